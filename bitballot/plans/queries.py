"""The registered queries of the classification engine, over the test tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitballot.functions import bits as B
from bitballot.operators import baselines, clauses, fit, metrics
from bitballot.operators import train as training
from bitballot.operators import models as model_files
from bitballot.plans import files
from bitballot.plans import fixtures as fx
from bitballot.plans.files import LINEAR, SCALER, perceptron, shifted_tree
from bitballot.sources import catalogue, formats, readers
from bitballot.sources.scratch import Folder

COLUMNS = list(fx.FEATURES)
QUERIES = dict(files.QUERIES)


def query(f):
    QUERIES[f.__name__] = f
    return f


def r9(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, for results that do not depend on the order of sums."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def rows_of(spark, values, schema):
    return spark.createDataFrame(values, schema)


def with_model(spark, sf_dir):
    df = fx.line(spark, sf_dir)
    return df, fx.fixture_model(df)


def cells_of(df: DataFrame) -> DataFrame:
    """feat, val: the four features, a sparse one, its negation and a constant."""
    sparse = F.when(F.col("quantity") > 35, F.col("price")).otherwise(F.lit(0.0)).cast("double")
    return df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in COLUMNS], sparse, -sparse, F.lit(1.0))).alias("feat", "val"))


def all_cells(spark, sf_dir) -> DataFrame:
    return cells_of(fx.line(spark, sf_dir))


def dense_cells(spark, sf_dir) -> DataFrame:
    return all_cells(spark, sf_dir).where("feat < 2")


def edges15(cells: DataFrame) -> DataFrame:
    return fit.quantile_edges(cells, 15)


# ---- bits ----


@query
def binarise_bits(spark, sf_dir):
    df, m = with_model(spark, sf_dir)
    return df.select("row_id", F.concat(*[b.cast("int").cast("string") for b in clauses.feature_bits(COLUMNS, m.feat, m.thresh)]).alias("bits"))


@query
def pack_words(spark, sf_dir):
    df, m = with_model(spark, sf_dir)
    return clauses.packed(df, COLUMNS, m).select("row_id", *[f"w{i}" for i in range(m.words)])


@query
def pack_bytes_msb(spark, sf_dir):
    df, m = with_model(spark, sf_dir)
    return df.select("row_id", F.hex(B.packed_bytes(clauses.feature_bits(COLUMNS, m.feat, m.thresh))).alias("bytes"))


@query
def booleanize_strict(spark, sf_dir):
    df = fx.line(spark, sf_dir)
    bits = B.booleanize([F.col(c) for c in COLUMNS], [0.04, 25.0, 30000.0])
    return df.select("row_id", F.concat(*[b.cast("int").cast("string") for b in bits]).alias("bits"))


@query
def bit_get_set(spark, sf_dir):
    df, m = with_model(spark, sf_dir)
    w = F.col("w0")
    count = lambda c, name: F.bit_count(c).cast("int").alias(name)
    return clauses.packed(df, COLUMNS, m).select("row_id", B.get(w, 0).alias("b0"), B.get(w, 63).alias("b63"), count(w, "ones"), count(B.put(w, 5, True), "ones_put"), count(B.put(w, 63, False), "ones_cut"))


@query
def bit_counts(spark, sf_dir):
    """Rows that reach each threshold, by the join of cells with thresholds."""
    df, m = with_model(spark, sf_dir)
    on = clauses.bit_cells(fx.cells(df), m.threshold_table(spark))
    return on.groupBy("bit").agg(F.sum(F.col("on").cast("long")).alias("n"))


@query
def bit_density(spark, sf_dir):
    df, m = with_model(spark, sf_dir)
    ones = sum((F.bit_count(f"w{i}") for i in range(m.words)), F.lit(0))
    n = len(m.feat)
    return r9(clauses.packed(df, COLUMNS, m).agg((F.count("*") * n).alias("cells"), F.sum(ones).alias("ones")).withColumn("density", F.coalesce(F.try_divide("ones", "cells"), F.lit(0.0))))


# ---- fitting ----


@query
def threshold_table(spark, sf_dir):
    return fx.fixture_thresholds(fx.line(spark, sf_dir))


@query
def fit_thresholds(spark, sf_dir):
    """The whole fit; its refill of dead bits is sequential, so its SQL holds where no bit is dropped.

    Routing and numeric edges come from a bounded sample, categorical values from all rows, as in the reference.
    """
    df = fx.line(spark, sf_dir)
    return fit.fit(cells_of(fx.sample(df)), 15, cells_of(df))


@query
def const_col_filter(spark, sf_dir):
    return fit.routing(all_cells(spark, sf_dir)).where("n_distinct > 1").select("feat")


@query
def col_routing(spark, sf_dir):
    return fit.routing(all_cells(spark, sf_dir))


@query
def cat_edges(spark, sf_dir):
    return r9(fit.categorical_edges(all_cells(spark, sf_dir)))


@query
def bit_budget(spark, sf_dir):
    return r9(fit.budgets(all_cells(spark, sf_dir)))


@query
def quantile_edges(spark, sf_dir):
    return r9(edges15(dense_cells(spark, sf_dir)), 6)


@query
def gap_test(spark, sf_dir):
    g = r9(fit.gaps(all_cells(spark, sf_dir)), 6)
    return g.withColumn("structural", F.coalesce((F.col("median_gap") > 0) & (F.col("max_gap") > fit.GAP * F.col("median_gap")), F.lit(False)))


@query
def gap_snap(spark, sf_dir):
    c = dense_cells(spark, sf_dir)
    return r9(fit.snap(c, edges15(c)), 6)


@query
def perturb_edges(spark, sf_dir):
    c = dense_cells(spark, sf_dir)
    return r9(fit.perturb(c, edges15(c)), 6)


@query
def bit_entropy(spark, sf_dir):
    c = dense_cells(spark, sf_dir)
    e = fit.bit_entropy(c, edges15(c))
    return e.select("feat", F.round("edge", 6).alias("edge"), F.round("p", 9).alias("p"), F.round("entropy", 9).alias("entropy"))


@query
def dead_bits(spark, sf_dir):
    c = dense_cells(spark, sf_dir)
    e = fit.quantiles(c, [0.002, 0.5, 0.9985]).select("feat", "edge")
    return fit.bit_entropy(c, e).select("feat", F.round("edge", 6).alias("edge"), (F.col("entropy") >= fit.FLOOR).alias("alive"))


@query
def sparse_prefix(spark, sf_dir):
    return r9(fit.sparse_prefix(all_cells(spark, sf_dir)), 6)


@query
def threshold_quantise(spark, sf_dir):
    d = fit.quantised(fx.fixture_thresholds(fx.line(spark, sf_dir)))
    return d.select("bit", "feat", "q", F.round("scale", 9).alias("scale"), F.round("zero", 9).alias("zero"), F.round(F.col("thresh").cast("double"), 6).alias("thresh"))


# ---- clauses ----


def outputs(spark, sf_dir, xor=False):
    df, m = with_model(spark, sf_dir)
    d = clauses.with_clauses(clauses.packed_batches(df, COLUMNS, m), m).withColumn("wrong", clauses.mismatch(m, xor))
    return d.withColumn("out", F.greatest(F.col("clamp") - F.col("wrong"), F.lit(0)))


def summed(d):
    return d.groupBy("class", "sign", "clause").agg(F.sum("wrong").alias("wrong"), F.sum((F.col("wrong") == 0).cast("long")).alias("perfect"))


@query
def clause_mismatch(spark, sf_dir):
    return summed(outputs(spark, sf_dir))


@query
def clause_xor(spark, sf_dir):
    return summed(outputs(spark, sf_dir, True))


@query
def clause_output(spark, sf_dir):
    return outputs(spark, sf_dir).groupBy("class", "sign", "clause").agg(F.sum("out").alias("output"), F.sum((F.col("out") > 0).cast("long")).alias("fired"))


@query
def team_votes(spark, sf_dir):
    side = lambda s, name: F.sum(F.when(F.col("sign") == s, F.col("out")).otherwise(0)).cast("long").alias(name)
    return outputs(spark, sf_dir).groupBy("row_id", "class").agg(side(1, "positive"), side(-1, "negative"))


@query
def class_votes(spark, sf_dir):
    return clauses.votes_relational(*_args(spark, sf_dir))


def _args(spark, sf_dir):
    df, m = with_model(spark, sf_dir)
    return df, COLUMNS, m


@query
def tm_predict(spark, sf_dir):
    return clauses.predict(*_args(spark, sf_dir)).select("row_id", "pred")


@query
def tm_predict_relational(spark, sf_dir):
    return clauses.predict_relational(*_args(spark, sf_dir))


@query
def tm_predict_sparse(spark, sf_dir):
    return clauses.predict_sparse(*_args(spark, sf_dir))


@query
def tm_predict_expression(spark, sf_dir):
    return clauses.predict_expression(*_args(spark, sf_dir))


@query
def tm_predict_binary(spark, sf_dir):
    """Positive votes over negative ones; a tie is false."""
    df, m = with_model(spark, sf_dir)
    one = np.flatnonzero(m.cls == 1)  # the other classes' clauses are not scored
    m = clauses.ClauseModel(m.feat, m.thresh, m.cls[one], m.sign[one], m.clause[one], m.clamp[one], m.pos[one], m.neg[one], m.classes)
    return clauses.votes_relational(df, COLUMNS, m).select("row_id", (F.col("votes") > 0).alias("pred"))


@query
def clause_decode(spark, sf_dir):
    return clauses.decoded(with_model(spark, sf_dir)[1], spark)


@query
def literal_stats(spark, sf_dir):
    m = with_model(spark, sf_dir)[1]
    n = F.aggregate("pos", F.lit(0), lambda a, w: a + F.bit_count(w)) + F.aggregate("neg", F.lit(0), lambda a, w: a + F.bit_count(w))
    d = m.clause_table(spark).withColumn("n", n).groupBy("class", "sign").agg(F.count("*").alias("clauses"), F.sum("n").alias("literals"), F.avg("n").alias("mean_literals"), F.sum((F.col("n") == 0).cast("long")).alias("empty"))
    return r9(d.withColumn("density", F.col("literals") / (F.col("clauses") * 2 * F.lit(len(m.feat)))))


@query
def density_stats(spark, sf_dir):
    """Size of a model: plain bytes of its dense and of its sparse body."""
    m = with_model(spark, sf_dir)[1]
    n = F.size("pos") + F.size("neg")
    d = rows_of(spark, m.rows(), "class int, sign int, clause int, clamp int, pos array<int>, neg array<int>")
    size, head = (len(m.feat) + 7) // 8, 4 * m.classes
    return r9(d.agg(F.count("*").alias("clauses"), F.sum(n).alias("literals"), F.avg(n).alias("mean")).select("clauses", "literals", "mean", F.lit(len(m.feat)).cast("long").alias("n_bits"), (F.lit(head) + F.col("clauses") * (1 + 2 * size)).alias("dense_bytes"), (F.lit(head) + F.col("clauses") * 5 + 2 * F.col("literals")).alias("sparse_bytes")))


@query
def clause_layout(spark, sf_dir):
    m = with_model(spark, sf_dir)[1]
    r = F.row_number().over(W.orderBy("class", F.desc("sign"), "clause")) - 1
    d = m.clause_table(spark).withColumn("r", r)
    return d.groupBy("class", "sign").agg(F.min("r").cast("int").alias("start"), (F.max("r") + 1).cast("int").alias("stop"))


@query
def mask_to_index(spark, sf_dir):
    m = with_model(spark, sf_dir)[1]
    told = lambda c: F.array_join(B.indexes(F.col(c), len(m.feat)).cast("array<string>"), ",").alias(c)
    return m.clause_table(spark).select("class", "sign", "clause", told("pos"), told("neg"))


@query
def index_to_mask(spark, sf_dir):
    m = with_model(spark, sf_dir)[1]
    d = m.literal_table(spark).withColumn("word", (F.col("bit") / 64).cast("int"))
    return d.groupBy("class", "sign", "clause", "negated", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("mask"))


@query
def bytes_to_words(spark, sf_dir):
    """The masks of the clauses as the bytes of a dense file, back in words."""
    m = with_model(spark, sf_dir)[1]
    size = (len(m.feat) + 7) // 8
    rows = [(k, s, c, bytearray(formats.mask(p, size))) for k, s, c, _, p, _ in m.rows()]
    d = rows_of(spark, rows, "class int, sign int, clause int, data binary")
    return d.select("class", "sign", "clause", *[w.alias(f"w{i}") for i, w in enumerate(B.words_of_bytes(F.col("data"), m.words))])


@query
def dense_sparse_match(spark, sf_dir):
    """Predictions of a model from its dense file and from its sparse file, row by row."""
    df, m = with_model(spark, sf_dir)
    a, b = (clauses.predict(df, COLUMNS, formats.decode(formats.encode(m, sparse=s))).select("row_id", F.col("pred").alias(f"p{int(s)}")) for s in (False, True))
    both = a.join(b, "row_id", "full_outer")
    return both.agg(F.count("*").alias("compared"), F.sum(F.col("p0").eqNullSafe(F.col("p1")).cast("long")).alias("equal"))


@query
def strategies_agree(spark, sf_dir):
    """Votes from Arrow batches against those of the relational plan."""
    df, m = with_model(spark, sf_dir)
    a = clauses.predict(df, COLUMNS, m).select("row_id", "votes")
    b = clauses.votes_relational(df, COLUMNS, m).groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "votes"))), lambda s: s["votes"]).alias("v"))
    return a.join(b, "row_id", "full_outer").agg(F.count("*").alias("compared"), F.sum(F.col("votes").eqNullSafe(F.col("v")).cast("long")).alias("equal"))


@query
def clamp_rule(spark, sf_dir):
    m = with_model(spark, sf_dir)[1]
    n = rows_of(spark, sorted({(len(r[4]) + len(r[5]),) for r in m.rows()}), "literals long")
    lf = n.withColumn("lf", F.explode(F.array(F.lit(4), F.lit(6), F.lit(15))))
    return lf.withColumn("clamp", F.when((F.col("literals") > 0) & (F.col("literals") < F.col("lf")), F.col("literals")).otherwise(F.col("lf")).cast("int"))


@query
def update_prob(spark, sf_dir):
    """Mean chance of feedback by class, for samples of the class and for others, from the votes of all rows."""
    df, m = with_model(spark, sf_dir)
    votes = clauses.predict(df, COLUMNS, m, ("row_id", "y")).select("y", F.posexplode("votes").alias("class", "v"))
    d = votes.select("class", (F.col("y") == F.col("class")).alias("own"), "v")
    p = training.update_chance(10, F.col("v"), F.col("own"))
    return r9(d.groupBy("class", "own").agg(F.count("*").alias("n"), F.avg(p).alias("p")))


@query
def parameter_counts(spark, sf_dir):
    """By class, the automata of a model in training (a literal and its negation a bit and clause) and the literals that a compiled one holds."""
    m = with_model(spark, sf_dir)[1]
    n = F.size("pos") + F.size("neg")
    d = rows_of(spark, m.rows(), "class int, sign int, clause int, clamp int, pos array<int>, neg array<int>")
    return d.groupBy("class").agg((F.count("*") * 2 * len(m.feat)).alias("before"), F.sum(n).alias("after"))


@query
def deploy_scores(spark, sf_dir):
    """The first ten predictions by identifier, as the command line shows them."""
    return tm_predict(spark, sf_dir).orderBy("row_id").limit(10)


@query
def model_prune(spark, sf_dir):
    """Votes of the pruned model and its constant votes: those of the whole model."""
    df, m = with_model(spark, sf_dir)
    small, bias = m.pruned()
    add = rows_of(spark, [(k, int(b)) for k, b in enumerate(bias)], "class int, bias long")
    votes = clauses.votes_relational(df, COLUMNS, small)
    every = df.select("row_id").join(F.broadcast(add)).join(votes, ["row_id", "class"], "left")
    return every.select("row_id", "class", (F.coalesce("votes", F.lit(0)) + F.col("bias")).alias("votes"))


# ---- metrics ----


def predicted(spark, sf_dir):
    df, m = with_model(spark, sf_dir)
    return clauses.predict(df, COLUMNS, m, ("row_id", "y"))


@query
def confusion(spark, sf_dir):
    return metrics.confusion(predicted(spark, sf_dir))


@query
def accuracy(spark, sf_dir):
    return r9(metrics.accuracy(predicted(spark, sf_dir)))


@query
def macro_f1_header(spark, sf_dir):
    """Over four classes of which one never occurs."""
    return r9(metrics.macro(metrics.confusion(predicted(spark, sf_dir)), domain="header", classes=4))


@query
def macro_f1_max_label(spark, sf_dir):
    return r9(metrics.macro(metrics.confusion(predicted(spark, sf_dir)), domain="max_label"))


@query
def macro_f1_truth(spark, sf_dir):
    return r9(metrics.macro(metrics.confusion(predicted(spark, sf_dir)), domain="truth"))


@query
def macro_f1_union(spark, sf_dir):
    return r9(metrics.macro(metrics.confusion(predicted(spark, sf_dir)), domain="union"))


@query
def per_class_f1(spark, sf_dir):
    return r9(metrics.per_class(metrics.confusion(predicted(spark, sf_dir))).drop("precision", "recall"))


@query
def class_union(spark, sf_dir):
    c = metrics.confusion(predicted(spark, sf_dir))
    return c.select(F.col("y").alias("class")).union(c.select("pred")).distinct()


# ---- baselines ----


@query
def dt_predict(spark, sf_dir):
    return baselines.predict_tree(fx.line(spark, sf_dir), shifted_tree(0), COLUMNS)


@query
def rf_vote(spark, sf_dir):
    return baselines.predict_forest(fx.line(spark, sf_dir), [shifted_tree(t) for t in range(5)], COLUMNS)


def scaled():
    return baselines.scaled(COLUMNS, *SCALER)


@query
def standard_scale(spark, sf_dir):
    return fx.line(spark, sf_dir).select("row_id", *[c.alias(n) for c, n in zip(scaled(), "abcd")])


@query
def linear_multi(spark, sf_dir):
    return baselines.predict_linear(fx.line(spark, sf_dir), scaled(), *LINEAR)


@query
def linear_binary(spark, sf_dir):
    return baselines.predict_linear(fx.line(spark, sf_dir), scaled(), [[2, -1, 1, -3]], [-1])


@query
def gnb_predict(spark, sf_dir):
    df = fx.line(spark, sf_dir)
    return baselines.predict_gnb(df, baselines.gnb_fit(df, COLUMNS[:2]), COLUMNS[:2]).select("row_id", "pred")


def embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("x"), F.col("label").alias("y"))


@query
def mlp_predict(spark, sf_dir):
    return baselines.predict_mlp(embeddings(spark, sf_dir), "x", perceptron())


@query
def knn_predict(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return baselines.predict_knn(e.where("vec_id % 5 = 0"), e.where("vec_id % 5 <> 0"), 5)


@query
def tree_offsets(spark, sf_dir):
    """Node offsets of trees: here the nations of each region."""
    return baselines.tree_offsets(spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("cast(n_regionkey as int) tree", "n_nationkey node"))


# ---- splits, training, reports ----


@query
def stratified_split(spark, sf_dir):
    d = training.stratified_split(fx.line(spark, sf_dir))
    return d.groupBy("y").agg(F.sum(F.col("train").cast("long")).alias("train"), F.sum((~F.col("train")).cast("long")).alias("test"))


@query
def class_weight_lookup(spark, sf_dir):
    return metrics.class_weights(fx.line(spark, sf_dir).groupBy("y").agg(F.count("*").alias("n")), {0: 2.0, 2: 0.5})


#: The most rows that a training reads: each class's task walks all of them in order, once an epoch.
TRAIN_ROWS = 20_000


@query
def train_model(spark, sf_dir):
    """Clauses of a seeded training on at most TRAIN_ROWS rows: the trainer takes a bounded set by design; no SQL."""
    df, m = with_model(spark, sf_dir)
    rows = clauses.packed(fx.sample(df, TRAIN_ROWS), COLUMNS, m).select("row_id", F.array(*[f"w{i}" for i in range(m.words)]).alias("words"), "y")
    return training.train(rows, len(m.feat), [0, 1, 2], clauses=10, epochs=2)


def history(spark, sf_dir):
    """Accuracy and F1 of four checkpoints: the fixture model with its first 5, 10, 15 and 20 clauses of a class and sign."""
    df, m = with_model(spark, sf_dir)
    models = {e: clauses.ClauseModel.of(m.feat, m.thresh, [r for r in m.rows() if r[2] < 5 * e], m.classes) for e in range(1, 5)}
    return r9(training.history(training.evaluated(df, COLUMNS, models)))


@query
def checkpoint_history(spark, sf_dir):
    return history(spark, sf_dir)


@query
def best_checkpoint(spark, sf_dir):
    return training.best_checkpoint(history(spark, sf_dir))


@query
def running_best(spark, sf_dir):
    return training.running_best(history(spark, sf_dir))


@query
def topk_models(spark, sf_dir):
    return training.best_models(history(spark, sf_dir), 2)


def results(spark, sf_dir):
    """model, acc: the share of rows that each model predicts right."""
    df, m = with_model(spark, sf_dir)
    keep = ("row_id", "y")
    found = {
        "clauses": clauses.predict(df, COLUMNS, m, keep),
        "tree": baselines.predict_tree(df, shifted_tree(0), COLUMNS, keep),
        "forest": baselines.predict_forest(df, [shifted_tree(t) for t in range(5)], COLUMNS, keep),
        "linear": baselines.predict_linear(df, scaled(), *LINEAR, keep),
    }
    out = None
    for name, p in found.items():
        told = metrics.accuracy(p).select(F.lit(name).alias("model"), F.round("accuracy", 9).alias("acc"))
        out = told if out is None else out.unionByName(told)
    return out


@query
def summary_upsert(spark, sf_dir):
    """A summary of results that has an old row of one model, brought up to date."""
    new = results(spark, sf_dir)
    old = new.withColumn("acc", F.when(F.col("model") == "clauses", F.lit(0.0)).otherwise(F.col("acc")))
    return readers.upsert(old, new.where("model = 'clauses'"), "model")


@query
def report_sorted(spark, sf_dir):
    """The report's lines, most accurate first, as they are written to a text file."""
    r = results(spark, sf_dir).select("model", F.round("acc", 4).alias("acc"))
    return catalogue.report(r, "%-10s|%8.4f", [F.desc("acc"), F.col("model")], Folder(spark).path("report"))


@query
def model_gap(spark, sf_dir):
    r = results(spark, sf_dir)
    a = r.where("model = 'clauses'").agg(F.first("acc").alias("c"))
    b = r.where("model <> 'clauses'")
    return b.join(F.broadcast(a)).select("model", F.round(F.col("c") / F.col("acc"), 6).alias("ratio"), F.round(F.col("c") - F.col("acc"), 6).alias("gain"))  # one row broadcast


@query
def cycle_sample(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("n_nationkey"))
    return spark.range(100).select(F.col("id").alias("i"), F.pmod("id", F.lit(25)).alias("n_nationkey")).join(F.broadcast(nation), "n_nationkey").select("i", "n_nationkey")


@query
def replicate(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nation.select(F.col("n_regionkey").cast("long").alias("n_regionkey"), F.explode(F.sequence(F.lit(1), F.lit(4)))).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query
def full_convolution(spark, sf_dir):
    """Nations as a matrix by region and key, spread by a kernel made of the regions."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    a = nation.groupBy(F.col("n_regionkey").cast("int").alias("i"), F.expr("cast(n_nationkey % 5 as int)").alias("j")).agg(F.sum(F.col("n_nationkey").cast("long") - 7).alias("v"))
    return convolve(a, region.selectExpr("cast(r_regionkey % 2 as int) p", "cast(r_regionkey div 2 as int) q", "cast(r_regionkey as bigint) - 1 w"))


@query
def shuffled(spark, sf_dir):
    """Nations in an order by hash, the same for the same seed."""
    d = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("n_nationkey"))
    return training.shuffled(d, "n_nationkey", 7)


def convolve(a: DataFrame, kernel: DataFrame) -> DataFrame:
    """Every cell (i, j, v) spreads over the offsets (p, q, w) of a small kernel."""
    d = a.join(F.broadcast(kernel)).select((F.col("i") + F.col("p")).alias("i"), (F.col("j") + F.col("q")).alias("j"), (F.col("v") * F.col("w")).alias("v"))
    return d.groupBy("i", "j").agg(F.sum("v").alias("v"))


@query
def string_table(spark, sf_dir):
    """Strings through the counted layout of the files and back."""
    brands = [r[0] for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand").distinct().orderBy("p_brand").limit(65_536).collect()]  # the layout counts to 65 535; more are refused
    back = formats.string_table(formats.packed_strings(brands))
    return rows_of(spark, [(s, len(s.encode())) for s in back], "s string, n int")


@query
def scaler_membership(spark, sf_dir):
    """Which of the models with results take scaled features."""
    return results(spark, sf_dir).select("model", F.col("model").isin(*model_files.SCALED).alias("scaled"))


@query
def event_scores_hourly(spark, sf_dir):
    """Predictions of a one-threshold tree by hour: the batch form of the streaming query."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    tree = {0: (0, float(np.nextafter(np.float32(50), np.float32(0))), 1, 2, 0), 1: (-1, 0.0, -1, -1, 0), 2: (-1, 0.0, -1, -1, 1)}
    d = baselines.predict_tree(e.withColumn("v", F.col("value").cast("float")), tree, ["v"], ("ts",))
    return d.groupBy(F.window("ts", "1 hour").alias("w"), "pred").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "pred", "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit, binarise, score and evaluate: precision, recall and F1 by class."""
    return per_class_f1(spark, sf_dir)
