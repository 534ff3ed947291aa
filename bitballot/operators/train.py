"""Seeded training of clause models: one task per class.

With the stream of samples fixed by the seed, a class's clauses see only that stream, so classes train apart.
A sample of its class gives feedback I to the clauses for the class and II to those against it, any other sample
the other way round, each clause with a chance that falls as the votes reach the target.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitballot.operators.clauses import ClauseModel


class Team:
    """Automata of one class: states [sign, negated, clause, bit]; a literal is in from ``include`` on."""

    def __init__(self, bits: int, clauses: int, T: int, S: int, L: int, LF: int, states: int = 256, include: int = 128, seed: int = 1):
        self.state = np.full((2, 2, clauses, bits), include - 1, np.int32)
        self.T, self.s, self.L, self.LF, self.include, self.top = T, round(bits / S), L, LF, include, states - 1
        self.rng = np.random.RandomState(seed)

    def inside(self):
        return self.state >= self.include

    def clamps(self):
        n = self.inside().sum(axis=(1, 3))
        return np.where((n > 0) & (n < self.LF), n, self.LF), n

    def outputs(self, x):
        inside = self.inside()
        wrong = (inside[:, 0] & ~x).sum(axis=2) + (inside[:, 1] & x).sum(axis=2)
        return np.maximum(self.clamps()[0] - wrong, 0)

    def step(self, x, own: bool, weight: float = 1.0):
        out = self.outputs(x)
        v = int(np.clip(out[0].sum() - out[1].sum(), -self.T, self.T))
        chance = update_probability(self.T, v, own, weight)
        first, second = (0, 1) if own else (1, 0)
        literals = np.stack([x, ~x])  # what each kind of literal needs
        _, size = self.clamps()
        inside = self.inside()
        for c in np.flatnonzero(self.rng.random_sample(out.shape[1]) < chance):
            mine = self.state[first, :, c]
            if out[first, c] > 0:
                if size[first, c] < self.L:
                    mine[literals] = np.minimum(mine[literals] + 1, self.top)
                fall = ~literals & ~inside[first, :, c]
                mine[fall] = np.maximum(mine[fall] - 1, 0)
            else:
                for kind in (0, 1):
                    hit = np.bincount(self.rng.randint(0, len(x), self.s), minlength=len(x)) if self.s else 0
                    mine[kind] = np.maximum(mine[kind] - hit, 0)
        for c in np.flatnonzero(self.rng.random_sample(out.shape[1]) < chance):
            if out[second, c] > 0:
                mine = self.state[second, :, c]
                mine[~literals & ~inside[second, :, c]] += 1

    def rows(self, k: int):
        clamps, _ = self.clamps()
        inside = self.inside()
        return [(k, 1 - 2 * g, c, int(clamps[g, c]), np.flatnonzero(inside[g, 0, c]).tolist(), np.flatnonzero(inside[g, 1, c]).tolist()) for g in (0, 1) for c in range(inside.shape[2])]


def update_probability(T: int, v: int, own: bool, weight: float = 1.0) -> float:
    return min(1.0, max(0.0, (T - v if own else T + v) / (2 * T) * weight))


def update_chance(T: int, v, own, weight=1.0):
    """``update_probability`` of columns: votes, whether the sample is of the class, and its weight."""
    v = F.least(F.lit(T), F.greatest(F.lit(-T), v))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(own, T - v).otherwise(T + v) / F.lit(2.0 * T) * weight))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds ``place``, from 0: a permutation by hash of a key, for the bounded rows of an epoch (they are numbered in one task)."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return df.withColumn("place", (F.row_number().over(W.orderBy(h, key)) - 1).cast("long"))


def train(df: DataFrame, n_bits: int, classes: list[int], clauses: int = 20, T: int = 10, S: int = 20, L: int = 16, LF: int = 4, epochs: int = 3, seed: int = 1, weights: dict[int, float] | None = None) -> DataFrame:
    """epoch, class, sign, clause, clamp, include, include_negated of rows (row_id, words array<long>, y).

    Training is sequential by nature, so its rows are a bounded set that the caller chooses; each class's task gets
    all of them and only ``n_bits`` bits a row.
    """
    spark = df.sparkSession
    weights = weights or {}
    per_class = df.join(F.broadcast(spark.createDataFrame([(k,) for k in classes], "class int")))

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("row_id")
        k = int(pdf["class"].iloc[0])
        words = np.stack(pdf["words"]).astype(np.int64).view(np.uint64)
        x = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, :n_bits].astype(bool)
        y = pdf["y"].to_numpy()
        team = Team(n_bits, max(1, clauses // 2), T, S, L, LF, seed=seed * 1000 + k)
        order = np.random.RandomState(seed)
        out = []
        for epoch in range(1, epochs + 1):
            for i in order.permutation(len(x)):
                team.step(x[i], bool(y[i] == k), weights.get(int(y[i]), 1.0))
            out += [(epoch, *r) for r in team.rows(k)]
        return pd.DataFrame(out, columns=["epoch", "class", "sign", "clause", "clamp", "include", "include_negated"])

    return per_class.groupBy("class").applyInPandas(one, "epoch int, class int, sign int, clause int, clamp int, include array<int>, include_negated array<int>")


def order_statistic(df: DataFrame, label: str, key: str, share: float, bits: int = 60, step: int = 12) -> DataFrame:
    """label, cut: the value at place floor(share * (n - 1)) of the integers ``key`` below 2^bits, by label.

    Two histograms of their leading bits narrow the place to one bin, of which alone the values are sorted.
    """
    left = df.groupBy(label).agg(F.floor(F.lit(share) * (F.count("*") - 1)).alias("_left")).withColumn("_bin", F.lit(0).cast("long"))
    rows, shift = df.select(label, key), bits
    for _ in range(2):
        shift -= step
        met = rows.join(F.broadcast(left), label).where(F.shiftright(key, shift + step) == F.col("_bin"))
        n = met.groupBy(label, F.shiftright(key, shift).alias("_bin")).agg(F.count("*").alias("_n"), F.first("_left").alias("_left"))
        before = F.sum("_n").over(W.partitionBy(label).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
        n = n.withColumn("_before", before).where((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_n")))
        left = n.select(label, "_bin", (F.col("_left") - F.col("_before")).alias("_left"))
    last = rows.join(F.broadcast(left), label).where(F.shiftright(key, shift) == F.col("_bin"))
    place = F.row_number().over(W.partitionBy(label).orderBy(key)) - 1
    return last.withColumn("_place", place).where("_place = _left").select(label, F.col(key).alias("cut"))


def stratified_split(df: DataFrame, label: str = "y", key: str = "row_id", percent: int = 80) -> DataFrame:
    """Adds ``train``: true for the rows of a label whose identifier (a hash of 60 bits) is in its lower ``percent`` of that label.

    A label has a row in the broadcast table of cuts.
    """
    cut = order_statistic(df, label, key, percent / 100).withColumnRenamed("cut", "_cut")
    return df.join(F.broadcast(cut), label).withColumn("train", F.col(key) <= F.col("_cut")).drop("_cut")


def evaluated(df: DataFrame, columns: list[str], models: dict[int, ClauseModel], label: str = "y") -> DataFrame:
    """epoch, y, pred, n: the confusion counts of each epoch's model, all in one scan of the features."""
    small = {e: m.pruned() for e, m in models.items()}
    shared = df.sparkSession.sparkContext.broadcast({e: (vars(m), bias) for e, (m, bias) in small.items()})

    def run(batches):
        import pyarrow as pa

        models = {e: (ClauseModel(**m), bias) for e, (m, bias) in shared.value.items()}
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float32) for c in columns], axis=1)
            y, out = batch.column(label).to_numpy(zero_copy_only=False).astype(np.int64), []
            for epoch, (m, bias) in models.items():
                pred = (m.votes(m.pack(x)) + bias).argmax(axis=1)
                pairs, n = np.unique(np.stack([y, pred], axis=1), axis=0, return_counts=True)
                out += [(epoch, int(a), int(b), int(c)) for (a, b), c in zip(pairs, n)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["epoch", "y", "pred", "n"])

    counts = df.select(*dict.fromkeys([*columns, label])).where(F.col(label).isNotNull()).mapInArrow(run, "epoch int, y int, pred int, n long")
    return counts.groupBy("epoch", "y", "pred").agg(F.sum("n").alias("n"))


def history(counts: DataFrame) -> DataFrame:
    """epoch, acc, f1 (macro over labels and predictions) of ``evaluated`` counts."""
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
    acc = counts.groupBy("epoch").agg(rate(F.sum(hit), F.sum("n")).alias("acc"))
    sides = counts.select("epoch", F.explode(F.array(F.struct(F.col("y").alias("class"), hit.alias("tp"), F.col("n").alias("size")), F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("size")))).alias("s")).select("epoch", "s.*")
    per = sides.groupBy("epoch", "class").agg(rate(2 * F.sum("tp"), F.sum("size")).alias("f1"))
    return acc.join(per.groupBy("epoch").agg(F.avg("f1").alias("f1")), "epoch").select("epoch", "acc", "f1")


def best_checkpoint(told: DataFrame) -> DataFrame:
    """The epoch of the largest f1, the first on ties."""
    best = F.max_by(F.struct("epoch", "f1"), F.struct("f1", -F.col("epoch")))
    return told.agg(best.alias("b")).where("b is not null").select("b.*")


def running_best(told: DataFrame) -> DataFrame:
    """epoch, best accuracy so far, and whether the epoch improved it.  One row an epoch."""
    w = W.orderBy("epoch")
    before = F.max("acc").over(w.rowsBetween(W.unboundedPreceding, -1))
    return told.select("epoch", F.max("acc").over(w).alias("best"), (F.col("acc") > F.coalesce(before, F.lit(-1.0))).alias("improved"))


def best_models(told: DataFrame, k: int) -> DataFrame:
    """epoch, acc of the k most accurate epochs, the first on ties."""
    return told.orderBy(F.desc("acc"), "epoch").limit(k).select("epoch", "acc")


def fit_loop(rows: DataFrame, test: DataFrame, columns: list[str], feat, thresh, classes: list[int], keep: int = 3, **how) -> tuple[DataFrame, ClauseModel, dict[int, ClauseModel]]:
    """History, the model of the best f1 and those of the ``keep`` most accurate epochs.

    ``rows``: see ``train``; every epoch's model predicts ``test`` (the features and y), in one scan for all of them.
    Models are a table bounded by clauses and epochs; the caller should choose a test set that no result is reported on.
    """
    trained = train(rows, len(feat), classes, **how).collect()
    by: dict[int, list] = {}
    for r in trained:
        by.setdefault(r["epoch"], []).append((r["class"], r["sign"], r["clause"], r["clamp"], r["include"], r["include_negated"]))
    models = {e: ClauseModel.of(feat, thresh, sorted(found, key=lambda r: (r[0], -r[1], r[2])), 1 + max(classes)) for e, found in by.items()}
    told = history(evaluated(test, columns, models))
    scored = told.collect()  # a row an epoch
    best = max(scored, key=lambda r: (r["f1"], -r["epoch"]))["epoch"]
    kept = sorted(scored, key=lambda r: (-r["acc"], r["epoch"]))[:keep]
    return rows.sparkSession.createDataFrame(scored, told.schema), models[best], {r["epoch"]: models[r["epoch"]] for r in kept}
