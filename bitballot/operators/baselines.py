"""Scoring by trees, forests, linear models, Gaussian naive Bayes, perceptrons and nearest neighbours, models as tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tree_expression(nodes: dict[int, tuple], columns: list[str], node: int = 0) -> Column:
    """Nested conditions of a tree {node: (feat, thresh, left, right, leaf class)}; feat -1 is a leaf; NaN goes right."""
    feat, thresh, left, right, leaf = nodes[node]
    if feat < 0:
        return F.lit(leaf)
    x = F.col(columns[feat])
    goes = F.coalesce(~F.isnan(x) & (x <= F.lit(float(thresh)).cast("float")), F.lit(False))
    return F.when(goes, tree_expression(nodes, columns, left)).otherwise(tree_expression(nodes, columns, right))


def predict_tree(df: DataFrame, nodes: dict[int, tuple], columns: list[str], keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """A tree of up to some hundred nodes as one expression; a larger one walks in Arrow batches."""
    if len(nodes) <= 255:
        return df.select(*keep, tree_expression(nodes, columns).cast("int").alias("pred"))
    return predict_forest(df, [nodes], columns, keep)


def walk(x: np.ndarray, nodes: dict[int, tuple]) -> np.ndarray:
    size = max(nodes) + 1
    table = np.array([nodes.get(i, (-1, 0, 0, 0, 0)) for i in range(size)], np.float64)
    at = np.zeros(len(x), np.int64)
    while True:
        feat = table[at, 0].astype(np.int64)
        live = np.flatnonzero(feat >= 0)
        if not len(live):
            return table[at, 4].astype(np.int64)
        with np.errstate(invalid="ignore"):
            left = x[live, feat[live]] <= table[at[live], 1].astype(np.float32)
        at[live] = np.where(left, table[at[live], 2], table[at[live], 3]).astype(np.int64)


def predict_forest(df: DataFrame, trees: list[dict[int, tuple]], columns: list[str], keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """The class of most trees, the least on ties."""
    shared = df.sparkSession.sparkContext.broadcast(trees)
    classes = 1 + max((n[4] for t in trees for n in t.values() if n[0] < 0), default=0)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float32) for c in columns], axis=1)
            votes = np.zeros((len(x), classes), np.int64)
            for nodes in shared.value:
                votes[np.arange(len(x)), walk(x, nodes)] += 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(votes.argmax(axis=1).astype(np.int32))], [*keep, "pred"])

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*dict.fromkeys([*keep, *columns])).mapInArrow(run, f"{schema}, pred int")


def forest_table(trees: list[dict[int, tuple]], spark) -> DataFrame:
    """tree, node, feat, thresh, left, right, leaf_cls with node numbers offset by the sizes of the trees before."""
    rows = [(t, i, *nodes[i]) for t, nodes in enumerate(trees) for i in sorted(nodes)]
    d = spark.createDataFrame(rows, "tree int, node int, feat int, thresh float, left int, right int, leaf_cls int")
    offsets = tree_offsets(d)
    shift = lambda c: F.when(F.col("feat") >= 0, F.col(c) + F.col("offset")).otherwise(F.lit(-1)).alias(c)
    return d.join(F.broadcast(offsets), "tree").select("tree", (F.col("node") + F.col("offset")).alias("node"), "feat", "thresh", shift("left"), shift("right"), "leaf_cls")


def tree_offsets(nodes: DataFrame) -> DataFrame:
    n = nodes.groupBy("tree").agg(F.count("*").alias("n"))
    return n.select("tree", F.coalesce(F.sum("n").over(W.orderBy("tree").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))


def scaled(columns: list[str], mean: list[float], scale: list[float]) -> list[Column]:
    return [(F.col(c).cast("double") - m) / s for c, m, s in zip(columns, mean, scale)]


def first_largest(scores: list[Column]) -> Column:
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = F.lit(len(scores) - 1)
    for i in range(len(scores) - 2, -1, -1):
        out = F.when(scores[i] == best, F.lit(i)).otherwise(out)
    return out.cast("int")


def predict_linear(df: DataFrame, x: list[Column], coef, intercept, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """One row of coefficients: 1 where the score reaches 0; several: the largest score, the first on ties."""
    scores = []
    for row, b in zip(coef, intercept):
        s = F.lit(float(b))
        for v, w in zip(x, row):
            s = s + v * float(w)
        scores.append(s)
    named = df.select(*keep, *[s.alias(f"s{i}") for i, s in enumerate(scores)])
    cols = [F.col(f"s{i}") for i in range(len(scores))]
    return named.select(*keep, ((cols[0] >= 0).cast("int") if len(cols) == 1 else first_largest(cols)).alias("pred"))


def gnb_fit(df: DataFrame, columns: list[str], label: str = "y") -> DataFrame:
    """class, n, means and floored variances of each column."""
    aggs = [f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("var", F.var_pop))]
    return df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"), *aggs).withColumns({f"var_{c}": F.greatest(F.col(f"var_{c}"), F.lit(1e-9)) for c in columns})


def predict_gnb(df: DataFrame, model: DataFrame, columns: list[str], keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """The class of the largest log density, the first on ties.  The model has a row per class and is collected."""
    rows = model.orderBy("class").collect()
    total = sum(r["n"] for r in rows)
    scores = []
    for r in rows:
        s = F.lit(math.log(r["n"] / total))
        for c in columns:
            m, v = r[f"mean_{c}"], r[f"var_{c}"]
            s = s - 0.5 * (F.lit(math.log(2 * math.pi * v)) + (F.col(c).cast("double") - m) * (F.col(c).cast("double") - m) / v)
        scores.append(s)
    named = df.select(*keep, *[s.alias(f"s{i}") for i, s in enumerate(scores)])
    best = first_largest([F.col(f"s{i}") for i in range(len(scores))])
    classes = F.array(*[F.lit(r["class"]) for r in rows])
    return named.select(*keep, classes[best].cast("int").alias("pred"), F.round(F.greatest(*[F.col(f"s{i}") for i in range(len(scores))]), 6).alias("log_density"))


def predict_mlp(df: DataFrame, x: str, layers: list[tuple[np.ndarray, np.ndarray]], keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """ReLU layers over an array column, the largest output, the first on ties; Arrow batches in double precision."""
    shared = df.sparkSession.sparkContext.broadcast(layers)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            a = matrix_of(batch.column(x))
            for i, (w, b) in enumerate(shared.value):
                a = a @ w + b
                if i < len(shared.value) - 1:
                    a = np.maximum(a, 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(a.argmax(axis=1).astype(np.int32))], [*keep, "pred"])

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*dict.fromkeys([*keep, x])).mapInArrow(run, f"{schema}, pred int")


def matrix_of(column) -> np.ndarray:
    """Rows of an Arrow list column of one length, in double precision, without Python objects."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


#: Rows of a block of test or training vectors that meet in one task.
KNN_BLOCK = 8192


def nearest(q: np.ndarray, a: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q the places in a (ids ascending) of its k nearest by squared distance, then id, and the distances.

    A matrix product finds all rows within rounding of the k-th distance; those few are measured exactly.
    """
    k = min(k, len(a))
    rough = (q * q).sum(axis=1)[:, None] + (a * a).sum(axis=1)[None, :] - 2 * (q @ a.T)
    kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
    slack = 1e-9 * (1 + (q * q).sum(axis=1) + (a * a).sum(axis=1).max(initial=0))
    places, dists = np.empty((len(q), k), np.int64), np.empty((len(q), k))
    for i in range(len(q)):
        few = np.flatnonzero(rough[i] <= kth[i] + slack[i])
        d = ((a[few] - q[i]) ** 2).sum(axis=1)
        top = np.lexsort((ids[few], d))[:k]
        places[i], dists[i] = few[top], d[top]
    return places, dists


def predict_knn(test: DataFrame, train: DataFrame, k: int = 5, block: int = KNN_BLOCK) -> DataFrame:
    """vec_id, pred: most frequent label of the k nearest (squared distance, then id), the least on ties.

    Both are (vec_id, x, y).  Both are cut into blocks of about ``block`` rows by their counts; each block of test rows
    meets each block of training rows in one task, which keeps the k nearest there, and the k nearest of those decide:
    no pair of rows is written, and no task holds more than two blocks.
    """
    blocks = lambda df: max(1, -(-df.count() // block))
    n, m = blocks(test), blocks(train)
    part = lambda count: F.pmod(F.hash("vec_id"), F.lit(count)).alias
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias
    left = test.select("vec_id", "x", part(n)("t"), every(m)("r"))
    right = train.select("vec_id", "x", "y", part(m)("r"), every(n)("t"))

    def near(key, left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in (("vec_id", "int64"), ("other", "int64"), ("y", "int32"), ("d", "float64"))})
        right = right.sort_values("vec_id")
        a, ids, y = np.stack(right["x"]).astype(np.float64), right["vec_id"].to_numpy(), right["y"].to_numpy()
        out = []
        for at in range(0, len(left), 512):
            some = left.iloc[at : at + 512]
            places, d = nearest(np.stack(some["x"]).astype(np.float64), a, ids, k)
            out.append(pd.DataFrame({"vec_id": np.repeat(some["vec_id"].to_numpy(), places.shape[1]), "other": ids[places].ravel(), "y": y[places].ravel(), "d": d.ravel()}))
        return pd.concat(out)

    met = left.groupBy("t", "r").cogroup(right.groupBy("t", "r")).applyInPandas(near, "vec_id long, other long, y int, d double")
    top = met.withColumn("r", F.row_number().over(W.partitionBy("vec_id").orderBy("d", "other"))).where(F.col("r") <= k)
    return mode(top, "vec_id", "y")


def mode(df: DataFrame, key: str, label: str) -> DataFrame:
    n = df.groupBy(key, label).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.max_by(F.col(label), F.struct("n", -F.col(label))).cast("int").alias("pred"))
