"""Confusion counts and the scores made from them; 0 / 0 is 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str = "y", pred: str = "pred") -> DataFrame:
    """y, pred, n: one row per pair that occurs."""
    return df.groupBy(F.col(truth).cast("int").alias("y"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, truth: str = "y", pred: str = "pred") -> DataFrame:
    return confusion(df, truth, pred).agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")), F.lit(0.0)).alias("accuracy"))


def per_class(counts: DataFrame, domain: str = "union", classes: int | None = None, train: DataFrame | None = None) -> DataFrame:
    """class, tp, fp, fn, precision, recall, f1 from ``confusion`` counts.

    domain: ``header`` (0 to classes - 1), ``max_label`` (0 to the largest true label), ``truth``, ``train``
    (column y of ``train``) or ``union`` (labels and predictions).
    """
    spark = counts.sparkSession
    sides = counts.select(F.col("y").alias("class"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("y") != F.col("pred"), F.col("n")).otherwise(0).alias("fn")).unionByName(
        counts.where("y <> pred").select(F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("fp"), F.lit(0).cast("long").alias("fn")))
    sums = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    if domain == "header":
        known = spark.range(classes).select(F.col("id").cast("int").alias("class"))
    elif domain == "max_label":
        known = counts.agg(F.max("y").alias("m")).where("m is not null").select(F.explode(F.sequence(F.lit(0), "m")).alias("class"))
    elif domain == "truth":
        known = counts.select(F.col("y").alias("class")).distinct()
    elif domain == "train":
        known = train.select(F.col("y").cast("int").alias("class")).distinct()
    elif domain == "union":
        known = sums.select("class")
    else:
        raise ValueError(domain)
    all_ = known.join(sums, "class", "left").na.fill(0, ["tp", "fp", "fn"])
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return all_.select("class", "tp", "fp", "fn", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


def macro(counts: DataFrame, **domain) -> DataFrame:
    """precision, recall, f1: means over the classes of the domain."""
    return per_class(counts, **domain).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])


def class_weights(df: DataFrame, weights: dict[int, float], label: str = "y") -> DataFrame:
    """Adds ``w``: the weight of a row's class, 1 where none is given.  One row a class is broadcast."""
    table = df.sparkSession.createDataFrame(sorted(weights.items()), f"{label} int, w double")
    return df.join(F.broadcast(table), label, "left").withColumn("w", F.coalesce("w", F.lit(1.0)))


def timed(run, rows: int, loops: int = 3) -> dict[str, float]:
    """Of ``loops`` runs of ``run()`` after one that warms up: mean seconds, microseconds a row and rows a second."""
    import time

    run()
    took = []
    for _ in range(loops):
        start = time.perf_counter()
        run()
        took.append(time.perf_counter() - start)
    mean = sum(took) / len(took)
    return {"seconds": mean, "us_per_row": mean / max(1, rows) * 1e6, "rows_per_s": rows / mean if mean else 0.0}
