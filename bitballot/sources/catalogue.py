"""Data sets by name, listings of folders, and model directories of Parquet tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitballot.operators.clauses import ClauseModel

MODEL = "class int, sign int, clause int, clamp int, pos array<int>, neg array<int>"


def listing(spark: SparkSession, folder: str, suffix: str = "", leave_out: tuple[str, ...] = ()) -> DataFrame:
    """name, bytes of the entries of a folder that end in ``suffix``, sorted by name, without those named; no rows for a folder that is not there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    found = [(s.getPath().getName(), int(fs.getContentSummary(s.getPath()).getLength())) for s in fs.listStatus(path)] if fs.exists(path) else []
    rows = sorted((name, size) for name, size in found if name.endswith(suffix) and name not in leave_out and not name.startswith(("_", ".")))
    return spark.createDataFrame(rows, "name string, bytes long")


def registry(spark: SparkSession, entries: list[tuple[str, str]]) -> DataFrame:
    """dataset, stem: the data sets that are known, by the stem of their files."""
    return spark.createDataFrame(entries, "dataset string, stem string")


def present(datasets: DataFrame, files: DataFrame, suffix: str = ".parquet", only: list[str] | None = None) -> DataFrame:
    """dataset, stem, name, bytes of the data sets (all, or those named) that have a file; the others are passed over."""
    wanted = datasets if only is None else datasets.where(F.col("dataset").isin(only))
    return wanted.join(files, F.concat("stem", F.lit(suffix)) == F.col("name"))


def save_model(spark: SparkSession, model: ClauseModel, path: str) -> None:
    """A directory of Parquet tables: thresholds, clauses, and names."""
    names = [("feature", i, n) for i, n in enumerate(model.feature_names)] + [("class", i, n) for i, n in enumerate(model.class_names)] + [("classes", model.classes, "")]
    tables = {
        "thresholds": model.threshold_table(spark).drop("told"),
        "clauses": spark.createDataFrame(model.rows(), MODEL),
        "names": spark.createDataFrame(names, "kind string, at int, name string"),
    }
    for name, table in tables.items():
        table.coalesce(1).write.option("compression", "zstd").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> ClauseModel:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    bits = read("thresholds").orderBy("bit").collect()
    rows = [tuple(r) for r in read("clauses").orderBy("class", F.desc("sign"), "clause").collect()]
    names = read("names").orderBy("kind", "at").collect()
    of = lambda kind: [r.name for r in names if r.kind == kind]
    classes = next(r["at"] for r in names if r.kind == "classes")
    return ClauseModel.of(np.array([r.feat for r in bits], np.int32), np.array([r.thresh for r in bits], np.float32), rows, classes, of("feature"), of("class"))


def report(df: DataFrame, form: str, order: list, path: str) -> DataFrame:
    """Writes a line for each row (its columns through ``form``) in that order to one text file; returns place, line."""
    from pyspark.sql import Window as W

    lines = df.select(F.row_number().over(W.orderBy(*order)).alias("place"), F.format_string(form, *df.columns).alias("line"))  # a report is read by people: few rows
    lines.orderBy("place").coalesce(1).select("line").write.text(path)
    return lines
