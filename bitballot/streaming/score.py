"""Scoring of a stream: stateless, so the batch plan is the streaming plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from bitballot.operators.clauses import ClauseModel, predict


def read(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def scored(stream: DataFrame, columns: list[str], model: ClauseModel, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    return predict(stream, columns, model, keep)


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends predictions as Parquet, each once, until the input is used up."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def windowed_counts(stream: DataFrame, at: str, pred: str = "pred", size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Predictions by class and tumbling window, with late rows dropped after ``late``; an extension for event streams."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), pred).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), pred, "n")
