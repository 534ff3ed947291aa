"""Spark readers and writers of the file formats around clause models.

Paths may be in any store that Spark reads: files come through ``binaryFile`` and ``text``; the raw matrix has a
batch data source of its own, which splits a file by rows.
"""

from __future__ import annotations

import gzip
import io
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from bitballot.operators.clauses import ClauseModel
from bitballot.sources import formats


def model(spark: SparkSession, path: str, layout: str = "fbz") -> ClauseModel:
    """A model file: fbz (dense or sparse), flat or tmpy; a path that ends in .gz is unpacked first."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    data = gzip.decompress(data) if path.endswith(".gz") else data
    return {"fbz": formats.decode, "flat": formats.decode_flat, "tmpy": formats.decode_tmpy}[layout](data)


def models(spark: SparkSession, folder: str, pattern: str = "*.fbz") -> DataFrame:
    """path, class, sign, clause, clamp, pos, neg of every model file of a folder, decoded on the executors."""

    def run(batches):
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema  # noqa: F401

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                m = formats_decode(content)
                rows = m.rows()
                columns = list(zip(*rows)) if rows else [[]] * 6
                types = [pa.int32()] * 4 + [pa.list_(pa.int32())] * 2
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array(list(c), t) for c, t in zip(columns, types))], ["path", "class", "sign", "clause", "clamp", "pos", "neg"])

    formats_decode = formats.decode
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    return files.mapInArrow(run, "path string, class int, sign int, clause int, clamp int, pos array<int>, neg array<int>")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """row_id, y: an integer a line, numbered in the file's order."""
    return numbered_lines(spark, path).select("row_id", F.col("value").cast("int").alias("y"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """row_id (from 0), value: the lines of one file in its order.

    The file is read in splits; the lines of the splits before it, a number a split, number the lines of each.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_m"))
    splits = lines.groupBy("_at").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("_at", (before - F.col("_first")).alias("_shift"))
    return lines.join(F.broadcast(splits), "_at").select((F.col("_m") + F.col("_shift")).alias("row_id"), "value")


def bool_rows(spark: SparkSession, path: str) -> DataFrame:
    """row_id, bit, on: space-separated Booleans (0, 1, true, false) a line."""
    cells = numbered_lines(spark, path).select("row_id", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("bit", "v"))
    return cells.select("row_id", "bit", F.lower("v").isin("1", "true").alias("on"))


def binariser_tsv(spark: SparkSession, path: str) -> DataFrame:
    """bit, feat, thresh: a feature and a threshold a line."""
    parts = F.split("value", "\t")
    return numbered_lines(spark, path).select(F.col("row_id").cast("int").alias("bit"), parts[0].cast("int").alias("feat"), parts[1].cast("float").alias("thresh"))


def binariser_json(spark: SparkSession, path: str) -> DataFrame:
    """bit, feat, thresh from plain or quantised JSON."""
    j = spark.read.schema("feat_idx array<int>, thresh array<double>, thresh_q array<int>, thresh_scale double, thresh_zp double").option("multiLine", True).json(path)
    values = F.coalesce("thresh", F.transform("thresh_q", lambda q: q * F.col("thresh_scale") + F.col("thresh_zp")))
    return j.select(F.posexplode(F.arrays_zip("feat_idx", values.alias("t"))).alias("bit", "p")).select("bit", F.col("p.feat_idx").alias("feat"), F.col("p.t").cast("float").alias("thresh"))


def npz(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The arrays of an archive; archives that hold pickled objects are refused."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def archive_tables(spark: SparkSession, folder: str, pattern: str = "*.npz", leave_out: tuple[str, ...] = ()) -> DataFrame:
    """file, array, i, j, value of the numeric arrays of every archive of a folder, but those named, decoded on the executors (a vector has j = 0)."""

    def run(batches):
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                name = path.rsplit("/", 1)[-1]
                with zipfile.ZipFile(io.BytesIO(content)) as entries:  # an array at a time
                    for entry in entries.namelist():
                        a = np.atleast_1d(np.lib.format.read_array(io.BytesIO(entries.read(entry)), allow_pickle=False))
                        if a.dtype.kind not in "biuf":
                            continue
                        flat = a.reshape(len(a), -1) if len(a) else a.reshape(0, 1)
                        for at in range(0, len(flat), max(1, 65_536 // flat.shape[1])):
                            part = flat[at : at + max(1, 65_536 // flat.shape[1])]
                            i, j = np.indices(part.shape)
                            n = part.size
                            yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([entry.removesuffix(".npy")] * n, pa.string()), pa.array((i + at).ravel().astype(np.int64)), pa.array(j.ravel().astype(np.int64)), pa.array(part.ravel().astype(np.float64))], ["file", "array", "i", "j", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    files = files.where(~F.element_at(F.split("path", "/"), -1).isin(list(leave_out))) if leave_out else files
    return files.mapInArrow(run, "file string, array string, i long, j long, value double")


def write_archive(spark: SparkSession, path: str, arrays: dict[str, np.ndarray]) -> int:
    """Writes an archive of arrays to any store; returns its bytes."""
    out = io.BytesIO()
    np.savez(out, **arrays)
    return write_bytes(spark, path, out.getvalue())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> int:
    """Writes a small file to any store that Spark writes."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return len(data)


def matrix_bytes(x) -> bytes:
    x = np.asarray(x, "<f4")
    return struct.pack("<II", *x.shape) + x.tobytes()


class Sink:
    """A stream to one file of any store that Spark writes."""

    def __init__(self, spark: SparkSession, path: str):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)

    def __enter__(self):
        return self

    def write(self, data: bytes) -> None:
        self.out.write(bytearray(data))

    def __exit__(self, *_):
        self.out.close()


def chunks(df: DataFrame, size: int):
    """The rows of an ordered frame, ``size`` at a time: one partition is on the driver at once."""
    rows = []
    for r in df.toLocalIterator():
        rows.append(r)
        if len(rows) == size:
            yield rows
            rows = []
    if rows:
        yield rows


def write_matrix(spark: SparkSession, df: DataFrame, columns: list[str], path: str) -> None:
    """The columns of an ordered frame as a raw matrix, a single file by its format, so written as a stream."""
    with Sink(spark, path) as out:
        out.write(struct.pack("<II", df.count(), len(columns)))
        for rows in chunks(df.select(*columns), 65_536):
            out.write(np.array([tuple(r) for r in rows], "<f4").tobytes())


def write_labels(spark: SparkSession, df: DataFrame, column: str, path: str) -> None:
    """A column of an ordered frame, a line a row."""
    with Sink(spark, path) as out:
        for rows in chunks(df.select(column), 65_536):
            out.write("".join(f"{r[0]}\n" for r in rows).encode())


class Rows(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class MatrixReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.per = options["path"].removeprefix("file:"), int(options.get("rowsPerPartition", 1 << 20))

    def shape(self) -> tuple[int, int]:
        with open(self.path, "rb") as f:
            return struct.unpack("<II", f.read(8))

    def partitions(self):
        n, _ = self.shape()
        return [Rows(a, min(n, a + self.per)) for a in range(0, n, self.per)]

    def read(self, partition):
        import pyarrow as pa

        _, d = self.shape()
        with open(self.path, "rb") as f:
            for at in range(partition.start, partition.end, 4096):
                m = min(4096, partition.end - at)
                f.seek(8 + 4 * d * at)
                flat = np.frombuffer(f.read(4 * d * m), "<f4")
                if len(flat) != d * m:
                    raise ValueError("the file ends early")
                x = pa.ListArray.from_arrays(np.arange(0, d * m + 1, d, dtype=np.int32) if d else np.zeros(m + 1, np.int32), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + m)), x], ["row_id", "x"])


class MatrixSource(DataSource):
    """``spark.read.format("raw_matrix")``: row_id, x of a file that all executors see; a task per ``rowsPerPartition`` rows."""

    @classmethod
    def name(cls):
        return "raw_matrix"

    def schema(self):
        return "row_id long, x array<float>"

    def reader(self, schema):
        return MatrixReader(self.options)


def matrix(spark: SparkSession, path: str, rows_per_partition: int = 1 << 20) -> DataFrame:
    """row_id, x of a raw matrix: split by rows where executors can open the path, else (any store) read whole, 2 GB at most."""
    scheme = path.split(":", 1)[0] if ":" in path else "file"
    if scheme != "file":
        return matrix_content(spark.read.format("binaryFile").load(path).select("content"))
    spark.dataSource.register(MatrixSource)
    return spark.read.format("raw_matrix").option("rowsPerPartition", rows_per_partition).load(path)


def matrix_content(files: DataFrame) -> DataFrame:
    """row_id, x of the bytes (content) of a raw matrix."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content").to_pylist():
                n, d = struct.unpack_from("<II", content)
                if len(content) < 8 + 4 * n * d:
                    raise ValueError("the file ends early")
                for at in range(0, n, 4096):
                    m = min(4096, n - at)
                    flat = np.frombuffer(content, "<f4", m * d, 8 + 4 * d * at)
                    x = pa.ListArray.from_arrays(np.arange(0, d * m + 1, d, dtype=np.int32) if d else np.zeros(m + 1, np.int32), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + m)), x], ["row_id", "x"])

    return files.mapInArrow(run, "row_id long, x array<float>")


def upsert(old: DataFrame, new: DataFrame, key: str = "Model") -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, and those of ``new``.  The planner chooses the join by the sizes."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new)


def matched(predictions: DataFrame, labels_: DataFrame, key: str = "row_id") -> DataFrame:
    """Predictions with the labels of the same rows; an error if either side has rows that the other lacks."""
    both = predictions.withColumn("_p", F.lit(1)).join(labels_.withColumn("_l", F.lit(1)), key, "full_outer")
    lost = F.assert_true(F.col("_p").isNotNull() & F.col("_l").isNotNull(), "predictions and labels are of different rows")
    return both.where(lost.isNull()).drop("_p", "_l")
