"""Reading tables, scratch tables in the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many rows of a few numbers each is broadcast (some 32 MB); a larger one is shuffled.
BROADCAST_ROWS = 1_000_000
#: Seconds between two calls of ``give_back`` by written tables.
BETWEEN = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="bitballot-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def give_back(spark: SparkSession) -> str:
    """Returns memory that the driver has freed, but its C library holds, to the system; says what the JVM reports, "" if it cannot.

    The JVM's compilers free what they took for each of many plans, and that stays with the process: some 250 MB
    over the stages of the pipeline.  No data or result is touched.
    """
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
    try:
        jvm, made = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
        lang, beans = jvm.java.lang, "javax.management"
        kinds, args = made(lang.Class, 4), made(lang.Object, 4)
        for i, name in enumerate((f"{beans}.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = lang.Class.forName(name)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = made(lang.Object, 0), made(lang.String, 0)
        # by the interface's method, since the class behind it is not open
        return lang.Class.forName(f"{beans}.MBeanServer").getMethod("invoke", kinds).invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Exception:  # a JVM without the command
        return ""


class Scratch:
    """Tables written to the shared folder: they cut the lineage and outlive executors.

    ``save`` writes and rereads a frame, ``drop`` deletes what is no longer needed.  What is left
    (the tables that a lazy result still reads) goes when the program ends.
    """

    given_back = 0.0

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/bitballot-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        if time.monotonic() - Scratch.given_back > BETWEEN:
            give_back(self.spark)
            Scratch.given_back = time.monotonic()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended; the folder is the cluster's to clean
            pass


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a written table for broadcast when it has at most ``rows`` rows; else leaves the join to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def map_texts(df: DataFrame, start, schema: str, limit: int = 1 << 17) -> DataFrame:
    """Applies ``start()(slice)`` to record batches of about ``limit`` bytes of text; one start per task."""
    from bitballot.llm._words import slices

    def run(batches):
        work = start()
        for batch in batches:
            for part in slices(batch, "text", limit):
                yield work(part)

    return df.mapInArrow(run, schema)
