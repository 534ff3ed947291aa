"""Views of the test tables as feature matrices, and the deterministic clause model over them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitballot.operators import fit
from bitballot.operators.clauses import ClauseModel

#: The most rows that a threshold fit reads.
SAMPLE = 30_000


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, quantity, price, discount, tax (float), y: lineitem with an identifier by hash of its five-column key."""
    key = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint))"
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        f"cast(conv(substr(md5({key}), 1, 15), 16, 10) as bigint) as row_id", "cast(l_quantity as float) as quantity", "cast(l_extendedprice as float) as price",
        "cast(l_discount + 0.0D as float) as discount", "cast(l_tax + 0.0D as float) as tax", "case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as y")


FEATURES = ("quantity", "price", "discount", "tax")


def sample(df: DataFrame, n: int = SAMPLE) -> DataFrame:
    """The n rows with the least identifiers: a uniform sample, as they are hashes of 60 bits.

    A count and a filter leave some 2 n rows to sort, spread over the tasks; if that were too few (it has no real
    chance), all rows are sorted.
    """
    total = df.count()
    if total > 8 * n:
        few = df.where(F.col("row_id") < int(2 * n / total * (1 << 60)))
        df = few if few.limit(n).count() == n else df
    return df.orderBy("row_id").limit(n)


def cells(df: DataFrame) -> DataFrame:
    """row_id, feat, val: the long form."""
    return df.select("row_id", F.posexplode(F.array(*FEATURES)).alias("feat", "val"))


def fixture_thresholds(df: DataFrame) -> DataFrame:
    """bit, feat, thresh: distinct 32-quantiles of the dense features, distinct values but the first of the others, of all rows."""
    every = cells(df)
    dense = fit.quantiles(every.where("feat < 2").withColumn("val", F.col("val").cast("double")), [i / 32 for i in range(1, 32)]).select("feat", F.col("edge").cast("float").alias("thresh"))
    few = every.where("feat >= 2 and val is not null").select("feat", "val").distinct()
    low = few.groupBy("feat").agg(F.min("val").alias("low"))
    above = few.join(F.broadcast(low), "feat").where("val > low").select("feat", F.col("val").alias("thresh"))
    places = dense.distinct().union(above)
    return places.selectExpr("cast(row_number() over (order by feat, thresh) - 1 as int) as bit", "feat", "thresh")


def literal_rule(n_bits: int, classes: int = 3, clauses: int = 20, limit: int = 6) -> dict:
    """The rule that gives the fixture its clauses."""
    out = []
    for k in range(classes):
        for sg in (0, 1):
            for c in range(clauses):
                pos, neg = [], []
                for bit in range(n_bits):
                    h = (bit * 31 + c * 17 + k * 7 + sg * 3) % 23
                    if h < 4 and c != 19 and (c % 4 == 0 or (bit + c * 5 + k * 7) % 40 < (c % 4) * 4):
                        (neg if h >= 2 else pos).append(bit)
                n = len(pos) + len(neg)
                out.append((k, 1 - 2 * sg, c, n if 0 < n < limit else limit, pos, neg))
    return {"rows": out, "classes": classes}


def fixture_model(df: DataFrame) -> ClauseModel:
    rows = fixture_thresholds(df).orderBy("bit").collect()  # a model's thresholds: 65 535 at most
    return fixture_from([(r.feat, r.thresh) for r in rows])


def fixture_from(table: list[tuple[int, float]]) -> ClauseModel:
    rule = literal_rule(len(table))
    return ClauseModel.of(np.array([f for f, _ in table], np.int32), np.array([t for _, t in table], np.float32), rule["rows"], rule["classes"])
