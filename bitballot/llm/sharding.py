"""Operator 7: sharding by sampled splitters, law ``bytes``.  DataFrame functions only.

Records are ordered by the hash of their text (so equal texts lie together), then by a hash of the record.  A
size-weighted sample of keys gives quantile boundaries of fine ranges, a large group of equal texts a range of
its own; their exact sizes are summed; such a group's range is subdivided by a hash of the row's place into as many parts
as its size asks for; consecutive ranges then fill the shards evenly.  Slots number a shard's records without gaps: the
records of the ranges before it, then the place within the range.  No task holds more than a range.

Cases: a null text has no bytes (size 8) and crc 0; equal texts share a shard unless their own group exceeds
two dues of a range; repeated rows get a slot each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitballot.llm._common import Scratch

FIXED = 8


def split_points(sizes: DataFrame, total: int, ranges: int, per_range: int = 8) -> list[int]:
    """Quantile boundaries of ``key`` by a size-weighted sample of about ranges * per_range keys (a bounded list).

    A key that alone fills a range in the sample gets a range of its own.
    """
    want = ranges * per_range
    chance = F.pmod(F.xxhash64(F.lit(3), "place"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # a record larger than the step is drawn for each step of it
    draws = F.floor(F.col("size") * F.lit(want / max(1, total)) + chance).cast("int")
    drawn = sizes.where(draws > 0).select("key", F.least(draws, F.lit(want)).alias("n")).groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").limit(4 * want).collect()
    points, seen = set(), 0
    for r in drawn:
        before, seen = seen, seen + r.n
        if r.n >= per_range:
            points |= {r.key, min(r.key + 1, (1 << 63) - 1)}
        elif before // per_range != seen // per_range:
            points.add(r.key)
    return sorted(points)


def range_of(points: list[int]):
    """Number of boundaries that are not above the key: a binary search over a constant array, in one expression."""
    if not points:
        return F.lit(0)
    text, steps = ",".join(map(str, points)), max(1, len(points)).bit_length()
    return F.expr(f"""aggregate(sequence({steps - 1}, 0, -1), 0, (at, s) ->
        CASE WHEN at + shiftleft(1, s) <= {len(points)} AND element_at(cast(split('{text}', ',') as array<bigint>), least(at + shiftleft(1, s), {len(points)})) <= key THEN at + shiftleft(1, s) ELSE at END)""")


def shard(docs: DataFrame, shards: int, scratch: Scratch, ranges_per_shard: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of ``docs`` (doc_id, text)."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + FIXED).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("key"), F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)).alias("sub"),
        F.xxhash64(F.lit(8), F.monotonically_increasing_id()).alias("place"))
    rows = scratch.save(rows, "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = shards * ranges_per_shard
    due = max(1.0, total / ranges)
    rows = rows.withColumn("range", range_of(split_points(rows, total, ranges)))
    sizes = rows.groupBy("range").agg(F.sum("size").alias("bytes"), (F.min("key") == F.max("key")).alias("alone"))
    # parts of an overfull range of one key: by a hash of the row's place in the table, so equal texts and rows that repeat as a whole are dealt evenly; a range of many keys stays whole
    cut = F.when(F.col("alone"), F.floor(F.col("bytes") / (2 * due))).otherwise(F.lit(1))
    parts = scratch.save(sizes.select("range", F.greatest(F.lit(1), cut).cast("int").alias("parts")).coalesce(1), "shard-parts")
    rows = rows.join(F.broadcast(parts), "range").withColumn("part", F.expr("cast(pmod(place, 1048576) * parts div 1048576 as int)"))
    filled = rows.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    order = W.orderBy("range", "part").rowsBetween(W.unboundedPreceding, 0)  # one row per range, as many as the parameters say
    filled = filled.withColumn("middle", F.sum("bytes").over(order) - F.col("bytes") / 2)
    filled = filled.withColumn("shard", F.least(F.floor(F.col("middle") * shards / F.lit(max(1, total))), F.lit(shards - 1)).cast("int"))
    filled = filled.withColumn("first", F.sum("n").over(W.partitionBy("shard").orderBy("range", "part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    plan = scratch.save(filled.select("range", "part", "shard", "first").coalesce(1), "shard-plan")
    rows = rows.join(F.broadcast(plan), ["range", "part"])
    place = F.row_number().over(W.partitionBy("range", "part").orderBy("key", "sub", "doc_id", "size")) - 1
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + place).cast("long").alias("slot"))
