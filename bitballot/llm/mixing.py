"""Operator 4: mixing sources to target weights by Pareto order sampling.  DataFrame functions only.

Every source gets a target of words: its weight's share of all words, but at most ``most`` times its own
words; the excess goes to the others by weight.  The whole part of target / own words is taken of every document for
certain.  The words that the target still leaves are a sample of one copy more: a document's inclusion probability p
is proportional to its size, 1 at most, with the factor by which the expected words of the sample are those left.
Documents are ranked by Pareto's order, random odds divided by inclusion odds, (u / (1 - u)) / (p / (1 - p)) with u
uniform by hash, and the first are taken up to the words left: a sample of fixed size in words, off by half a
document at most.  The cut is found by two histograms of the rank, so no task holds a source; only the last narrow bin
is sorted.  The factor comes from counts of documents by source and size.  The plan has one row per source; sources
are named, so they are few beside documents, and it is sorted in one task.

Cases: a null text has size 0; documents without words take 0 words (and the certain copies); the null
source is one source, last by order; rows repeated as a whole are taken
or left together;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitballot.llm._common import Scratch, small

WORD = r"[^\x20\x09-\x0D]+"
#: Bins of either histogram; values of u, of 13 hexadecimal digits, and of a rank.
BINS = 1 << 12
HASH = 1 << 52


def targets(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """source, source_size, weight -> target.  One row per source, so a window over all of them is small.

    Sources stop at ``most`` times their size in order of most * size / weight: with those before stopped, the rest
    share what is left by weight.
    """
    order = W.orderBy("_full", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    s = sources.withColumn("_full", most * F.col("source_size") / F.col("weight"))
    s = s.withColumns({
        "_all": F.sum("source_size").over(whole),
        "_weights": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(order), F.lit(0)),
        "_spent": F.coalesce(F.sum(most * F.col("source_size")).over(order), F.lit(0.0)),
    })
    s = s.withColumn("_level", (F.col("_all") - F.col("_spent")) / F.col("_weights"))
    s = s.withColumn("_stops", F.col("_full") <= F.col("_level"))
    # the level of the first source that does not stop holds for all the others
    s = s.withColumn("_level", F.min(F.when(~F.col("_stops"), F.struct("_full", F.col("source").isNull().alias("n"), "source", F.col("_level").alias("level")))).over(whole)["level"])
    target = F.when(F.col("_stops"), most * F.col("source_size")).otherwise(F.col("weight") * F.col("_level"))
    return s.select("source", "source_size", "weight", target.cast("double").alias("target"))


def uniform(doc_id: str = "doc_id", text: str = "text"):
    """52 bits by hash of a document's number and text: rows repeated as a whole share them."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("mix"), F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))).cast("binary")), 1, 13), 16, 10).cast("long")


def words_in(text: str = "text"):
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in().alias("size"), uniform().alias("u"))


def same(a: str, b: str = "_s"):
    return F.col(a).eqNullSafe(F.col(b))


def factors(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """_s and _factor: p = min(1, _factor * size) makes the expected words of a sample those that ``sources`` have left.

    The largest sizes have p = 1; of the sizes below, the first whose p stays within 1 by its own factor gives it.
    """
    sizes = rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = sizes.join(sources.select("_s", F.greatest("_left", F.lit(0.0)).alias("left")), same("source"))
    by = W.partitionBy("_s").orderBy(F.desc("size"))
    words = F.col("n").cast("decimal(38,0)") * F.col("size")
    above = F.coalesce(F.sum(words).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("double")
    squares = F.sum((words * F.col("size")).cast("decimal(38,0)")).over(by.rowsBetween(0, W.unboundedFollowing)).cast("double")
    sizes = sizes.select("_s", "size", ((F.col("left") - above) / squares).alias("factor"))
    found = sizes.where(F.col("factor") * F.col("size") <= 1).groupBy("_s").agg(F.max_by("factor", "size").alias("_factor"))
    return found.select("_s", F.greatest("_factor", F.lit(0.0)).alias("_factor"))


def rank():
    """Pareto's rank r of a row with u, size and _factor, as r / (1 + r) in HASH steps; 0 where p is 1, HASH where it is 0."""
    p = F.least(F.lit(1.0), F.coalesce(F.col("_factor"), F.lit(0.0)) * F.col("size"))
    u = (F.col("u") + F.lit(0.5)) / F.lit(float(HASH))
    a, b = u * (1 - p), p * (1 - u)
    return F.floor(a / (a + b) * F.lit(float(HASH))).cast("long")


def plan(rows: DataFrame, scratch: Scratch, most: float = 3.0, weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Of ``sized`` rows: one row per source (_s, source_size, target, _certain, _left, _factor, low, high), and the documents (doc_id, u) taken from the bins that are cut.

    ``weights`` (source, weight) defaults to 1, 2, 3 repeating over the sources by code point, null last.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        weighed = sums.withColumn("weight", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    else:
        weighed = sums.join(weights.select(F.col("source").alias("_s"), "weight"), same("source")).drop("_s")
    p = targets(weighed, most)
    p = p.withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    p = p.withColumn("_certain", F.least(F.floor("_rate"), F.lit(int(most))).cast("long"))
    p = p.withColumn("_left", F.col("target") - F.col("_certain") * F.col("source_size")).withColumnRenamed("source", "_s")
    p = scratch.save(p.drop("_rate", "weight").coalesce(1), "mix-sources")
    p = p.join(factors(rows, small(p)).withColumnRenamed("_s", "_t"), same("_s", "_t"), "left").drop("_t")
    p = scratch.save(p.coalesce(1), "mix-plan")

    ranked = rows.where("size > 0").join(small(p.select("_s", "_factor")), same("source")).withColumn("rank", rank()).drop("_s", "_factor")
    cut = small(p.select("_s", F.col("_left").alias("left"), F.lit(0).cast("long").alias("low"), F.lit(HASH).cast("long").alias("high")))
    for i, width in enumerate((HASH // BINS, HASH // BINS // BINS)):
        inside = ranked.join(cut, same("source") & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        bins = inside.groupBy("source", F.expr(f"rank div {width}").alias("bin")).agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        bins = bins.withColumn("before", F.sum("words").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) - F.col("words"))
        found = bins.where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("words") > F.col("left")))
        found = found.select("source", (F.col("left") - F.col("before")).alias("l"), (F.col("bin") * width).alias("a"), ((F.col("bin") + 1) * width).alias("b"))
        # where all bins fit, all are taken
        cut = p.select("_s").join(found, same("source"), "left").select("_s", F.coalesce("l", F.lit(0.0)).alias("left"), F.coalesce("a", F.lit(HASH)).cast("long").alias("low"), F.coalesce("b", F.lit(HASH)).cast("long").alias("high"))
        cut = small(scratch.save(cut.coalesce(1), f"mix-cut-{i}"))
    edge = scratch.save(p.join(cut.withColumnRenamed("_s", "_t"), same("_s", "_t")).drop("_t").coalesce(1), "mix-edge")

    last = ranked.join(small(edge.select("_s", "left", "low", "high")), same("source") & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    last = last.groupBy("source", "rank", "u", "doc_id").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    before = F.sum("words").over(W.partitionBy("source").orderBy("rank", "u", "doc_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("words")
    taken = last.withColumn("before", before).where(F.col("before") + F.col("words") / 2 <= F.col("left")).select(F.col("doc_id").alias("_d"), F.col("u").alias("_u"))
    return edge, scratch.save(taken.distinct(), "mix-last")


def with_copies(rows: DataFrame, edge: DataFrame, last: DataFrame, most: float = 3.0) -> DataFrame:
    """Adds source_size, target and copies to rows that have doc_id, source, size and u."""
    all_ = rows.join(small(edge), same("source")).withColumn("_rank", rank()).join(small(last), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("u") == F.col("_u")), "left")
    extra = ((F.col("_rank") < F.col("low")) | F.col("_u").isNotNull()) & (F.col("_left") > 0)  # a source that is all certain takes no more
    copies = F.least(F.col("_certain") + extra.cast("long"), F.lit(int(most)).cast("long"))
    return all_.withColumn("copies", copies).drop("_s", "_certain", "_left", "_factor", "_rank", "left", "low", "high", "_d", "_u")


def mix(docs: DataFrame, scratch: Scratch, most: float = 3.0, weights: DataFrame | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of ``docs`` (doc_id, text, source)."""
    rows = scratch.save(sized(docs), "mix-rows")
    out = with_copies(rows, *plan(rows, scratch, most, weights), most)
    return out.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, scratch: Scratch, most: float = 3.0, weights: DataFrame | None = None) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; texts are not shuffled."""
    rows = scratch.save(sized(docs), "mix-rows")
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in().alias("size"), uniform().alias("u"))
    out = with_copies(own, *plan(rows, scratch, most, weights), most).where("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")


#: The rows of the query in DuckDB, by windows over whole sources.
SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS u
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM rows GROUP BY source
), levels AS (
  SELECT *, 3.0 * source_size / weight AS full_level,
         (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM sums WINDOW before AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), plan AS (
  SELECT source, source_size, CASE WHEN full_level <= level THEN 3.0 * source_size ELSE weight * (SELECT arg_min(level, full_level) FROM levels WHERE full_level > level) END::DOUBLE AS target FROM levels
), rated AS (
  SELECT *, least(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END), 3)::BIGINT AS certain FROM plan
), sizes AS (
  SELECT r.source, size, greatest(max(target) - max(certain) * max(source_size), 0) AS left_, count(*) AS n
  FROM rows r JOIN rated p ON r.source IS NOT DISTINCT FROM p.source WHERE size > 0 GROUP BY r.source, size
), odds AS (
  SELECT source, size, (left_ - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(n * size * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS factor FROM sizes
), factors AS (
  SELECT source, greatest(arg_max(factor, size), 0) AS factor FROM odds WHERE factor * size <= 1 GROUP BY source
), chances AS (
  SELECT r.*, p.source_size, p.target, p.certain, least(1, coalesce(f.factor, 0) * r.size)::DOUBLE AS p, (u::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS x
  FROM rows r JOIN rated p ON r.source IS NOT DISTINCT FROM p.source LEFT JOIN factors f ON r.source IS NOT DISTINCT FROM f.source
), pareto AS (
  SELECT *, floor(x * (1 - p) / (x * (1 - p) + p * (1 - x)) * 4503599627370496::DOUBLE)::BIGINT AS rank FROM chances
), ranked AS (
  SELECT *, sum(size) OVER (PARTITION BY source, rank, u, doc_id) AS words, sum(size) OVER (PARTITION BY source ORDER BY rank, u, doc_id NULLS FIRST RANGE UNBOUNDED PRECEDING) AS upto FROM pareto
)
SELECT doc_id, size, source_size, target,
       (size * least(certain + CASE WHEN target - certain * source_size > 0 AND upto - words / 2.0 <= target - certain * source_size THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM ranked
"""
