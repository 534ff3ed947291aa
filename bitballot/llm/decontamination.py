"""Operator 10: benchmark decontamination by winnowing.  DataFrame functions only.

Words are hashed, ``k`` consecutive hashes combined, and of each ``span - k + 1`` consecutive k-grams the least
is kept: every shared run of ``span`` words shares such a fingerprint.  Documents with a fingerprint of the
benchmark are candidates; their hits are extended to exact windows of ``span`` words, compared as words.  Items
shorter than ``span`` are one window of their own length, found by the k-grams of that length.  The texts are
scanned once: what the scan keeps of a document is its number, its count of words and whether it is a candidate.

Cases: a null or empty text has no words and no hit; items without words are left out; an item without
an identifier counts for n_hit and contaminated, not for n_items and items_sha256; equal windows of several
items count for each; hit words covered by several windows count once; repeated rows are one until the end and are
reported each; rows are told apart by 128 bits of their number and text; empty
tables give no hits; columns other than doc_id, item_id and text are not read.  Case is lower-cased for A-Z only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitballot.llm._common import Scratch, small

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lies between the words of a text without capitals.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A side of at most so many rows of a window's words (some 70 bytes) is broadcast.
WINDOWS = 250_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str = "text") -> Column:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.regexp_extract_all(F.translate(t, UPPER, LOWER), F.lit(WORD), F.lit(0))


def coarse_words(text: str = "text") -> Column:
    """As many words, lower-cased beyond A-Z too: equal where ``words`` are equal, and cheaper for a first look."""
    parts = F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), BETWEEN)
    first, last = (F.element_at(parts, 1) == "").cast("int"), (F.element_at(parts, -1) == "").cast("int")
    # text before the first and after the last separator may be empty; a text of one separator gives two empty parts
    return F.slice(parts, first + 1, F.greatest(F.size(parts) - first - last, F.lit(0)))


def _tail(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def _head(a: Column, less: int) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - less, F.lit(0)))


def combined(df: DataFrame, column: str, length: int, join) -> DataFrame:
    """Replaces an array by ``join`` over each ``length`` consecutive elements, in steps that double (binary)."""
    def pair(x: str, y: str, by: int) -> Column:
        return F.zip_with(_head(F.col(x), by), F.col(y), join)

    made, width, have = column, 1, []
    bits = length
    while bits:
        if bits & 1:
            have.append((made, width))
        bits >>= 1
        if bits:
            nxt = f"_{column}_{2 * width}"
            df = df.withColumn(nxt, F.zip_with(_head(F.col(made), width), _tail(F.col(made), width), join))
            made, width = nxt, 2 * width
    out, covered = have[-1]
    for part, size in reversed(have[:-1]):
        name = f"_{column}_to_{covered + size}"
        # x covers [i, i + covered), y covers [i + covered, i + covered + size); the shorter of both arrays rules
        x, y = F.col(out), _tail(F.col(part), covered)
        n = F.greatest(F.lit(0), F.least(F.size(x), F.size(y)))
        df = df.withColumn(name, F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), join))
        out, covered = name, covered + size
    result = df.withColumn(column, F.col(out))
    return result.drop(*[c for c in result.columns if c.startswith(f"_{column}_")])


def winnowed(df: DataFrame, column: str, k: int, span: int) -> DataFrame:
    """Turns the array of word hashes in ``column`` into the distinct winnowed hashes of its k-grams."""
    df = combined(df, column, k, lambda a, b: F.xxhash64(a, b))
    df = combined(df, column, span - k + 1, lambda a, b: F.least(a, b))
    return df.withColumn(column, F.array_distinct(column))


def fingerprints(df: DataFrame, column: str, k: int, span: int) -> DataFrame:
    """Turns the array of words in ``column`` into the distinct winnowed hashes of its k-grams."""
    return winnowed(df.withColumn(column, F.transform(column, lambda w: F.xxhash64(w))), column, k, span)


def windows(array: str, length: Column | int) -> Column:
    """Each window of ``length`` words as a string; nothing if there are fewer."""
    n = F.size(array) - length
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.concat_ws(" ", F.slice(array, i + 1, length)))).otherwise(F.array().cast("array<string>"))


def key() -> list[Column]:
    """Names a row by 128 bits of its number and text; repeated rows share them and their result."""
    return [F.xxhash64(F.lit(i), F.col("doc_id").cast("long"), F.col("text").cast("string")).alias(f"k{i}") for i in (1, 2)]


KEY = ["k1", "k2"]


def hits(docs: DataFrame, items: DataFrame, scratch: Scratch, span: int = 10, k: int = 6) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs`` (doc_id, text)."""
    found = keyed_hits(docs, items, scratch, span, k)
    # repeated rows were counted in the scan
    return found.select(*[c for c in found.columns if c not in (*KEY, "copies")], F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def keyed_hits(docs: DataFrame, items: DataFrame, scratch: Scratch, span: int, k: int) -> DataFrame:
    """As ``hits``, with one row for repeated rows, their number as copies, and the key."""
    # the outer forms of explode keep the optimiser from computing the arrays a second time, in a filter on their size
    item_words = scratch.save(items.select(F.col("item_id").cast("string").alias("item_id"), words().alias("w")), "bench-words").where("size(w) > 0")
    length = F.least(F.size("w"), F.lit(span))
    known = item_words.select("item_id", length.alias("len"), F.explode_outer(windows("w", length)).alias("window")).distinct()
    known = scratch.save(known, "bench-windows")
    lengths = [r[0] for r in known.where(F.col("len") < span).select("len").distinct().orderBy("len").collect()]  # at most span - 1 of them
    prints = fingerprints(item_words.where(F.size("w") >= span).select(F.transform("w", lambda x: F.lower(x)).alias("f")), "f", k, span).select(F.explode_outer("f").alias("f"))
    for n in lengths:  # an item of n words is one n-gram
        short = combined(item_words.where(F.size("w") == n).select(F.transform("w", lambda x: F.xxhash64(F.lower(x))).alias("f")), "f", n, lambda a, b: F.xxhash64(a, b))
        prints = prints.unionByName(short.select(F.explode_outer("f").alias("f")))
    prints = small(scratch.save(prints.distinct().select(F.col("f").alias("p")), "bench-prints"))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coarse = texts.select("doc_id", *key(), coarse_words().alias("f")).withColumn("n_words", F.size("f"))
    hashed = coarse.withColumn("f", F.transform("f", lambda w: F.xxhash64(w)))
    for n in lengths:
        hashed = combined(hashed.withColumn(f"g{n}", F.col("f")), f"g{n}", n, lambda a, b: F.xxhash64(a, b))
    hashed = winnowed(hashed, "f", k, span)
    if lengths:
        hashed = hashed.withColumn("f", F.array_distinct(F.concat("f", *[f"g{n}" for n in lengths])))
    looked = hashed.select(*KEY, "doc_id", "n_words", F.posexplode_outer("f").alias("at", "f")).join(prints, F.col("f") == F.col("p"), "left")
    # the rows of a document lie together, so they are one before the shuffle
    scan = looked.groupBy(*KEY, "doc_id", "n_words").agg(F.sum((F.coalesce("at", F.lit(0)) == 0).cast("long")).alias("copies"), F.max(F.col("p").isNotNull()).alias("candidate"))
    scan = scratch.save(scan, "bench-scan")

    candidates = scan.where("candidate").select(*KEY)
    chosen = texts.select(*key(), "text").join(small(candidates), KEY, "left_semi").select(*KEY, words().alias("w"))
    where = [chosen.select(*KEY, F.lit(n).alias("len"), F.posexplode_outer(windows("w", n)).alias("pos", "window")) for n in [*lengths, span]]
    at = where[0]
    for p in where[1:]:
        at = at.unionByName(p)
    strings = small(scratch.save(known.select("window", "len").distinct(), "bench-strings"), WINDOWS)
    at = scratch.save(at.join(strings, ["window", "len"], "left_semi").dropDuplicates([*KEY, "pos", "len"]), "bench-hits")
    spans = at.groupBy(*KEY, "pos").agg(F.max("len").alias("len")).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("pos", F.expr("pos + len").alias("end")))).alias("s"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + F.greatest(x["end"] - F.greatest(acc["end"], x["pos"]), F.lit(0))).alias("n"))
    covered = spans.select(*KEY, F.aggregate("s", start, step)["n"].alias("n_hit"))
    # a window that many documents hold meets its items where the documents are, or in a join that can be split
    named = at.select(*KEY, "window", "len").distinct().join(small(known, WINDOWS), ["window", "len"]).groupBy(*KEY).agg(F.collect_set("item_id").alias("i"))
    named = named.select(*KEY, F.size("i").cast("long").alias("n_items"), F.array_join(F.sort_array("i"), ",").alias("i"))
    result = scratch.save(covered.join(named, KEY), "bench-result")
    return scan.join(result, KEY, "left").select(
        *KEY, "copies", "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("i", F.lit("")).cast("binary"), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, scratch: Scratch, span: int = 10, k: int = 6) -> DataFrame:
    """The rows of ``docs``, all columns, without a hit."""
    hit = scratch.save(keyed_hits(docs, items, scratch, span, k).where("contaminated").select(*KEY), "contaminated")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *key())
    return rows.join(small(hit), KEY, "left_anti").select("_row.*")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
known AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[p : p + least(len(w), 10) - 1] AS s FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(p) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM known),
place AS (SELECT rid, p, n, w[p : p + n - 1] AS s FROM d, lengths, unnest(range(1, len(w) - n + 2)) AS t(p)),
hit AS (SELECT rid, p, place.n, item_id FROM place JOIN known USING (s)),
words AS (SELECT rid, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + n)) AS t(q) GROUP BY rid),
named AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS i FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(i, '')) AS items_sha256, coalesce(n_hit > 0, false) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN named USING (rid)
"""
