"""Mixing, sharding, decontamination and embeddings against plain forms; the pipeline as a whole."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitballot.llm import decontamination, embedding_dedup, mixing, sharding
from bitballot.llm._common import Scratch

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain_targets(sizes, most=3.0):
    total, names = sum(sizes.values()), sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    weight = {k: i % 3 + 1 for i, k in enumerate(names)}
    capped = set()
    while True:
        level = (total - sum(most * sizes[k] for k in capped)) / max(1e-300, sum(weight[k] for k in names if k not in capped))
        over = {k for k in names if k not in capped and weight[k] * level > most * sizes[k]}
        if not over:
            return {k: most * sizes[k] if k in capped else weight[k] * level for k in names}
        capped |= over


def test_mixing(spark):
    rng = np.random.RandomState(1)
    rows = [(i, " ".join(["w"] * int(rng.randint(0, 60))), ["a", "b", "c", "d", None, "é"][min(5, int(rng.exponential(1.2)))]) for i in range(1500)]
    rows += [(5000, None, "z"), (5001, "", "z"), (7, "one two", "a"), (7, "one two", "a"), (None, "x y", None)]
    df = spark.createDataFrame([(*r, 1, 1.0) for r in rows], "doc_id long, text string, source string, size int, u double")
    got = mixing.mix(df, Scratch(spark)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = plain_targets(sizes), defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and r.taken in {n * r.size for n in range(4)}
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    assert sorted(map(str, mixing.mix(df, Scratch(spark)).collect())) == sorted(map(str, got))
    copies = Counter(r.doc_id for r in mixing.mixed(df, Scratch(spark)).collect())
    assert copies == Counter({k: n for k, n in sum((Counter({r.doc_id: r.copies}) for r in got), Counter()).items() if n})
    assert mixing.mix(df.limit(0), Scratch(spark)).count() == 0


def test_sharding(spark):
    rng = np.random.RandomState(1)
    texts = ["t%d " % i * int(rng.randint(1, 40)) for i in range(3000)] + ["same text here"] * 1500 + [None, "", "x" * 3000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 2 + [(None, "n")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, shard int")
    got = sharding.shard(df, 6, Scratch(spark)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert set(slots) == set(range(6)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sizes.values()) < 1.05 * sum(sizes.values()) / 6 and min(sizes.values()) > 0.95 * sum(sizes.values()) / 6
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    assert sum(len(v) > 1 for v in where.values()) <= 1  # only the large group may be cut
    assert sharding.shard(df.limit(0), 6, Scratch(spark)).count() == 0 and sharding.shard(df.limit(1), 6, Scratch(spark)).count() == 1


def plain_hits(rows, items, span=10):
    known = defaultdict(set)
    for i, t in items:
        w = re.findall(WORD, low(t))
        n = min(len(w), span)
        for p in range(len(w) - n + 1 if w else 0):
            known[tuple(w[p : p + n])].add(str(i))
    lengths = {len(k) for k in known}
    out = []
    for i, t in rows:
        w, hit, found = re.findall(WORD, low(t)), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in known:
                    hit |= set(range(p, p + n))
                    found |= known[tuple(w[p : p + n])]
        out.append((i, len(w), len(hit), len(found), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination(spark):
    rng = np.random.RandomState(3)
    words = [f"W{i}" for i in range(60)] + ["É", "naïve"]
    say = lambda n: " ".join(rng.choice(words, n))
    items = [(i, say(n)) for i, n in enumerate([30, 12, 10, 9, 3, 1, 40])] + [(10, None), (11, ""), (2, say(15)), (12, "w1 " * 20)]
    rows = [(i, say(80)) for i in range(60)]
    for i, (_, t) in enumerate(items * 4):
        w = (t or "").split()
        a = int(rng.randint(0, max(1, len(w) - 9)))
        rows.append((100 + i, say(20) + ", " + " ".join(w[a : a + int(rng.randint(8, 25))]).upper() + "; " + say(20)))
    rows += [(500, None), (501, ""), (502, "w1-w1 " * 3000), (100, rows[60][1]), (None, items[0][1])]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, n_hit int, _rid int")
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = decontamination.hits(df, bench, Scratch(spark)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got), key=repr) == plain_hits(rows, items)
    clean = decontamination.clean(df, bench, Scratch(spark))
    assert clean.columns == df.columns and clean.count() == sum(not r.contaminated for r in got)
    assert decontamination.hits(df.limit(0), bench, Scratch(spark)).count() == 0
    assert not any(r.contaminated for r in decontamination.hits(df, bench.limit(0), Scratch(spark)).collect())


@pytest.mark.parametrize("sizes", [{}, {"SHARD": 60, "FAN": 3, "DEAL": 50, "SAMPLE": 150}, {"SHARD": 100, "BLOCK": 40, "CAP": 70}])
def test_embeddings(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.RandomState(5)
    base = rng.randn(30, 16)
    x = np.concatenate([base[rng.randint(0, 30, 500)] + rng.randn(500, 16) * rng.choice([0.02, 0.05, 0.12], (500, 1)), rng.randn(100, 16)]).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(50)] + [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 1), (2003, rows[1][1], None), (2004, [None] * 16, 1), (2005, [], 1), (2006, rows[2][1][:8], 0)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, label int, component string")
    rows_ = embedding_dedup.dedup(df, Scratch(spark)).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows_}
    good = [r for r in rows if r[1] and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and r[2] is not None]
    u = embedding_dedup.unit([r[1] for r in good])
    label = np.array([r[2] for r in good])
    link = (u @ u.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    comp = np.array([r[0] for r in good])
    ids = comp.copy()
    for _ in good:
        comp = np.minimum(comp, np.where(link, comp[None, :], 10**9).min(axis=1))
    assert np.mean([r.recall for r in rows_ if r.recall is not None]) >= 0.9
    want = {r[0]: (0, r[0], True) for r in rows} | {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, link.sum(axis=1), comp)}
    assert got == want
    assert sizes or embedding_dedup.dedup(df.limit(0), Scratch(spark)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns, name
        n.append(docs.count())
    assert n[0] > n[1] >= n[2] >= n[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(h[4] for h in plain_hits([(r.doc_id, r.text) for r in docs.collect()], items))
    last = pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == n[4] and last.agg(F.countDistinct("shard", "slot")).first()[0] == n[4]


def test_decontamination_keeps_items_without_identifier(spark):
    passage = " ".join(f"word{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"so {passage} end"), (2, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage)], "item_id string, text string")
    got = {r.doc_id: r for r in decontamination.hits(df, bench, Scratch(spark)).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].contaminated, got[2].n_hit) == (12, 0, True, 0) and got[1].items_sha256 == got[2].items_sha256
    assert [r.doc_id for r in decontamination.clean(df, bench, Scratch(spark)).collect()] == [2]


def test_a_hot_text_leaves_its_neighbours_together(spark):
    rows = [(i, f"group {i % 2000} " + "x" * 40) for i in range(6000)] + [(i, "hot " + "y" * 50) for i in range(6000, 9000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4, Scratch(spark)).collect()
    places, sizes = defaultdict(set), Counter()
    for r in got:
        places[rows[r.doc_id][1]].add(r.shard)
        sizes[r.shard] += r.size
    assert len(got) == len(rows) and max(sizes.values()) < 1.1 * min(sizes.values())
    assert all(len(shards) == 1 for text, shards in places.items() if text.startswith("group"))


def test_a_label_of_many_vectors_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 512)
    rng = np.random.RandomState(8)
    base = rng.randn(600, 32)
    x = base[rng.randint(0, 600, 6000)] + rng.randn(6000, 32) * rng.choice([0.05, 0.1, 0.14], (6000, 1))
    df = spark.createDataFrame([(i, v.tolist(), "one") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.dedup(df, Scratch(spark)).collect()}
    u = embedding_dedup.unit(x)
    link = u @ u.T >= 0.98
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(link, comp[None, :], 10**9).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    assert got == {i: (int(n), int(c)) for i, (n, c) in enumerate(zip(link.sum(axis=1), comp))}


def test_inclusion_follows_size(spark):
    """Pareto's order takes a size class about as often as its inclusion probability says; the largest sizes for certain."""
    n = {1: 4000, 5: 2000, 20: 800, 400: 20}
    rows = [(i, " ".join(["w"] * s), "a") for s, k in n.items() for i in range(10_000 * s, 10_000 * s + k)]
    rows += [(-1 - i, "w " * 100, "b") for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), Scratch(spark)).where("source = 'a'").collect()
    size, target = got[0].source_size, got[0].target
    whole, left = divmod(target, size)
    low, high = 0.0, 1.0
    for _ in range(200):  # the factor by bisection
        c = (low + high) / 2
        low, high = (c, high) if sum(k * s * min(1, c * s) for s, k in n.items()) < left - whole * 0 else (low, c)
    taken = Counter()
    for r in got:
        taken[r.size] += r.copies - int(target // size)
    for s, k in n.items():
        p = min(1.0, c * s)
        assert abs(taken[s] - k * p) <= 5 * (k * p * (1 - p)) ** 0.5 + 2, (s, taken[s], k * p)
    assert abs(sum(r.taken for r in got) - target) <= 200


def test_ranges_lie_in_order_and_repeated_rows_are_dealt(spark):
    """Equal texts have one shard, shards follow the order of the texts' hashes, and a hot row that repeats as a whole fills several."""
    rows = [(i, f"text {i % 900} " + "y" * (i % 50)) for i in range(5000)] + [(77, "the same row " * 4)] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(df, 5, Scratch(spark))
    sizes = Counter()
    for r in got.collect():
        sizes[r.shard] += r.size
    due = sum(sizes.values()) / 5
    assert max(sizes.values()) < 1.05 * due and min(sizes.values()) > 0.95 * due and got.where("doc_id = 77").select("shard").distinct().count() > 1
    keys = df.distinct().select("doc_id", F.xxhash64(F.col("text").cast("binary")).alias("key"))
    ends = got.where("doc_id <> 77").join(keys, "doc_id").groupBy("shard").agg(F.min("key").alias("a"), F.max("key").alias("b")).orderBy("shard").collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:]))


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(5).withColumn("text", F.lit(None).cast("string")).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
    odd = odd.unionByName(docs.limit(2).withColumn("source", F.lit(None).cast("string")).withColumn("text", F.lit("")))
    for frame in (docs.limit(0), spark.createDataFrame(odd.collect(), docs.schema)):
        out = frame
        for _, stage in pipeline.STAGES:
            before, out = out, stage(spark, out, sf)
            out = spark.createDataFrame(out.collect(), out.schema)
        assert set(out.columns) == {"doc_id", "size", "text_crc32", "shard", "slot"} and out.count() == before.count()
