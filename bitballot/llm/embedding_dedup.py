"""Operator 1: near-duplicate embeddings by a robust-pruned flat graph.

1. Equal vectors of a label are one point with its copies counted.  2. A label's points are one shard; a shard of more
than twice ``SHARD`` points at home is dealt to the shards of some SHARD points around centroids of a bounded sample of
it, and so on, so shards grow in number with the table, not in size.  Each point is home to its nearest centroid's
shard and a guest in every shard where a point linked to it may be at home.  For unit vectors x at home with c and y
with angle(x, y) at most the threshold's, y lies no deeper beyond the plane between the centroids than the sine of that
angle, so that test loses nothing.  3. The points that have a shard among their two nearest get a flat graph there, in
growing batches: a greedy search finds candidates, robust pruning keeps a spread few of them.
4. The adjacency lists of a point from all its shards are united.  5. Every point at home searches the united graph of
its shard from the medoid and from its own place; once a point in range is met, the search expands over all
neighbours in range; a link met from either end counts for both.  6. A sample of each block's searches is audited against all its points, and
the beam is doubled, four times BEAM at most, while their recall is short.  7. An exact check of the block in double
precision verifies the links and adds what the searches missed, so no link within a block is lost; the recall that the
searches had against it is returned.

A shard that cannot be cut smaller, of vectors that all lie in range of each other, is worked by pairs of a block of
BLOCK points at home and one of CAP points, so no task holds more than those.  Components come
from links between points; only a few of a point's links are needed for them: a link to each of its block's local
components.

Cases: vectors that are null, empty, zero, or hold null or non-finite numbers, and rows with a null label, link with
nothing; vectors of different lengths do not link; a null vec_id gets a row and no component of its own to give, and is kept;
repeated rows are vectors like others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitballot.llm._common import Scratch
from bitballot.llm._graph import components

#: Points at home in a shard, rows of a shard's sample, neighbours of a point, beam of a search.
SHARD, SAMPLE, DEGREE, BEAM = 2048, 4096, 16, 24
#: The most shards that one is dealt to, and how often; points dealt in a task.
FAN, LEVELS, DEAL = 256, 4, 1 << 15
#: Points at home that are searched, and points that they are searched among, in a task.
BLOCK, CAP = 2048, 8192
#: Searches of a block that are audited, and the recall below which the beam is doubled.
AUDIT, TARGET = 64, 0.99


def unit(x):
    x = np.asarray(x, np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centroids(x, k: int, rounds: int = 8):
    """Spherical k-means, the same for the same rows in the same order."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        ok = size > 1e-9
        c[ok] = sums[ok] / size[ok, None]
    return c


def places(x, c, cosine: float):
    """Home of each point, all (point, shard) pairs that it belongs to, and whether it is one of the two nearest."""
    sims = x @ c.T
    home = np.argmax(sims, axis=1)
    gap = np.sqrt(np.maximum(0.0, 2 - 2 * c @ c.T))[home]
    inside = sims[np.arange(len(x)), home][:, None] - sims <= np.sqrt(1 - cosine * cosine) * gap + 1e-9
    second = np.sort(sims, axis=1)[:, -min(2, len(c))]
    inside |= sims >= second[:, None]
    p, s = np.nonzero(inside)
    return home, (p, s), sims[p, s] >= second[p]


def robust_prune(x, ids, pool, degree: int, alpha: float = 1.2):
    """For each of ``ids`` up to ``degree`` of its ``pool`` (-1: none): the nearest first, dropping those that a kept one is nearer to by alpha."""
    n, m = pool.shape
    ok = (pool >= 0) & (pool != ids[:, None])
    pool = np.where(ok, pool, 0)
    d = np.where(ok, 2 - 2 * np.einsum("ij,ikj->ik", x[ids], x[pool]), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    pool, d = np.take_along_axis(pool, order, 1), np.take_along_axis(d, order, 1)
    same = np.zeros_like(ok)
    srt = np.sort(np.where(np.isfinite(d), pool, -1), axis=1)
    if (srt[:, 1:] == srt[:, :-1]).any():  # a candidate counts once
        first = np.argsort(pool, axis=1, kind="stable")
        p = np.take_along_axis(pool, first, 1)
        again = np.zeros_like(ok)
        again[:, 1:] = p[:, 1:] == p[:, :-1]
        np.put_along_axis(same, first, again, 1)
    alive = np.isfinite(d) & ~same
    out = np.full((n, degree), -1, np.int64)
    rows = np.arange(n)
    for t in range(degree):
        first = np.argmax(alive, axis=1)
        has = alive[rows, first]
        if not has.any():
            break
        out[has, t] = pool[rows, first][has]
        chosen = x[pool[rows, first]]
        between = 2 - 2 * np.einsum("ij,ikj->ik", chosen, x[pool])
        alive &= (alpha * between > d) | ~has[:, None]
        alive[rows, first] = False
    # places left over go to the nearest that were dropped: near a hub that is nearer to all, a list would end with the hub
    used = (out >= 0).sum(axis=1)
    free = np.isfinite(d) & ~same & ~(pool[:, :, None] == out[:, None, :]).any(axis=2)
    rank = np.cumsum(free, axis=1) - 1 + used[:, None]
    r, c = np.nonzero(free & (rank < degree))
    out[r, rank[r, c]] = pool[r, c]
    return out


def beam_search(x, graph, queries, entry, width: int):
    """Greedy search of all queries at once: the ``width`` best points met for each, best first."""
    n, rows = len(queries), np.arange(len(queries))
    ids = np.full((n, width), -1, np.int64)
    ids[:, : entry.shape[1]] = entry
    sim = np.where(ids >= 0, np.einsum("ij,ikj->ik", queries, x[np.maximum(ids, 0)]), -np.inf)
    done = ids < 0
    for _ in range(4 * width):
        open_ = ~done
        active = np.flatnonzero(open_.any(axis=1))
        if not len(active):
            break
        at = np.argmax(np.where(open_[active], sim[active], -np.inf), axis=1)
        done[active, at] = True
        new = graph[ids[active, at]]
        known = (new[:, :, None] == ids[active][:, None, :]).any(axis=2) | (new < 0)
        s = np.where(known, -np.inf, np.einsum("ij,ikj->ik", queries[active], x[np.maximum(new, 0)]))
        all_ids = np.concatenate([ids[active], np.where(known, -1, new)], axis=1)
        all_sim = np.concatenate([sim[active], s], axis=1)
        all_done = np.concatenate([done[active], known], axis=1)
        top = np.argsort(-all_sim, axis=1, kind="stable")[:, :width]
        ids[active], sim[active], done[active] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sim, all_done))
        done[active] |= ids[active] < 0
    return ids, sim


def medoid(x) -> int:
    return int(np.argmax(x @ x.mean(axis=0)))


def build(x, degree: int = DEGREE, width: int = BEAM):
    """Adjacency lists (-1: none) of a robust-pruned graph; batches double, each searched on the graph before it."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    start = medoid(x)
    order = np.random.RandomState(1).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    done, size = 1, 1
    while done < n:
        batch = order[done : done + min(size, 512)]
        ids, _ = beam_search(x, graph, x[batch], np.full((len(batch), 1), start), width)
        peers = np.broadcast_to(batch, (len(batch), len(batch))) if len(batch) <= 48 else batch[(np.arange(len(batch))[:, None] + np.arange(1, 17)) % len(batch)]
        graph[batch] = robust_prune(x, batch, np.concatenate([ids, peers], axis=1), degree)
        # the other direction, pruned where a list is full
        to, frm = graph[batch].ravel(), np.repeat(batch, degree)
        keep = to >= 0
        to, frm = to[keep], frm[keep]
        by = np.argsort(to, kind="stable")
        to, frm = to[by], frm[by]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        pool = np.full((len(nodes), count.max(initial=0)), -1, np.int64)
        pool[np.repeat(np.arange(len(nodes)), count), np.arange(len(to)) - np.repeat(first, count)] = frm
        for a in range(0, len(nodes), 256):
            part = slice(a, a + 256)
            graph[nodes[part]] = robust_prune(x, nodes[part], np.concatenate([graph[nodes[part]], pool[part]], axis=1), degree)
        done += len(batch)
        size *= 2
    return adopted(graph)


def adopted(graph):
    """Adds to each point that no list names one place in a list: that of its neighbour with the fewest such additions."""
    n = len(graph)
    orphans = np.setdiff1d(np.arange(n), graph[graph >= 0])
    load, extra = np.zeros(n, np.int64), []
    for o in orphans.tolist():
        near = graph[o][graph[o] >= 0]
        if len(near):
            to = near[np.argmin(load[near])]
            extra.append((to, load[to], o))
            load[to] += 1
    more = np.full((n, int(load.max(initial=0))), -1, np.int64)
    for to, at, o in extra:
        more[to, at] = o
    return np.concatenate([graph, more], axis=1)


def both_ways(graph):
    """The graph's links read from both ends: offsets and neighbours."""
    n = len(graph)
    frm, at = np.nonzero(graph >= 0)
    to = graph[frm, at]
    pairs = np.unique(np.concatenate([frm * n + to, to * n + frm]))
    return np.searchsorted(pairs, np.arange(n + 1) * n), pairs % n


def ranged(x, graph, queries, own, cosine: float, width: int):
    """For each query (own: its place among the points, or -1) the points in range that the search reaches, as lists of indexes."""
    entry = np.stack([np.full(len(queries), medoid(x)), own], axis=1)
    entry[entry[:, 0] == own, 1] = -1
    ids, sim = beam_search(x, graph, queries, entry, width)
    off, to = both_ways(graph)
    out = []
    for q, at, i, s in zip(queries, own.tolist(), ids, sim):
        front = np.unique(np.append(i[s >= cosine], at))
        front = front[front >= 0]
        inside = np.zeros(len(x), bool)
        inside[front] = True
        met = inside.copy()
        while len(front):  # expand over everything in range
            size = off[front + 1] - off[front]
            near = to[np.arange(size.sum()) + np.repeat(off[front] - (np.cumsum(size) - size), size)]
            near = np.unique(near[~met[near]])
            met[near] = True
            front = near[x[near] @ q >= cosine]
            inside[front] = True
        if at >= 0:
            inside[at] = False
        out.append(np.flatnonzero(inside))
    # a link met from one end only is one of the other end too
    place = np.full(len(x), -1, np.int64)
    place[own[own >= 0]] = np.flatnonzero(own >= 0)
    back = [[] for _ in out]
    for at, near in zip(own.tolist(), out):
        if at >= 0:
            for j in place[near][place[near] >= 0].tolist():
                back[j].append(at)
    return [np.union1d(near, b) if b else near for near, b in zip(out, back)]


def compared(x, queries, own, cosine: float):
    """The exact lists of the queries."""
    out = []
    for a in range(0, len(queries), 256):
        for at, s in zip(own[a : a + 256], queries[a : a + 256] @ x.T >= cosine):
            if at >= 0:
                s[at] = False
            out.append(np.flatnonzero(s))
    return out


def recall_of(found, true) -> float:
    """Mean share of a point's links that were found, over the points that have links; 1 without such points."""
    share = [len(np.intersect1d(f, t, assume_unique=True)) / len(t) for f, t in zip(found, true) if len(t)]
    return float(np.mean(share)) if share else 1.0


def block_links(x, graph, queries, own, cosine: float):
    """(lists, recall of the searches, beam): searched with a beam that a sample finds wide enough, then checked exactly, which adds what is missed."""
    sample = np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int)
    true, width = compared(x, queries[sample], own[sample], cosine), BEAM
    while True:
        found = ranged(x, graph, queries, own, cosine, width)
        if width >= 4 * BEAM or recall_of([found[i] for i in sample], true) >= TARGET:
            break
        width *= 2
    exact = compared(x, queries, own, cosine)
    return exact, recall_of(found, exact), width


def joined(ids, own, lists):
    """Few links (query, point's number) that connect what ``lists`` connect: a spanning forest."""
    parent = list(range(len(ids) + len(own)))

    def root(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    out = [[] for _ in lists]
    for q, (at, near) in enumerate(zip(own.tolist(), lists)):
        for b in near.tolist():
            r, s = root(at if at >= 0 else len(ids) + q), root(b)
            if r != s:
                parent[max(r, s)] = min(r, s)
                out[q].append(int(ids[b]))
    return out


DEALT = "shard string, id long, copies long, x binary, home boolean, built boolean"


def dealt_out(dealt: DataFrame, over: DataFrame, level: int, cosine: float) -> DataFrame:
    """The rows of the shards in ``over`` (shard, n at home, m in all), dealt to shards around centroids of a sample.

    Points and centroids meet in blocks of about DEAL points, read as a sorted stream with the centroids first.
    """
    rows = dealt.join(over, "shard")
    chance = F.pmod(F.xxhash64(F.lit(level), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where("home").where(chance < F.lit(float(SAMPLE)) / F.col("n")).select("shard", "id", "x", "n", F.ceil(F.col("m") / DEAL).alias("blocks"))
    shard_size, fan = SHARD, FAN

    def centres(pdf):
        import pandas as pd

        pdf = pdf.sort_values("id")
        x = np.stack([np.frombuffer(b) for b in pdf["x"]])
        c = centroids(x, min(fan, max(2, round(pdf["n"].iloc[0] / shard_size)), len(x)))
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "blocks": pdf["blocks"].iloc[:1], "c": [c.tobytes()]})

    heads = sample.groupBy("shard").applyInPandas(centres, "shard string, blocks long, c binary")
    heads = heads.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("copies"), F.col("c").alias("x"), F.lit(True).alias("home"), F.lit(True).alias("built"))
    rows = rows.select("shard", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / DEAL)).cast("long").alias("block"), "id", "copies", "x", "home", "built")
    stream = rows.unionByName(heads).repartition("shard", "block").sortWithinPartitions(F.col("shard"), F.col("block"), F.col("id").asc_nulls_first())

    def deal(batches):
        import pyarrow as pa

        c = None
        types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_()]
        for batch in batches:
            shards, ids, copies, homes, built = (batch.column(k).to_pylist() for k in ("shard", "id", "copies", "home", "built"))
            vectors, out, at = batch.column("x"), [], 0
            while at < len(ids):
                if ids[at] is None:
                    c = np.frombuffer(vectors[at].as_buffer())
                    at += 1
                    continue
                end = at
                while end < len(ids) and ids[end] is not None:
                    end += 1
                x = np.stack([np.frombuffer(vectors[i].as_buffer()) for i in range(at, end)])
                home, (p, s), near = places(x, c.reshape(-1, x.shape[1]), cosine)
                out += [(f"{shards[at + a]}/{b}", ids[at + a], copies[at + a], x[a].tobytes(), homes[at + a] and bool(home[a] == b), built[at + a] and bool(n)) for a, b, n in zip(p.tolist(), s.tolist(), near)]
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(list(k), t) for k, t in zip(zip(*out) if out else [[]] * 6, types)], ["shard", "id", "copies", "x", "home", "built"])

    return stream.mapInArrow(deal, DEALT)


def shards(points: DataFrame, scratch: Scratch, cosine: float) -> DataFrame:
    """Rows (DEALT, n, m) of the points in all their shards, n at home and m in all."""
    def units(batches):
        import pyarrow as pa

        for batch in batches:
            x = [unit([e])[0].tobytes() for e in batch.column("e").to_pylist()]
            true = pa.array([True] * len(x), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("space"), batch.column("id"), batch.column("copies"), pa.array(x, pa.binary()), true, true], ["shard", "id", "copies", "x", "home", "built"])

    dealt = scratch.save(points.select("space", "e", "id", "copies").mapInArrow(units, DEALT), "dealt")
    count = lambda df: df.groupBy("shard").agg(F.sum(F.col("home").cast("long")).alias("n"), F.count("*").alias("m"))
    for level in range(1, LEVELS + 1):
        over = scratch.save(count(dealt).where(F.col("n") > 2 * SHARD), f"over-{level}")
        if over.isEmpty():
            break
        rest = dealt.join(over, "shard", "left_anti")
        dealt = scratch.save(rest.unionByName(dealt_out(dealt, over, level, cosine)), f"dealt-{level}")
    return dealt.join(count(dealt), "shard")


def dedup(rows: DataFrame, scratch: Scratch, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept and recall (of the searches of the row's block) for each row of ``rows`` (vec_id, embedding, label)."""
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("string").alias("label"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("e").isNotNull() & finite & F.exists("e", lambda x: x != 0)
    v = v.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("e", F.transform("e", lambda x: x + F.lit(0.0)))
    v = scratch.save(v.withColumn("space", F.when(F.col("sound"), F.concat_ws("/", F.size("e").cast("string"), "label"))), "vectors")
    points = v.where("sound").groupBy("space", "e").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    points = scratch.save(points, "points")

    # blocks: of the points at home that search, and of the points that are searched; one of each but in large shards
    blocks = lambda n, size, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.greatest(F.lit(1), F.ceil(F.col(n) / size))).cast("int")
    dealt = shards(points, scratch, cosine)
    dealt = dealt.withColumn("searching", blocks("n", BLOCK, 1)).withColumn("block", blocks("m", CAP, 2))

    def graph_of(pdf):
        import pandas as pd

        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy()
        graph = build(np.stack([np.frombuffer(b) for b in pdf["x"]]))
        return pd.DataFrame({"id": ids, "near": [ids[g[g >= 0]].tolist() for g in graph]})

    lists = dealt.where("built").select("shard", "block", "id", "x").groupBy("shard", "block").applyInPandas(graph_of, "id long, near array<long>")
    united = scratch.save(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "united")

    last = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int") - 1
    among = F.transform(F.sequence(F.lit(0), last("n", BLOCK)), lambda h: F.struct(h.alias("searching"), F.col("block").alias("block"), F.lit(True).alias("point"), (F.col("home") & (h == F.col("searching"))).alias("query")))
    alone = F.transform(F.filter(F.sequence(F.lit(0), last("m", CAP)), lambda b: b != F.col("block")), lambda b: F.struct(F.col("searching").alias("searching"), b.alias("block"), F.lit(False).alias("point"), F.lit(True).alias("query")))
    part = F.explode(F.when(F.col("home"), F.concat(among, alone)).otherwise(among)).alias("p")
    full = dealt.join(united, "id").select("shard", "id", "copies", "x", "near", part).select("shard", "p.*", "id", "copies", "x", "near")

    def search(pdf):
        import pandas as pd

        pdf = pdf.sort_values("id")
        asked, pdf = pdf[pdf["query"]], pdf[pdf["point"]]
        if not len(asked) or not len(pdf):
            none = np.zeros(0, np.int64)
            return pd.DataFrame({"id": none, "n": none, "to": pd.Series([], dtype=object), "recall": pd.Series([], dtype=float), "beam": pd.Series([], dtype="int32")})
        vectors = lambda f: np.stack([np.frombuffer(b) for b in f["x"]])
        ids, copies, x, queries = pdf["id"].to_numpy(), pdf["copies"].to_numpy(), vectors(pdf), vectors(asked)
        found_at = lambda wanted: np.where(ids[at := np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)] == wanted, at, -1)
        # neighbours that another shard knows count where both points are here
        size = np.array([len(n) for n in pdf["near"]])
        graph = np.full((len(ids), max(1, size.max(initial=0))), -1, np.int64)
        graph[np.repeat(np.arange(len(ids)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = found_at(np.concatenate([np.asarray(n, np.int64) for n in pdf["near"]]))
        own = found_at(asked["id"].to_numpy())
        found, recall, beam = block_links(x, graph, queries, own, cosine)
        return pd.DataFrame({"id": asked["id"].to_numpy(), "n": [int(copies[f].sum()) for f in found], "to": joined(ids, own, found), "recall": recall, "beam": beam})

    links = scratch.save(full.groupBy("shard", "searching", "block").applyInPandas(search, "id long, n long, to array<long>, recall double, beam int"), "links")
    joined_ = components(links.select(F.col("id").alias("a"), F.explode("to").alias("b")), scratch, "parts")
    counts = links.groupBy("id").agg(F.sum("n").alias("n"), F.min("recall").alias("recall"))
    counted = points.join(counts, "id").join(joined_.withColumnRenamed("node", "id"), "id", "left")
    counted = counted.select("space", "e", (F.col("n") + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component"), "recall")
    out = v.join(counted.withColumnRenamed("space", "s").withColumnRenamed("e", "f"), F.col("sound") & (F.col("space") == F.col("s")) & (F.col("e") == F.col("f")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), "recall")


SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN c ON a = vec_id
"""
