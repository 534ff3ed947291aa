"""Operator 6: Jaccard self-join of word shingles by adaptive multi-match prefixes.

The distinct shingles of a document are put in one order for all documents: rare ones first, by a table of counts
over all documents (``TABLE`` counters addressed by hash, so of fixed size; a collision only makes a shingle look
more common, and any order is exact).  Two sets that reach the similarity share at least l of the first
|x| - ceil(t |x|) + l shingles, for every l up to the overlap they need.  Each document picks its own l: it lengthens
its prefix while the estimated cost of postings and of verified candidates falls, and two documents are compared
when they share the lesser of their two numbers within that lesser prefix.

Documents with the same set are one class, named by the hash of the set; rows that share a number but not a text are
different classes.  A group is the classes that share a prefix shingle; its centre is the one whose
shingles are the most common by the table of counts, so of near copies the least edited.  Every class is first compared with the centres of its
groups, in numbers that grow with the members: classes linked to the same one need no more comparison
for the components.  In groups that are still not one, pairs that share enough prefix shingles meet; so many near
copies that miss the similarity among each other would meet in numbers that grow with the square of a group, so
groups beyond ``GROUP`` meet by a second prefix filter, over their differences from the centre (``recentred``):
an exact way for the rest, which loses no link.  Every candidate must pass a parity bitmap (``plausible``, an upper bound
of the overlap), then the common shingles of both sets are counted.

Cases: words are lower-cased for A-Z and split at ASCII space; a null text or one without words has an empty set,
linked with nothing; a text of fewer words than a shingle is one shingle; rows with a null doc_id are returned with
a null component and link nothing; repeated rows are returned each; a doc_id used by several texts names each of them,
and component_id is the least doc_id of the texts reached; an empty table gives an empty result; other
columns are not read.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitballot.llm._common import BROADCAST_ROWS, Scratch, map_texts, small
from bitballot.llm._graph import components
from bitballot.llm._words import Words, mix, shingles, slices, utf8

#: Counters in the table of counts, and the part of it in one row.
TABLE = 1 << 20
ROW = 1 << 14
#: The most members of a group whose pairs meet by shared prefix shingles.
GROUP = 32
#: The most shared prefix shingles that a document may ask for; the share of prefix shingles that the cost takes to be shared by chance.
MOST = 8
CHANCE = 0.1
#: 64-bit words of a parity bitmap; the most members that are compared with one copy of a centre.
MARK = 16
BLOCK = 64


def class_of(s):
    """Names a set by a hash of its shingles."""
    import numpy as np

    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """A row (doc_id, th, n, cls) for each document and, for each task, rows (part, counts) of its table of counts."""
    names = ["doc_id", "th", "n", "cls", "part", "counts"]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zlib

        words, table = Words(), np.zeros(TABLE, np.int32)
        empty = lambda n, t: pa.nulls(n, t)
        for batch in batches:
            for part in slices(batch, "text"):
                n, cls = [], []
                row, _, _, h = words(*utf8(part.column("text")))
                for s in shingles(row, h, len(part), k):
                    n.append(len(s))
                    cls.append(class_of(s))
                    np.add.at(table, (s & np.uint64(TABLE - 1)).astype(np.int64), 1)
                m = len(part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(n, pa.int32()), pa.array(cls, pa.int64()), empty(m, pa.int32()), empty(m, pa.binary())], names)
        for i in range(TABLE // ROW):
            counts = table[i * ROW : (i + 1) * ROW]
            if counts.any():
                yield pa.RecordBatch.from_arrays([empty(1, pa.int64()), empty(1, pa.int64()), empty(1, pa.int32()), empty(1, pa.int64()), pa.array([i], pa.int32()), pa.array([zlib.compress(counts.tobytes(), 1)])], names)

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, n int, cls long, part int, counts binary")


def total_counts(signed: DataFrame):
    """The table of counts of all documents: TABLE numbers, whatever the input."""
    import numpy as np

    def add(batches):
        import zlib

        import pyarrow as pa

        sums = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(counts), np.int32).astype(np.int64)
        for part, total in sums.items():
            packed = zlib.compress(np.minimum(total, 2**31 - 1).astype(np.int32).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed])], ["part", "counts"])

    import zlib

    rows = signed.where("part is not null").select("part", "counts")
    # each task sums what it reads, then the rows of a part meet
    sums = rows.mapInArrow(add, "part int, counts binary").repartition(TABLE // ROW, "part").mapInArrow(add, "part int, counts binary")
    table = np.zeros(TABLE, np.int32)
    for r in sums.collect():
        table[r.part * ROW : (r.part + 1) * ROW] = np.frombuffer(zlib.decompress(r.counts), np.int32)
    return table


def prefixes(docs: DataFrame, k: int, percent: int, shared) -> DataFrame:
    """cls, n, ell (shared shingles asked for), the prefix for ell, rare shingles first, the parity bitmap, a row's doc_id and how common its shingles are.

    A class once for each task that meets it.  ``shared``: the broadcast table of counts.
    """

    def start():
        import numpy as np
        import pyarrow as pa

        counts, words, seen = shared.value, Words(), set()
        noise = counts.mean() * 1.25 + 1
        types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int32()]

        def work(part):
            out = []
            row, _, _, h = words(*utf8(part.column("text")))
            for s, doc_id in zip(shingles(row, h, len(part), k), part.column("doc_id").to_pylist()):
                n, cls = len(s), class_of(s) if len(s) else 0
                if not n or cls in seen:
                    continue
                seen.add(cls)
                need = -(-percent * n // 100)
                most = min(MOST, need)
                c = counts[(s & np.uint64(TABLE - 1)).astype(np.int64)]
                order = np.lexsort((s, c))[: n - need + most]
                posted = np.cumsum(np.maximum(0.0, c[order] - noise))[n - need :]
                ell = np.arange(1, most + 1)
                cost = posted + (posted / ell + (n - need + ell) * CHANCE**ell) * (8 + n / 16) + ell
                best = int(np.argmin(cost)) + 1
                odd = (np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=64 * MARK) & 1).astype(np.uint8)
                out.append((cls, n, best, s[order[: n - need + best]].view(np.int64), np.packbits(odd).view(np.int64), doc_id, int(1024 * np.log2(c + 1.0).mean())))
            columns = zip(*out) if out else [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["cls", "n", "ell", "prefix", "mark", "id", "usual"])

        return work

    return map_texts(docs, start, "cls long, n int, ell int, prefix array<long>, mark array<long>, id long, usual int")


def fits(n: str, m: str, percent: int):
    return F.col(n) * 100 >= F.col(m) * percent


def allowed(n, m, percent: int):
    """The most elements by which linked sets of n and m elements differ."""
    return n + m - 2 * (-(-percent * (n + m) // (100 + percent)))


def allowed_column(n: str, m: str, percent: int):
    total = F.col(n) + F.col(m)
    return total - 2 * F.ceil(total * percent / F.lit(100 + percent))


def plausible(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, more) whose bitmaps differ in no more bits than the sets may differ in elements, with a number of a row of each, ia and ib.

    Each element that only one of two sets has changes one bit of its bitmap, so the bits that differ are at most
    those elements: no linked pair goes.  ``marks``: written, a row (cls, n, mark, id) a class, so that a centre with many
    members can be split in the join.
    """
    right = pairs.join(marks.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("mark").alias("y"), F.col("id").alias("ib")), "b")
    both = right.join(marks.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("mark").alias("x"), F.col("id").alias("ia")), "a")
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, c: s + c)
    return both.where(fits("na", "nb", percent) & fits("nb", "na", percent) & (apart <= allowed_column("na", "nb", percent))).select(*pairs.columns, "ia", "ib")


def beside(pairs: DataFrame, texts: DataFrame, k: int, each, schema: str) -> DataFrame:
    """Applies ``each``(rows (a, centre's set, list of (b and more of a pair, member's set))) to the written ``pairs`` (a, b, ia, ib, m, more).

    m: about how many members a has.  The texts of the classes in pairs go to Python once each, chosen by their numbers; a
    task gives the set of a class once, however often its row is repeated.  The sets are shuffled to blocks of about BLOCK
    members, each with a copy of its centre, and read there as a sorted stream: no task holds more than a batch.
    """
    more = ["b", *[c for c in pairs.columns if c not in ("a", "b", "ia", "ib", "m")]]
    kinds = {c: t for c, t in pairs.dtypes if c in more}
    cut = pairs.withColumn("block", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / BLOCK)))
    members = cut.select("a", "block", F.col("b").alias("cls"), F.col("ib").alias("id"), *more)
    hubs = cut.select("a", "block", F.col("a").alias("cls"), F.col("ia").alias("id")).distinct().select("a", "block", "cls", "id", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    roles = members.unionByName(hubs)
    few = F.broadcast if pairs.limit(BROADCAST_ROWS // 2 + 1).count() <= BROADCAST_ROWS // 2 else lambda df: df
    chosen = texts.join(few(roles.select(F.col("id").alias("doc_id")).distinct()), "doc_id", "left_semi").select("text")
    names = ["a", "block", "shingles", *more]

    def start():
        import numpy as np
        import pyarrow as pa

        words, seen = Words(), set()

        def work(part):
            cls, packed = [], []
            row, _, _, h = words(*utf8(part.column("text")))
            for s in shingles(row, h, len(part), k):
                name = class_of(s) if len(s) else None
                if name is not None and name not in seen:
                    seen.add(name)
                    cls.append(name), packed.append(s.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(packed, pa.binary())], ["cls", "shingles"])

        return work

    def run(batches):
        import numpy as np

        at, centre = None, None
        for batch in batches:
            keys = list(zip(batch.column("a").to_pylist(), batch.column("block").to_pylist()))
            told = list(zip(*[batch.column(c).to_pylist() for c in more]))
            inside, out = [], []
            for key, values, s in zip(keys, told, batch.column("shingles")):
                s = np.frombuffer(s.as_buffer(), np.uint64)
                if key != at or values[0] is None:
                    if inside:
                        out.append((at[0], centre, inside))
                    at, centre, inside = key, s, []
                if values[0] is not None:
                    inside.append((values, s))
            if inside:
                out.append((at[0], centre, inside))
            yield from each(out)

    # a text that shares its number with a chosen one has another class, or is as good
    sets = map_texts(chosen, start, "cls long, shingles binary").join(few(roles.drop("id")), "cls").select(names)
    return sets.repartition("a", "block").sortWithinPartitions(F.col("a"), F.col("block"), F.col("b").asc_nulls_first()).mapInArrow(run, schema)


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the written ``pairs`` (a, b, ia, ib, m) that reach the similarity."""

    def each(groups):
        import numpy as np
        import pyarrow as pa

        a, b = [], []
        for centre, xs, members in groups:
            for (other,), ys in members:
                few, many = (xs, ys) if len(xs) < len(ys) else (ys, xs)
                both = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
                if both > 0 and 100 * both >= percent * (len(xs) + len(ys) - both):
                    a.append(centre), b.append(other)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return beside(pairs.select("a", "b", "ia", "ib", "m"), texts, k, each, "a long, b long")


def differences(members: DataFrame, texts: DataFrame, k: int, percent: int, shared) -> DataFrame:
    """For rows (a: centre, b: member, ia, ib, m: members of the centre, label, linked) the size and prefix of D(b), the symmetric difference from the centre.

    D's elements are ordered by about how many members' D have them: those that the centre lacks by the table of counts,
    rare ones first; those of the centre as if one member in 16 lacks them, or as many as the table of counts leaves.
    """

    def each(groups):
        import numpy as np
        import pyarrow as pa

        counts = shared.value
        noise = int(counts.mean() * 1.25 + 1)
        at = lambda d: counts[(d & np.uint64(TABLE - 1)).astype(np.int64)].astype(np.int64)
        out = {c: [] for c in ("a", "b", "label", "linked", "n", "dn", "reach", "short", "mark", "tokens")}
        for a, xs, rows in groups:
            m = len(xs)
            for (b, label, linked, g), ys in rows:
                added, lost = np.setdiff1d(ys, xs, assume_unique=True), np.setdiff1d(xs, ys, assume_unique=True)
                d, n = np.concatenate([added, lost]), len(ys)
                dn, weight = len(d), np.concatenate([at(added), noise + np.maximum(g // 16, g - at(lost))])
                most = (100 - percent) * n // percent  # the most that any partner of its size differs by
                apart = allowed(-(-percent * n // 100), m, percent) + 1  # the least D of a partner that is not linked
                far = max(1, -(-(dn - most) // 2))
                near = max(1, -(-(dn + max(dn, apart if linked else dn) - most) // 2))
                reach, short = max(0, dn - far + 1), max(0, dn - near + 1)
                # 1, 2: ends of pairs that need not share an element of D
                mark = 1 if linked and dn <= (100 - percent) * max(0, n - m) / (100 + percent) + 2 else 2 if not linked and dn <= most else 0
                tokens = d[np.lexsort((d, weight))][: max(reach, short)].view(np.int64)
                for c, v in zip(out, (a, b, label, linked, n, dn, reach, short, mark, tokens)):
                    out[c].append(v)
        types = [pa.int64()] * 3 + [pa.bool_()] + [pa.int32()] * 5 + [pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))

    schema = "a long, b long, label long, linked boolean, n int, dn int, reach int, short int, mark int, tokens array<long>"
    return beside(members.select("a", "b", "ia", "ib", "m", "label", "linked", F.col("m").alias("g")), texts, k, each, schema)


def recentred(made: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of written ``differences`` that may be linked, of one centre and different labels.

    |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|, and linked sets differ by at most ``allowed``.  So they share at least
    o = (|D(x)| + |D(y)| - allowed) / 2 elements of D, some of them among the first |D| - o + 1 of each.  Members of a
    group of near copies differ in their own edits, which are rare, so few pairs meet.  Two members that are both linked
    with the centre are one already; so the D of at least one exceeds what the centre allows.  Where o is 0, the other
    is linked with the centre and all but the centre itself: as all such members are one, only the nearest of each size is kept.
    """
    posted = made.select("a", "b", "label", "linked", "n", "dn", "reach", "short", F.posexplode_outer("tokens").alias("pos", "token")).where("token is not null")
    columns = ("b", "label", "linked", "n", "dn")
    pick = lambda df, end: [F.col(c).alias(f"{c}{end}") for c in columns]
    role = lambda name, end: posted.where(F.col(name) > F.col("pos")).select("a", "token", F.col("pos").alias(f"pos{end}"), *pick(posted, end))
    more = (F.col("dn_") > F.col("dn")) | (F.col("dn_") == F.col("dn")) & (F.col("b_") > F.col("b"))
    ok = (F.col("label") != F.col("label_")) & ~(F.col("linked") & F.col("linked_")) & fits("n", "n_", percent) & fits("n_", "n", percent)
    need = F.ceil((F.col("dn") + F.col("dn_") - allowed_column("n", "n_", percent)) / 2)
    shared = role("short", "").join(role("reach", "_"), ["a", "token"]).where(ok & more & (F.col("pos") <= F.col("dn") - need) & (F.col("pos_") <= F.col("dn_") - need))
    near = made.where("mark = 1").groupBy("a", "n").agg(F.min(F.struct("dn", "b", "label", "linked")).alias("x")).select("a", "n", "x.*")
    none = near.join(made.where("mark = 2").select("a", *pick(made, "_")), "a").where(ok & (need <= 0))
    return shared.select("b", "b_").unionByName(none.select("b", "b_")).select(F.least("b", "b_").alias("a"), F.greatest("b", "b_").alias("b"))


def labels(links: DataFrame) -> DataFrame:
    """cls, label for the ends of ``links`` (a, b): another node of their component, the same for most of it."""
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ends.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("label")).withColumn("label", F.least("cls", "label"))
    for _ in range(2):
        near = near.join(near.select(F.col("cls").alias("label"), F.col("label").alias("next")), "label").select("cls", F.col("next").alias("label"))
    return near


def linked(docs: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame:
    """doc_id, th (hash of the text), n, component_id and stays (the row stands for its component) for each row of ``docs`` (doc_id, text)."""
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    signed = scratch.save(signatures(texts, k), "signed")
    table = docs.sparkSession.sparkContext.broadcast(total_counts(signed))  # TABLE counters
    rows = signed.where("part is null").drop("part", "counts")
    texts = texts.where("doc_id is not null").drop("th")
    classes = scratch.save(rows.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("id")), "classes")
    made = scratch.save(prefixes(texts, k, percent, table), "prefixes")

    marks = scratch.save(made.select("cls", "n", "mark", "id").dropDuplicates(["cls"]), "marks")
    # shingles in two prefixes at least; n, usual (16 bits), level and ell (8 bits each) of a posting in one number
    pos = made.select("cls", "n", "ell", "usual", F.posexplode_outer("prefix").alias("pos", "token"))
    level = F.greatest(F.lit(1), F.col("pos") - F.col("n") + F.ceil(F.col("n") * percent / F.lit(100)) + 1)
    posted = pos.select("token", "cls", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("usual") * 65536 + level * 256 + F.col("ell")).alias("meta"))
    common = posted.groupBy("token").count().where("count > 1").select("token")
    shared = scratch.save(posted.join(common, "token", "left_semi").groupBy("token", "cls").agg(F.min("meta").alias("meta")), "shared")
    part = lambda meta, low, bits: F.shiftright(meta, low).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    size, ell = lambda meta: part(meta, 32, 31), lambda meta: part(meta, 0, 8)
    centre = shared.groupBy("token").agg(F.count("*").alias("c"), F.max(F.struct(part("meta", 16, 16).alias("usual"), "cls", "meta")).alias("p")).where("c > 1")
    groups = scratch.save(shared.join(centre.select("token", "c", F.col("p.cls").alias("a"), F.col("p.meta").alias("am")), "token"), "groups")
    scratch.drop("shared")

    # 1. the centre of each group against the others
    stars = groups.where("cls <> a").select("a", F.col("cls").alias("b"), "c", size("meta").alias("n"), size("am").alias("n_"), F.least(ell("meta"), ell("am")).alias("asked"))
    stars = stars.where(fits("n", "n_", percent) & fits("n_", "n", percent)).groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("asked").alias("asked"), F.max("c").alias("m"))
    stars = stars.where((F.col("shared") >= F.col("asked")) | (F.col("m") > GROUP)).select("a", "b", "m")
    stars = scratch.save(plausible(stars, marks, percent), "stars")
    links = scratch.save(verified(stars, texts, k, percent), "links-1")
    # 2. pairs of groups that are not yet one by these links
    label = labels(links)
    labelled = groups.join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    labelled = scratch.save(labelled, "labelled")
    scratch.drop("groups")
    open_ = labelled.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token")
    open_ = scratch.save(labelled.join(open_, "token", "left_semi"), "open")
    scratch.drop("labelled")
    left = open_.where(F.col("c") <= GROUP).select("token", "cls", "label", size("meta").alias("n"), ell("meta").alias("ell"), part("meta", 8, 8).alias("level"))
    right = left.select("token", *[F.col(c).alias(f"{c}_") for c in left.columns[1:]])
    met = left.join(right, "token").where((F.col("cls") < F.col("cls_")) & (F.col("label") != F.col("label_")) & (F.greatest("level", "level_") <= F.least("ell", "ell_")) & fits("n", "n_", percent) & fits("n_", "n", percent))
    met = met.groupBy(F.col("cls").alias("a"), F.col("cls_").alias("b")).agg(F.count("*").alias("shared"), F.first(F.least("ell", "ell_")).alias("asked")).where("shared >= asked").select("a", "b")
    # larger groups by their differences from the centre
    large = open_.where(F.col("c") > GROUP).groupBy("a", F.col("cls").alias("b"), "label").agg(F.max("c").alias("m"))
    large = large.join(links.withColumn("linked", F.lit(True)), ["a", "b"], "left").withColumn("linked", F.coalesce("linked", F.col("a") == F.col("b")))
    ids = marks.select("cls", "id")
    large = large.join(ids.toDF("b", "ib"), "b").join(ids.toDF("a", "ia"), "a")
    large = scratch.save(large, "large")
    apart = scratch.save(differences(large, texts, k, percent, table), "differences")
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    met = met.unionByName(recentred(apart, percent)).distinct().join(done, ["a", "b"], "left_anti")
    met = scratch.save(plausible(met.withColumn("m", F.lit(8 * BLOCK)), marks, percent), "met")
    scratch.drop("open", "prefixes", "large", "marks")
    last = scratch.save(verified(met, texts, k, percent), "links-2")
    table.destroy()

    # the least number of each component, for the classes that have links
    found = components(links.unionByName(last), scratch, "joined")
    found = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("node", "cls").join(classes, "cls")
    names = found.groupBy("component").agg(F.min(F.struct("id", "cls")).alias("p")).select("component", F.col("p.id").alias("least"), F.col("p.cls").alias("first"))
    found = found.join(names, "component").select("cls", "least", "first")
    named = scratch.save(classes.join(found, "cls", "left").select(F.col("cls").alias("_cls"), F.coalesce("least", "id").alias("least"), F.coalesce("first", "cls").alias("first")), "named")
    out = rows.join(named, (F.col("cls") == F.col("_cls")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    stays = F.coalesce((F.col("doc_id") == F.col("least")) & (F.col("cls") == F.col("first")), F.lit(True))
    return out.select("doc_id", "th", "n", F.coalesce("least", "doc_id").alias("component_id"), stays.alias("stays"))


def join(docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text)."""
    return linked(docs, scratch, k, percent).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group: its text of least doc_id, a repeated row once."""
    found = scratch.save(linked(docs, scratch, k, percent), "joined-rows")
    gone = found.where("not stays").select("doc_id", "th").distinct().withColumn("gone", F.lit(True))
    once = found.where("stays and n > 0 and doc_id is not null").groupBy("doc_id", "th").count().where("count > 1").select("doc_id", "th", F.lit(False).alias("gone"))
    told = small(scratch.save(gone.unionByName(once), "told").toDF("_d", "_t", "_gone"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_th"))
    rows = rows.join(told, (F.col("_doc") == F.col("_d")) & (F.col("_th") == F.col("_t")), "left")
    once = rows.where("_gone = false").dropDuplicates(["_d", "_t"])
    return rows.where("_gone is null").select("_row.*").unionByName(once.select("_row.*"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[p : p + 3] AS g FROM d, unnest(range(1, greatest(len(w) - 2, 2))) AS t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""
