"""Clause models as arrays and as tables, and ways to score rows with them.

A clause's output is max(clamp - mismatches, 0); a class's votes are the outputs of its positive clauses less
those of its negative ones; the prediction is the class with most votes, the least index on ties.
All ways give the same integers: ``predict`` (Arrow batches, no shuffle; the default), ``votes_relational``
(packed words against a broadcast clause table, then a grouped sum), ``votes_sparse`` (bits met by the clauses'
lists of literals in Arrow batches, no shuffle) and ``votes_expression`` (one expression per class, no shuffle).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitballot.functions import bits as B


@dataclass
class ClauseModel:
    feat: np.ndarray
    thresh: np.ndarray
    cls: np.ndarray
    sign: np.ndarray
    clause: np.ndarray
    clamp: np.ndarray
    pos: np.ndarray  # uint64, clauses x words
    neg: np.ndarray
    classes: int
    feature_names: list[str] = field(default_factory=list)
    class_names: list[str] = field(default_factory=list)

    @staticmethod
    def of(feat, thresh, rows, classes: int, feature_names=(), class_names=()) -> ClauseModel:
        """rows: (class, sign, clause, clamp, bits included, bits included negated)."""
        h = max(1, -(-len(feat) // 64))
        pos, neg = np.zeros((len(rows), h), np.uint64), np.zeros((len(rows), h), np.uint64)
        for i, r in enumerate(rows):
            for mask, literals in ((pos, r[4]), (neg, r[5])):
                for b in literals:
                    if not 0 <= b < len(feat):
                        raise ValueError(f"bit {b} of {len(feat)}")
                    mask[i, b >> 6] |= np.uint64(1 << (b & 63))
        column = lambda j: np.array([r[j] for r in rows], np.int64)
        return ClauseModel(np.asarray(feat, np.int32), np.asarray(thresh, np.float32), column(0), column(1), column(2), column(3), pos, neg, classes, list(feature_names), list(class_names) or [str(k) for k in range(classes)])

    @property
    def words(self) -> int:
        return self.pos.shape[1]

    def literals(self, i: int) -> tuple[list[int], list[int]]:
        on = lambda m: [b for b in range(len(self.feat)) if int(m[i, b >> 6]) >> (b & 63) & 1]
        return on(self.pos), on(self.neg)

    def rows(self) -> list[tuple]:
        return [(int(self.cls[i]), int(self.sign[i]), int(self.clause[i]), int(self.clamp[i]), *self.literals(i)) for i in range(len(self.cls))]

    def clause_table(self, spark: SparkSession) -> DataFrame:
        """class, sign, clause, clamp, pos, neg, xor (words)."""
        signed = lambda m: m.view(np.int64).tolist()
        rows = list(zip(self.cls.tolist(), self.sign.tolist(), self.clause.tolist(), self.clamp.tolist(), signed(self.pos), signed(self.neg), signed(self.pos ^ self.neg)))
        return spark.createDataFrame(rows, "class int, sign int, clause int, clamp int, pos array<long>, neg array<long>, xor array<long>")

    def literal_table(self, spark: SparkSession) -> DataFrame:
        """class, sign, clause, clamp, bit, negated."""
        rows = [(k, s, c, m, b, n) for k, s, c, m, p, q in self.rows() for n, bits in ((False, p), (True, q)) for b in bits]
        return spark.createDataFrame(rows, "class int, sign int, clause int, clamp int, bit int, negated boolean")

    def threshold_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, int(f), float(t), f"{float(t):.4g}") for i, (f, t) in enumerate(zip(self.feat, self.thresh))], "bit int, feat int, thresh float, told string")

    def literal_lists(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The literals in use (a bit, its negation as that plus the number of bits), and each clause's places among them."""
        n = len(self.feat)
        on = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little")[:n])
        each = [np.concatenate([on(p), n + on(q)]) for p, q in zip(self.pos, self.neg)]
        used, at = np.unique(np.concatenate([np.zeros(0, np.int64), *each]), return_inverse=True)
        return used, np.split(at, np.cumsum([len(e) for e in each])[:-1])

    def pruned(self) -> tuple[ClauseModel, np.ndarray]:
        """An equal model with fewer clauses, and constant votes by class.

        Empty clauses give their clamp always; a clause whose contradictions reach its clamp gives nothing; equal
        clauses of both signs cancel.
        """
        size = np.bitwise_count(self.pos).sum(axis=1) + np.bitwise_count(self.neg).sum(axis=1)
        bias = np.zeros(self.classes, np.int64)
        empty = size == 0
        np.add.at(bias, self.cls[empty], (self.sign * self.clamp)[empty])
        dead = np.bitwise_count(self.pos & self.neg).sum(axis=1) >= self.clamp
        weight: dict[tuple, list[int]] = {}
        for i in np.flatnonzero(~empty & ~dead):
            weight.setdefault((int(self.cls[i]), int(self.clamp[i]), self.pos[i].tobytes(), self.neg[i].tobytes()), []).append(i)
        keep, sign = [], []
        for same in weight.values():
            total = int(self.sign[same].sum())
            keep += same[: abs(total)]
            sign += [1 if total > 0 else -1] * abs(total)
        k = np.array(keep, np.int64)
        return ClauseModel(self.feat, self.thresh, self.cls[k], np.array(sign, np.int64), self.clause[k], self.clamp[k], self.pos[k], self.neg[k], self.classes, self.feature_names, self.class_names), bias

    def pack(self, x: np.ndarray) -> np.ndarray:
        """uint64 words of rows of features; NaN is below every threshold."""
        n = len(x)
        out = np.zeros((n, self.words), np.uint64)
        with np.errstate(invalid="ignore"):
            for w in range(self.words):
                f, t = self.feat[64 * w : 64 * w + 64], self.thresh[64 * w : 64 * w + 64]
                on = np.zeros((n, 64), np.uint8)
                on[:, : len(f)] = x[:, f] >= t
                out[:, w] = np.packbits(on, axis=1, bitorder="little").view(np.uint64)[:, 0]
        return out

    def votes(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), self.classes), np.int64)
        xor = self.pos ^ self.neg
        for k, s, m, lits, x in zip(self.cls.tolist(), self.sign.tolist(), self.clamp.tolist(), self.pos, xor):
            wrong = np.bitwise_count(lits ^ (x & words)).sum(axis=1, dtype=np.int64)
            out[:, k] += s * np.maximum(m - wrong, 0)
        return out

    def votes_by_literals(self, x: dict[int, np.ndarray], n: int, used: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
        """The same from ``literal_lists`` and n values of each feature: contradicted literals are counted by clause; NaN is below every threshold."""
        out = np.zeros((self.classes, n), np.int64)
        step = max(1, (1 << 24) // max(1, len(used)))  # rows at once: 16 MB of literals
        for start in range(0, n, step):
            part = slice(start, min(n, start + step))
            against = np.empty((len(used), part.stop - start), np.uint8)
            with np.errstate(invalid="ignore"):
                for row, literal in zip(against, used.tolist()):
                    negated, b = divmod(literal, len(self.feat))
                    on = x[int(self.feat[b])][part] >= self.thresh[b]
                    row[:] = on if negated else ~on
            for k, s, m, at in zip(self.cls.tolist(), self.sign.tolist(), self.clamp.tolist(), lists):
                wrong = np.zeros(part.stop - start, np.int64)
                for i in range(0, len(at), 255):  # as many as a byte can count
                    few = against[at[i]].copy()
                    for j in at[i + 1 : i + 255]:
                        few += against[j]
                    wrong += few
                out[k, part] += s * np.maximum(m - wrong, 0)
        return out.T


def feature_bits(columns: list[str], feat, thresh) -> list[Column]:
    return [B.at_least(F.col(columns[f]), F.lit(float(t)).cast("float")) for f, t in zip(feat.tolist(), thresh.tolist())]


def ladders(model: ClauseModel) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each feature its thresholds, ascending, and the words of its bits when none, one, two, ... of them are reached."""
    out = {}
    for f in sorted(set(model.feat.tolist())):
        bits = np.flatnonzero(model.feat == f)
        steps = np.unique(model.thresh[bits])
        steps = steps[~np.isnan(steps)]
        words = np.zeros((len(steps) + 1, model.words), np.uint64)
        for b in bits:
            words[1 + np.searchsorted(steps, model.thresh[b]) :, b >> 6] |= np.uint64(1 << (int(b) & 63))
        out[f] = (steps, words)
    return out


def up_to(x: Column):
    return lambda t: t <= x


def packed(df: DataFrame, columns: list[str], model: ClauseModel) -> DataFrame:
    """Adds w0, w1, ...; only the named columns are read.

    A feature's bits depend on how many of its thresholds a value reaches, so that number looks its words up: a
    comparison a bit would make one generated method too large for the JVM to compile.
    """
    found = ladders(model)
    reached = {}
    for f, (steps, _) in found.items():
        x = F.col(columns[f])
        known = F.array(*[F.lit(float(t)).cast("float") for t in steps])
        reached[f"_reached{f}"] = F.when(x.isNull() | F.isnan(x), 0).otherwise(F.size(F.filter(known, up_to(x))))
    with_counts = df.select("*", *[c.alias(n) for n, c in reached.items()])
    signed = lambda column: F.array(*[F.lit(int(v)).cast("long") for v in column.view(np.int64)])
    words = []
    for i in range(model.words):
        parts = [F.element_at(signed(np.ascontiguousarray(w[:, i])), F.col(f"_reached{f}") + 1) for f, (_, w) in found.items() if w[:, i].any()] or [F.lit(0).cast("long")]
        while len(parts) > 1:
            parts = [parts[j].bitwiseOR(parts[j + 1]) if j + 1 < len(parts) else parts[j] for j in range(0, len(parts), 2)]
        words.append(parts[0].alias(f"w{i}"))
    return with_counts.select(*df.columns, *words)


def bit_cells(cells: DataFrame, thresholds: DataFrame, key: str = "row_id") -> DataFrame:
    """key, bit, on of long cells (key, feat, val), by an equi-join with the thresholds (bit, feat, thresh) of each feature."""
    few = F.broadcast(thresholds.select("bit", "feat", "thresh"))  # 65 535 at most
    return cells.join(few, "feat").select(key, "bit", B.at_least(F.col("val"), F.col("thresh")).alias("on"))


def packed_batches(df: DataFrame, columns: list[str], model: ClauseModel, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """``keep`` columns with w0, w1, ... from Arrow batches.

    Before a loop over clauses this keeps the many comparisons of the bits out of the loop's generated method, which
    would otherwise be too large for the JVM to compile.
    """
    shared = df.sparkSession.sparkContext.broadcast(vars(model))  # plain arrays: workers need no copy of the package

    def run(batches):
        import pyarrow as pa

        model = ClauseModel(**shared.value)
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float32) for c in columns], axis=1)
            words = model.pack(x).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(np.ascontiguousarray(w)) for w in words.T)], [*keep, *(f"w{i}" for i in range(model.words))])

    schema = ", ".join([f"{c} {df.schema[c].dataType.simpleString()}" for c in keep] + [f"w{i} long" for i in range(model.words)])
    return df.select(*dict.fromkeys([*keep, *columns])).mapInArrow(run, schema)


def predict(df: DataFrame, columns: list[str], model: ClauseModel, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """``keep`` columns with votes (by class) and pred, in Arrow batches of a map-only plan."""
    small, bias = model.pruned()
    shared = df.sparkSession.sparkContext.broadcast((vars(small), bias))  # 65 535 clauses a class and sign at most

    def run(batches):
        import pyarrow as pa

        model, bias = ClauseModel(**shared.value[0]), shared.value[1]
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float32) for c in columns], axis=1)
            if not len(x):
                continue
            votes = model.votes(model.pack(x)) + bias
            flat = pa.ListArray.from_arrays(np.arange(0, votes.size + 1, model.classes, dtype=np.int32), pa.array(votes.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), flat, pa.array(votes.argmax(axis=1).astype(np.int32))], [*keep, "votes", "pred"])

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    need = list(dict.fromkeys([*keep, *columns]))
    return df.select(*need).mapInArrow(run, f"{schema}, votes array<long>, pred int")


def with_clauses(df: DataFrame, model: ClauseModel) -> DataFrame:
    """Every row with every clause of the broadcast model (a clause table is bounded by its file format)."""
    return df.join(F.broadcast(model.clause_table(df.sparkSession)))


def mismatch(model: ClauseModel, xor: bool = False) -> Column:
    words = [F.col(f"w{i}") for i in range(model.words)]
    part = lambda name: [F.col(name)[i] for i in range(model.words)]
    return B.mismatches_xor(words, part("pos"), part("xor")) if xor else B.mismatches(words, part("pos"), part("neg"))


def votes_relational(df: DataFrame, columns: list[str], model: ClauseModel, key: str = "row_id") -> DataFrame:
    """row_id, class, votes by a grouped sum over the clause table; the narrow rows are shuffled before they meet the clauses."""
    out = with_clauses(packed_batches(df, columns, model, (key,)).repartition(key), model).withColumn("out", F.greatest(F.col("clamp") - mismatch(model), F.lit(0)))
    return out.groupBy(key, "class").agg(F.sum(F.col("sign") * F.col("out")).alias("votes"))


def scored_sparse(df: DataFrame, columns: list[str], model: ClauseModel, key: str = "row_id") -> DataFrame:
    """key with votes (by class) and pred from literals, in Arrow batches of a map-only plan.

    Within a batch each bit meets the clauses that include it or its negation. As rows of joined tables those would be
    hundreds for each row of data, and their counts by clause would have to be shuffled.
    """
    used, lists = model.literal_lists()
    shared = df.sparkSession.sparkContext.broadcast((vars(model), used, lists))  # 65 535 clauses a class and sign at most
    read = {f: f"x{f}" for f in sorted({int(model.feat[i % len(model.feat)]) for i in used})}

    def run(batches):
        import pyarrow as pa

        fields, used, lists = shared.value
        model = ClauseModel(**fields)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {f: batch.column(c).to_numpy(zero_copy_only=False) for f, c in read.items()}
            votes = np.ascontiguousarray(model.votes_by_literals(x, batch.num_rows, used, lists))
            flat = pa.ListArray.from_arrays(np.arange(0, votes.size + 1, model.classes, dtype=np.int32), pa.array(votes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), flat, pa.array(votes.argmax(axis=1).astype(np.int32))], [key, "votes", "pred"])

    # doubles keep their digits: a value is compared with the float threshold as Spark compares them
    values = [F.col(columns[f]).cast("float" if df.schema[columns[f]].dataType.simpleString() == "float" else "double").alias(c) for f, c in read.items()]
    return df.select(F.col(key).alias("key"), *values).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, votes array<long>, pred int")


def votes_sparse(df: DataFrame, columns: list[str], model: ClauseModel, key: str = "row_id") -> DataFrame:
    """key, class, votes by ``scored_sparse``."""
    return scored_sparse(df, columns, model, key).select(key, F.posexplode("votes").alias("class", "votes"))


def predict_sparse(df: DataFrame, columns: list[str], model: ClauseModel, key: str = "row_id") -> DataFrame:
    """key, pred by ``scored_sparse``."""
    return scored_sparse(df, columns, model, key).select(key, "pred")


def class_sums(df: DataFrame, columns: list[str], model: ClauseModel, key: str = "row_id") -> DataFrame:
    """key, v0, v1, ...: the votes of each class by one expression a class, for small models; a map-only plan in the JVM."""
    signed = lambda v: F.lit(int(np.uint64(v).view(np.int64))).cast("long")
    words = [F.col(f"w{i}") for i in range(model.words)]
    sums = []
    for k in range(model.classes):
        terms = [F.lit(int(model.sign[i])) * F.greatest(F.lit(int(model.clamp[i])) - B.mismatches_xor(words, [signed(v) for v in model.pos[i]], [signed(v) for v in model.pos[i] ^ model.neg[i]]), F.lit(0)) for i in np.flatnonzero(model.cls == k)] or [F.lit(0)]
        while len(terms) > 1:
            terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
        sums.append(terms[0].cast("long").alias(f"v{k}"))
    # a lambda keeps this projection out of whole-stage code, whose one method for all clauses would be too large to compile
    apart = F.size(F.filter(F.array(key), lambda x: x.isNotNull())).alias("_apart")
    return packed(df, columns, model).select(key, *sums, apart)


def votes_expression(df: DataFrame, columns: list[str], model: ClauseModel, key: str = "row_id") -> DataFrame:
    """key, class, votes by ``class_sums``."""
    return class_sums(df, columns, model, key).where("_apart >= 0").select(key, F.posexplode(F.array(*[F.col(f"v{k}") for k in range(model.classes)])).alias("class", "votes"))


def first_most(names: list[str]) -> Column:
    """Place of the largest of some columns, the first on ties."""
    best = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    out = F.lit(len(names) - 1)
    for i in range(len(names) - 2, -1, -1):
        out = F.when(F.col(names[i]) == best, F.lit(i)).otherwise(out)
    return out.cast("int")


def predict_expression(df: DataFrame, columns: list[str], model: ClauseModel, key: str = "row_id") -> DataFrame:
    """key, pred by ``class_sums``, without a shuffle."""
    return class_sums(df, columns, model, key).select(key, F.when(F.col("_apart") >= 0, first_most([f"v{k}" for k in range(model.classes)])).alias("pred"))


def predict_relational(df: DataFrame, columns: list[str], model: ClauseModel, key: str = "row_id") -> DataFrame:
    """key, pred by one grouped sum over the clause table: a column of votes for each class, and the narrow rows are shuffled before they meet the clauses, so that is the only shuffle."""
    out = with_clauses(packed_batches(df, columns, model, (key,)).repartition(key), model).withColumn("out", F.col("sign") * F.greatest(F.col("clamp") - mismatch(model), F.lit(0)))
    sums = [F.sum(F.when(F.col("class") == k, F.col("out")).otherwise(0)).alias(f"v{k}") for k in range(model.classes)]
    return out.groupBy(key).agg(*sums).select(key, first_most([f"v{k}" for k in range(model.classes)]).alias("pred"))


def decoded(model: ClauseModel, spark: SparkSession) -> DataFrame:
    """class, sign, clause, text of each clause; a bit's condition before its negation, bits in order; thresholds to four digits."""
    names = F.create_map(*[v for i in range(len(model.feat)) for v in (F.lit(i), F.lit(model.feature_names[i] if i < len(model.feature_names) else f"bit_{i}"))]) if len(model.feat) else None
    literals = model.literal_table(spark).join(F.broadcast(model.threshold_table(spark)), "bit")
    part = F.concat(F.when(F.col("negated"), "NOT (").otherwise("("), names[F.col("bit")], F.lit(" >= "), F.col("told"), F.lit(")"))
    told = literals.groupBy("class", "sign", "clause").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bit", "negated", part.alias("t")))), lambda s: s["t"]), " AND ").alias("t"))
    every = model.clause_table(spark).select("class", "sign", "clause", "clamp")
    return every.join(told, ["class", "sign", "clause"], "left").select("class", "sign", "clause", F.concat(F.lit("[clamp="), "clamp", F.lit("] "), F.coalesce("t", F.lit(""))).alias("text"))
