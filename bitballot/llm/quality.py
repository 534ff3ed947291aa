"""Operator 5: quality by supervised subword embeddings.

Words and character n-grams (of bytes) are hashed to rows of a table of learned vectors; a document is the
mean of its vectors; a softmax layer gives the labels' probabilities; all is trained by numpy stochastic
gradient descent on a bounded sample of labelled rows (``rows`` whole rows are expected, twice as many at most).
Since the output is linear in the mean, scoring looks up each vector's product with the output layer.

Cases: a null or empty text has no vector and gets the prior of the output layer; without any labelled row
every score is 0.5; repeated rows are scored each; an empty table gives an empty result; texts are read whole;
columns other than doc_id and text (and quality when fitting) are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitballot.llm._common import give_back, map_texts
from bitballot.llm._words import Words, mix, utf8

BITS = 17
#: Steps of the descent, in whole passes over the sample, and the first step's rate, which falls to 0.
STEPS, RATE = 8000, 1.0


class Features:
    """Hashed features of a slice of texts: every 3 and 4 consecutive bytes, every word, and of every pair of words whether they are the same."""

    def __init__(self):
        self.words = Words()

    def __call__(self, raw, off):
        """Pairs of a feature array and the bounds of each row in it."""
        shift = np.uint32(32 - BITS)
        b = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.uint32)
        n = len(raw)
        three = b[:n] | b[1 : n + 1] << np.uint32(8) | b[2 : n + 2] << np.uint32(16)
        four = three | b[3 : n + 3] << np.uint32(24)
        for grams, k in ((three * np.uint32(0x9E3779B1), 3), (four * np.uint32(0x85EBCA6B) ^ (four >> np.uint32(15)), 4)):
            yield grams >> shift, off[:-1], np.maximum(off[1:] - k + 1, off[:-1])
        row, _, _, h = self.words(raw, off)
        bounds = np.searchsorted(row, np.arange(len(off)))
        yield (h >> np.uint64(64 - BITS)).astype(np.int64), bounds[:-1], bounds[1:]
        # of each pair of words only whether both are the same, which holds for any vocabulary
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        repeat = np.where(again, int(mix(np.array([3], np.uint64))[0] >> np.uint64(64 - BITS)), int(mix(np.array([4], np.uint64))[0] >> np.uint64(64 - BITS)))
        yield repeat, bounds[:-1], bounds[1:]


def fit(docs: DataFrame, rows: int = 2000, dim: int = 8, steps: int = STEPS, rate: float = RATE):
    """Vectors, output layer and bias from (doc_id, text, quality) rows that the caller allows for training."""
    known = docs.where("quality in (0, 1) and text is not null")
    count = known.count()
    share = min(1.0, rows / count) if count else 1.0
    chance = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = known.where(chance < share).select("doc_id", "quality", "text").limit(2 * rows).collect()
    model = train([(r.text, int(r.quality)) for r in sorted(sample, key=lambda r: (r.doc_id, r.quality, r.text))], dim, steps, rate)
    del sample
    give_back(docs.sparkSession)
    return model


def train(labelled: list[tuple[str, int]], dim: int = 8, steps: int = STEPS, rate: float = RATE):
    import pyarrow as pa

    rng = np.random.RandomState(11)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float64)
    out, bias = np.zeros((2, dim)), np.zeros(2)
    if not labelled:
        return {"vectors": vectors, "out": out, "bias": bias}
    # numbers and counts of the features in two buffers, counts in as few bytes as a text's largest needs: as arrays for
    # each text they would take three times as much and fragment the driver's memory, which is then not given back
    features, bags, flat, counts = Features(), [], bytearray(), bytearray()
    for text, _ in labelled:
        ids, n = np.unique(np.concatenate([f[a[0] : b[0]].astype(np.int32) for f, a, b in features(*utf8(pa.array([text])))]), return_counts=True)
        n = n.astype(np.min_scalar_type(n.max(initial=0)))
        bags.append((len(ids), len(flat), n.dtype, len(counts)))
        flat += ids.tobytes()
        counts += n.tobytes()
    y = np.array([q for _, q in labelled])
    passes = -(-steps // len(bags))
    steps, done = passes * len(bags), 0
    for _ in range(passes):
        for i in rng.permutation(len(bags)):
            size, at, kind, first = bags[i]
            ids, n = np.frombuffer(flat, np.int32, size, at), np.frombuffer(counts, kind, size, first)
            total = int(n.sum())
            hidden = n @ vectors[ids] / total if total else np.zeros(dim)
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            step = rate * (1 - done / steps)
            done += 1
            if total:
                vectors[ids] -= step * np.outer(n / total, p @ out)
            out -= step * np.outer(p, hidden)
            bias -= 0.1 * step * p
    return {"vectors": vectors, "out": out, "bias": bias}


class Scorer:
    def __init__(self, model):
        self.features = Features()
        self.weight = model["vectors"] @ (model["out"][1] - model["out"][0])
        self.bias = float(model["bias"][1] - model["bias"][0])

    def __call__(self, column):
        raw, off = utf8(column)
        total, count = np.zeros(len(column)), np.zeros(len(column))
        for ids, a, b in self.features(raw, off):
            run = np.concatenate([[0.0], np.cumsum(self.weight[ids])])
            total += run[b] - run[a]
            count += b - a
        logit = total / np.maximum(1, count) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model, held=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: probability of label 1 and whether it reaches 0.5; ``keep`` names columns to hand through."""
    shared = docs.sparkSession.sparkContext.broadcast({"vectors": model["vectors"].astype(np.float32), "out": model["out"], "bias": model["bias"]})  # bounded by BITS

    def start():
        import pyarrow as pa

        scorer = Scorer(shared.value)

        def work(part):
            s = scorer(part.column("text"))
            return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return work

    held = F.lit(False) if held is None else held
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, start, SCHEMA)


def accepted(docs: DataFrame, model) -> DataFrame:
    """The rows of ``docs``, all columns, whose text reaches 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast({"vectors": model["vectors"].astype(np.float32), "out": model["out"], "bias": model["bias"]})

    def start():
        import pyarrow as pa

        scorer = Scorer(shared.value)
        return lambda part: part.filter(pa.array(scorer(part.column("text")) >= 0.5))

    return map_texts(docs, start, docs.schema)
