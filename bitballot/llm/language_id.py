"""Operator 2: language spans by script ranges and a Viterbi pass over per-word scores.

``fit`` learns hashed n-gram log-likelihoods and the scripts of each language from a bounded sample
of labelled rows (``per_language`` whole rows are expected; fitting alone is bounded,
every text is labelled whole).  A word's script ranges narrow the candidates; its score for each of them
is the sum over its n-grams; a Viterbi pass with a penalty for each switch labels spans of words.  A text
in which no other language can repay a switch is decided without the pass, with the same result.  A long text is
scored in pieces of words, its Viterbi state carried from piece to piece, so scores are held for one piece at a time.

Cases: a null text or one without a letter is ``und`` with score 0; ties go to the first language by
name; without any labelled row every text is ``und``; repeated rows are labelled each; an empty table
gives an empty result; columns other than doc_id and text (and lang when fitting) are not read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitballot.llm._common import map_texts

BITS = 16
#: Code points scored at once; words are whole.
PIECE = 1 << 17
#: First and last code point of common scripts' main blocks.
SCRIPTS = {"latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)), "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "cyrillic": ((0x400, 0x52F),), "armenian": ((0x530, 0x58F),), "hebrew": ((0x590, 0x5FF),), "arabic": ((0x600, 0x6FF), (0x750, 0x77F)), "devanagari": ((0x900, 0x97F),), "thai": ((0xE00, 0xE7F),), "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)), "kana": ((0x3040, 0x30FF),), "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF))}
OTHER = len(SCRIPTS)


def held_out(doc_id, modulus: int, rest: int):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


class Grams:
    """Words (runs of letters) of texts and their hashed n-grams, all texts of a slice at once."""

    def __init__(self):
        self.codes = np.full(0x110000 >> 8, -1, np.int16)
        letter = np.zeros(0x110000, bool)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                letter[c] = True
        script = np.full(0x110000, OTHER, np.int8)
        for i, ranges in enumerate(SCRIPTS.values()):
            for a, b in ranges:
                script[a : b + 1] = i
        self.letter, self.script = letter, script

    def __call__(self, texts):
        """Row, first code and end of each word in one array of code points (lower-cased, spaced apart)."""
        parts = [(t or "").lower() for t in texts]
        codes = np.frombuffer((" " + " ".join(parts) + " ").encode("utf-32-le"), np.uint32)
        inside = self.letter[codes]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        st, en = edge[::2], edge[1::2]
        starts = 1 + np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        return codes, np.searchsorted(starts, st, "right") - 1, st, en

    def hashes(self, codes, st, en):
        """Arrays of table indexes by position: code i starts one of 2 and one of 3 codes; other marks read as spaces."""
        c = np.where(self.letter[codes], codes, 32).astype(np.uint32)
        c = np.concatenate([c, [32, 32]]).astype(np.uint32)
        two = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77)
        three = two * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
        return (two >> np.uint32(32 - BITS)) & np.uint32((1 << BITS) - 1), three >> np.uint32(32 - BITS)


def fit(docs: DataFrame, per_language: int = 400):
    """Languages, their n-gram tables and scripts from rows (doc_id, text, lang) that the caller allows for training."""
    known = docs.where("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # one number per language
    languages = sorted(counts)
    tables = np.zeros((2, 1 << BITS, max(1, len(languages))), np.float32)
    scripts = np.zeros((OTHER + 1, max(1, len(languages))), bool)
    if languages:
        share = F.create_map(*chain(*((F.lit(k), F.lit(min(1.0, per_language / n))) for k, n in counts.items())))
        chance = F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        sample = known.where(chance < share[F.col("lang")]).select("doc_id", "lang", "text").limit(2 * per_language * len(languages))
        rows = sorted(sample.collect(), key=lambda r: (r.doc_id, r.lang, r.text))
        grams, seen = Grams(), np.zeros((OTHER + 1, len(languages)))
        for at in range(0, len(rows), 64):
            part = rows[at : at + 64]
            codes, row, st, en = grams([r.text for r in part])
            if not len(st):
                continue
            lang = np.array([languages.index(r.lang) for r in part])[row]
            two, three = grams.hashes(codes, st, en)
            np.add.at(seen, (grams.script[codes[st]], lang), 1)
            word = np.repeat(np.arange(len(st)), en - st + 1)
            at_code = np.arange(len(word)) - np.repeat(np.cumsum(en - st + 1) - (en - st + 1), en - st + 1) + np.repeat(st - 1, en - st + 1)
            for k, h in enumerate((two, three)):
                ok = at_code + 2 + k <= en[word] + 1
                np.add.at(tables[k], (h[at_code[ok]], lang[word[ok]]), 1)
        tables = np.log((tables + 0.5) / (tables.sum(axis=1, keepdims=True) + 0.5 * (1 << BITS))).astype(np.float32)
        scripts = seen >= 0.01 * np.maximum(1, seen.sum(axis=0))
    return {"languages": languages, "tables": tables, "scripts": scripts}


def viterbi(scores, penalty: float):
    """Best label of each word: the sum of scores less ``penalty`` for each switch; exact."""
    return best_path(lambda: [scores], penalty)


def few_labels(s, v: list[float], penalty: float):
    """Moves v over the rows of s: a byte of labels that stay, and the best label before, for each row.  Plain lists are the faster form here."""
    labels, kept, tops = range(len(v)), [], []
    for row in s.tolist():
        best = max(v)
        least, mask = best - penalty, 0
        tops.append(v.index(best))
        for k in labels:
            if v[k] >= least:
                mask |= 128 >> k
                v[k] += row[k]
            else:
                v[k] = least + row[k]
        kept.append(mask)
    return np.array(kept, np.uint8)[:, None], tops


def many_labels(s, v: list[float], penalty: float):
    """As ``few_labels``, for any number of labels."""
    now, kept, tops = np.array(v), np.empty(s.shape, bool), np.empty(len(s), np.int32)
    for i, row in enumerate(s):
        tops[i] = np.argmax(now)
        least = now[tops[i]] - penalty
        kept[i] = now >= least
        now = np.maximum(now, least) + row
    v[:] = now.tolist()
    return np.packbits(kept, axis=1), tops


def best_path(pieces, penalty: float):
    """``viterbi`` over the concatenated ``pieces()`` of scores, which are made anew for each pass over them."""
    total, n = 0.0, 0
    for s in pieces():
        total, n = total + s.sum(axis=0), n + len(s)
    best = int(np.argmax(total))
    m = len(total)
    reached, low, most = np.zeros(m), np.zeros(m), 0.0
    for s in pieces():
        gain = reached + np.cumsum(s - s[:, [best]], axis=0)
        floor = np.minimum.accumulate(np.vstack([low, np.minimum(low, reached), gain[:-1]]), axis=0)[1:]
        most = max(most, (gain - floor).max(initial=0))
        reached, low = gain[-1], np.minimum(floor[-1], gain[-1])
    if most <= penalty / 2:  # m stretches away gain at most m * penalty / 2 and cost (m - 1) * penalty at least
        return np.full(n, best)
    # a word's best path comes from the same label or from the best of all: one bit a label and one number a word
    stay, tops, v, t = np.zeros((n, (m + 7) // 8), np.uint8), np.zeros(n, np.int32), [0.0] * m, 0
    for s in pieces():
        kept, top = (few_labels if m <= 8 else many_labels)(s, v, penalty)
        stay[t : t + len(s)], tops[t : t + len(s)] = kept, top
        t += len(s)
    path = np.empty(n, np.int64)
    k = int(np.argmax(v))
    for t in range(n - 1, -1, -1):
        path[t] = k
        if not stay[t, k >> 3] >> (7 - (k & 7)) & 1:
            k = tops[t]
    return path


class Labeller:
    def __init__(self, model, penalty: float):
        self.languages, self.tables, self.penalty, self.grams = model["languages"], model["tables"], penalty, Grams()
        self.barred = np.where(model["scripts"] | ~model["scripts"].any(axis=1, keepdims=True), 0.0, -1e4)

    def scores(self, codes, st, en):
        """A row of scores for each of some words in a row, by language."""
        a = st[0] - 1
        codes, st, en = codes[a : en[-1] + 1], st - a, en - a
        two, three = self.grams.hashes(codes, st, en)
        scores = self.barred[self.grams.script[codes[st]]]
        zero = np.zeros((1, len(self.languages)))
        total = np.vstack([zero, np.cumsum(self.tables[0][two], axis=0, dtype=np.float64)])
        scores = scores + total[en] - total[st - 1]  # pairs from the space before the word to the space after it
        total = np.vstack([zero, np.cumsum(self.tables[1][three], axis=0, dtype=np.float64)])
        return scores + total[np.maximum(en - 1, st)] - total[st - 1]

    def pieces(self, codes, st, en):
        at = 0
        while at < len(st):
            end = max(at + 1, int(np.searchsorted(en, st[at] + PIECE, "right")))
            yield self.scores(codes, st[at:end], en[at:end])
            at = end

    def spans(self, texts):
        """For each text its words' lengths and labels."""
        codes, row, st, en = self.grams(texts)
        if not self.languages or not len(st):
            return [(np.zeros(0, int), np.zeros(0, int))] * len(texts)
        bounds, out = np.searchsorted(row, np.arange(len(texts) + 1)), []
        scores = self.scores(codes, st, en) if len(codes) <= 2 * PIECE else None  # a longer slice is one text
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                path = np.zeros(0, int)
            elif scores is not None:
                path = viterbi(scores[a:b], self.penalty)
            else:
                path = best_path(lambda a=a, b=b: self.pieces(codes, st[a:b], en[a:b]), self.penalty)
            out.append(((en - st)[a:b], path))
        return out


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_spans long"


def label(docs: DataFrame, model, penalty: float = 24.0, held=None) -> DataFrame:
    """One row per row of ``docs``: the language of most letters, its share of the letters, the number of spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BITS and the number of languages

    def start():
        import pyarrow as pa

        labeller = Labeller(shared.value, penalty)
        names = labeller.languages

        def work(part):
            pred, score, spans = [], [], []
            for size, path in labeller.spans(part.column("text").to_pylist()):
                if len(path):
                    weight = np.bincount(path, size, len(names))
                    best = int(np.argmax(weight))
                    pred.append(names[best]), score.append(float(weight[best] / weight.sum())), spans.append(1 + int((path[1:] != path[:-1]).sum()))
                else:
                    pred.append("und"), score.append(0.0), spans.append(0)
            return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.int64())], ["doc_id", "held_out", "lang_pred", "score", "n_spans"])

        return work

    held = F.lit(False) if held is None else held
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, start, SCHEMA)
