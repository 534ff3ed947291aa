"""Vectorised words and shingles over the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

import numpy as np

#: Bytes handled at once; a single word may be longer.
PIECE = 1 << 17
SPACES = b" \t\n\v\f\r"


def mix(h):
    """Finaliser of a 64-bit hash; unsigned arithmetic wraps."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column):
    """Bytes and offsets of an Arrow string array, nulls as empty texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch, column: str, limit: int = PIECE):
    """Cuts a record batch into slices of about ``limit`` bytes of text, one row at least."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


class Words:
    """Hashes of the words of texts: maximal runs of bytes outside ``separators``."""

    def __init__(self, separators: bytes = SPACES, seed: int = 7):
        rng = np.random.RandomState(seed)
        self.codes = rng.randint(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        for c in range(ord("A"), ord("Z") + 1):
            self.codes[c] = self.codes[c + 32]
        self.inside = np.ones(256, bool)
        self.inside[list(separators)] = False
        self.base = (0x9E3779B97F4A7C15 & ~7) | 5  # of the highest multiplicative order
        self.pw = self.ipw = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.pw) < n:
            with np.errstate(over="ignore"):
                self.pw, self.ipw = (self._series(b, n) for b in (self.base, pow(self.base, -1, 1 << 64)))

    @staticmethod
    def _series(base: int, n: int):
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors)

    def _piece(self, b, doc_starts):
        """Starts, ends and hashes of the words of one piece; a word never crosses ``doc_starts``."""
        inside = self.inside[b]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        before[doc_starts] = False
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        after[doc_starts[doc_starts > 0] - 1] = False
        st, en = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self._powers(len(b))
        with np.errstate(over="ignore"):
            total = np.empty(len(b) + 1, np.uint64)
            total[0] = 0
            np.cumsum(self.codes[b] * self.pw[: len(b)], out=total[1:])
            h = mix((total[en] - total[st]) * self.ipw[st] + (en - st).astype(np.uint64))
        return st, en, h

    def __call__(self, raw, off):
        """Row index, start, end and hash of each word, in order."""
        parts, at, n = [], 0, len(raw)
        while at < n:
            end = min(n, at + PIECE)
            if end < n:  # end a piece where a document or a separator is
                k = np.searchsorted(off, end, "right") - 1
                if off[k] > at:
                    end = int(off[k])
                else:
                    last = int(off[k + 1])
                    gap = np.flatnonzero(~self.inside[raw[end - 1 : last]])
                    back = np.flatnonzero(~self.inside[raw[at:end]])
                    end = at + int(back[-1]) + 1 if len(back) else end + int(gap[0]) if len(gap) else last
            lo, hi = np.searchsorted(off, at, "left"), np.searchsorted(off, end, "left")
            st, en, h = self._piece(raw[at:end], off[lo:hi] - at)
            parts.append((st + at, en + at, h))
            at = end
        st, en, h = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        return np.searchsorted(off, st, "right") - 1, st, en, h


def shingles(row, h, rows: int, k: int):
    """Yields for each row its sorted distinct hashes of k consecutive words; fewer words count as one sequence."""
    coef = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    bounds = np.searchsorted(row, np.arange(rows + 1))
    with np.errstate(over="ignore"):
        n = max(0, len(h) - k + 1)
        s = np.zeros(n, np.uint64)
        for j in range(k if n else 0):
            s += h[j : j + n] * coef[j]
        s = mix(s)
        for i in range(rows):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= k:
                x = np.sort(s[a : b - k + 1])
                yield x[np.concatenate([[True], x[1:] != x[:-1]])]
            elif b > a:
                yield mix(np.array([(h[a:b] * coef[: b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
