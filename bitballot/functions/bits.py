"""Column expressions on bits: 64-bit words with the lowest bit first, bytes with the highest first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_least(x: Column, t: Column) -> Column:
    """x >= t as IEEE has it: NaN and null give false (Spark orders NaN above all numbers)."""
    return F.coalesce(~F.isnan(x) & (x >= t), F.lit(False))


def above(x: Column, t: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (x > t), F.lit(False))


def words(bits: list[Column]) -> list[Column]:
    """BIGINT words of Boolean columns; bit i of a word is column 64 * word + i."""
    out = []
    for at in range(0, len(bits), 64):
        parts = [F.when(b, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i, b in enumerate(bits[at : at + 64])]
        while len(parts) > 1:  # a balanced tree of ORs keeps the expression shallow
            parts = [parts[i].bitwiseOR(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        out.append(parts[0])
    return out


def get(word: Column, i: int) -> Column:
    return F.shiftrightunsigned(word, i).bitwiseAND(F.lit(1)).cast("int")


def put(word: Column, i: int, on: bool) -> Column:
    mask = F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")
    return word.bitwiseOR(mask) if on else word.bitwiseAND(F.bitwise_not(mask))


def mismatches(words_: list[Column], pos: list[Column], neg: list[Column]) -> Column:
    """Literals of a clause that the bits contradict."""
    out = F.lit(0)
    for w, p, n in zip(words_, pos, neg):
        out = out + F.bit_count(p.bitwiseAND(F.bitwise_not(w))) + F.bit_count(n.bitwiseAND(w))
    return out


def mismatches_xor(words_: list[Column], lits: list[Column], xor: list[Column]) -> Column:
    """The same with one count a word: lits = pos, xor = pos ^ neg."""
    out = F.lit(0)
    for w, p, x in zip(words_, lits, xor):
        out = out + F.bit_count(p.bitwiseXOR(x.bitwiseAND(w)))
    return out


def indexes(words_: Column, n: int) -> Column:
    """Array of the set bits below n of an array of words."""
    return F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(F.element_at(words_, (i / 64).cast("int") + 1), i % 64) == 1)


def booleanize(columns: list[Column], thresholds: list[float]) -> list[Column]:
    """Every column strictly above every threshold, all columns for the first threshold first."""
    return [above(c, F.lit(t).cast("float")) for t in thresholds for c in columns]


def packed_bytes(bits: list[Column]) -> Column:
    """A binary column of Boolean columns, eight a byte, the first the highest bit; zeros fill the last byte."""
    filled = [*bits, *[F.lit(False)] * (-len(bits) % 8)]
    told = [F.concat(*[b.cast("int").cast("string") for b in filled[i : i + 8]]) for i in range(0, len(filled), 8)]
    return F.unhex(F.concat(*[F.lpad(F.conv(t, 2, 16), 2, "0") for t in told]))


def words_of_bytes(data: Column, n: int) -> list[Column]:
    """n BIGINT words of a binary column, the lowest byte of each first; zeros beyond its end."""
    digits = F.rpad(F.hex(data), 16 * n, "0")
    out = []
    for i in range(n):
        highest_first = F.concat(*[F.substring(digits, 16 * i + 2 * j + 1, 2) for j in range(7, -1, -1)])
        high, low = (F.conv(F.substring(highest_first, at, 8), 16, 10).cast("long") for at in (1, 9))
        out.append(F.shiftleft(high, 32).bitwiseOR(low))
    return out
