"""Operator 3: token counts by the whole-token shortcut.

``prove_whole_tokens`` finds offline, from the vocabulary itself, which strings are one pre-token and
encode alone as one token.  Counting then splits a text into pre-tokens; those strings count one each
without a merge, and only the rest go through the library's merges.  ``unlike`` finds offline, code point by code
point, where our pattern could split otherwise than the library.

Cases: a null text is empty and has no tokens; special strings inside a text count as the library
counts them by default (one token each); texts of any length are counted whole; code points that were not
proven to be split as the library splits them (a few thousand recent ones, and those from U+30000 on) send the text to
the library as it is; repeated rows are counted each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitballot.llm._common import map_texts

#: Pre-tokens that are remembered in a worker; beyond it the memory starts anew.
MEMO = 800_000
#: Scripts whose classes are written out for the faster standard module; other texts are split by the pattern itself.
PLAIN = r"[^\x00-ɏͰ-ϿЀ-ҁҊ-ԯ‐-‧‰-⁞€]"


def byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 stands for itself, the rest for 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def prove_whole_tokens(vocabulary: str, pattern: str) -> list[str]:
    """The strings of the vocabulary that are a single pre-token and encode alone as a single token."""
    import regex
    from tokenizers import Tokenizer

    library, of = Tokenizer.from_str(vocabulary), byte_chars()
    special = {t["content"] for t in json.loads(vocabulary).get("added_tokens", [])}
    texts = []
    for token in json.loads(vocabulary)["model"]["vocab"]:
        try:
            texts.append(bytes(of[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    texts = [t for t in texts if t not in special and regex.fullmatch(pattern, t) and regex.match(pattern, t)[0] == t]
    found = library.encode_batch(texts, add_special_tokens=False)
    return [t for t, e in zip(texts, found) if len(e.ids) == 1]


def unlike(vocabulary: str, pattern: str, end: int = 0x30000) -> str:
    """A class of the code points that the library and ``pattern`` do not split alike after a letter, a number, a mark and a space, and of those from ``end`` on."""
    import regex
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_str(vocabulary).pre_tokenizer, regex.compile(pattern)
    out, at = [], None
    for c in range(end + 1):
        same = c == end or 0xD800 <= c < 0xE000
        if not same:
            s = f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}"
            same = own.findall(s) == [s[a:b] for _, (a, b) in library.pre_tokenize_str(s)]
        if same and at is not None:
            out.append(f"\\U{at:08x}-\\U{c - 1:08x}")
            at = None
        elif not same and at is None:
            at = c
    return f"[{''.join(out)}\\U{end:08x}-\\U0010ffff]"


def spelt(pattern: str) -> str:
    """The vocabulary files' pattern with its classes written out for the scripts in PLAIN, for the faster standard module.

    Another pattern stays as it is.
    """
    import regex

    if pattern != split_pattern():
        return ""

    def members(name: str, end: int) -> str:
        out, at = [], 0
        for c in range(end + 1):
            if c == end or not regex.match(name, chr(c)):
                if c > at:
                    out.append(f"\\u{at:04x}-\\u{c - 1:04x}")
                at = c + 1
        return "".join(out)

    letters, numbers, spaces = members(r"\p{L}", 0x530), members(r"\p{N}", 0x530), members(r"\s", 0x3001)
    return f"'(?:[stmd]|re|ve|ll)| ?(?:[{letters}]++|[{numbers}]++|[^{spaces}{letters}{numbers}]++)|[{spaces}]+(?![^{spaces}])|[{spaces}]+"


class Counter:
    """Counts the tokens of a list of texts."""

    def __init__(self, vocabulary: str, whole: list[str], pattern: str, odd: str):
        import os
        import re

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(vocabulary)
        self.merges = Tokenizer.from_str(vocabulary)
        self.merges.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.any_script = regex.compile(pattern).findall
        self.pieces = re.compile(fast).findall if (fast := spelt(pattern)) else self.any_script
        self.beyond, self.odd = re.compile(PLAIN).search, re.compile(odd).search
        special = [t["content"] for t in json.loads(vocabulary).get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.whole = dict.fromkeys(whole, 1)
        self.memo = dict(self.whole)

    def __call__(self, texts: list[str | None]) -> list[int]:
        fixed, split = [0] * len(texts), []
        for i, text in enumerate(texts):
            if not text:
                split.append([])
                continue
            beyond = self.beyond(text)
            if beyond and self.odd(text):
                fixed[i] = len(self.library.encode(text, add_special_tokens=False).ids)
                split.append([])
                continue
            pieces = self.any_script if beyond else self.pieces
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                fixed[i] = len(parts) - 1
                split.append([p for part in parts for p in pieces(part)])
            else:
                split.append(pieces(text))
        if len(self.memo) > len(self.whole) + MEMO:
            self.memo = dict(self.whole)
        new = list(set().union(*split).difference(self.memo))
        self.memo.update(zip(new, (len(e.ids) for e in self.merges.encode_batch(new, add_special_tokens=False))))
        of = self.memo.__getitem__
        return [n + sum(map(of, p)) for n, p in zip(fixed, split)]


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 512, pattern: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    pattern = pattern or split_pattern()
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    shared = spark.sparkContext.broadcast((vocabulary, prove_whole_tokens(vocabulary, pattern), pattern, unlike(vocabulary, pattern)))  # bounded by the vocabulary

    def start():
        import pyarrow as pa
        import pyarrow.compute as pc

        count = Counter(*shared.value)

        def work(part):
            text = part.column("text")
            n = count(text.to_pylist())
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            return pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, start, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", 1 << 20)
