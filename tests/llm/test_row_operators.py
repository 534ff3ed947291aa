"""Token counts, personal data, licences, languages and quality against plain forms."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bitballot.llm import language_id, licenses, pii, quality, token_counts
from bitballot.llm._words import Words, shingles, utf8

ODD = [None, "", " ", "\n", "Hello, world", "Hello, world", "a" * 50_000, "the cat " * 5000, "日本語 text ١٢٣ Ⅷ", "é \x1c\x85  end  ", "<|endoftext|> it's <|endoftext|>", "\U0001f600" * 40]


def frame(spark, texts, **more):
    return spark.createDataFrame([(i, t, "clash", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score double")


def test_words_and_shingles():
    texts = [*ODD, "x" * 300_000, "b c " * 60_000, "A b\tC\x0bd e"]
    row, st, en, h = Words()(*utf8(pa.array(texts)))
    for i, t in enumerate(texts):
        want = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        assert len(want) == (row == i).sum() and len(set(want)) == len({*h[row == i].tolist()})
    for s, t in zip(shingles(row, h, len(texts), 4), texts):
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        assert len(s) == len({tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())) and (np.diff(s.astype(object)) > 0).all()


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = token_counts.count_tokens(frame(spark, ODD), path).orderBy("doc_id").collect()
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in ODD]
    assert [r.n_tokens for r in got] == want and [r.n_bytes for r in got] == [len((t or "").encode()) for t in ODD] and [r.over_limit for r in got] == [n > 512 for n in want]
    assert token_counts.count_tokens(frame(spark, []), path).count() == 0


def test_classes_of_plain_scripts():
    """On every code point that is not left to the library, its pre-tokens are those of our pattern."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer
    fast, odd = re.compile(token_counts.spelt(public_tokenizers.PATTERN)), re.compile(token_counts.PLAIN)
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x2FFFF)]):
        if not odd.search(c):
            for s in (f"a{c}1", f" {c} {c}", f"!{c}!", f"'{c}s't"):
                assert fast.findall(s) == [s[a:b] for _, (a, b) in library.pre_tokenize_str(s)], repr(c)


def plain_pii(text):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k in pii.BASE for n, m in out if n == k]


PRIVATE = ["é mail a.b+c@x-y.co.uk, @a.b a@b a@@b.c x@y.z@w.v", "1.2.3.4 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 1..2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 or 41111111111111111", "+1 (619) 555-0053 +49.30.1234567. +1 +12 3456", "9" * 4000, "1." * 2000, "a@" * 500 + "b.c", "x" * 20_000 + "@b.c", "+1 " + " " * 5000, "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, DE89370400440532013001", "ssn 078-05-1120, id 078-05-1120-9"]


def test_pii(spark):
    texts = [*ODD, *PRIVATE]
    got = pii.scan(frame(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        want = plain_pii(t or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w.startswith(k + ":") for w in want) for k in pii.BASE)
        assert set(want) <= set(r.spans.split(",")) or not want
    assert got[-2].spans.count("iban") == 2 and "ssn" in got[-1].spans
    assert pii.scan(frame(spark, [])).count() == 0


def test_licences(spark, tmp_path):
    notice = licenses.TEMPLATES["MIT-grant"]
    texts = [*ODD, "Foo.\nLicensed under CC BY-NC 4.0.\nbar", "prose " * 300 + "\n" + "Released under the MIT license", notice.replace(", ", ",\n"), "Licensed under nothing at all.", "Title\n\nprose here.\n\n" + licenses.TEMPLATES["MIT-text"] + "\n\nmore prose", "Copyright\n\n" + licenses.TEMPLATES["BSD-3-Clause-text"]]
    got = licenses.scan(frame(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        best = max((plain_dice(u, w) for u in plain_units(t or "") for w in licenses.TEMPLATES.values()), default=0.0)
        assert (r.license is not None) == (best >= 0.8) and abs(r.dice - (best if best >= 0.8 else 0.0)) < 1e-12, t
    assert [r.license for r in got[-6:]] == ["CC-BY-NC-4.0", "MIT", "MIT-grant", None, "MIT-text", "BSD-3-Clause-text"]
    assert {r.license for r in licenses.scan(frame(spark, texts), templates={}).collect()} == {None}
    assert licenses.scan(frame(spark, [])).count() == 0
    for name in ("MIT-text", "Zlib-text"):
        (tmp_path / f"{name}.txt").write_text(licenses.TEMPLATES[name])
    own = licenses.read_templates(spark, str(tmp_path))
    assert own == {n: licenses.TEMPLATES[n] for n in ("MIT-text", "Zlib-text")}
    assert [r.license for r in licenses.scan(frame(spark, texts[-2:]), templates=own).orderBy("doc_id").collect()] == ["MIT-text", None]


def plain_dice(a, b):
    """Of the word bigrams of two texts, by lists alone."""
    words = lambda t: re.findall(r"[^\W_]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    x, y = (list(zip(w, w[1:])) for w in (words(a), words(b)))
    both = sum(min(x.count(g), y.count(g)) for g in set(x) & set(y))
    return 2 * both / (len(x) + len(y)) if x and y else 0.0


def plain_units(text):
    """Lines, runs of one to five paragraphs, and the text, each once."""
    out = set(text.split("\n")) | {text}
    found = [p for p in re.split(r"\n\s*\n", text) if p.strip()]
    return out | {"\n".join(found[i : i + n]) for n in range(1, 7) for i in range(len(found) - n + 1)}


def test_viterbi_is_exact():
    rng = np.random.RandomState(2)
    for n in (1, 2, 7, 40):
        for _ in range(40):
            s = rng.randn(n, 3) * rng.choice([0.2, 1, 4])
            path = language_id.viterbi(s, 3.0)
            total = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:]))
            v = s[0].copy()
            for i in range(1, n):
                v = s[i] + np.maximum(v, v.max() - 3.0)
            assert abs(total(path.tolist()) - v.max()) < 1e-9


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from pyspark.sql import functions as F

    held = language_id.held_out(F.col("doc_id"), 4, 2)
    model = language_id.fit(docs.where(~held).select("doc_id", "text", "lang"))
    out = language_id.label(docs, model, held=held).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    odd = language_id.label(frame(spark, [*ODD, "12 34 !!"]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd[:4]] == ["und"] * 4 and odd[-1].lang_pred == "und" and odd[4].lang_pred in model["languages"] and all(0 <= r.score <= 1 for r in odd)
    nothing = language_id.fit(docs.where("false").select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in language_id.label(frame(spark, ODD), nothing).collect()} == {"und"}


@pytest.mark.parametrize("empty", [False, True])
def test_quality(spark, empty):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = language_id.held_out(F.col("doc_id"), 3, 1)
    model = quality.fit(docs.where(~held).join(labels, "doc_id").where(F.lit(not empty)))
    odd = quality.score(frame(spark, ODD), model).orderBy("doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd) and len(odd) == len(ODD) and odd[0].score == odd[1].score
    if empty:
        assert {r.score for r in odd} == {0.5}
    else:
        out = quality.score(docs, model, held=held).join(labels, "doc_id").where("held_out")
        assert out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.95
        assert quality.accepted(docs, model).columns == docs.columns


def test_accounts_next_to_each_other():
    a, b = "DE89370400440532013000", "GB82WEST12345698765432"
    spans = lambda text: [text[i:j] for i, j in pii.accounts(text)]
    assert spans(f"{a} {b}") == [a, b] and spans(f"RE45 {a}") == [a] and spans(f"x{a}") == []
    assert spans("GB82 WEST 1234 5698 7654 32 DE89 3704 0044 0532 0130 00") == ["GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"]
    assert spans("TR330006100519786457841326") == ["TR330006100519786457841326"]


def test_token_counts_of_every_script(spark):
    """Texts beyond the written-out scripts go through the shortcut too, with the library's counts; only unproven code points go to the library."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        vocabulary = f.read()
    odd, pattern = token_counts.unlike(vocabulary, public_tokenizers.PATTERN), public_tokenizers.PATTERN
    count = token_counts.Counter(vocabulary, token_counts.prove_whole_tokens(vocabulary, pattern), pattern, odd)
    rng = np.random.RandomState(6)
    blocks = [(0x20, 0x7F), (0x370, 0x600), (0x600, 0x900), (0x900, 0xE00), (0x3040, 0x3100), (0x4E00, 0x5200), (0xAC00, 0xB000), (0x1F300, 0x1F600), (0x2000, 0x2100), (0x10000, 0x10900), (0x1E900, 0x1E960)]
    texts = ["".join(chr(rng.randint(*blocks[b])) if rng.rand() < 0.8 else " " for _ in range(60)) for b in rng.randint(0, len(blocks), 400)]
    library = Tokenizer.from_str(vocabulary)
    assert count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert sum(bool(count.odd(t)) for t in texts) < 100 and not count.odd("日本語 العربية हिन्दी \U0001f600") and count.odd("\U00030001")


SCRIPT_OF = language_id.Grams().script


def plain_scores(model, word):
    """Log-likelihoods of a word's pairs and triples of code points by language, one by one."""
    c = [32, *map(ord, word), 32]
    mask = 0xFFFFFFFF
    allowed = model["scripts"][SCRIPT_OF[c[1]]]
    out = np.where(allowed, 0.0, -1e4) if allowed.any() else np.zeros(len(model["languages"]))
    for i in range(len(c) - 1):
        two = (c[i] * 0x9E3779B1 + c[i + 1] * 0x85EBCA77) & mask
        out = out + model["tables"][0][two >> (32 - language_id.BITS)]
        if i + 2 < len(c):
            out = out + model["tables"][1][((two * 0xC2B2AE3D + c[i + 2] * 0x27D4EB2F) & mask) >> (32 - language_id.BITS)]
    return out


def odd_model(m, seed=1):
    rng = np.random.RandomState(seed)
    return {"languages": [f"l{i:03}" for i in range(m)], "tables": rng.randn(2, 1 << language_id.BITS, m).astype(np.float32), "scripts": rng.rand(language_id.OTHER + 1, m) < 0.6}


@pytest.mark.parametrize("m", [3, 200])
def test_labels_equal_a_plain_pass(monkeypatch, m):
    """Whole texts and texts in pieces, with few and with many languages."""
    model = odd_model(m)
    labeller = language_id.Labeller(model, 4.0)
    texts = ["Guten tag, my friend, this is ein text", "αβγ δε жук 日本 x", "a", "12 ?", "x y " * 40, "été naïf " * 30]
    plain = []
    for t in texts:
        s = np.array([plain_scores(model, w) for w in re.findall(r"[^\W\d_]+", t.lower())]).reshape(-1, m)
        v = s[0].copy() if len(s) else np.zeros(m)
        for row in s[1:]:
            v = row + np.maximum(v, v.max() - 4.0)
        plain.append((s, v.max()))
    for piece in (1 << 17, 16):
        monkeypatch.setattr(language_id, "PIECE", piece)
        for (s, best), (_, path) in zip(plain, labeller.spans(texts) if piece > 99 else [labeller.spans([t])[0] for t in texts]):
            got = sum(s[i, k] for i, k in enumerate(path)) - 4.0 * sum(a != b for a, b in zip(path, path[1:]))
            assert len(path) == len(s) and (not len(s) or abs(got - best) < 1e-3)


def test_many_languages_and_a_long_text(spark):
    rows = [(i, f"word{chr(97 + i % 26)} uv{chr(97 + i // 26)}x " * 5, f"l{i:03}") for i in range(150)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model["languages"]) == 150
    long = "worda uvax " * 100_000
    got = language_id.label(spark.createDataFrame([(0, long), (1, "worda uvax " * 5), (2, "wordb uvbx")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got[:2]] == ["l000", "l000"] and got[0].n_spans == 1


def plain_features(text):
    """Hashed byte n-grams, words and repeats of a text, by loops over its bytes."""
    b, top = text.encode(), 32 - quality.BITS
    for i in range(len(b) - 2):
        yield (int.from_bytes(b[i : i + 3], "little") * 0x9E3779B1 & 0xFFFFFFFF) >> top
    for i in range(len(b) - 3):
        f = int.from_bytes(b[i : i + 4], "little")
        yield ((f * 0x85EBCA6B & 0xFFFFFFFF) ^ (f >> 15)) >> top
    row, _, _, h = Words()(*utf8(pa.array([text])))
    finish = lambda v: int(v) >> (64 - quality.BITS)
    from bitballot.llm._words import mix

    for i, v in enumerate(h.tolist()):
        yield finish(v)
        yield finish(mix(np.array([3 if i and v == h[i - 1] else 4], np.uint64))[0])


def test_quality_equals_a_plain_form():
    """The score of averaged vectors, and one step of gradient descent."""
    texts = ["abc abc d", "Ünder the Ünder", "", "x"]
    model = quality.train([(t, i % 2) for i, t in enumerate(texts)], dim=3, steps=40)
    got = quality.Scorer(model)(pa.array(texts))
    for t, s in zip(texts, got):
        ids = list(plain_features(t))
        hidden = np.mean([model["vectors"][i] for i in ids], axis=0) if ids else np.zeros(3)
        z = model["out"] @ hidden + model["bias"]
        assert abs(np.exp(z[1]) / np.exp(z).sum() - s) < 1e-6
    before, after = quality.train([], dim=3), quality.train([("abc d", 1)], dim=3, steps=1, rate=0.3)
    ids = list(plain_features("abc d"))
    hidden = np.mean([before["vectors"][i] for i in ids], axis=0)
    assert np.allclose(after["out"], -0.3 * np.outer([0.5, -0.5], hidden)) and np.allclose(after["bias"], [-0.015, 0.015])
    assert np.allclose(after["vectors"], before["vectors"])  # the output layer is 0 before the first step
    again = quality.train([("abc d", 1)], dim=3, steps=2, rate=0.3)
    p = np.exp(after["out"] @ hidden + after["bias"])
    grad = (p / p.sum() - [0, 1]) @ after["out"]
    share = np.bincount(ids, minlength=1 << quality.BITS) / len(ids)
    assert np.allclose(again["vectors"], before["vectors"] - 0.15 * np.outer(share, grad))


def test_quality_training_is_compact():
    """Less than 10 bytes of the driver for each feature of a text, where arrays for each text took 16 and more."""
    import tracemalloc

    rng = np.random.RandomState(5)
    texts = ["".join(chr(c) for c in rng.randint(32, 127, 4000)) for _ in range(200)]
    quality.train(list(zip(texts[:2], (0, 1))), steps=2)
    tracemalloc.start()
    try:
        quality.train([], steps=1)
        empty = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        quality.train([(t, i % 2) for i, t in enumerate(texts)], steps=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    features = sum(len(set(plain_features(t))) for t in texts[:5]) / 5 * len(texts)
    assert peak - empty < 10 * features


def test_driver_gives_back_free_memory(spark, tmp_path, monkeypatch):
    """Written tables make the driver return what it has freed."""
    from bitballot.llm import _common

    assert "Trim native heap" in _common.give_back(spark)
    calls = []
    monkeypatch.setattr(_common, "give_back", calls.append)
    monkeypatch.setattr(_common.Scratch, "given_back", 0.0)
    kept = _common.Scratch(spark)
    for name in ("a", "b"):
        assert kept.save(spark.range(3), name).count() == 3
    assert calls == [spark]  # soon after, not again
