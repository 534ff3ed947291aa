import random

import pytest

from bitballot.llm import ngram_join
from bitballot.llm._common import Scratch

SPACE = " \t\n\v\f\r"


def words(text):
    out, word = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c in SPACE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def brute(rows, k, percent):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    ids = [r[0] for r in rows]
    label = list(ids)
    link = [[j for j in range(len(rows)) if sets[i] and ids[i] is not None and ids[j] is not None and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in range(len(rows))]
    for _ in rows:
        label = [min([label[i], *(label[j] for j in link[i])]) if ids[i] is not None else None for i in range(len(rows))]
    return sorted(((i, len(s), c) for i, s, c in zip(ids, sets, label)), key=repr)


def made(n_groups=4, members=40, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 80, 150]))]
        for _ in range(members):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12])):
                i = rng.randrange(len(text))
                rng.choice([lambda: text.insert(i, rng.choice(vocabulary)), lambda: text.__setitem__(i, f"x{rng.random()}"), lambda: text.__delitem__(i)])()
            rows.append(" ".join(text))
    passage = " ".join(rng.choice(vocabulary) for _ in range(25))
    rows += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(2, 12))) for _ in range(40)]
    rng.shuffle(rows)
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


ODD = [(2001, None), (2002, ""), (2003, " \n"), (2004, "One two"), (2005, "one TWO"), (2006, "a b c d"), (2006, "a b c d"), (None, "a b c d"), (2007, "É a b c"), (2008, "é a b c"), (2009, "z " * 3000)]


@pytest.mark.parametrize(("group", "k", "percent"), [(3, 4, 85), (10_000, 4, 85), (3, 5, 80)])
def test_components_equal_brute_force(spark, monkeypatch, group, k, percent):
    """Both ways, direct and recentred, lose no link; odd rows have their stated results."""
    monkeypatch.setattr(ngram_join, "GROUP", group)
    rows = made() + ODD
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component string, n int")
    got = sorted((tuple(r) for r in ngram_join.join(df, Scratch(spark), k, percent).collect()), key=repr)
    assert got == brute(rows, k, percent)


def test_representatives_keep_one_of_each_group(spark):
    rows = made(2, 10) + ODD
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string")
    kept = [r[0] for r in ngram_join.representatives(df, Scratch(spark)).collect()]
    want = {(i if n else ("empty", i)) for i, n, c in brute(rows, 5, 80) if i is None or i == c}
    assert sorted(kept, key=repr) == sorted([w[1] if isinstance(w, tuple) else w for w in want], key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join(df, Scratch(spark)).count() == 0


def test_a_number_used_by_several_texts_loses_no_link(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, " ".join(f"c{i}" for i in range(9))), (1, a), (1, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join.join(df, Scratch(spark), 4, 85).collect())
    assert got == brute(rows, 4, 85) and {c for _, _, c in got} == {1, 4}
    kept = sorted((r.doc_id, r.text) for r in ngram_join.representatives(df.withColumn("_gone", df.doc_id), Scratch(spark), 4, 85).collect())
    assert kept == sorted([(1, a), (1, b), rows[4]])


def test_large_groups_of_copies_that_miss_each_other(spark):
    """One edit each: linked with the text that was copied, or a first copy of it, not with each other."""
    rng = random.Random(9)
    rows = []
    for size in (58, 47):  # one edit of a text of 58 words is within 85 %, one of 47 is not
        base = [f"t{size}-{i}" for i in range(size)]
        for j in range(300):
            text = list(base)
            text[rng.randrange(4, size - 4)] = f"e{size}-{j}"
            rows.append(" ".join(text))
        rows += [" ".join([*base, f"more{j}"]) for j in range(20)]
        rows += [" ".join([*base[:6], "second", *base[7:20], f"s{j}", *base[21:]]) for j in range(100)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = sorted((tuple(r) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark), 4, 85).collect()), key=repr)
    assert got == brute(rows, 4, 85)
