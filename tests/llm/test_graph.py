"""Components against a plain search."""

import random

import pytest

from bitballot.llm._common import Scratch
from bitballot.llm._graph import components


def plain(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    least = {}
    for start in sorted(near):
        stack = [start] if start not in least else []
        while stack:
            n = stack.pop()
            if n not in least:
                least[n] = start
                stack += near[n]
    return {n: c for n, c in least.items() if n != c}


def sparse(seed, nodes, edges):
    rng = random.Random(seed)
    return [(rng.randrange(-nodes, nodes), rng.randrange(-nodes, nodes)) for _ in range(edges)]


CASES = {
    "none": [],
    "loops": [(1, 1), (2, 2)],
    "path": [(i, i + 1) for i in range(60)],
    "mixed path": [(i * 37 % 61, (i + 1) * 37 % 61) for i in range(60)],
    "star of the largest": [(99, i) for i in range(40)],
    "two stars and a bridge": [(0, i) for i in range(2, 20)] + [(1, i) for i in range(20, 40)] + [(19, 39)],
    "sparse": sparse(1, 200, 180),
    "dense": sparse(2, 60, 300),
    "repeated": [(5, 3), (3, 5), (5, 3), (4, 3)],
}


@pytest.mark.parametrize("case", CASES)
def test_components(spark, case):
    df = spark.createDataFrame(CASES[case], "a long, b long")
    got = [tuple(r) for r in components(df, Scratch(spark), "c").collect()]
    want = plain([(a, b) for a, b in CASES[case] if a != b])
    assert len(got) == len(want) and dict(got) == want
