import random

import pytest

from aeroflow.operators import components
from aeroflow.operators.components import connected_components


def _expected(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("small", [0, 20_000])
def test_random_graphs_chains_and_stars(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL_LINKS", small)
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    pairs += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 60)]
    pairs += [(5, 5), (None, 7), (8, None), pairs[0]]
    got = connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == _expected(pairs)
    assert len(got) == len({r.node for r in got})


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []
