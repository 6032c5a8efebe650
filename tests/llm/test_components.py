"""Components in one task and in distributed rounds are the same; small edge tables take no rounds."""

import random

import pytest

from scholion.llm import components


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("limit", [None, 0])
def test_components(spark, limit):
    pick = random.Random(3)
    chain = [(k, k + 1) for k in range(300)]
    pick.shuffle(chain)
    some = [(pick.randrange(1000, 1400), pick.randrange(1000, 1400)) for _ in range(220)]
    edges = [*chain, *some, (-(2**63), 2**63 - 1), (5, 5), (None, 7), (7000, 7000), (9000, None), *chain[:50]]
    got = components.connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(5), task_edges=limit).collect()
    assert len(got) == len(set(got)) and dict(map(tuple, got)) == plain(edges)


def test_small_tables_take_no_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "materialize", lambda df, name, old=components.materialize: written.append(name) or old(df, name))
    components.connected_components(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"))
    assert written == ["components"]
