"""H7 on edge tables against a topological sort and against the in-row kernel."""

import random

import pytest
from pyspark.sql import functions as F

from prefspark.operators import peel


def sorts(edges):
    """Kahn's algorithm."""
    edges = {(s, d) for s, d in edges if s is not None and d is not None}
    out, into = {}, {}
    for s, d in edges:
        out.setdefault(s, []).append(d)
        into[d] = into.get(d, 0) + 1
        into.setdefault(s, 0)
    free, seen = [n for n, k in into.items() if k == 0], 0
    while free:
        n = free.pop()
        seen += 1
        for d in out.get(n, ()):
            into[d] -= 1
            if into[d] == 0:
                free.append(d)
    return seen == len(into)


def check(spark, graphs, **kw):
    rows = [(g, s, d) for g, edges in graphs.items() for s, d in edges]
    df = spark.createDataFrame(rows, "g long, src long, dst long")
    got = {r.g: r.acyclic for r in peel.acyclic_graphs(df, ["g"], **kw).collect()}
    assert got == {g: sorts(e) for g, e in graphs.items() if e}
    return got


def test_small_random_graphs(spark):
    rng = random.Random(1)
    graphs = {}
    for g in range(250):
        n = rng.randrange(2, 9)
        graphs[g] = [(rng.randrange(n), rng.randrange(n)) if g % 3 else tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randrange(1, 2 * n))]
    graphs[900] = [(1, 1)]
    graphs[901] = [(1, 2), (2, 1)]
    graphs[902] = [(1, None), (None, 2), (1, 2), (1, 2)]
    got = check(spark, graphs)
    assert 50 < sum(got.values()) < 220


@pytest.mark.parametrize("close", [False, True])
def test_ten_thousand_nodes(spark, close):
    """A chain, which takes as many plain rounds as nodes; a random order; a hub on a third of the edges."""
    rng = random.Random(2)
    n = 10_000
    names = rng.sample(range(10 * n), n)
    chain = [(names[k], names[k + 1]) for k in range(n - 1)]
    order = [tuple(names[x] for x in sorted(rng.sample(range(n), 2))) for _ in range(2 * n)]
    hub = [(names[0], names[k]) for k in range(1, n)] + [(names[k], names[k + 1]) for k in range(1, n - 1, 2)] + [(names[k], names[-1]) for k in range(1, n - 1)]
    graphs = {1: chain, 2: order, 3: hub}
    if close:
        graphs = {1: chain + [(names[-1], names[0])], 2: order + [(d, s) for s, d in order[:1]], 3: hub + [(names[-1], names[0])]}
    check(spark, graphs)


def test_graphs_without_edges_and_several_keys(spark):
    df = spark.createDataFrame([("a", 1, "x", "y"), ("a", 2, "x", "x"), (None, 1, "y", "x"), (None, 2, "y", "x"), (None, 2, "x", "y")], "k string, m.n int, src string, dst string".replace("m.n", "`m.n`"))
    all_ = spark.createDataFrame([("b", 5), ("a", 1)], "k string, `m.n` int")
    got = {(r[0], r[1]): r[2] for r in peel.acyclic_graphs(df, ["k", "m.n"], graphs=all_).collect()}
    assert got == {("a", 1): True, ("a", 2): False, (None, 1): True, (None, 2): False, ("b", 5): True}
    assert peel.acyclic_graphs(df.where(F.lit(False)), ["k"]).collect() == []
