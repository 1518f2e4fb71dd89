"""Levels and costs against direct computations, and the rounds they take."""

import random

import pytest

from harborline.operators import graphs as G


def levels_of(nodes, edges):
    level, left, rest = {}, set(nodes), set(edges)
    while True:
        ready = {n for n in left if not any(b == n for _, b in rest)}
        for n in ready:
            level[n] = max((level[a] + 1 for a, b in edges if b == n), default=0)
        left -= ready
        rest = {(a, b) for a, b in rest if a not in ready}
        if not ready or not left:
            return level


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_by_peeling_one_list(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(45)) + [100, 101, 102, 103, 104]
    edges = [(rng.randint(0, i - 1), i) for i in range(1, 45) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]
    edges += [(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (3, 104)] if seed == 1 else []
    edges += edges[:5]
    got = G.levels(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(n,) for n in nodes], "node long"))
    assert {r.node: r.level for r in got.collect()} == levels_of(nodes, set(edges))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    real = G.cut
    monkeypatch.setattr(G, "cut", lambda df, what: (rounds.append(what), real(df, what))[1])
    edges = spark.range(1, n).selectExpr("id - 1 AS src", "id AS dst")
    got = G.levels(edges, spark.range(n).withColumnRenamed("id", "node"))
    assert got.where("node <> level").count() == 0 and got.count() == n
    assert rounds.count("jumps") < 20 and rounds.count("ready") == 1


def test_levels_of_nothing(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert G.levels(none, spark.createDataFrame([], "node long")).count() == 0
    assert [tuple(r) for r in G.levels(none, spark.createDataFrame([(5,)], "node long")).collect()] == [(5, 0)]


@pytest.mark.parametrize("width", [None, 0.3])
def test_costs_by_relaxing_one_list(spark, width):
    rng = random.Random(5)
    edges = [(rng.randint(0, 40), rng.randint(0, 40), rng.choice([0.0, 0.5, 1.0, rng.random() * 3])) for _ in range(90)]
    sources = [(0, 0.0), (1, 0.7), (1, 0.2), (77, 1.0)]
    want = {}
    for n, c in sources:
        want[n] = min(c, want.get(n, c))
    for _ in range(60):
        for a, b, c in edges:
            if a in want and want[a] + c < want.get(b, float("inf")) - 1e-15:
                want[b] = want[a] + c
    got = G.cheapest(spark.createDataFrame(edges, "src long, dst long, cost double"), spark.createDataFrame(sources, "node long, cost double"), width, 3)
    got = {r.node: r.cost for r in got.collect()}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in want)


def test_costs_of_a_negative_ring(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, -2.0)], "src long, dst long, cost double")
    with pytest.raises(ValueError):
        G.cheapest(edges, spark.createDataFrame([(0, 0.0)], "node long, cost double"))
