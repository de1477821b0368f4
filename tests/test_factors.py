"""Factors of the adjacency against plain arrays, and new links against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import factors


@pytest.fixture(scope="module")
def skewed(spark):
    """Hubs with most of all partners, a sparse tail, loops, repeats and nulls."""
    rng = random.Random(3)
    rows = [(h, 100 + p) for h in range(4) for p in range(200) if rng.random() < 0.95] + [(rng.randrange(300), rng.randrange(300)) for _ in range(250)]
    return spark.createDataFrame(rows + rows[:40] + [(5, 5), (None, 3), (3, None)], "src long, dst long")


def matrix(entries):
    rows = entries.collect()
    nodes = sorted({r.src for r in rows})
    a = np.zeros((len(nodes), len(nodes)))
    for r in rows:
        a[nodes.index(r.src), nodes.index(r.dst)] = r.weight
    return nodes, a


def arrays(nodes, df, rank):
    got = {r.node: [r[f"v{i}"] for i in range(rank)] for r in df.collect()}
    return np.array([got[n] for n in nodes])


def test_adjacency(skewed):
    nodes, a = matrix(factors.adjacency(skewed))
    count = np.zeros_like(a)
    for r in skewed.dropna().collect():
        if r.src != r.dst:
            i, j = nodes.index(r.src), nodes.index(r.dst)
            count[i, j] += 1
            count[j, i] += 1
    root = np.sqrt(count.sum(axis=1))
    assert np.allclose(a, count / root[:, None] / root[None, :])


def test_rounds_are_multiplicative_updates_and_come_nearer(skewed):
    entries = factors.adjacency(skewed)
    nodes, a = matrix(entries)
    before, w, h = None, None, None
    for rounds in (0, 1, 4):
        got_w, got_h = factors.factorise(entries, 5, rounds)
        if rounds == 0:
            w, h = arrays(nodes, got_w, 5), arrays(nodes, got_h, 5).T
        elif rounds == 1:
            w = w * (a @ h.T) / (w @ h @ h.T + factors.EPSILON)
            h = h * (w.T @ a) / (w.T @ w @ h + factors.EPSILON)
            assert np.allclose(arrays(nodes, got_w, 5), w) and np.allclose(arrays(nodes, got_h, 5).T, h)
        now = factors.residual(entries, got_w, got_h, 5)
        assert now == pytest.approx(((a - arrays(nodes, got_w, 5) @ arrays(nodes, got_h, 5).T) ** 2).sum())
        assert before is None or now < before
        before = now


def test_rounds_don_t_shuffle_the_entries(spark, skewed, monkeypatch):
    """Entries are stored by the node that joins them to the factors, and nothing stays behind in the catalogue."""
    plans, updated = [], factors._updated

    def seen(w, h, entries, rank):
        met = entries.hint("merge").join(h.withColumnRenamed("node", "dst"), "dst")
        plans.append(met._jdf.queryExecution().executedPlan().toString())
        return updated(w, h, entries, rank)

    monkeypatch.setattr(factors, "_updated", seen)
    factors.factorise(factors.adjacency(skewed), 3, 1)
    assert len(plans) == 2 and all("SortMergeJoin" in p and p.count("Exchange") == 1 for p in plans)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


@pytest.mark.parametrize("block, seed", [(2048, 512), (7, 3), (30, 60)])
def test_new_edges_equal_all_pairs(skewed, block, seed):
    entries = factors.adjacency(skewed)
    nodes, a = matrix(entries)
    rows, columns = factors.factorise(entries, 4, 3)
    s = arrays(nodes, rows, 4) @ arrays(nodes, columns, 4).T
    want = sorted((-s[i, j], nodes[i], nodes[j]) for i in range(len(nodes)) for j in range(i + 1, len(nodes)) if a[i, j] == 0)[:20]
    got = factors.new_edges(entries, rows, columns, 20, 4, block, seed).collect()
    assert [(r.src, r.dst) for r in got] == [x[1:] for x in want]
    assert [r.score for r in got] == pytest.approx([-x[0] for x in want])


def test_far_blocks_are_left_out(spark):
    """A few long factors bound the search: most pairs of blocks aren't looked at, and the result is whole."""
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, *[rng.random() * (1.0 if i < 40 else 1e-3) for _ in range(3)]) for i in range(2000)], "node long, v0 double, v1 double, v2 double")
    none = spark.createDataFrame([], "src long, dst long, weight double")
    got = factors.new_edges(none, rows, rows, 10, 3, 50).collect()
    v = {r.node: (r.v0, r.v1, r.v2) for r in rows.collect()}
    want = sorted((-sum(x * y for x, y in zip(v[i], v[j])), i, j) for i in range(40) for j in range(i + 1, 40))[:10]
    assert [(r.src, r.dst) for r in got] == [x[1:] for x in want]
    assert factors.new_edges(none, rows.limit(0), rows.limit(0), 10, 3).count() == 0


def test_nothing_to_link(spark):
    entries = factors.adjacency(spark.createDataFrame([(1, 1)], "src long, dst long"))
    rows, columns = factors.factorise(entries, 3, 2)
    assert rows.count() == 0 and factors.new_edges(entries, rows, columns, 5, 3).count() == 0
    pair = factors.adjacency(spark.createDataFrame([(1, 2)], "src long, dst long"))
    rows, columns = factors.factorise(pair, 3, 2)
    assert factors.new_edges(pair, rows, columns, 5, 3).where(F.col("score") >= 0).count() == 0
