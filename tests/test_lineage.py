"""Edges that would close a cycle, and the closure after batches, against adding edges one by one."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import graph, lifecycle, lineage


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def one_by_one(base, batch):
    out = {}
    for a, b in base:
        out.setdefault(a, set()).add(b)
    refused, admitted = [], []
    for src, dst, seq in sorted(batch, key=lambda e: (e[2], e[0], e[1])):
        if src is None or dst is None or dst in out.get(src, ()) or (src, dst) in [x[:2] for x in refused]:
            continue
        stack, seen = [dst], set()
        while stack:
            n = stack.pop()
            if n not in seen:
                seen.add(n)
                stack += out.get(n, ())
        if src in seen:
            refused.append((src, dst, seq, "loop" if src == dst else "cycle"))
        else:
            admitted.append((src, dst, seq))
            out.setdefault(src, set()).add(dst)
    return sorted(admitted), sorted(refused)


@pytest.mark.parametrize("seed", range(2))
def test_batches_equal_one_by_one(spark, seed):
    rng = random.Random(seed)
    n = 14
    base = sorted({(f"n{a:02}", f"n{b:02}") for a, b in (rng.sample(range(n), 2) for _ in range(12)) if a > b})
    edges = edges_of(spark, base)
    known = lineage.ranks(edges)
    for size in (12, 5)[: 1 + seed]:
        batch = [(f"n{rng.randrange(n + 3):02}", f"n{rng.randrange(n + 3):02}", rng.randrange(100)) for _ in range(size)]
        admitted, refused, known = lineage.admit(edges, known, spark.createDataFrame(batch, "src string, dst string, seq int"))
        want = one_by_one(base, batch)
        got = sorted(map(tuple, admitted.collect())), sorted(map(tuple, refused.collect()))
        assert got == want
        base += [x[:2] for x in got[0]]
        edges = edges_of(spark, base)
        rank = {r.node: r["rank"] for r in known.collect()}
        assert all(rank[a] > rank[b] for a, b in base)


def test_batches_that_agree_with_the_ranks_start_no_search(spark, monkeypatch):
    base = [("c", "b"), ("b", "a")]
    edges = edges_of(spark, base)
    known = lineage.ranks(edges)
    monkeypatch.setattr(lineage, "_reached", lambda *a: pytest.fail("searched"))
    batch = [("c", "a", 1), ("new", "c", 2), ("newer", "new", 3), ("c", "b", 4), (None, "a", 5), ("x", "x", 6)]
    admitted, refused, after = lineage.admit(edges, known, spark.createDataFrame(batch, "src string, dst string, seq long"))
    assert sorted(map(tuple, admitted.collect())) == [("c", "a", 1), ("new", "c", 2), ("newer", "new", 3)] and [tuple(r) for r in refused.collect()] == [("x", "x", 6, "loop")]
    assert {r.node: r["rank"] for r in after.collect()}.items() >= {"a": 0, "b": 1, "c": 2, "new": 3, "newer": 4}.items()
    none = lineage.admit(edges, known, spark.createDataFrame([], "src string, dst string, seq long"))
    assert none[0].count() == none[1].count() == 0


def test_a_refused_edge_frees_later_ones(spark):
    edges = edges_of(spark, [("b", "a")])
    batch = [("a", "b", 1), ("c", "b", 2), ("a", "c", 3), ("d", "a", 4), ("a", "d", 5)]
    admitted, refused, _ = lineage.admit(edges, lineage.ranks(edges), spark.createDataFrame(batch, "src string, dst string, seq long"))
    assert (sorted(map(tuple, admitted.collect())), sorted(map(tuple, refused.collect()))) == one_by_one([("b", "a")], batch)


def test_ranks_are_found_from_below(spark, monkeypatch):
    """The longest way down, each node placed once; a cycle is told as soon as nothing can be taken away."""
    monkeypatch.setattr(lineage, "_raised", lambda *a: pytest.fail("raised"))
    rows = [("d", "c"), ("c", "b"), ("b", "a"), ("d", "a"), ("e", "a"), ("d", "c"), (None, "a")]
    assert {r.node: r["rank"] for r in lineage.ranks(edges_of(spark, rows)).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 1}
    assert lineage.ranks(edges_of(spark, [])).count() == 0
    with pytest.raises(ValueError):
        lineage.ranks(edges_of(spark, [*rows, ("a", "d"), ("x", "d")]))


def test_ranks_refuse_cycles(spark, monkeypatch):
    monkeypatch.setattr(lineage, "ROUNDS", 4)
    with pytest.raises(ValueError):
        lineage.ranks(edges_of(spark, [("a", "b"), ("b", "a")]))


@pytest.mark.parametrize("seed", range(2))
def test_closure_after_batches_equals_a_rebuild(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(30), 2), reverse=True)) for _ in range(60)})
    rng.shuffle(pairs)
    rows = [(f"n{a:02}", f"n{b:02}") for a, b in pairs]
    name = edges_of(spark, rows).select(F.explode(F.array("src", "dst")).alias("root")).distinct
    reached = graph.closure(edges_of(spark, rows[:20]), edges_of(spark, rows[:20]).select(F.explode(F.array("src", "dst")).alias("root")).distinct())
    for k in (20, 35, 50):
        delta = lineage.closure_delta(reached, edges_of(spark, rows[k : k + 15] + [(None, "n01"), ("n01", "n01")]))
        assert delta.count() < 0.9 * reached.count() + 60
        reached = reached.unionByName(delta).checkpoint()
    want = graph.closure(edges_of(spark, rows), name())
    assert sorted(map(tuple, lineage.nearest(reached).collect())) == sorted(map(tuple, want.collect()))
    assert lineage.closure_delta(reached, edges_of(spark, rows[:5])).count() == 0


@pytest.mark.parametrize("few", [0, 100])
def test_appended_edges_leave_one_row_a_pair(spark, monkeypatch, few):
    """Long ways are cut short by later edges, and new nodes come above and below."""
    monkeypatch.setattr(lineage, "FEW", few)
    batches = [[("a", "b"), ("b", "c"), ("c", "d"), ("x", "a")], [("a", "d"), ("new", "x"), ("d", "under")], [("x", "under"), ("new", "b"), ("b", "b"), (None, "a")]]
    first = edges_of(spark, batches[0])
    nodes = lambda e: e.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("root")).distinct()
    kept = graph.closure(first, nodes(first)).checkpoint()
    for batch in batches[1:]:
        kept = lineage.appended(kept, edges_of(spark, batch))
    every = edges_of(spark, sum(batches, []))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, graph.closure(every, nodes(every)).collect()))


def test_plan_checks(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    used = table([("p", "k1", "r1"), ("p", "k2", "r2"), ("q", "k1", "r0"), ("s", "k1", "r1"), ("t", "k1", "r1"), ("u", "k3", "r3")], "root string, semantic_key string, record_id string")
    heads = table([("k1", "r1"), ("k2", "r2")], "semantic_key string, record_id string")
    needs = table([("p", "k1"), ("p", "k2"), ("p", "k2"), ("q", "k1"), ("s", "k1"), ("t", "k1"), ("t", "k2"), ("u", "k3")], "root string, semantic_key string")
    reached = table([("p", "r1", 1), ("p", "r2", 3), ("q", "r0", 1), ("t", "r1", 1), ("u", "r3", 1), ("p", "r1", 2)], "root string, node string, depth int")
    got = {r.root: (r.outcome, r.reason, r.stale) for r in lifecycle.plan_checks(used, heads, needs, reached).collect()}
    assert got == {
        "p": ("AUTHORIZED", "validated", []), "q": ("REPLAN_REQUIRED", "stale dependencies", ["k1"]), "s": ("REPLAN_REQUIRED", "does not derive", []),
        "t": ("BLOCKED", "incomplete lineage", []), "u": ("BLOCKED", "no head", []),
    }
    again = {r.root: r.outcome for r in lifecycle.plan_checks(used, heads, needs, reached, True).collect()}
    assert again == {"p": "AUTHORIZED", "q": "BLOCKED", "s": "BLOCKED", "t": "BLOCKED", "u": "BLOCKED"}
