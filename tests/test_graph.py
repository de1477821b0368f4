"""Graph, retrieval and lifecycle on the small cases that define them."""

import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.functions.frames import ensure_checkpoint_dir
from factloom.operators import graph, lifecycle, metrics, ordering, retrieval, triples, vector
from factloom.sources import sinks

T = "ordinal long, subject string, subject_type string, predicate string, object string, object_type string"


def facts(spark, rows):
    return spark.createDataFrame([(i, s, "A", p, o, "B") for i, (s, p, o) in enumerate(rows)], T)


def test_bounded_distances(spark):
    e = spark.createDataFrame([("root", "A", 1.5), ("root", "B", 4.0), ("A", "C", 2.0), ("C", "D", 1.0), ("D", "root", 0.1)], "src string, dst string, distance double")
    near = graph.bounded_distances(e, "root", 4.0)
    assert {r.node: r.distance for r in near.collect()} == {"root": 0.0, "A": 1.5, "C": 3.5, "B": 4.0}
    assert graph.induced(e, near).count() == 3
    assert graph.bounded_distances(e, "nowhere", 4.0).count() == 0


def test_closure_and_cycles(spark):
    chain = [(f"k{i}", f"k{i + 1}") for i in range(8)]
    e = spark.createDataFrame(chain, "src string, dst string")
    reached = graph.closure(e, spark.createDataFrame([("k0",)], "root string"))
    assert {r.node: r.depth for r in reached.collect()} == {f"k{i}": i for i in range(9)}
    assert graph.cyclic_nodes(e).count() == 0
    back = e.unionByName(spark.createDataFrame([("k8", "k3")], "src string, dst string"))
    assert graph.cyclic_nodes(back).count() == 9
    assert graph.closure(back, spark.createDataFrame([("k8",)], "root string")).count() == 6
    records = spark.createDataFrame([("k1", "a", 0), ("k2", "a", 1), ("k5", "b", 0)], "record_id string, semantic_key string, owner_seq long")
    assert {r.semantic_key: r.record_id for r in graph.frontier(reached, records).collect()} == {"a": "k1", "b": "k5"}


def test_corroboration(spark):
    t = facts(spark, [("p1", "has", "fever"), ("p2", "has", "fever"), ("p3", "has", "fever"), ("p1", "had", "fever"), ("fever", "is", "fever")])
    assert {r.entity: r.corroboration for r in graph.corroboration(t).collect()} == {"fever": 3}


def test_most_common(spark):
    t = facts(spark, [("p1", "Diagnosed_With", "ards"), ("p2", "diagnosed_with", "ards"), ("p3", "Diagnosed_With", "flu"), ("p1", "Presents_With", "fever"), ("p1", "Presents_With", "cough"), ("p2", "Presents_With", "fever"), ("p3", "Presents_With", "rash")])
    got = retrieval.most_common(t, "ards", ("presents_with",), ("Diagnosed_With",)).collect()
    assert [tuple(r) for r in got] == [("fever", 2), ("cough", 1)]
    assert [tuple(r) for r in retrieval.most_common(t, "p1", ("Presents_With",), top_n=1).collect()] == [("cough", 1)]
    twice = facts(spark, [("d", "s", "fever"), ("d", "s", "fever"), ("d", "s", "cough")])
    assert [tuple(r) for r in retrieval.most_common(twice, "d", ("s",)).collect()] == [("fever", 2), ("cough", 1)]
    assert retrieval.most_common(t, "nobody", ("s",), ("v",)).count() == 0


def test_recency(spark):
    now = datetime.datetime(2026, 9, 14)
    day = lambda n: now - datetime.timedelta(days=n)
    rows = [("metformin", "ARCHIVED", day(730), "a"), ("ibuprofen", "ACTIVE", day(365), "b"), ("biotin", "ACTIVE", day(1), ""), ("zinc", "ACTIVE", None, "c"), ("edge", "ACTIVE", day(90), "d")]
    df = spark.createDataFrame([("P", "takes", *r) for r in rows], "subject string, predicate string, object string, state string, doc_date timestamp, source_id string")
    got = retrieval.in_order(retrieval.temporal_facts(df, F.lit(now))).collect()
    assert [(r.object, r.recency) for r in got] == [("biotin", "CURRENT"), ("edge", "CURRENT"), ("zinc", "CURRENT"), ("ibuprofen", "CURRENT_STALE"), ("metformin", "PAST")]
    text = {r.object: r.text for r in got}
    assert text["biotin"] == "P — takes — biotin" and text["metformin"] == "[PAST / SUPERSEDED] P — takes — metformin [source: a]"
    assert text["ibuprofen"].startswith("[CURRENT, but as of 2025-09-14 (365 days ago) — no more recent record exists; this may be outdated] P")


def test_seeds(spark):
    entities = spark.createDataFrame([("pt_7714", "PT-7714"), ("fever", "Fever"), ("x1", "Chest Pain")], "entity string, label string")
    names = spark.createDataFrame([("Patient 7714",), ("7714",), ("FEVER",), ("chest pain",), ("none",)], "name string")
    assert {r.name: r.entity for r in retrieval.resolve_seeds(names, entities).collect()} == {"Patient 7714": "pt_7714", "7714": "pt_7714", "FEVER": "fever", "chest pain": "x1"}


def test_fact_text(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    got = spark.range(1).select(retrieval.fact_text(F.lit("S"), F.lit("p"), F.lit("O"), a("d1", "d2"), a("2026-01-01"), F.lit(3), F.lit(True)).alias("x")).first().x
    assert got == "[ARCHIVED / SUPERSEDED] S — p — O [Docs: d1, d2 | Date: 2026-01-01 | 3 mentions]"


def test_states_and_reverts(spark):
    audit = spark.createDataFrame([("a", None, "ACTIVE", 0), ("a", "ACTIVE", "ARCHIVED", 1), ("a", "ARCHIVED", "TBD", 2), ("b", "DELETED", "DELETED", 3)], "node_id string, from_state string, to_state string, seq long")
    assert [(r.node_id, r.seq) for r in lifecycle.illegal_transitions(audit).collect()] == [("a", 2)]
    assert {r.node_id: r.state for r in lifecycle.states(audit).collect()} == {"a": "TBD", "b": "DELETED"}
    r = spark.createDataFrame([("v0", "k", 0), ("v1", "k", 1), ("v2", "k", 2), ("w0", "j", 0)], "record_id string, semantic_key string, owner_seq long")
    touched = spark.createDataFrame([("k", 1), ("k", 2), ("j", 0)], "semantic_key string, owner_seq long")
    assert [tuple(x) for x in lifecycle.revert_plan(r, touched).collect()] == [("k", "v2", "v0")]
    fault = lambda *v: spark.range(1).select(lifecycle.revert_fault(*map(F.lit, v[:4]), F.lit(v[4]), 30, F.lit(v[5]), F.lit(v[6])).alias("x")).first().x
    assert fault("t", "k", "k", "ARCHIVED", 1, 4, "SYSTEM_1") is None
    assert fault("t", "k", "k", "ARCHIVED", 1, 0, "SYSTEM_1") == "needs SYSTEM_2"
    assert fault("t", "k", "j", "ARCHIVED", 1, 4, "SYSTEM_1") == "other key"
    assert fault("t", "k", "k", "ACTIVE", 99, 4, "SYSTEM_1") == "not archived"


def test_collection(spark):
    old, now = datetime.datetime(2020, 1, 1), datetime.datetime(2026, 1, 1)
    r = spark.createDataFrame([("v0", "k", 0, "ARCHIVED", old), ("v1", "k", 1, "ARCHIVED", old), ("v2", "k", 2, "ACTIVE", old), ("c", "j", 0, "TBD", old)], "record_id string, semantic_key string, owner_seq long, state string, created_at timestamp")
    deps = spark.createDataFrame([("v0", "c")], "parent string, child string")
    none = spark.createDataFrame([], "record_id string")
    assert [x.record_id for x in lifecycle.sweep(lifecycle.evictable(r, deps, none, F.lit(now), 30)).collect()] == ["v1"]


def test_append_is_idempotent(spark):
    s = "record_id string, obj string, txn_id string"
    store = spark.createDataFrame([("a", "1", "t"), ("b", "1", "t")], s)
    new = spark.createDataFrame([("a", "1", "t"), ("b", "2", "t"), ("c", "1", "t"), ("c", "1", "t"), ("d", "1", "t"), ("d", "2", "t")], s)
    fresh, conflicts = lifecycle.append(store, new, ("obj", "txn_id"))
    assert [r.record_id for r in fresh.collect()] == ["c"] and sorted(r.record_id for r in conflicts.collect()) == ["b", "d"]


def test_plans(spark):
    need = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a"), ("r", "z")], "root string, semantic_key string")
    used = spark.createDataFrame([("p", "a", "a1"), ("p", "b", "b1"), ("q", "a", "a0")], "root string, semantic_key string, record_id string")
    held = spark.createDataFrame([("a", "a1"), ("b", "b1")], "semantic_key string, record_id string")
    assert {r.root: r.outcome for r in lifecycle.plan_outcomes(used, held, need).collect()} == {"p": "AUTHORIZED", "q": "REPLAN_REQUIRED", "r": "REPLAN_REQUIRED"}
    calls = []
    assert lifecycle.replan("q", lambda root, again: "BLOCKED" if again else "REPLAN_REQUIRED", lambda root: calls.append(root) or "q2") == ("q2", "BLOCKED") and calls == ["q"]


def test_queue(spark):
    ev = spark.createDataFrame([("i", "CONTRADICTION", "SYSTEM_2", None, "r", 0), ("i", "CONTRADICTION", "SYSTEM_2", "approve", "r", 1), ("j", "REDERIVE", "SYSTEM_1", None, "s", 0), ("j", "REDERIVE", "SYSTEM_1", "defer", "s", 1)], "item_id string, kind string, routing string, verdict string, record_id string, seq long")
    assert [r.item_id for r in lifecycle.pending(ev).collect()] == ["j"] and lifecycle.pending(ev, "SYSTEM_2").count() == 0


def test_triples(spark):
    t = spark.createDataFrame([(0, "a", "X", "p", "b", "Y"), (5, "b", "Z", "q", "c", None), (9, "a", "X", "q", "b", "Y")], T)
    e, r = triples.entities(t), triples.relations(t)
    assert sorted(map(tuple, e.collect())) == [(0, "a", "X"), (1, "b", "Z"), (2, "c", "Unknown")]
    ids = triples.over_ids(t, e, r)
    assert sorted(map(tuple, ids.collect())) == [(0, 0, 1), (0, 1, 1), (1, 1, 2)]
    assert sorted(map(tuple, triples.named(ids, e, r).collect())) == [("a", "p", "b"), ("a", "q", "b"), ("b", "q", "c")]
    assert {(x.subject, x.object): x.predicate for x in triples.last_edge_wins(t).collect()} == {("a", "b"): "q", ("b", "c"): "q"}
    assert triples.entities(t.limit(0)).count() == 0


def test_numbered_over_ranges(spark):
    df = spark.range(0, 5000, 7).withColumn("o", F.col("id") * 3)
    got = {r.id: r.n for r in ordering.numbered(df, "o", "n", 1000).collect()}
    assert got == {i: k for k, i in enumerate(range(0, 5000, 7))}


@pytest.mark.parametrize("found, truth, want", [("ab", "bc", (1, 1, 1, 0.5, 0.5, 0.5)), ("", "", (0, 0, 0, 1, 1, 1)), ("", "a", (0, 0, 1, 0, 0, 0)), ("a", "", (0, 1, 0, 0, 1, 0))])
def test_set_scores(spark, found, truth, want):
    arr = lambda s: F.array(*map(F.lit, s)).cast("array<string>")
    s = metrics.set_scores(arr(found), arr(truth))
    row = spark.range(1).select(*[c.alias(n) for n, c in s.items()]).first()
    assert tuple(row) == pytest.approx(want)


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank long")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank long")
    assert [r.id for r in vector.fuse([a, b], 3).collect()] == [2, 1, 3]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "s")
    for v in (1, 2):
        sinks.publish({"t": spark.range(v)}, root, v)
    assert sinks.load(spark, root, "t").count() == 2


def test_running_total(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice(["hub"] * 8 + ["a", "b"]), rng.choice([0, 1 << 56]) + rng.randrange(200), rng.randrange(5), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at long, n long, id long")
    got = {r.id: r.total for r in ordering.running_total(df, "k", "at", "n", "total").collect()}
    assert got == {i: sum(m for l, b, m, _ in rows if l == k and b <= at) for k, at, n, i in rows}
    assert ordering.running_total(df.limit(0), "k", "at", "n", "total").count() == 0


def test_subgraphs_of_subjects(spark):
    nodes = [
        ("Patient_p_1", "entity", None, None), ("patient_p_2", "entity", None, None), ("fever", "entity", None, None), ("old", "entity", None, None), ("alone", "entity", None, None), ("doc", "entity", None, None),
        ("r1", "record", "p_1::has", "ACTIVE"), ("r0", "record", "p_1::has", "ARCHIVED"), ("x", "record", "other::has", "ARCHIVED"), ("r2", "record", "Patient_p_1::sex", "ACTIVE"), ("q1", "record", "p_2::has", "FLAGGED"), ("z", "record", "p_10::has", "ACTIVE"), ("n", "record", None, "ACTIVE"),
    ]
    edges = [("r1", "fever", "OBJECT"), ("r1", "r0", "SUPERSEDES"), ("r0", "old", "OBJECT"), ("r1", "x", "DERIVED_FROM"), ("x", "alone", "OBJECT"), ("doc", "r1", "SUBJECT"), ("q1", "fever", "OBJECT"), ("x", "z", "SUPERSEDES"), ("z", "fever", "OBJECT")]
    g = spark.createDataFrame(nodes, "node string, kind string, semantic_key string, state string"), spark.createDataFrame(edges, "src string, dst string, kind string")
    asked = spark.createDataFrame([("P-1",), ("p_2",), ("P-1",), ("ALONE",), ("nobody",), (None,)], "subject string")

    def around(history):
        got = {}
        for r in graph.subjects_around(*g, asked, history).collect():
            got.setdefault(r.subject, []).append(r.node)
        return {k: sorted(v) for k, v in got.items()}

    assert around(True) == {"P-1": sorted(["Patient_p_1", "r1", "r0", "r2", "fever", "old", "doc", "x", "alone"]), "p_2": ["fever", "patient_p_2", "q1"], "ALONE": ["alone"]}
    assert around(False) == {"P-1": sorted(["Patient_p_1", "r1", "r2", "fever", "doc"]), "p_2": ["patient_p_2"], "ALONE": ["alone"]}
    kept = graph.subject_edges(graph.subjects_around(*g, asked), g[1]).collect()
    assert sorted((r.subject, r.src, r.dst) for r in kept) == sorted([("P-1", a, b) for a, b, _ in edges[:6]] + [("p_2", "q1", "fever")])


def all_ways(edges, roots):
    """(root, node): depth, hop by hop."""
    out = {}
    for root in roots:
        front, depth, seen = {root}, 0, {root: 0}
        while front:
            depth += 1
            front = {b for a, b in edges if a in front and b not in seen}
            seen |= {n: depth for n in front}
        out |= {(root, n): k for n, k in seen.items()}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_closures_that_share_nodes(spark, seed):
    """Layers of fewer and fewer nodes with several parents each, repeated edges, loops, a cycle at the bottom and roots without edges."""
    rng = random.Random(seed)
    layers = [[f"{c}{i}" for i in range(n)] for c, n in zip("abcde", (60, 25, 9, 4, 2))]
    edges = [(x, y) for up, down in zip(layers, layers[1:]) for x in up for y in rng.sample(down, 1 + (seed > 0 and rng.random() < 0.3))]
    edges += [("a1", "c1"), ("a1", "a1"), edges[0], ("e0", "d0"), ("e1", "c2"), ("b3", "a5")]
    asked = [x for up in layers[: 1 + seed] for x in up] + ["lone"]
    e = spark.createDataFrame([*edges, (None, "a1"), ("a2", None)], "src string, dst string")
    roots = spark.createDataFrame([(x,) for x in asked + asked[:3]], "root string")
    reached = graph.closure(e, roots).checkpoint()
    got = [tuple(r) for r in reached.collect()]
    assert len(got) == len(set(got)) and {r[:2]: r[2] for r in got} == all_ways(edges, asked)
    rows = [(x, x[0] if x[0] < "d" else "low", rng.randrange(3)) for up in layers for x in up if rng.random() < 0.8] + [("a1", "also", 0), ("c1", "also", 1)]
    records = spark.createDataFrame(rows, "record_id string, semantic_key string, owner_seq long")
    want = sorted(map(tuple, graph.frontier(reached, records).collect()))
    assert sorted(map(tuple, graph.frontiers(e, roots, records).collect())) == want and len(want) > 60


def test_a_closure_stores_less_than_it_has(spark):
    """What many roots share is stored once, not for each of them."""
    tail = [(f"t{i}", f"t{i + 1}") for i in range(12)]
    e = spark.createDataFrame([(f"leaf {i}", "t0") for i in range(3000)] + tail, "src string, dst string")
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    reached = graph.closure(e, e.select(F.col("src").alias("root")))
    assert reached.count() == 3000 * 14 + sum(range(2, 14))
    assert size() - before < 500_000
