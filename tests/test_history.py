"""States as of any step against a replay of the log."""

import hashlib
import random

from factloom.operators import history


def log(spark, seed=1):
    rng = random.Random(seed)
    rows = [(f"n{rng.randrange(12)}", rng.choice(["ACTIVE", "ARCHIVED", "FLAGGED"]), s) for s in sorted(rng.sample(range(1, 400), 80))]
    return rows, spark.createDataFrame(rows, "node_id string, to_state string, seq long")


def test_as_of_equals_a_replay(spark):
    rows, audit = log(spark)
    known = history.intervals(audit).checkpoint()
    steps = [0, 1, 2, 31, 32, 33, 63, 64, 127, 128, 200, 255, 256, 399, 400, 1000]
    want = set()
    for s in steps:
        now = {}
        for node, state, seq in rows:
            if seq <= s:
                now[node] = state
        want |= {(s, n, x) for n, x in now.items()}
    got = [tuple(r) for r in history.as_of(known, spark.createDataFrame([(s,) for s in steps], "step long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    single = [tuple(r) for r in history.as_of(known, spark.createDataFrame([(77,), (77,)], "step int")).collect()]
    assert len(single) == len({n for n, _, q in rows if q <= 77})
    assert history.as_of(known, spark.createDataFrame([], "step long")).count() == 0


def test_intervals_don_t_overlap_and_join_what_changes_nothing(spark):
    rows, audit = log(spark, 2)
    for node in {r[0] for r in rows}:
        mine = sorted((r.since, r.until, r.state) for r in history.intervals(audit).where(f"node_id = '{node}'").collect())
        assert mine[-1][1] is None and all(a[1] == b[0] and a[2] != b[2] for a, b in zip(mine, mine[1:]))
    assert history.intervals(audit.limit(0)).count() == 0


def test_step_report(spark):
    rows, audit = log(spark)
    old = spark.createDataFrame([("b", "a", 10), ("c", "b", 10), ("d", "c", 300), ("e", "d", 999)], "new_id string, old_id string, seq long")
    got = {r.step: r for r in history.step_report(history.intervals(audit), spark.createDataFrame([(0,), (10,), (350,)], "step long"), old).collect()}
    assert got[0].states == {} and got[0].superseded == []
    assert [tuple(x) for x in got[10].superseded] == [("b", "a"), ("c", "b")] and [tuple(x) for x in got[350].superseded] == [("d", "c")]
    assert sum(got[350].states.values()) == len({n for n, _, s in rows if s <= 350})


def test_digests_of_steps_are_read_piece_by_piece(spark, monkeypatch):
    """A step whose texts lie in many ranges and pieces, small steps, and one without any."""
    monkeypatch.setattr(history, "PIECE", 40)
    rng = random.Random(5)
    rows = [(f"n{rng.randrange(10**6)}", f"ö{i}", rng.choice([3, 16, 17, 40])) for i in range(500)] + [("last", "one", 80), ("too", "late", 97)]
    steps = spark.createDataFrame([(s,) for s in (0, 16, 32, 48, 64, 80, 96)], "step long")
    want = {}
    for new, old, seq in rows:
        want.setdefault(-(-seq // 16) * 16, []).append(f"{new}>{old}")
    got = {r.step: r.digest for r in history.step_digests(steps, spark.createDataFrame(rows, "new_id string, old_id string, seq long"), 7).collect()}
    assert got == {s: hashlib.md5(",".join(sorted(x)).encode()).hexdigest() for s, x in want.items() if s <= 96} and len(got) == 4


def test_counts_of_steps_equal_a_replay(spark):
    rows, audit = log(spark, 3)
    steps = [0, 1, 2, 50, 200, 399, 400, 1000]
    got = {r.step: r.states for r in history.step_counts(history.intervals(audit), spark.createDataFrame([(s,) for s in steps + [50]], "step int")).collect()}
    for s in steps:
        now = {node: state for node, state, seq in rows if seq <= s}
        assert got.get(s, {}) == {x: list(now.values()).count(x) for x in set(now.values())}
