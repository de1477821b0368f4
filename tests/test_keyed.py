"""Tables that several writers and streams keep up."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.sources import keyed

SCHEMA = "semantic_key string, record_id string, owner string, owner_seq long"


def table(spark, path, **more):
    return keyed.KeyedTable(spark, str(path), SCHEMA, ("semantic_key",), "owner_seq", buckets=8, **more)


def moves(spark, rows):
    return spark.createDataFrame(rows, SCHEMA + ", writer string")


def heads(t):
    return {r.semantic_key: (r.record_id, r.owner_seq) for r in t.read().collect()}


def test_one_of_two_writers_loses_and_nothing_is_lost(spark, tmp_path):
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    t.commit(moves(spark, [("a", "a1", "w", 1, "w"), ("b", "b1", "w", 1, "w")]), keyed.judge_heads)
    tried = []

    def slow(rows, current):
        tried.append(other.manifest()["version"])
        if len(tried) == 1:  # the other writer commits after this one has read the table
            assert other.commit(moves(spark, [("a", "a3", "w", 3, "w"), ("c", "c1", "v", 1, "v")]), keyed.judge_heads)[0] == 2
        return keyed.judge_heads(rows, current)

    version, conflicts = t.commit(moves(spark, [("a", "a2", "w", 2, "w"), ("b", "b2", "w", 2, "w"), ("c", "x", "v", 9, "w")]), slow)
    assert version == 3 and tried == [1, 2]
    assert sorted((r.record_id, r.fault) for r in conflicts.collect()) == [("a2", "head has moved"), ("x", "other owner")]
    assert heads(t) == heads(other) == {"a": ("a3", 3), "b": ("b2", 2), "c": ("c1", 1)}


def test_moves_of_one_batch_go_up(spark, tmp_path):
    t = table(spark, tmp_path)
    _, conflicts = t.commit(moves(spark, [("a", "y", "w", 1, "w"), ("a", "x", "w", 1, "w"), ("a", "z", "w", 2, "w"), ("b", "n", None, 1, "w")]), keyed.judge_heads)
    assert sorted((r.record_id, r.fault) for r in conflicts.collect()) == [("n", "other owner"), ("y", "repeated")] and heads(t) == {"a": ("z", 2)}
    version, conflicts = t.commit(moves(spark, [("a", "old", "w", 2, "w")]), keyed.judge_heads)
    assert version == 2 and [r.fault for r in conflicts.collect()] == ["head has moved"] and heads(t) == {"a": ("z", 2)}


def test_a_commit_writes_the_buckets_that_it_touches(spark, tmp_path):
    t = table(spark, tmp_path, depth=2)
    rows = lambda keys, seq: spark.createDataFrame([(k, f"{k}{seq}", "w", seq) for k in keys], SCHEMA)
    t.commit(rows([f"k{i}" for i in range(60)], 1))
    before = t.manifest()["sets"]
    assert len(before) == 8
    for seq in (2, 3, 4, 5):
        t.commit(rows(["k7", "k8"], seq))
    after = t.manifest()["sets"]
    changed = {b for b in after if after[b] != before[b]}
    assert 1 <= len(changed) <= 2 and all(len(after[b]) <= 2 for b in after)
    assert heads(t) == {f"k{i}": (f"k{i}{5 if i in (7, 8) else 1}", 5 if i in (7, 8) else 1) for i in range(60)}


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    rows = spark.createDataFrame([("a", "a1", "w", 1)], SCHEMA)
    assert t.commit(rows, source="s", tag=0)[0] == 1 and t.commit(rows, source="s", tag=0)[0] == 1 and t.commit(rows, source="other", tag=0)[0] == 2


def test_a_failed_commit_leaves_the_table(spark, tmp_path):
    t = table(spark, tmp_path)
    t.commit(spark.createDataFrame([("a", "a1", "w", 1)], SCHEMA))
    with pytest.raises(ZeroDivisionError):
        t.commit(spark.createDataFrame([("a", "a2", "w", 2)], SCHEMA), lambda rows, current: 1 / 0)
    t._write(t._bucketed(spark.createDataFrame([("a", "a3", "w", 3)], SCHEMA)))  # files without a manifest
    assert heads(t) == {"a": ("a1", 1)} and t.manifest()["version"] == 1


def test_deletes_and_empty_tables(spark, tmp_path):
    t = keyed.KeyedTable(spark, str(tmp_path), "k long, v string, seq long, gone boolean", ("k",), "seq", deleted="gone")
    assert t.read().count() == 0
    t.commit(spark.createDataFrame([(1, "x", 1, False), (2, "y", 1, None), (2, "z", 3, True), (1, "w", 2, False)], t.schema))
    assert [(r.k, r.v) for r in t.read().collect()] == [(1, "w")]
    t.commit(spark.createDataFrame([], t.schema))
    t.commit(spark.createDataFrame([(2, "back", 4, False)], t.schema))
    assert sorted((r.k, r.v) for r in t.read().collect()) == [(1, "w"), (2, "back")]


def test_a_stream_that_is_stopped_and_started(spark, tmp_path):
    src, t = tmp_path / "in", table(spark, tmp_path / "t", depth=3)
    src.mkdir()
    for n in range(4):
        (src / f"{n}.json").write_text("\n".join(json.dumps({"semantic_key": f"k{i % 5}", "record_id": f"r{n}-{i}", "owner": "w", "owner_seq": 10 * n + i}) for i in range(10)))
    for _ in range(2):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))
        t.follow(stream, "s").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert t.manifest()["version"] == 4 and t.manifest()["tags"] == {"s": 3}
    assert heads(t) == {f"k{i}": (f"r3-{5 + i}", 35 + i) for i in range(5)}
    # the last batch again, as after a failure between its manifest and the stream's own log
    t.commit(spark.read.schema(SCHEMA).json(str(src / "3.json")).withColumn("record_id", F.lit("wrong")), source="s", tag=3)
    assert heads(t)["k0"] == ("r3-5", 35)
