"""Feeds that are broken off and started again, splits, and the replacement of verified subjects."""

import datetime

import pytest
from pyspark.sql import functions as F

from factloom.operators import feed
from factloom.sources.keyed import KeyedTable


def cases(spark, n=23):
    return spark.createDataFrame([(7 * i + 3, f"case {i}", "é" * i) for i in range(n)], "ordinal long, name string, text string")


def table(spark, path):
    return KeyedTable(spark, f"{path}/table", "name string, n long, ordinal long", ("name",), "ordinal", buckets=4)


def ingest(rows):
    return rows.select("name", F.char_length("text").cast("long").alias("n"), "ordinal")


def everything(t, folder):
    return sorted(map(tuple, t.read().collect())), sorted(map(tuple, t.spark.read.parquet(f"{folder}/holdout").collect())), t.manifest()["tags"]


def test_a_feed_that_breaks_anywhere_goes_on(spark, tmp_path):
    whole = table(spark, tmp_path / "whole")
    assert feed.feed(cases(spark), "ordinal", 0.8, whole, str(tmp_path / "whole"), ingest, size=5) == {"cases": 23, "train": 18, "fed": [0, 1, 2, 3]}
    want = everything(whole, tmp_path / "whole")
    assert len(want[0]) == 18 and len(want[1]) == 5
    for k in (0, 2):
        here, seen = tmp_path / f"k{k}", []

        def breaks(rows, k=k, seen=seen):
            seen.append(1)
            if len(seen) == k + 1:
                raise RuntimeError("killed")
            return ingest(rows)

        with pytest.raises(RuntimeError):
            feed.feed(cases(spark), "ordinal", 0.8, table(spark, here), str(here), breaks, size=5)
        assert feed.feed(cases(spark), "ordinal", 0.8, table(spark, here), str(here), ingest, size=5)["fed"] == list(range(k, 4))
        assert feed.feed(cases(spark), "ordinal", 0.8, table(spark, here), str(here), ingest, size=5)["fed"] == []
        assert everything(table(spark, here), here) == want


def test_batches_that_are_fed_together(spark, tmp_path):
    """One commit for several batches, each ingested by itself; what comes before a batch that fails, when planned or when run, is fed."""
    whole = table(spark, tmp_path / "whole")
    assert feed.feed(cases(spark), "ordinal", 0.8, whole, str(tmp_path / "whole"), ingest, size=2, together=4)["fed"] == list(range(9))
    assert whole.manifest()["version"] == 3
    want = everything(whole, tmp_path / "whole")
    assert len(want[0]) == 18 and want[2] == {"feed": 8}
    seen = []

    def breaks(rows):
        seen.append(rows.count())
        if len(seen) == 7:
            raise RuntimeError("killed")
        return ingest(rows)

    fails = lambda rows: ingest(rows).withColumn("n", F.when(F.col("ordinal") == 7 * 15 + 3, F.raise_error(F.lit("no"))).otherwise(F.col("n")))
    for here, bad, last in ((tmp_path / "plan", breaks, 5), (tmp_path / "run", fails, 6)):
        with pytest.raises(Exception):
            feed.feed(cases(spark), "ordinal", 0.8, table(spark, here), str(here), bad, size=2, together=4)
        assert table(spark, here).manifest()["tags"] == {"feed": last}
        assert feed.feed(cases(spark), "ordinal", 0.8, table(spark, here), str(here), ingest, size=2, together=4)["fed"] == list(range(last + 1, 9))
        assert everything(table(spark, here), here) == want
    assert seen == [2] * 7


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 25])
@pytest.mark.parametrize("least", [True, False])
def test_line_split(spark, n, least):
    parts = feed.line_split(spark.range(n), "id", at_least_one=least).groupBy("part").agg(F.collect_list("id").alias("ids")).collect()
    got = {r.part: r.ids for r in parts}
    a, b = int(n * 0.8), int(n * 0.1)
    if least:
        a, b = max(1, a), (max(1, b) if n > 2 else 0)
    rest = max(n - a - b, 0)
    fill = int(least and n > 0)
    assert [len(got.get(p, [])) for p in ("train", "valid", "test")] == [min(a, n), b or fill, rest or fill]
    assert set(sum(got.values(), [])) == set(range(n))


def test_replace_subjects(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), feed.SUBGRAPH, ("kind", "id"), "seq", buckets=4, deleted="gone")
    day = lambda n: datetime.datetime(2024, 1, n)
    facts = lambda rows: spark.createDataFrame(rows, "subject string, predicate string, object string, state string, sources array<string>, dates array<timestamp>")
    olds = lambda rows: spark.createDataFrame(rows, "subject string, new_predicate string, new_object string, old_predicate string, old_object string")
    first = [("Ann", "Has Gender", "Female", "ACTIVE", ["d1", "d2"], [day(1), day(2)]), ("Ann", "takes", "Aspirin", "ARCHIVED", ["d1"], [day(1)]), ("Bob", "takes", "Aspirin", "ACTIVE", None, None), (None, "x", "y", "ACTIVE", [], [])]
    refused = feed.replace_subjects(t, facts(first), olds([("Ann", "takes", "Zinc", "takes", "Aspirin")]), 1)
    assert refused.count() == 1
    got = {(r.kind, r.id): r for r in t.read().collect()}
    assert set(got) == {("entity", "ann"), ("entity", "bob"), ("record", "rec_ann_has_gender_female"), ("record", "rec_archived_ann_takes_aspirin"), ("record", "rec_bob_takes_aspirin")} | {
        ("edge", f"{a}|{k}|{b}") for a, s, o in (("rec_ann_has_gender_female", "ann", "female"), ("rec_archived_ann_takes_aspirin", "ann", "aspirin"), ("rec_bob_takes_aspirin", "bob", "aspirin")) for k, b in (("SUBJECT", s), ("OBJECT", o))
    }
    r = got["record", "rec_ann_has_gender_female"]
    assert (r.semantic_key, r.state, r.owner_seq, r.source_id, r.mentions, r.valid_from) == ("ann::has_gender::female", "ACTIVE", 1, "d2", 2, day(1))
    # an edge of another subject at a record that goes, and another spelling of the entity
    extra = [("entity", "PT_Ann", None, None), ("edge", "x|Y|rec_ann_has_gender_female", "x", "rec_ann_has_gender_female")]
    t.commit(spark.createDataFrame([(k, i, "other", s, d, *[None] * 7, None, 2) for k, i, s, d in extra], feed.SUBGRAPH))
    again = [("Ann", "takes", "Zinc", "ACTIVE", ["d3"], [day(3)]), ("Ann", "takes", "Aspirin", "ARCHIVED", ["d1"], [day(1)]), ("Ann", "takes", "Aspirin", "ARCHIVED", ["d1", "d4"], [day(1), day(4)])]
    version = t.manifest()["version"]
    assert feed.replace_subjects(t, facts(again), olds([("Ann", "takes", "Zinc", "takes", "aspirin")]), 3).count() == 0
    assert t.manifest()["version"] == version + 1
    got = {(r.kind, r.id): r for r in t.read().collect()}
    assert {i for k, i in got if k == "record"} == {"rec_ann_takes_zinc", "rec_archived_ann_takes_aspirin", "rec_bob_takes_aspirin"} and got["record", "rec_archived_ann_takes_aspirin"].mentions == 2
    assert {i for k, i in got if k == "entity"} == {"ann", "bob"} and ("edge", "rec_ann_takes_zinc|SUPERSEDES|rec_archived_ann_takes_aspirin") in got
    assert not any("female" in i for k, i in got if k == "edge")
