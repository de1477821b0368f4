"""The gate's decisions, as folds, against given heads and on a stream."""

import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from factloom.operators import gate
from factloom.plans import fixtures

SCHEMA = "semantic_key string, predicate string, obj string, tier int, auto_update boolean, valid_from timestamp, source_id string, arrival long"


def drafts(spark, rows):
    """(key, obj, tier, auto, day, arrival) as drafts."""
    df = spark.createDataFrame([(k, "p", o, t, a, d, "s", n) for k, o, t, a, d, n in rows], SCHEMA.replace("timestamp", "int"))
    return df.withColumn("valid_from", F.timestamp_seconds(F.col("valid_from") * 86400))


def decide(rows_before, draft):
    """The rules, one draft at a time."""
    head = None
    for o, t, a, d in [*rows_before, draft]:
        if head is None:
            r = "first version"
        elif o.lower() == head[0].lower():
            r = "identical"
        elif d == head[3]:
            r = "contradiction"
        elif t > head[1] or t == head[1] and d < head[3]:
            r = "precedence"
        elif head[1] == 0 or not (head[2] and a):
            r = "needs review"
        else:
            r = "superseded"
        if r in ("first version", "superseded"):
            head = (o, t, a, d)
    return r


def test_all_pairs_of_head_and_draft(spark):
    cases, rows = list(itertools.product(range(5), range(5), (True, False), (True, False), (1, 2, 3), "xy")), []
    for i, (ht, t, ha, a, d, o) in enumerate(cases):
        rows += [(f"k{i}", "x", ht, ha, 2, 0), (f"k{i}", o, t, a, d, 1)]
    got = {r.semantic_key: r.reason for r in gate.fold(drafts(spark, rows)).where("arrival = 1").collect()}
    assert got == {f"k{i}": decide([("x", ht, ha, 2)], (o, t, a, d)) for i, (ht, t, ha, a, d, o) in enumerate(cases)}
    heads = drafts(spark, [r for r in rows if r[5] == 0])
    judged = {r.semantic_key: r.reason for r in gate.judge(drafts(spark, [r for r in rows if r[5] == 1]), heads).collect()}
    assert judged == got


@pytest.mark.parametrize("rows, want", [
    ([("x", 4, True, 1), ("y", 4, True, 2), ("Y ", 4, True, 3), ("z", 2, True, 1), ("w", 4, True, 9)], ["first version", "superseded", "identical", "superseded", "precedence"]),
    ([("x", 1, False, 1), ("y", 1, True, 2), ("y", 0, True, 3)], ["first version", "needs review", "needs review"]),
    ([("x", 2, True, 5), ("y", 2, True, 5), ("y", 2, True, 6)], ["first version", "contradiction", "superseded"]),
])
def test_chains(spark, rows, want):
    got = gate.fold(drafts(spark, [("k", *r, n) for n, r in enumerate(rows)])).orderBy("arrival").collect()
    assert [r.reason for r in got] == want
    assert [r.owner_seq for r in got] == [sum(w in ("first version", "superseded") for w in want[: i + 1]) - 1 for i in range(len(want))]


def test_malformed(spark):
    df = drafts(spark, [("", "x", 1, True, 1, 0), ("k", "x", 7, True, 1, 1), ("j", None, 1, True, 1, 2), ("ok", "0", 1, True, 1, 3)])
    assert {r.arrival: r.disposition for r in gate.fold(df).collect()} == {0: "REJECT_FAIL_CLOSED", 1: "REJECT_FAIL_CLOSED", 2: "REJECT_FAIL_CLOSED", 3: "AUTO_COMMIT"}
    assert gate.fold(df.limit(0)).count() == 0


def test_steady_form_is_the_fold(spark, sf):
    d = fixtures.event_drafts(spark, sf)
    rows = lambda x: sorted((r.semantic_key, r.arrival, r.disposition, r.owner_seq) for r in x.collect())
    # in the order of instants, as the steady form needs
    assert rows(gate.fold_steady(d)) == rows(gate.fold(d))


def test_partitioning_changes_nothing(spark, sf):
    d = fixtures.order_drafts(spark, sf)
    rows = lambda x: sorted(map(tuple, x.select("semantic_key", "arrival", "reason", "owner_seq").collect()))
    assert rows(gate.fold(d)) == rows(gate.fold(d.repartition(7, "obj")))


def test_aliases(spark):
    df = drafts(spark, [("p::has_sex", "f", 4, True, 1, 0), ("p::has_gender", "f", 4, True, 2, 1), ("p::age", "3", 4, True, 2, 2)])
    assert {r.original_key: r.semantic_key for r in gate.resolve_aliases(df).collect()} == {"p::has_sex": "p::has_sex", "p::has_gender": "p::has_sex", "p::age": "p::age"}


def test_stream_is_the_batch(spark, sf, tmp_path):
    from factloom.streaming import gate as stream_gate

    d = fixtures.event_drafts(spark, sf)
    d.repartitionByRange(3, "arrival").write.parquet(str(tmp_path / "in"))
    q = stream_gate.fold(spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    columns = ("semantic_key", "arrival", "reason", "head_arrival", "owner_seq", "disposition")
    rows = lambda x: sorted(tuple(str(r[c]) for c in columns) for r in x.collect())
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(gate.fold(d))


def test_window_stream_is_the_batch(spark, sf, tmp_path):
    from factloom.streaming import windows

    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "1 day")
    q = stream.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    rows = lambda x: sorted((str(r.window_start), r.event_type, r.n) for r in x.collect())
    assert rows(spark.table("daily")) == rows(windows.tumbling(e, "1 day"))


def test_a_stream_out_of_order_is_the_batch(spark, sf, tmp_path):
    """Files that are shuffled within the delay give the batch's decisions; a draft that comes later comes out as late."""
    import random

    from factloom.plans import fixtures
    from factloom.streaming import gate as stream_gate

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    drafts = fixtures.order_drafts(spark, sf).where("semantic_key < 'customer_12'").orderBy("arrival").limit(120).collect()
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(*r, start + datetime.timedelta(seconds=10 * i)) for i, r in enumerate(drafts)]
    schema = fixtures.order_drafts(spark, sf).schema.add("seen_at", "timestamp")
    rng = random.Random(1)
    mixed = sorted(rows, key=lambda r: (r[-1] - start).total_seconds() + rng.uniform(0, 90))  # out of order by less than 100 seconds
    late = next(r for r in rows if r[0] == mixed[0][0])
    far = lambda k, seconds: (*mixed[-1][:-2], 1 + k, start + datetime.timedelta(seconds=seconds))
    files = [mixed[i : i + 20] for i in range(0, 120, 20)] + [[(*late[:-2], -7, start + datetime.timedelta(seconds=950))], [far(0, 9000)], [far(1, 9001)]]
    (tmp_path / "in").mkdir()
    for n, part in enumerate(files):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "raw" / str(n)))
        (next((tmp_path / "raw" / str(n)).glob("part-*"))).rename(tmp_path / "in" / f"{n}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = stream_gate.ordered_fold(stream, 100).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    got = {r.arrival: (r.semantic_key, r.reason, r.head_arrival, r.owner_seq, r.disposition) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got.pop(-7)[1::3] == ("late", "LATE")
    want = {r.arrival: (r.semantic_key, r.reason, r.head_arrival, r.owner_seq, r.disposition) for r in gate.fold(spark.createDataFrame(drafts, fixtures.order_drafts(spark, sf).schema)).collect()}
    assert {k: v for k, v in got.items() if k > 10} == want and len({v[1] for v in want.values()}) > 2
