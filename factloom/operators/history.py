"""States over time: the interval in which a node was in each state, and what held at any step.

An interval of steps is cut into a few dyadic blocks, at most two for each power of two; a step lies in one block of each size.  So the
states at a set of steps are an equal join on blocks, whatever the length of the intervals, and no step needs the log before it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.frames import written
from factloom.operators.ordering import running_total

#: Characters of text in a piece; a batch of pieces that goes to Python has 10,000 of them.
PIECE = 4096


def intervals(audit: DataFrame) -> DataFrame:
    """(node_id, state, since, until) of ``audit`` (node_id, to_state, seq): each state from its step to before the next other one (null: still).

    Rows that change nothing are joined to the interval before them.
    """
    order = W.partitionBy("node_id").orderBy("seq")
    turns = audit.withColumn("_was", F.lag("to_state").over(order)).where(~F.col("to_state").eqNullSafe(F.col("_was")) | F.col("_was").isNull())
    return turns.select("node_id", F.col("to_state").alias("state"), F.col("seq").cast("long").alias("since"), F.lead("seq").over(order).cast("long").alias("until"))


def _blocks(since: Column, until: Column, sizes: int) -> Column:
    """The dyadic blocks (size, block) that make up the steps from ``since`` to before ``until``: block b of size k has the steps from b * 2^k on."""
    one = lambda k, b: F.struct(k.alias("size"), b.alias("block"))
    start = F.struct(since.alias("a"), until.alias("b"), F.array().cast("array<struct<size:int,block:bigint>>").alias("out"))

    def step(state: Column, k: Column) -> Column:
        a, b, out = state["a"], state["b"], state["out"]
        left, right = (a < b) & (a % 2 == 1), (a < b) & (b % 2 == 1)
        more = F.concat(out, F.when(left, F.array(one(k, a))).otherwise(F.array().cast("array<struct<size:int,block:bigint>>")), F.when(right & (b - 1 >= a + left.cast("int")), F.array(one(k, b - 1))).otherwise(F.array().cast("array<struct<size:int,block:bigint>>")))
        return F.struct(F.shiftright(a + left.cast("long"), 1).alias("a"), F.shiftright(b - right.cast("long"), 1).alias("b"), more.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(sizes)), start, step, lambda s: s["out"])


def as_of(known: DataFrame, steps: DataFrame) -> DataFrame:
    """(step, node_id, state): what held at each of ``steps`` (step, not negative), from intervals (node_id, state, since, until)."""
    last = steps.agg(F.max("step")).first()[0]
    end = (last or 0) + 1
    sizes = end.bit_length()
    cut = F.least(F.coalesce("until", F.lit(end)), F.lit(end))
    held = known.where(F.col("since") < end).select("node_id", "state", F.inline(_blocks(F.greatest("since", F.lit(0)), cut, sizes)))
    asked = steps.select(F.col("step").cast("long").alias("step")).distinct().select("step", F.explode(F.sequence(F.lit(0), F.lit(sizes))).alias("size"))
    asked = asked.withColumn("block", F.expr("shiftright(step, size)"))
    return held.join(asked, ["size", "block"]).select("step", "node_id", "state")


def step_counts(known: DataFrame, steps: DataFrame) -> DataFrame:
    """(step, states): a map from each state to the number of nodes that are in it at each of ``steps``, from intervals (node_id, state, since, until).

    Intervals are summed up by their ends; a running sum over those gives the counts, so that no node is a row for each step.
    """
    ends = F.array(*[F.struct(F.col(c).alias("at"), F.lit(d).cast("long").alias("change")) for c, d in (("since", 1), ("until", -1))])
    moves = written(known.select("state", F.inline(ends)).where("at is not null").groupBy("state", "at").agg(F.sum("change").alias("change")))
    asked = moves.select("state").distinct().crossJoin(steps.select(F.col("step").cast("long").alias("at")).distinct()).withColumn("change", F.lit(0).cast("long"))
    told = running_total(moves.withColumn("asked", F.lit(False)).unionByName(asked.withColumn("asked", F.lit(True))), "state", "at", "change", "n")
    held = told.where("asked and n > 0").groupBy(F.col("at").alias("step"))
    return held.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n")))).alias("states"))


def _by_step(steps: DataFrame, superseded: DataFrame) -> DataFrame:
    """``superseded`` (seq, ...) with the ``step`` of ``steps`` (step) that tells it: the first from its seq on."""
    asked = steps.select(F.col("step").cast("long").alias("step")).distinct()
    spans = asked.withColumn("after", F.coalesce(F.lag("step").over(W.orderBy("step")), F.lit(-1)))  # one row a step that is asked for
    return superseded.join(F.broadcast(spans), (F.col("seq") > F.col("after")) & (F.col("seq") <= F.col("step")))


def step_digests(steps: DataFrame, superseded: DataFrame, tasks: int | None = None) -> DataFrame:
    """(step, digest): the MD5 of all *new_id>old_id* since the step before, in their order and with commas between; steps without any have no row.

    Texts are put in order in ranges, and joined to pieces of a few KB; a step's pieces are then read in order into its digest, so that no task holds a step's text.
    """
    tasks = tasks or int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = _by_step(steps, superseded).select("step", F.concat_ws(">", "new_id", "old_id").alias("text"))
    ordered = texts.repartitionByRange(tasks, "step", "text").sortWithinPartitions("step", "text").withColumn("part", F.spark_partition_id())

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fields = [("step", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("piece", pa.binary())]
        step, part, n, held, length = None, 0, 0, [], 0
        for batch in batches:
            out = []
            for at, text, part in zip(*(batch[c].to_pylist() for c in ("step", "text", "part"))):
                if held and (at != step or length > PIECE):
                    out.append((step, part, n, ",".join(held).encode()))
                    n, held, length = n + 1, [], 0
                step = at
                held.append(text)
                length += len(text)
            yield pa.RecordBatch.from_pylist([dict(zip(("step", "part", "n", "piece"), x)) for x in out], pa.schema(fields))
        if held:
            yield pa.RecordBatch.from_pylist([{"step": step, "part": part, "n": n, "piece": ",".join(held).encode()}], pa.schema(fields))

    def digests(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        step, made, out = None, None, []
        for batch in batches:
            for at, piece in zip(batch["step"].to_pylist(), batch["piece"].to_pylist()):
                if at != step:
                    if made:
                        out.append((step, made.hexdigest()))
                    step, made = at, hashlib.md5(piece)
                else:
                    made.update(b",")
                    made.update(piece)
        if made:
            out.append((step, made.hexdigest()))
        yield pa.RecordBatch.from_pydict({"step": pa.array([x[0] for x in out], pa.int64()), "digest": pa.array([x[1] for x in out], pa.string())})

    cut = ordered.mapInArrow(pieces, "step long, part int, n long, piece binary")
    return cut.repartition("step").sortWithinPartitions("step", "part", "n").mapInArrow(digests, "step long, digest string")


def step_report(known: DataFrame, steps: DataFrame, superseded: DataFrame) -> DataFrame:
    """(step, states, superseded): how many nodes are in each state at each of ``steps``, and what was superseded since the step before it.

    ``superseded`` is (new_id, old_id, seq); ``states`` is a map from state to number, ``superseded`` an array of (new_id, old_id) in the order of seq.
    Where a step's array may not fit into memory, :func:`step_digests` tells steps apart.
    """
    asked = steps.select(F.col("step").cast("long").alias("step")).distinct()
    listed = _by_step(steps, superseded).groupBy("step").agg(F.array_sort(F.collect_list(F.struct("seq", "new_id", "old_id"))).alias("rows"))
    told = F.transform(F.coalesce("rows", F.array().cast("array<struct<seq:bigint,new_id:string,old_id:string>>")), lambda x: F.struct(x["new_id"].alias("new_id"), x["old_id"].alias("old_id")))
    return asked.join(step_counts(known, steps), "step", "left").join(listed, "step", "left").select("step", F.coalesce("states", F.create_map().cast("map<string,bigint>")).alias("states"), told.alias("superseded"))
