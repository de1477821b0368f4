"""Hard negatives: for each anchor and each of its nearest rows of the same label, the nearest rows of other labels that are
less near by a set ratio.

All scores of an anchor, highest first, make a stream: a row of the anchor's label is a positive, for as long as
there are too few, and opens a window of scores below its own; a row of another label goes to each window that it falls in
and that isn't full.  The stream is the order of a secondary sort: keys are packed from the anchor, the
descending score, the kind of row and its id, dealt by the anchor, and sorted within the tasks by the shuffle
itself.  A task walks its keys once, holding the open windows of one anchor and nothing else.

Most scores can't be of use and never enter that shuffle.  Vectors are packed into blocks, and blocks of anchors meet all
blocks of rows in tasks: once to find the positives, of which each task keeps the best of each anchor, and once more with
the windows of those positives, of which each task keeps the best of each window.  What a task leaves
out has better rows before it in the same window, so the walk gives what it would give over all scores.  Nothing passes through the
driver; blocks have a fixed number of rows, and the anchors are stated rows, so the work is anchors times rows.

Defined cases: rows with a null vec_id, label or vector, an empty vector, or a null or non-finite component take no part;
rows meet rows of their own length only; an anchor is never its own positive or negative, nor are other rows of its
vec_id; apart from that rows that repeat a vec_id are rows of their own, also as positives and negatives; anchors that
repeat in full count once, and anchors of one vec_id with different labels or vectors are mined each; ties go to the smaller
vec_id; a window that no score can meet (a positive with a negative score) is empty; an empty table gives an empty
result; other columns are ignored, whatever their names.  Components and scores beyond 64 bits count as the largest or smallest 64-bit number.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import checkpointed, stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score, in percent of the positive's.
LOW, HIGH = 50, 95
ANCHOR_BLOCK, ROW_BLOCK = 1024, 2048
#: Blocks in a task that packs them.
PACK = 8
MOST = (1 << 63) - 1
NONE = -(1 << 63)


def rows(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, tag, label, v): floor(scale * x) of all components of the rows that take part; ``tag`` is a hash of label and vector."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    def one(x: Column) -> Column:
        return F.when(scale * x >= 2.0**63, MOST).when(scale * x <= -(2.0**63), -MOST).otherwise(F.floor(scale * x)).cast("long")

    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    there = whole.where("vec_id is not null and label is not null and e is not null and size(e) > 0").where(~F.exists("e", bad))
    return there.select("vec_id", "label", F.transform("e", one).alias("v")).select("vec_id", F.xxhash64("label", "v").alias("tag"), "label", "v")


BLOCK = "dims int, ids binary, tags binary, labels binary, x binary, windows binary"


def blocks(table: DataFrame, size: int) -> DataFrame:
    """``table`` (vec_id, tag, label, v, and the scores of an anchor's positives as ``near``) in blocks of at most ``size`` rows of one length, each ascending by vec_id."""
    tasks = max(1, -(-table.count() // (size * PACK)))
    near = [F.col("near")] if "near" in table.columns else [F.array().cast("array<bigint>").alias("near")]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def block(dims: int, held: list):
            held.sort(key=lambda r: r[0])
            ids, tags, labels, v, near = zip(*held)
            numbers = lambda x: np.array(x, np.int64).tobytes()
            bounds = numbers([[window(s) for s in n] + [(MOST, NONE)] * (POSITIVES - len(n)) for n in near]) if near[0] else None
            return pa.RecordBatch.from_pylist([{"dims": dims, "ids": numbers(ids), "tags": numbers(tags), "labels": numbers(labels), "x": numbers(v), "windows": bounds}], schema=_block())

        held: dict[int, list] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                mine = held.setdefault(len(row[3]), [])
                mine.append(row)
                if len(mine) == size:
                    yield block(len(row[3]), held.pop(len(row[3])))
        for dims, mine in held.items():
            yield block(dims, mine)

    return table.select("vec_id", "tag", "label", "v", *near).repartition(tasks).mapInArrow(run, BLOCK)


def _block():
    import pyarrow as pa

    return pa.schema([("dims", pa.int32()), *((n, pa.binary()) for n in ("ids", "tags", "labels", "x", "windows"))])


def window(positive: int) -> tuple[int, int]:
    """The least and greatest score of a negative for a positive of this score."""
    return -((-LOW * positive) // 100), HIGH * positive // 100


def scores(q, x):
    """The integer inner products of the rows of ``q`` with those of ``x`` (int64), kept within 64 bits."""
    import numpy as np

    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    if most < 2.0**62:
        return q @ x.T
    exact = q.astype(object) @ x.T.astype(object)
    return np.array([[min(max(s, -MOST), MOST) for s in row] for row in exact], np.int64).reshape(exact.shape)


class Best:
    """For each anchor of a block and each of its windows the best rows of the window so far: score, id and row number."""

    def __init__(self, anchors: int, windows: int, k: int):
        import numpy as np

        self.k = k
        self.score, self.id, self.at = np.full((anchors, windows, k), NONE), np.zeros((anchors, windows, k), np.int64), np.zeros((anchors, windows, k), np.int64)

    def add(self, w: int, found, ids, base: int) -> None:
        """Take the best of ``found``, scores by anchor and row of a block with ascending ``ids``, into the window ``w``; :data:`NONE` is no score."""
        import numpy as np

        who = np.flatnonzero((found > self.score[:, w, -1:]).any(axis=1) | ((found == self.score[:, w, -1:]) & (found > NONE)).any(axis=1))
        found = found[who]
        score, id_, at = ([x[who, w]] for x in (self.score, self.id, self.at))
        for _ in range(min(self.k, found.shape[1])):
            j = found.argmax(axis=1)  # of equals the first, which has the smallest id
            score.append(found[np.arange(len(who)), j][:, None])
            id_.append(ids[j][:, None])
            at.append(j[:, None] + base)
            found[np.arange(len(who)), j] = NONE
        score, id_, at = (np.concatenate(x, axis=1) for x in (score, id_, at))
        # descending score: its complement doesn't overflow
        by = np.lexsort((at, id_, ~score), axis=1)[:, : self.k]
        self.score[who, w], self.id[who, w], self.at[who, w] = (np.take_along_axis(x, by, axis=1) for x in (score, id_, at))

    def rows(self):
        """(anchor's place, id, score) of all that is kept, a row of several windows once."""
        import numpy as np

        there = self.score > NONE
        who, at = np.nonzero(there)[0], self.at[there]
        by = np.lexsort((at, who))
        first = np.ones(len(by), bool)
        first[1:] = (np.diff(who[by]) != 0) | (np.diff(at[by]) != 0)
        by = by[first]
        return who[by], self.id[there][by], self.score[there][by]


def meet(candidates: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(anchor_id, tag, vec_id, score) of the ``k`` best rows of each window of each anchor within a task.

    Anchors without windows get the rows of their own label, with windows those of other labels.
    """
    mine = anchors.select(F.monotonically_increasing_id().alias("a"), *[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    pairs = candidates.crossJoin(mine)  # of blocks, of the stated anchors with all rows; lengths are compared below, as a join key they would all go to one task

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bests: dict = {}
        base = 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["dims"] != r["a_dims"]:
                    continue
                read = lambda name: np.frombuffer(r[name], np.int64)  # noqa: B023, E731
                a_ids, ids, windows = read("a_ids"), read("ids"), r["a_windows"] and read("a_windows").reshape(len(read("a_ids")), -1, 2)
                if r["a"] not in bests:
                    bests[r["a"]] = a_ids, read("a_tags"), Best(len(a_ids), 1 if windows is None else windows.shape[1], k)
                best = bests[r["a"]][2]
                all_ = scores(read("a_x").reshape(len(a_ids), -1), read("x").reshape(len(ids), -1))
                same = read("a_labels")[:, None] == read("labels")[None, :]
                others = a_ids[:, None] != ids[None, :]
                if windows is None:
                    best.add(0, np.where(same & others, all_, NONE), ids, base)
                else:
                    all_[same | ~others] = NONE
                    for w in range(windows.shape[1]):
                        low, high = windows[:, w, 0, None], windows[:, w, 1, None]
                        best.add(w, np.where((all_ >= low) & (all_ <= high), all_, NONE), ids, base)
                base += len(ids)
        for a_ids, tags, best in bests.values():
            who, id_, score = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a_ids[who], tags[who], id_, score)], names=["anchor_id", "tag", "vec_id", "score"])

    return pairs.mapInArrow(run, "anchor_id long, tag long, vec_id long, score long")


#: Anchor, its tag, descending score, 0 for a positive and 1 for another label, id: as unsigned numbers, most significant byte first.
_KEY = struct.Struct(">QQQBQ")
_DEALT = 16


def packed(anchor: int, tag: int, score: int, other: int, id_: int) -> bytes:
    """A key whose order as bytes is that of anchor, tag, descending score, kind and id."""
    return _KEY.pack(anchor + (1 << 63), tag + (1 << 63), MOST - score, other, id_ + (1 << 63))


def unpacked(key: bytes) -> tuple[int, int, int, int, int]:
    anchor, tag, score, other, id_ = _KEY.unpack(key)
    return anchor - (1 << 63), tag - (1 << 63), MOST - score, other, id_ - (1 << 63)


def walk(keys: Iterator[bytes], positives: int = POSITIVES, negatives: int = NEGATIVES) -> Iterator[tuple]:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from sorted keys, holding one anchor's open windows."""
    now, opened, open_ = None, 0, []
    for key in keys:
        anchor, tag, score, other, id_ = unpacked(key)
        if (anchor, tag) != now:
            now, opened, open_ = (anchor, tag), 0, []
        if not other:
            if opened < positives:
                opened += 1
                open_.append([id_, score, *window(score), 0])
            continue
        for w in open_:
            if w[2] <= score <= w[3]:
                w[4] += 1
                yield anchor, w[0], w[4], id_, w[1], score
        open_ = [w for w in open_ if w[4] < negatives and w[2] <= score]  # those that are full or that the scores have passed are closed


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def secondary_sort(pairs: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """The walk over all of ``pairs`` (anchor_id, tag, vec_id, score, other)."""
    import zlib

    spark = pairs.sparkSession
    keyed = pairs.select("anchor_id", "tag", "score", "other", "vec_id").rdd.map(lambda r: (packed(*r), None))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionAndSortWithinPartitions(tasks, lambda key: zlib.crc32(key[:_DEALT]))
    found = dealt.mapPartitions(lambda part: walk((k for k, _ in part), positives, negatives))
    return spark.createDataFrame(found, RESULT, verifySchema=False)


def mine(vectors: DataFrame, anchors: DataFrame, scale: int = SCALE, anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """The hard negatives of the rows of ``anchors`` among those of ``vectors``; both have vec_id, embedding and label."""
    candidates = stored(blocks(rows(vectors, scale), row_block))
    wanted = stored(rows(anchors, scale).dropDuplicates(["vec_id", "tag"]))
    best = W.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "vec_id")
    near = meet(candidates, stored(blocks(wanted, anchor_block)), POSITIVES).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= POSITIVES)
    near = checkpointed(near.drop("rank"))
    open_ = near.groupBy(F.col("anchor_id").alias("vec_id"), "tag").agg(F.sort_array(F.collect_list("score"), asc=False).alias("near"))
    far = meet(candidates, stored(blocks(wanted.join(open_, ["vec_id", "tag"]), anchor_block)), NEGATIVES)
    return secondary_sort(near.withColumn("other", F.lit(0)).unionByName(far.withColumn("other", F.lit(1))))


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
