"""Exact top-k search by inner product, score at a time over an impact-ordered index.

Components are quantised to integers.  A block of candidates has an index: the impact of a candidate in
a dimension is how far its component lies from the block's mean there, impacts are quantised into levels, and
a posting segment lists the candidates whose impact in one dimension is of one level.  The segments of a level
are processed together, from the highest level down, for a tile of queries at once; each adds its
candidates' deviation times the query's component to their scores, which begin at the product with the mean.  The
lowest levels list most candidates in most dimensions, and are held as matrices.

What a candidate still lacks is the product of the query with what is left of the candidate's deviation, so it
is at most the product of their two lengths; those of the candidates are in the index, by level.  A candidate
is out for a query once its score and that bound together stay below the kth best score that is sure: of the
candidates of earlier blocks, or for the first block of its own after all levels.  The search of a block stops when scoring those that can still be in costs less than the postings to come, or before the
first level if none can: that bound is the proof for all others, and those that are left are scored exactly, in
integers.
Without such proof all levels are processed, and what the bounds then leave open by rounding is scored exactly.

The index of all candidates is built once, in the tasks that read them, and written.  Queries pass over it in
blocks of bounded size, which are broadcast; a task keeps the ``k`` best of each query over all its
candidate blocks, and the bests of the tasks are merged by a limited window.

Defined cases: vectors that are null or hold null or non-finite components and rows without vec_id take
no part; a query meets candidates of its own length only; rows that repeat a vec_id are candidates of
their own, but never for a query of that vec_id; query rows that repeat in full count once, and rows of one
vec_id with different vectors are queries of their own; ties go to the smaller vec_id; an empty table gives an
empty result; other columns are ignored.  Components and scores beyond 64 bits count as the largest or
smallest 64-bit number.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import checkpointed, ensure_checkpoint_dir, stored

SCALE = 64
K = 20
LEVELS = 4
#: A level that lists more than one in so many candidates and dimensions is held as a matrix instead of lists.
DENSE = 8
QUERY_BLOCK = 16_384
CANDIDATE_BLOCK = 4096
#: Queries whose scores are held at once.
TILE = 512
#: Scoring a pair exactly costs so many times as much, for each dimension, as adding a posting; the search of a block
#: stops once the possible pairs cost less than the postings that are left.
RESCORE = 4
MOST = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of all components, for the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    there = whole.where("vec_id is not null and e is not null and size(e) > 0").where(~F.exists("e", bad))

    def one(x: Column) -> Column:
        return F.when(scale * x >= 2.0**63, MOST).when(scale * x <= -(2.0**63), -MOST).otherwise(F.floor(scale * x)).cast("long")

    return there.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("e", one).alias("v"))


class Index:
    """The postings of one block of candidates."""

    def __init__(self, ids, x, mean, postings, bounds, left):
        """``postings``: positions by level, from the highest, and dimension, cut at ``bounds``; ``left``: what remains by level."""
        self.ids, self.x, self.mean, self.postings, self.bounds, self.left = ids, x, mean, postings, bounds, left
        self.matrices: dict = {}

    @classmethod
    def of(cls, ids, x, levels: int = LEVELS) -> Index:
        """The index of candidates ``ids`` with the rows of ``x`` (int64)."""
        import numpy as np

        mean = x.mean(axis=0)
        off = x - mean
        impact = np.abs(off)
        level = np.minimum(impact * (levels / max(impact.max(initial=0.0), 1e-300)), levels - 1).astype(np.int64)
        dims = x.shape[1]
        group = ((levels - 1 - level) * dims + np.arange(dims)).ravel()
        by = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[by], np.arange(levels * dims + 1))
        square = off * off
        # after all levels nothing is left; a little is added for rounding
        left = np.stack([np.sqrt((square * (level < levels - n)).sum(axis=1)) for n in range(levels + 1)]) * (1 + 1e-6)
        return cls(ids, x, mean, (by // dims).astype(np.int32), bounds.astype(np.int64), left)

    def add(self, level: int, q, scores) -> None:
        """Add what the segments of a level (0: the highest) give for the queries ``q``, a column each, to ``scores``."""
        import numpy as np

        dims = self.x.shape[1]
        cuts = self.bounds[level * dims : (level + 1) * dims + 1]
        lists = [self.postings[a:b] for a, b in zip(cuts, cuts[1:])]
        if DENSE * (cuts[-1] - cuts[0]) > self.x.size:
            if (level, q.dtype) not in self.matrices:
                m = np.zeros(self.x.shape, q.dtype)
                for d, there in enumerate(lists):
                    m[there, d] = self.x[there, d] - self.mean[d]
                self.matrices[level, q.dtype] = m
            scores += self.matrices[level, q.dtype] @ q
            return
        for d, there in enumerate(lists):
            if len(there):
                scores[there] += np.multiply.outer((self.x[there, d] - self.mean[d]).astype(q.dtype), q[d])

    def parts(self) -> dict[str, bytes]:
        """The arrays as bytes, to be stored."""
        return {k: getattr(self, k).tobytes() for k in ("ids", "x", "mean", "postings", "bounds", "left")}

    @classmethod
    def from_parts(cls, dims: int, p: dict[str, bytes]) -> Index:
        import numpy as np

        ids = np.frombuffer(p["ids"], np.int64)
        return cls(ids, np.frombuffer(p["x"], np.int64).reshape(-1, dims), np.frombuffer(p["mean"]), np.frombuffer(p["postings"], np.int32), np.frombuffer(p["bounds"], np.int64), np.frombuffer(p["left"]).reshape(-1, len(ids)))


def exact_scores(q, x):
    """The integer inner products of the rows of ``q`` with those of ``x``, kept within 64 bits."""
    import numpy as np

    if float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * x.shape[1] < 2.0**62:
        return np.einsum("ij,ij->i", q, x)
    sums = (q.astype(object) * x.astype(object)).sum(axis=1)
    return np.array([min(max(s, -MOST), MOST) for s in sums], np.int64)


def search_block(index: Index, queries, query_ids, k: int, sure=None):
    """(query, candidate, score) by position: all candidates that can be among the ``k`` best of a query.

    ``sure`` holds for each query the kth best score that is known from elsewhere.  Also the number of levels that
    were processed.
    """
    import numpy as np

    n, dims = index.x.shape
    size = float(np.abs(index.x.astype(float)).max(initial=0)) * float(np.abs(queries.astype(float)).max(initial=0)) * dims
    kind, err = (np.float32, 2.0**-21) if size < 1e30 else (np.float64, 2.0**-50)
    exact = queries.T.astype(float)
    q = np.ascontiguousarray(exact, kind)
    scores = np.repeat((index.mean @ exact).astype(kind)[None, :], n, axis=0)  # a row for each candidate
    span = np.sqrt((exact * exact).sum(axis=0)) * (1 + 1e-6)
    # what rounding can add up to
    slack = (np.abs(index.mean) @ np.abs(exact) + span * index.left[0].max(initial=0.0)) * (dims + 8) * err
    by_id = np.argsort(index.ids, kind="stable")
    first, last = (np.searchsorted(index.ids[by_id], query_ids, side) for side in ("left", "right"))
    own = np.array([(by_id[j], i) for i in np.flatnonzero(first < last) for j in range(first[i], last[i])], np.int64).reshape(-1, 2)
    levels, unsure = len(index.left) - 1, n > k and (sure is None or not np.isfinite(sure).all())
    bound = np.full(len(query_ids), -np.inf) if sure is None else sure - np.abs(sure) * 2.0**-50
    for level in range(levels + 1):
        if unsure and level == levels:
            low = scores - slack.astype(kind)
            low[own[:, 0], own[:, 1]] = -np.inf
            bound = np.maximum(bound, np.partition(low, n - k, axis=0)[n - k])
        if level == levels or not unsure:
            # upper bounds against the bound, less what the comparison itself may round off
            need = (bound - slack - np.abs(bound) * err).astype(kind)
            possible = scores + np.multiply.outer(index.left[level].astype(kind), span.astype(kind)) >= need
            possible[own[:, 0], own[:, 1]] = False
            if level == levels or RESCORE * dims * possible.sum() <= (index.bounds[-1] - index.bounds[level * dims]) * len(query_ids):
                break
        index.add(level, q, scores)
    what, who = np.nonzero(possible)
    score = np.concatenate([exact_scores(queries[who[i : i + 65536]], index.x[what[i : i + 65536]]) for i in range(0, max(len(who), 1), 65536)])
    return who, what, score, level


class Best:
    """The k best (score, vec_id) of each of a tile of queries so far, best first."""

    def __init__(self, n: int, k: int):
        import numpy as np

        self.k, self.who, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.sure = np.full(n, -np.inf)

    def add(self, who, ids, scores) -> None:
        import numpy as np

        who, ids, scores = (np.concatenate(x) for x in ((self.who, who), (self.ids, ids), (self.scores, scores)))
        by = np.lexsort((ids, -scores, who))
        who = who[by]
        rank = np.arange(len(who)) - np.searchsorted(who, who, "left")
        keep = rank < self.k
        self.who, self.ids, self.scores = who[keep], ids[by][keep], scores[by][keep]
        full = rank[keep] == self.k - 1
        self.sure[self.who[full]] = self.scores[full]


INDEXED = "dims int, ids binary, x binary, mean binary, postings binary, bounds binary, left binary"


def build(vectors: DataFrame, scale: int = SCALE, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The index of ``vectors`` (vec_id, embedding), one row for each block of candidates."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: dict[int, list] = {}

        def block(dims: int, size: int):
            ids, x = (np.concatenate(a) for a in zip(*held[dims]))
            held[dims] = [(ids[size:], x[size:])]
            index = Index.of(ids[:size], x[:size])
            return pa.RecordBatch.from_pylist([{"dims": dims} | index.parts()], schema=_indexed())

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            lengths, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
            ends = np.cumsum(lengths)
            for dims in np.unique(lengths).tolist():
                rows = lengths == dims
                x = flat[np.repeat(rows, lengths)].reshape(-1, dims) if len(ends) else flat.reshape(0, dims)
                held.setdefault(dims, []).append((ids[rows], x))
                while sum(len(i) for i, _ in held[dims]) >= candidate_block:
                    yield block(dims, candidate_block)
        for dims in held:
            if sum(len(i) for i, _ in held[dims]):
                yield block(dims, candidate_block)

    return quantised(vectors, scale).select("vec_id", "v").mapInArrow(run, INDEXED)


def _indexed():
    import pyarrow as pa

    return pa.schema([("dims", pa.int32()), *((n, pa.binary()) for n in ("ids", "x", "mean", "postings", "bounds", "left"))])


def search(index: DataFrame, queries: list[tuple[int, int, list[int]]], k: int) -> DataFrame:
    """(q, vec_id, score): for each of ``queries`` (q, vec_id, v), a block that fits in memory, the best of each task."""
    import numpy as np

    by_dims: dict[int, tuple] = {}
    for dims in {len(v) for _, _, v in queries}:
        rows = [r for r in queries if len(r[2]) == dims]
        by_dims[dims] = tuple(np.array([r[i] for r in rows], np.int64) for i in range(3))
    shared = index.sparkSession.sparkContext.broadcast(by_dims)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bests: dict[tuple[int, int], Best] = {}
        for batch in batches:
            for row in batch.to_pylist():
                numbers, ids, v = shared.value.get(row["dims"], ([], [], []))
                block = Index.from_parts(row["dims"], row) if len(ids) else None
                for at in range(0, len(ids), TILE):
                    best = bests.setdefault((row["dims"], at), Best(len(ids[at : at + TILE]), k))
                    who, what, score, _ = search_block(block, v[at : at + TILE], ids[at : at + TILE], k, best.sure)
                    best.add(who, block.ids[what], score)
        for (dims, at), best in bests.items():
            numbers = shared.value[dims][0][at : at + TILE]
            yield pa.RecordBatch.from_arrays([pa.array(numbers[best.who]), pa.array(best.ids), pa.array(best.scores)], names=["q", "vec_id", "score"])

    return index.mapInArrow(run, "q long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best rows of ``vectors`` for each row of ``queries``.

    Both have vec_id and embedding.
    """
    wanted = checkpointed(quantised(queries, scale).distinct().withColumn("q", F.monotonically_increasing_id()))
    index = stored(build(vectors, scale, candidate_block))
    blocks = -(-wanted.count() // query_block)
    best = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    path = f"{ensure_checkpoint_dir(vectors.sparkSession)}/best-{uuid.uuid4().hex}"
    found = None
    for b in range(max(1, blocks)):
        rows = [(r["q"], r["vec_id"], r["v"]) for r in wanted.where(F.pmod(F.xxhash64("q"), F.lit(max(1, blocks))) == b).collect()]  # about query_block rows
        found = search(index, rows, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if blocks > 1:
            found.write.mode("append").parquet(path)
    if blocks > 1:
        found = vectors.sparkSession.read.schema(found.schema).parquet(path)
    return found.join(wanted.select("q", F.col("vec_id").alias("query_id")), "q").select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
