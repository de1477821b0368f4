"""Filter interaction audit: what each of several filters removes, in every order in which they could run.

A document's failure mask says which filters it fails on its own.  Masks are counted for each part of the
corpus, and a decision diagram holds the counts: a level for each filter, an edge for passing and one for
failing it, equal parts shared, and on each node how many documents, good ones and toxic ones lie below it.
The path that passes everything is a pipeline of the filters in the order of the levels: what hangs on its
failing edges is removed at that step.  Orders are gone through by plain changes, each of which exchanges two
filters that stand next to each other, and such an exchange rebuilds only the two levels it touches.

Texts are read once, in tasks; what is shuffled is a row of numbers a document.  A text's first document is
found by its 128-bit hash: the least doc_id of each hash is taken with combination before the shuffle and
joined back by hash and doc_id together, so that copies of one text don't meet in one task.

Defined cases: a null text is the empty text, a null part the empty string; a null doc_id is no document's
smaller one and has none, and no labels; rows that repeat a doc_id count each, and none of them is smaller than
another; a document with several rows in ``labels`` is good or toxic if any of them says so; nulls there say
nothing; parts without rows give nothing, so an empty table gives an empty result; other columns are ignored,
whatever their names.  A part has 600 rows of result, and the numbers of at most 32 masks meet in its task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpointed

FILTERS = "ABCDE"
#: Least words, least distinct words of 100, most capitals of 100 characters, the signs that no text may hold.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SIGNS = 200, 50, 2, "#$%&*|"

_CAPITALS, _SIGNS = bytes(range(65, 91)), SIGNS.encode()


def failures(text: bytes) -> int:
    """The filters A to D that a text (UTF-8) fails on its own, as bits from the lowest."""
    words = text.split()  # of bytes: at ASCII white space only
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.decode("utf-8", "replace"))
    signs = len(text) - len(text.translate(None, _SIGNS))
    return (len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1 | (100 * capitals > MAX_CAPITALS * points) << 2 | bool(signs) << 3


def _measured(batches: Iterator) -> Iterator:
    import hashlib

    import numpy as np
    import pyarrow as pa

    for batch in batches:
        texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        hashes = np.frombuffer(b"".join(hashlib.sha256(x).digest()[:16] for x in texts), np.int64).reshape(-1, 2)
        masks = pa.array([failures(x) for x in texts], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), masks, pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy())], names=["doc_id", "part", "mask", "h1", "h2"])


def masks(docs: DataFrame, part: str = "source") -> DataFrame:
    """(part, doc_id, mask, n): the failure masks of all filters, with the number of rows that agree in all of it."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    own = read.mapInArrow(_measured, "doc_id long, part string, mask int, h1 long, h2 long")
    counted = checkpointed(own.groupBy("doc_id", "part", "mask", "h1", "h2").agg(F.count("*").alias("n")))
    firsts = counted.where("doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    met = counted.join(firsts, ["h1", "h2", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return met.select("part", "doc_id", (F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"), "n")


class Diagram:
    """A decision diagram over failure masks, with counts: nodes are numbers, 0 the one that nothing reaches.

    ``levels[i]`` holds the nodes that test the filter ``order[i]``, found by what hangs on their passing and failing edges.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], filters: int):
        width = len(next(iter(counts.values()), (0,)))
        self.order, self.levels = list(range(filters)), [{} for _ in range(filters)]
        self.edges: dict[int, tuple[int, int]] = {}
        self.weights: dict[int, tuple[int, ...]] = {0: (0,) * width}
        ends: dict[tuple[int, ...], int] = {(0,) * width: 0}

        def below(level: int, masks: dict[int, tuple[int, ...]]) -> int:
            if not masks:
                return 0
            if level == filters:
                weight = masks.popitem()[1]
                if weight not in ends:
                    ends[weight] = self._new(weight)
                return ends[weight]
            split = [{m: w for m, w in masks.items() if m >> level & 1 == bit} for bit in (0, 1)]
            return self._node(level, below(level + 1, split[0]), below(level + 1, split[1]))

        self.root = below(0, counts)

    def _new(self, weight: tuple[int, ...]) -> int:
        self.weights[len(self.weights)] = weight
        return len(self.weights) - 1

    def _node(self, level: int, passing: int, failing: int) -> int:
        if not passing and not failing:
            return 0
        key = passing, failing
        if key not in self.levels[level]:
            node = self._new(tuple(map(sum, zip(self.weights[passing], self.weights[failing]))))
            self.levels[level][key], self.edges[node] = node, key
        return self.levels[level][key]

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next; the nodes of ``level`` stay what they are for those above."""
        above, self.levels[level], self.levels[level + 1] = self.levels[level], {}, {}
        for (passing, failing), node in above.items():
            (pp, pf), (fp, ff) = self.edges.get(passing, (0, 0)), self.edges.get(failing, (0, 0))
            key = self._node(level + 1, pp, fp), self._node(level + 1, pf, ff)
            self.levels[level][key], self.edges[node] = node, key
        self.order[level : level + 2] = self.order[level + 1], self.order[level]

    def all_pass(self) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, kept, removed) for each step of the path that passes everything."""
        node, steps = self.root, []
        for filter_ in self.order:
            node, out = self.edges.get(node, (0, 0))
            steps.append((filter_, self.weights[node], self.weights[out]))
        return steps


def plain_changes(n: int) -> list[int]:
    """Where to exchange neighbours, one after the other, to go through all orders of ``n`` things."""
    if n < 2:
        return []
    inner, out = plain_changes(n - 1), []
    for turn in range(len(inner) + 1):
        down = turn % 2 == 0  # the first thing goes through all others, down and up by turns
        out += range(n - 2, -1, -1) if down else range(n - 1)
        out += [inner[turn] + down] if turn < len(inner) else []
    return out


def steps(counts: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> Iterator[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders.

    ``counts`` has for each mask the number of documents, good ones and toxic ones.
    """
    diagram, paths = Diagram(counts, len(filters)), []
    for at in [None, *plain_changes(len(filters))]:
        if at is not None:
            diagram.swap(at)
        paths.append(diagram.all_pass())
    fails = {path[0][0]: path[0][2][0] for path in paths}
    alone = {path[-1][0]: path[-1][2][0] for path in paths}
    shapley = dict.fromkeys(fails, 0)
    for path in paths:
        for filter_, _, out in path:
            shapley[filter_] += out[0]
    for path in paths:
        order = "".join(filters[f] for f, _, _ in path)
        for k, (f, kept, out) in enumerate(path, 1):
            yield order, k, kept[0], out[0], fails[f] - out[0], alone[f], out[1], out[2], shapley[f]


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _audited(batches: Iterator) -> Iterator:
    import pyarrow as pa

    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
    for batch in batches:
        for part, met in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist()):
            rows = steps({m["mask"]: (m["n"], m["good"], m["toxic"]) for m in met})
            columns = list(zip(*((part, *row) for row in rows)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step; see :data:`RESULT`."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(m) for c, m in (("quality", "good"), ("toxic", "bad"))])
    met = masks(docs, part).join(marks, "doc_id", "left")
    total = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0)))
    counted = met.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("good").alias("good"), total("bad").alias("toxic"))
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks")).mapInArrow(_audited, RESULT)


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT doc_id, part,
    CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
    + 4 * CAST(100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x) AS INTEGER)
    + 8 * CAST(regexp_matches(x, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false) AS INTEGER) AS mask
  FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
v AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM v a, v b, v c, v d, v e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INTEGER) AS before FROM o, range(1, 6) r(k)),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
