"""Non-negative factors of a graph's normalised adjacency, and the most likely edges that aren't there.

The adjacency stays a table of its entries.  A round of multiplicative updates is a join of the entries with the factors and a sum by node,
combined before the shuffle, and the product of a factor matrix with itself, a few numbers that go into the plan.  A pair's
score is at most the product of its two factors' lengths: nodes are put into blocks of similar length, and a pair of
blocks is looked at only if that product reaches the score of pairs that are known to exist.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.frames import bucketed, checkpointed

EPSILON = 1e-9
#: Nodes in a block, and of each side those among which a first bound is sought.
BLOCK, SEED = 2048, 512


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): both directions of the pairs that ``edges`` (src, dst) link, by the roots of both degrees; loops and nulls are left out."""
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    sided = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "n").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "n"))
    degree = sided.groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("d"))
    of = lambda end: degree.select(F.col("node").alias(end), F.col("d").alias(f"d_{end}"))
    return sided.join(of("src"), "src").join(of("dst"), "dst").select("src", "dst", (F.col("n") / F.sqrt(F.col("d_src") * F.col("d_dst"))).alias("weight"))


def _columns(rank: int) -> list[str]:
    return [f"v{i}" for i in range(rank)]


def _started(nodes: DataFrame, side: str, rank: int) -> DataFrame:
    """(node, v0, v1, ...) from hashes, evenly from 0 to 1."""
    return nodes.select("node", *[(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(side), F.col("node").cast("string"), F.lit(str(i)))), 1, 8), 16, 10).cast("double") / float(1 << 32)).alias(c) for i, c in enumerate(_columns(rank))])


def _gram(factors: DataFrame, rank: int) -> list[list[float]]:
    """The products of all columns with each other: rank x rank numbers."""
    cells = [(i, j) for i in range(rank) for j in range(i, rank)]
    row = factors.agg(*[F.sum(F.col(f"v{i}") * F.col(f"v{j}")) for i, j in cells]).first()
    at = {c: x or 0.0 for c, x in zip(cells, row)}
    return [[at[min(i, j), max(i, j)] for j in range(rank)] for i in range(rank)]


def _updated(factors: DataFrame, other: DataFrame, entries: DataFrame, rank: int) -> DataFrame:
    """One multiplicative update of ``factors`` by the node ``src`` of each of ``entries``, with ``other`` by the node ``dst``."""
    gram, names = _gram(other, rank), _columns(rank)
    met = entries.join(other.withColumnRenamed("node", "dst"), "dst")
    sums = met.groupBy(F.col("src").alias("node")).agg(*[F.sum(F.col("weight") * F.col(c)).alias(f"s{i}") for i, c in enumerate(names)])
    below = [sum((F.col(c) * F.lit(gram[j][i]) for j, c in enumerate(names)), F.lit(0.0)) for i in range(rank)]
    return checkpointed(factors.join(sums, "node").select("node", *[(F.col(c) * F.col(f"s{i}") / (below[i] + EPSILON)).alias(c) for i, c in enumerate(names)]))


def factorise(entries: DataFrame, rank: int = 10, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """(node, v0, v1, ...) for the rows and for the columns of ``entries`` (src, dst, weight), which hold both directions of each pair; their product comes near to them.

    Both factors are updated over entries that are stored in buckets of ``dst``: only factors and sums are shuffled in a round, and the other direction is the same table.
    """
    with bucketed(entries.select("src", "dst", "weight"), "dst") as stored:
        rows, columns = (checkpointed(_started(stored.select(F.col("dst").alias("node")).distinct(), side, rank)) for side in "wh")
        for _ in range(rounds):
            rows = _updated(rows, columns, stored, rank)
            columns = _updated(columns, rows, stored, rank)
    return rows, columns


def residual(entries: DataFrame, rows: DataFrame, columns: DataFrame, rank: int) -> float:
    """The squared distance of the product from the matrix of ``entries``, from sums over entries and nodes alone."""
    a, b = (df.select(F.col("node").alias(end), F.array(*_columns(rank)).alias(x)) for df, end, x in ((rows, "src", "a"), (columns, "dst", "b")))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    square, cross = entries.join(a, "src").join(b, "dst").agg(F.sum(F.col("weight") ** 2), F.sum(F.col("weight") * dot)).first()
    g, h = _gram(rows, rank), _gram(columns, rank)
    return (square or 0.0) - 2 * (cross or 0.0) + sum(x * y for p, q in zip(g, h) for x, y in zip(p, q))


def _blocked(factors: DataFrame, rank: int, size: int) -> DataFrame:
    """(node, v, norm, block): blocks hold about ``size`` nodes whose lengths are within a fifth of each other."""
    v = F.array(*_columns(rank))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    levelled = factors.select("node", v.alias("v"), norm.alias("norm")).withColumn("level", F.when(F.col("norm") > 0, F.floor(4 * F.log2("norm"))).otherwise(-10_000))
    counts = levelled.groupBy("level").agg(F.ceil(F.count("*") / size).alias("blocks"))  # one row a level: four for each power of two
    return levelled.join(F.broadcast(counts), "level").select("node", "v", "norm", F.concat_ws(":", "level", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("block"))


def new_edges(entries: DataFrame, rows: DataFrame, columns: DataFrame, k: int, rank: int = 10, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(src, dst, score): the ``k`` pairs of nodes, src < dst, with the highest product of factors that ``entries`` doesn't hold; of equals the least pair."""
    w, h = (checkpointed(_blocked(x, rank, block)) for x in (rows, columns))
    order = (F.desc("score"), "src", "dst")
    # k pairs that exist: none below the least of them can be among the best
    top = lambda df, end, x: df.orderBy(F.desc("norm"), "node").limit(seed).select(F.col("node").alias(end), F.col("v").alias(x))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    some = top(w, "src", "a").crossJoin(top(h, "dst", "b")).where("src < dst").select("src", "dst", dot.alias("score"))  # seed x seed pairs
    known = some.join(entries.select("src", "dst"), ["src", "dst"], "left_anti").orderBy(F.desc("score")).limit(k).agg(F.count("*"), F.min("score")).first()
    bound = known[1] * (1 - 1e-9) if known[0] == k else -1.0
    packed = lambda df, b, all_, most: df.groupBy(F.col("block").alias(b)).agg(F.max("norm").alias(most), F.array_sort(F.collect_list(F.struct("node", "v"))).alias(all_))
    wb, hb = checkpointed(packed(w, "bw", "ws", "mw")), checkpointed(packed(h, "bh", "hs", "mh"))
    pairs = wb.select("bw", "mw").crossJoin(hb.select("bh", "mh")).where(F.col("mw") * F.col("mh") * (1 + 1e-9) >= bound).select("bw", "bh")  # of blocks
    pairs = checkpointed(pairs)
    in_block = lambda df, end, b: df.select(F.col("node").alias(end), F.col("block").alias(b)).join(F.broadcast(pairs.select(b).distinct()), b, "left_semi")
    held = entries.where("src < dst").join(in_block(w, "src", "bw"), "src").join(in_block(h, "dst", "bh"), "dst").join(F.broadcast(pairs), ["bw", "bh"], "left_semi").groupBy("bw", "bh").agg(F.collect_list(F.struct("src", "dst")).alias("held"))
    met = pairs.join(held, ["bw", "bh"], "left").join(wb.select("bw", "ws"), "bw").join(hb.select("bh", "hs"), "bh").select("ws", "hs", "held")

    def best(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                src, dst = (np.array([x["node"] for x in row[c]]) for c in ("ws", "hs"))
                score = np.array([x["v"] for x in row["ws"]]) @ np.array([x["v"] for x in row["hs"]]).T
                open_ = (src[:, None] < dst[None, :]) & (score >= bound)
                for x in row["held"] or []:
                    open_[np.searchsorted(src, x["src"]), np.searchsorted(dst, x["dst"])] = False
                i, j = np.nonzero(open_)
                first = np.lexsort((dst[j], src[i], -score[i, j]))[:k]
                yield pa.RecordBatch.from_arrays([pa.array(src[i][first]), pa.array(dst[j][first]), pa.array(score[i, j][first])], names=["src", "dst", "score"])

    kinds = dict(entries.dtypes)
    return met.mapInArrow(best, f"src {kinds['src']}, dst {kinds['dst']}, score double").orderBy(*order).limit(k)


def sql(edges: str, rank: int, rounds: int) -> str:
    """The common table expressions of the factors after ``rounds``: adj (src, dst, weight), w and h (node, i, v) from ``edges``, a table (src, dst)."""
    start = lambda side, end: f"SELECT node, i, CAST(('0x' || substr(md5('{side}:' || node || ':' || i), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS v FROM (SELECT DISTINCT {end} AS node FROM adj), range({rank}) AS d(i)"
    parts = [
        f"sided AS (SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM {edges} UNION ALL SELECT dst, src FROM {edges}) WHERE src <> dst GROUP BY ALL)",
        "degree AS (SELECT src AS node, sum(n) AS d FROM sided GROUP BY ALL)",
        "adj AS MATERIALIZED (SELECT src, dst, n / sqrt(a.d * b.d) AS weight FROM sided JOIN degree a ON src = a.node JOIN degree b ON dst = b.node)",
        f"w0 AS MATERIALIZED ({start('w', 'src')})",
        f"h0 AS MATERIALIZED ({start('h', 'dst')})",
    ]
    for n in range(rounds):
        for new, old, other, near, far in ((f"w{n + 1}", f"w{n}", f"h{n}", "src", "dst"), (f"h{n + 1}", f"h{n}", f"w{n + 1}", "dst", "src")):
            parts.append(f"""{new} AS MATERIALIZED (WITH g AS (SELECT x.i, y.i AS j, sum(x.v * y.v) AS g FROM {other} x JOIN {other} y USING (node) GROUP BY ALL),
  s AS (SELECT {near} AS node, i, sum(weight * v) AS s FROM adj JOIN {other} ON {far} = node GROUP BY ALL),
  b AS (SELECT node, g.j AS i, sum(v * g) AS b FROM {old} o JOIN g ON o.i = g.i GROUP BY ALL)
  SELECT node, i, v * s / (b + {EPSILON}) AS v FROM {old} JOIN s USING (node, i) JOIN b USING (node, i))""")
    return ",\n".join(parts)
