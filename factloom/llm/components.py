"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpointed, packed

#: Up to so many edges the least neighbours, one row a node, are broadcast; more meet their edges through a shuffle.
BROADCAST_ROWS = 100_000


def _star(both: DataFrame, large: bool, few: bool) -> DataFrame:
    """One contraction of ``both`` (u, v: for *large* every edge in both directions, else u > v).

    Large star links each larger neighbour of u to the least of u and its neighbours; small star
    links u and its smaller neighbours to the least of them.  Counting and taking the least combine
    before the shuffle, and the join back is a broadcast for a ``few`` edges, or else one that Spark can split where
    one node has very many neighbours.  Edges may repeat: a large star makes no more than it gets, a small star two of each.
    """
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(F.broadcast(least) if few else least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u > v")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v); the root is the least node of its component.

    ``edges`` may hold repeats, both directions, loops and nulls (dropped).  A round costs two
    shuffles of the remaining edges, whose number never grows, and one that drops repeats; the number of rounds is about the
    logarithm of the longest path.  Each round is written to the shared checkpoint folder, in as many parts
    as its edges need: the shuffles of a few edges leave a few files, however many partitions the session has.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    e = checkpointed(e)
    rows = e.count()
    e, mark = packed(e, rows), None
    for _ in range(max_rounds):
        both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        few = rows <= BROADCAST_ROWS
        e = checkpointed(packed(_star(_star(both, True, few), False, few).distinct(), rows))
        # the stars no longer change once their numbers and sums stay
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root"))))).distinct()
        mark, rows = now, now[0]
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
