"""A lineage that stays without cycles, and its closure, kept up as edges are appended.

Every node has a rank, and each edge goes from a higher to a lower one.  A batch of edges that agree with the ranks can
make no cycle, and costs two joins.  Only an edge against the ranks starts a search, which is bounded by the ranks it spans: the nodes that
lie on a path from the end of such an edge to the beginning of one are the affected region, and only edges within it are judged.

The closure is an append-only table: each batch adds the pairs that it brings nearer, found by composing what reached a new
edge, the edge, and what its end reached, once for each further new edge on a path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.frames import written
from factloom.operators import graph

ROUNDS = 100_000
#: Keys that are broadcast.
FEW = 100_000


def _raised(edges: DataFrame, ranks: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, rank) of all nodes that must be raised above ``ranks`` (node, rank) once ``seeds`` (node, rank) are, over edges (src, dst) without cycles."""
    front = changed = written(seeds)
    for _ in range(ROUNDS):
        need = front.join(edges, front["node"] == edges["dst"]).groupBy("src").agg((F.max("rank") + 1).alias("need"))
        of = lambda df, name: df.select(F.col("node").alias("src"), F.col("rank").alias(name))
        known = need.join(of(ranks, "old"), "src", "left").join(of(changed, "new"), "src", "left")
        front = written(known.where(F.col("need") > F.coalesce(F.greatest("old", "new"), F.lit(-1))).select(F.col("src").alias("node"), F.col("need").alias("rank")))
        if front.isEmpty():
            return changed
        changed = written(changed.join(front.select("node"), "node", "left_anti").unionByName(front))
    raise ValueError("ranks don't settle: the edges have a cycle")


def _over(ranks: DataFrame, changed: DataFrame) -> DataFrame:
    """``ranks`` with the rows of ``changed`` in the place of theirs."""
    return ranks.join(changed.select("node"), "node", "left_anti").unionByName(changed)


def _at(nodes: DataFrame, rank: int) -> DataFrame:
    """(node, rank) of the distinct ``nodes`` (node), all of one rank; an aggregate, as Spark loses track of a checkpointed constant in later joins."""
    return nodes.groupBy("node").agg(F.max(F.lit(rank).cast("long")).alias("rank"))


def ranks(edges: DataFrame) -> DataFrame:
    """(node, rank) of all nodes of ``edges`` (src, dst), which have no cycle: the longest way down.

    Nodes are taken away from below: those whose edges have all gone are next, so that a round looks at the edges that are left and at no rank found before.
    """
    named = lambda df, c: df.select(F.col(c).alias("node"))
    left = written(edges.select("src", "dst").dropna().distinct())
    ready = written(named(left, "dst").distinct().join(named(left, "src"), "node", "left_anti"))
    found = _at(ready, 0)
    for rank in range(1, ROUNDS):
        if left.isEmpty():
            return written(found)
        low = ready.withColumnRenamed("node", "dst")
        rest = written(left.join(low, "dst", "left_anti").select("src", "dst"))
        ready = written(named(left.join(low, "dst", "left_semi"), "src").distinct().join(named(rest, "src"), "node", "left_anti"))
        if ready.isEmpty():
            break
        found, left = found.unionByName(_at(ready, rank)), rest
        if rank % 32 == 0:
            found = written(found)
    raise ValueError("ranks don't settle: the edges have a cycle")


def _reached(edges: DataFrame, start: DataFrame, src: str, dst: str) -> DataFrame:
    """(node) of ``start`` (node) and all that edges lead to from ``src`` to ``dst``."""
    seen = front = written(start.distinct())
    while not front.isEmpty():
        front = written(front.join(edges, front["node"] == edges[src]).select(F.col(dst).alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = seen.unionByName(front)
    return seen


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")


def _place() -> Column:
    """When an edge of a batch comes: by seq, of equals by its ends."""
    return F.struct(F.col("seq").cast("long").alias("seq"), F.col("src").alias("src"), F.col("dst").alias("dst"))


def _judged(base: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(admitted, refused) of ``asked`` (src, dst, seq), added to ``base`` (src, dst) one by one in their order.

    An edge is refused if a way leads back over edges that are sure and came before it, and admitted if none does even over those that
    are still open; what is neither waits for the next round.  The first open edge is always settled.
    """
    admitted, refused, open_ = asked.limit(0), asked.limit(0), written(asked)
    kind = open_.select(_place().alias("at")).schema["at"].dataType
    old = base.select("src", "dst", F.lit(None).cast(kind).alias("at"), F.lit(True).alias("sure"))
    while not open_.isEmpty():
        step = lambda df, sure: df.select("src", "dst", _place().alias("at"), F.lit(sure).alias("sure"))
        steps = written(old.unionByName(step(admitted, True)).unionByName(step(open_, False)).withColumnsRenamed({"src": "from", "dst": "to", "at": "when", "sure": "firm"}))
        front = seen = written(open_.select(_place().alias("e"), F.col("src").alias("goal"), F.col("dst").alias("node"), F.lit(True).alias("sure")))
        while not front.isEmpty():
            on = (F.col("node") == F.col("from")) & (F.col("when").isNull() | (F.col("when") < F.col("e"))) & (F.col("node") != F.col("goal"))
            ways = front.join(steps, on).groupBy("e", "goal", F.col("to").alias("node")).agg(F.max(F.col("sure") & F.col("firm")).alias("sure"))
            met = ways.join(seen.select("e", "node", F.col("sure").alias("was")), ["e", "node"], "left").where(F.col("was").isNull() | (F.col("sure") & ~F.col("was")))
            front = written(met.select("e", "goal", "node", "sure"))
            seen = written(seen.join(front.select("e", "node"), ["e", "node"], "left_anti").unionByName(front))
        back = seen.where("node = goal").select("e.src", "e.dst", "sure")
        told = written(open_.join(back, ["src", "dst"], "left"))
        admitted = admitted.unionByName(told.where("sure is null").drop("sure"))
        refused = refused.unionByName(told.where("sure").drop("sure"))
        open_ = told.where("not sure").drop("sure")
    return admitted, refused


def admit(edges: DataFrame, known: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(admitted, refused, ranks) of a ``batch`` (src, dst, seq) for ``edges`` (src, dst) with the ranks ``known`` (node, rank).

    The same as adding the edges one by one in the order of seq, of equals by their ends: an edge that would close a cycle is
    refused, with ``reason`` *loop* or *cycle*, and those after it are judged without it.  ``admitted`` has src, dst and seq of new
    edges; a repeated edge counts at its first place, edges that are there already and edges without an end are neither.
    """
    new = batch.select("src", "dst", F.col("seq").cast("long").alias("seq")).dropna(subset=["src", "dst"]).groupBy("src", "dst").agg(F.min("seq").alias("seq"))
    new = written(new.join(edges.select("src", "dst"), ["src", "dst"], "left_anti"))
    loops = new.where("src = dst").withColumn("reason", F.lit("loop"))
    new = new.where("src <> dst")
    # a new node stands above what it points at; a few steps are enough for most batches, and wrong ranks cost a search only
    fresh = written(_at(new.select(F.explode(F.array("src", "dst")).alias("node")).join(known, "node", "left_anti"), 0))
    for _ in range(3):
        of = known.unionByName(fresh).select(F.col("node").alias("dst"), "rank")
        above = new.join(of, "dst").groupBy(F.col("src").alias("node")).agg((F.max("rank") + 1).alias("above"))
        fresh = written(fresh.join(above, "node", "left").select("node", F.greatest("rank", F.coalesce("above", "rank")).alias("rank")))
    ranked = known.select("node", "rank").unionByName(fresh)
    end = lambda name: ranked.select(F.col("node").alias(name), F.col("rank").alias(f"rank_{name}"))
    new = written(new.join(end("src"), "src").join(end("dst"), "dst"))
    against = new.where("rank_src <= rank_dst")
    low = against.agg(F.min("rank_src")).first()[0]
    plain = new.select("src", "dst", "seq")
    if low is None:
        return plain, loops, ranked
    # below the lowest beginning of an edge against the ranks no way leads back to one
    window = written(edges.select("src", "dst").join(end("dst"), "dst").where(F.col("rank_dst") >= low).select("src", "dst"))
    ways = written(window.unionByName(new.where(F.col("rank_dst") >= low).select("src", "dst")))
    after = written(_reached(ways, against.select(F.col("dst").alias("node")), "src", "dst"))
    both = written(_reached(_within(ways, after), against.select(F.col("src").alias("node")).join(after, "node", "left_semi"), "dst", "src"))
    asked = written(_within(plain, both))
    admitted, refused = _judged(written(_within(window, both)), asked)
    admitted = written(plain.join(asked.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(admitted))
    seeds = admitted.join(against.select("src", "dst", "rank_dst"), ["src", "dst"]).groupBy(F.col("src").alias("node")).agg((F.max("rank_dst") + 1).alias("rank"))
    changed = _raised(written(edges.select("src", "dst").unionByName(admitted.select("src", "dst"))), written(ranked), seeds)
    return admitted, loops.unionByName(refused.withColumn("reason", F.lit("cycle"))), written(_over(ranked, changed))


def nearest(reached: DataFrame) -> DataFrame:
    """(root, node, depth) with the least depth of each pair: how a closure with appended deltas is read."""
    return reached.groupBy("root", "node").agg(F.min("depth").alias("depth"))


def _delta(reached: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, nearer): the rows (root, node, depth) of :func:`closure_delta`, a pair perhaps at several depths, and the pairs (root, node) of ``reached`` that they bring nearer."""
    edges = written(new.select("src", "dst").dropna().where("src <> dst").distinct())
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("root")).distinct()
    own = written(nodes.join(reached.where("depth = 0").select("root"), "root", "left_anti").select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))
    old = written(reached.where("depth = 1").select(F.col("root").alias("src"), F.col("node").alias("dst")))  # the edges so far
    ends, begins = (edges.select(F.col(c).alias("root")).distinct() for c in ("dst", "src"))
    beyond = written(graph.closure(old, ends).withColumnsRenamed({"root": "dst", "node": "far", "depth": "more"}))
    back = graph.closure(old.select(F.col("dst").alias("src"), F.col("src").alias("dst")), begins)
    front = back.select(F.col("node").alias("root"), F.col("root").alias("node"), "depth")
    found, nearer = own, own.select("root", "node").limit(0)
    while True:
        steps = front.join(edges, front["node"] == edges["src"]).select("root", "dst", (F.col("depth") + 1).alias("depth"))
        ways = written(nearest(steps.join(beyond, "dst").select("root", F.col("far").alias("node"), (F.col("depth") + F.col("more")).alias("depth"))))
        was = nearest(found.join(ways.select("root", "node"), ["root", "node"], "left_semi").unionByName(written(_known(reached, ways.join(own.select("root"), "root", "left_anti")))))
        front = written(ways.join(was.withColumnRenamed("depth", "was"), ["root", "node"], "left").where(F.col("was").isNull() | (F.col("depth") < F.col("was"))))
        if front.isEmpty():
            return found, nearer
        nearer = nearer.unionByName(front.where("was is not null").select("root", "node"))
        front = front.drop("was")
        found = written(found.unionByName(front))


def _known(reached: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``reached`` of the pairs (root, node): with few of them, or of roots or nodes, no row of ``reached`` is shuffled that can't be one."""
    asked = written(pairs.select("root", "node").distinct())
    n = asked.count()
    if not n:
        return reached.limit(0)
    if n <= FEW:
        return reached.join(F.broadcast(asked), ["root", "node"], "left_semi")
    for end in ("node", "root"):
        some = written(asked.select(end).distinct())
        if some.count() <= FEW:
            reached = reached.join(F.broadcast(some), end, "left_semi")
            break
    return reached.join(asked, ["root", "node"], "left_semi")


def closure_delta(reached: DataFrame, new: DataFrame) -> DataFrame:
    """The rows (root, node, depth) that new edges ``new`` (src, dst) add to the closure ``reached`` (root, node, depth) of all nodes.

    ``reached`` may hold a pair at several depths, the least counts.  A round composes what the last one found with one more new
    edge and with what its end reached before; only pairs that came nearer go on, so that there are as many rounds as new edges on a shortest way.
    What led to the beginnings of new edges and what their ends reached is found over the closure's own edges, its pairs of depth 1; the closure is read, and shuffled only
    as far as its pairs are compared, never for nodes that it doesn't have.
    """
    return nearest(_delta(reached, new)[0])


def appended(reached: DataFrame, new: DataFrame) -> DataFrame:
    """The closure ``reached`` (root, node, depth), a row a pair, after new edges ``new`` (src, dst): its own rows but for pairs that came nearer, and the delta.  No row is stored again."""
    found, nearer = _delta(reached, new)
    gone = _known(reached, nearer)
    return (reached if gone.isEmpty() else reached.join(written(gone.select("root", "node")), ["root", "node"], "left_anti")).unionByName(written(nearest(found)))
