"""Graph operators over edge tables.

Loops on the driver go by hop or by round, each a join and an aggregate; rounds are written to the shared
checkpoint folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.frames import checkpointed, written


def neighbours(triples: DataFrame) -> DataFrame:
    """(entity, predicate, direction, other) of every relation, seen from both ends; loops are left out."""
    t = triples.where(F.col("subject") != F.col("object"))
    out = t.select(F.col("subject").alias("entity"), "predicate", F.lit("->").alias("direction"), F.col("object").alias("other"))
    back = t.select(F.col("object").alias("entity"), "predicate", F.lit("<-").alias("direction"), F.col("subject").alias("other"))
    return out.unionByName(back)


def direct_dependents(edges: DataFrame) -> DataFrame:
    """(parent, child): who derives directly from whom, of edges (src, dst, kind)."""
    return edges.where("kind = 'DERIVED_FROM'").select(F.col("dst").alias("parent"), F.col("src").alias("child")).distinct()


def corroboration(triples: DataFrame) -> DataFrame:
    """(entity, corroboration): the number of other subjects that point at each object.

    Where ``triples`` has states, only active ones count.
    """
    live = triples.where("state = 'ACTIVE'") if "state" in triples.columns else triples
    return live.where("subject <> object").groupBy(F.col("object").alias("entity")).agg(F.countDistinct("subject").alias("corroboration"))


def _levels(edges: DataFrame, roots: DataFrame, max_depth: int, more: DataFrame | None = None) -> tuple[list[tuple[DataFrame, DataFrame, bool]], DataFrame]:
    """What a closure is put together from: levels (starts, pairs, several), and the closure (root, node, depth) of the last level's ends.

    A level's ``starts`` (root, ...) are distinct, ``pairs`` (root, dst, n, ...) its starts with the ends of their edges and their number; ``several`` says
    whether any start has more than one.  The ends are the next level's starts as long as they are at most half as many, so that what very
    many nodes share is searched once; from there on each start is followed hop by hop.  ``more`` (root, ...) has further columns of starts.
    """
    step = written(edges.select("src", "dst").where("src <> dst"))
    starts, levels = roots.select("root").distinct(), []
    while True:
        starts = written(starts if more is None else starts.join(more, "root", "left"))
        met = starts.join(step, starts["root"] == step["src"]).drop("src")
        pairs = written(met.withColumn("n", F.count("*").over(W.partitionBy("root"))))
        edges_of, begun, most = pairs.agg(F.count("*"), F.sum(1 / F.col("n")), F.max("n")).first()
        if not edges_of:
            return levels, starts.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
        if max_depth - len(levels) <= 1:
            raise ValueError(f"the closure goes deeper than {max_depth}")
        ends = written(pairs.select(F.col("dst").alias("root")).distinct())
        if 2 * ends.count() > round(begun):
            return levels, _followed(step, starts.select("root"), pairs.select("root", F.col("dst").alias("node")).distinct(), max_depth - len(levels))
        if edges_of == step.count():  # what lies below starts at the ends
            step = written(step.join(ends.withColumnRenamed("root", "src"), "src", "left_semi"))
        levels.append((starts, pairs, most > 1))
        starts = ends


def _followed(step: DataFrame, roots: DataFrame, first: DataFrame, max_depth: int) -> DataFrame:
    """(root, node, depth) of all that ``roots`` (root) reach over ``step`` (src, dst), hop by hop, after their ``first`` one (root, node)."""
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    reached = first
    for depth in range(1, max_depth + 1):
        front = written(reached.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        reached = front.join(step, front["node"] == step["src"]).select("root", F.col("dst").alias("node")).distinct()
    raise ValueError(f"the closure goes deeper than {max_depth}")


def closure(edges: DataFrame, roots: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(root, node, depth): all that ``roots`` (root) reach over edges (src, dst), at the least depth; a root reaches itself at 0.

    The last joins are left to the reader, so that a closure that is only written out isn't stored before; one that is read again and again should be.
    """
    levels, below = _levels(edges, roots, max_depth)
    for starts, pairs, several in reversed(levels):
        below = written(below) if several else below  # it is read twice
        ways = lambda at: pairs.where(at).join(below.withColumnRenamed("root", "dst"), "dst").where("node <> root").select("root", "node", (F.col("depth") + 1).alias("depth"))  # noqa: E731, B023
        found = ways("n = 1")
        if several:
            found = found.unionByName(ways("n > 1").groupBy("root", "node").agg(F.min("depth").alias("depth")))
        below = starts.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).unionByName(found)
    return below


def frontiers(edges: DataFrame, roots: DataFrame, records: DataFrame, max_depth: int = 1000) -> DataFrame:
    """:func:`frontier` of the closure of ``roots`` (root) over ``edges`` (src, dst), without making that closure: what a node's ends found, one
    step farther, against its own versions, which are nearest to it."""
    own = F.struct("semantic_key", F.struct(F.lit(0).alias("depth"), (-F.col("owner_seq")).alias("back"), "record_id").alias("at"))
    mine = written(records.where("record_id is not null").groupBy(F.col("record_id").alias("root")).agg(F.array_agg(own).alias("mine")))
    levels, below = _levels(edges, roots, max_depth, mine)
    met = below.join(mine.withColumnRenamed("root", "node"), "node").select("root", "depth", F.inline("mine"))
    nearest = lambda df: df.groupBy("root", "semantic_key").agg(F.min("at").alias("at"))
    farther = lambda steps: F.struct((F.col("at.depth") + steps).alias("depth"), "at.back", "at.record_id").alias("at")
    best = nearest(met.select("root", "semantic_key", farther(F.col("depth"))))
    for starts, pairs, several in reversed(levels):
        best = written(best) if several else best  # it is read twice
        held = F.exists(F.coalesce("mine", F.array()), lambda x: x["semantic_key"].eqNullSafe(F.col("semantic_key")))
        ways = lambda at: pairs.where(at).join(best.withColumnRenamed("root", "dst"), "dst").where(~held).select("root", "semantic_key", farther(F.lit(1)))  # noqa: E731, B023
        found = ways("n = 1").unionByName(nearest(starts.select("root", F.inline("mine"))))
        best = found.unionByName(nearest(ways("n > 1"))) if several else found
    return best.select("root", "semantic_key", F.col("at.record_id").alias("record_id"))


def frontier(reached: DataFrame, records: DataFrame) -> DataFrame:
    """(root, semantic_key, record_id) of a closure: for each key the nearest version, of equals the newest.

    ``records`` has record_id, semantic_key and owner_seq.
    """
    met = reached.join(records, reached["node"] == records["record_id"])
    return met.groupBy("root", "semantic_key").agg(F.min_by("record_id", F.struct("depth", -F.col("owner_seq"), "record_id")).alias("record_id"))


def cyclic_nodes(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node) of all nodes on a cycle or behind one, of edges (src, dst): what is left after nodes without
    outgoing edges have been taken away again and again."""
    left = checkpointed(edges.select("src", "dst").distinct())
    n = left.count()
    for _ in range(max_rounds):
        left = checkpointed(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        now = left.count()
        if now == n:
            return left.select(F.col("src").alias("node")).distinct()
        n = now
    raise ValueError(f"not settled in {max_rounds} rounds")


def bounded_distances(edges: DataFrame, root: str, threshold: float, max_rounds: int = 10_000) -> DataFrame:
    """(node, distance) of all within ``threshold`` of ``root`` over directed edges (src, dst, distance > 0).

    Each round relaxes the edges of the nodes that came nearer in the last one, and drops what is beyond
    the threshold before it is shuffled.  A root without edges is there at 0 if it is a node at all.
    """
    spark: SparkSession = edges.sparkSession
    cheap = checkpointed(edges.where(F.col("distance") <= threshold).groupBy("src", "dst").agg(F.min("distance").alias("w")))
    known = edges.where((F.col("src") == root) | (F.col("dst") == root)).limit(1).select(F.lit(root).alias("node"), F.lit(0.0).alias("distance"))
    known = checkpointed(known)
    front = known
    for _ in range(max_rounds):
        reached = front.join(cheap, front["node"] == cheap["src"]).select(F.col("dst").alias("node"), (F.col("distance") + F.col("w")).alias("distance"))
        best = reached.where(F.col("distance") <= threshold).groupBy("node").agg(F.min("distance").alias("new"))
        front = checkpointed(best.join(known, "node", "left").where(F.col("distance").isNull() | (F.col("new") < F.col("distance"))).select("node", F.col("new").alias("distance")))
        if front.isEmpty():
            return known
        known = checkpointed(known.join(front.select("node"), "node", "left_anti").unionByName(front))
    raise ValueError(f"not settled in {max_rounds} rounds on {spark.sparkContext.appName}")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges (src, dst, ...) with both ends in ``nodes`` (node)."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


HISTORY = ("SUPERSEDES", "DERIVED_FROM", "REVERTED_FROM")


def subjects_around(nodes: DataFrame, edges: DataFrame, subjects: DataFrame, history: bool = True) -> DataFrame:
    """(subject, node) of the subgraph of each of ``subjects`` (subject): its anchor, its records, their objects and subjects, and one hop of history.

    ``nodes`` is (node, kind, semantic_key, state), ``edges`` (src, dst, kind).  An anchor is an entity whose name, in any case, is the subject, the subject with _ for -,
    or that with ``patient_`` before it; of several the least.  Records have a key that begins with the slug or the anchor.  With ``history``
    records of all states count, and what they supersede, derive from or were reverted from comes with its object; without it active records only.
    All subjects are found in the same joins, by keys that are equal; a subject without any node has no row.
    """
    low = F.lower("subject")
    own = F.replace(low, F.lit("-"), F.lit("_"))
    asked = subjects.select("subject").dropna().distinct()
    spelled = asked.select("subject", F.explode(F.array_distinct(F.array(own, low, F.concat(F.lit("patient_"), own)))).alias("low"))
    anchors = nodes.withColumn("low", F.lower("node")).join(spelled, "low").groupBy("subject").agg(F.min("node").alias("node"))
    prefixes = asked.select("subject", own.alias("prefix")).unionByName(anchors.select("subject", F.col("node").alias("prefix"))).distinct()
    records = nodes.where(F.coalesce(F.col("kind") != "entity", F.lit(True)) & F.col("semantic_key").contains("::"))
    if not history:
        records = records.where("state = 'ACTIVE'")
    mine = checkpointed(records.withColumn("prefix", F.split_part("semantic_key", F.lit("::"), F.lit(1))).join(prefixes, "prefix").select("subject", "node").distinct())
    out = lambda at, kinds: at.join(edges.where(F.col("kind").isin(*kinds)).select(F.col("src").alias("node"), F.col("dst").alias("to")), "node").select("subject", F.col("to").alias("node"))
    into = mine.join(edges.where("kind = 'SUBJECT'").select(F.col("dst").alias("node"), F.col("src").alias("from")), "node").select("subject", F.col("from").alias("node"))
    found = anchors.unionByName(mine).unionByName(out(mine, ["OBJECT"])).unionByName(into)
    if history:
        before = checkpointed(out(mine, HISTORY).distinct())
        found = found.unionByName(before).unionByName(out(before, ["OBJECT"]))
    return found.distinct()


def subject_edges(around: DataFrame, edges: DataFrame) -> DataFrame:
    """(subject, src, dst, kind): the edges with both ends in a subject's nodes (subject, node)."""
    ends = lambda name: around.select("subject", F.col("node").alias(name))
    return edges.select("src", "dst", "kind").join(ends("src"), "src").join(ends("dst"), ["subject", "dst"]).select("subject", "src", "dst", "kind")


def bfs_edges(edges: DataFrame, root: str, depth: int) -> DataFrame:
    """(src, dst, hop) of a breadth-first tree from ``root``: each new node under its least parent."""
    step = checkpointed(edges.select("src", "dst").where("src <> dst").distinct())
    front = edges.sparkSession.createDataFrame([(root,)], "node string")
    seen, tree = front, None
    for hop in range(1, depth + 1):
        reached = front.join(step, front["node"] == step["src"]).groupBy("dst").agg(F.min("src").alias("src"))
        found = checkpointed(reached.join(seen.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst", F.lit(hop).alias("hop")))
        tree = found if tree is None else tree.unionByName(found)
        front = found.select(F.col("dst").alias("node"))
        seen = seen.unionByName(front)
        if found.isEmpty():
            break
    return tree


def subgraph_of_files(edges: DataFrame, files: list[str]) -> DataFrame:
    """The edges that come from any of ``files``, parallel ones included."""
    return edges.where(F.col("file").isin(files))


def styled(nodes: DataFrame) -> DataFrame:
    """``nodes`` (kind, state) with the colour and size that they are drawn with."""
    colour = F.when(F.col("kind") == "entity", "#4C78A8").when(F.col("state") == "ACTIVE", "#54A24B").when(F.col("state") == "FLAGGED", "#E45756").when(F.col("state") == "TBD", "#F2CF5B").otherwise("#BAB0AC")
    return nodes.withColumns({"colour": colour, "size": F.when(F.col("kind") == "entity", 18).otherwise(10)})


def incomplete(roots: DataFrame, dependencies: DataFrame, found: DataFrame) -> DataFrame:
    """(root, missing): the keys that ``dependencies`` (root, semantic_key) ask for and a frontier ``found`` (root, semantic_key)
    lacks, for those of ``roots`` (root) whose lineage is incomplete."""
    lost = dependencies.select("root", "semantic_key").distinct().join(found.select("root", "semantic_key"), ["root", "semantic_key"], "left_anti")
    return lost.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.array_sort(F.collect_set("semantic_key")).alias("missing"))


def derives_from_all(reached: DataFrame, wanted: DataFrame) -> DataFrame:
    """(root, derives): whether each root of ``wanted`` (root, node) reaches all that it names there, by its closure ``reached``."""
    met = wanted.select("root", "node").distinct().join(reached.select("root", "node", F.lit(True).alias("there")), ["root", "node"], "left")
    return met.groupBy("root").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("derives"))


def knowledge(triples: DataFrame, root: str, depth: int) -> DataFrame:
    """(src, relation, dst, hop): the tree of :func:`bfs_edges` with the least relation of each of its edges."""
    tree = bfs_edges(triples.select(F.col("subject").alias("src"), F.col("object").alias("dst")), root, depth)
    named = triples.groupBy(F.col("subject").alias("src"), F.col("object").alias("dst")).agg(F.min("predicate").alias("relation"))
    return tree.join(named, ["src", "dst"]).select("src", "relation", "dst", "hop")
