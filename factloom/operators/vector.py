"""Vector and term search, the fusion of ranks, and scores of relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.frames import checkpointed

#: The relations whose vectors are written into a plan; more are refused.
MAX_RELATIONS = 1000


def inner_product(a: Column, b: Column) -> Column:
    """The inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_top(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, score, rank): the ``k`` rows of ``vectors`` (id, embedding) with the highest inner product."""
    q = F.array(*[F.lit(float(x)) for x in query])
    best = vectors.select("id", inner_product(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")).cast("long"))


def sparse_top(terms: DataFrame, query_terms: DataFrame, k: int) -> DataFrame:
    """(id, score, rank): the ``k`` documents of ``terms`` (id, term, w) with the highest product with ``query_terms`` (term, qw)."""
    # rounded: sums of doubles differ in their last digits with the order of the rows
    score = terms.join(query_terms, "term").groupBy("id").agg(F.round(F.sum(F.col("w") * F.col("qw")), 6).alias("score"))
    best = score.orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")).cast("long"))


def fuse(rankings: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """(id, score): the ``k`` best by the sum of 1 / (constant + rank) over all rankings (id, rank)."""
    all_ = rankings[0].select("id", "rank")
    for r in rankings[1:]:
        all_ = all_.unionByName(r.select("id", "rank"))
    return all_.groupBy("id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def known_relations(relations: DataFrame) -> list[tuple[str, list[float]]]:
    """The few (relation, v) of a model, in order; more than :data:`MAX_RELATIONS` are refused."""
    rows = relations.select("relation", "v").orderBy("relation").limit(MAX_RELATIONS + 1).collect()
    if len(rows) > MAX_RELATIONS:
        raise ValueError(f"there are more than {MAX_RELATIONS} relations")
    return [(r["relation"], list(r["v"])) for r in rows]


def translation_scores(pairs: DataFrame, nodes: DataFrame, relations: list[tuple[str, list[float]]]) -> DataFrame:
    """(src, dst, relation, score): minus the distance from head plus relation to tail, for each relation.

    ``nodes`` is (node, v); ``relations`` are the model's few (name, vector) parameters.
    """
    a, b = nodes.select(F.col("node").alias("src"), F.col("v").alias("h")), nodes.select(F.col("node").alias("dst"), F.col("v").alias("t"))
    known = F.array(*[F.struct(F.lit(n).alias("relation"), F.array(*[F.lit(float(x)) for x in v]).alias("r")) for n, v in relations])
    met = pairs.join(a, "src").join(b, "dst").select("src", "dst", "h", "t", F.inline(known))
    gap = F.zip_with(F.zip_with("h", "r", lambda x, y: x + y), F.col("t"), lambda x, y: (x - y) * (x - y))
    return met.select("src", "dst", "relation", (-F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))).alias("score"))


def best_relations(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best relations of each pair."""
    order = W.partitionBy("src", "dst").orderBy(F.desc("score"), "relation")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def translation_vectors(triples: DataFrame, dim: int = 16, rounds: int = 3, rate: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(nodes, relations) with vectors in which a relation leads from subjects to objects.

    Starts from hashes; a round sets each relation to the mean step over its triples and moves each node
    towards where its triples say it should be.  Both are averages over plain columns, summed before the
    shuffle, so that a hub or a frequent relation is no large group.  Every round's tables are written to the
    checkpoint folder: the plan stays as long as one round.
    """
    places = range(dim)
    start = [F.conv(F.substring(F.md5(F.concat(F.col("node"), F.lit(f":{i}"))), 1, 8), 16, 10).cast("double") / (1 << 31) - 1 for i in places]
    columns = lambda name: [f"{name}{i}" for i in places]
    listed = lambda name: F.array(*columns(name))
    named = lambda df, key, new, name: df.select(F.col(key).alias(new), *[F.col(f"v{i}").alias(f"{name}{i}") for i in places])
    t = checkpointed(triples.select("subject", "predicate", "object").distinct())
    nodes = t.select(F.explode(F.array("subject", "object")).alias("node")).distinct()
    nodes = checkpointed(nodes.select("node", *[v.alias(c) for v, c in zip(start, columns("v"))]))
    relations = None
    for _ in range(rounds):
        met = checkpointed(t.join(named(nodes, "node", "subject", "h"), "subject").join(named(nodes, "node", "object", "t"), "object"))
        relations = checkpointed(met.groupBy("predicate").agg(*[F.avg(F.col(f"t{i}") - F.col(f"h{i}")).alias(f"r{i}") for i in places]))
        full = met.join(relations, "predicate")
        wants = full.select(F.col("object").alias("node"), *[(F.col(f"h{i}") + F.col(f"r{i}")).alias(f"w{i}") for i in places])
        wants = wants.unionByName(full.select(F.col("subject").alias("node"), *[(F.col(f"t{i}") - F.col(f"r{i}")).alias(f"w{i}") for i in places]))
        aim = wants.groupBy("node").agg(*[F.avg(f"w{i}").alias(f"w{i}") for i in places])
        nodes = checkpointed(nodes.join(aim, "node").select("node", *[((1 - rate) * F.col(f"v{i}") + rate * F.col(f"w{i}")).alias(f"v{i}") for i in places]))
    return nodes.select("node", listed("v").alias("v")), relations.select(F.col("predicate").alias("relation"), listed("r").alias("v"))
