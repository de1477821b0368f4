"""Triples as relational tables: entities, relations, and triples over their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.ordering import numbered

#: Ordinals are below 2^58; those of objects are moved behind those of all subjects.
AFTER_SUBJECTS = 1 << 58
#: Ordinals that are numbered together.
RANGE = 1 << 28


def entities(triples: DataFrame) -> DataFrame:
    """(entity_id, entity_name, entity_type) of all subjects and objects, ids in the order of appearance.

    Subjects come before objects.  The type is the first subject type, else the first object type,
    else Unknown.
    """
    subjects = triples.select(F.col("subject").alias("name"), "ordinal", F.col("subject_type").alias("st"), F.lit(None).cast("string").alias("ot"))
    objects = triples.select(F.col("object").alias("name"), (F.col("ordinal") + AFTER_SUBJECTS).alias("ordinal"), F.lit(None).cast("string").alias("st"), F.col("object_type").alias("ot"))
    first = subjects.unionByName(objects).groupBy("name").agg(
        F.min("ordinal").alias("ordinal"),
        F.min_by("st", F.when(F.col("st").isNotNull(), F.col("ordinal"))).alias("st"),
        F.min_by("ot", F.when(F.col("ot").isNotNull(), F.col("ordinal"))).alias("ot"),
    )
    return numbered(first, "ordinal", "entity_id", RANGE).select("entity_id", F.col("name").alias("entity_name"), F.coalesce("st", "ot", F.lit("Unknown")).alias("entity_type"))


def relations(triples: DataFrame) -> DataFrame:
    """(relation_id, relation_name), ids in the order of appearance."""
    first = triples.groupBy("predicate").agg(F.min("ordinal").alias("ordinal"))
    return numbered(first, "ordinal", "relation_id", RANGE).select("relation_id", F.col("predicate").alias("relation_name"))


def over_ids(triples: DataFrame, entity_table: DataFrame, relation_table: DataFrame) -> DataFrame:
    """(entity_id_1, relation_id, entity_id_2) of each triple; -1 where a name is unknown."""
    e1 = entity_table.select(F.col("entity_name").alias("subject"), F.col("entity_id").alias("entity_id_1"))
    e2 = entity_table.select(F.col("entity_name").alias("object"), F.col("entity_id").alias("entity_id_2"))
    r = relation_table.select(F.col("relation_name").alias("predicate"), "relation_id")
    joined = triples.select("subject", "predicate", "object").join(e1, "subject", "left").join(e2, "object", "left").join(r, "predicate", "left")
    known = lambda c: F.coalesce(c, F.lit(-1)).cast("long").alias(c)
    return joined.select(known("entity_id_1"), known("relation_id"), known("entity_id_2"))


def named(id_triples: DataFrame, entity_table: DataFrame, relation_table: DataFrame) -> DataFrame:
    """The names behind id triples."""
    e1 = entity_table.select(F.col("entity_id").alias("entity_id_1"), F.col("entity_name").alias("subject"))
    e2 = entity_table.select(F.col("entity_id").alias("entity_id_2"), F.col("entity_name").alias("object"))
    r = relation_table.select("relation_id", F.col("relation_name").alias("predicate"))
    return id_triples.join(e1, "entity_id_1").join(e2, "entity_id_2").join(r, "relation_id").select("subject", "predicate", "object")


def last_edge_wins(triples: DataFrame) -> DataFrame:
    """(subject, object, predicate): of triples between the same two entities the last."""
    return triples.groupBy("subject", "object").agg(F.max_by("predicate", "ordinal").alias("predicate"))


def well_formed(arrays: DataFrame, column: str = "triple") -> DataFrame:
    """Rows whose array has the five parts of a triple."""
    return arrays.where(F.size(column) == 5)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) over undirected edges (src, dst)."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def normalised_adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): the number of edges over the root of the product of both degrees."""
    d = degrees(edges)
    n = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    a, b = d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), d.select(F.col("node").alias("dst"), F.col("degree").alias("dd"))
    return n.join(a, "src").join(b, "dst").select("src", "dst", (F.col("n") / F.sqrt(F.col("ds") * F.col("dd"))).alias("weight"))


def apply_edge_changes(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """``edges`` (key, src, dst, predicate) after ``changes`` (key, op, src, dst, predicate, seq).

    Of the changes to a key the last counts: *insert* adds an edge that isn't there, *delete* takes one away.
    """
    last = changes.groupBy("key").agg(F.max_by(F.struct("op", "src", "dst", "predicate"), "seq").alias("c")).select("key", "c.*")
    stay = edges.join(last.where("op = 'delete'"), "key", "left_anti")
    new = last.where("op = 'insert'").drop("op").join(edges, "key", "left_anti")
    return stay.unionByName(new.select(*edges.columns))


def multigraph(triples: DataFrame) -> DataFrame:
    """(src, dst, key, relation, file): all edges of triples (subject, predicate, object, file, ordinal), parallel ones numbered."""
    from pyspark.sql import Window as W

    whole = triples.where("subject is not null and predicate is not null and object is not null")
    key = F.row_number().over(W.partitionBy("subject", "object").orderBy("ordinal")) - 1
    return whole.select(F.col("subject").alias("src"), F.col("object").alias("dst"), key.cast("long").alias("key"), F.col("predicate").alias("relation"), "file")
