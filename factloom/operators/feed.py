"""Feeding cases into a table batch by batch, and replacing the whole subgraph of verified subjects.

Both write through a keyed table's manifests, so that each step is seen whole or not at all: a batch of cases carries its number as
a tag and is fed once, however often the feed is broken off and started again; a subject's old rows, new rows and edges change in one commit.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from factloom.functions.frames import checkpointed
from factloom.functions.text import slug
from factloom.operators.ordering import numbered
from factloom.sources.keyed import KeyedTable


def ordered_split(cases: DataFrame, ordinal: str, share: float) -> DataFrame:
    """``cases`` with ``place`` (from 0, in the order of the distinct integers ``ordinal``) and ``part``: *train* up to the rounded share of all, else *holdout*."""
    placed = checkpointed(numbered(cases, ordinal, "place"))
    return placed.withColumn("part", F.when(F.col("place") < round(placed.count() * share), "train").otherwise("holdout"))


def line_split(lines: DataFrame, key: str, train: float = 0.8, valid: float = 0.1, at_least_one: bool = True) -> DataFrame:
    """``lines`` with ``part``, in the order of a hash of ``key``: shares are cut to whole rows, the rest is the test part.

    With ``at_least_one`` a part has one row where its share would round to none, from more than two rows on for the validation part, and a part that
    is still empty repeats the first row.
    """
    hashed = lines.withColumn("_hash", F.shiftrightunsigned(F.xxhash64(key), 1))
    placed = checkpointed(numbered(hashed, "_hash", "_place", 1 << 48).drop("_hash"))
    n = placed.count()
    a, b = int(n * train), int(n * valid)
    if at_least_one:
        a, b = max(1, a), max(1, b) if n > 2 else 0
    at = F.col("_place")
    parts = [F.when(at < a, "train"), F.when((at >= a) & (at < a + b), "valid"), F.when(at >= a + b, "test")]
    if at_least_one:
        parts += [F.when(at == 0, "valid") if not b else F.lit(None), F.when(at == 0, "test") if a + b >= n else F.lit(None)]
    return placed.withColumn("part", F.explode(F.filter(F.array(*[p.cast("string") for p in parts]), lambda x: x.isNotNull()))).drop("_place")


def feed(cases: DataFrame, ordinal: str, share: float, table: KeyedTable, folder: str, ingest: Callable[[DataFrame], DataFrame], size: int = 1000, source: str = "feed", together: int = 1) -> dict:
    """Feed the training part of ``cases`` into ``table``, ``size`` of them a batch in their order; the holdout goes to ``folder``/holdout.

    ``ingest(rows)`` gives a batch's rows of the table.  So many batches as ``together`` says are ingested each by itself but in one job, and seen at once:
    for an ``ingest`` that doesn't read the table.  A feed that was broken off goes on after the last batch that the table's manifest has.
    The result says how many cases there are, how many are for training, and which batches were fed this time.
    """
    split = ordered_split(cases, ordinal, share)
    n, n_train = split.count(), split.where("part = 'train'").count()
    split.where("part = 'holdout'").drop("place", "part").write.mode("overwrite").parquet(f"{folder}/holdout")
    done = table.manifest()["tags"].get(source, -1)
    batches, fed = -(-n_train // size), []
    if done + 1 < batches:  # what is left, by batch, so that each is read alone
        left = split.where(F.col("part") == "train").withColumn("_batch", F.expr(f"place div {size}")).where(F.col("_batch") > done)
        left.drop("place", "part").write.mode("overwrite").partitionBy("_batch").parquet(f"{folder}/train")
        train = table.spark.read.schema(StructType([*cases.schema.fields, StructField("_batch", LongType())])).parquet(f"{folder}/train")

    def commit(parts: list[DataFrame], first: int) -> None:
        rows = reduce(DataFrame.unionByName, parts)
        rows = rows.repartition(-(-len(parts) // 16)) if len(parts) > 1 else rows  # else each bucket gets a file from each batch
        table.commit(checkpointed(rows), source=source, tag=first + len(parts) - 1)

    for first in range(done + 1, batches, together):
        parts, broke = [], None
        for k in range(first, min(first + together, batches)):
            try:
                parts.append(ingest(train.where(F.col("_batch") == k).drop("_batch")))
            except Exception as e:
                broke = e
                break
        try:
            if parts:
                commit(parts, first)
        except Exception:
            if len(parts) == 1:
                raise
            for i, part in enumerate(parts):  # those before the one that fails are fed
                commit([part], first + i)
        fed += range(first, first + len(parts))
        if broke:
            raise broke
    return {"cases": n, "train": n_train, "fed": fed}


SUBGRAPH = "kind string, id string, subject string, src string, dst string, semantic_key string, obj string, state string, owner_seq long, valid_from timestamp, source_id string, mentions long, gone boolean, seq long"


def _record(subject: Column, predicate: Column, obj: Column, state: Column) -> Column:
    """A verified record's id: archived ones are told apart from active ones of the same fact."""
    return F.concat(F.when(state == "ARCHIVED", "rec_archived_").otherwise("rec_"), slug(subject), F.lit("_"), slug(predicate), F.lit("_"), slug(obj))


def verified_rows(facts: DataFrame, supersessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, refused): nodes and edges of verified ``facts`` and the supersessions whose ends aren't among them.

    ``facts`` is (subject, predicate, object, state, sources, dates), with the arrays in the order of the documents; the first date is when
    it became true, the last source is cited.  ``supersessions`` is (subject, new_predicate, new_object, old_predicate, old_object).  Of an active and an archived
    record of one fact the archived one is superseded, the active one supersedes.  Facts with a null part are left out; of repeated ones the one with most sources counts.
    """
    named = facts.dropna(subset=["subject", "predicate", "object", "state"]).withColumn("id", _record(F.col("subject"), F.col("predicate"), F.col("object"), F.col("state")))
    whole = F.struct(F.coalesce(F.size("sources"), F.lit(0)), "object", "predicate", "subject", "state", "sources", "dates")
    r = named.groupBy("id").agg(F.max(whole).alias("f")).select("id", "f.*")
    own, key = slug(F.col("subject")), F.concat(slug(F.col("subject")), F.lit("::"), slug(F.col("predicate")), F.lit("::"), slug(F.col("object")))
    row = lambda **c: [c.get(x.split()[0], F.lit(None).cast(x.split()[1])).cast(x.split()[1]).alias(x.split()[0]) for x in SUBGRAPH.split(", ")]
    records = r.select(*row(kind=F.lit("record"), id=F.col("id"), subject=own, semantic_key=key, obj=F.col("object"), state=F.col("state"), owner_seq=F.when(F.col("state") == "ARCHIVED", 0).otherwise(1), valid_from=F.get("dates", 0), source_id=F.element_at("sources", -1), mentions=F.size("sources")))
    anchors = r.select(own.alias("id")).distinct().select(*row(kind=F.lit("entity"), id=F.col("id"), subject=F.col("id")))
    edge = lambda src, dst, kind, subject: row(kind=F.lit("edge"), id=F.concat_ws("|", src, F.lit(kind), dst), subject=subject, src=src, dst=dst)
    about = r.select(*edge(F.col("id"), own, "SUBJECT", own)).unionByName(r.select(*edge(F.col("id"), slug(F.col("object")), "OBJECT", own)))
    end = lambda side, first: r.groupBy(own.alias("s"), slug(F.col("predicate")).alias("p"), slug(F.col("object")).alias("o")).agg(F.min_by("id", F.when(F.col("state") == first, 0).otherwise(1)).alias(side))
    asked = supersessions.select("*", slug(F.col("subject")).alias("s"), *[slug(F.col(f"{side}_{c}")).alias(f"{side}_{c[0]}") for side in ("new", "old") for c in ("predicate", "object")])
    met = asked
    for side, first in (("new", "ACTIVE"), ("old", "ARCHIVED")):
        met = met.join(end(f"{side}_id", first).withColumnsRenamed({"p": f"{side}_p", "o": f"{side}_o"}), ["s", f"{side}_p", f"{side}_o"], "left")
    both = F.col("new_id").isNotNull() & F.col("old_id").isNotNull() & (F.col("new_id") != F.col("old_id"))
    replaced = met.where(both).select(*edge(F.col("new_id"), F.col("old_id"), "SUPERSEDES", F.col("s"))).dropDuplicates(["id"])
    return records.unionByName(anchors).unionByName(about).unionByName(replaced), met.where(~F.coalesce(both, F.lit(False))).select(*supersessions.columns)


def replace_subjects(table: KeyedTable, facts: DataFrame, supersessions: DataFrame, seq: int) -> DataFrame:
    """Put the subgraphs of the subjects of ``facts`` in the place of what ``table`` (of :data:`SUBGRAPH`, by kind and id) has of them, in one commit; the refused supersessions.

    What goes: a subject's records, its entity, also as ``pt_`` and in other case, and all edges at any of these, other subjects' too; what the
    new subgraph holds again stays.  ``seq`` orders commits.  Outside the gate: verified facts aren't judged against heads.
    """
    rows, refused = verified_rows(facts, supersessions)
    rows = checkpointed(rows)
    now = checkpointed(table.read())
    subjects = rows.where("kind = 'entity'").select("subject")
    spellings = subjects.select("subject", F.explode(F.array("subject", F.concat(F.lit("pt_"), "subject"))).alias("low"))
    nodes = now.where("kind = 'record'").join(subjects, "subject", "left_semi").select("kind", "id")
    nodes = nodes.unionByName(now.where("kind = 'entity'").withColumn("low", F.lower("id")).join(spellings.select("low"), "low", "left_semi").select("kind", "id"))
    gone_nodes = checkpointed(nodes.join(rows.select("kind", "id"), ["kind", "id"], "left_anti"))
    ids = gone_nodes.select("id")
    edges = now.where("kind = 'edge'")
    loose = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("kind", "id").unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("kind", "id")).unionByName(edges.join(subjects, "subject", "left_semi").select("kind", "id"))
    gone = gone_nodes.unionByName(loose.distinct().join(rows.select("kind", "id"), ["kind", "id"], "left_anti"))
    rest = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in SUBGRAPH.split(", ")[2:-2]]
    table.commit(checkpointed(rows.drop("gone", "seq").unionByName(gone.select("kind", "id", *rest)).join(gone.withColumn("gone", F.lit(True)), ["kind", "id"], "left").withColumn("seq", F.lit(seq).cast("long"))))
    return refused
