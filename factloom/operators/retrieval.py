"""Questions to the fact graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.frames import checkpointed


def most_common(triples: DataFrame, seed: str, targets: tuple[str, ...], via: tuple[str, ...] = (), top_n: int | None = None) -> DataFrame:
    """(label, n): how often each object occurs in ``targets`` relations of the entities around ``seed``.

    With ``via`` these are the entities that point at the seed by any of these predicates, without it the
    seed itself.  Occurrences count; the most frequent come first, ties by label.
    """
    low = F.lower("predicate")
    around = triples.where((F.col("object") == seed) & low.isin([v.lower() for v in via]) & (F.col("subject") != seed)).select("subject").distinct()
    facts = triples.where(low.isin([t.lower() for t in targets]) & (F.col("subject") != F.col("object")))
    facts = facts.join(around, "subject", "left_semi") if via else facts.where(F.col("subject") == seed)
    counted = facts.groupBy(F.col("object").alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")
    return counted if top_n is None else counted.limit(top_n)


def recency(state: Column, doc_date: Column, now: Column, fresh_days: int = 90) -> tuple[Column, Column]:
    """The recency of a fact and its age in whole days: PAST unless active, CURRENT without a date or within
    ``fresh_days``, else CURRENT_STALE."""
    days = F.floor((F.unix_micros(now) - F.unix_micros(doc_date)) / F.lit(86_400_000_000)).cast("long")
    kind = F.when(state != "ACTIVE", "PAST").when(days.isNull() | (days <= fresh_days), "CURRENT").otherwise("CURRENT_STALE")
    return kind, days


def temporal_facts(facts: DataFrame, now: Column, fresh_days: int = 90) -> DataFrame:
    """``facts`` (subject, predicate, object, state, doc_date, source_id) with recency, days_old and text."""
    kind, days = recency(F.col("state"), F.col("doc_date"), now, fresh_days)
    base = F.concat(F.concat_ws(" — ", "subject", "predicate", "object"), F.when(F.coalesce(F.col("source_id"), F.lit("")) == "", "").otherwise(F.concat(F.lit(" [source: "), "source_id", F.lit("]"))))
    note = F.concat(F.lit("as of "), F.date_format("doc_date", "yyyy-MM-dd"), F.lit(" ("), F.col("days_old").cast("string"), F.lit(" days ago) — no more recent record exists; this may be outdated"))
    text = F.when(F.col("recency") == "PAST", F.concat(F.lit("[PAST / SUPERSEDED] "), base)).when(F.col("recency") == "CURRENT_STALE", F.concat(F.lit("[CURRENT, but "), note, F.lit("] "), base)).otherwise(base)
    return facts.withColumns({"recency": kind, "days_old": days}).withColumn("text", text)


def in_order(facts: DataFrame) -> DataFrame:
    """Temporal facts, current before stale before past, and the newest first."""
    rank = F.when(F.col("recency") == "CURRENT", 0).when(F.col("recency") == "CURRENT_STALE", 1).otherwise(2)
    return facts.orderBy(rank, F.col("doc_date").desc_nulls_last(), "text")


def mentions(facts: DataFrame, keys: tuple[str, ...] = ("semantic_key", "obj")) -> DataFrame:
    """The mentions of each fact: count, sources and dates in the order of their first arrival, and the latest ones."""
    by_source = facts.groupBy(*keys, "source_id").agg(F.count("*").alias("n"), F.min("arrival").alias("first"), F.max("arrival").alias("last"))
    sources = by_source.groupBy(*keys).agg(
        F.sum("n").alias("mention_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("first", "source_id"))), lambda x: x["source_id"]).alias("source_ids"),
        F.max_by("source_id", "last").alias("source_id"),
    )
    by_date = facts.groupBy(*keys, "doc_date").agg(F.min("arrival").alias("first"), F.max("arrival").alias("last"))
    dates = by_date.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "doc_date"))), lambda x: x["doc_date"]).alias("doc_dates"), F.max_by("doc_date", "last").alias("doc_date"))
    return sources.join(dates, list(keys))


def fact_text(subject: Column, predicate: Column, obj: Column, sources: Column, dates: Column, n: Column, archived: Column) -> Column:
    """A fact as a line, with its documents, dates and mentions."""
    many = lambda a, one, more: F.when(F.size(a) == 0, F.lit(None)).when(F.size(a) == 1, F.concat(F.lit(f"{one}: "), a[0])).otherwise(F.concat(F.lit(f"{more}: "), F.array_join(a, ", ")))
    parts = F.concat_ws(" | ", many(sources, "Doc", "Docs"), many(dates, "Date", "Dates"), F.when(n > 1, F.concat(n.cast("string"), F.lit(" mentions"))))
    line = F.concat(F.concat_ws(" — ", subject, predicate, obj), F.when(parts == "", "").otherwise(F.concat(F.lit(" ["), parts, F.lit("]"))))
    return F.when(archived, F.concat(F.lit("[ARCHIVED / SUPERSEDED] "), line)).otherwise(line)


def facts_around(triples: DataFrame, seeds: DataFrame, depth: int = 2, include_history: bool = False, closed_type: str = "PATIENT", closed: tuple[str, ...] = ("female", "male")) -> DataFrame:
    """The triples within ``depth`` hops of ``seeds`` (entity).

    The first hop goes both ways, except to subjects of ``closed_type``; later hops go from subject to
    object and never into entities of ``closed_type`` or named in ``closed``.  Triples whose state isn't
    ACTIVE count only with ``include_history``.  At least one hop is made.
    """
    live = triples if include_history else triples.where("state = 'ACTIVE'")
    front = seen = checkpointed(seeds.select("entity").distinct())
    inbound = live.where(~F.coalesce(F.col("subject_type"), F.lit("")).isin(closed_type) & (F.col("subject") != F.col("object")))
    found = inbound.join(front.withColumnRenamed("entity", "object"), "object", "left_semi").select(*triples.columns)
    for hop in range(max(1, depth)):
        outgoing = live.join(front.withColumnRenamed("entity", "subject"), "subject", "left_semi").select(*triples.columns)
        found = found.unionByName(outgoing)
        enter = outgoing.where((F.coalesce(F.col("object_type"), F.lit("")) != closed_type) & ~F.col("object").isin(*closed))
        front = enter.select(F.col("object").alias("entity")).distinct().join(seen, "entity", "left_anti")
        if hop + 1 < depth:
            front = checkpointed(front)
            seen = seen.unionByName(front)
    return found.distinct()


def resolve_seeds(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, entity): what each of ``names`` (name) means among ``entities`` (entity, label): by its slug, with
    patient_ as pt_, a bare number as a patient's, or by label."""
    from factloom.functions.text import slug

    s = slug(F.col("name"), default=None)
    cand = names.select("name", F.explode(F.array(
        F.struct(F.lit(1).alias("rank"), s.alias("key")),
        F.struct(F.lit(2).alias("rank"), F.regexp_replace(s, "^patient_", "pt_").alias("key")),
        F.struct(F.lit(3).alias("rank"), F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("pt_"), s)).alias("key")),
    )).alias("c")).select("name", "c.*")
    by_id = cand.join(entities, cand["key"] == entities["entity"]).select("name", "rank", "entity")
    by_label = names.join(entities, F.lower(F.trim("name")) == F.lower("label")).select("name", F.lit(4).alias("rank"), "entity")
    return by_id.unionByName(by_label).groupBy("name").agg(F.min_by("entity", F.struct("rank", "entity")).alias("entity"))


def statistics(records: DataFrame, edges: DataFrame, queue: DataFrame, n_entities: DataFrame) -> DataFrame:
    """(name, value): the counters of a knowledge base as one long table.

    Each table is read once: records are counted by tier and state, edges and queue by kind, and totals are summed from
    these few rows.
    """

    def rolled(df: DataFrame, total: str, **prefixes: str) -> DataFrame:
        counted = df.groupBy(*prefixes).agg(F.count("*").alias("n"))
        names = [F.struct(F.concat(F.lit(p), F.col(c).cast("string")).alias("name"), "n") for c, p in prefixes.items()]
        each = counted.select(F.inline(F.array(F.struct(F.lit(total).alias("name"), "n"), *names)))
        return each.groupBy("name").agg(F.sum("n").cast("long").alias("value"))

    distinct = records.agg(F.countDistinct("semantic_key").alias("semantic_keys"), F.countDistinct("source_id").alias("documents_ingested"))
    distinct = distinct.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("value")) for c in distinct.columns])))
    entities = n_entities.agg(F.count("*").alias("value")).select(F.lit("entities_total").alias("name"), "value")
    parts = [rolled(records, "records_total", tier="records_by_tier:T", state="nodes_by_state:"), rolled(edges, "edges_total", kind="edges_by_kind:"), rolled(queue, "queue_pending", kind="queue_by_kind:"), distinct, entities]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def in_blocks(facts: DataFrame) -> DataFrame:
    """Facts (text), those that hold before archived ones, each block by text."""
    return facts.orderBy(F.col("text").startswith("[ARCHIVED"), "text")


def answer(outcomes: DataFrame, facts: DataFrame, answers: DataFrame) -> DataFrame:
    """(root, reply) of questions by their plan's outcome (root, outcome), their facts (root, text) and a model's answers (root, answer).

    Nothing is said without authority, and nothing is made up without facts.
    """
    n = facts.groupBy("root").agg(F.count("*").alias("n"))
    met = outcomes.join(n, "root", "left").join(answers, "root", "left")
    reply = F.when(F.col("outcome") != "AUTHORIZED", F.concat(F.lit("withheld: "), "outcome")).when(F.coalesce("n", F.lit(0)) == 0, "no facts").otherwise(F.col("answer"))
    return met.select("root", reply.alias("reply"))
