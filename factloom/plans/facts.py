"""Queries over drafts, versions and triples as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import gate, ordering, retrieval, triples
from factloom.plans import fixtures as fx
from factloom.plans.registry import registry

QUERIES, ORACLES, query = registry()

_NAMED = fx.STAR + """,
names AS (SELECT subject AS name, ordinal, subject_type AS st, NULL AS ot FROM star UNION ALL SELECT object, ordinal + 288230376151711744, NULL, object_type FROM star),
entities AS (SELECT row_number() OVER (ORDER BY min(ordinal)) - 1 AS entity_id, name AS entity_name,
                    coalesce(arg_min(st, ordinal) FILTER (st IS NOT NULL), arg_min(ot, ordinal) FILTER (ot IS NOT NULL), 'Unknown') AS entity_type FROM names GROUP BY name),
relations AS (SELECT row_number() OVER (ORDER BY min(ordinal)) - 1 AS relation_id, predicate AS relation_name FROM star GROUP BY predicate)"""


@query(f"WITH {_NAMED} SELECT CAST(entity_id AS BIGINT) AS entity_id, entity_name, entity_type FROM entities")
def triple_entities(spark: SparkSession, d: str) -> DataFrame:
    return triples.entities(fx.star_triples(spark, d))


@query(f"WITH {_NAMED} SELECT CAST(relation_id AS BIGINT) AS relation_id, relation_name FROM relations")
def triple_relations(spark: SparkSession, d: str) -> DataFrame:
    return triples.relations(fx.star_triples(spark, d))


@query(f"""WITH {_NAMED} SELECT CAST(a.entity_id AS BIGINT) AS entity_id_1, CAST(relation_id AS BIGINT) AS relation_id, CAST(b.entity_id AS BIGINT) AS entity_id_2
FROM star JOIN entities a ON subject = a.entity_name JOIN entities b ON object = b.entity_name JOIN relations ON predicate = relation_name""")
def triples_to_ids(spark: SparkSession, d: str) -> DataFrame:
    t = fx.star_triples(spark, d)
    return triples.over_ids(t, triples.entities(t), triples.relations(t))


@query(f"WITH {fx.STAR} SELECT subject, object, arg_max(predicate, ordinal) AS predicate FROM star GROUP BY subject, object")
def graph_last_edge_wins(spark: SparkSession, d: str) -> DataFrame:
    return triples.last_edge_wins(fx.star_triples(spark, d))


@query(f"""WITH {fx.EVENT_DRAFTS},
e AS (SELECT *, lag(obj) OVER (PARTITION BY semantic_key ORDER BY valid_from, arrival) AS before FROM drafts)
SELECT arrival, semantic_key, CASE WHEN before IS DISTINCT FROM obj THEN 'AUTO_COMMIT' ELSE 'NO_OP' END AS disposition,
       CAST(sum(CAST(before IS DISTINCT FROM obj AS INT)) OVER (PARTITION BY semantic_key ORDER BY valid_from, arrival ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS owner_seq FROM e""")
def gate_events_window(spark: SparkSession, d: str) -> DataFrame:
    return gate.fold_steady(fx.event_drafts(spark, d)).select("arrival", "semantic_key", "disposition", "owner_seq")


@query(f"WITH RECURSIVE {fx.FOLD} SELECT semantic_key, arrival, reason, disposition, head_arrival, owner_seq FROM decided")
def gate_orders_fold(spark: SparkSession, d: str) -> DataFrame:
    return gate.fold(fx.order_drafts(spark, d)).select("semantic_key", "arrival", "reason", "disposition", "head_arrival", "owner_seq")


@query(f"WITH RECURSIVE {fx.FOLD} SELECT disposition, reason, count(*) AS n FROM decided GROUP BY ALL")
def disposition_histogram(spark: SparkSession, d: str) -> DataFrame:
    return gate.histogram(gate.fold(fx.order_drafts(spark, d)))


@query(f"""WITH RECURSIVE {fx.FOLD},
heads AS (SELECT semantic_key, clean, tier, auto, valid_from, source_id FROM drafts JOIN (SELECT semantic_key, max(arrival) AS arrival FROM decided WHERE disposition = 'AUTO_COMMIT' GROUP BY semantic_key) USING (semantic_key, arrival)),
last AS (SELECT * FROM drafts QUALIFY row_number() OVER (PARTITION BY semantic_key ORDER BY arrival DESC) = 1)
SELECT l.semantic_key, CASE WHEN l.clean = h.clean THEN 'NO_OP' WHEN l.valid_from = h.valid_from THEN 'FLAG_CONTRADICTION' WHEN l.tier > h.tier OR (l.tier = h.tier AND l.valid_from < h.valid_from) THEN 'NO_OP'
       WHEN h.tier <> 0 AND h.auto AND l.auto THEN 'AUTO_COMMIT' ELSE 'QUEUE_SYSTEM_2' END AS disposition
FROM last l JOIN heads h USING (semantic_key)""")
def gate_last_against_head(spark: SparkSession, d: str) -> DataFrame:
    drafts = fx.order_drafts(spark, d)
    head = gate.committed(gate.fold(drafts)).groupBy("semantic_key").agg(F.max_by(F.struct("obj", "tier", "auto_update", "valid_from"), "arrival").alias("h")).select("semantic_key", "h.*")
    columns = [c for c in drafts.columns if c != "semantic_key"]
    last = drafts.groupBy("semantic_key").agg(F.max_by(F.struct(*columns), "arrival").alias("l")).select("semantic_key", "l.*")
    return gate.judge(last, head).select("semantic_key", "disposition")


@query(f"""WITH {fx.EVENT_DRAFTS},
f AS (SELECT semantic_key, obj, 'stream:' || event_type AS source_id, strftime(valid_from, '%Y-%m-%d') AS doc_date, arrival FROM drafts),
d AS (SELECT semantic_key, obj, doc_date, min(arrival) AS a FROM f GROUP BY ALL)
SELECT semantic_key, obj, count(*) AS mention_count, arg_max(source_id, arrival) AS source_id, arg_max(doc_date, arrival) AS doc_date,
       (SELECT string_agg(doc_date, ',' ORDER BY a) FROM d WHERE d.semantic_key = f.semantic_key AND d.obj = f.obj) AS doc_dates FROM f GROUP BY semantic_key, obj""")
def mention_rollup(spark: SparkSession, d: str) -> DataFrame:
    facts = fx.event_drafts(spark, d).withColumn("doc_date", F.date_format("valid_from", "yyyy-MM-dd"))
    return retrieval.mentions(facts).select("semantic_key", "obj", "mention_count", "source_id", "doc_date", F.array_join("doc_dates", ",").alias("doc_dates"))


@query("""WITH h AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
r AS (SELECT doc_id, row_number() OVER (ORDER BY substr(h, 1, 7), doc_id) - 1 AS i, count(*) OVER () AS n FROM h)
SELECT doc_id, CASE WHEN i < CAST(floor(round(n * 0.8, 6)) AS BIGINT) THEN 'train' WHEN i < CAST(floor(round(n * 0.9, 6)) AS BIGINT) THEN 'valid' ELSE 'test' END AS split FROM r""")
def split_80_10_10(spark: SparkSession, d: str) -> DataFrame:
    from factloom.functions.frames import table

    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("_tie"))
    key = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 7), 16, 10).cast("int")
    return ordering.ratio_split(docs, key, (0.8, 0.1, 0.1), ("train", "valid", "test"), docs.count()).select("doc_id", "split")


@query(f"""WITH {fx.ORDER_DRAFTS},
k AS (SELECT semantic_key, obj, tier, arrival, CAST(arrival AS VARCHAR) AS a FROM drafts)
SELECT a AS arrival, semantic_key, CAST(row_number() OVER (PARTITION BY semantic_key ORDER BY k.arrival) AS BIGINT) AS mention_no,
       CAST(count(*) OVER (PARTITION BY semantic_key, obj ORDER BY k.arrival ROWS UNBOUNDED PRECEDING) AS BIGINT) AS same_value_so_far FROM k""")
def running_mentions(spark: SparkSession, d: str) -> DataFrame:
    by_key = W.partitionBy("semantic_key").orderBy("arrival")
    by_value = W.partitionBy("semantic_key", "obj").orderBy("arrival").rowsBetween(W.unboundedPreceding, W.currentRow)
    return fx.order_drafts(spark, d).select(F.col("arrival").cast("string").alias("arrival"), "semantic_key", F.row_number().over(by_key).cast("long").alias("mention_no"), F.count("*").over(by_value).alias("same_value_so_far"))


@query(None)
def record_ids(spark: SparkSession, d: str) -> DataFrame:
    r = fx.order_records(spark, d)
    return r.select("record_id", tx.record_id(F.col("semantic_key"), F.col("obj"), F.lit("current_status"), F.lit("gate"), F.array().cast("array<string>"), F.col("owner_seq")).alias("content_id"))
