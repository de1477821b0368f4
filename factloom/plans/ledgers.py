"""Queries over versions, states, reverts and collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions.frames import checkpointed
from factloom.operators import gate, graph, lifecycle, retrieval
from factloom.plans import fixtures as fx
from factloom.plans.registry import registry

QUERIES, ORACLES, query = registry()

#: The instant that ages are counted from.
NOW = "1999-01-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


@query(f"""WITH {fx.ORDER_RECORDS} SELECT record_id, semantic_key, CAST(owner_seq AS BIGINT) AS owner_seq, CAST(owner_seq + 1 AS BIGINT) AS version_no FROM records""")
def versions(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.versions(fx.order_records(spark, d)).select("record_id", "semantic_key", "owner_seq", "version_no")


@query(f"""WITH {fx.ORDER_RECORDS} SELECT semantic_key, arg_max(record_id, owner_seq) AS record_id, CAST(max(owner_seq) AS BIGINT) AS owner_seq FROM records GROUP BY semantic_key""")
def heads(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.heads(fx.order_records(spark, d))


@query(f"""WITH {fx.ORDER_RECORDS} SELECT record_id, lag(record_id) OVER (PARTITION BY semantic_key ORDER BY owner_seq) AS prior_id FROM records""")
def prior_version(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.versions(fx.order_records(spark, d)).select("record_id", "prior_id")


def _audit(spark: SparkSession, d: str) -> DataFrame:
    """Each version becomes active, and archived with the next; reviews flag and clear some again."""
    r = lifecycle.versions(fx.order_records(spark, d)).withColumn("next", F.lead("record_id").over(_by_key()))
    born = r.select(F.col("record_id").alias("node_id"), F.lit(None).cast("string").alias("from_state"), F.lit("ACTIVE").alias("to_state"), (F.col("owner_seq") * 4).alias("seq"))
    flagged = r.where("obj = 'P'").select(F.col("record_id").alias("node_id"), F.lit("ACTIVE").alias("from_state"), F.lit("FLAGGED").alias("to_state"), (F.col("owner_seq") * 4 + 1).alias("seq"))
    gone = r.where("next is not null").select(F.col("record_id").alias("node_id"), F.when(F.col("obj") == "P", "FLAGGED").otherwise("ACTIVE").alias("from_state"), F.when(F.col("obj") == "F", "TBD").otherwise("ARCHIVED").alias("to_state"), (F.col("owner_seq") * 4 + 2).alias("seq"))
    return born.unionByName(flagged).unionByName(gone)


def _by_key():
    from pyspark.sql import Window as W

    return W.partitionBy("semantic_key").orderBy("owner_seq")


_AUDIT = (
    fx.ORDER_RECORDS
    + """,
n AS (SELECT *, lead(record_id) OVER (PARTITION BY semantic_key ORDER BY owner_seq) AS next FROM records),
audit AS (
  SELECT record_id AS node_id, NULL AS from_state, 'ACTIVE' AS to_state, owner_seq * 4 AS seq FROM n
  UNION ALL SELECT record_id, 'ACTIVE', 'FLAGGED', owner_seq * 4 + 1 FROM n WHERE obj = 'P'
  UNION ALL SELECT record_id, CASE WHEN obj = 'P' THEN 'FLAGGED' ELSE 'ACTIVE' END, CASE WHEN obj = 'F' THEN 'TBD' ELSE 'ARCHIVED' END, owner_seq * 4 + 2 FROM n WHERE next IS NOT NULL),
states AS (SELECT node_id AS record_id, arg_max(to_state, seq) AS state FROM audit GROUP BY node_id)"""
)


@query(f"WITH {_AUDIT} SELECT record_id AS node_id, state FROM states")
def state_from_audit(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.states(_audit(spark, d))


#: What kind of event moves a user to which state.
_MOVES = {"signup": "ACTIVE", "click": "TBD", "error": "FLAGGED", "view": "ARCHIVED", "purchase": "DELETED"}


@query(f"""WITH m(kind, state) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _MOVES.items())}), ok(a, b) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, to in schemas.TRANSITIONS.items() for b in to)}),
t AS (SELECT 'u' || user_id AS node_id, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, state AS to_state, event_id AS seq FROM events JOIN m ON event_type = kind)
SELECT node_id, from_state, to_state, seq FROM t LEFT JOIN ok ON from_state = a AND to_state = b
WHERE CASE WHEN from_state IS NULL THEN to_state NOT IN ('ACTIVE', 'ARCHIVED') ELSE from_state <> to_state AND a IS NULL END""")
def illegal_transitions(spark: SparkSession, d: str) -> DataFrame:
    """The users' events as moves between states, and those that no node may make."""
    from pyspark.sql import Window as W

    kind = F.create_map(*[F.lit(x) for pair in _MOVES.items() for x in pair])
    e = fx.table(spark, d, "events").withColumn("to_state", F.try_element_at(kind, F.col("event_type"))).where("to_state is not null")
    before = F.lag("to_state").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    audit = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("node_id"), before.alias("from_state"), "to_state", F.col("event_id").alias("seq"))
    return lifecycle.illegal_transitions(audit)


@query(f"""WITH {fx.LINEAGE}, {_AUDIT},
children AS (SELECT src AS child, replace(dst, 'O-', 'rec_') AS parent FROM lineage WHERE src LIKE 'L-%')
SELECT child AS record_id, min(parent) AS cause, CASE WHEN length(child) % 2 = 0 THEN 'SYSTEM_1' ELSE 'SYSTEM_2' END AS routing
FROM children JOIN states ON parent = record_id WHERE state IN ('ARCHIVED', 'TBD') GROUP BY child""")
def cascade_flags(spark: SparkSession, d: str) -> DataFrame:
    gone = lifecycle.states(_audit(spark, d)).where("state in ('ARCHIVED', 'TBD')").select(F.col("node_id").alias("record_id"))
    deps = graph.direct_dependents(fx.lineage(spark, d).where("src like 'L-%'")).withColumn("parent", F.regexp_replace("parent", "^O-", "rec_"))
    children = deps.select(F.col("child").alias("record_id")).distinct().select("record_id", F.lit("ACTIVE").alias("state"), F.when(F.length("record_id") % 2 == 0, 3).otherwise(2).alias("tier"))
    return lifecycle.cascade(gone, deps, children)


@query(f"""WITH RECURSIVE {fx.FOLD} SELECT semantic_key || '@' || arrival AS item_id, CASE disposition WHEN 'QUEUE_SYSTEM_2' THEN 'SUPERSESSION_REVIEW' ELSE 'CONTRADICTION' END AS kind
FROM decided JOIN drafts USING (semantic_key, arrival) WHERE disposition IN ('QUEUE_SYSTEM_2', 'FLAG_CONTRADICTION') AND obj <> 'O'""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    held = gate.fold(fx.order_drafts(spark, d)).where("disposition in ('QUEUE_SYSTEM_2', 'FLAG_CONTRADICTION')")
    item = F.concat("semantic_key", F.lit("@"), F.col("arrival").cast("string"))
    kind = F.when(F.col("disposition") == "QUEUE_SYSTEM_2", "SUPERSESSION_REVIEW").otherwise("CONTRADICTION")
    asked = held.select(item.alias("item_id"), kind.alias("kind"), F.lit("SYSTEM_2").alias("routing"), F.lit(None).cast("string").alias("verdict"), "source_id", F.lit(0).alias("seq"))
    settled = held.where("obj in ('O', 'F')").select(item.alias("item_id"), kind.alias("kind"), F.lit("SYSTEM_2").alias("routing"), F.when(F.col("obj") == "O", "approve").otherwise("defer").alias("verdict"), "source_id", F.lit(1).alias("seq"))
    events = asked.unionByName(settled).withColumnRenamed("source_id", "record_id")
    return lifecycle.pending(events, routing="SYSTEM_2").select("item_id", "kind")


@query(f"""WITH {fx.ORDER_RECORDS},
t AS (SELECT semantic_key, min(owner_seq) AS f FROM records WHERE year(created_at) = 1997 GROUP BY semantic_key),
p AS (SELECT semantic_key, arg_max(record_id, owner_seq) FILTER (owner_seq < f) AS to_id, arg_max(record_id, owner_seq) AS from_id FROM records JOIN t USING (semantic_key) GROUP BY semantic_key)
SELECT semantic_key, from_id, to_id FROM p WHERE to_id IS NOT NULL""")
def revert_txn_plan(spark: SparkSession, d: str) -> DataFrame:
    r = fx.order_records(spark, d)
    return lifecycle.revert_plan(r, r.where(F.year("created_at") == 1997).select("semantic_key", "owner_seq"))


@query(f"""WITH {_AUDIT},
r AS (SELECT *, max(owner_seq) OVER (PARTITION BY semantic_key) AS newest FROM records JOIN states USING (record_id))
SELECT record_id, semantic_key FROM r WHERE state = 'ARCHIVED' AND newest > owner_seq AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at) > 365 * 86400000000
AND record_id NOT IN (SELECT record_id FROM records WHERE tier = 0)
AND semantic_key NOT IN (SELECT semantic_key FROM r WHERE state = 'TBD')""")
def gc_evictable(spark: SparkSession, d: str) -> DataFrame:
    r = fx.order_records(spark, d)
    now = r.join(lifecycle.states(_audit(spark, d)).withColumnRenamed("node_id", "record_id"), "record_id")
    waiting = now.where("state = 'TBD'").groupBy("semantic_key").agg(F.min("record_id").alias("child"))  # one is enough to hold a key's versions
    deps = now.select("record_id", "semantic_key").join(waiting, "semantic_key").select(F.col("record_id").alias("parent"), "child")
    return lifecycle.evictable(now, deps, r.where("tier = 0"), _now(), 365).select("record_id", "semantic_key")


@query(f"""WITH {_AUDIT},
f AS (SELECT semantic_key AS subject, obj AS object, state, created_at AS doc_date, source_id, date_diff('microsecond', created_at, TIMESTAMP '{NOW}') // 86400000000 AS days FROM records JOIN states USING (record_id)),
g AS (SELECT *, CASE WHEN state <> 'ACTIVE' THEN 'PAST' WHEN days <= 90 THEN 'CURRENT' ELSE 'CURRENT_STALE' END AS recency,
             subject || ' — current_status — ' || object || ' [source: ' || source_id || ']' AS base FROM f)
SELECT source_id, recency, CAST(days AS BIGINT) AS days_old,
       CASE recency WHEN 'PAST' THEN '[PAST / SUPERSEDED] ' || base WHEN 'CURRENT' THEN base
       ELSE '[CURRENT, but as of ' || strftime(doc_date, '%Y-%m-%d') || ' (' || days || ' days ago) — no more recent record exists; this may be outdated] ' || base END AS text FROM g""")
def temporal_classify(spark: SparkSession, d: str) -> DataFrame:
    r = fx.order_records(spark, d).join(lifecycle.states(_audit(spark, d)).withColumnRenamed("node_id", "record_id"), "record_id")
    facts = r.select(F.col("semantic_key").alias("subject"), F.lit("current_status").alias("predicate"), F.col("obj").alias("object"), "state", F.col("created_at").alias("doc_date"), "source_id")
    return retrieval.temporal_facts(facts, _now()).select("source_id", "recency", "days_old", "text")


@query(f"""WITH {fx.LINEAGE}, {_AUDIT}, {fx.STAR.replace('star AS', 'star AS')},
s AS (SELECT r.*, state FROM records r JOIN states USING (record_id)),
q AS (SELECT CASE WHEN state = 'FLAGGED' THEN 'CONTRADICTION' ELSE 'REDERIVE' END AS kind FROM s WHERE state IN ('FLAGGED', 'TBD'))
SELECT 'records_total' AS name, count(*) AS value FROM s UNION ALL SELECT 'semantic_keys', count(DISTINCT semantic_key) FROM s UNION ALL SELECT 'documents_ingested', count(DISTINCT source_id) FROM s
UNION ALL SELECT 'records_by_tier:T' || tier, count(*) FROM s GROUP BY tier UNION ALL SELECT 'nodes_by_state:' || state, count(*) FROM s GROUP BY state
UNION ALL SELECT 'edges_total', count(*) FROM lineage UNION ALL SELECT 'edges_by_kind:DERIVED_FROM', count(*) FROM lineage
UNION ALL SELECT 'queue_pending', count(*) FROM q UNION ALL SELECT 'queue_by_kind:' || kind, count(*) FROM q GROUP BY kind
UNION ALL SELECT 'entities_total', count(*) FROM (SELECT subject FROM star UNION SELECT object FROM star)""")
def kb_stats(spark: SparkSession, d: str) -> DataFrame:
    r = fx.order_records(spark, d).join(lifecycle.states(_audit(spark, d)).withColumnRenamed("node_id", "record_id"), "record_id")
    r = checkpointed(r.select("semantic_key", "source_id", "tier", "state"))
    queue = r.where("state in ('FLAGGED', 'TBD')").select(F.when(F.col("state") == "FLAGGED", "CONTRADICTION").otherwise("REDERIVE").alias("kind"))
    names = fx.star_triples(spark, d).select(F.explode(F.array("subject", "object")).alias("name")).distinct()
    return retrieval.statistics(r, fx.lineage(spark, d), queue, names)


@query(f"""WITH {fx.ORDER_RECORDS},
f AS (SELECT semantic_key AS root, semantic_key, arg_max(record_id, owner_seq) FILTER (year(created_at) < 1998) AS used, arg_max(record_id, owner_seq) AS held FROM records GROUP BY semantic_key)
SELECT root, CASE WHEN used = held THEN 'AUTHORIZED' ELSE 'REPLAN_REQUIRED' END AS outcome FROM f""")
def planfence_outcomes(spark: SparkSession, d: str) -> DataFrame:
    r = fx.order_records(spark, d)
    used = lifecycle.heads(r.where(F.year("created_at") < 1998)).select(F.col("semantic_key").alias("root"), "semantic_key", "record_id")
    needs = r.select(F.col("semantic_key").alias("root"), "semantic_key").distinct()
    return lifecycle.plan_outcomes(used, lifecycle.heads(r), needs)


@query(f"""WITH {fx.ORDER_RECORDS},
f AS (SELECT semantic_key AS root, arg_max(record_id, owner_seq) FILTER (year(created_at) < 1997) AS used, arg_max(record_id, owner_seq) FILTER (owner_seq >= 2) AS held FROM records GROUP BY semantic_key),
c AS (SELECT f.*, coalesce(t.tier <> 0, false) AS derives FROM f LEFT JOIN records t ON used = t.record_id)
SELECT root, CASE WHEN used IS NULL OR held IS NULL THEN 'BLOCKED' WHEN used <> held OR NOT derives THEN 'REPLAN_REQUIRED' ELSE 'AUTHORIZED' END AS outcome,
CASE WHEN used IS NULL THEN 'incomplete lineage' WHEN held IS NULL THEN 'no head' WHEN used <> held THEN 'stale dependencies' WHEN NOT derives THEN 'does not derive' ELSE 'validated' END AS reason,
CASE WHEN used <> held THEN [root] ELSE [] END AS stale FROM c""")
def plan_checks(spark: SparkSession, d: str) -> DataFrame:
    """Plans that rest on each key's last version before a year; heads are known from the third version on, and plans derive from what isn't of the first tier."""
    r = fx.order_records(spark, d)
    used = lifecycle.heads(r.where(F.year("created_at") < 1997)).select(F.col("semantic_key").alias("root"), "semantic_key", "record_id")
    needs = r.select(F.col("semantic_key").alias("root"), "semantic_key").distinct()
    reached = r.where("tier <> 0").select(F.col("semantic_key").alias("root"), F.col("record_id").alias("node"))
    return lifecycle.plan_checks(used, lifecycle.heads(r.where("owner_seq >= 2")), needs, reached)


@query(f"""WITH {_AUDIT},
s AS (SELECT semantic_key, state, obj FROM records JOIN states USING (record_id) WHERE state IN ('ACTIVE', 'ARCHIVED', 'FLAGGED'))
SELECT semantic_key, state, count(*) AS n, string_agg(obj, ',' ORDER BY obj) AS objects FROM s GROUP BY ALL""")
def patient_summary(spark: SparkSession, d: str) -> DataFrame:
    r = fx.order_records(spark, d).join(lifecycle.states(_audit(spark, d)).withColumnRenamed("node_id", "record_id"), "record_id")
    kept = r.where("state in ('ACTIVE', 'ARCHIVED', 'FLAGGED')")
    return kept.groupBy("semantic_key", "state").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("obj")), ",").alias("objects"))
