"""Queries over what the gate writes: versions, edges, states, reviews, reverts and collection."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions.frames import ensure_checkpoint_dir, table
from factloom.operators import commit, feed, gate, lifecycle
from factloom.plans import fixtures as fx
from factloom.plans import ledgers, words
from factloom.plans.registry import registry
from factloom.sources import keyed

QUERIES, ORACLES, query = registry()


@query("""WITH k AS (SELECT 'C-' || c_custkey AS id FROM customer WHERE c_acctbal >= 0)
SELECT o_orderkey AS draft_id, CASE WHEN o_orderkey % 11 = 0 THEN 'no writer identity' WHEN 'C-' || o_custkey NOT IN (FROM k) THEN 'missing parent C-' || o_custkey
       WHEN o_orderkey % 13 = 0 THEN 'missing parent C-lost' WHEN o_custkey % 7 = 0 THEN 'lost head h' || o_custkey ELSE 'fine' END AS reason FROM orders""")
def gate_fail_closed(spark: SparkSession, d: str) -> DataFrame:
    """Why drafts are refused before anything is decided about them."""
    drafts = fx.order_drafts(spark, d).withColumn("draft_id", F.regexp_replace("source_id", "order:", "").cast("long")).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("draft_id"), "o_custkey"), "draft_id")
    customer = F.concat(F.lit("C-"), F.col("o_custkey").cast("string"))
    drafts = drafts.withColumn("writer", F.when(F.col("draft_id") % 11 == 0, "").otherwise("sales")).withColumn("parent_ids", F.when(F.col("draft_id") % 13 == 0, F.array(customer, F.lit("C-lost"))).otherwise(F.array(customer)))
    known = table(spark, d, "customer").where("c_acctbal >= 0").select(F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("record_id"))
    heads = drafts.select("semantic_key", F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("record_id"), (F.col("o_custkey") % 7 != 0).alias("there")).distinct()
    checked = commit.unknown_heads(commit.missing_parents(drafts, known), heads, heads.where("there"))
    return checked.select("draft_id", F.coalesce(gate.malformed(checked), F.lit("fine")).alias("reason"))


def _folded(spark: SparkSession, d: str) -> DataFrame:
    """The fold of the orders' drafts, with ids, parents and the ends of each fact."""
    folded = gate.fold(fx.order_drafts(spark, d))
    customer = F.regexp_extract("semantic_key", "^customer_(\\d+)", 1)
    return folded.withColumns({
        "draft_id": F.regexp_replace("source_id", "order:", ""), "parent_ids": F.array(F.concat(F.lit("C-"), customer)),
        "subject_ref": F.concat(F.lit("customer_"), customer), "subject_label": F.concat(F.lit("Customer "), customer), "subject_type": F.when(F.col("tier") >= 2, "PERSON").otherwise(" "),
        "object_ref": F.concat(F.lit("status_"), F.lower("obj")), "object_label": F.col("obj"), "object_type": F.lit("CONCEPT"),
    })


_VERSIONS = f"""{fx.FOLD},
done AS (SELECT semantic_key, arrival, owner_seq, obj, tier, 'rec_' || replace(source_id, 'order:', '') AS record_id, split_part(semantic_key, '::', 1) AS subject_ref
         FROM decided JOIN drafts USING (semantic_key, arrival) WHERE disposition = 'AUTO_COMMIT'),
v AS (SELECT *, lag(record_id) OVER (PARTITION BY semantic_key ORDER BY owner_seq) AS prev_id FROM done)"""


@query(f"WITH RECURSIVE {_VERSIONS} SELECT record_id, semantic_key, CAST(owner_seq AS BIGINT) AS owner_seq, prev_id, 'derived' AS record_type FROM v")
def committed_versions(spark: SparkSession, d: str) -> DataFrame:
    return commit.versions(_folded(spark, d)).select("record_id", "semantic_key", "owner_seq", "prev_id", "record_type")


@query(f"""WITH RECURSIVE {_VERSIONS} SELECT record_id AS src, prev_id AS dst, 'SUPERSEDES' AS kind FROM v WHERE prev_id IS NOT NULL
UNION ALL SELECT record_id, subject_ref, 'SUBJECT' FROM v UNION ALL SELECT record_id, 'status_' || lower(obj), 'OBJECT' FROM v
UNION ALL SELECT record_id, replace(subject_ref, 'customer_', 'C-'), 'DERIVED_FROM' FROM v""")
def commit_edges(spark: SparkSession, d: str) -> DataFrame:
    return commit.edges(commit.versions(_folded(spark, d))).select("src", "dst", "kind")


@query(f"""WITH RECURSIVE {_VERSIONS} SELECT record_id, CASE WHEN owner_seq = max(owner_seq) OVER (PARTITION BY semantic_key) THEN 'ACTIVE' ELSE 'ARCHIVED' END AS state FROM v
UNION ALL SELECT DISTINCT replace(subject_ref, 'customer_', 'C-'), 'ARCHIVED' FROM v""")
def commit_states(spark: SparkSession, d: str) -> DataFrame:
    """The states of all nodes after the commits, those of parents that had no node of their own included."""
    versions = commit.versions(_folded(spark, d))
    states = lifecycle.states(commit.audit(versions)).withColumnRenamed("node_id", "record_id")
    return states.unionByName(commit.materialised(commit.edges(versions), versions))


@query(f"""WITH RECURSIVE {_VERSIONS} SELECT subject_ref AS entity, replace(subject_ref, 'customer_', 'Customer ') AS label, CASE WHEN bool_or(tier >= 2) THEN 'PERSON' END AS entity_type FROM v GROUP BY subject_ref
UNION ALL SELECT 'status_' || lower(obj), min(obj), 'CONCEPT' FROM v GROUP BY lower(obj)""")
def commit_entities(spark: SparkSession, d: str) -> DataFrame:
    return commit.entities(commit.versions(_folded(spark, d)))[0]


_REVIEWS = f"""{_VERSIONS},
heads AS (SELECT semantic_key, arg_max(record_id, owner_seq) AS held, max(owner_seq) AS held_seq FROM v GROUP BY semantic_key),
items AS (SELECT 'item_' || replace(source_id, 'order:', '') AS item_id, CAST(replace(source_id, 'order:', '') AS BIGINT) AS n, d.semantic_key, d.arrival, v.record_id AS active_id,
                 CASE disposition WHEN 'QUEUE_SYSTEM_2' THEN 'SUPERSESSION_REVIEW' ELSE 'CONTRADICTION' END AS kind
          FROM decided d JOIN drafts USING (semantic_key, arrival) JOIN v ON v.semantic_key = d.semantic_key AND v.arrival = d.head_arrival
          WHERE disposition IN ('QUEUE_SYSTEM_2', 'FLAG_CONTRADICTION'))"""


@query(f"""WITH RECURSIVE {_REVIEWS},
m AS (SELECT *, coalesce(held = active_id, false) AS same, row_number() OVER (PARTITION BY semantic_key, coalesce(held = active_id, false) ORDER BY arrival, item_id) AS rn
      FROM items LEFT JOIN heads USING (semantic_key) WHERE kind = 'SUPERSESSION_REVIEW' AND n % 2 = 0)
SELECT item_id, semantic_key, CASE WHEN same AND rn = 1 THEN 'AUTO_COMMIT' ELSE 'QUEUE_SYSTEM_2' END AS disposition, CASE WHEN same AND rn = 1 THEN 'SYSTEM_2 approved' ELSE 'the head has moved' END AS detail,
       CASE WHEN same AND rn = 1 THEN 'rec_' || n END AS record_id, CASE WHEN same AND rn = 1 THEN active_id END AS prev_id, CAST(CASE WHEN same AND rn = 1 THEN held_seq + 1 END AS BIGINT) AS owner_seq FROM m""")
def approved_reviews(spark: SparkSession, d: str) -> DataFrame:
    folded = _folded(spark, d)
    heads = lifecycle.heads(commit.versions(folded).select("semantic_key", "record_id", "owner_seq"))
    approvals = folded.where("cast(draft_id as long) % 2 = 0").select(F.concat(F.lit("item_"), "draft_id").alias("item_id"), F.col("arrival").alias("seq"))
    return commit.approve(commit.queue_items(folded), approvals, heads)


@query(f"""WITH RECURSIVE {_REVIEWS} SELECT item_id, kind, active_id AS record_id FROM items WHERE n % 3 <> 0""")
def pending_after_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What is still in the queue after verdicts: every third item is settled, every fifth of the others put off."""
    items = commit.queue_items(_folded(spark, d))
    n = F.regexp_extract("item_id", "(\\d+)", 1).cast("long")
    verdict = F.when(n % 3 == 0, F.when(n % 2 == 0, "approve").otherwise("reject")).when(n % 5 == 0, "defer")
    settled = commit.decide(items, items.select("item_id", verdict.alias("verdict"), F.lit(1).alias("seq")).where("verdict is not null"))
    asked = items.select("item_id", "kind", "routing", F.lit(None).cast("string").alias("verdict"), F.col("active_id").alias("record_id"), F.lit(0).alias("seq"))
    return lifecycle.pending(asked.unionByName(settled), routing="SYSTEM_2").select("item_id", "kind", "record_id")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """For each key a request to go back to its first version; some name an unknown record or that of another key."""
    first = fx.order_records(spark, d).where("owner_seq = 0").withColumn("n", F.regexp_extract("semantic_key", "(\\d+)", 1).cast("long"))
    target = F.when(F.col("n") % 19 == 0, "rec_none").otherwise(F.col("record_id"))
    key = F.when(F.col("n") % 17 == 0, F.concat("semantic_key", F.lit("x"))).otherwise(F.col("semantic_key"))
    return first.select(key.alias("semantic_key"), target.alias("target_id"), F.when(F.col("n") % 2 == 0, "SYSTEM_2").otherwise("SYSTEM_1").alias("actor"))


_REVERTS = f"""{ledgers._AUDIT},
heads AS (SELECT semantic_key, arg_max(record_id, owner_seq) AS held, max(owner_seq) AS held_seq FROM records GROUP BY semantic_key),
first AS (SELECT *, CAST(regexp_extract(semantic_key, '(\\d+)', 1) AS BIGINT) AS n FROM records WHERE owner_seq = 0),
asked AS (SELECT CASE WHEN n % 17 = 0 THEN semantic_key || 'x' ELSE semantic_key END AS semantic_key, CASE WHEN n % 19 = 0 THEN 'rec_none' ELSE record_id END AS target_id, CASE WHEN n % 2 = 0 THEN 'SYSTEM_2' ELSE 'SYSTEM_1' END AS actor FROM first),
judged AS (SELECT a.semantic_key, target_id, held, held_seq,
  CASE WHEN r.record_id IS NULL THEN 'unknown record' WHEN r.semantic_key <> a.semantic_key THEN 'other key' WHEN coalesce(state, 'ARCHIVED') NOT IN ('ARCHIVED', 'DELETED') THEN 'not archived'
       WHEN epoch_us(TIMESTAMP '{ledgers.NOW}') - epoch_us(created_at) > 2000 * 86400000000 THEN 'past retention' WHEN tier <= 2 AND actor <> 'SYSTEM_2' THEN 'needs SYSTEM_2' END AS fault
  FROM asked a LEFT JOIN records r ON target_id = r.record_id LEFT JOIN states s ON s.record_id = target_id LEFT JOIN heads h ON h.semantic_key = a.semantic_key),
outcomes AS (SELECT *, fault IS NULL AND held IS DISTINCT FROM target_id AS moved FROM judged)"""


@query(f"WITH {_REVERTS} SELECT semantic_key, target_id, fault, moved, CASE WHEN moved THEN held END AS from_id, CAST(CASE WHEN moved THEN coalesce(held_seq + 1, 0) END AS BIGINT) AS owner_seq FROM outcomes")
def revert_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d)


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    records = fx.order_records(spark, d)
    states = lifecycle.states(ledgers._audit(spark, d)).withColumnRenamed("node_id", "record_id")
    return commit.revert(_requests(spark, d), records, states, lifecycle.heads(records), ledgers._now(), 2000)


@query(f"""WITH {_REVERTS} SELECT 'heads' AS written, semantic_key AS a, target_id AS b, CAST(held_seq + 1 AS VARCHAR) AS c FROM outcomes WHERE moved
UNION ALL SELECT 'states', target_id, 'ACTIVE', NULL FROM outcomes WHERE moved UNION ALL SELECT 'states', held, 'ARCHIVED', NULL FROM outcomes WHERE moved AND held IS NOT NULL
UNION ALL SELECT 'edges', target_id, held, 'REVERTED_FROM' FROM outcomes WHERE moved AND held IS NOT NULL
UNION ALL SELECT 'flagged', 'L-' || l_orderkey || '-' || l_linenumber, held, 'SYSTEM_2' FROM outcomes JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON held = 'rec_' || l_orderkey WHERE moved""")
def revert_writes(spark: SparkSession, d: str) -> DataFrame:
    """Heads, states, edges and flagged dependents that the reverts write, as one long table."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    child = F.concat_ws("-", F.lit("L"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    deps = lines.select(F.concat(F.lit("rec_"), F.col("l_orderkey").cast("string")).alias("parent"), child.alias("child"))
    current = lines.select(child.alias("record_id"), F.lit("ACTIVE").alias("state"), F.lit(2).alias("tier"))
    written = commit.revert_writes(_outcomes(spark, d), deps, current)
    row = lambda name, a, b, c: written[name].select(F.lit(name).alias("written"), a.alias("a"), b.alias("b"), c.alias("c"))
    none = F.lit(None).cast("string")
    return (
        row("heads", F.col("semantic_key"), F.col("record_id"), F.col("owner_seq").cast("string")).unionByName(row("states", F.col("node_id"), F.col("to_state"), none))
        .unionByName(row("edges", F.col("src"), F.col("dst"), F.col("kind"))).unionByName(row("flagged", F.col("record_id"), F.col("cause"), F.col("routing")))
    )


@query(f"""WITH {fx.ORDER_RECORDS},
t AS (SELECT semantic_key, min(owner_seq) AS f FROM records WHERE year(created_at) = 1996 AND tier < 3 GROUP BY semantic_key),
p AS (SELECT semantic_key, arg_max(record_id, owner_seq) FILTER (owner_seq < f) AS target_id FROM records JOIN t USING (semantic_key) GROUP BY semantic_key)
SELECT semantic_key, target_id, 'SYSTEM_2' AS actor FROM p WHERE target_id IS NOT NULL""")
def revert_txn_requests(spark: SparkSession, d: str) -> DataFrame:
    """The reverts that take the transactions of a year back."""
    records = fx.order_records(spark, d).withColumn("txn_id", F.concat(F.year("created_at").cast("string"), F.when(F.col("tier") < 3, "a").otherwise("b")))
    return commit.revert_txn(records, spark.createDataFrame([("1996a",), ("1996a",)], "txn_id string"), "SYSTEM_2")


@query(f"""WITH {ledgers._AUDIT},
e AS (SELECT record_id, semantic_key, owner_seq, obj, state, created_at, max(owner_seq) OVER (PARTITION BY semantic_key) AS newest FROM records JOIN states USING (record_id)),
c AS (SELECT * FROM e WHERE state = 'ARCHIVED' AND newest > owner_seq AND epoch_us(TIMESTAMP '{ledgers.NOW}') - epoch_us(created_at) > 365 * 86400000000 ORDER BY created_at, record_id LIMIT 100)
SELECT record_id, semantic_key, obj, CAST(owner_seq AS BIGINT) AS owner_seq, state AS from_state, 'DELETED' AS to_state FROM c""")
def gc_sweep(spark: SparkSession, d: str) -> DataFrame:
    """One sweep's cold rows with their audit rows."""
    states = lifecycle.states(ledgers._audit(spark, d)).withColumnRenamed("node_id", "record_id")
    records = fx.order_records(spark, d).join(states, "record_id")
    none = spark.createDataFrame([], "parent string, child string")
    gone = lifecycle.sweep(lifecycle.evictable(records, none, spark.createDataFrame([], "record_id string"), ledgers._now(), 365))
    written = commit.swept(gone.withColumn("txn_id", F.lit("t")))
    return written["cold"].join(written["audit"], F.col("record_id") == F.col("node_id")).select("record_id", "semantic_key", "obj", "owner_seq", "from_state", "to_state")


@query(f"""WITH {ledgers._AUDIT}, k AS (SELECT 'customer_' || c_custkey || '::current_status' AS semantic_key FROM customer),
h AS (SELECT semantic_key, arg_max(record_id, owner_seq) AS record_id, max(owner_seq) AS owner_seq FROM records WHERE year(created_at) < 1994 GROUP BY semantic_key)
SELECT semantic_key, record_id, CAST(h.owner_seq AS BIGINT) AS owner_seq, obj, CASE WHEN record_id IS NULL THEN NULL ELSE coalesce(state, 'EVICTED') END AS state, record_id IS NOT NULL AS found
FROM k LEFT JOIN h USING (semantic_key) LEFT JOIN (SELECT record_id, obj FROM records) USING (record_id) LEFT JOIN (SELECT * FROM states WHERE state <> 'TBD') USING (record_id)""")
def head_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's head before a year, and which keys have none."""
    records = fx.order_records(spark, d)
    keys = table(spark, d, "customer").select(F.concat(F.lit("customer_"), F.col("c_custkey").cast("string"), F.lit("::current_status")).alias("semantic_key"))
    states = lifecycle.states(ledgers._audit(spark, d)).where("state <> 'TBD'").withColumnRenamed("node_id", "record_id")
    return commit.lookup(keys, lifecycle.heads(records.where(F.year("created_at") < 1994)), records, states)


_KEYWORDS = ", ".join(f"({k}, '{w}', '{p}', '{x}')" for k, (w, p, x) in enumerate(words.KEYWORDS))
_INGEST = f"""
drafts AS (SELECT source || '::' || lower(predicate) AS semantic_key, lower(label) AS clean, label AS obj, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 ELSE 4 END AS tier, lang <> 'en' AS auto,
                  TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 97 AS INTEGER)) AS valid_from, doc_id * 8 + k AS arrival, 'doc:' || doc_id AS source_id
           FROM documents, (VALUES {_KEYWORDS}) AS k(k, word, predicate, label) WHERE contains(lower(text), word)),{fx.FOLD_STEPS}"""


def _ingested(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    low = F.lower("text")
    facts = [F.when(low.contains(w), F.struct(F.lit(k).alias("k"), F.lit(p).alias("predicate"), F.lit(x).alias("obj"))) for k, (w, p, x) in enumerate(words.KEYWORDS)]
    found = docs.select("doc_id", "source", "lang", F.inline(F.filter(F.array(*facts), lambda x: x.isNotNull())))
    drafts = found.select(
        tx.semantic_key(F.col("source"), F.col("predicate")).alias("semantic_key"), F.lower("predicate").alias("predicate"), "obj",
        F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2).otherwise(4).alias("tier"), (F.col("lang") != "en").alias("auto_update"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") % 97 * 86_400).alias("valid_from"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_id"), (F.col("doc_id") * 8 + F.col("k")).alias("arrival"),
    )
    return gate.fold(gate.resolve_aliases(drafts).drop("original_key"))


@query(f"WITH RECURSIVE {_INGEST} SELECT semantic_key, disposition, reason, count(*) AS n, max(arrival) AS last FROM decided GROUP BY ALL")
def ingest_chain(spark: SparkSession, d: str) -> DataFrame:
    """Documents to facts to drafts, drafts to known keys, and these through the gate: what became of them."""
    return _ingested(spark, d).groupBy("semantic_key", "disposition", "reason").agg(F.count("*").alias("n"), F.max("arrival").alias("last"))


@query(f"""WITH {fx.ORDER_RECORDS},
m AS (SELECT semantic_key, max(owner_seq) FILTER (owner_seq % 2 = 1) AS held FROM records GROUP BY semantic_key),
j AS (SELECT r.*, CASE WHEN owner_seq % 2 = 1 THEN 'added' WHEN tier = 4 THEN 'other owner' WHEN owner_seq < held THEN 'head has moved' ELSE 'added' END AS outcome FROM records r JOIN m USING (semantic_key))
SELECT semantic_key, arg_max(record_id, owner_seq) AS record_id, max(owner_seq) AS owner_seq, 'head' AS outcome FROM j WHERE outcome = 'added' GROUP BY semantic_key
UNION ALL SELECT semantic_key, record_id, owner_seq, outcome FROM j WHERE outcome <> 'added'""")
def head_commits(spark: SparkSession, d: str) -> DataFrame:
    """The heads after two writers have committed every other version each, and the moves that were refused."""
    heads = keyed.KeyedTable(spark, f"{ensure_checkpoint_dir(spark)}/heads-{uuid.uuid4().hex}", "semantic_key string, record_id string, owner string, owner_seq long", ("semantic_key",), "owner_seq", buckets=16)
    writer = F.when((F.col("owner_seq") % 2 == 0) & (F.col("tier") == 4), "web").otherwise("sales")
    moves = fx.order_records(spark, d).select("semantic_key", "record_id", F.lit("sales").alias("owner"), "owner_seq", writer.alias("writer"))
    refused = [heads.commit(moves.where(F.col("owner_seq") % 2 == odd), keyed.judge_heads)[1] for odd in (1, 0)]
    told = refused[0].unionByName(refused[1]).select("semantic_key", "record_id", "owner_seq", F.col("fault").alias("outcome"))
    return heads.read().select("semantic_key", "record_id", "owner_seq", F.lit("head").alias("outcome")).unionByName(told)


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def stream_upserts(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user and kind, from a stream that is run to its end into a keyed table."""
    folder = f"{ensure_checkpoint_dir(spark)}/upserts-{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    kind = dict(events.dtypes)
    last = keyed.KeyedTable(spark, f"{folder}/table", f"user_id {kind['user_id']}, event_type {kind['event_type']}, value {kind['value']}, event_id {kind['event_id']}", ("user_id", "event_type"), "event_id", buckets=16)
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*").select("user_id", "event_type", "value", "event_id")
    last.follow(stream, "events").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return last.read()


@query("""WITH p AS (SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents)
SELECT doc_id, source, CAST(n_chars AS BIGINT) AS n_chars, CASE WHEN place < round_even(n * 0.8, 0) THEN 'train' ELSE 'holdout' END AS part FROM p""")
def case_feed(spark: SparkSession, d: str) -> DataFrame:
    """Documents fed as cases in batches, four fifths of them, from a table that is read back; the rest is the holdout."""
    folder = f"{ensure_checkpoint_dir(spark)}/feed-{uuid.uuid4().hex}"
    cases = table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("n_chars").cast("long").alias("n_chars"))
    fed = keyed.KeyedTable(spark, f"{folder}/table", "doc_id long, source string, n_chars long, place long", ("doc_id",), "place", buckets=16)
    feed.feed(cases, "doc_id", 0.8, fed, folder, lambda rows: rows.withColumn("place", F.col("doc_id")), size=300, together=64)
    trained = fed.read().drop("place").withColumn("part", F.lit("train"))
    return trained.unionByName(spark.read.schema(cases.schema).parquet(f"{folder}/holdout").withColumn("part", F.lit("holdout")))


@query("""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, (CASE WHEN o_orderstatus = 'F' THEN 'rec_archived_' ELSE 'rec_' END) || 'customer_' || o_custkey || '_ordered_' || o_orderkey AS id,
  CASE WHEN o_orderstatus = 'F' THEN 'ARCHIVED' ELSE 'ACTIVE' END AS state FROM orders),
b AS (SELECT * FROM o WHERE c % 3 = 0 AND k % 3 <> 0), a AS (SELECT * FROM o WHERE k % 2 = 0 AND c NOT IN (SELECT c FROM b)), f AS (SELECT * FROM a UNION ALL SELECT * FROM b),
s AS (SELECT arg_max(id, k) AS new, arg_min(id, k) AS old FROM b GROUP BY c)
SELECT 'record' AS kind, id, state FROM f UNION ALL SELECT 'entity', 'customer_' || c, NULL FROM f GROUP BY c
UNION ALL SELECT 'edge', id || '|SUBJECT|customer_' || c, NULL FROM f UNION ALL SELECT 'edge', id || '|OBJECT|' || k, NULL FROM f UNION ALL SELECT 'edge', new || '|SUPERSEDES|' || old, NULL FROM s WHERE new <> old""")
def verified_population(spark: SparkSession, d: str) -> DataFrame:
    """Customers with half of their orders; every third customer is then replaced by other orders of its, the last of which supersedes the first."""
    graph_ = keyed.KeyedTable(spark, f"{ensure_checkpoint_dir(spark)}/verified-{uuid.uuid4().hex}", feed.SUBGRAPH, ("kind", "id"), "seq", buckets=16, deleted="gone")
    o = table(spark, d, "orders")
    subject = F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("subject")
    facts = o.select(
        "o_custkey", "o_orderkey", subject, F.lit("ordered").alias("predicate"), F.col("o_orderkey").cast("string").alias("object"), F.when(F.col("o_orderstatus") == "F", "ARCHIVED").otherwise("ACTIVE").alias("state"),
        F.array(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))).alias("sources"), F.array(F.col("o_orderdate").cast("timestamp")).alias("dates"),
    )
    first, later = facts.where("o_orderkey % 2 = 0"), facts.where("o_custkey % 3 = 0 and o_orderkey % 3 <> 0")
    ends = later.groupBy("subject").agg(F.max("o_orderkey").cast("string").alias("new_object"), F.min("o_orderkey").cast("string").alias("old_object"))
    replaced = ends.select("subject", F.lit("ordered").alias("new_predicate"), "new_object", F.lit("ordered").alias("old_predicate"), "old_object")
    feed.replace_subjects(graph_, first, replaced.limit(0), 1)
    feed.replace_subjects(graph_, later, replaced, 2)
    return graph_.read().select("kind", "id", "state")
