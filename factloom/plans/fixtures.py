"""The given tables as facts, drafts and lineage, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.frames import table
from factloom.functions.text import slug

#: Groups of triples lie this far apart in the order, keys of small tables this far.
GROUP, KEY, PAIR = 1 << 56, 1 << 12, 1 << 28


def star_triples(spark: SparkSession, d: str) -> DataFrame:
    """(ordinal, subject, subject_type, predicate, object, object_type): who belongs where, and who produces what."""
    customer, supplier, nation, region, part = (table(spark, d, t) for t in ("customer", "supplier", "nation", "region", "part"))
    made = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()

    def triples(df: DataFrame, ordinal, subject: str, st: str, predicate: str, obj: str, ot: str) -> DataFrame:
        return df.select(ordinal.cast("long").alias("ordinal"), F.col(subject).alias("subject"), F.lit(st).alias("subject_type"), F.lit(predicate).alias("predicate"), F.col(obj).alias("object"), F.lit(ot).alias("object_type"))

    key = lambda c: F.col(c).cast("long") * KEY
    return (
        triples(customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]), key("c_custkey"), "c_name", "CUSTOMER", "Is_Member_Of", "n_name", "NATION")
        .unionByName(triples(supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]), F.lit(GROUP) + key("s_suppkey"), "s_name", "SUPPLIER", "Operate_In", "n_name", "NATION"))
        .unionByName(triples(nation.join(region, nation["n_regionkey"] == region["r_regionkey"]), F.lit(2 * GROUP) + key("n_nationkey"), "n_name", "NATION", "Is_Member_Of", "r_name", "REGION"))
        .unionByName(
            triples(
                made.join(supplier, made["l_suppkey"] == supplier["s_suppkey"]).join(part, made["l_partkey"] == part["p_partkey"]),
                F.lit(3 * GROUP) + F.col("l_suppkey") * PAIR + F.col("l_partkey"), "s_name", "SUPPLIER", "Produce", "p_name", "PART",
            )
        )
    )


STAR = f"""star AS (
  SELECT CAST(c_custkey AS BIGINT) * {KEY} AS ordinal, c_name AS subject, 'CUSTOMER' AS subject_type, 'Is_Member_Of' AS predicate, n_name AS object, 'NATION' AS object_type
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT {GROUP} + CAST(s_suppkey AS BIGINT) * {KEY}, s_name, 'SUPPLIER', 'Operate_In', n_name, 'NATION' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT {2 * GROUP} + CAST(n_nationkey AS BIGINT) * {KEY}, n_name, 'NATION', 'Is_Member_Of', r_name, 'REGION' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT {3 * GROUP} + l_suppkey * {PAIR} + l_partkey, s_name, 'SUPPLIER', 'Produce', p_name, 'PART'
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


def order_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Drafts of each customer's current order status, trusted by priority."""
    o = table(spark, d, "orders")
    return o.select(
        F.concat(slug(F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string"))), F.lit("::current_status")).alias("semantic_key"),
        F.lit("current_status").alias("predicate"),
        F.col("o_orderstatus").alias("obj"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("tier"),
        (F.col("o_orderkey") % 7 != 0).alias("auto_update"),
        F.col("o_orderdate").cast("timestamp").alias("valid_from"),
        F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("source_id"),
        (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * (1 << 32) + F.col("o_orderkey")).alias("arrival"),
    )


ORDER_DRAFTS = f"""drafts AS (
  SELECT 'customer_' || o_custkey || '::current_status' AS semantic_key, lower(trim(o_orderstatus)) AS clean, o_orderstatus AS obj,
         CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS tier, o_orderkey % 7 <> 0 AS auto, o_orderdate AS valid_from,
         CAST(epoch(o_orderdate) AS BIGINT) * {1 << 32} + o_orderkey AS arrival, 'order:' || o_orderkey AS source_id
  FROM orders)"""

#: The gate's fold over the table drafts (semantic_key, clean, obj, tier, auto, valid_from, arrival, source_id).
FOLD_STEPS = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY semantic_key ORDER BY arrival) AS rn FROM drafts),
folded AS (
  SELECT semantic_key, arrival, rn, 'first version' AS reason, CAST(NULL AS BIGINT) AS head_arrival, CAST(0 AS BIGINT) AS owner_seq,
         clean AS h_clean, tier AS h_tier, auto AS h_auto, valid_from AS h_from, arrival AS h_arrival
  FROM ranked WHERE rn = 1
  UNION ALL
  SELECT semantic_key, arrival, rn, reason, h_arrival, owner_seq + CAST(reason = 'superseded' AS BIGINT),
         CASE WHEN reason = 'superseded' THEN clean ELSE h_clean END, CASE WHEN reason = 'superseded' THEN tier ELSE h_tier END,
         CASE WHEN reason = 'superseded' THEN auto ELSE h_auto END, CASE WHEN reason = 'superseded' THEN valid_from ELSE h_from END,
         CASE WHEN reason = 'superseded' THEN arrival ELSE h_arrival END
  FROM (SELECT r.*, f.owner_seq, f.h_clean, f.h_tier, f.h_auto, f.h_from, f.h_arrival,
          CASE WHEN r.clean = f.h_clean THEN 'identical' WHEN r.valid_from = f.h_from THEN 'contradiction'
               WHEN r.tier > f.h_tier OR (r.tier = f.h_tier AND r.valid_from < f.h_from) THEN 'precedence'
               WHEN f.h_tier <> 0 AND f.h_auto AND r.auto THEN 'superseded' ELSE 'needs review' END AS reason
        FROM folded f JOIN ranked r ON r.semantic_key = f.semantic_key AND r.rn = f.rn + 1)),
decided AS (SELECT *, CASE WHEN reason IN ('first version', 'superseded') THEN 'AUTO_COMMIT' WHEN reason IN ('identical', 'precedence') THEN 'NO_OP'
                           WHEN reason = 'contradiction' THEN 'FLAG_CONTRADICTION' ELSE 'QUEUE_SYSTEM_2' END AS disposition FROM folded)"""
FOLD = f"{ORDER_DRAFTS},{FOLD_STEPS}"


def event_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Drafts of each user's current value of each kind of event, all from one source of the weakest tier."""
    e = table(spark, d, "events")
    return e.select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string"), F.lit("::"), F.col("event_type")).alias("semantic_key"),
        F.col("event_type").alias("predicate"),
        F.get_json_object("props", "$.k").alias("obj"),
        F.lit(4).alias("tier"),
        F.lit(True).alias("auto_update"),
        F.col("ts").cast("timestamp").alias("valid_from"),
        F.concat(F.lit("stream:"), F.col("event_type")).alias("source_id"),
        F.col("event_id").alias("arrival"),
    )


EVENT_DRAFTS = """drafts AS (
  SELECT 'user_' || user_id || '::' || event_type AS semantic_key, props->>'$.k' AS obj, ts AS valid_from, event_id AS arrival, event_type FROM events)"""


def order_records(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a version of its customer's status: (record_id, semantic_key, owner_seq, created_at, source_id, tier, status)."""
    from pyspark.sql import Window as W

    drafts = order_drafts(spark, d)
    order = W.partitionBy("semantic_key").orderBy("arrival")
    return drafts.withColumn("owner_seq", (F.row_number().over(order) - 1).cast("long")).select(
        F.regexp_replace("source_id", "order:", "rec_").alias("record_id"), "semantic_key", "owner_seq", F.col("valid_from").alias("created_at"), "source_id", "tier", "obj", "arrival"
    )


ORDER_RECORDS = (
    ORDER_DRAFTS
    + """,
records AS (SELECT replace(source_id, 'order:', 'rec_') AS record_id, semantic_key, row_number() OVER (PARTITION BY semantic_key ORDER BY arrival) - 1 AS owner_seq,
                   valid_from AS created_at, source_id, tier, obj, arrival FROM drafts)"""
)


def lineage(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, kind): line items derive from orders, these from customers, nations and regions."""
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    name = lambda letter, *cols: F.concat_ws("-", F.lit(letter), *[F.col(x).cast("string") for x in cols])
    edge = lambda df, a, b: df.select(a.alias("src"), b.alias("dst"), F.lit("DERIVED_FROM").alias("kind"))
    return (
        edge(li.select("l_orderkey", "l_linenumber").distinct(), name("L", "l_orderkey", "l_linenumber"), name("O", "l_orderkey"))
        .unionByName(edge(o, name("O", "o_orderkey"), name("C", "o_custkey")))
        .unionByName(edge(c, name("C", "c_custkey"), name("N", "c_nationkey")))
        .unionByName(edge(n, name("N", "n_nationkey"), name("R", "n_regionkey")))
    )


LINEAGE = """lineage AS (
  SELECT DISTINCT 'L-' || l_orderkey || '-' || l_linenumber AS src, 'O-' || l_orderkey AS dst FROM lineitem
  UNION ALL SELECT 'O-' || o_orderkey, 'C-' || o_custkey FROM orders
  UNION ALL SELECT 'C-' || c_custkey, 'N-' || c_nationkey FROM customer
  UNION ALL SELECT 'N-' || n_nationkey, 'R-' || n_regionkey FROM nation)"""


def weighted_edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, distance): the star from the inside out, heavier where a fact is less corroborated."""
    t = star_triples(spark, d)
    weight = F.when(F.col("object_type") == "REGION", 1.0).when(F.col("predicate") == "Operate_In", 1.5).when(F.col("predicate") == "Produce", 1.25).otherwise(3.0)
    return t.select(F.col("object").alias("src"), F.col("subject").alias("dst"), weight.alias("distance")).unionByName(
        t.where("predicate = 'Produce'").select(F.col("subject").alias("src"), F.col("object").alias("dst"), weight.alias("distance"))
    )


WEIGHTED = (
    STAR
    + """,
weighted AS (
  SELECT object AS src, subject AS dst, CAST(CASE WHEN object_type = 'REGION' THEN 1.0 WHEN predicate = 'Operate_In' THEN 1.5 WHEN predicate = 'Produce' THEN 1.25 ELSE 3.0 END AS DOUBLE) AS distance FROM star
  UNION ALL SELECT subject, object, 1.25 FROM star WHERE predicate = 'Produce')"""
)
