"""Queries over the fact graph and its lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions.frames import written
from factloom.operators import commit, graph, lifecycle, lineage, retrieval, triples
from factloom.plans import fixtures as fx
from factloom.plans.registry import registry

QUERIES, ORACLES, query = registry()


@query(f"WITH {fx.STAR} SELECT object AS label, count(*) AS n FROM star WHERE predicate = 'Produce' AND subject IN (SELECT subject FROM star WHERE predicate = 'Operate_In' AND object = 'NATION_3') GROUP BY object")
def most_common_via(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.most_common(fx.star_triples(spark, d), "NATION_3", targets=("Produce",), via=("Operate_In",))


@query(f"WITH {fx.STAR} SELECT object AS label, count(*) AS n FROM star WHERE predicate = 'Produce' AND subject = 'Supplier#000000001' GROUP BY object")
def most_common_direct(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.most_common(fx.star_triples(spark, d), "Supplier#000000001", targets=("produce",))


@query(f"WITH {fx.STAR} SELECT subject AS entity, predicate, '->' AS direction, object AS other FROM star WHERE subject <> object UNION ALL SELECT object, predicate, '<-', subject FROM star WHERE subject <> object")
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(fx.star_triples(spark, d))


@query(f"WITH {fx.STAR} SELECT entity, count(*) FILTER (side = 's') AS as_subject, count(*) FILTER (side = 'o') AS as_object FROM (SELECT subject AS entity, 's' AS side FROM star UNION ALL SELECT object, 'o' FROM star) GROUP BY entity")
def relations_of(spark: SparkSession, d: str) -> DataFrame:
    t = fx.star_triples(spark, d)
    both = t.select(F.explode(F.array(F.struct(F.col("subject").alias("entity"), F.lit("s").alias("side")), F.struct(F.col("object").alias("entity"), F.lit("o").alias("side")))).alias("e")).select("e.*")
    return both.groupBy("entity").agg(F.count_if(F.col("side") == "s").alias("as_subject"), F.count_if(F.col("side") == "o").alias("as_object"))


@query(f"WITH {fx.LINEAGE} SELECT DISTINCT dst AS parent, src AS child FROM lineage")
def direct_dependents(spark: SparkSession, d: str) -> DataFrame:
    return graph.direct_dependents(fx.lineage(spark, d))


@query(f"WITH {fx.STAR} SELECT object AS entity, count(DISTINCT subject) AS corroboration FROM star WHERE subject <> object AND ordinal % 5 <> 0 GROUP BY object")
def corroboration(spark: SparkSession, d: str) -> DataFrame:
    t = fx.star_triples(spark, d)
    return graph.corroboration(t.withColumn("state", F.when(F.col("ordinal") % 5 == 0, "ARCHIVED").otherwise("ACTIVE")))


@query(f"""WITH {fx.STAR}, c AS (SELECT *, count(DISTINCT subject) FILTER (subject <> object) OVER (PARTITION BY object ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM star)
SELECT ordinal, round((CASE predicate WHEN 'Produce' THEN 5 WHEN 'Operate_In' THEN 3 ELSE 2 END) / sqrt(1 + n), 6) AS distance FROM c""")
def commit_distance(spark: SparkSession, d: str) -> DataFrame:
    """How far each fact is when it is committed: by its tier and the subjects that have pointed at its object so far."""
    t = commit.corroboration_so_far(fx.star_triples(spark, d).withColumn("seq", F.col("ordinal")))
    tier = F.when(F.col("predicate") == "Produce", 4).when(F.col("predicate") == "Operate_In", 2).otherwise(1)
    return t.select("ordinal", F.round(tx.distance(tier, F.col("corroboration")), 6).alias("distance"))


_CLOSURE = f"""WITH RECURSIVE {fx.LINEAGE},
reach AS (SELECT src AS root, src AS node, 0 AS depth FROM lineage WHERE src LIKE 'L-%' OR src LIKE 'O-%' UNION SELECT root, dst, depth + 1 FROM reach JOIN lineage ON node = src)"""


def _asked(edges: DataFrame) -> DataFrame:
    return edges.where("src like 'L-%' or src like 'O-%'").select(F.col("src").alias("root"))


@query(f"{_CLOSURE} SELECT root, node, min(depth) AS depth FROM reach GROUP BY root, node")
def lineage_closure(spark: SparkSession, d: str) -> DataFrame:
    edges = fx.lineage(spark, d)
    return graph.closure(edges, _asked(edges))


@query(f"{_CLOSURE} SELECT root, left(node, 1) AS semantic_key, arg_min(node, depth) AS record_id FROM reach GROUP BY root, left(node, 1)")
def frontier(spark: SparkSession, d: str) -> DataFrame:
    edges = written(fx.lineage(spark, d))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("record_id")).distinct()
    return graph.frontiers(edges, _asked(edges), nodes.select("record_id", F.substring("record_id", 1, 1).alias("semantic_key"), F.lit(0).alias("owner_seq")))


@query("SELECT 'X-' || c_nationkey AS node FROM customer GROUP BY c_nationkey UNION ALL SELECT 'Y-' || c_nationkey FROM customer GROUP BY c_nationkey")
def acyclicity_check(spark: SparkSession, d: str) -> DataFrame:
    """The lineage has no cycle; two nodes that are hung onto each other for each nation have one."""
    edges = fx.lineage(spark, d).select("src", "dst")
    n = fx.table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("n")).distinct()
    x, y = F.concat(F.lit("X-"), F.col("n")), F.concat(F.lit("Y-"), F.col("n"))
    wrong = n.select(x.alias("src"), y.alias("dst")).unionByName(n.select(y.alias("src"), x.alias("dst")))
    return graph.cyclic_nodes(edges.unionByName(wrong))


@query(f"""WITH b AS (SELECT 'C-' || xor(o_custkey, 1) AS src, 'O-' || o_orderkey AS dst, o_orderkey AS seq, o_custkey AS owner, o_custkey // 2 AS pair FROM orders WHERE o_orderkey % 3 = 0),
f AS (SELECT *, arg_min(owner, seq) OVER (PARTITION BY pair) AS first_owner FROM b)
SELECT src, dst, CAST(seq AS BIGINT) AS seq, 'cycle' AS reason FROM f WHERE owner <> first_owner""")
def refused_edges(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring customers are said to derive from each other's orders: the first such edge of a pair holds, those the other way are refused."""
    edges = written(fx.lineage(spark, d).select("src", "dst"))
    o = fx.table(spark, d, "orders").where("o_orderkey % 3 = 0")
    batch = o.select(F.concat(F.lit("C-"), F.col("o_custkey").bitwiseXOR(F.lit(1)).cast("string")).alias("src"), F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("dst"), F.col("o_orderkey").alias("seq"))
    return lineage.admit(edges, lineage.ranks(edges), batch)[1]


@query(f"""WITH RECURSIVE {fx.LINEAGE}, nodes AS (SELECT src AS node FROM lineage UNION SELECT dst FROM lineage),
reach AS (SELECT node AS root, node, 0 AS depth FROM nodes UNION SELECT root, dst, depth + 1 FROM reach JOIN lineage ON node = src)
SELECT root, node, min(depth) AS depth FROM reach GROUP BY root, node""")
def closure_after_batches(spark: SparkSession, d: str) -> DataFrame:
    """The closure of all nodes, after a tenth of the orders and a few customers have come in two later batches."""
    edges = written(fx.lineage(spark, d).select("src", "dst"))
    number = F.split_part("src", F.lit("-"), F.lit(2)).cast("long")
    late = F.when(F.col("src").rlike("^[LO]-") & (number % 10 == 0), 1).when(F.col("src").startswith("C-") & (number % 50 == 0), 2).otherwise(0)
    first = edges.where(late == 0)
    reached = written(graph.closure(first, first.select(F.explode(F.array("src", "dst")).alias("root")).distinct()))
    for k in (1, 2):
        reached = lineage.appended(reached, edges.where(late == k))
    return reached


_REACH = f"""WITH RECURSIVE {fx.WEIGHTED},
cheap AS (SELECT src, dst, min(distance) AS w FROM weighted GROUP BY src, dst),
walk AS (SELECT 'AFRICA' AS node, CAST(0 AS DOUBLE) AS distance UNION SELECT dst, distance + w FROM walk JOIN cheap ON node = src WHERE distance + w <= 4),
near AS (SELECT node, min(distance) AS distance FROM walk GROUP BY node)"""


@query(f"{_REACH} SELECT node, distance FROM near")
def bounded_context(spark: SparkSession, d: str) -> DataFrame:
    return graph.bounded_distances(fx.weighted_edges(spark, d), "AFRICA", 4.0)


@query(f"{_REACH} SELECT src, dst, w AS distance FROM cheap WHERE src IN (SELECT node FROM near) AND dst IN (SELECT node FROM near)")
def context_triples(spark: SparkSession, d: str) -> DataFrame:
    edges = fx.weighted_edges(spark, d)
    found = graph.induced(edges, graph.bounded_distances(edges, "AFRICA", 4.0))
    return found.groupBy("src", "dst").agg(F.min("distance").alias("distance"))


@query(f"""WITH {fx.WEIGHTED},
h1 AS (SELECT DISTINCT src, dst, 1 AS hop FROM weighted WHERE src = 'ASIA' AND dst <> 'ASIA'),
h2 AS (SELECT min(w.src) AS src, w.dst, 2 AS hop FROM weighted w JOIN h1 ON w.src = h1.dst WHERE w.dst <> 'ASIA' AND w.dst NOT IN (SELECT dst FROM h1) GROUP BY w.dst),
h3 AS (SELECT min(w.src) AS src, w.dst, 3 AS hop FROM weighted w JOIN h2 ON w.src = h2.dst WHERE w.dst <> 'ASIA' AND w.dst NOT IN (SELECT dst FROM h1 UNION ALL SELECT dst FROM h2) GROUP BY w.dst)
SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3""")
def bfs_edges_depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.bfs_edges(fx.weighted_edges(spark, d), "ASIA", 3)


_HIST = f"{fx.STAR}, t AS (SELECT *, CASE WHEN predicate = 'Produce' THEN 'ARCHIVED' ELSE 'ACTIVE' END AS state FROM star)"
_SEEDS = "SELECT r_name FROM region WHERE r_name LIKE 'A%'"


@query(f"""WITH {_HIST}, seeds AS ({_SEEDS}),
inbound AS (SELECT ordinal, subject, predicate, object FROM t WHERE state = 'ACTIVE' AND subject_type <> 'CUSTOMER' AND object IN (FROM seeds)),
out1 AS (SELECT ordinal, subject, predicate, object, object_type FROM t WHERE state = 'ACTIVE' AND subject IN (FROM seeds)),
out2 AS (SELECT ordinal, subject, predicate, object FROM t WHERE state = 'ACTIVE' AND subject IN (SELECT object FROM out1 WHERE object_type <> 'CUSTOMER'))
SELECT ordinal, subject || ' — ' || predicate || ' — ' || object AS text FROM (SELECT * FROM inbound UNION SELECT ordinal, subject, predicate, object FROM out1 UNION SELECT * FROM out2)""")
def qa_facts_depth2(spark: SparkSession, d: str) -> DataFrame:
    t = fx.star_triples(spark, d).withColumn("state", F.when(F.col("predicate") == "Produce", "ARCHIVED").otherwise("ACTIVE"))
    seeds = fx.table(spark, d, "region").where("r_name like 'A%'").select(F.col("r_name").alias("entity"))
    found = retrieval.facts_around(t, seeds, 2, closed_type="CUSTOMER")
    none = F.array().cast("array<string>")
    return found.select("ordinal", retrieval.fact_text(F.col("subject"), F.col("predicate"), F.col("object"), none, none, F.lit(1), F.lit(False)).alias("text"))


@query(f"""WITH {fx.STAR}, anchor AS (SELECT object AS node FROM star WHERE subject = 'Supplier#000000002'), n AS (SELECT node FROM anchor UNION SELECT 'Supplier#000000002')
SELECT ordinal, subject, predicate, object FROM star WHERE subject IN (FROM n) AND object IN (FROM n)""")
def patient_subgraph(spark: SparkSession, d: str) -> DataFrame:
    t = fx.star_triples(spark, d).select("ordinal", F.col("subject").alias("src"), "predicate", F.col("object").alias("dst"))
    around = t.where("src = 'Supplier#000000002'").select(F.explode(F.array("src", "dst")).alias("node"))
    return graph.induced(t, around).select("ordinal", F.col("src").alias("subject"), "predicate", F.col("dst").alias("object"))


@query(f"""WITH {fx.ORDER_RECORDS}, r AS (SELECT *, split_part(semantic_key, '::', 1) AS own FROM records WHERE CAST(substr(split_part(semantic_key, '::', 1), 10) AS BIGINT) % 7 = 0),
n AS (SELECT own, own AS node FROM r UNION SELECT own, record_id FROM r UNION SELECT own, 'status ' || obj FROM r)
SELECT 'Customer-' || substr(own, 10) AS subject, node FROM n""")
def subject_subgraphs(spark: SparkSession, d: str) -> DataFrame:
    """The subgraphs of every seventh customer: the customer under another spelling, its records with their history, and their objects."""
    r = lifecycle.versions(fx.order_records(spark, d)).withColumn("own", F.split_part("semantic_key", F.lit("::"), F.lit(1)))
    status = F.concat(F.lit("status "), F.col("obj"))
    none = F.lit(None).cast("string")
    entity = lambda name: r.select(name.alias("node"), F.lit("entity").alias("kind"), none.alias("semantic_key"), none.alias("state")).distinct()
    nodes = r.select(F.col("record_id").alias("node"), F.lit("record").alias("kind"), "semantic_key", F.lit("ACTIVE").alias("state")).unionByName(entity(F.col("own"))).unionByName(entity(status))
    edge = lambda rows, dst, kind: rows.select(F.col("record_id").alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))
    edges = edge(r, status, "OBJECT").unionByName(edge(r.where("prior_id is not null"), F.col("prior_id"), "SUPERSEDES"))
    number = F.substring("own", 10, 20).cast("long")
    asked = r.where(number % 7 == 0).select(F.concat(F.lit("Customer-"), number.cast("string")).alias("subject")).distinct()
    return graph.subjects_around(nodes, edges, asked)


@query("""
SELECT s_suppkey AS key, s_name AS src, 'NATION_' || s_nationkey AS dst FROM supplier WHERE s_acctbal >= 0
UNION ALL SELECT 1000000000 + c_custkey, c_name, 'NATION_' || c_nationkey FROM customer WHERE c_acctbal < 0""")
def edge_delta_apply(spark: SparkSession, d: str) -> DataFrame:
    s, c = fx.table(spark, d, "supplier"), fx.table(spark, d, "customer")
    nation = lambda x: F.concat(F.lit("NATION_"), F.col(x).cast("string"))
    edges = s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("src"), nation("s_nationkey").alias("dst"), F.lit("Operate_In").alias("predicate"))
    gone = edges.join(s.where("s_acctbal < 0").select(F.col("s_suppkey").alias("key")), "key", "left_semi").select("key", F.lit("delete").alias("op"), "src", "dst", "predicate", F.lit(1).alias("seq"))
    new = c.where("c_acctbal < 0").select((F.col("c_custkey") + 1000000000).alias("key"), F.lit("insert").alias("op"), F.col("c_name").alias("src"), nation("c_nationkey").alias("dst"), F.lit("Is_Member_Of").alias("predicate"), F.lit(2).alias("seq"))
    again = edges.select("key", F.lit("insert").alias("op"), "src", "dst", "predicate", F.lit(0).alias("seq"))
    return triples.apply_edge_changes(edges, gone.unionByName(new).unionByName(again)).select("key", "src", "dst")


@query(f"""WITH {fx.STAR}, deg AS (SELECT node, count(*) AS k FROM (SELECT subject AS node FROM star UNION ALL SELECT object FROM star) GROUP BY node)
SELECT subject AS src, object AS dst, round(n / sqrt(a.k * b.k), 9) AS weight FROM (SELECT subject, object, count(*) AS n FROM star GROUP BY subject, object) JOIN deg a ON subject = a.node JOIN deg b ON object = b.node""")
def normalized_adjacency(spark: SparkSession, d: str) -> DataFrame:
    e = fx.star_triples(spark, d).select(F.col("subject").alias("src"), F.col("object").alias("dst"))
    return triples.normalised_adjacency(e).select("src", "dst", F.round("weight", 9).alias("weight"))
