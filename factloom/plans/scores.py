"""Queries over vectors, links and scores, and the batch sides of the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions.frames import table, written
from factloom.operators import embedding, factors, metrics, vector
from factloom.plans import fixtures as fx
from factloom.plans.registry import registry
from factloom.streaming import windows

QUERIES, ORACLES, query = registry()

_DENSE = """dense AS (SELECT e.vec_id AS id, list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE))) AS score
FROM embeddings e JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q ON true)"""


def _dense(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    first = e.where("vec_id = 0 and embedding is not null").select("embedding").first()
    vectors = e.select(F.col("vec_id").alias("id"), "embedding")
    return vector.dense_top(vectors, list(first[0]), k) if first else vector.dense_top(vectors.limit(0), [], k)


@query(f"WITH {_DENSE} SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM dense ORDER BY score DESC, id LIMIT 20")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, 20).select("id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_DENSE}, a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM dense ORDER BY rank LIMIT 50),
terms AS (SELECT e.vec_id AS id, i, e.embedding[i] AS w, q.embedding[i] AS qw FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) e JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q ON true),
s AS (SELECT id, sum(round(CAST(w AS DOUBLE), 1) * round(CAST(qw AS DOUBLE), 1)) AS score FROM terms WHERE w > 0.2 AND qw > 0.2 GROUP BY id),
b AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM s ORDER BY rank LIMIT 50)
SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY sum(1.0 / (60 + rank)) DESC, id LIMIT 20""")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    terms = e.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("term", "w")).where("w > 0.2").withColumn("w", F.round(F.col("w").cast("double"), 1))
    query_terms = terms.where("id = 0").select("term", F.col("w").alias("qw"))
    return vector.fuse([_dense(spark, d, 50), vector.sparse_top(terms, query_terms, 50)], 20).select("id", F.round("score", 9).alias("score"))


_SETS = """p AS (SELECT o_custkey, list(DISTINCT o_orderstatus || o_orderpriority) FILTER (o_totalprice > 200000) AS found, list(DISTINCT o_orderstatus || o_orderpriority) FILTER (o_orderstatus <> 'P') AS truth FROM orders GROUP BY o_custkey),
n AS (SELECT o_custkey, coalesce(found, []) AS found, coalesce(truth, []) AS truth FROM p),
c AS (SELECT o_custkey, len(found) AS nf, len(truth) AS nt, len(list_intersect(found, truth)) AS tp FROM n),
s AS (SELECT o_custkey, tp, nf - tp AS fp, nt - tp AS fn, CASE WHEN nf = 0 AND nt = 0 THEN 1.0 WHEN nf = 0 OR nt = 0 THEN 0.0 ELSE tp / nf END AS precision,
             CASE WHEN nt = 0 THEN 1.0 WHEN nf = 0 THEN 0.0 ELSE tp / nt END AS recall FROM c)"""


@query(f"""WITH {_SETS} SELECT o_custkey, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(CAST(precision AS DOUBLE), 9) AS precision, round(CAST(recall AS DOUBLE), 9) AS recall,
round(CAST(CASE WHEN precision = 1 AND recall = 1 THEN 1 WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS DOUBLE), 9) AS f1 FROM s""")
def triplet_prf1(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    value = F.concat("o_orderstatus", "o_orderpriority")
    sets = o.groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_totalprice") > 200000, value)).alias("found"), F.collect_set(F.when(F.col("o_orderstatus") != "P", value)).alias("truth"))
    s = metrics.set_scores(F.col("found"), F.col("truth"))
    return sets.select("o_custkey", *[(F.round(c, 9) if n in ("precision", "recall", "f1") else c).alias(n) for n, c in s.items()])


@query("""WITH r AS (SELECT text AS answer, [source, lang] AS gold, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS context FROM documents),
s AS (SELECT CAST(len(context) > 0 AS INT) AS g, len(list_filter(gold, lambda x: contains(lower(answer), lower(x)))) AS h, len(gold) AS ng, len(context) AS nc,
             len(list_filter(context, lambda c: len(list_filter(gold, lambda x: contains(lower(c), lower(x)))) > 0)) AS u FROM r)
SELECT count(*) AS n, round_even(avg(g), 3) AS grounding, round_even(avg(CAST(h > 0 AS INT)), 3) AS answered, round_even(avg(h / ng), 3) AS keyword_recall,
       round_even(avg(CASE WHEN nc = 0 THEN 0 ELSE u / nc END), 3) AS context_precision FROM s""")
def qa_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("text").alias("answer"), F.array("source", "lang").alias("gold"), F.filter(F.split("text", "\n", -1), lambda x: x != "").alias("context"))
    return metrics.answer_scores(rows)


@query("""SELECT doc_id, md5(CASE WHEN lang = 'en' THEN 'no match found' ELSE trim(text || ' because', ' ' || chr(9) || chr(10) || chr(13)) END) AS evaluation, CASE WHEN lang = 'en' OR n_chars % 3 = 0 THEN 0.0 ELSE CAST(n_chars AS DOUBLE) + 0.5 END AS score FROM documents""")
def judge_parse(spark: SparkSession, d: str) -> DataFrame:
    """What replies about whole texts say, and the ratings of those that have one."""
    docs = table(spark, d, "documents")
    rating = F.when(F.col("n_chars") % 3 == 0, "none").otherwise(F.concat(F.col("n_chars").cast("string"), F.lit(".5 of all")))
    reply = F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat(F.lit("Evaluation: "), "text", F.lit(" because\nTotal rating: "), rating))
    r = docs.select("doc_id", reply.alias("reply"))
    return r.select("doc_id", F.md5(tx.judge_evaluation(F.col("reply"))).alias("evaluation"), tx.judge_score(F.col("reply")).alias("score"))


_EDGES = "e AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 10000000 AS dst FROM lineitem)"


def _supplies(spark: SparkSession, d: str) -> DataFrame:
    """Who supplies which part, as edges between numbers."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 10_000_000).alias("dst")).distinct()


@query(f"WITH {_EDGES}, {factors.sql('e', 4, 2)} SELECT side, node, CAST(i AS INTEGER) AS i, round(v, 6) AS v FROM (SELECT 'row' AS side, * FROM w2 UNION ALL SELECT 'column', * FROM h2)")
def link_factors(spark: SparkSession, d: str) -> DataFrame:
    """Both factors of the normalised adjacency after two rounds."""
    found = factors.factorise(factors.adjacency(_supplies(spark, d)), 4, 2)
    sides = [df.select(F.lit(side).alias("side"), "node", F.posexplode(F.array(*[f"v{i}" for i in range(4)])).alias("i", "v")) for side, df in zip(("row", "column"), found)]
    return sides[0].unionByName(sides[1]).withColumn("v", F.round("v", 6))


@query(f"""WITH {_EDGES}, {factors.sql('e', 6, 4)}, a AS (SELECT node, list(v ORDER BY i) AS v FROM w4 GROUP BY node), b AS (SELECT node, list(v ORDER BY i) AS v FROM h4 GROUP BY node),
s AS (SELECT a.node AS src, b.node AS dst, list_inner_product(a.v, b.v) AS score FROM a JOIN b ON a.node < b.node)
SELECT src, dst, round(score, 6) AS score FROM s ANTI JOIN adj USING (src, dst) ORDER BY s.score DESC, src, dst LIMIT 50""")
def link_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The fifty likeliest pairs of suppliers and parts that aren't linked."""
    entries = written(factors.adjacency(_supplies(spark, d)))
    rows, columns = factors.factorise(entries, 6, 4)
    return factors.new_edges(entries, rows, columns, 50, 6).withColumn("score", F.round("score", 6))


def _transe_sql(dim: int = 16, rounds: int = 3) -> str:
    """The rounds of the translation model, one node and dimension a row."""
    parts = [
        "t AS (SELECT DISTINCT subject, predicate, object FROM star)",
        f"""n0 AS (SELECT node, i, CAST(('0x' || substr(md5(node || ':' || i), 1, 8)) AS BIGINT) / 2147483648.0::DOUBLE - 1 AS v
FROM (SELECT subject AS node FROM t UNION SELECT object FROM t), range({dim}) AS d(i))""",
    ]
    for k in range(rounds):
        parts.append(f"m{k} AS (SELECT subject, predicate, object, h.i, h.v AS h, o.v AS t FROM t JOIN n{k} h ON subject = h.node JOIN n{k} o ON object = o.node AND h.i = o.i)")
        parts.append(f"r{k} AS (SELECT predicate, i, avg(t - h) AS r FROM m{k} GROUP BY ALL)")
        parts.append(f"w{k} AS (SELECT node, i, avg(w) AS w FROM (SELECT object AS node, i, h + r AS w FROM m{k} JOIN r{k} USING (predicate, i) UNION ALL SELECT subject, i, t - r FROM m{k} JOIN r{k} USING (predicate, i)) GROUP BY ALL)")
        parts.append(f"n{k + 1} AS (SELECT node, i, 0.5 * v + 0.5 * w AS v FROM n{k} JOIN w{k} USING (node, i))")
    parts.append(f"s AS (SELECT src, dst, predicate AS relation, -sqrt(sum((h.v + r - o.v) * (h.v + r - o.v))) AS score FROM (SELECT DISTINCT subject AS src, object AS dst FROM t) JOIN n{rounds} h ON src = h.node JOIN n{rounds} o ON dst = o.node AND h.i = o.i JOIN r{rounds - 1} r ON r.i = h.i GROUP BY ALL)")
    return f"WITH {fx.STAR}, " + ", ".join(parts) + " SELECT src, dst, relation, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY score DESC, relation) AS rank FROM s) WHERE rank <= 2"


@query(_transe_sql())
def transe_scores(spark: SparkSession, d: str) -> DataFrame:
    """The two best relations for each pair of the star."""
    t = fx.star_triples(spark, d)
    nodes, relations = vector.translation_vectors(t)
    pairs = t.select(F.col("subject").alias("src"), F.col("object").alias("dst")).distinct()
    best = vector.best_relations(vector.translation_scores(pairs, nodes, vector.known_relations(relations)), 2)
    return best.withColumn("score", F.round("score", 6))


def _held_out_ranks(spark: SparkSession, d: str, model: embedding.Model, epochs: int) -> DataFrame:
    """The ranks of a tenth of the star's triples after training on eight tenths."""
    nodes, relations, triples = embedding.indexed(fx.star_triples(spark, d))
    part = F.pmod(F.xxhash64("r", "t", "h"), F.lit(10))
    train, test = triples.where(part < 8), triples.where(part == 9)
    found, _ = embedding.train(train, nodes, relations, model, epochs)
    ranks = embedding.ranks(test, triples, found, model)
    name = lambda df, key, id_, new: df.select(F.col(key).alias(new), F.col("id").alias(id_))
    return ranks.join(name(nodes, "node", "h", "subject"), "h").join(name(relations, "relation", "r", "predicate"), "r").join(name(nodes, "node", "t", "object"), "t").select("subject", "predicate", "object", "rank")


@query(None)
def transe_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Filtered ranks of held-out triples under a trained translation model."""
    return _held_out_ranks(spark, d, embedding.Model(), 4)


@query(None)
def transr_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The same with a space for each relation."""
    return _held_out_ranks(spark, d, embedding.Model(dim=8, projected=True), 3)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    return windows.tumbling(table(spark, d, "events"), "1 day").withColumn("total", F.round("total", 4))


@query("""SELECT w AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w, * FROM events) GROUP BY ALL""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return windows.tumbling(table(spark, d, "events"), "2 hours", "1 hour").withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT *, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS INT) AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, session""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(table(spark, d, "events"), "30 minutes")
