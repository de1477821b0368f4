"""Queries over views, samples, orders and lineage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions.frames import checkpointed, table
from factloom.operators import extract, graph, lifecycle, metrics, ordering, retrieval, triples, vector
from factloom.plans import fixtures as fx
from factloom.plans import graphs, ledgers, words
from factloom.plans.registry import registry
from factloom.sources import readers
from factloom.streaming import windows

QUERIES, ORACLES, query = registry()


@query(f"WITH {ledgers._AUDIT} SELECT record_id AS node_id, 'record' AS kind FROM states WHERE state = 'FLAGGED'")
def nodes_by_state(spark: SparkSession, d: str) -> DataFrame:
    """The nodes in a state; entities have none and drop out."""
    states = lifecycle.states(ledgers._audit(spark, d)).withColumn("kind", F.lit("record"))
    entities = table(spark, d, "customer").select(F.col("c_name").alias("node_id"), F.lit(None).cast("string").alias("state"), F.lit("entity").alias("kind"))
    return states.unionByName(entities).where("state = 'FLAGGED'").select("node_id", "kind")


@query(f"""WITH {ledgers._AUDIT}, f AS (SELECT record_id, CASE WHEN state <> 'ACTIVE' THEN 'PAST' WHEN date_diff('microsecond', created_at, TIMESTAMP '{ledgers.NOW}') // 86400000000 <= 90 THEN 'CURRENT' ELSE 'CURRENT_STALE' END AS recency FROM records JOIN states USING (record_id))
SELECT record_id, recency FROM f WHERE recency IN ('CURRENT', 'CURRENT_STALE')""")
def recency_filter(spark: SparkSession, d: str) -> DataFrame:
    r = fx.order_records(spark, d).join(lifecycle.states(ledgers._audit(spark, d)).withColumnRenamed("node_id", "record_id"), "record_id")
    kind, _ = retrieval.recency(F.col("state"), F.col("created_at"), ledgers._now())
    return r.select("record_id", kind.alias("recency")).where(F.col("recency").isin("CURRENT", "CURRENT_STALE"))


@query("SELECT doc_id, source FROM documents WHERE length(trim(text)) BETWEEN 300 AND 2500 ORDER BY doc_id LIMIT 100")
def first_cases(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred cases of a length band in the order of the file."""
    cut = table(spark, d, "documents").where(F.char_length(F.trim("text")).between(300, 2500))
    return ordering.first_in_order(cut, "doc_id", 100).select("doc_id", "source")


@query(f"WITH {fx.ORDER_RECORDS} SELECT record_id, semantic_key FROM records WHERE starts_with(semantic_key, 'customer_1')")
def key_prefix(spark: SparkSession, d: str) -> DataFrame:
    return fx.order_records(spark, d).where(F.col("semantic_key").startswith("customer_1")).select("record_id", "semantic_key")


@query(f"""WITH {ledgers._AUDIT} SELECT CASE WHEN state = 'ACTIVE' THEN '' ELSE '[ARCHIVED / SUPERSEDED] ' END || semantic_key || ' — current_status — ' || obj || ' [Doc: ' || source_id || ' | Date: ' || strftime(created_at, '%Y-%m-%d') || CASE WHEN tier > 0 THEN ' | ' || (tier + 1) || ' mentions' ELSE '' END || ']' AS text
FROM records JOIN states USING (record_id)""")
def facts_in_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every record as a line with its document, date and mentions, what holds before what is archived."""
    r = fx.order_records(spark, d).join(lifecycle.states(ledgers._audit(spark, d)).withColumnRenamed("node_id", "record_id"), "record_id")
    line = retrieval.fact_text(F.col("semantic_key"), F.lit("current_status"), F.col("obj"), F.array("source_id"), F.array(F.date_format("created_at", "yyyy-MM-dd")), F.col("tier") + 1, F.col("state") != "ACTIVE")
    return retrieval.in_blocks(r.select(line.alias("text")))


@query("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 25")
def sample_documents(spark: SparkSession, d: str) -> DataFrame:
    return ordering.sampled(table(spark, d, "documents").select("doc_id"), "doc_id", 25)


@query(f"WITH {fx.STAR} SELECT ordinal, subject, object FROM star ORDER BY md5(CAST(ordinal AS VARCHAR)), ordinal LIMIT 40")
def sample_edges(spark: SparkSession, d: str) -> DataFrame:
    return ordering.sampled(fx.star_triples(spark, d).select("ordinal", "subject", "object"), "ordinal", 40)


@query("""WITH f AS (SELECT conv_id, coalesce(role, '?') AS role, min(turn) AS t FROM conversations GROUP BY ALL) SELECT conv_id, string_agg(role, ',' ORDER BY t, role) AS deps FROM f GROUP BY conv_id""")
def declared_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """What a conversation depends on, in the order of first mention, each once."""
    c = table(spark, d, "conversations").withColumn("role", F.coalesce("role", F.lit("?")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return c.groupBy("conv_id").agg(F.array_join(F.array_distinct(listed), ",").alias("deps"))


@query(f"""WITH w AS (SELECT source, list(DISTINCT predicate) AS found FROM documents, (VALUES {', '.join(f"('{k}', '{p}_{k}')" for k, p, _ in words.KEYWORDS)}) AS k(k, predicate) WHERE contains(lower(text), k) GROUP BY source),
r AS (SELECT source, list(DISTINCT CASE WHEN lang = 'en' THEN 'Receives_public' ELSE 'Presents_With_mail' END) AS reference FROM documents GROUP BY source)
SELECT source, array_to_string(list_sort(list_filter(coalesce(found, []), lambda x: NOT list_contains(reference, x))), ',') AS only_here, array_to_string(list_sort(list_filter(reference, lambda x: NOT list_contains(coalesce(found, []), x))), ',') AS only_there FROM r LEFT JOIN w USING (source)""")
def predicate_differences(spark: SparkSession, d: str) -> DataFrame:
    """The predicates that one way of extraction finds for a source and another one doesn't."""
    docs = table(spark, d, "documents").where("source is not null")
    low = F.lower("text")
    found = F.filter(F.array(*[F.when(low.contains(k), F.lit(f"{p}_{k}")) for k, p, _ in words.KEYWORDS]), lambda x: x.isNotNull())
    reference = F.when(F.col("lang") == "en", "Receives_public").otherwise("Presents_With_mail")
    sets = docs.groupBy("source").agg(F.array_distinct(F.flatten(F.collect_set(found))).alias("found"), F.collect_set(reference).alias("reference"))
    left = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return sets.select("source", left("found", "reference").alias("only_here"), left("reference", "found").alias("only_there"))


@query(f"""WITH {fx.ORDER_RECORDS}, f AS (SELECT semantic_key AS root, arg_max(record_id, owner_seq) FILTER (year(created_at) < 1998) AS used, arg_max(record_id, owner_seq) AS held, min(arrival) AS a FROM records GROUP BY semantic_key)
SELECT root, row_number() OVER (ORDER BY a) - 1 AS validated_at FROM f WHERE used = held""")
def validation_clock(spark: SparkSession, d: str) -> DataFrame:
    """The place of each authorised plan in its batch, by its first arrival."""
    r = fx.order_records(spark, d)
    first = r.groupBy(F.col("semantic_key").alias("root")).agg(F.min("arrival").alias("a"))
    done = ledgers.planfence_outcomes(spark, d).where("outcome = 'AUTHORIZED'").join(first, "root")
    done = checkpointed(done.select("root", "a"))
    return ordering.numbered(done, "a", "validated_at", ordering.even_width(done, "a")).select("root", "validated_at")


@query("""SELECT doc_id, coalesce(trim(html), '') = '' AS missing, CAST(length(coalesce(trim(html), '')) AS BIGINT) AS n FROM documents LEFT JOIN (SELECT page_id, html FROM pages WHERE page_id % 2 = 0) ON page_id = doc_id % 400""")
def filing_sections(spark: SparkSession, d: str) -> DataFrame:
    """The raw section behind each document's file name, empty where there is no such file."""
    names = table(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), (F.col("doc_id") % 400).cast("string")).alias("file"))
    raw = table(spark, d, "pages").where("page_id % 2 = 0").select(F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("file"), F.col("html").alias("item_1"))
    return readers.section(raw, names, "item_1").select("doc_id", (F.col("item_1") == "").alias("missing"), F.char_length("item_1").cast("long").alias("n"))


@query(f"""WITH {fx.STAR} SELECT subject AS src, object AS dst, row_number() OVER (PARTITION BY subject, object ORDER BY ordinal) - 1 AS key, predicate AS relation, 'f' || ordinal % 7 AS file
FROM (SELECT * FROM star UNION ALL SELECT ordinal + 1, subject, subject_type, 'Again', object, object_type FROM star WHERE predicate <> 'Produce')""")
def multigraph_edges(spark: SparkSession, d: str) -> DataFrame:
    t = fx.star_triples(spark, d)
    twice = t.unionByName(t.where("predicate <> 'Produce'").withColumns({"ordinal": F.col("ordinal") + 1, "predicate": F.lit("Again")}))
    return triples.multigraph(twice.withColumn("file", F.concat(F.lit("f"), (F.col("ordinal") % 7).cast("string"))))


@query(f"""WITH {fx.STAR}, e AS (SELECT object AS src, subject AS dst, min(predicate) AS relation FROM star WHERE subject <> object GROUP BY ALL),
h1 AS (SELECT 'EUROPE' AS src, dst, 1 AS hop FROM e WHERE src = 'EUROPE'), h2 AS (SELECT min(e.src) AS src, e.dst, 2 AS hop FROM e JOIN h1 ON e.src = h1.dst WHERE e.dst NOT IN (SELECT dst FROM h1) AND e.dst <> 'EUROPE' GROUP BY e.dst)
SELECT src, relation, dst, hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) JOIN e USING (src, dst)""")
def entity_knowledge(spark: SparkSession, d: str) -> DataFrame:
    t = fx.star_triples(spark, d)
    return graph.knowledge(t.select(F.col("object").alias("subject"), "predicate", F.col("subject").alias("object")), "EUROPE", 2)


_ASKED = """asked AS (SELECT 'O-' || o_orderkey AS root, unnest(['C', 'N', CASE WHEN o_orderkey % 4 = 0 THEN 'L' ELSE 'R' END]) AS semantic_key FROM orders WHERE o_orderkey % 2 = 0)"""


@query(f"WITH {_ASKED} SELECT root, 'L' AS missing FROM asked WHERE semantic_key = 'L'")
def incomplete_lineage(spark: SparkSession, d: str) -> DataFrame:
    """The keys that a lineage never reaches, for the roots that were asked for them."""
    reached = graph.closure(fx.lineage(spark, d), table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("root")))
    found = reached.select("root", F.substring("node", 1, 1).alias("semantic_key"))
    o = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("root"), F.array(F.lit("C"), F.lit("N"), F.when(F.col("o_orderkey") % 4 == 0, "L").otherwise("R")).alias("k"))
    asked = o.select("root", F.explode("k").alias("semantic_key"))
    return graph.incomplete(asked, asked, found).select("root", F.array_join("missing", ",").alias("missing"))


@query("""SELECT 'O-' || o_orderkey AS root, c_custkey IS NOT NULL AND o_orderkey % 3 <> 0 AS derives FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def derivations(spark: SparkSession, d: str) -> DataFrame:
    """Whether an order derives from its customer and itself, and for every third one from a part as well."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").unionByName(table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti"))
    name = lambda letter, c: F.concat(F.lit(f"{letter}-"), F.col(c).cast("string"))
    wanted = o.select(name("O", "o_orderkey").alias("root"), F.explode(F.filter(F.array(name("O", "o_orderkey"), name("C", "o_custkey"), F.when(F.col("o_orderkey") % 3 == 0, name("P", "o_custkey"))), lambda x: x.isNotNull())).alias("node"))
    edges = fx.lineage(spark, d).join(table(spark, d, "customer").select(name("C", "c_custkey").alias("dst")), "dst", "left_semi").select("src", "dst")
    reached = graph.closure(edges, wanted.select("root").distinct())
    return graph.derives_from_all(reached, wanted)


@query(f"""WITH {fx.ORDER_RECORDS}, f AS (SELECT semantic_key AS root, count(*) AS n, CASE WHEN arg_max(record_id, owner_seq) FILTER (year(created_at) < 1998) = arg_max(record_id, owner_seq) THEN 'AUTHORIZED' ELSE 'REPLAN_REQUIRED' END AS outcome,
count(*) FILTER (tier < 2) AS facts FROM records GROUP BY semantic_key)
SELECT root, CASE WHEN outcome <> 'AUTHORIZED' THEN 'withheld: ' || outcome WHEN facts = 0 THEN 'no facts' ELSE 'it is so' END AS reply FROM f""")
def gated_answers(spark: SparkSession, d: str) -> DataFrame:
    r = fx.order_records(spark, d)
    facts = r.where("tier < 2").select(F.col("semantic_key").alias("root"), F.col("obj").alias("text"))
    said = r.select(F.col("semantic_key").alias("root")).distinct().withColumn("answer", F.lit("it is so"))
    return retrieval.answer(ledgers.planfence_outcomes(spark, d), facts, said)


@query("""WITH v AS (SELECT vec_id AS id, unnest(range(1, len(embedding) + 1)) - 1 AS term, unnest(embedding) AS w FROM embeddings),
q AS (SELECT term, round(CAST(w AS DOUBLE), 2) AS qw FROM v WHERE id = 7 AND w > 0.1), s AS (SELECT id, round(sum(round(CAST(w AS DOUBLE), 2) * qw), 6) AS score FROM v JOIN q USING (term) WHERE w > 0.1 GROUP BY id)
SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s ORDER BY score DESC, id LIMIT 30""")
def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("term", "w")).where("w > 0.1").withColumn("w", F.round(F.col("w").cast("double"), 2))
    return vector.sparse_top(terms, terms.where("id = 7").select("term", F.col("w").alias("qw")), 30)


@query("SELECT event_id FROM events WHERE event_id IS NOT NULL GROUP BY event_id")
def stream_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return windows.deduplicated(e.unionByName(e.where("event_id % 3 = 0"))).select("event_id")


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, CAST(length(CASE WHEN length(replace(t, chr(10), '\\n')) > 80 THEN substr(replace(t, chr(10), '\\n'), 1, 80) || '…(+' || (length(replace(t, chr(10), '\\n')) - 80) || ' chars)' ELSE replace(t, chr(10), '\\n') END) AS BIGINT) AS n,
CAST(count(*) OVER (PARTITION BY md5(left(replace(t, chr(10), '\\n'), 80))) AS BIGINT) AS alike FROM d""")
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Texts as lines of a log, cut, and how many begin alike."""
    line = F.coalesce(tx.truncated(F.col("text"), 80), F.lit(""))
    docs = table(spark, d, "documents").select("doc_id", F.char_length(line).cast("long").alias("n"), F.md5(F.substring(line, 1, 80)).alias("h"))
    return docs.join(docs.groupBy("h").agg(F.count("*").alias("alike")), "h").select("doc_id", "n", "alike")


@query(f"""WITH {fx.STAR} SELECT DISTINCT 'patient' AS subject, lower(subject_type) AS subject_type, lower(predicate) AS predicate, lower(trim(object)) AS object, lower(object_type) AS object_type FROM star""")
def semantic_matches(spark: SparkSession, d: str) -> DataFrame:
    t = fx.star_triples(spark, d).withColumn("object", F.concat(F.lit(" "), F.upper("object"), F.lit(" ")))
    return metrics.semantic_match(t).distinct()


@query(f"""WITH {fx.STAR} SELECT ordinal, subject, predicate, object FROM star WHERE ordinal % 5 IN (1, 3)""")
def file_subgraph(spark: SparkSession, d: str) -> DataFrame:
    t = fx.star_triples(spark, d).withColumn("file", F.concat(F.lit("f"), (F.col("ordinal") % 5).cast("string")))
    return graph.subgraph_of_files(t, ["f1", "f3"]).select("ordinal", "subject", "predicate", "object")


@query(f"""WITH {ledgers._AUDIT} SELECT record_id, CASE state WHEN 'ACTIVE' THEN '#54A24B' WHEN 'FLAGGED' THEN '#E45756' WHEN 'TBD' THEN '#F2CF5B' ELSE '#BAB0AC' END AS colour, 10 AS size, round(least(greatest((tier + 1) / sqrt(1 + tier), 0.1) * 40, 400), 6) AS length FROM records JOIN states USING (record_id)""")
def node_styles(spark: SparkSession, d: str) -> DataFrame:
    """How records are drawn, with the length of an edge of their distance."""
    r = fx.order_records(spark, d).join(lifecycle.states(ledgers._audit(spark, d)).withColumnRenamed("node_id", "record_id"), "record_id").withColumn("kind", F.lit("record"))
    return graph.styled(r).select("record_id", "colour", "size", F.round(tx.edge_length(tx.distance(F.col("tier"), F.col("tier"))), 6).alias("length"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 100) || CASE WHEN c_custkey % 100 = 1 THEN ' year' ELSE ' years' END WHEN c_custkey % 3 = 1 THEN '1 month' ELSE 'old' END AS age, CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE c_mktsegment END AS gender,
regexp_replace(lower(trim(c_mktsegment)), '[^a-z0-9]+', '_', 'g') IN ('building') AS functional FROM customer""")
def case_fields(spark: SparkSession, d: str) -> DataFrame:
    """Ages and genders as cases have them, and whether a predicate has one value at a time."""
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("[["), (k % 100).cast("string"), F.lit(".0, 'year']]"))).when(k % 3 == 1, "[[1.0, 'month']]").otherwise(" old ")
    gender = F.when(k % 3 == 0, " M").when(k % 3 == 1, "F").otherwise(F.col("c_mktsegment"))
    predicate = F.when(F.col("c_mktsegment") == "BUILDING", "has max building height").otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", tx.age_text(raw).alias("age"), tx.gender_text(gender).alias("gender"), tx.is_functional(predicate).alias("functional"))


@query("""WITH n AS (SELECT DISTINCT 'Patient ' || c_custkey AS name FROM customer UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer UNION SELECT upper(n_name) FROM nation UNION SELECT ' Nobody')
SELECT name, CASE WHEN starts_with(name, 'Patient ') THEN 'pt_' || substr(name, 9) WHEN regexp_full_match(name, '[0-9]+') THEN 'pt_' || name ELSE 'n_' || n_nationkey END AS entity FROM n LEFT JOIN nation ON upper(n_name) = name WHERE name <> ' Nobody'""")
def resolved_seeds(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    key = F.col("c_custkey").cast("string")
    entities = c.select(F.concat(F.lit("pt_"), key).alias("entity"), F.col("c_name").alias("label")).unionByName(n.select(F.concat(F.lit("n_"), F.col("n_nationkey").cast("string")).alias("entity"), F.col("n_name").alias("label")))
    names = c.select(F.concat(F.lit("Patient "), key).alias("name")).unionByName(c.select(key.alias("name"))).unionByName(n.select(F.upper("n_name").alias("name"))).unionByName(n.limit(1).select(F.lit(" Nobody").alias("name"))).distinct()
    return retrieval.resolve_seeds(names, entities)


@query("""SELECT doc_id, regexp_replace(regexp_replace(replace(trim(regexp_replace(regexp_replace(text, '[^\\x20-\\x7E]+', '', 'g'), '\\s+', ' ', 'g')), ' the ', ' our '), '\\b(we|us)\\b', 'Acme', 'gi'), '\\b(our|ours|the company)\\b', 'Acme''s', 'gi') AS plain FROM documents""")
def plain_prose(spark: SparkSession, d: str) -> DataFrame:
    """Texts in printable characters alone, with a name for the words that stand for it."""
    plain = F.replace(extract.printable(F.col("text")), F.lit(" the "), F.lit(" our "))
    return table(spark, d, "documents").select("doc_id", extract.named_for(plain, "Acme").alias("plain"))


@query(graphs.ORACLES["qa_facts_depth2"])
def qa_facts_resolved(spark: SparkSession, d: str) -> DataFrame:
    """The facts around the seeds that names resolve to."""
    t = fx.star_triples(spark, d).withColumn("state", F.when(F.col("predicate") == "Produce", "ARCHIVED").otherwise("ACTIVE"))
    regions = table(spark, d, "region").where("r_name like 'A%'")
    entities = regions.select(F.col("r_name").alias("entity"), F.lower("r_name").alias("label"))
    seeds = retrieval.resolve_seeds(regions.select(F.concat(F.lit(" "), F.lower("r_name")).alias("name")), entities).select("entity")
    found = retrieval.facts_around(t, seeds, 2, closed_type="CUSTOMER")
    return found.select("ordinal", F.concat_ws(" — ", "subject", "predicate", "object").alias("text"))
