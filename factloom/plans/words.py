"""Queries over texts, names and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions.frames import table
from factloom.plans.registry import registry
from factloom.sources import readers

QUERIES, ORACLES, query = registry()

_CANON = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in tx.WORD_CANON.items()) + "}"


def _slug_sql(x: str) -> str:
    return f"trim(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '_', 'g'), '_')"


def _canon_sql(x: str) -> str:
    return f"array_to_string(list_transform(string_split({_slug_sql(x)}, '_'), lambda w: coalesce(element_at({_CANON}, w)[1], w)), '_')"


@query("""
SELECT doc_id, CAST(i - 1 AS BIGINT) AS chunk_no, CAST(length(chunk) AS BIGINT) AS n_chars, md5(chunk) AS digest FROM (
  SELECT doc_id, unnest(range(1, 1 + CAST(ceil(length(t) / 6000.0) AS BIGINT))) AS i, t, substr(t, CAST((i - 1) * 6000 + 1 AS BIGINT), 6000) AS chunk
  FROM (SELECT doc_id, trim(text) AS t FROM documents WHERE trim(coalesce(text, '')) <> ''))""")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "documents").select("doc_id", F.posexplode(tx.chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return each.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.char_length("chunk").cast("long").alias("n_chars"), F.md5(F.col("chunk")).alias("digest"))


@query("""
SELECT conv_id, string_agg(coalesce(role, '?') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, coalesce(role, '?') || ': ' || coalesce(text, '')) AS text FROM conversations GROUP BY conv_id""")
def conversation_text(spark: SparkSession, d: str) -> DataFrame:
    return readers.conversation_texts(table(spark, d, "conversations"))


@query(f"""
SELECT p_partkey, {_slug_sql('p_name')} || '::' || {_canon_sql("p_type || ' max qty'")} AS one_key,
       {_slug_sql('p_name')} || '::' || {_canon_sql("p_type || ' max qty'")} || '::' || {_slug_sql('p_brand')} AS many_key FROM part""")
def slug_semantic_key(spark: SparkSession, d: str) -> DataFrame:
    predicate = F.concat("p_type", F.lit(" max qty"))
    return table(spark, d, "part").select("p_partkey", tx.semantic_key(F.col("p_name"), predicate).alias("one_key"), tx.semantic_key(F.col("p_name"), predicate, F.col("p_brand")).alias("many_key"))


@query("""
SELECT event_id, obj, trim(obj) <> '' AND (event_type <> 'view' OR NOT regexp_matches(trim(obj), '^[\\s\\d.,%$/-]+$')) AS shaped
FROM (SELECT event_id, event_type, CASE WHEN event_type = 'click' THEN event_type || ' ' || value ELSE CAST(CAST(value AS BIGINT) AS VARCHAR) || '%' END AS obj FROM (SELECT event_id, event_type, floor(value) AS value FROM events))""".replace("event_type || ' ' || value", "event_type || ' ' || CAST(CAST(value AS BIGINT) AS VARCHAR)"))
def entity_shape_filter(spark: SparkSession, d: str) -> DataFrame:
    whole = F.floor("value").cast("long").cast("string")
    obj = F.when(F.col("event_type") == "click", F.concat("event_type", F.lit(" "), whole)).otherwise(F.concat(whole, F.lit("%")))
    e = table(spark, d, "events").select("event_id", obj.alias("obj"), F.when(F.col("event_type") == "view", "").otherwise("METRIC").alias("kind"))
    return e.select("event_id", "obj", tx.is_entity_shaped(F.col("obj"), F.col("kind")).alias("shaped"))


@query("""
SELECT doc_id, line_no, len(string_split_regex(trim(line), '\\s+')) > 6 OR (regexp_matches(line, '[0-9]') AND len(string_split_regex(trim(line), '\\s+')) > 3)
       OR contains(lower(line), 'effective') OR contains(lower(line), 'as of') OR contains(lower(line), 'as_of') AS value_laden
FROM (SELECT doc_id, CAST(unnest(range(len(l))) AS BIGINT) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
WHERE trim(line) <> ''""")
def value_laden_filter(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(F.trim("line") != "")
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), tx.is_value_laden(F.col("line")).alias("value_laden"))


@query("""
SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN trim(text) = '' THEN 'empty' WHEN length(trim(text)) > 512 THEN 'too long'
       WHEN lower(trim(text)) IN ('nan', 'none', 'null', 'n/a', 'unknown') THEN 'placeholder' ELSE 'fine' END AS verdict FROM documents""")
def clean_string_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce(tx.string_fault(F.col("text")), F.lit("fine")).alias("verdict"))


@query(f"""
SELECT doc_id, source, lang, tier, auto_update, tag FROM (
  SELECT doc_id, source, lang, CASE kind WHEN 'policy' THEN 1 WHEN 'arxiv' THEN 2 WHEN 'email' THEN 4 ELSE 4 END AS tier,
         kind <> 'policy' AS auto_update, CASE kind WHEN 'policy' THEN 'internal' WHEN 'arxiv' THEN 'external' ELSE 'observational' END AS tag
  FROM (SELECT *, CASE lang WHEN 'en' THEN 'policy' WHEN 'de' THEN 'arxiv' WHEN 'fr' THEN 'email' ELSE 'other' END AS kind FROM documents))""")
def source_policy(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "policy").when(F.col("lang") == "de", "arxiv").when(F.col("lang") == "fr", "email").otherwise("other")
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.concat(kind, F.lit(":"), F.col("source")).alias("source_id"))
    return readers.with_policy(docs, readers.policies(spark)).drop("source_id")


@query("""
SELECT page_id, CAST(CASE WHEN b = 0 THEN 0 WHEN e = 0 THEN length(html) - b + 1 ELSE 8 + e END AS BIGINT) AS n_chars
FROM (SELECT page_id, html, instr(html, '<article>') AS b, instr(substr(html, instr(html, '<article>') + 9), '</article>') AS e FROM pages)""")
def page_section_slice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.char_length(tx.between(F.col("html"), "<article>", "</article>")).cast("long").alias("n_chars"))


@query("""
SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1)), '') AS title,
       nullif(trim(regexp_extract(html, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1)), '') AS heading FROM pages""")
def page_tag_extract(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", readers.tag_text(html, "title").alias("title"), readers.tag_text(html, "h1").alias("heading"))


@query(f"""
SELECT doc_id, lower(regexp_extract(t, '(?i)\\b({'|'.join(tx.CONDITIONS)})\\b', 0)) AS condition_hint, CAST(length(t) AS BIGINT) AS n
FROM (SELECT doc_id, trim(text) AS t FROM documents) WHERE length(t) BETWEEN 300 AND 2500""")
def condition_hint_cut(spark: SparkSession, d: str) -> DataFrame:
    cut = table(spark, d, "documents").select("doc_id", F.trim("text").alias("t")).where(F.char_length("t").between(300, 2500))
    return cut.select("doc_id", tx.condition_hint(F.col("t")).alias("condition_hint"), F.char_length("t").cast("long").alias("n"))


#: What stands for the keyword maps of clinical cases in these tables' prose: (keyword, predicate, label).
KEYWORDS = (("license", "Presents_With", "License"), ("token", "Presents_With", "Token"), ("public", "Receives", "Publication"), ("version", "Receives", "Versioning"), ("mail", "Presents_With", "Mail"))


@query(f"""
SELECT DISTINCT 'Document ' || doc_id AS subject, predicate, label AS object FROM documents, (VALUES {', '.join(f"('{k}', '{p}', '{x}')" for k, p, x in KEYWORDS)}) AS k(keyword, predicate, label)
WHERE contains(lower(text), keyword)""")
def keyword_triples(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    found = F.filter(F.array(*[F.when(low.contains(k), F.struct(F.lit(p).alias("predicate"), F.lit(x).alias("object"))) for k, p, x in KEYWORDS]), lambda x: x.isNotNull())
    return table(spark, d, "documents").select(F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("subject"), F.inline(F.array_distinct(found)))


@query("""
SELECT orig, norm, min(k) AS canonical FROM (
  SELECT k AS orig, k, replace(replace(CASE WHEN s LIKE '%ies' THEN left(s, length(s) - 3) || 'y' WHEN s LIKE '%s' AND s NOT LIKE '%ss' THEN left(s, length(s) - 1) ELSE s END, 'hassex', 'hasgender'), 'sex', 'gender') AS norm
  FROM (SELECT k, lower(replace(k, '_', '')) AS s FROM (SELECT DISTINCT p_name || '::' || lower(p_type) || 's' AS k FROM part))) GROUP BY ALL""")
def alias_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "part").select(F.concat("p_name", F.lit("::"), F.lower("p_type"), F.lit("s")).alias("orig")).distinct()
    return keys.withColumn("norm", tx.alias_norm(F.col("orig"))).groupBy("orig", "norm").agg(F.min("orig").alias("canonical"))


@query("""
SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[.!?]\\s+'), lambda x: x <> '')) AS BIGINT) AS n_sentences FROM documents""")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(F.split("text", r"[.!?]\s+", -1), lambda x: x != "")).cast("long").alias("n_sentences"))
