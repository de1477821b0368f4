"""Queries over prose, requests and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import prose
from factloom.functions import text as tx
from factloom.functions.frames import table
from factloom.operators import extract
from factloom.plans import fixtures as fx
from factloom.plans.registry import registry

QUERIES, ORACLES, query = registry()


@query("""SELECT doc_id, CAST(k AS INTEGER) AS k, regexp_full_match(lower(trim(name)), '(the\\s+)?(patient(\\s+\\w+)?|pt[-\\s]?\\w+|subject|individual|client|person|he|she|him|her|his|the\\s+man|the\\s+woman|a\\s+\\d+[\\s-]*y.*|\\d+[\\s-]*y.*|this\\s+\\d+[\\s-]*year[\\s-]*old.*)') AS refers
FROM (SELECT doc_id, unnest(range(6)) AS k, unnest(['Patient ' || doc_id, ' PT-' || doc_id, 'a ' || doc_id % 90 || '-Year-old from ' || source, lang, source || ' patient', 'The Person']) AS name FROM documents)""")
def self_references(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    names = F.array(
        F.concat(F.lit("Patient "), n), F.concat(F.lit(" PT-"), n), F.concat(F.lit("a "), (F.col("doc_id") % 90).cast("string"), F.lit("-Year-old from "), "source"),
        F.col("lang"), F.concat("source", F.lit(" patient")), F.lit("The Person"),
    )
    each = table(spark, d, "documents").select("doc_id", F.posexplode(names).alias("k", "name"))
    return each.select("doc_id", "k", prose.refers_to_subject(F.col("name")).alias("refers"))


def _nested(text: str, pairs) -> str:
    for a, b in pairs:
        text = f"replace({text}, '{a}', {b})"
    return text


_WE = _nested("text", [(" the ", "' we '"), (" and ", "' our '"), (" of ", "' the Company '"), (". T", "'. We T'")])
_NAMED = _nested(_WE, [(w, f"'{w[0].strip()[:0]}{' ' if w[0] == ' ' else ''}' || source || '''s '" if own else f"'{' ' if w[0] == ' ' else ''}' || source || ' '") for w, own in prose.COMPANY_WORDS])


@query(f"SELECT doc_id, md5({_NAMED}) AS digest FROM documents")
def company_names(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    for a, b in ((" the ", " we "), (" and ", " our "), (" of ", " the Company "), (". T", ". We T")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return table(spark, d, "documents").select("doc_id", F.md5(prose.company_named(t, F.col("source"))).alias("digest"))


_PATIENT = _nested("trim(replace(replace(text, ' the ', ' the patient '), ' that ', ' This patient '), ' ' || chr(9) || chr(10) || chr(13))", [(w, f"'{' ' if w[0] == ' ' else ''}P' || doc_id || ' '") for w in prose.PATIENT_WORDS])


@query(f"SELECT doc_id, md5({_PATIENT}) AS digest FROM documents")
def patient_names(spark: SparkSession, d: str) -> DataFrame:
    t = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit(" the patient ")), F.lit(" that "), F.lit(" This patient "))
    return table(spark, d, "documents").select("doc_id", F.md5(prose.patient_named(t, F.concat(F.lit("P"), F.col("doc_id").cast("string")))).alias("digest"))


@query("SELECT doc_id, md5(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]+', '', 'g')) AS digest FROM documents")
def repaired_contents(spark: SparkSession, d: str) -> DataFrame:
    escaped = F.replace("text", F.lit("\n"), F.lit("\\n"))
    return table(spark, d, "documents").select("doc_id", F.md5(prose.repaired(escaped)).alias("digest"))


_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\\s\\x0B]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"


@query(f"""WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n, list_filter(s, lambda x: contains(lower(x), 'the') OR contains(lower(x), ' de '))[1] AS first, list_filter(s, lambda x: contains(lower(x), 'an'))[-1] AS last FROM s""")
def keyword_sentences(spark: SparkSession, d: str) -> DataFrame:
    """How many sentences a text has, the first with one of some words and the last with another."""
    docs = table(spark, d, "documents").select("doc_id", prose.sentences(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("n"), prose.sentence_with(F.col("s"), ("the", " de ")).alias("first"), prose.sentence_with(F.col("s"), ("an",), last=True).alias("last"))


@query("""SELECT p_partkey, regexp_replace(p_type || '-' || p_name, '[^a-zA-Z0-9_]', '', 'g') AS node_key, replace(regexp_replace(p_type || ', ' || p_brand || '#', '[^a-zA-Z0-9_ ,\n]', '', 'g'), ' ', '_') AS asked,
CASE WHEN regexp_replace(p_name, '[^0-9]', '', 'g') = '' THEN p_name ELSE regexp_replace(p_name, '[^0-9]', '', 'g') END AS digits FROM part""")
def sanitised_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", prose.node_key(F.concat_ws("-", "p_type", "p_name")).alias("node_key"), prose.asked_entity(F.concat("p_type", F.lit(", "), "p_brand", F.lit("#"))).alias("asked"), prose.digits(F.col("p_name")).alias("digits"))


@query(f"""WITH {fx.STAR} SELECT ordinal, CASE WHEN ordinal % 3 = 0 THEN object WHEN ordinal % 2 = 0 THEN predicate ELSE subject END AS label FROM star""")
def object_labels(spark: SparkSession, d: str) -> DataFrame:
    t = fx.star_triples(spark, d)
    key = F.when(F.col("ordinal") % 2 == 0, F.concat_ws("::", "subject", "predicate")).otherwise(F.col("subject"))
    return t.select("ordinal", prose.object_label(F.when(F.col("ordinal") % 3 == 0, F.col("object")).otherwise(""), key).alias("label"))


@query("""WITH e AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'pt_' || c_custkey WHEN 1 THEN 'PT-' || c_custkey WHEN 2 THEN 'x' || c_custkey ELSE 'patients' || c_custkey END AS id, CASE WHEN c_custkey % 10 = 6 THEN 'A Patient' WHEN c_custkey % 10 = 2 THEN 'pt-' || c_custkey ELSE c_name END AS label FROM customer)
SELECT id, label FROM e WHERE starts_with(lower(id), 'pt_') OR starts_with(lower(id), 'pt-') OR starts_with(lower(id), 'patient_') OR contains(lower(label), 'pt-') OR contains(lower(label), 'patient') ORDER BY label, id""")
def list_patients(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    n, k = F.col("c_custkey").cast("string"), F.col("c_custkey")
    node = F.when(k % 4 == 0, F.concat(F.lit("pt_"), n)).when(k % 4 == 1, F.concat(F.lit("PT-"), n)).when(k % 4 == 2, F.concat(F.lit("x"), n)).otherwise(F.concat(F.lit("patients"), n))
    label = F.when(k % 10 == 6, "A Patient").when(k % 10 == 2, F.concat(F.lit("pt-"), n)).otherwise(F.col("c_name"))
    return c.select(node.alias("id"), label.alias("label")).where(prose.is_patient(F.col("id"), F.col("label"))).orderBy("label", "id")


@query("""SELECT doc_id, CAST(len(string_split(text, ',')) AS BIGINT) AS n, trim(string_split(text, ',')[-1], ' ' || chr(9) || chr(10) || chr(13)) AS last FROM documents""")
def context_splits(spark: SparkSession, d: str) -> DataFrame:
    items = prose.context_items(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(items).cast("long").alias("n"), F.element_at(items, -1).alias("last"))


@query("""WITH r AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'no json' WHEN 'click' THEN 'Here: [1, ' || props || '] and }' WHEN 'error' THEN '} ' || event_type || ' {' ELSE 'Sure! ' || props || ' [done]' END AS reply, event_type, props FROM events)
SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN '[1, ' || props || ']' WHEN 'error' THEN NULL ELSE props END AS json FROM r""")
def json_slices(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    reply = (
        F.when(kind == "view", "no json").when(kind == "click", F.concat(F.lit("Here: [1, "), "props", F.lit("] and }")))
        .when(kind == "error", F.concat(F.lit("} "), kind, F.lit(" {"))).otherwise(F.concat(F.lit("Sure! "), "props", F.lit(" [done]")))
    )
    return table(spark, d, "events").select("event_id", prose.json_slice(reply).alias("json"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'required field missing' WHEN o_custkey % 5 = 0 THEN 'key without attribute' WHEN o_orderstatus = 'P' THEN 'unknown record type'
       WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'derived without parents' END AS fault FROM orders""")
def draft_faults(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    key = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.when(F.col("o_custkey") % 5 == 0, "").otherwise("::status"))
    kind = F.when(F.col("o_orderstatus") == "P", "guessed").when(F.col("o_orderstatus") == "F", "derived").otherwise("asserted")
    parents = F.when(F.col("o_orderkey") % 2 == 1, F.array(F.lit("p")))
    return o.select("o_orderkey", prose.draft_fault(key, kind, parents, ~F.col("o_orderpriority").startswith("1")).alias("fault"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'IDENTICAL' WHEN 'purchase' THEN 'CONTRADICTION' WHEN 'view' THEN 'REFINEMENT' END AS delta, CAST(least(512, length(event_type) * user_id) AS BIGINT) AS n FROM events""")
def delta_labels(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    said = F.when(kind == "click", "identical").when(kind == "purchase", "Contradiction").when(kind == "view", "REFINEMENT").when(kind == "error", "unclear")
    label, why = prose.delta_label(said, F.repeat(kind, F.col("user_id").cast("int")))
    return table(spark, d, "events").select("event_id", label.alias("delta"), F.char_length(why).cast("long").alias("n"))


@query("""WITH q AS (SELECT doc_id, text, [upper(source), ' ' || substr(text, 1, 5) || ' ', '', NULL, 'zzzz' || doc_id] AS found FROM documents WHERE length(text) > 5)
SELECT doc_id, array_to_string(list_filter(list_transform(found, lambda e: trim(e)), lambda e: e IS NOT NULL AND e <> '' AND contains(lower(text), lower(e))), '|') AS entities FROM q""")
def query_entities(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.char_length("text") > 5)
    found = F.array(F.upper("source"), F.concat(F.lit(" "), F.substring("text", 1, 5), F.lit(" ")), F.lit(""), F.lit(None).cast("string"), F.concat(F.lit("zzzz"), F.col("doc_id").cast("string")))
    return docs.select("doc_id", F.array_join(prose.asked_entities(found, F.col("text")), "|").alias("entities"))


@query("""SELECT doc_id, CASE WHEN lang = 'de' THEN 'subject: placeholder' WHEN doc_id % 7 = 0 THEN 'predicate: empty' WHEN trim(text) = '' THEN 'object: empty' WHEN length(trim(text)) > 512 THEN 'object: too long'
  WHEN lower(trim(text)) IN ('nan', 'none', 'null', 'n/a', 'unknown') THEN 'object: placeholder' WHEN doc_id % 3 = 0 THEN 'value-laden predicate' ELSE 'fine' END AS fault FROM documents WHERE text IS NOT NULL AND source IS NOT NULL""")
def extraction_faults(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null and source is not null")
    subject = F.when(F.col("lang") == "de", " N/A ").otherwise(F.col("source"))
    predicate = F.when(F.col("doc_id") % 7 == 0, " ").when(F.col("doc_id") % 3 == 0, "effective from").otherwise("says")
    return docs.select("doc_id", F.coalesce(prose.row_fault(subject, predicate, F.col("text")), F.lit("fine")).alias("fault"))


@query("""SELECT doc_id, 'Q: ' || substr(replace(text, chr(10), '.'), 1, 4192) || ' A:' AS prompt FROM documents""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", prose.prompt("Q: {text} A:", F.col("text")).alias("prompt"))


@query("""SELECT event_id, event_type = 'view' AS served, event_type = 'click' OR user_id % 2 = 0 AS derived, CAST(CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'view' THEN 2 ELSE 1 END AS BIGINT) AS n FROM events""")
def record_flags(spark: SparkSession, d: str) -> DataFrame:
    """Whether a record is given out, whether it was derived, and how many documents its list names."""
    kind = F.col("event_type")
    parents = F.when(F.col("user_id") % 2 == 0, F.array("event_type"))
    listed = F.when(kind == "error", "").when(kind == "view", F.to_json(F.array(kind, F.col("props")))).otherwise(kind)
    e = table(spark, d, "events")
    return e.select("event_id", prose.served(F.when(kind == "view", "ACTIVE").when(kind == "click", "ARCHIVED")).alias("served"), prose.is_derived(F.when(kind == "click", "derived"), parents).alias("derived"), F.size(prose.as_list(listed)).cast("long").alias("n"))


@query(f"""WITH {fx.ORDER_RECORDS} SELECT record_id, to_json({{'record_id': record_id, 'obj': obj, 'tier': tier, 'parents': ['C-' || regexp_extract(semantic_key, '(\\d+)', 1)]}}) AS row, true AS same FROM records""")
def record_codec(spark: SparkSession, d: str) -> DataFrame:
    """Records as JSON rows, and whether reading them gives the records back."""
    r = fx.order_records(spark, d).withColumn("parents", F.array(F.concat(F.lit("C-"), F.regexp_extract("semantic_key", "(\\d+)", 1))))
    whole = F.struct("record_id", "obj", "tier", "parents")
    rows = r.select("record_id", whole.alias("r"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("row"))
    return rows.select("record_id", "row", (F.from_json("row", "record_id string, obj string, tier int, parents array<string>") == F.col("r")).alias("same"))


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies of several shapes about each document."""
    docs = table(spark, d, "documents").where("source is not null and lang is not null")
    five = lambda p: F.concat(F.lit("('"), "source", F.lit(f"', 'SOURCE', '{p}', '"), "lang", F.lit("', 'LANG')"))
    two = F.concat(five("Has_Age"), F.lit(", "), five("Receives"))
    k = F.col("doc_id") % 6
    reply = (
        F.when(k == 0, F.concat(F.lit("["), two, F.lit("]"))).when(k == 1, two).when(k == 2, F.concat(F.lit("Sure!\n```python\n["), two, F.lit(", ('a', 'b', 'c')]\n```")))
        .when(k == 3, F.concat(F.lit("["), five("Knows"), F.lit(", 'abcde', ('x',)]<|eot_id|> more"))).when(k == 4, F.lit("I can't help with that.")).otherwise(F.concat(F.lit("Facts: ["), five("has_age"), F.lit("] as asked.")))
    )
    return docs.select("doc_id", reply.alias("reply"))


@query("""SELECT doc_id, CAST(CASE doc_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 4 THEN 0 ELSE 1 END AS BIGINT) AS n, doc_id % 6 = 0 OR doc_id % 6 = 3 AS strict, doc_id % 6 = 0 OR doc_id % 6 = 5 AS standard
FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""".replace("WHEN 1 THEN 2 WHEN 2", "WHEN 1 THEN 0 WHEN 2"))
def scored_replies(spark: SparkSession, d: str) -> DataFrame:
    return extract.parse_scores(_replies(spark, d)).select("doc_id", F.size("triples").cast("long").alias("n"), "strict", "standard")


@query("""SELECT doc_id, CAST(CASE doc_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 2 END AS BIGINT) AS plain, CAST(CASE doc_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 2 END AS BIGINT) AS bracketed, CAST(CASE doc_id % 6 WHEN 0 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 5 THEN 1 END AS BIGINT) AS guarded
FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def parsed_replies(spark: SparkSession, d: str) -> DataFrame:
    """How many facts each way of reading replies finds; null where it finds no list at all."""
    out = _replies(spark, d)
    for name, parser in (("plain", "plain"), ("bracketed", "bracketed"), ("guarded", None)):
        out = extract.parse_replies(out, parser).withColumn(name, F.when(F.col("triples").isNotNull(), F.size("triples").cast("long"))).drop("triples")
    return out.drop("reply")


@query("""WITH c AS (SELECT doc_id, source, lang, trim(text) AS text FROM documents WHERE length(trim(text)) BETWEEN 100 AND 3000)
SELECT CAST(doc_id AS VARCHAR) AS patient_id, 'Has_Age' AS predicate, (doc_id % 90) || ' years' AS object FROM c UNION ALL SELECT CAST(doc_id AS VARCHAR), 'Has_Gender', CASE WHEN doc_id % 2 = 0 THEN 'Female' ELSE 'Male' END FROM c
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'Diagnosed_With', upper(lang) FROM c WHERE lang <> 'en' UNION ALL SELECT CAST(doc_id AS VARCHAR), 'Diagnosed_With', CASE WHEN contains(lower(text), 'covid-19') THEN 'COVID-19' ELSE 'ARDS' END FROM c WHERE lang = 'en' AND (contains(lower(text), 'covid-19') OR contains(lower(text), 'ards'))
UNION SELECT CAST(doc_id AS VARCHAR), predicate, object FROM c, (VALUES """ + ", ".join(f"('{k}', '{p}', '{x}')" for p, kws in (("Presents_With", extract.SYMPTOMS), ("Receives", extract.TREATMENTS)) for k, x in kws) + """) AS w(k, predicate, object) WHERE contains(lower(text), k)""")
def rule_made_facts(spark: SparkSession, d: str) -> DataFrame:
    return extract.case_triples(_cases(spark, d)).select("patient_id", "predicate", "object")


def _cases(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", F.trim("text").alias("text")).where(F.char_length("text").between(100, 3000))
    return docs.select(
        F.col("doc_id").cast("string").alias("patient_id"), F.concat((F.col("doc_id") % 90).cast("string"), F.lit(" years")).alias("age"), F.when(F.col("doc_id") % 2 == 0, "female").otherwise("male").alias("gender"),
        F.when(F.col("lang") != "en", F.col("lang")).otherwise("").alias("condition_hint"), "text",
    )


@query(f"""WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS patient_id, lang, {_SENTENCES.replace('text', 'trim(text)', 1)} AS s FROM documents WHERE length(trim(text)) BETWEEN 100 AND 3000)
SELECT patient_id, 'presentation' AS category, array_to_string(s[1:2], ' ') AS answer FROM c
UNION ALL SELECT patient_id, 'diagnosis', coalesce(list_filter(s, lambda x: contains(lower(x), lang))[1], s[1]) FROM c WHERE lang <> 'en'
UNION ALL SELECT patient_id, 'intervention', list_filter(s, lambda x: len(list_filter(['{"', '".join(prose.INTERVENTION_WORDS)}'], lambda w: contains(lower(x), w))) > 0)[1] FROM c WHERE len(list_filter(s, lambda x: len(list_filter(['{"', '".join(prose.INTERVENTION_WORDS)}'], lambda w: contains(lower(x), w))) > 0)) > 0
UNION ALL SELECT patient_id, 'outcome', coalesce(list_filter(s, lambda x: len(list_filter(['{"', '".join(prose.OUTCOME_WORDS)}'], lambda w: contains(lower(x), w))) > 0)[-1], s[-1]) FROM c""")
def rule_made_questions(spark: SparkSession, d: str) -> DataFrame:
    return extract.case_questions(_cases(spark, d)).select("patient_id", "category", "answer")


@query("""WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, lang FROM documents WHERE length(trim(text)) BETWEEN 100 AND 3000)
SELECT 'patient_' || id || '::age' AS semantic_key, (doc_id % 90) || ' years' AS obj FROM c UNION ALL SELECT 'patient_' || id || '::sex', CASE WHEN doc_id % 2 = 0 THEN 'female' ELSE 'male' END FROM c
UNION ALL SELECT 'patient_' || id || '::condition', lang FROM c WHERE lang <> 'en'""")
def structured_drafts(spark: SparkSession, d: str) -> DataFrame:
    return extract.case_drafts(_cases(spark, d), F.lit("2024-01-01").cast("timestamp")).select("semantic_key", "obj")


@query("""SELECT doc_id, name, cast(value as double) AS value FROM (SELECT doc_id, unnest(['helpfulness', 'verbosity']) AS name, unnest([doc_id % 5 + 0.5, CASE WHEN lang = 'en' THEN n_chars END]) AS value FROM documents) WHERE value IS NOT NULL""".replace("SELECT doc_id, name, cast(value as double) AS value FROM", "SELECT name, count(*) AS n, round(avg(CAST(value AS DOUBLE)), 6) AS mean FROM") + " GROUP BY name")
def reward_means(spark: SparkSession, d: str) -> DataFrame:
    """The means of the scores in replies; a score that a reply lacks doesn't count."""
    docs = table(spark, d, "documents").where("doc_id is not null")
    reply = F.concat_ws(",", F.concat(F.lit("helpfulness: "), (F.col("doc_id") % 5 + 0.5).cast("string")), F.when(F.col("lang") == "en", F.concat(F.lit("verbosity:"), F.col("n_chars").cast("string"))))
    each = docs.select(F.explode(tx.reward_map(reply)).alias("name", "value"))
    return each.groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
