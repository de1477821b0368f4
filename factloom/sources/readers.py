"""Documents, conversations, policies and records from storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom import schemas

#: What a kind of source is trusted with (tier, automatic updates, tag).
POLICIES = (
    ("statute", 0, False, "canonical"),
    ("contract", 0, False, "canonical"),
    ("municipal", 0, False, "canonical"),
    ("policy", 1, False, "internal"),
    ("sop", 1, True, "internal"),
    ("vendor_doc", 2, True, "external"),
    ("arxiv", 2, True, "external"),
    ("derived", 3, True, "derived"),
    ("conversation", 4, True, "observational"),
    ("email", 4, True, "observational"),
)


#: The policies of clinical authors by role, as of :data:`POLICIES`.
CLINICAL_POLICIES = (
    ("Primary_Care_Physician", 1, True, "clinical_physician"),
    ("General_Surgeon", 1, True, "clinical_specialist"),
    ("Nephrologist", 1, True, "clinical_specialist"),
    ("Endocrinologist", 1, True, "clinical_specialist"),
    ("ED_Attending_Physician", 1, True, "clinical_physician"),
    ("Radiologist", 1, True, "clinical_imaging"),
    ("Laboratory_System", 1, True, "clinical_lab"),
    ("Triage_Nurse", 2, True, "clinical_triage"),
)


def clinical_policies(spark: SparkSession) -> DataFrame:
    """The default policies with those of clinical roles over them."""
    rows = [(*row, k) for k, row in enumerate(CLINICAL_POLICIES)]
    return policies(spark, spark.createDataFrame(rows, "source string, tier int, auto_update boolean, tag string, seq long"))


def policies(spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """(source, tier, auto_update, tag): the default policies, with ``overrides`` (and seq) over them, the last winning."""
    base = spark.createDataFrame(list(POLICIES), "source string, tier int, auto_update boolean, tag string")
    if overrides is None:
        return base
    all_ = base.withColumn("seq", F.lit(-1).cast("long")).unionByName(overrides.select("source", "tier", "auto_update", "tag", F.col("seq").cast("long").alias("seq")))
    return all_.withColumn("_r", F.row_number().over(W.partitionBy("source").orderBy(F.desc("seq")))).where("_r = 1").drop("_r", "seq")


def with_policy(items: DataFrame, policy_table: DataFrame) -> DataFrame:
    """``items`` (source_id, ...) with tier, auto_update and tag: by the whole source_id, else by what stands
    before its first colon, else the weakest.  The policy table has a row for each kind of source."""
    exact = policy_table.select(F.col("source").alias("_e"), *[F.col(c).alias(f"_e_{c}") for c in ("tier", "auto_update", "tag")])
    kind = policy_table.select(F.col("source").alias("_k"), *[F.col(c).alias(f"_k_{c}") for c in ("tier", "auto_update", "tag")])
    met = items.join(exact, F.col("source_id") == F.col("_e"), "left").join(kind, F.substring_index("source_id", ":", 1) == F.col("_k"), "left")
    pick = lambda c, default: F.coalesce(F.when(F.col("_e").isNotNull(), F.col(f"_e_{c}")), F.when(F.col("_k").isNotNull(), F.col(f"_k_{c}")), F.lit(default)).alias(c)
    return met.select(*items.columns, pick("tier", 4), pick("auto_update", True), pick("tag", "observational"))


def conversation_texts(conversations: DataFrame) -> DataFrame:
    """(conv_id, text): a line ``role: text`` for each turn, ? for a missing role and nothing for a missing text."""
    line = F.concat(F.coalesce("role", F.lit("?")), F.lit(": "), F.coalesce("text", F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return conversations.groupBy("conv_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("text"))


def emr_documents(spark: SparkSession, path: str, role_tiers: dict[str, int] | None = None) -> DataFrame:
    """One row for each document of nested patient records, with the tier of its author's role: by ``role_tiers``, else that of clinical roles, else the weakest."""
    tiers = {source: tier for source, tier, _, _ in CLINICAL_POLICIES} if role_tiers is None else role_tiers
    docs = spark.read.schema(schemas.EMR).option("multiLine", True).json(path).select("patient_id", F.explode("emr_documents").alias("d")).select("patient_id", "d.*")
    tier = F.lit(4)
    for role, t in tiers.items():
        tier = F.when(F.col("author_role") == role, t).otherwise(tier)
    return docs.withColumns({"tier": tier, "valid_from": F.try_to_timestamp("timestamp")})


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines of ``path`` that parse."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of ``path`` that have as many fields as its header."""
    return spark.read.schema(schema).options(header=True, mode="DROPMALFORMED", multiLine=True, escape='"').csv(path)


def texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of each file."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def visible_text(html: Column) -> Column:
    """What a page says: without scripts, styles and tags, its entities resolved and white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def tag_text(html: Column, tag: str) -> Column:
    """What stands in the first element ``tag``, trimmed; null without one."""
    got = F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return F.nullif(F.trim(got), F.lit(""))


def tagged_value(html: Column, name: str) -> Column:
    """The value of the inline element with this name, null without one."""
    return F.nullif(F.regexp_extract(html, rf"""(?is)<ix:nonNumeric\b[^>]*name=["']{name}["'][^>]*>([^<]*)<""", 1), F.lit(""))


TRIPLE_FILE = "filename string, item_1a array<array<string>>, item_7 array<array<string>>"


def triple_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, subject, subject_type, predicate, object, object_type) of files of triples, one JSON document each.

    Files that can't be read, or lack one of the two lists, are left out, and so are triples without a head,
    relation or tail.
    """
    files = spark.read.schema(TRIPLE_FILE).options(multiLine=True, mode="DROPMALFORMED").json(path)
    each = files.select(F.col("filename").alias("file"), F.explode(F.concat("item_1a", "item_7")).alias("t"))
    part = lambda i: F.get("t", F.lit(i))
    named = each.select("file", *[part(i).alias(n) for i, n in enumerate(("subject", "subject_type", "predicate", "object", "object_type"))])
    return named.where("subject is not null and predicate is not null and object is not null")


def section(filings: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """``names`` (file, ...) with the section ``column`` of the filing of that name, trimmed; empty where there is none."""
    raw = filings.select("file", F.col(column).alias("_section"))
    return names.join(raw, "file", "left").withColumn(column, F.trim(F.coalesce("_section", F.lit("")))).drop("_section")


def ticker_filings(spark: SparkSession, path: str, tickers: list[str]) -> DataFrame:
    """(ticker, file, form, text) of the text files under a folder for each of ``tickers``; the form is told by the file's name."""
    found = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    parts = F.split(F.col("_metadata.file_path"), "/")
    named = found.select(parts.alias("_parts"), F.element_at(parts, -1).alias("file"), F.col("value").alias("text"))
    ticker = F.try_element_at(F.filter("_parts", lambda x: x.isin(tickers)), F.lit(-1))
    return named.select(ticker.alias("ticker"), "file", F.when(F.col("file").contains("10-K"), "10-K").otherwise("10-Q").alias("form"), "text").where("ticker is not null")
