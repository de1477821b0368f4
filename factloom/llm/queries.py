"""The registered queries of the corpus operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import audit, chat, hardneg, licenses, mixing, nbest, ordinal, passages, pii, rules, simhash, tokencount, topk
from factloom.llm.common import table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.plan(table(spark, sf_dir, "documents"))
    places = F.array_sort(F.transform("draws", lambda d: F.struct(d["shard"].alias("shard"), d["at"].alias("at"))))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), places.alias("places"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.rewrite(table(spark, sf_dir, "documents").select("doc_id", "text"), names=("n_mentions", "kinds"))


def op5_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(tokencount.flatten(table(spark, sf_dir, "documents"))).select("doc_id", "n_tokens")


def op6_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


def op8_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.encode(table(spark, sf_dir, "documents"), check="exact", keep=["doc_id"])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judge(table(spark, sf_dir, "documents"))
    named = [f"{r}_vote" for r in rules.RULES]
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("p_good", 9).alias("p_good"), *[F.get("votes", i).alias(n) for i, n in enumerate(named)],
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = passages.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hardneg.mine(vectors, vectors.where("vec_id % 50 = 0"))


QUERIES = {
    "op1_topk": op1_topk,
    "op2_licenses": op2_licenses,
    "op3_mixing": op3_mixing,
    "op4_pii": op4_pii,
    "op5_tokencount": op5_tokencount,
    "op6_ordinal": op6_ordinal,
    "op7_chat": op7_chat,
    "op8_nbest": op8_nbest,
    "op9_simhash": op9_simhash,
    "op10_quality_rules": op10_quality_rules,
    "op11_filter_audit": op11_filter_audit,
    "op12_passages": op12_passages,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op1_topk": topk.ORACLE_SQL,
    "op2_licenses": licenses.oracle_sql(),
    "op7_chat": chat.ORACLE_SQL,
    "op11_filter_audit": audit.ORACLE_SQL,
    "op13_hard_negatives": hardneg.ORACLE_SQL,
}
