"""Append-only tables and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, *partitions: str) -> None:
    """Add rows to a table; rows already there are never rewritten."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def publish(tables: dict[str, DataFrame], root: str, version: int) -> None:
    """Write a snapshot of several tables, and only when all are there point to it."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{root}/v{version}/{name}")
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(f"{root}/_published")


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the last snapshot that was published whole."""
    version = spark.read.schema("version long").json(f"{root}/_published").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/v{version}/{name}")


def archive_cold(evicted: DataFrame, path: str) -> None:
    """Evicted records by transaction."""
    evicted.select("txn_id", "record_id", "semantic_key", "obj", "owner_seq", "evicted_at").write.mode("append").partitionBy("txn_id").json(path)


def node_link(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as one JSON document a row, for viewers."""
    as_json = lambda df: df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    return as_json(nodes), as_json(edges)


def chat_examples(rows: DataFrame) -> DataFrame:
    """Training examples (prompt, completion, text) of rows (instruction, input, output) with an input."""
    prompt = F.format_string("<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n%s\n\n%s<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", "instruction", "input")
    out = rows.where(F.trim("input") != "").withColumns({"prompt": prompt, "completion": F.concat("output", F.lit("<|eot_id|>"))})
    return out.withColumn("text", F.concat("prompt", "completion"))


def triple_csv(entities: DataFrame, relations: DataFrame, triples: DataFrame, path: str) -> None:
    """The three tables of a graph as CSV folders with headers."""
    for name, df in (("entities", entities), ("relations", relations), ("triples", triples)):
        df.write.option("header", True).mode("overwrite").csv(f"{path}/{name}")


def chunk_csv(chunks: DataFrame, path: str) -> None:
    """Chunks (id, content) as CSV; line ends and quotes in a chunk are quoted."""
    chunks.select("id", "content").write.options(header=True, escape='"', quoteAll=True).mode("overwrite").csv(path)


def manifest(spark: SparkSession, path: str, counts: dict[str, DataFrame], **facts: object) -> None:
    """One JSON row with the number of rows of each of ``counts`` and given facts, added to a folder."""
    row = spark.range(1).select(*[F.lit(df.count()).alias(f"n_{k}") for k, df in counts.items()], *[F.lit(v).alias(k) for k, v in facts.items()])
    row.coalesce(1).write.mode("append").json(path)
