"""Helpers around whole DataFrames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; where it names none, a temporary one is set on a single machine
    (tests), and a cluster is refused."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.  As a checkpoint, but the optimiser forgets what it has inferred about the rows, which
    in loops that join their own results with each other grows with each round."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, by: str) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder, in as many buckets by ``by`` as a shuffle has partitions, so that joins on it don't shuffle it; its name goes at the end."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, by).write.bucketBy(n, by).option("path", f"{ensure_checkpoint_dir(spark)}/{name}").saveAsTable(name, format="parquet")
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
