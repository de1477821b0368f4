"""A table of the last row for each key, kept up by several writers and by streams.

A key belongs to a bucket.  A commit adds its rows to the buckets that they touch, each as one more file set of a bucket, and
then creates the next numbered manifest, which names the file sets of every bucket.  A manifest is created only if there is none of its
number: of two writers the slower one finds it there, reads the moved table, judges its rows again and tries the next number.  So nothing
that was committed is lost, and readers see whole commits only.  A bucket with more file sets than ``depth`` is rewritten when it is touched;
the others stay as they are.  A manifest has one entry a bucket, and old ones are kept as history.

A commit with a ``tag`` from a ``source`` is made once: a stream's micro-batch that comes again after a failure finds its number in the manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Judge = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


class Moved(Exception):
    """Another writer has made the manifest of this number."""


@dataclass
class KeyedTable:
    """The table at ``root`` with rows of ``schema``: of the rows of equal ``keys`` the one with the highest ``order`` counts, unless its ``deleted`` says that it is gone."""

    spark: SparkSession
    root: str
    schema: str
    keys: tuple[str, ...]
    order: str
    buckets: int = 64
    depth: int = 8
    deleted: str | None = None

    def _files(self):
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_manifests")
        return path.getFileSystem(conf), path, jvm.org.apache.hadoop.fs.Path

    def _number(self) -> int:
        fs, path, _ = self._files()
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max([int(n) for n in names if n.isdigit()], default=0)

    def manifest(self) -> dict:
        """``version``, ``sets`` (the file sets of each bucket, oldest first) and ``tags`` (the last tag of each source)."""
        n = self._number()
        if not n:
            return {"version": 0, "sets": {}, "tags": {}}
        fs, path, new = self._files()
        stream = fs.open(new(path, f"{n:020}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        fs, path, new = self._files()
        fs.mkdirs(path)
        try:
            stream = fs.create(new(path, f"{manifest['version']:020}"), False)  # fails if it is there
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise Moved from e
            raise
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()

    def _rows(self, manifest: dict, buckets=None) -> DataFrame:
        """All stored rows of the ``buckets``, those that no longer count too."""
        paths = [f"{self.root}/data/{s}/_bucket={b}" for b, sets in manifest["sets"].items() if buckets is None or int(b) in buckets for s in sets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _last(self, rows: DataFrame) -> DataFrame:
        whole = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*whole), F.struct(self.order, *[c for c in whole if c != self.order])).alias("_r")).select(*self.keys, "_r.*").select(*rows.columns)

    def _there(self, rows: DataFrame) -> DataFrame:
        return rows.where(~F.coalesce(F.col(self.deleted), F.lit(False))) if self.deleted else rows

    def read(self) -> DataFrame:
        """The rows that count."""
        return self._there(self._last(self._rows(self.manifest())))

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.partitionBy("_bucket").parquet(f"{self.root}/data/{name}")
        return name

    def _filled(self, name: str) -> list[int]:
        """The buckets that the file set ``name`` has rows of."""
        fs, _, new = self._files()
        found = [s.getPath().getName() for s in fs.listStatus(new(f"{self.root}/data/{name}"))]
        return [int(n.removeprefix("_bucket=")) for n in found if n.startswith("_bucket=")]

    def commit(self, rows: DataFrame, judge: Judge | None = None, source: str | None = None, tag: int | None = None, attempts: int = 20) -> tuple[int, DataFrame | None]:
        """(version, conflicts) after adding ``rows``; ``judge(rows, current)`` splits them into those to add and those refused.

        ``current`` are the rows that count of the touched buckets.  A repeated tag adds nothing.  ``rows`` must give the same again when it is read again.
        """
        touched = sorted(r[0] for r in self._bucketed(rows).select("_bucket").distinct().collect())  # at most one a bucket
        for _ in range(attempts):
            old = self.manifest()
            if source is not None and old["tags"].get(source, -1) >= tag:
                return old["version"], None
            good, bad = judge(rows, self._there(self._last(self._rows(old, touched)))) if judge else (rows, None)
            name = self._write(self._bucketed(good.select(*self._columns())))
            written = self._filled(name)
            sets = {int(b): list(s) for b, s in old["sets"].items()}
            for b in written:
                sets.setdefault(b, []).append(name)
            full = [b for b in written if len(sets[b]) > self.depth]
            if full:
                packed = self._write(self._bucketed(self._last(self._rows({"sets": sets}, full))))
                sets |= {b: [packed] for b in full}
            tags = old["tags"] | ({source: tag} if source is not None else {})
            try:
                self._publish({"version": old["version"] + 1, "sets": sets, "tags": tags})
                return old["version"] + 1, bad
            except Moved:
                continue
        raise Moved(f"other writers were faster {attempts} times")

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def follow(self, stream: DataFrame, source: str, judge: Judge | None = None):
        """A writer of ``stream`` into the table, each micro-batch once; it still needs a checkpoint folder and a trigger."""
        return stream.writeStream.foreachBatch(lambda batch, n: self.commit(batch, judge, source, n) and None)


def judge_heads(rows: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moves of heads (semantic_key, record_id, owner, owner_seq, writer) against those that hold: (to add, refused with ``fault``).

    A writer moves its own heads only, and upwards: each move's owner_seq exceeds the head's and those of its batch before it, which
    come in the order of owner_seq; of equal ones the least record_id is first.
    """
    from pyspark.sql import Window as W

    held = current.select("semantic_key", F.col("owner_seq").alias("held"))
    again = F.row_number().over(W.partitionBy("semantic_key", "owner_seq").orderBy("record_id")) > 1
    met = rows.withColumn("_again", again & (F.col("writer").eqNullSafe(F.col("owner")))).join(held, "semantic_key", "left")
    fault = F.when(~F.col("writer").eqNullSafe(F.col("owner")), "other owner").when(F.col("owner_seq") <= F.col("held"), "head has moved").when(F.col("_again"), "repeated")
    told = met.withColumn("fault", fault).drop("_again", "held")
    return told.where("fault is null").drop("fault"), told.where("fault is not null")
