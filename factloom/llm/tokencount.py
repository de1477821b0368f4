"""Token counts from flat token files, by scanning for the end-of-document identifier.

A flat token file is nothing but the identifiers of its documents one after the other, each document
ended by a separator; there is no index.  The file is cut into blocks of equal size, wherever documents
begin or end.  Each block is searched for separators as a whole vector, which gives the lengths of the
documents inside it; what a document that crosses into a block has before it comes from a prefix scan over
the blocks.

:func:`flatten` writes such files from texts, one for each partition of the input, and a manifest of the
documents' order; :func:`read_files` reads them from storage, a file in as many tasks as it has ranges;
:func:`count` scans.  A block is searched in the task that has it, and becomes one row: its size, what follows
its last separator, and the lengths in it.  The prefix scan runs over sizes and tails alone, one row of a few
numbers for each block of a file, and its offsets are joined back to the blocks.

Defined cases: a null or empty text has 0 tokens; repeated rows and rows that share a doc_id are counted
one by one; tokens after the last separator of a file are a document that was cut off and are not
counted; an empty table or file gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import checkpointed, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of texts that this vocabulary was made for, and its free identifier, as separator.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEPARATOR = 50256
DTYPE = "<u2"
BLOCK = 1 << 16

FLAT = "file string, block long, ids binary, ordinal long, doc_id long"


def vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """The ranks in a vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding(ranks: dict[bytes, int], pattern: str = PATTERN):
    """The tokenizer of these ranks."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def flatten(docs: DataFrame, path: str = VOCABULARY, separator: int = SEPARATOR, block: int = BLOCK, dtype: str = DTYPE) -> DataFrame:
    """Flat token files from texts, in blocks, with their manifest: rows of :data:`FLAT`.

    Rows with ``ids`` are blocks of ``block`` identifiers (the last of a file may be shorter); rows
    with an ``ordinal`` say which document is the file's nth.  A partition of ``docs`` is one file.  All of it is
    written to the shared folder before it is read.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(path))  # a vocabulary file: a few MB

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoding(ranks.value).encode_ordinary
        name, held, n_held, at, ordinal = f"part-{TaskContext.get().partitionId():08d}", [], 0, 0, 0
        end = np.array([separator], dtype)

        def blocks(rest: bool) -> Iterator:
            nonlocal held, n_held, at
            flat = np.concatenate(held) if held else np.zeros(0, dtype)
            full = len(flat) if rest else len(flat) - len(flat) % block
            cuts = range(0, full, block)
            if len(cuts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(cuts)), pa.array(range(at, at + len(cuts)), pa.int64()), pa.array([flat[c : min(c + block, full)].tobytes() for c in cuts], pa.binary()), pa.nulls(len(cuts), pa.int64()), pa.nulls(len(cuts), pa.int64())],
                    names=["file", "block", "ids", "ordinal", "doc_id"],
                )
            at += len(cuts)
            held, n_held = [flat[full:]], len(flat) - full

        for batch in batches:
            texts, ids = batch.column(1), batch.column(0)
            for text in texts:
                text = text.as_py()
                one = np.array(encode(text), dtype) if text else end[:0]
                held += [one, end]
                n_held += len(one) + 1
                if n_held >= 16 * block:
                    yield from blocks(False)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(range(ordinal, ordinal + n), pa.int64()), ids], names=["file", "block", "ids", "ordinal", "doc_id"])
            ordinal += n
        yield from blocks(True)

    return stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FLAT))


def read_files(spark: SparkSession, path: str, block: int = BLOCK, width: int = 2, blocks_a_range: int = 512) -> DataFrame:
    """The flat token files under ``path``, in blocks, as rows of :data:`FLAT` without a manifest.

    Spark lists the files and deals out their ranges; a task opens a file at its range and holds one block, so that
    a file may have any size.  The store must be one that pyarrow's file systems reach (local and shared folders,
    object stores, HDFS).  A last identifier that is cut off is left out.
    """
    size = block * width
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")  # contents are not read
    starts = F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(size * blocks_a_range)))
    ranges = files.select("path", "length", starts.alias("start")).repartition("path", "start")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                store, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", row["path"]))
                with store.open_input_file(name) as file:
                    for at in range(row["start"], min(row["start"] + size * blocks_a_range, row["length"]), size):
                        raw = file.read_at(size, at)
                        raw = raw[: len(raw) - len(raw) % width]
                        yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([at // size], pa.int64()), pa.array([raw], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names=["file", "block", "ids", "ordinal", "doc_id"])

    return ranges.mapInArrow(run, FLAT)


SCANNED = "file string, block long, size long, tail long, lengths array<long>"


def _scan(flat: DataFrame, separator: int, dtype: str) -> DataFrame:
    """For each block its size, the identifiers after its last separator (null without one), and before each separator:
    since the one before it, or for the first since the block's begin."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for name, block, raw in zip(batch.column(0), batch.column(1), batch.column(2)):
                ids = np.frombuffer(raw.as_buffer(), dtype)
                places = np.flatnonzero(ids == separator)
                lengths = np.diff(places, prepend=-1) - 1
                tail = len(ids) - 1 - int(places[-1]) if len(places) else None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()]), pa.array([block.as_py()], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([tail], pa.int64()), pa.array([lengths], pa.list_(pa.int64()))],
                    names=["file", "block", "size", "tail", "lengths"],
                )

    return flat.where("ids is not null").select("file", "block", "ids").mapInArrow(run, SCANNED)


def count(flat: DataFrame, separator: int = SEPARATOR, dtype: str = DTYPE) -> DataFrame:
    """file, ordinal, doc_id, n_tokens of each document of the flat files ``flat`` (rows of :data:`FLAT`).

    doc_id is null where the files come without a manifest.
    """
    scanned = checkpointed(_scan(flat, separator, dtype))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = scanned.select("file", "block", "size", "tail", F.size("lengths").alias("n"))
    ends = blocks.withColumns({"start": F.coalesce(F.sum("size").over(before), F.lit(0)), "first": F.coalesce(F.sum("n").over(before), F.lit(0))})
    # where the document begins that is open after a block: the largest such place so far is the last one
    opened = ends.withColumn("open", F.when(F.col("tail").isNotNull(), F.col("start") + F.col("size") - F.col("tail")))
    carried = opened.select("file", "block", "first", (F.col("start") - F.coalesce(F.max("open").over(before), F.lit(0))).alias("carried"))
    met = scanned.select("file", "block", "lengths").join(carried, ["file", "block"])
    each = met.select("file", "first", "carried", F.posexplode("lengths").alias("at", "length"))
    found = each.select("file", (F.col("first") + F.col("at")).alias("ordinal"), F.lit(None).cast("long").alias("doc_id"), (F.col("length") + F.when(F.col("at") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"))
    manifest = flat.where("ordinal is not null").select("file", "ordinal", "doc_id", F.lit(None).cast("long").alias("n_tokens"))
    return found.unionByName(manifest).groupBy("file", "ordinal").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
