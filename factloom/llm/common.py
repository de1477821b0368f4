"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.frames import checkpointed, ensure_checkpoint_dir, table

__all__ = ["SPACES", "bind", "checkpointed", "ensure_checkpoint_dir", "fresh", "lower_ascii", "needs_stored", "packed", "stored", "table", "whole_text"]

#: ASCII white space, [\x20\x09-\x0D]; words are maximal runs of anything else.
SPACES = " \t\n\x0b\x0c\r"

#: Rows of a few numbers that are worth a task.
ROWS_A_TASK = 10_000


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Plan nodes that keep rows where they are, and those that read stored rows.
_IN_PLACE, _STORED = {"Project", "Filter", "Union", "Generate"}, {"LogicalRelation", "LogicalRDD", "LocalRelation", "DataSourceV2ScanRelation", "Range", "Relation"}


def needs_stored(docs: DataFrame) -> None:
    """Refuse input whose rows may come in another order when it is read again: row numbers would then not meet.

    Stored files and checkpoints keep their order, also after a filter or a projection.
    """
    todo = [docs._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() not in _IN_PLACE | _STORED and not (node.children().isEmpty() and "Relation" in node.nodeName()):
            raise ValueError(f"the rows must come straight from stored files, not from {node.nodeName()}: write them first")
        todo += [node.children().apply(i) for i in range(node.children().size())]


def whole_text(name: str = "text") -> Column:
    """The text, a null as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """The text with A-Z as a-z, and nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bind(value: Column, body) -> Column:
    """``body(v)`` with ``v`` evaluated once, also where lambdas inside ``body`` use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has up to so many ``rows`` of a few numbers, in no more partitions than these are worth.

    Each partition leaves files on disk in each shuffle and each checkpoint that it goes into, also without rows.
    """
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: a checkpoint of which single columns can be read."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
