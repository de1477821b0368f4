"""The reconciliation gate: which drafts become the authorised version of their key.

A draft is judged against the head of its key alone, so keys are independent and a key's drafts are
folded in the order of their arrival.  Three forms: a window form for keys where every draft may
commit, the general fold, and the per-draft rules as Column functions for judging one batch
against given heads.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import delta_clean


def precedence(tier: Column, valid_from: Column, head_tier: Column, head_valid_from: Column) -> Column:
    """SUPERSEDE, REJECT or COEXIST: the stronger (lower) tier wins, then the newer; equal ones coexist."""
    return (
        F.when(tier < head_tier, "SUPERSEDE")
        .when(tier > head_tier, "REJECT")
        .when(valid_from > head_valid_from, "SUPERSEDE")
        .when(valid_from < head_valid_from, "REJECT")
        .otherwise("COEXIST")
    )


def auto_allowed(tier: Column, auto: Column, head_tier: Column, head_auto: Column) -> Column:
    """Whether a head may give way without review."""
    return (head_tier != 0) & head_auto & auto & F.when(head_tier == 1, tier <= 1).when(head_tier.isin(2, 4), tier <= head_tier).otherwise(True)


def delta(obj: Column, valid_from: Column, head_obj: Column, head_valid_from: Column) -> Column:
    """IDENTICAL for the same cleaned value, CONTRADICTION for another one at the same instant, else SUPERSEDING_CHANGE."""
    return F.when(delta_clean(obj) == delta_clean(head_obj), "IDENTICAL").when(valid_from == head_valid_from, "CONTRADICTION").otherwise("SUPERSEDING_CHANGE")


def malformed(drafts: DataFrame) -> Column:
    """The first reason why a draft can't be judged (null: none).

    Where ``drafts`` has them, ``writer`` must not be blank, and ``missing_parent`` and ``lost_head`` name a record that
    isn't stored (:mod:`factloom.operators.commit`).
    """
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = F.when(
        missing("semantic_key") | missing("predicate") | missing("source_id") | F.col("obj").isNull() | F.coalesce(~F.col("tier").between(0, 4), F.lit(True)), "required field missing"
    )
    if "writer" in drafts.columns:
        reason = reason.when(missing("writer"), "no writer identity")
    if "missing_parent" in drafts.columns:
        reason = reason.when(F.col("missing_parent").isNotNull(), F.concat(F.lit("missing parent "), "missing_parent"))
    reason = reason.when(F.col("valid_from").isNull(), "no instant")
    return reason.when(F.col("lost_head").isNotNull(), F.concat(F.lit("lost head "), "lost_head")) if "lost_head" in drafts.columns else reason


def judge(drafts: DataFrame, heads: DataFrame) -> DataFrame:
    """One draft a key against ``heads`` (semantic_key, obj, tier, auto_update, valid_from): disposition and reason."""
    h = heads.select(F.col("semantic_key").alias("hk"), *[F.col(c).alias(f"head_{c}") for c in ("obj", "tier", "auto_update", "valid_from")])
    met = drafts.join(h, F.col("semantic_key") == F.col("hk"), "left")
    change = delta(F.col("obj"), F.col("valid_from"), F.col("head_obj"), F.col("head_valid_from"))
    wins = precedence(F.col("tier"), F.col("valid_from"), F.col("head_tier"), F.col("head_valid_from"))
    auto = auto_allowed(F.col("tier"), F.col("auto_update"), F.col("head_tier"), F.col("head_auto_update"))
    reason = (
        F.when(malformed(drafts).isNotNull(), malformed(drafts)).when(F.col("hk").isNull(), "first version").when(change == "IDENTICAL", "identical")
        .when(change == "CONTRADICTION", "contradiction").when(wins == "REJECT", "precedence").when(auto, "superseded").otherwise("needs review")
    )
    return met.withColumn("reason", reason).withColumn("disposition", disposition_of(F.col("reason"))).drop("hk")


def disposition_of(reason: Column) -> Column:
    """The disposition that goes with a reason."""
    return (
        F.when(reason.isin("first version", "superseded"), "AUTO_COMMIT").when(reason.isin("identical", "precedence"), "NO_OP")
        .when(reason == "contradiction", "FLAG_CONTRADICTION").when(reason == "needs review", "QUEUE_SYSTEM_2").otherwise("REJECT_FAIL_CLOSED")
    )


def step(head: tuple | None, bad: str | None, clean: str | None, tier: int, auto: bool, at, arrival: int) -> tuple[str, tuple | None]:
    """(reason, head afterwards) of one draft after the others of its key; a head is (clean object, tier, auto, instant, arrival, owner_seq)."""
    if bad:
        return bad, head
    if head is None:
        return "first version", (clean, tier, auto, at, arrival, 0)
    if clean == head[0]:
        return "identical", head
    if at == head[3]:
        return "contradiction", head
    if tier > head[1] or tier == head[1] and at < head[3]:
        return "precedence", head
    if head[1] != 0 and head[2] and auto:
        return "superseded", (clean, tier, auto, at, arrival, head[5] + 1)
    return "needs review", head


def fold(drafts: DataFrame) -> DataFrame:
    """``drafts`` with disposition, reason, head_arrival and owner_seq, each key's in the order of ``arrival``.

    ``head_arrival`` is the draft whose record was the head when this one was judged; ``owner_seq``
    is the head's number of commits afterwards.  Keys are dealt over tasks and sorted there; a task walks
    its rows once and holds one head, however many drafts a key has.
    """
    prepared = drafts.withColumns({"_bad": malformed(drafts), "_clean": delta_clean(F.col("obj"))})
    dealt = prepared.repartition("semantic_key").sortWithinPartitions("semantic_key", "arrival")
    names = drafts.columns
    schema = T.StructType([*drafts.schema.fields, *T._parse_datatype_string("reason string, head_arrival long, owner_seq long").fields])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, head = object(), None  # head: (clean object, tier, auto, instant, arrival, owner_seq)
        for batch in batches:
            get = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n in ("semantic_key", "tier", "auto_update", "valid_from", "arrival", "_bad", "_clean")}
            reasons, arrivals, seqs = [], [], []
            for k, tier, auto, at, arrival, bad, clean in zip(*(get[n] for n in ("semantic_key", "tier", "auto_update", "valid_from", "arrival", "_bad", "_clean"))):
                if k != key:
                    key, head = k, None
                arrivals.append(head[4] if head else None)
                reason, head = step(head, bad, clean, tier, auto, at, arrival)
                reasons.append(reason)
                seqs.append(head[5] if head else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(reasons, pa.string()), pa.array(arrivals, pa.int64()), pa.array(seqs, pa.int64())], names=[*names, "reason", "head_arrival", "owner_seq"])

    return dealt.mapInArrow(run, schema).withColumn("disposition", disposition_of(F.col("reason")))


def fold_steady(drafts: DataFrame) -> DataFrame:
    """The fold where all drafts of a key have one tier that isn't 0, may commit, and arrive in the order of their
    instants: a draft commits where its value differs from that of the draft before it."""
    order = W.partitionBy("semantic_key").orderBy("valid_from", "arrival")
    clean = delta_clean(F.col("obj"))
    before = F.lag(clean).over(order)
    commits = F.coalesce(clean != before, F.lit(True))
    seq = F.sum(commits.cast("long")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - 1
    return drafts.withColumns({"disposition": F.when(commits, "AUTO_COMMIT").otherwise("NO_OP"), "owner_seq": seq})


def committed(folded: DataFrame) -> DataFrame:
    """The versions that a fold committed."""
    return folded.where("disposition = 'AUTO_COMMIT'")


def histogram(folded: DataFrame) -> DataFrame:
    """The number of drafts by disposition and reason."""
    return folded.groupBy("disposition", "reason").agg(F.count("*").alias("n"))


def resolve_aliases(drafts: DataFrame) -> DataFrame:
    """``drafts`` under the first key, by arrival, of those that mean the same."""
    from factloom.functions.text import alias_norm

    normed = drafts.withColumn("_norm", alias_norm(F.col("semantic_key")))
    first = normed.groupBy("_norm").agg(F.min_by("semantic_key", F.struct("arrival", "semantic_key")).alias("_first"))
    return normed.join(first, "_norm").withColumns({"original_key": F.col("semantic_key"), "semantic_key": F.col("_first")}).drop("_norm", "_first")
