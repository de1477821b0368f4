"""Versions, states, reverts, collection and plans over append-only event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom import schemas


def versions(records: DataFrame) -> DataFrame:
    """``records`` with version_no (from 1) and prior_id, the version before, by key and owner_seq."""
    order = W.partitionBy("semantic_key").orderBy("owner_seq")
    return records.withColumns({"version_no": F.row_number().over(order).cast("long"), "prior_id": F.lag("record_id").over(order)})


def heads(moves: DataFrame) -> DataFrame:
    """(semantic_key, record_id, owner_seq): the last move of each key."""
    return moves.groupBy("semantic_key").agg(F.max_by("record_id", "owner_seq").alias("record_id"), F.max("owner_seq").alias("owner_seq"))


def head_conflicts(moves: DataFrame) -> DataFrame:
    """Moves whose owner_seq does not exceed all earlier ones of their key, in the order of ``seq``."""
    before = F.max("owner_seq").over(W.partitionBy("semantic_key").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return moves.withColumn("_before", before).where(F.col("owner_seq") <= F.col("_before")).drop("_before")


def append(store: DataFrame, new: DataFrame, identity: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows of ``new`` to append, conflicts): records are put once; the same id with other content is a conflict."""
    blob = F.sha2(F.to_json(F.struct(*identity), {"ignoreNullFields": "false"}), 256)
    known = store.select("record_id", blob.alias("_old"))
    met = new.withColumn("_new", blob).join(known, "record_id", "left")
    within = met.groupBy("record_id").agg(F.countDistinct("_new").alias("n")).where("n > 1").select("record_id")
    conflicts = met.where(F.col("_old") != F.col("_new")).select("record_id").unionByName(within).distinct()
    fresh = met.where(F.col("_old").isNull()).join(conflicts, "record_id", "left_anti").drop("_old", "_new").dropDuplicates(["record_id"])
    return fresh, conflicts


def states(audit: DataFrame) -> DataFrame:
    """(node_id, state): where each node's last transition led; no-op rows change nothing."""
    return audit.groupBy("node_id").agg(F.max_by("to_state", "seq").alias("state"))


def illegal_transitions(audit: DataFrame) -> DataFrame:
    """Transitions to another state that no node may make."""
    allowed = F.lit(False)
    for a, to in schemas.TRANSITIONS.items():
        allowed = allowed | ((F.col("from_state") == a) & F.col("to_state").isin(*to))
    started = F.col("from_state").isNull() & F.col("to_state").isin("ACTIVE", "ARCHIVED")
    return audit.where(~F.coalesce((F.col("from_state") == F.col("to_state")) | allowed, started))


def cascade(archived: DataFrame, dependents: DataFrame, current: DataFrame) -> DataFrame:
    """(record_id, cause, routing): active direct dependents of ``archived`` (record_id), which are to be derived anew.

    ``dependents`` is (parent, child), ``current`` (record_id, state, tier).  Facts of tier 3 are derived
    automatically, others need review.
    """
    met = dependents.join(archived.select(F.col("record_id").alias("parent")), "parent").join(current, dependents["child"] == current["record_id"])
    live = met.where("state = 'ACTIVE'").groupBy("record_id", "tier").agg(F.min("parent").alias("cause"))
    return live.select("record_id", "cause", F.when(F.col("tier") == 3, "SYSTEM_1").otherwise("SYSTEM_2").alias("routing"))


def pending(events: DataFrame, routing: str | None = None, kind: str | None = None) -> DataFrame:
    """Queue items whose last event doesn't resolve them; an item that was put off is still pending."""
    last = events.groupBy("item_id").agg(F.max_by(F.struct("kind", "routing", "verdict", "record_id"), "seq").alias("e")).select("item_id", "e.*")
    out = last.where(F.coalesce(F.col("verdict"), F.lit("defer")) == "defer")
    if routing:
        out = out.where(F.col("routing") == routing)
    return out.where(F.col("kind") == kind) if kind else out


def evictable(records: DataFrame, dependents: DataFrame, queue_refs: DataFrame, now: Column, keep_days: int) -> DataFrame:
    """Archived or deleted records that nothing holds: no dependent to be derived anew, no pending item, a newer
    version, and older than ``keep_days``.

    ``records`` is (record_id, semantic_key, owner_seq, state, created_at).
    """
    newest = F.max("owner_seq").over(W.partitionBy("semantic_key"))
    old = (F.unix_micros(now) - F.unix_micros("created_at")) > F.lit(keep_days * 86_400_000_000)
    cand = records.withColumn("_newest", newest).where(F.col("state").isin("ARCHIVED", "DELETED") & (F.col("_newest") > F.col("owner_seq")) & old).drop("_newest")
    waiting = dependents.join(records.where("state = 'TBD'").select(F.col("record_id").alias("child")), "child", "left_semi").select(F.col("parent").alias("record_id"))
    return cand.join(waiting, "record_id", "left_anti").join(queue_refs.select("record_id"), "record_id", "left_anti")


def sweep(candidates: DataFrame, batch: int = 100) -> DataFrame:
    """The next records to evict: archived ones before deleted ones, the oldest first."""
    return candidates.orderBy(F.col("state") != "ARCHIVED", "created_at", "record_id").limit(batch)


def revert_plan(records: DataFrame, touched: DataFrame) -> DataFrame:
    """(semantic_key, from_id, to_id): for each key that ``touched`` (semantic_key, owner_seq) names, the last version
    before the earliest touched one; keys without one are left out."""
    first = touched.groupBy("semantic_key").agg(F.min("owner_seq").alias("first"))
    met = records.join(first, "semantic_key")
    plan = met.groupBy("semantic_key").agg(
        F.max_by("record_id", F.when(F.col("owner_seq") < F.col("first"), F.col("owner_seq"))).alias("to_id"), F.max_by("record_id", "owner_seq").alias("from_id")
    )
    return plan.where("to_id is not null").select("semantic_key", "from_id", "to_id")


def revert_fault(target: Column, key: Column, asked_key: Column, state: Column, age_days: Column, keep_days: int, tier: Column, actor: Column) -> Column:
    """The first reason why a record can't become the head again (null: it can)."""
    return (
        F.when(target.isNull(), "unknown record").when(key != asked_key, "other key")
        .when(~F.coalesce(state, F.lit("ARCHIVED")).isin("ARCHIVED", "DELETED"), "not archived").when(age_days > keep_days, "past retention")
        .when((tier <= 2) & (actor != "SYSTEM_2"), "needs SYSTEM_2")
    )


def plan_outcomes(frontier: DataFrame, head_table: DataFrame, dependencies: DataFrame, replanned: bool = False) -> DataFrame:
    """(root, outcome): whether plans still rest on the authorised versions.

    ``dependencies`` (root, semantic_key) says what each plan needs, ``frontier`` (root, semantic_key,
    record_id) what it was derived from, and ``head_table`` (semantic_key, record_id) what holds.  A missing
    head or version, or another one, means a new plan, and a block if this is one.
    """
    d = dependencies.select("root", "semantic_key").distinct()
    met = d.join(frontier.withColumnRenamed("record_id", "used"), ["root", "semantic_key"], "left").join(head_table.select("semantic_key", F.col("record_id").alias("held")), "semantic_key", "left")
    stale = F.max((~F.coalesce(F.col("used") == F.col("held"), F.lit(False))).cast("int"))
    return met.groupBy("root").agg(stale.alias("stale")).select("root", F.when(F.col("stale") == 0, "AUTHORIZED").otherwise("BLOCKED" if replanned else "REPLAN_REQUIRED").alias("outcome"))


def plan_checks(frontier: DataFrame, head_table: DataFrame, dependencies: DataFrame, reached: DataFrame, replanned: bool = False) -> DataFrame:
    """(root, outcome, reason, stale): the whole check of plans, with the test that they derive from what they say they used.

    As :func:`plan_outcomes`, and ``reached`` (root, node) is the closure of the lineage.  The first of these decides: a dependency
    without a version in the frontier and one without a head block the plan; another version than the head's (``stale`` lists
    the keys), or a version that the root doesn't reach, asks for a new plan, and blocks it if this is one.
    """
    d = dependencies.select("root", "semantic_key").distinct()
    met = d.join(frontier.select("root", "semantic_key", F.col("record_id").alias("used")), ["root", "semantic_key"], "left").join(head_table.select("semantic_key", F.col("record_id").alias("held")), "semantic_key", "left")
    met = met.join(reached.select("root", F.col("node").alias("used"), F.lit(True).alias("derives")).distinct(), ["root", "used"], "left")
    keys = lambda when: F.array_sort(F.collect_set(F.when(when, F.col("semantic_key"))))  # noqa: E731  a plan's own dependencies
    by_root = met.groupBy("root").agg(
        keys(F.col("used").isNull()).alias("lost"), keys(F.col("held").isNull()).alias("headless"),
        keys(F.col("used") != F.col("held")).alias("stale"), F.bool_and(F.coalesce("derives", F.lit(False))).alias("derives"),
    )
    again, some = F.lit("BLOCKED" if replanned else "REPLAN_REQUIRED"), lambda c: F.size(c) > 0
    outcome = F.when(some("lost") | some("headless"), "BLOCKED").when(some("stale") | ~F.col("derives"), again).otherwise("AUTHORIZED")
    reason = F.when(some("lost"), "incomplete lineage").when(some("headless"), "no head").when(some("stale"), "stale dependencies").when(~F.col("derives"), "does not derive").otherwise("validated")
    return by_root.select("root", outcome.alias("outcome"), reason.alias("reason"), "stale")


def replan(root: str, validate, recompute) -> tuple[str, str]:
    """(root, outcome) of a plan that may be computed anew once.

    ``validate(root, replanned)`` gives an outcome and ``recompute(root)`` a new root.
    """
    outcome = validate(root, False)
    if outcome != "REPLAN_REQUIRED":
        return root, outcome
    new = recompute(root)
    return new, validate(new, True)
