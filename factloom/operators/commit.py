"""What the gate's decisions write: versions, nodes, edges, heads, states, audit rows and queue items, as tables.

A batch is decided by a fold and then written at once, so that nothing has to be undone: every function
here takes tables and gives the rows that are to be appended.  Heads and states are views over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators import lifecycle
from factloom.operators.ordering import running_total


def missing_parents(drafts: DataFrame, known: DataFrame) -> DataFrame:
    """``drafts`` (draft_id, parent_ids, ...) with ``missing_parent``: the first parent that ``known`` (record_id) lacks."""
    cited = drafts.select("draft_id", F.posexplode("parent_ids").alias("at", "record_id"))
    lost = cited.join(known.select("record_id").distinct(), "record_id", "left_anti")
    first = lost.groupBy("draft_id").agg(F.min_by("record_id", "at").alias("missing_parent"))
    return drafts.join(first, "draft_id", "left")


def unknown_heads(drafts: DataFrame, heads: DataFrame, known: DataFrame) -> DataFrame:
    """``drafts`` with ``lost_head``: the record that their key's head names, if ``known`` (record_id) lacks it."""
    lost = heads.select("semantic_key", F.col("record_id").alias("lost_head")).join(known.select(F.col("record_id").alias("lost_head")), "lost_head", "left_anti")
    return drafts.join(lost, "semantic_key", "left")


def versions(folded: DataFrame) -> DataFrame:
    """The committed drafts of a fold with record_id, prev_id (the version that each takes the place of) and record_type.

    ``folded`` has draft_id, parent_ids, semantic_key, arrival, owner_seq and disposition; a draft with parents is derived.
    """
    order = W.partitionBy("semantic_key").orderBy("owner_seq")
    done = folded.where("disposition = 'AUTO_COMMIT'").withColumn("record_id", F.concat(F.lit("rec_"), "draft_id"))
    kind = F.when(F.size(F.coalesce("parent_ids", F.array().cast("array<string>"))) > 0, "derived").otherwise("asserted")
    return done.withColumns({"prev_id": F.lag("record_id").over(order), "record_type": kind})


def edges(committed: DataFrame) -> DataFrame:
    """(src, dst, kind, seq) of committed versions (record_id, prev_id, parent_ids, subject_ref, object_ref, arrival).

    A version supersedes the one before, derives from its parents, and points at its subject and object, so far
    as they are known.
    """

    def edge(dst: Column, kind: str) -> Column:
        return F.when(dst.isNotNull(), F.struct(dst.alias("dst"), F.lit(kind).alias("kind")))

    fixed = F.array(edge(F.col("prev_id"), "SUPERSEDES"), edge(F.col("subject_ref"), "SUBJECT"), edge(F.col("object_ref"), "OBJECT"))
    parents = F.transform(F.array_distinct(F.coalesce("parent_ids", F.array().cast("array<string>"))), lambda p: edge(p, "DERIVED_FROM"))
    all_ = F.filter(F.concat(fixed, parents), lambda e: e.isNotNull())
    return committed.select(F.col("record_id").alias("src"), F.inline(all_), F.col("arrival").alias("seq")).select("src", "dst", "kind", "seq")


def entities(committed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, clashes) of the versions' refs: (entity, label, entity_type) with the first label and the first type
    that isn't blank, and those entities whose name is a record's."""
    end = lambda side: F.struct(F.col(f"{side}_ref").alias("entity"), F.col(f"{side}_label").alias("label"), F.nullif(F.trim(f"{side}_type"), F.lit("")).alias("entity_type"), F.col("arrival").alias("seq"))
    ends = committed.select(F.inline(F.array(end("subject"), end("object")))).where("entity is not null")
    known = ends.groupBy("entity").agg(F.min_by("label", "seq").alias("label"), F.min_by("entity_type", F.when(F.col("entity_type").isNotNull(), F.col("seq"))).alias("entity_type"))
    records = committed.select(F.col("record_id").alias("entity"))
    return known.join(records, "entity", "left_anti"), known.join(records, "entity", "left_semi").select("entity")


def materialised(edge_table: DataFrame, nodes: DataFrame) -> DataFrame:
    """(record_id, state): parents that edges (dst, kind) name and ``nodes`` (record_id) lacks, to be added as archived."""
    parents = edge_table.where("kind = 'DERIVED_FROM'").select(F.col("dst").alias("record_id")).distinct()
    return parents.join(nodes.select("record_id"), "record_id", "left_anti").withColumn("state", F.lit("ARCHIVED"))


def audit(committed: DataFrame) -> DataFrame:
    """(node_id, from_state, to_state, reason, seq): a version becomes active, and archives the one before it."""
    row = lambda node, before, after, why, seq: F.struct(node.alias("node_id"), F.lit(before).cast("string").alias("from_state"), F.lit(after).alias("to_state"), why.alias("reason"), seq.alias("seq"))
    born = row(F.col("record_id"), None, "ACTIVE", F.lit("commit"), 2 * F.col("arrival"))
    gone = F.when(F.col("prev_id").isNotNull(), row(F.col("prev_id"), "ACTIVE", "ARCHIVED", F.concat(F.lit("superseded by "), "record_id"), 2 * F.col("arrival") + 1))
    return committed.select(F.inline(F.filter(F.array(born, gone), lambda x: x.isNotNull())))


def queue_items(folded: DataFrame) -> DataFrame:
    """(item_id, kind, routing, semantic_key, active_id, draft_id) of what a fold could not decide by itself.

    ``folded`` has head_arrival, from which ``active_id`` is the head that a draft was judged against.
    """
    kind = F.when(F.col("disposition") == "QUEUE_SYSTEM_2", "SUPERSESSION_REVIEW").when(F.col("disposition") == "FLAG_CONTRADICTION", "CONTRADICTION").when(F.col("disposition") == "REJECT_FAIL_CLOSED", "DEAD_LETTER")
    heads = folded.select(F.col("semantic_key").alias("k"), F.col("arrival").alias("a"), F.concat(F.lit("rec_"), "draft_id").alias("active_id"))
    asked = folded.withColumn("kind", kind).where(F.col("kind").isNotNull())
    met = asked.join(heads, (F.col("semantic_key") == F.col("k")) & (F.col("head_arrival") == F.col("a")), "left")
    return met.select(F.concat(F.lit("item_"), "draft_id").alias("item_id"), "kind", F.lit("SYSTEM_2").alias("routing"), "semantic_key", "active_id", "draft_id")


def approve(items: DataFrame, approvals: DataFrame, heads: DataFrame) -> DataFrame:
    """(item_id, semantic_key, disposition, detail, record_id, prev_id, owner_seq) of approved reviews.

    ``approvals`` is (item_id, seq), ``heads`` (semantic_key, record_id, owner_seq).  A draft is committed on top of
    the head that it was queued against; if another one holds by now, or an earlier approval of the same
    batch has moved it, the item stays queued.
    """
    asked = items.where("kind = 'SUPERSESSION_REVIEW'").join(approvals.groupBy("item_id").agg(F.min("seq").alias("seq")), "item_id")
    h = heads.select("semantic_key", F.col("record_id").alias("held"), F.col("owner_seq").alias("held_seq"))
    met = asked.join(h, "semantic_key", "left").withColumn("same", F.coalesce(F.col("held") == F.col("active_id"), F.lit(False)))
    order = W.partitionBy("semantic_key", "same").orderBy("seq", "item_id")
    done = F.col("same") & (F.row_number().over(order) == 1)
    out = met.withColumn("done", done)
    only = lambda c: F.when(F.col("done"), c)
    return out.select(
        "item_id", "semantic_key", F.when(F.col("done"), "AUTO_COMMIT").otherwise("QUEUE_SYSTEM_2").alias("disposition"),
        F.when(F.col("done"), "SYSTEM_2 approved").otherwise("the head has moved").alias("detail"),
        only(F.concat(F.lit("rec_"), "draft_id")).alias("record_id"), only(F.col("active_id")).alias("prev_id"), only(F.col("held_seq") + 1).alias("owner_seq"),
    )


def decide(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(item_id, kind, routing, verdict, record_id, seq): queue events of ``verdicts`` (item_id, verdict, seq) on ``items``; an
    item that isn't there has none."""
    return verdicts.join(items.select("item_id", "kind", "routing", F.col("active_id").alias("record_id")), "item_id").select("item_id", "kind", "routing", "verdict", "record_id", "seq")


def revert(requests: DataFrame, records: DataFrame, states: DataFrame, heads: DataFrame, now: Column, keep_days: int) -> DataFrame:
    """(semantic_key, target_id, fault, moved, from_id, owner_seq): what becomes of requests to go back to a version.

    ``requests`` is (semantic_key, target_id, actor), ``records`` (record_id, semantic_key, tier, created_at), ``states``
    (record_id, state) and ``heads`` (semantic_key, record_id, owner_seq).  A request has the first fault
    of :func:`lifecycle.revert_fault`, or moves the head, whose number goes up by one; one for the record that is
    the head already moves nothing.
    """
    r = records.select(F.col("record_id").alias("target_id"), F.col("semantic_key").alias("own_key"), "tier", "created_at")
    met = requests.join(r, "target_id", "left").join(states.select(F.col("record_id").alias("target_id"), "state"), "target_id", "left")
    met = met.join(heads.select("semantic_key", F.col("record_id").alias("held"), F.col("owner_seq").alias("held_seq")), "semantic_key", "left")
    age = (F.unix_micros(now) - F.unix_micros("created_at")) / 86_400_000_000
    held = F.coalesce(F.col("held") == F.col("target_id"), F.lit(False)) & F.col("own_key").isNotNull()
    known = F.when(F.col("own_key").isNotNull(), F.col("target_id"))
    fault = lifecycle.revert_fault(known, F.col("own_key"), F.col("semantic_key"), F.col("state"), age, keep_days, F.col("tier"), F.col("actor"))
    out = met.withColumn("fault", fault).withColumn("moved", F.col("fault").isNull() & ~held)
    return out.select("semantic_key", "target_id", "fault", "moved", F.when(F.col("moved"), F.col("held")).alias("from_id"), F.when(F.col("moved"), F.coalesce(F.col("held_seq") + 1, F.lit(0))).alias("owner_seq"))


def revert_writes(outcomes: DataFrame, dependents: DataFrame, current: DataFrame) -> dict[str, DataFrame]:
    """The rows that moved requests write: ``heads``, ``states`` (node_id, to_state), ``edges`` and ``flagged`` dependents.

    ``dependents`` is (parent, child) and ``current`` (record_id, state, tier).
    """
    moved = outcomes.where("moved")
    swap = F.array(F.struct(F.col("target_id").alias("node_id"), F.lit("ACTIVE").alias("to_state")), F.when(F.col("from_id").isNotNull(), F.struct(F.col("from_id").alias("node_id"), F.lit("ARCHIVED").alias("to_state"))))
    left = moved.where("from_id is not null")
    return {
        "heads": moved.select("semantic_key", F.col("target_id").alias("record_id"), "owner_seq"),
        "states": moved.select(F.inline(F.filter(swap, lambda x: x.isNotNull()))),
        "edges": left.select(F.col("target_id").alias("src"), F.col("from_id").alias("dst"), F.lit("REVERTED_FROM").alias("kind")),
        "flagged": lifecycle.cascade(left.select(F.col("from_id").alias("record_id")), dependents, current),
    }


def revert_txn(records: DataFrame, txn: DataFrame, actor: str) -> DataFrame:
    """Requests of :func:`revert` that take back transactions (txn_id): each touched key to its last version before them."""
    touched = records.join(txn.select("txn_id").distinct(), "txn_id", "left_semi").select("semantic_key", "owner_seq")
    return lifecycle.revert_plan(records, touched).select("semantic_key", F.col("to_id").alias("target_id"), F.lit(actor).alias("actor"))


def swept(evicted: DataFrame) -> dict[str, DataFrame]:
    """The rows that evicted records (record_id, semantic_key, owner_seq, obj, state, txn_id) write: ``cold`` and ``audit``.

    The audit rows name the state that a record really had.
    """
    return {
        "cold": evicted.select("txn_id", "record_id", "semantic_key", "obj", "owner_seq"),
        "audit": evicted.select(F.col("record_id").alias("node_id"), F.col("state").alias("from_state"), F.lit("DELETED").alias("to_state"), F.lit("collected").alias("reason")),
    }


def lookup(keys: DataFrame, heads: DataFrame, records: DataFrame, states: DataFrame) -> DataFrame:
    """``keys`` (semantic_key) with their head's record_id, owner_seq, obj and state, and whether it was ``found``.

    A record that has no state has been evicted.
    """
    h = heads.select("semantic_key", "record_id", "owner_seq")
    known = keys.join(h, "semantic_key", "left").join(records.select("record_id", "obj"), "record_id", "left").join(states.select("record_id", "state"), "record_id", "left")
    state = F.when(F.col("record_id").isNotNull(), F.coalesce("state", F.lit("EVICTED")))
    return known.select("semantic_key", "record_id", "owner_seq", "obj", state.alias("state"), F.col("record_id").isNotNull().alias("found"))


def corroboration_so_far(relations: DataFrame) -> DataFrame:
    """``relations`` (subject, object, seq, ...) with ``corroboration``: the distinct subjects that pointed at the object before.

    A subject counts from its first relation on; sums run in ranges of seq, so that an object with very many relations is no single group.
    """
    first = F.row_number().over(W.partitionBy("object", "subject").orderBy("seq")) == 1
    own = relations.withColumn("_first", (first & (F.col("subject") != F.col("object"))).cast("long"))
    return running_total(own, "object", "seq", "_first", "_total").withColumn("corroboration", F.col("_total") - F.col("_first")).drop("_first", "_total")
