"""Closed sets of values and the tables' types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TIERS = (0, 1, 2, 3, 4)
STATES = ("ACTIVE", "TBD", "FLAGGED", "ARCHIVED", "DELETED")
DELTAS = ("IDENTICAL", "REFINEMENT", "SUPERSEDING_CHANGE", "CONTRADICTION")
DISPOSITIONS = ("NO_OP", "AUTO_COMMIT", "QUEUE_SYSTEM_2", "FLAG_CONTRADICTION", "REJECT_FAIL_CLOSED")
PRECEDENCES = ("SUPERSEDE", "REJECT", "COEXIST")
EDGE_KINDS = ("DERIVED_FROM", "SUPERSEDES", "REVERTED_FROM", "SUBJECT", "OBJECT")
QUEUE_KINDS = ("SUPERSESSION_REVIEW", "CONTRADICTION", "REDERIVE", "DEAD_LETTER")
RECENCIES = ("CURRENT", "CURRENT_STALE", "PAST")

#: The states that a record may go to from each state.
TRANSITIONS = {
    "ACTIVE": ("ARCHIVED", "FLAGGED", "TBD", "DELETED"),
    "TBD": ("ACTIVE", "FLAGGED", "ARCHIVED", "DELETED"),
    "FLAGGED": ("ACTIVE", "ARCHIVED", "DELETED"),
    "ARCHIVED": ("ACTIVE", "DELETED"),
    "DELETED": ("ACTIVE",),
}

DRAFT = "semantic_key string, predicate string, obj string, tier int, auto_update boolean, valid_from timestamp, source_id string, subject string, arrival long, delta string"
RECORD = (
    "record_id string, semantic_key string, predicate string, obj string, parent_ids array<string>, owner string, owner_seq long, tier int, auto_update boolean, "
    "record_type string, valid_from timestamp, created_at timestamp, source_id string, raw_citation string, txn_id string, subject_ref string, object_ref string, "
    "cardinality string, provenance map<string,string>"
)
AUDIT = "node_id string, from_state string, to_state string, actor string, txn_id string, reason string, seq long"
QUEUE = "item_id string, kind string, routing string, payload map<string,string>, resolved boolean, seq long"
EMR = "patient_id string, description string, emr_documents array<struct<doc_id:string,timestamp:string,author_role:string,document_type:string,content:string>>"


def transitions(spark: SparkSession) -> DataFrame:
    """(from_state, to_state) of all allowed changes."""
    return spark.createDataFrame([(a, b) for a, to in TRANSITIONS.items() for b in to], "from_state string, to_state string")
