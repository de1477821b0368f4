"""Chat formatting, after collapsing logs of the same conversation at different lengths.

A log that records a conversation anew after each turn holds it many times over, each time a little
longer.  Every turn has a hash of its place, role and text, and every prefix of a conversation the
exclusive or of its turns' hashes, in 128 bits, as a running aggregate.  A conversation goes if its
whole hash is the hash of a proper prefix of another; of equal conversations the one with the least
conv_id stays.  What stays is rendered.

Everything is built from Spark SQL functions.  Hashes are compared without texts; prefixes and
conversations are made distinct before they meet, so that a first turn or a whole conversation that
is logged very often is one row.  Texts are shuffled once, those of kept conversations only.

Defined cases: a null role or text counts as empty; rows of one conversation that agree in turn, role
and text are one turn; turns with the same number are in the order of role and text; a row with a null
conv_id is a conversation of one turn, whatever its number; an empty table gives an empty result; other columns
are ignored, whatever their names.  The turns of one conversation meet in one task, and a rendered conversation
is one value, so it must be smaller than 2 GB; that is some ten million turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import bind, checkpointed

#: What stands before a role, between role and text, and after a text.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, turn, role, text); ``part`` tells conversations apart that have no conv_id."""
    empty = F.lit("")
    role, text = F.coalesce(F.col("role").cast("string"), empty), F.coalesce(F.col("text").cast("string"), empty)
    none = F.col("conv_id").isNull()
    part = F.when(none, F.concat_ws("-", F.xxhash64(role, text).cast("string"), F.xxhash64(text, role).cast("string"))).otherwise("")
    return conversations.select("conv_id", part.alias("part"), F.when(~none, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, n, a, b, at): each conversation's length, and the hash (a, b) of its first ``at`` turns."""
    hashed = _turns(conversations).select("conv_id", "part", "turn", F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit("second"), "text", "role").alias("y")).distinct()
    order = W.partitionBy("conv_id", "part").orderBy("turn", "x", "y")
    placed = hashed.withColumn("at", F.row_number().over(order))
    so_far = W.partitionBy("conv_id", "part").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    return placed.select(
        "conv_id",
        "part",
        F.count("*").over(W.partitionBy("conv_id", "part")).alias("n"),
        "at",
        F.bit_xor(F.xxhash64("at", "x", "y")).over(so_far).alias("a"),
        F.bit_xor(F.xxhash64("y", "x", "at")).over(so_far).alias("b"),
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, n_copies) of the conversations that are no proper prefix of another, each once."""
    all_ = checkpointed(prefixes(conversations))
    name = F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "part")).alias("name")
    whole = all_.where("at = n").groupBy("n", "a", "b").agg(name, F.count("*").alias("n_copies")).select("n", "a", "b", "name.conv_id", "name.part", "n_copies")
    proper = all_.where("at < n").select(F.col("at").cast("long").alias("n"), "a", "b").distinct()
    return whole.join(proper, ["n", "a", "b"], "left_anti").select("conv_id", "part", F.col("n").alias("n_turns"), "n_copies")


def render(conversations: DataFrame, chosen: DataFrame, open_: str = OPEN, middle: str = MIDDLE, close: str = CLOSE) -> DataFrame:
    """``chosen`` (conv_id, part and more) with the conversation in chat format as ``rendered``.

    Markers in a text are broken up (``<|`` becomes ``< |``), so that no text can end its own turn.
    """
    safe = lambda x: F.replace(x, F.lit("<|"), F.lit("< |"))
    same = lambda x, other: x.eqNullSafe(other)
    ids = chosen.select(F.col("conv_id").alias("id"), F.col("part").alias("of"))
    turns = _turns(conversations)
    kept = turns.join(ids, turns["conv_id"].eqNullSafe(ids["id"]) & (turns["part"] == ids["of"]), "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    once = bind(F.col("turns"), lambda all_: F.filter(all_, lambda x, i: (i == 0) | ~same(x, F.get(all_, i - 1))))
    line = lambda x: F.concat(F.lit(open_), safe(x["role"]), F.lit(middle), safe(x["text"]), F.lit(close))
    texts = kept.groupBy("conv_id", "part").agg(listed.alias("turns")).select(F.col("conv_id").alias("id"), F.col("part").alias("of"), F.array_join(F.transform(once, line), "").alias("rendered"))
    return chosen.join(texts, chosen["conv_id"].eqNullSafe(texts["id"]) & (chosen["part"] == texts["of"]), "left").drop("id", "of")


def collapse(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and rendered of each maximal conversation."""
    return render(conversations, checkpointed(maximal(conversations))).drop("part")


ORACLE_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, CASE WHEN conv_id IS NULL THEN coalesce(role, '') || chr(0) || coalesce(text, '') ELSE '' END AS part, CASE WHEN conv_id IS NOT NULL THEN turn END AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, part, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS turns, count(*) AS n FROM t GROUP BY conv_id, part),
d AS (SELECT min(conv_id) AS conv_id, turns, n, count(*) AS copies FROM c GROUP BY turns, n),
k AS (SELECT turns, n, unnest(range(1, n)) AS upto FROM d),
p AS (SELECT DISTINCT turns[1:upto] AS turns FROM k),
kept AS (SELECT d.* FROM d ANTI JOIN p ON d.turns = p.turns)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, CAST(copies AS BIGINT) AS n_copies,
       list_aggregate(list_transform(turns, lambda x: '{OPEN}' || replace(x.role, '<|', '< |') || chr(10) || replace(x.text, '<|', '< |') || '<|im_end|>' || chr(10)), 'string_agg', '') AS rendered
FROM kept
"""
