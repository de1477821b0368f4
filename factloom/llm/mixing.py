"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source gets a target number of words: its weight's share of all words, but never more than
three times what it has; what is cut off goes to the other sources by weight.  A source's documents
are dealt into blocks by a hash of what they are, and the blocks are permuted anew for each pass over the
source.  The quota of a source is an exact number of blocks: all blocks once for each whole pass, and the
first ones of one more permutation for the rest, the part pass.  In the part pass documents of more than a
sixteenth of the rest are passed over, and of the last block those documents are taken that come first.
What is missing then is filled from all documents left, the largest that fit first, until it is below the
least of them, and by the one further document that brings the source nearer to its target
(:func:`_filled`); these go to shards by hash.

Output shards get their blocks from a tree.  At the root stands the vector of all quotas; a node
hands its left child half of its blocks, drawn without replacement, so that the child's vector is
multivariate hypergeometric, and its right child the rest.  A leaf is a shard: it takes the next
blocks of each source's permutation, as many as its vector says, so that shards are disjoint and
together use up every quota exactly.  Inside a shard documents are in the order of a keyed hash.
The number of shards follows the number of words, that of blocks the number of shards.

Everything is built from Spark SQL functions, and all draws are functions of the seed and of hashes of
doc_id, source and text: how the input is split over files or tasks changes nothing.  Prefix sums
run over a source's blocks or over the documents of one block; both are spread over many tasks, however large
a source is.  The vector of quotas has an entry for each source and is handled as one value, so sources must
be few against documents (a million of them are 16 MB).

Defined cases: a null or empty text has size 0 and is in every pass like any other; a null source is
a source of its own, the last; rows that share a doc_id are documents of their own; rows that are equal
in doc_id, source and text share a block, and which of them is taken can't be told; an empty table gives
an empty mix; a source without words has the target 0; other columns pass through :func:`mix` whatever their
names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import SPACES, bind, checkpointed, fresh, needs_stored, whole_text

WEIGHTS = (5, 2, 1)
CAP = 3
#: Blocks of a source at least, and for each shard; shards at least, and the words of one.
BLOCKS, BLOCKS_A_SHARD = 4096, 64
SHARDS, WORDS_A_SHARD = 16, 1 << 24
#: The part pass passes over documents of more than this part of what it is to take.
SMALL = 16
#: Nodes of the tree from which on they are spread over tasks.
WIDE = 4096
#: Up to so many rows of a few numbers are broadcast; more are joined through a shuffle.
BROADCAST_ROWS = 200_000
SEED = 7


def size(text: Column) -> Column:
    """The number of words in a text."""
    return F.size(F.regexp_extract_all(text, F.lit(f"[^{SPACES}]+"), F.lit(0))).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sources`` (source, source_size) with ``weight`` and ``target``.

    Handing excess on until no target is above its cap gives every uncapped source the same multiple
    of its weight.  Sources are capped in the order of cap / weight, so one pass in that order finds
    the multiple.  The table has a row for each source.
    """
    everything = W.partitionBy()
    by_code = W.partitionBy().orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_code) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighted = sources.withColumn("weight", w).withColumn("cap", (cap * F.col("source_size")).cast("double"))
    by_cap = W.partitionBy().orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("cap").over(everything) / cap - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = weighted.withColumn("level", left / weights_left)
    # the level holds from the first source on whose cap it doesn't exceed
    held = level.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", F.col("level").alias("level")))).over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return held.select("source", "source_size", "weight", target.alias("target"))


def _uniform(*keys) -> Column:
    """A number in [0, 1) from the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def _hypergeometric(good: Column, rest: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` draws without replacement, from ``good`` and ``rest`` items, are good.

    Inverts the distribution function at ``u``, over its values in the order mode, mode + 1, ...,
    mode - 1, ...; probabilities are carried relative to that of the mode, by the ratio of
    neighbouring ones, out to where they vanish in double precision.
    """

    def drawn(s: Column) -> Column:
        k, m, n, mode, reach = (s[x] for x in ("k", "m", "n", "mode", "reach"))
        up = lambda x: (k - x) * (n - x) / ((x + 1) * (m - n + x + 1))  # noqa: E731  P(x + 1) / P(x)
        high = F.least(F.least(k, n), mode + reach)
        low = F.greatest(F.greatest(n - m, F.lit(0.0)), mode - reach)

        def along(first: Column, steps: Column, ratio, start, visit) -> Column:
            return F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps.cast("int"))).otherwise(F.array().cast("array<int>")), start, visit(first, ratio))

        def weigh(first, ratio):
            return lambda a, i: bind(a["w"] * ratio(first, i), lambda w: F.struct(w.alias("w"), (a["t"] + w).alias("t")))

        upward = lambda first, i: up(first + i - 1)
        downward = lambda first, i: 1 / up(first - i)
        none = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("t"))
        total = 1 + along(mode, high - mode, upward, none, weigh)["t"] + along(mode, mode - low, downward, none, weigh)["t"]

        def walk(sign: int):
            def visit(first, ratio):
                return lambda a, i: bind(
                    a["w"] * ratio(first, i),
                    lambda w: F.struct(
                        w.alias("w"),
                        (a["t"] + w).alias("t"),
                        F.when(a["x"].isNull() & (a["t"] + w >= a["goal"]), first + sign * i).otherwise(a["x"]).alias("x"),
                        a["goal"].alias("goal"),
                    ),
                )

            return visit

        def found(goal: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("t"), F.when(goal <= 1, mode).alias("x"), goal.alias("goal"))
            above = along(mode, high - mode, upward, start, walk(1))
            return bind(above, lambda a: F.coalesce(along(mode, mode - low, downward, F.struct(F.lit(1.0).alias("w"), a["t"].alias("t"), a["x"].alias("x"), a["goal"].alias("goal")), walk(-1))["x"], mode))

        return bind(total * u, found)

    k, m, n = (x.cast("double") for x in (good, rest, draws))
    mode = F.least(F.least(k, n), F.greatest(F.greatest(n - m, F.lit(0.0)), F.floor((n + 1) * (k + 1) / (k + m + 2)).cast("double")))
    spread = F.sqrt(n * F.greatest(k * m, F.lit(1.0))) / F.greatest(k + m, F.lit(1.0))
    state = F.struct(k.alias("k"), m.alias("m"), n.alias("n"), mode.alias("mode"), F.ceil(40 * spread + 40).cast("double").alias("reach"))
    return F.when((good == 0) | (draws == 0), F.lit(0)).when(rest == 0, draws).otherwise(bind(state, drawn).cast("long"))


def _left(quotas: Column, node: Column, draws: Column, seed: int) -> Column:
    """The left child's vector: ``draws`` blocks drawn from the node's, one source after the other."""
    rest = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q["n"])
    start = F.struct(F.array().cast("array<bigint>").alias("out"), draws.cast("long").alias("draws"), rest.alias("rest"))

    def step(a: Column, q: Column) -> Column:
        others = a["rest"] - q["n"]
        one = _hypergeometric(q["n"], others, a["draws"], _uniform(F.lit(seed), node, q["id"]))
        return bind(one.cast("long"), lambda x: F.struct(F.concat(a["out"], F.array(x)).alias("out"), (a["draws"] - x).alias("draws"), others.alias("rest")))

    return F.aggregate(quotas, start, step, lambda a: a["out"])


def split(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(id, shard, n, offset): how many of each id's ``n`` blocks each shard gets, and from where on.

    ``quotas`` is (id, n), one row for each source; a node of the tree is one row with its vector.
    """
    if shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("id", F.col("n").cast("long").alias("n")))).alias("q")).select(F.lit(0).alias("shard"), "q")
    width = shards
    while width > 1:
        total = F.aggregate(F.col("q"), F.lit(0).cast("long"), lambda a, x: a + x["n"])
        left = _left(F.col("q"), F.struct(F.lit(width), F.col("shard")), F.floor(total / 2), seed)
        drawn = node.withColumn("left", left)
        part = lambda pick: F.transform(F.col("q"), lambda x, i: F.struct(x["id"].alias("id"), pick(x, F.get(F.col("left"), i)).alias("n")))
        halves = F.array(
            F.struct(F.col("shard").alias("shard"), part(lambda x, y: y).alias("q")),
            F.struct((F.col("shard") + width // 2).alias("shard"), part(lambda x, y: x["n"] - y).alias("q")),
        )
        node = drawn.select(F.inline(halves))
        width //= 2
        if shards // width == WIDE:
            node = checkpointed(node.repartition("shard"))
    leaves = node.select("shard", F.inline("q"))
    before = W.partitionBy("id").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return leaves.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _few(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is small enough; it has been written already, so that counting is cheap."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, blocks: int | None = None, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """Which documents the mix takes: row, doc_id, size, source_size, target and ``draws``, for each row.

    ``draws`` is an array of (pass, shard, at), one entry for each time the document is taken; ``at`` orders
    the documents of a shard.  ``row`` is the row's number within the scan of ``docs``.
    """
    parts = ("doc_id", "source", "text")
    key = F.xxhash64(F.lit(seed), *parts, *[F.col(c).isNull() for c in parts])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", key.alias("key"), size(whole_text()).alias("size"))
    rows = checkpointed(rows)
    sizes = checkpointed(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    if shards is None:
        words = sizes.agg(F.sum("source_size").alias("n")).first()["n"] or 0
        shards = max(SHARDS, 1 << max(0, (words - 1) // WORDS_A_SHARD).bit_length())
    blocks = blocks or max(BLOCKS, BLOCKS_A_SHARD * shards)
    whole = F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(cap)).cast("int")
    per_source = targets(sizes, weights, cap).select(
        F.col("source").alias("s"), "source_size", "target", whole.alias("whole"),
        F.when(whole >= cap, 0.0).otherwise(F.greatest(F.col("target") - whole * F.col("source_size"), F.lit(0.0))).alias("rest"),
        F.xxhash64(F.lit("source"), F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("id"),
    )
    per_source = checkpointed(per_source)
    bucket = F.pmod("key", F.lit(blocks)).cast("int")
    small = SMALL * F.col("size") <= F.col("rest")
    rows = rows.join(_few(per_source), F.col("source").eqNullSafe(F.col("s"))).withColumns({"bucket": bucket, "small": small}).drop("s", "source")
    sums = rows.groupBy("id", "bucket", "whole", "rest").agg(F.sum(F.when(F.col("small"), F.col("size")).otherwise(0)).alias("words"), F.count_if("small").alias("n_small"))
    # a source's blocks in the order of the part pass, with the words before each
    order = W.partitionBy("id").orderBy(F.xxhash64(F.lit(seed), F.lit("whole"), "bucket"), "bucket")
    room = F.col("rest") - F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kind = F.when((room <= 0) | (F.col("n_small") == 0), "none").when(room >= F.col("words"), "all").otherwise("part")
    placed = sums.select("id", "bucket", "whole", room.alias("room"), kind.alias("kind"), (F.row_number().over(order) - 1).alias("part_rank"), F.count("*").over(W.partitionBy("id")).alias("n_blocks"))
    placed = checkpointed(placed)
    # the tree shares out block instances: each whole pass has all blocks, the part pass the first ones
    passes = F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(F.array().cast("array<int>"))
    per_pass = placed.select("id", "bucket", "n_blocks", F.explode(passes).alias("pass"))
    ranked = per_pass.withColumn("rank", F.row_number().over(W.partitionBy("id", "pass").orderBy(F.xxhash64(F.lit(seed), "pass", "bucket"), "bucket")) - 1)
    last = placed.where("kind <> 'none'").withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("part_rank")) - 1).select("id", "bucket", "n_blocks", F.col("whole").alias("pass"), "rank")
    instances = ranked.select("id", "bucket", "n_blocks", "pass", "rank").unionByName(last).select("id", "bucket", "pass", (F.col("pass").cast("long") * F.col("n_blocks") + F.col("rank")).alias("at"))
    instances = checkpointed(instances)
    shares = split(instances.groupBy("id").agg(F.count("*").alias("n")), shards, seed)
    slots = shares.where("n > 0").select("id", "shard", F.explode(F.sequence(F.col("offset"), F.col("offset") + F.col("n") - 1)).alias("at"))
    dealt = instances.join(slots, ["id", "at"]).groupBy("id", "bucket").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("draws"))
    decided = placed.select("id", "bucket", "kind", "room").join(dealt, ["id", "bucket"], "left")
    met = checkpointed(rows.join(decided.hint("shuffle_hash"), ["id", "bucket"]).select("row", "doc_id", "key", "id", "bucket", "size", "source_size", "target", "whole", "small", "kind", "room", "draws"))
    # of a block that is taken in part the small documents, in the order of their hashes, while they fit; only these are sorted
    in_part = (F.col("kind") == "part") & F.col("small")
    inside = W.partitionBy("id", "bucket").orderBy(F.xxhash64(F.lit(seed), "key"), "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = met.where(in_part).withColumn("fits", F.sum("size").over(inside) <= F.col("room"))
    others = met.where(~in_part).withColumn("fits", (F.col("kind") == "all") & F.col("small"))
    draws = F.coalesce("draws", F.array().cast("array<struct<pass:int,shard:int>>"))
    chosen = cut.unionByName(others).withColumn("draws", F.when(F.col("fits"), draws).otherwise(F.filter(draws, lambda d: d["pass"] < F.col("whole"))))
    more = checkpointed(_filled(chosen.select("id", "row", "key", "bucket", "size", "target", "whole", "fits", "draws"), cap, shards, seed))
    added = F.array(F.struct(F.col("whole").alias("pass"), F.col("more").alias("shard")))
    both = F.when(F.col("more").isNull(), F.col("draws")).otherwise(F.concat("draws", added))
    at = lambda d: F.xxhash64(F.lit(seed), F.lit("at"), "key", d["pass"])
    listed = F.transform(both, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), at(d).alias("at")))
    return chosen.join(_few(more), "row", "left").select("row", "doc_id", "size", "source_size", "target", listed.alias("draws"))


def _filled(chosen: DataFrame, cap: int, shards: int, seed: int) -> DataFrame:
    """(row, more): the documents that fill what is missing of the targets after the part pass, and their shards.

    Each size, from the largest down, fills what it can, after which every document left is larger than what
    is missing; and the one nearest to it goes in if that brings the source nearer to its target.  Sizes are
    handled as counts, one row for each; of the documents of a size those with the least hashes are taken.
    """
    # documents that the part pass can still take, and what their sources miss
    left = chosen.where(~F.col("fits") & (F.col("whole") < cap)).select("id", "row", "key", "bucket", "size", F.xxhash64(F.lit(seed), F.lit("left"), "key").alias("h"))
    short = chosen.groupBy("id", "target").agg(F.sum(F.col("size") * F.size("draws")).alias("taken"))
    short = checkpointed(short.select("id", (F.col("target") - F.col("taken")).alias("missing")).where("missing > 0"))
    shard = F.pmod(F.xxhash64(F.lit(seed), F.lit("more"), "key"), F.lit(shards)).cast("int")
    fitting = left.join(_few(short), "id").where((F.col("size") > 0) & (F.col("size") <= F.col("missing")))
    counts = fitting.groupBy("id", "missing", "size").agg(F.count("*").alias("n"))
    counts = counts.groupBy("id", "missing").agg(F.sort_array(F.collect_list(F.struct("size", "n")), False).alias("sizes"))
    start = F.struct(F.col("missing").alias("m"), F.array().cast("array<struct<size:bigint,k:bigint>>").alias("out"))

    def fill(a: Column, x: Column) -> Column:
        k = F.least(x["n"], F.floor(a["m"] / x["size"])).cast("long")
        grown = F.when(k > 0, F.concat(a["out"], F.array(F.struct(x["size"].alias("size"), k.alias("k"))))).otherwise(a["out"])
        return F.struct((a["m"] - k * x["size"]).alias("m"), grown.alias("out"))

    picks = checkpointed(counts.select("id", F.inline(F.aggregate("sizes", start, fill, lambda a: a["out"]))))
    met = left.join(_few(picks), ["id", "size"])
    parts = W.partitionBy("id", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = met.groupBy("id", "size", "bucket").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(parts), F.lit(0))).drop("c")
    inside = W.partitionBy("id", "size", "bucket").orderBy("h", "row")
    first = met.join(sums, ["id", "size", "bucket"]).where("before < k").withColumn("at", F.col("before") + F.row_number().over(inside)).where("at <= k")
    first = checkpointed(first.select("id", "row", "key", "size"))
    filled = first.groupBy("id").agg(F.sum("size").alias("words"))
    still = checkpointed(short.join(filled, "id", "left").select("id", (F.col("missing") - F.coalesce("words", F.lit(0))).alias("missing")).where("missing > 0"))
    near = left.join(_few(still), "id").where((F.col("size") > 0) & (F.col("size") < 2 * F.col("missing"))).join(_few(first.select("row")), "row", "left_anti")
    last = near.groupBy("id").agg(F.min(F.struct(F.abs(F.col("missing") - F.col("size")).alias("off"), "h", "row", "key")).alias("best"))
    return first.select("row", "key").unionByName(last.select("best.row", "best.key")).select("row", shard.alias("more"))


def mix(docs: DataFrame, order: bool = False, shuffle: bool = False, **settings) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.

    With ``shuffle`` they come by shard, each shard in its own order, ready to be written; with ``order`` the
    columns _shard and _at say in which shard a row goes and where.  Rows are met by their number in a second
    scan of ``docs``, so ``docs`` must come straight from stored files; anything else is refused.
    """
    needs_stored(docs)
    row, draws = fresh(docs, "_row"), fresh(docs, "_draws")
    chosen = plan(docs, **settings).where(F.size("draws") > 0).select(F.col("row").alias(row), F.col("draws").alias(draws))
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    shard, at, one = (fresh(docs, n) for n in ("_shard", "_at", "_one"))
    each = numbered.join(chosen, row).withColumn(one, F.explode(draws))
    if not (order or shuffle):
        return each.drop(row, draws, one)
    placed = each.withColumns({shard: F.col(one)["shard"], at: F.col(one)["at"]}).drop(row, draws, one)
    if shuffle:
        placed = placed.repartition(F.col(shard)).sortWithinPartitions(shard, at)
    return placed if order else placed.drop(shard, at)
