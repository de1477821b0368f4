"""SimHash near-duplicates, found in an embedding of segment bit counts.

A 64-bit fingerprint is cut into segments of two bits and mapped to the vector of the segments' bit
counts.  The Manhattan distance of two such vectors is never above the Hamming distance of the
fingerprints, so a range join over the vectors finds every link, and the exact distance decides.

The grid: the segments fall into six groups.  Vectors at most two apart differ in two groups at
most and agree in at least four, so the cells are the vectors' values on the fifteen choices of four groups; two
fingerprints that link meet in at least one of the fifteen.  A cell holds two thirds of the segments, so that
fingerprints that have nothing in common share one with a probability of one in a thousand million.  The join
compares whole vectors (the lower bound) and then fingerprints inside its condition, so that only links leave it,
each once: from the first of the cells in which both meet.

Equal fingerprints are merged before the join, so that thousands of copies are one point.

With a ``similarity`` (the pipeline's stage: 0.8 over five-word shingles) :func:`keep_one` links by the
Jaccard similarity of the sets of shingles instead, in two steps that each end in the exact similarity of two sets (of 64-bit hashes).
First the method above: each set has its fingerprint, the grid finds those at most two bits apart, and each set meets one that is
near (:func:`by_prints`).  Two bits don't reach every pair of similarity 0.8, whose fingerprints differ in about ten, so
what that step has not put together goes on to bands: 24 of five min-hashes, and sets of different components meet that share one
band's.  A pair of similarity s meets there with probability 1 - (1 - s^5)^24, 0.99993 at 0.8.

Here too a popcount is a lower bound: each set has a bitmap of 512 bits in which every shingle flips one, and two
sets differ in at least as many shingles as their bitmaps do in bits.  Of what fingerprints left apart each set first meets one other,
the head of one of its bands' cells: in the first turn the set that shares most cells with others, which for edited
copies of one text is that text, in the next one a random set.  What a component holds together already is passed
over from then on, and of the rest those pairs of a cell come out of its join whose sizes and bitmaps leave a
similarity of 0.8 possible (:func:`similar`).  No pair is lost, and those that come out are few, so that a group of m
near copies costs a multiple of m in rows; within the join of a cell whose sets aren't all linked, pairs of
bitmaps are still compared one by one.

Defined cases: a null or empty text, or one without words, has the fingerprint zero and links like
any other; a text of one or two words has one shingle, all its words; repeated rows and rows that
share a doc_id get a row each; a null doc_id is in its component but never its name unless all are
null; an empty table gives an empty result; other columns are ignored by :func:`group` and passed
through by :func:`keep_one`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import checkpointed, fresh, needs_stored, packed
from factloom.llm.components import components

SEED = 42
RADIUS = 2
SHINGLE = 3
#: Fixed masks: the lower bit of each two-bit segment.
LOW = 0x5555555555555555
#: Where the grid's groups of segments begin and end.
GROUPS = (0, 5, 11, 16, 21, 27, 32)
#: Bands of min-hashes, and min-hashes of a band, for links by similarity.
BANDS = 24
WIDTH = 5
#: Turns in which a set meets one other.
TURNS = 2
#: Up to so many sets that are linked to others, their roots are broadcast; more meet the cells through a shuffle.
BROADCAST_ROWS = 100_000
#: The words of 64 bits of a set's bitmap.
WORDS = 8


def _shingles(text: bytes | None, shingle: int):
    """The hashes of a text's (UTF-8) shingles, repeats included."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64, max(1, len(words) - shingle + 1))


def _fingerprint(hashes) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit integer; zero for none."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bits of a slice at a time: memory stays small for very long texts
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(raw: list[bytes | None], shingle: int):
    """The fingerprint of each text (UTF-8), as a signed 64-bit integer."""
    import numpy as np

    return np.array([_fingerprint(_shingles(text, shingle)) for text in raw], np.int64)


def _hashes(text: bytes | None, shingle: int):
    """The distinct hashes of a text's shingles, in order."""
    import numpy as np

    return np.unique(_shingles(text, shingle))


def _bands(hashes):
    """A 64-bit hash of the min-hashes of each band; none for an empty set."""
    import numpy as np
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return np.zeros(0, np.int64)
    draw = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 63, (2, BANDS * WIDTH), np.uint64)
    flip, factor = draw[0], draw[1] << np.uint64(1) | np.uint64(1)
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        np.minimum(least, ((hashes[at : at + (1 << 12), None] ^ flip) * factor).min(0), out=least)
    return np.array([xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, WIDTH))], np.uint64).view(np.int64)


def _bitmap(hashes):
    """A bitmap in which each hash flips one bit."""
    import numpy as np

    odd = np.bincount((hashes >> np.uint64(20) & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def shingle_sets(rows: DataFrame, shingle: int, bands: bool) -> DataFrame:
    """doc_id and row of ``rows`` (doc_id, row, text), with ``f``, a 128-bit hash of the set of shingles, its fingerprint ``s``, the
    set's size ``n``, its bands' hashes ``bands`` and its bitmap ``bits``; or else row and the set itself as ``hashes``."""
    keep = ["doc_id", "row"] if bands else ["row"]
    table = rows.select(*keep, F.col("text").cast("string").cast("binary").alias("text"))
    longs = T.ArrayType(T.LongType())
    more = [("f", T.BinaryType()), ("s", T.LongType()), ("n", T.LongType()), ("bands", longs), ("bits", longs)] if bands else [("hashes", longs)]
    names = [*keep, *(n for n, _ in more)]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh128_digest

        def lists(parts):
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))

        for batch in batches:
            sets = [_hashes(t, shingle) for t in batch.column("text").to_pylist()]
            kept = [batch.column(c) for c in keep]
            if bands:
                found = [pa.array([xxh128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(list(map(_fingerprint, sets)), pa.int64()), pa.array(list(map(len, sets)), pa.int64()), lists([_bands(s) for s in sets]), lists([_bitmap(s) for s in sets])]
            else:
                found = [lists([s.view(np.int64) for s in sets])]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=names)

    return table.mapInArrow(run, T.StructType([*(f for f in table.schema if f.name != "text"), *(T.StructField(*x) for x in more)]))


def _rooted(cells: DataFrame, roots: DataFrame, few: bool) -> DataFrame:
    """``cells`` (id, cell, ...) with each id's ``root``, only those with several roots; a ``few`` roots are broadcast."""
    known = cells.join((F.broadcast(roots) if few else roots).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = known.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("cell")
    return checkpointed(known.join(mixed, "cell", "left_semi"))


def by_prints(points: DataFrame) -> DataFrame:
    """Pairs (u, v) of ids of the sets ``points`` (id, s) whose fingerprints ``s`` are at most two bits apart, u < v.

    One for each set that is not the least of its fingerprint, with the least, and one for each fingerprint with others
    near it, with the smallest of these: m sets make at most m pairs, and each set that has a near one is in a pair.
    """
    prints = checkpointed(points.groupBy("s").agg(F.min("id").alias("head"), F.count("*").alias("c")))
    several = prints.where("c > 1").select("s", "head")
    same = salted_join(points.select("id", "s"), several, "s").where(F.col("id") > F.col("head")).select(F.col("head").alias("u"), F.col("id").alias("v"))
    found = links(prints.select(F.col("s").alias("f")))
    both = found.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    near = both.groupBy("v").agg(F.min("u").alias("u"))
    of = lambda x: prints.select(F.col("s").alias(x), F.col("head").alias(f"of_{x}"))
    apart = near.join(of("u"), "u").join(of("v"), "v").select(F.least("of_u", "of_v").alias("u"), F.greatest("of_u", "of_v").alias("v")).distinct()
    return same.unionByName(apart)


def _possible(a: str, b: str, similarity: float) -> Column:
    """Whether two sets with sizes ``n`` and bitmaps ``bits`` may be so similar: they differ in no more than a share of all."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    apart = sum((F.bit_count(F.get(F.col(f"{a}bits"), i).bitwiseXOR(F.get(F.col(f"{b}bits"), i))) for i in range(1, WORDS)), F.bit_count(F.get(F.col(f"{a}bits"), 0).bitwiseXOR(F.get(F.col(f"{b}bits"), 0))))
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6) & ((1 + similarity) * apart <= (1 - similarity) * (n + m) + 1e-6)


def similar(points: DataFrame, sets_of, similarity: float, turns: int = TURNS) -> DataFrame:
    """(node, root) of the sets ``points`` (id, s, n, bands, bits) that link to any other, by exact similarity.

    ``sets_of`` gives the table (row, hashes) of the ids in a table (row), of which there are no more than a number.
    """

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = checkpointed(pairs)
        n = pairs.count()
        pairs = packed(pairs, n)
        sets = checkpointed(sets_of(pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct(), 2 * n))
        first, second = (sets.select(F.col("row").alias(x), F.col("hashes").alias(f"of_{x}")) for x in "uv")
        both = F.size(F.array_intersect("of_u", "of_v"))
        near = both >= F.lit(similarity) * (F.size("of_u") + F.size("of_v") - both)
        return pairs.join(first, "u").join(second, "v").where(near).select("u", "v")

    def merged(edges: DataFrame) -> tuple[DataFrame, bool]:
        roots = checkpointed(components(edges))
        n = roots.count()
        return packed(roots, n), n <= BROADCAST_ROWS

    roots, few = merged(linked(by_prints(points)))
    cells = points.select("id", F.explode("bands").alias("cell"))
    cells = checkpointed(cells.join(cells.groupBy("cell").agg(F.count("*").alias("c")).where("c > 1"), "cell"))
    degrees = cells.groupBy("id").agg(F.sum("c").alias("degree")).join(points.select("id", "n", "bits"), "id")
    cells = checkpointed(cells.join(degrees, "id").select("id", "n", "bits", "degree", "cell"))
    for turn in range(turns + 1):
        known = _rooted(cells, roots, few)
        if not known.select("id").take(1):
            break
        cells = known.drop("root")  # the sets of a cell with one root will always have one
        if turn < turns:
            rank = F.struct(F.when(F.lit(turn == 0), F.col("degree")).otherwise(F.xxhash64(F.lit(turn), "root")).alias("a"), F.xxhash64(F.lit(turn), "id").alias("b"), "id", "n", "root", "bits")
            heads = known.groupBy("cell").agg(F.max(rank).alias("head"))
            met = known.join(heads, "cell").where((F.col("root") != F.col("head.root")) & _possible("", "head.", similarity))
            best = met.groupBy("id").agg(F.max(F.struct("head.a", "head.b", "head.id")).alias("head"))
            pairs = best.select(F.least("id", "head.id").alias("u"), F.greatest("id", "head.id").alias("v"))
        else:
            a, b = known.alias("a"), known.alias("b")
            met = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.root") != F.col("b.root")) & _possible("a.", "b.", similarity))
            pairs = met.select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()
        # a component's links so far are those to its root
        roots, few = merged(linked(pairs).unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    return roots


def fingerprint(docs: DataFrame, keep: list[str], name: str, shingle: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` of ``docs`` and each row's fingerprint as the long column ``name``."""
    text = fresh(docs, "_text")
    table = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").cast("binary").alias(text))
    schema = T.StructType([*(f for f in table.schema if f.name != text), T.StructField(name, T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = _fingerprints(batch.column(text).to_pylist(), shingle)
            kept = [batch.column(i) for i, f in enumerate(batch.schema.names) if f != text]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found)], names=[*(f for f in batch.schema.names if f != text), name])

    return table.mapInArrow(run, schema)


def _pairs_of_two(x: Column) -> Column:
    """For each two-bit segment its bit count, in place (0 to 2)."""
    low, high = x.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(LOW))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _manhattan(a: Column, b: Column) -> Column:
    """Sum over the two-bit segments of the difference of their counts, from packed counts.

    Counts 0, 1, 2 are packed as 00, 01, 10.  Re-coded as thermometers (00, 01, 11) their Manhattan
    distance is the number of differing bits.
    """

    def thermometer(c: Column) -> Column:
        return c.bitwiseOR(F.shiftrightunsigned(c, 1).bitwiseAND(F.lit(LOW)))

    return F.bit_count(thermometer(a).bitwiseXOR(thermometer(b)))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) for all pairs of the distinct fingerprints ``prints`` (f) at most two bits apart, u < v."""
    if not 0 <= radius <= 2:
        raise ValueError("the groups of the grid prove links of up to two bits")
    counted = prints.select("f", _pairs_of_two(F.col("f")).alias("c"))
    masks = [(1 << 2 * b) - (1 << 2 * a) for a, b in zip(GROUPS, GROUPS[1:])]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    pairs = [signed(sum(four)) for four in combinations(masks, len(masks) - 2)]

    def cells(c: Column) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("k"), c.bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(pairs)])

    placed = counted.select("f", "c", F.inline(cells(F.col("c"))))
    a, b = placed.alias("a"), placed.alias("b")
    agree = lambda m: F.col("a.c").bitwiseAND(F.lit(m)) == F.col("b.c").bitwiseAND(F.lit(m))
    first = F.coalesce(*[F.when(agree(m), F.lit(k)) for k, m in enumerate(pairs)])
    near = (
        (F.col("a.k") == F.col("b.k"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.f") < F.col("b.f"))
        & (_manhattan(F.col("a.c"), F.col("b.c")) <= radius)
        & (F.bit_count(F.col("a.f").bitwiseXOR(F.col("b.f"))) <= radius)
        & (first == F.col("a.k"))
    )
    return a.join(b, near).select(F.col("a.f").alias("u"), F.col("b.f").alias("v"))


def _roots(points: DataFrame) -> DataFrame:
    """(f, root) of the distinct fingerprints ``points`` that link to any other."""
    return components(links(points.select("f"))).select(F.col("node").alias("f"), "root")


def group(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row of ``docs``.

    The component is named by the least doc_id in it.  Only doc_id and eight bytes of each row pass
    through shuffles; the rows join the table of fingerprints by the fingerprint's class, salted, so
    that a class with very many copies is spread over tasks.
    """
    rows = checkpointed(fingerprint(docs.select("doc_id", "text"), ["doc_id"], "f"))
    points = checkpointed(rows.groupBy("f").agg(F.min("doc_id").alias("least")))
    roots = _roots(points)
    named = points.join(roots, "f", "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(names, "root").select("f", "component_id")
    out = salted_join(rows, classes, "f")
    return out.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


def salted_join(rows: DataFrame, classes: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """``rows`` left-joined with ``classes``, one row for each ``key``: the few columns of the classes
    are repeated ``salts`` times, and the rows of one key are spread over as many tasks."""
    salt = fresh(rows, "_salt")
    spread = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    copies = classes.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return spread.join(copies, [key, salt], "left").drop(salt)


def keep_one(docs: DataFrame, broadcast_rows: int = 1_000_000, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """``docs`` without all but one document of each component: that with the least doc_id.

    Components are those of fingerprints at most two bits apart, or with a ``similarity`` those of sets of
    shingles at least so similar.  Of rows that repeat its doc_id, one stays; a component whose doc_ids are
    all null keeps one row.
    Rows are told apart by their number within the scan of ``docs``, so ``docs`` must come straight
    from stored files (as all stages here do); anything else is refused.  The rows that go are found from fingerprints alone;
    up to ``broadcast_rows`` of them (eight bytes each) are broadcast, so that no text is shuffled;
    beyond that they are joined through a shuffle.
    """
    needs_stored(docs)
    row, f = fresh(docs, "_row"), fresh(docs, "_f")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    if similarity is None:
        prints = checkpointed(fingerprint(numbered.select("doc_id", row, "text"), ["doc_id", row], f, shingle).select(F.col("doc_id"), F.col(row).alias("row"), F.col(f).alias("f")))
        points = checkpointed(prints.groupBy("f").agg(best.alias("best")))
        named = points.join(_roots(points), "f", "left").select("best", F.coalesce("root", "f").alias("root"))
    else:
        texts = numbered.select("doc_id", F.col(row).alias("row"), "text")
        prints = checkpointed(shingle_sets(texts, shingle, True))
        points = checkpointed(prints.groupBy("f").agg(best.alias("best"), F.min("row").alias("id"), F.any_value("s").alias("s"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("bits").alias("bits")))

        def sets_of(rows: DataFrame, most: int) -> DataFrame:
            wanted = texts.join(F.broadcast(rows) if most <= broadcast_rows else rows, "row", "left_semi")
            return shingle_sets(wanted, shingle, False)

        roots = similar(points, sets_of, similarity).select(F.col("node").alias("id"), "root")
        named = points.join(roots, "id", "left").select("best", F.coalesce("root", "id").alias("root"))
    kept = named.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    gone = checkpointed(prints.select("row").join(kept, "row", "left_anti")).select(F.col("row").alias(row))
    few = gone.count() <= broadcast_rows
    return numbered.join(F.broadcast(gone) if few else gone, row, "left_anti").drop(row)
