"""Removal of passages that repeat across documents, word by word, by anchors at the places of a difference cover.

A window is a fixed number of consecutive words.  A difference cover of a period holds, for any two places, the same shift of
both into the cover, by less than the period.  So two equal windows share an anchor, a shorter run of words, that begins at a
place of the cover in both documents, and only those places are hashed: six of each 31 for windows of 50 words, with
anchors of 20.

An anchor extends by what stands around it.  Its context is the stretch of all windows that hold it.  Where the
context of an anchor is the same as in a smaller document, all of these windows are copies, which needs one comparison for
some eighty words.  An anchor that stands in different documents in different contexts, such as at the borders of a
passage, is open: the windows around it, and only those, are hashed in full, and the least document of each hash decides.
Where an anchor always stands in one context, nothing is open, so the inside of passages, of near copies
and of whole copies costs no windows.  Contexts and windows are compared by 128 bits.

Copies are settled within a batch of documents before anything is shuffled: of an anchor in one context only the least document
goes on.  An anchor that has several contexts in a batch is known to be open; its contexts are then dealt by anchor and context, and
the anchor itself tells this to the others once a batch.  So an anchor or context that very many documents share is a few rows a
batch.  Windows are settled among those that a task holds at once in the same way, so that of a window that very many documents share only
the least document's goes on.  Of texts only those with open anchors are shuffled, and those from which something goes; the keys of either are broadcast
up to a bound (:data:`BROADCAST_ROWS`), beyond which all texts are.

Defined cases: a null text has no words; a null doc_id is neither smaller nor greater than another, and keeps all its words; rows of one
doc_id don't remove from each other, and equal rows have equal results; white space is only ASCII's; texts of fewer words
than a window keep all; an empty table gives an empty result; other columns are kept as they are.  A text is worked on in slices, with eight bytes a word, and must be smaller than 2 GB.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import checkpointed, fresh, whole_text

WINDOW = 50
#: Sets of residues in which every difference modulo the period occurs.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
#: Bytes of text that are split at once, rows of hashes that are held at once, and words that a task remembers.
SLICE, ROWS, VOCABULARY = 1 << 20, 1 << 15, 1 << 20
COLD, WARM, FLAG, RUN = range(4)
#: Windows that a task settles among themselves at once, and keys up to which texts are parted by a broadcast.
HELD, BROADCAST_ROWS = 1 << 19, 4_000_000


def plan(window: int) -> tuple[int, int]:
    """(period, anchor): the largest period that leaves anchors of at least two fifths of the window."""
    period = max(p for p in COVERS if 5 * (window - p + 1) >= 2 * window)
    return period, window - period + 1


def split(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, slice by slice."""
    at = 0
    while len(text) - at > SLICE:
        end = at + SLICE
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end].split()
        at = end
    yield text[at:].split()


class Hasher:
    """Hashes of words, and of runs of words as sums of the words' hashes times keys."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def words(self, text: bytes):
        import numpy as np
        import xxhash

        def one(word: bytes) -> int:
            found = self.known.get(word)
            if found is None:
                if len(self.known) >= VOCABULARY:
                    self.known.clear()
                found = self.known[word] = xxhash.xxh64_intdigest(word)
            return found

        return np.concatenate([np.fromiter(map(one, part), np.uint64, len(part)) for part in split(text)])

    @staticmethod
    def keys(n: int, seed: int):
        import numpy as np
        import xxhash

        return np.array([xxhash.xxh64_intdigest(b"%d" % j, seed) | 1 for j in range(n)], np.uint64)

    @staticmethod
    def mixed(x):
        """The numbers (uint64) with their bits spread, as long."""
        import numpy as np

        with np.errstate(over="ignore"):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))).view(np.int64)

    @classmethod
    def runs(cls, hashes, starts, *spans: tuple[int, int, int]):
        """For each span (from, to, seed) the hash of the words from ``starts`` + from to ``starts`` + to."""
        import numpy as np

        longest, out = max(to for _, to, _ in spans), [np.empty(len(starts), np.uint64) for _ in spans]
        keys = [cls.keys(to - from_, seed) for from_, to, seed in spans]
        if len(starts):
            seen = np.lib.stride_tricks.sliding_window_view(hashes, longest)
            for i in range(0, len(starts), ROWS):
                part = seen[starts[i : i + ROWS]]
                for o, k, (from_, to, _) in zip(out, keys, spans):
                    o[i : i + ROWS] = part[:, from_:to] @ k
        return [cls.mixed(o) for o in out]


def _anchored(window: int):
    """Rows (k, c, d, th, at, kind) from batches (d, th, text): the anchors of each batch after its own copies are settled.

    For COLD rows ``k`` is the anchor, for WARM ones anchor and context, ``c`` the context, ``at`` the anchor's place; a FLAG says that the anchor ``k`` has
    several contexts; a RUN is a stretch from ``at`` to ``c`` that goes.
    """
    period, anchor = plan(window)
    cover, side = COVERS[period], period - 1

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        hasher = Hasher()
        for batch in batches:
            ids, hashes = batch.column("d").to_numpy(), batch.column("th").to_numpy()
            seen, docs, words, starts, places, lengths, size = set(), [], [np.zeros(side, np.uint64)], [], [], [], side
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                if (key := (ids[i], hashes[i])) in seen:
                    continue
                seen.add(key)
                h = hasher.words(text.as_buffer().to_pybytes())
                if len(h) < window:
                    continue
                blocks = np.arange(0, len(h) - anchor + 1, period)[:, None]
                at = (blocks + np.array(cover)).ravel()
                at = at[at <= len(h) - anchor]
                docs.append(i)
                lengths.append(len(at))
                places.append(at)
                starts.append(at + size - side)
                words += [h, np.zeros(side, np.uint64)]
                size += len(h) + side
            if not docs:
                continue
            at = np.concatenate(places)
            doc = np.repeat(np.array(docs), lengths)
            d, th = ids[doc], hashes[doc]
            a, c = Hasher.runs(np.concatenate(words), np.concatenate(starts), (side, side + anchor, 1), (0, 2 * side + anchor, 2))
            by = np.lexsort((d, c, a))
            a, c, d, th, at = a[by], c[by], d[by], th[by], at[by]
            new_a = np.append(True, a[1:] != a[:-1])
            new_c = new_a | np.append(True, c[1:] != c[:-1])
            class_ = np.cumsum(new_c) - 1
            settled = d > d[new_c][class_]  # sorted by document, so a context's first is its least
            group = np.cumsum(new_a) - 1
            first, last = np.flatnonzero(new_a), np.append(np.flatnonzero(new_a)[1:], len(a)) - 1
            many = (np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first)) & (class_[first] < class_[last])
            open_ = many[group]
            went = np.flatnonzero(settled)
            went = went[np.lexsort((at[went], th[went], d[went]))]
            cut = np.append(True, (d[went][1:] != d[went][:-1]) | (th[went][1:] != th[went][:-1]) | (at[went][1:] - side > at[went][:-1] + side + anchor)) if len(went) else np.zeros(0, bool)
            begin, end = went[cut], went[np.append(np.flatnonzero(cut)[1:], len(went)) - 1] if len(went) else went
            in_text = lambda x: x[np.argsort(by[x])]  # noqa: B023, E731  rows of one document next to each other take less room
            warm, cold, flags = in_text(np.flatnonzero(~settled & open_)), in_text(np.flatnonzero(~settled & ~open_)), first[many]
            spread = lambda x: Hasher.mixed(x.view(np.uint64))
            none = np.zeros(len(flags), np.int64)
            columns = [
                (a[cold], spread(a[warm] ^ spread(c[warm])), a[flags], spread(th[begin] ^ d[begin])),
                (c[cold], c[warm], none, at[end] + side + anchor),
                (d[cold], d[warm], none, d[begin]),
                (th[cold], th[warm], none, th[begin]),
                (at[cold], at[warm], none, np.maximum(at[begin] - side, 0)),
                tuple(np.full(n, kind) for n, kind in ((len(cold), COLD), (len(warm), WARM), (len(flags), FLAG), (len(begin), RUN))),
            ]
            arrays = [np.concatenate(x) for x in columns]
            yield pa.RecordBatch.from_arrays([*map(pa.array, arrays[:4]), *[pa.array(x.astype(np.int32)) for x in arrays[4:]]], names=["k", "c", "d", "th", "at", "kind"])

    return run


def anchors(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(d, th, runs, opens) from (d, th, text): for each document with any, the stretches (s, e) that go and the places of open anchors."""
    period, anchor = plan(window)
    side = period - 1
    rows = keyed.where("d is not null").select("d", "th", "text").mapInArrow(_anchored(window), "k long, c long, d long, th long, at int, kind int")
    kind = F.col("kind")
    of_key, of_class = W.partitionBy("k"), W.partitionBy("k", "kind", "c")
    cold = lambda x, f: f(F.when(kind == COLD, F.col(x))).over(of_key)
    several = (cold("d", F.min) < cold("d", F.max)) & (cold("c", F.min) < cold("c", F.max))
    flagged = F.max(F.when(kind == FLAG, 1)).over(of_key).isNotNull()
    met = rows.withColumn("open", (kind == WARM) | flagged | F.coalesce(several, F.lit(False))).withColumn("least", F.min("d").over(of_class))
    settled = (kind == RUN) | (F.col("d") > F.col("least"))
    start = F.when(kind == RUN, F.col("at")).otherwise(F.greatest(F.col("at") - side, F.lit(0)))
    end = F.when(kind == RUN, F.col("c").cast("int")).otherwise(F.col("at") + side + anchor)
    told = met.where((kind != FLAG) & (settled | F.col("open"))).select("d", "th", F.when(settled, F.struct(start.alias("s"), end.alias("e"))).alias("run"), F.when(~settled, F.col("at")).alias("open"))
    return told.groupBy("d", "th").agg(F.collect_list("run").alias("runs"), F.collect_list("open").alias("opens"))


def _windows(window: int):
    """Rows (h1, h2, d, th, at, to) from batches (d, th, text, opens): the windows around open anchors, with ``to`` zero, after copies among
    those that are held at once are settled; and stretches from ``at`` to ``to`` that go."""
    side = plan(window)[0] - 1

    def settled(parts: list[list]) -> Iterator:
        import numpy as np
        import pyarrow as pa

        h1, h2, d, th, at = map(np.concatenate, zip(*parts))
        by = np.lexsort((d, h2, h1))
        new = np.append(True, (h1[by][1:] != h1[by][:-1]) | (h2[by][1:] != h2[by][:-1]))
        more = d[by] > d[by][new][np.cumsum(new) - 1]  # sorted by document, so a window's first is its least
        went = by[more]
        went = went[np.lexsort((at[went], th[went], d[went]))]
        cut = np.append(True, (d[went][1:] != d[went][:-1]) | (th[went][1:] != th[went][:-1]) | (at[went][1:] > at[went][:-1] + window)) if len(went) else np.zeros(0, bool)
        begin, end = went[cut], went[np.append(np.flatnonzero(cut)[1:], len(went)) - 1] if len(went) else went
        rest = np.sort(by[~more])  # rows of one document next to each other take less room
        spread = Hasher.mixed((th[begin] ^ d[begin]).view(np.uint64))
        columns = [(h1[rest], spread), (h2[rest], np.zeros(len(begin), np.int64)), (d[rest], d[begin]), (th[rest], th[begin]), (at[rest], at[begin]), (np.zeros(len(rest), np.int64), at[end] + window)]
        arrays = [np.concatenate(x) for x in columns]
        for j in range(0, len(arrays[0]), ROWS):
            part = [x[j : j + ROWS] for x in arrays]
            yield pa.RecordBatch.from_arrays([*map(pa.array, part[:4]), *[pa.array(x.astype(np.int32)) for x in part[4:]]], names=["h1", "h2", "d", "th", "at", "to"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        hasher, parts, size = Hasher(), [], 0
        for batch in batches:
            ids, hashes = batch.column("d").to_numpy(), batch.column("th").to_numpy()
            seen = set()
            for i, (text, opens) in enumerate(zip(batch.column("text").cast(pa.binary()), batch.column("opens"))):
                if (key := (ids[i], hashes[i])) in seen:
                    continue
                seen.add(key)
                h = hasher.words(text.as_buffer().to_pybytes())
                open_ = opens.values.to_numpy().astype(np.int64)
                change = np.zeros(len(h) + 1, np.int64)
                np.add.at(change, np.maximum(open_ - side, 0), 1)
                np.add.at(change, np.minimum(open_, len(h) - window) + 1, -1)
                at = np.flatnonzero(np.cumsum(change) > 0)
                for j in range(0, len(at), HELD):
                    part = at[j : j + HELD]
                    parts.append([*Hasher.runs(h, part, (0, window, 3), (0, window, 4)), np.full(len(part), ids[i]), np.full(len(part), hashes[i]), part])
                    size += len(part)
                    if size >= HELD:
                        yield from settled(parts)
                        parts, size = [], 0
        if parts:
            yield from settled(parts)

    return run


def copies(windows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(d, th, runs): of ``windows`` (h1, h2, d, th, at, to), the stretches that go and those of windows that a smaller document has too."""
    least = F.min(F.when(F.col("to") == 0, F.col("d"))).over(W.partitionBy("h1", "h2"))
    gone = windows.withColumn("least", least).where((F.col("to") > 0) | (F.col("d") > F.col("least")))
    end = F.when(F.col("to") > 0, F.col("to")).otherwise(F.col("at") + window)
    return gone.groupBy("d", "th").agg(F.collect_list(F.struct(F.col("at").alias("s"), end.alias("e"))).alias("runs"))


def _kept(at: int):
    """Batches with the text, their column number ``at``, cut, and the numbers of words and removed words instead of the last column."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts, totals, removed = [], [], []
            for text, runs in zip(batch.column(at).cast(pa.binary()), batch.column(batch.num_columns - 1)):
                text = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = [w for part in split(text) for w in part]
                change = np.zeros(len(words) + 1, np.int64)
                if runs.is_valid:
                    np.add.at(change, runs.values.field("s").to_numpy(), 1)
                    np.add.at(change, np.minimum(runs.values.field("e").to_numpy(), len(words)), -1)
                gone = np.cumsum(change[:-1]) > 0
                texts.append(b" ".join(words if not gone.any() else [w for w, g in zip(words, gone.tolist()) if not g]))
                totals.append(len(words))
                removed.append(int(gone.sum()))
            columns = [*batch.columns[:-1], pa.array(totals, pa.int64()), pa.array(removed, pa.int64())]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])

    return run


def _sides(rows: DataFrame, keys: list[str], told: DataFrame, of: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with those that may meet ``told`` by ``keys`` (there named ``of``), and those that don't.

    Rows are parted by a hash of the keys where they are, so that texts that nothing is told about aren't shuffled.  Above ``most`` keys,
    eight bytes each, all rows may meet.
    """
    if told.count() > most:
        return rows, rows.where("false")
    key = fresh(rows, "key")
    few = F.broadcast(told.select(F.xxhash64(*of).alias(key)).distinct())
    keyed = rows.withColumn(key, F.xxhash64(*keys))
    return keyed.join(few, key, "left_semi").drop(key), keyed.join(few, key, "left_anti").drop(key)


def remove(docs: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and more), the text as the words that stay, joined by one space, and the columns n_words and n_removed.

    The last two get underscores where ``docs`` has such names.  ``broadcast_rows`` changes the joins only.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(whole_text()).alias("th"), whole_text().alias("text"))
    found = checkpointed(anchors(keyed, window))
    opens = found.where("size(opens) > 0").select("d", "th", "opens")
    open_ = _sides(keyed, ["d", "th"], opens, ["d", "th"], broadcast_rows)[0].join(opens, ["d", "th"])
    windows = open_.select("d", "th", "text", "opens").mapInArrow(_windows(window), "h1 long, h2 long, d long, th long, at int, to int")
    told = found.where("size(runs) > 0").select("d", "th", "runs").unionByName(copies(windows, window))
    cuts = checkpointed(told.groupBy("d", "th").agg(F.flatten(F.collect_list("runs")).alias("runs")))
    names = list(docs.columns)
    for name in ("n_words", "n_removed"):
        while name.lower() in {n.lower() for n in names}:
            name += "_"
        names.append(name)
    d, th, runs = (fresh(docs, x) for x in ("d", "th", "runs"))
    cuts = cuts.withColumnsRenamed({"d": d, "th": th, "runs": runs})
    rows = docs.withColumns({d: F.col("doc_id").cast("long"), th: F.xxhash64(whole_text())})
    touched, rest = _sides(rows, [d, th], cuts, [d, th], broadcast_rows)
    met = touched.join(cuts, [d, th], "left").unionByName(rest.withColumn(runs, F.lit(None).cast(cuts.schema[runs].dataType)))
    wanted = met.select(*[F.col(f"`{c}`") for c in docs.columns], runs)
    fields = [T.StructField(f.name, T.StringType()) if f.name.lower() == "text" else f for f in docs.schema]
    schema = T.StructType([*fields, *[T.StructField(n, T.LongType()) for n in names[-2:]]])
    return wanted.mapInArrow(_kept([c.lower() for c in docs.columns].index("text")), schema)
