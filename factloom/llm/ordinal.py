"""A quality classifier for graded ratings: cumulative-link ordinal regression over hashed text.

One weight for each hashed feature, shared by all grades, places a document on a line; ordered
thresholds cut the line into grades: P(grade >= k) = 1 / (1 + exp(threshold_k - place)).  That gives an
expected grade and the probability of the upper tail, by which documents are selected.

Features are words, their first four letters (stems carry over to forms never seen) and their shapes
(letters and digits as classes, runs of one class as one), hashed into a fixed number of slots, with the square root of their share of the text as value, and coarse
classes of the text's length, of its share of distinct words and of its share of repeated lines.

The model is fitted on a sample of at most ``sample`` labelled documents, taken by the hash of doc_id,
whose features alone reach the driver; of rows that share such a doc_id one counts.  All documents are scored
where they are read.

Defined cases: a null or empty text has only the coarse features and is graded by them; labels whose
quality is null don't count, a null ``toxic`` counts as 0; repeated rows and rows that share a doc_id are
scored one by one; an empty table of documents gives an empty result, whatever the labels are; else labels
of documents with a single grade or none give an error that says so; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 16
SAMPLE = 12_000
GRADES = 3
#: Words that a task remembers the slots of.
REMEMBERED = 300_000


def _shape(word: str) -> str:
    """Runs of a class as one letter: A for capitals, a for other letters, 0 for digits, others as they are."""
    out = ""
    for c in word[:40]:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if out[-1:] != k:
            out += k
    return out


class _Slots(dict):
    """The slots of a word, of its shape and of its first letters."""

    def __missing__(self, word: str) -> tuple[int, int, int]:
        if len(self) >= REMEMBERED:
            self.clear()
        plain = word.lower().strip(".,;:!?\"'()*#$%&|")
        found = self[word] = tuple(crc32(x.encode("utf-8", "replace")) % SLOTS for x in (plain, "shape " + _shape(word), "start " + plain[:4]))
        return found


def _coarse(text: str, n: int, distinct: int) -> list[int]:
    lines = [x for x in text.split("\n") if x]
    said = (f"length {n.bit_length()}", f"distinct {10 * distinct // max(n, 1)}", f"lines {10 * len(set(lines)) // max(len(lines), 1) if len(lines) > 2 else 10}")
    return [crc32(x.encode()) % SLOTS for x in said]


def features(text: str | None, slots: _Slots):
    """(slots, values) of a text, each slot once."""
    import numpy as np

    text = text or ""
    words = Counter(text.split())
    n = sum(words.values())
    coarse = _coarse(text, n, len(words))
    if not words:
        return np.array(sorted(set(coarse)), np.int32), np.ones(len(set(coarse)), np.float32)
    pairs = np.array([slots[w] for w in words], np.int64)
    times = np.fromiter(words.values(), np.float64, len(words))
    at, back = np.unique(np.concatenate([pairs.T.ravel(), coarse]), return_inverse=True)
    share = np.bincount(back, np.concatenate([np.tile(times / n, 3), np.full(len(coarse), 0.1)]))
    return at.astype(np.int32), np.sqrt(share).astype(np.float32)


@dataclass
class Model:
    """Weights by slot and the increasing thresholds between the grades."""

    weights: object
    thresholds: object

    def tails(self, texts: list[str | None], slots: _Slots):
        """P(grade >= k) of each text, for k from 1."""
        import numpy as np

        place = np.zeros(len(texts))
        for i, text in enumerate(texts):
            at, values = features(text, slots)
            place[i] = self.weights[at] @ values
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - place[:, None], -500, 500)))


def grade(quality: Column, toxic: Column) -> Column:
    """The graded rating of a label: 0 toxic, 1 junk, 2 good."""
    return F.when(F.coalesce(toxic, F.lit(0)) > 0, 0).when(quality > 0, 2).otherwise(1)


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(grade, slots, values) of at most ``sample`` labelled documents.

    The sample is a list of ids, small enough to be broadcast; no text leaves its task.  A doc_id that very many
    rows have is one row after a partial aggregation in the tasks.
    """
    graded = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("id"), grade(F.col("quality"), F.col("toxic")).alias("grade"))
    once = graded.groupBy("id").agg(F.min("grade").alias("grade"))
    few = once.orderBy(F.xxhash64("id"), "id").limit(sample)
    met = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(few), F.col("doc_id") == F.col("id")).select("id", "grade", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        slots = _Slots()
        for batch in batches:
            found = [features(t, slots) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (0, 1))], names=["id", "grade", "slots", "values"])

    made = met.mapInArrow(run, f"id {labels.schema['doc_id'].dataType.simpleString()}, grade int, slots binary, values binary")
    return made.groupBy("id").agg(F.min(F.struct("grade", "slots", "values")).alias("one")).select("one.*")


def _cuts(p):
    """The thresholds of the parameters ``p``: the first one, and the others by the logarithms of their gaps."""
    import numpy as np

    return np.concatenate([p[SLOTS : SLOTS + 1], p[SLOTS] + np.cumsum(np.exp(p[SLOTS + 1 :]))])


def loss_and_gradient(p, y, at, values, starts, of, shrink: float):
    """The mean negative logarithm of the likelihood of the grades ``y`` with the weights' penalty, and its gradient.

    ``at`` and ``values`` hold the features of all rows, a row's from ``starts`` on; ``of`` is the row of each.
    """
    import numpy as np

    k, w, cuts, rows = len(p) - SLOTS, p[:SLOTS], _cuts(p), np.arange(len(y))
    place = np.add.reduceat(w[at] * values, starts)
    tail = np.concatenate([np.ones((len(y), 1)), 1 / (1 + np.exp(np.clip(cuts[None, :] - place[:, None], -500, 500))), np.zeros((len(y), 1))], axis=1)
    upper, lower = tail[rows, y], tail[rows, y + 1]
    chance = np.maximum(upper - lower, 1e-12)
    up, down = upper * (1 - upper), lower * (1 - lower)  # slopes of the two tails of a row's grade
    d_place = -(up - down) / chance / len(y)
    d_cuts = np.zeros(k)
    np.add.at(d_cuts, y[y > 0] - 1, (up / chance)[y > 0] / len(y))
    np.add.at(d_cuts, y[y < k], -(down / chance)[y < k] / len(y))
    later = np.cumsum(d_cuts[::-1])[::-1]
    gradient = np.concatenate([np.bincount(at, d_place[of] * values, SLOTS) + shrink * w, [d_cuts.sum()], later[1:] * np.exp(p[SLOTS + 1 :])])
    return -np.log(chance).mean() + shrink * (w @ w) / 2, gradient


def fit_rows(rows: list, grades: int = GRADES, rounds: int = 250, rate: float = 0.3, shrink: float = 2e-6) -> Model:
    """Maximum likelihood by Adam over all rows at once; ``shrink`` is the weights' L2 penalty."""
    import numpy as np

    y = np.array([r[0] for r in rows])
    if len(set(y.tolist())) < 2:
        raise ValueError("the labelled documents have fewer than two grades")
    at = [np.frombuffer(r[1], np.int32) for r in rows]
    starts = np.cumsum([0, *map(len, at)])[:-1]
    of = np.repeat(np.arange(len(rows)), list(map(len, at)))
    at = np.concatenate(at)
    values = np.concatenate([np.frombuffer(r[2], np.float32) for r in rows]).astype(np.float64)
    share = np.clip([(y >= j + 1).mean() for j in range(grades - 1)], 0.005, 0.995)
    first = np.sort(np.log((1 - share) / share))
    gaps = np.log(np.maximum(np.diff(first), 0.1))
    p = np.concatenate([np.zeros(SLOTS), first[:1], gaps])  # weights, first threshold, logs of gaps
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        _, g = loss_and_gradient(p, y, at, values, starts, of, shrink)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(p[:SLOTS].copy(), _cuts(p))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of a bounded sample of labelled documents."""
    # sorted, so that sums and with them the weights are the same in each run
    return fit_rows(sorted((r["grade"], bytes(r["slots"]), bytes(r["values"])) for r in sampled(docs, labels, sample).collect()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade, p_upper (the chance of the highest grade) and p_lowest for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        slots = _Slots()
        for batch in batches:
            tails = shared.value.tails(batch.column(1).to_pylist(), slots)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(1 - tails[:, 0])], names=["doc_id", "expected_grade", "p_upper", "p_lowest"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, expected_grade double, p_upper double, p_lowest double")


def select(docs: DataFrame, labels: DataFrame, at: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """:func:`score` with the most likely ``grade`` and ``kept``: whether the highest grade reaches ``at``."""
    empty = docs.limit(1).count() == 0
    scored = score(docs, Model(None, None) if empty else fit(docs, labels, sample))
    middle = 1 - F.col("p_upper") - F.col("p_lowest")
    likely = F.when((F.col("p_upper") >= middle) & (F.col("p_upper") >= F.col("p_lowest")), GRADES - 1).when(F.col("p_lowest") > middle, 0).otherwise(1)
    return scored.withColumns({"grade": likely, "kept": F.col("p_upper") >= at})
