"""Quality rules as weak supervision.

Each rule looks at a few measurements of a document and votes *good* (1), *bad* (-1) or abstains (0).
Nobody says how far a rule can be trusted: expectation-maximisation over the counts of vote patterns in the
whole corpus estimates it, and a document is kept when its posterior probability of being good reaches a
bound.

Junk is of several kinds, and a rule sees only its own, so that rules aren't independent given that a document
is junk.  The model therefore has one class of good documents and one for each kind of junk in :data:`KINDS`;
within a class votes are independent, and each rule has its own chance to vote bad when it votes.  These
chances and the sizes of the classes have Beta and Dirichlet priors of stated strength (:data:`FALSE_ALARM`,
:data:`SEEN`, :data:`UNSEEN`, :data:`STRENGTH`, :data:`CLASSES`) and no bounds: enough documents move
them anywhere.  A single bad vote against several good ones does not reject a document unless the corpus
has many such documents whose other votes are bad as well.

Everything is built from Spark SQL functions.  Measuring needs no shuffle; the corpus is reduced to
vote patterns, at most 3^rules and in practice some hundreds, and the estimation is one expression over those.

Repeated windows of words are told by 64-bit hashes; in a text of a million words two different ones fall
together with a probability of 3e-8.

Defined cases: a null text counts as the empty text, which has no words and fails the base rule;
repeated rows and rows with a null or repeated doc_id each get their own result; an empty table
gives an empty result; other columns of the input are ignored by :func:`judge` and passed through
by :func:`keep`, whatever their names.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import SPACES, bind, checkpointed, fresh, stored, whole_text

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
KEEP_AT = 0.5
ROUNDS = 25
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_ends", "n_marks", "n_letters", "n_distinct", "n_echoes", "n_bullets", "n_ellipses")
RULES = ("length", "word_length", "symbols", "dup_lines", "repeats", "capitals", "sentences", "marks", "letters", "variety", "echoes", "bullets", "ellipses")
#: Kinds of junk, each with the rules that are expected to see it.
KINDS = {
    "brief": ("length",),
    "signs": ("symbols", "marks", "letters"),
    "repetition": ("repeats", "echoes", "variety"),
    "lists": ("dup_lines", "bullets", "ellipses"),
    "shape": ("word_length", "capitals", "sentences"),
}
#: Prior means: how often a rule's vote is bad on a good document, on junk that it is expected to see, and on other junk.
FALSE_ALARM, SEEN, UNSEEN = 0.01, 0.6, 0.15
#: Prior strengths in votes: of the false alarms and of the others.
STRENGTH = (100.0, 20.0)
#: Prior documents of each class: good ones, and of each kind of junk.
CLASSES = (80.0, 4.0)


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows that occur twice or more, from the array of all windows' hashes."""

    def covered(found: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(found, i)["h"], F.lit(False))
        starts = F.array_sort(F.transform(F.filter(found, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
            lambda a, i: F.struct((i + WINDOW).alias("end"), (a["total"] + i + WINDOW - F.greatest(i, a["end"])).alias("total")),
            lambda a: a["total"],
        )

    by_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), bind(by_hash, covered)).otherwise(0)


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the struct ``m`` of the measurements, one row for each row."""
    m, words, windows = (fresh(docs, n) for n in ("m", "_words", "_windows"))
    text = whole_text()
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(
        *[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])],
        bind(F.btrim(text, F.lit(SPACES)), lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, f"[{SPACES}]+"))).alias(words),
    )
    w = F.col(words)
    hashed = lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)])
    second = first.withColumn(windows, F.when(F.size(w) >= WINDOW, F.transform(F.slice(w, 1, F.size(w) - (WINDOW - 1)), hashed)).otherwise(F.array().cast("array<bigint>")))
    values = {
        "n_words": F.size(w),
        "word_chars": F.char_length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": _repeat_words(F.col(windows)),
        "n_lines": F.size(lines),
        "n_upper": F.char_length(F.regexp_replace(text, "[^A-Z]+", "")),
        "n_ends": F.regexp_count(text, F.lit(r"""[.!?](?=[\s"')\]]|$)|[。！？؟।]""")),
        "n_marks": F.regexp_count(text, F.lit("[#*$%&|<>]+")),
        "n_letters": F.char_length(F.regexp_replace(text, r"[^\p{L}\p{M}]+", "")),
        "n_distinct": F.size(F.array_distinct(w)),
        "n_echoes": F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i + 1), F.lit(False)))),
        "n_bullets": F.regexp_count(text, F.lit(r"(?m)^[\x20\x09]*[•▪‣●*+–-][\x20\x09]")),
        "n_ellipses": F.regexp_count(text, F.lit(r"(?m)(?:\.\.\.|…)[\x20\x09]*$")),
    }
    return second.select(*[F.col(f"`{c}`") for c in keep], F.struct(*[v.cast("long").alias(k) for k, v in values.items()]).alias(m))


def base_failed(m: Column) -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def votes(m: Column) -> Column:
    """An array with the vote of each of :data:`RULES`: 1 good, -1 bad, 0 abstains (an unclear measure, or too short a text)."""
    n = F.greatest(m["n_words"], F.lit(1)).cast("double")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    length = m["word_chars"] / n
    symbols = m["n_symbols"] / n
    lines = F.greatest(m["n_lines"], F.lit(1))
    dups = m["n_dup_lines"] / lines
    repeats = m["n_repeat_words"] / n
    chars = F.greatest(m["word_chars"], F.lit(1))
    upper = m["n_upper"] / chars
    ends = m["n_ends"] / n
    letters = m["n_letters"] / chars
    long_enough = m["n_words"] >= MIN_WORDS
    return F.array(
        vote(~long_enough, m["n_words"] >= 40),
        vote((length < 2) | (length > 15), length.between(3, 11)),
        vote(symbols > 0.1, symbols <= 0.01),
        vote((dups > 0.3) & (m["n_dup_lines"] >= 3), (m["n_dup_lines"] == 0) & (m["n_lines"] >= 2)),
        vote(repeats > 0.2, (m["n_repeat_words"] == 0) & (m["n_words"] >= 40)),
        vote(upper > 0.4, upper < 0.1),
        vote((ends > 0.5) | ((ends == 0) & (m["n_words"] >= 60)), ends.between(0.01, 0.3)),
        vote(m["n_marks"] > 0.1 * n, m["n_marks"] <= 0.01 * n),
        vote(letters < 0.7, letters > 0.85),
        # different words against a power of their number: texts of any length have more than the first, most more than the second
        vote(long_enough & (m["n_distinct"] < F.pow(n, F.lit(0.8))), long_enough & (m["n_distinct"] > F.pow(n, F.lit(0.87)))),
        vote(m["n_echoes"] > 0.2 * n, long_enough & (m["n_echoes"] <= 0.02 * n)),
        vote((m["n_bullets"] > 0.9 * lines) & (m["n_lines"] >= 3), (m["n_bullets"] == 0) & (m["n_lines"] >= 2)),
        vote((m["n_ellipses"] > 0.3 * lines) & (m["n_lines"] >= 3), (m["n_ellipses"] == 0) & (m["n_lines"] >= 2)),
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def priors() -> list[list[float]]:
    """For each class, the good one first: its prior documents, and each rule's prior bad and good votes."""
    rows = [[CLASSES[0], *[x for _ in RULES for x in (STRENGTH[0] * FALSE_ALARM, STRENGTH[0] * (1 - FALSE_ALARM))]]]
    for seen in KINDS.values():
        means = [SEEN if r in seen else UNSEEN for r in RULES]
        rows.append([CLASSES[1], *[x for p in means for x in (STRENGTH[1] * p, STRENGTH[1] * (1 - p))]])
    return rows


def _places(v: Column) -> Column:
    """Where the votes ``v`` stand in a class's row; abstentions stand nowhere."""
    at = F.transform(v, lambda x, j: F.when(x == -1, 2 * j + 1).when(x == 1, 2 * j + 2))
    return F.filter(at, lambda x: x.isNotNull())


def _table(counts: Column) -> Column:
    """The logarithms of a model's chances, one row for each class, from its counts with those of the priors."""
    total = _sum(F.transform(counts, lambda c: F.get(c, 0)))
    other = lambda c, k: F.get(c, k + F.when(k % 2 == 1, 1).otherwise(-1))
    chance = lambda c: F.transform(c, lambda x, k: F.log(F.when(k == 0, x / total).otherwise(x / (x + other(c, k)))))
    return F.transform(counts, chance)


def _posteriors(at: Column, table: Column) -> Column:
    """The probabilities of the classes for votes at the places ``at``."""
    odds = F.transform(table, lambda t: F.aggregate(at, F.get(t, 0), lambda a, k: a + F.get(t, k)))
    scaled = bind(odds, lambda o: F.transform(o, lambda x: F.exp(x - F.array_max(o))))
    return bind(scaled, lambda e: F.transform(e, lambda x: x / _sum(e)))


def estimate(patterns: Column, rounds: int = ROUNDS) -> Column:
    """The counts of the fitted model, those of the priors included, in the layout of :func:`priors`.

    ``patterns`` is an array of (v, n): a vote pattern and its number of documents.
    """
    prior = F.array(*[F.array(*map(F.lit, row)) for row in priors()])
    classes = len(KINDS) + 1

    def step(counts: Column) -> Column:
        def gathered(table: Column) -> Column:
            weighed = F.transform(patterns, lambda x: bind(_places(x["v"]), lambda at: F.struct(at.alias("at"), F.transform(_posteriors(at, table), lambda p: p * x["n"]).alias("w"))))

            def of_class(ws: Column, c: Column) -> Column:
                start = F.get(prior, c)
                return F.aggregate(ws, start, lambda acc, x: F.transform(acc, lambda a, k: a + F.when((k == 0) | F.array_contains(x["at"], k), F.get(x["w"], c)).otherwise(0.0)))

            return bind(weighed, lambda ws: F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: of_class(ws, c)))

        return bind(_table(counts), gathered)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), prior, lambda counts, _: step(counts))


def fit(votes_table: DataFrame, column: str = "v") -> list[list[float]]:
    """The fitted counts over all rows of ``votes_table``.

    At most 3^rules patterns meet in the one row that is estimated; its few numbers are all that
    the driver sees.
    """
    counts = votes_table.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    one = counts.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("patterns"))
    row = one.select(estimate(F.col("patterns")).alias("counts")).first()
    return [list(map(float, c)) for c in row["counts"]]


def accuracies(counts: list[list[float]]) -> dict[str, dict[str, float]]:
    """What has been learned: for each class each rule's chance to vote bad when it votes, and the class's share."""
    total = sum(c[0] for c in counts)
    return {k: {"share": c[0] / total} | {r: c[2 * j + 1] / (c[2 * j + 1] + c[2 * j + 2]) for j, r in enumerate(RULES)} for k, c in zip(("good", *KINDS), counts)}


def _verdict(m: Column, counts: list[list[float]], at: float) -> tuple[Column, Column]:
    total = sum(c[0] for c in counts)
    rows = [[log(c[0] / total)] + [log(x / (c[j] + c[j + 1])) for j in range(1, len(c), 2) for x in (c[j], c[j + 1])] for c in counts]
    fitted = F.array(*[F.array(*map(F.lit, r)) for r in rows])
    p = F.get(_posteriors(_places(votes(m)), fitted), 0)
    return p, ~base_failed(m) & (p >= at)


def judge(docs: DataFrame, at: float = KEEP_AT) -> DataFrame:
    """doc_id, the measurements, base_failed, votes, posterior ``p_good`` and ``kept`` for each row."""
    table = docs.select("doc_id", "text")
    measured = checkpointed(measure(table, ["doc_id"]))
    m = F.col("m")
    counts = fit(measured.select(votes(m).alias("v")))
    p, kept = _verdict(m, counts, at)
    return measured.select("doc_id", "m.*", base_failed(m).alias("base_failed"), votes(m).alias("votes"), p.alias("p_good"), kept.alias("kept"))


def keep(docs: DataFrame, at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``.

    The corpus is measured once: rows and measurements are written as Parquet to the shared folder, where the
    estimation reads the measurements alone.
    """
    m = fresh(docs, "m")
    measured = stored(measure(docs, docs.columns))
    counts = fit(measured.select(votes(F.col(m)).alias("v")))
    return measured.where(_verdict(F.col(m), counts, at)[1]).drop(m)
