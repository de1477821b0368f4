"""Scores of extractions and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_scores(found: Column, truth: Column) -> dict[str, Column]:
    """tp, fp, fn, precision, recall and f1 of two arrays as sets.

    Two empty sets score 1; nothing found scores 0; with no truth recall is 1 and the others are 0.
    """
    tp, fp, fn = F.size(F.array_intersect(found, truth)), F.size(F.array_except(found, truth)), F.size(F.array_except(truth, found))
    none_found, none_true = F.size(found) == 0, F.size(truth) == 0
    p = F.when(none_found & none_true, 1.0).when(none_found | none_true, 0.0).otherwise(tp / (tp + fp))
    r = F.when(none_true, 1.0).when(none_found, 0.0).otherwise(tp / (tp + fn))
    f1 = F.when(none_found & none_true, 1.0).otherwise(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
    return {"tp": tp.cast("long"), "fp": fp.cast("long"), "fn": fn.cast("long"), "precision": p, "recall": r, "f1": f1}


def macro(scores: DataFrame) -> DataFrame:
    """The means of precision, recall and f1, to three places."""
    return scores.agg(*[F.bround(F.avg(c), 3).alias(c) for c in ("precision", "recall", "f1")])


def semantic_match(triples: DataFrame) -> DataFrame:
    """Triples as compared: the subject as *patient*, everything else in lower case and trimmed."""
    low = lambda c: F.lower(F.trim(c)).alias(c)
    return triples.select(F.lit("patient").alias("subject"), low("subject_type"), low("predicate"), low("object"), low("object_type"))


def answer_scores(rows: DataFrame) -> DataFrame:
    """n, grounding, answered, keyword recall and context precision of QA rows (answer, gold, context), to three places."""
    low = F.lower("answer")
    hits = F.size(F.filter("gold", lambda g: low.contains(F.lower(g))))
    useful = F.size(F.filter("context", lambda c: F.exists("gold", lambda g: F.lower(c).contains(F.lower(g)))))
    per = rows.select(
        (F.size("context") > 0).cast("double").alias("grounding"),
        (hits > 0).cast("double").alias("answered"),
        F.coalesce(F.try_divide(hits, F.size("gold")), F.lit(0.0)).alias("keyword_recall"),
        F.coalesce(F.try_divide(useful, F.size("context")), F.lit(0.0)).alias("context_precision"),
    )
    return per.agg(F.count("*").alias("n"), *[F.bround(F.avg(c), 3).alias(c) for c in per.columns])
