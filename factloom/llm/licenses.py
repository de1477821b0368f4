"""License scans by diagonal voting.

Every pair of neighbouring words of a document is looked up among the word pairs of a set of license
templates.  A hit at word p of the document and word t of a template votes for the diagonal p - t, the
place where the template would start; a template that stands in the text gets all its votes on one
diagonal, and one with words put in or left out gets them on neighbouring diagonals.  Votes are counted by
diagonal, and the diagonals from each one up to ``SLACK`` above it are merged.

A merged span with enough votes is verified word by word: of its votes, whose words have been compared
and not only their hashes, the longest chain is taken in which the places in the text and those in the
template both increase.  So each word pair of the template counts once, in its order, and within a
stretch of the text about as long as the template; the chain's share of all the template's pairs is the
span's score, and a span is accepted from ``COVERAGE`` on.  Words that merely repeat make no chain.  The word pairs that tell a
license from its neighbours, such as version numbers, *noncommercial* or *lesser*, must all be among the votes: a notice of version 2 or of another
license of the family is none of version 3, however much else they share.

Everything is built from Spark SQL functions.  The templates are the only data that is broadcast; their
number of words is bounded.  Pairs that hit nothing are dropped in the task that reads the text, and
votes are counted before the shuffle.

Defined cases: a null or empty text has no words and gets no labels, score 0; repeated rows and rows
that share a doc_id get a row each; an empty table gives an empty result; other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import bind, lower_ascii, whole_text

#: Words are maximal runs of letters and digits of ASCII and of anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that label a text wherever they stand.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices of well-known licenses, with labels of their own.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license version 2 1", "lgpl-2.1"),
    ("gnu lesser general public license version 3", "lgpl-3.0"),
    ("gnu affero general public license version 3", "agpl-3.0"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license v 1 1", "mpl-1.1"),
    ("subject to the mozilla public license version 1 1", "mpl-1.1"),
    ("creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc-4.0"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0"),
    ("creative commons attribution noderivatives 4 0 international license", "cc-by-nd-4.0"),
    ("creative commons attribution noncommercial sharealike 4 0 international license", "cc-by-nc-sa-4.0"),
    ("creative commons attribution noncommercial noderivatives 4 0 international license", "cc-by-nc-nd-4.0"),
)
#: Diagonals up to so far above another one are merged with it; short templates must stand on one.
SLACK = 6
#: The share of a template's word pairs that a span must have.
COVERAGE = 0.8
#: Templates of other labels are neighbours of one from this share of its word pairs in common.
NEAR = 0.5
#: The templates are broadcast; more words than this are refused.
MAX_TEMPLATE_WORDS = 100_000


def needed(templates: Sequence[tuple[str, str, bool]]) -> list[list[int]]:
    """For each template the places of the word pairs without which it isn't that license: those with a number, and those that a neighbour lacks.

    Only notices have such places; base phrases must stand whole.
    """
    pairs = [list(zip(p.split(" "), p.split(" ")[1:])) for p, _, _ in templates]
    out = []
    for own, (_, label, base) in zip(pairs, templates):
        near = [set(other) for other, (_, x, b) in zip(pairs, templates) if x != label and not b and len(set(own) & set(other)) >= NEAR * len(set(own))]
        out.append([] if base else [t for t, (a, b) in enumerate(own) if a.isdigit() or b.isdigit() or any((a, b) not in other for other in near)])
    return out


def template_pairs(spark: SparkSession, templates: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """(h, a, b, t, template, label, base, pairs) for each word pair (a, b) of each template."""
    rows = []
    for k, (phrase, label, base) in enumerate(templates):
        words = phrase.split(" ")
        if len(words) < 2:
            raise ValueError(f"a template needs two words: {phrase}")
        rows += [(a, b, t, k, label, base, len(words) - 1) for t, (a, b) in enumerate(zip(words, words[1:]))]
    if len(rows) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"the templates have {len(rows)} words; at most {MAX_TEMPLATE_WORDS} are broadcast")
    one = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("a", "b", "t", "template", "label", "base", "pairs"))]) for r in rows])
    return spark.range(1).select(F.inline(one)).withColumn("h", F.xxhash64("a", "b"))


def slack(pairs: Column) -> Column:
    """How many diagonals a span of a template of so many word pairs may have beyond its first."""
    return F.when(pairs > SLACK, SLACK).otherwise(0)


def _chain(votes: Column) -> Column:
    """The length of the longest chain of ``votes`` (t, back) that increases in t and in the place -back.

    By ends: for each length the least place where a chain so long can end.  Votes come by t, and for
    one t from the last place to the first, so that none follows another of its own t.
    """

    def step(ends: Column, v: Column) -> Column:
        p = -v["back"]
        return bind(F.size(F.filter(ends, lambda x: x < p)), lambda k: F.concat(F.slice(ends, 1, k), F.array(p), F.slice(ends, k + 2, F.size(ends) + 1)))

    return F.aggregate(F.array_sort(votes), F.array().cast("array<bigint>"), step, F.size)


def spans(docs: DataFrame, templates: Sequence[tuple[str, str, bool]], coverage: float = COVERAGE) -> DataFrame:
    """Verified spans: row, doc_id, n_words, template, label, base, pairs, start, votes, found, share.

    ``start`` is a span's first diagonal, ``votes`` the number of votes on it, ``found`` the length of the
    verified chain (0 where too few votes are merged to reach ``coverage``) and ``share`` its part of the
    template's ``pairs``.  Each document also has one row without a template.
    """
    words = F.regexp_extract_all(lower_ascii(whole_text()), F.lit(WORD), F.lit(0))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("words"))
    each = rows.select("row", "doc_id", F.size("words").alias("n_words"), "words", F.posexplode_outer("words").alias("p", "w"))
    each = each.select("row", "doc_id", "n_words", "p", "w", F.get("words", F.col("p") + 1).alias("next"))
    known = F.broadcast(template_pairs(docs.sparkSession, templates))
    met = each.join(known, (F.xxhash64("w", "next") == F.col("h")) & (F.col("w") == F.col("a")) & (F.col("next") == F.col("b")), "left")
    hits = met.where(F.col("template").isNotNull() | (F.coalesce("p", F.lit(0)) == 0))
    # on one diagonal a template's pair has one vote at most, so that a list is no longer than the template
    by_diagonal = hits.groupBy("row", "doc_id", "n_words", "template", "label", "base", "pairs", (F.col("p") - F.col("t")).cast("long").alias("start")).agg(F.collect_list("t").alias("ts"))
    reach = W.partitionBy("row", "template").orderBy("start").rangeBetween(W.currentRow, SLACK)
    near = F.filter(F.collect_list(F.struct("start", "ts")).over(reach), lambda g: g["start"] <= F.col("start") + slack(F.col("pairs")))
    merged = by_diagonal.withColumn("near", near).withColumn("votes", F.size("ts"))
    enough = F.aggregate("near", F.lit(0), lambda a, g: a + F.size(g["ts"])) >= coverage * F.col("pairs")
    votes = F.flatten(F.transform("near", lambda g: F.transform(g["ts"], lambda t: F.struct(t.alias("t"), (-(g["start"] + t)).alias("back")))))
    need = F.get(F.array(*[F.array(*map(F.lit, x)).cast("array<int>") for x in needed(templates)]), F.col("template"))
    telling = F.size(F.array_except(need, F.transform(votes, lambda v: v["t"]))) == 0
    found = F.when(enough & telling & F.col("template").isNotNull(), F.when(F.col("votes") == F.col("pairs"), F.col("pairs")).otherwise(_chain(votes))).otherwise(0)
    return merged.select("row", "doc_id", "n_words", "template", "label", "base", "pairs", "start", "votes", found.alias("found")).withColumn("share", F.col("found") / F.col("pairs"))


def default_templates() -> list[tuple[str, str, bool]]:
    """The phrases and the notices as (words, label, whether a base phrase)."""
    return [(p, x, True) for p, x in BASE] + [(p, x, False) for p, x in NOTICES]


def scan(docs: DataFrame, templates: Sequence[tuple[str, str, bool]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row for each row of ``docs``.

    doc_id, n_words, n_base (places of base phrases), first_word and last_word (their least and largest
    start), base_labels, labels (with those of accepted spans) and score, the largest accepted share.
    """
    found = spans(docs, default_templates() if templates is None else templates, coverage)
    whole = F.coalesce(F.col("votes") == F.col("pairs"), F.lit(False))
    base = F.coalesce(F.col("base"), F.lit(False)) & whole
    accepted = F.col("template").isNotNull() & F.when(F.col("base"), whole).otherwise(F.col("share") >= coverage)
    listed = lambda pick: F.array_join(F.array_sort(F.collect_set(F.when(pick, F.col("label")))), ",")
    per_row = found.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(accepted).alias("labels"),
        F.coalesce(F.max(F.when(accepted, F.col("share"))), F.lit(0.0)).alias("score"),
    )
    return per_row.select("doc_id", F.greatest(F.col("n_words"), F.lit(0)).cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def oracle_sql() -> str:
    """The default scan in DuckDB SQL, from the definitions: a place of a base phrase is where its words stand, and
    a notice's score is the best, over all starts, of the longest chains of its word pairs near that start."""
    base = ", ".join(f"({p.split(' ')!r}, '{x}')" for p, x in BASE)
    need = needed(default_templates())[len(BASE) :]
    notices = ", ".join(f"({k}, {p.split(' ')!r}, '{x}', {len(need[k])})" for k, (p, x) in enumerate(NOTICES))
    needs = ", ".join(f"({k}, {t})" for k, places in enumerate(need) for t in places)
    return f"""
WITH base(phrase, label) AS (VALUES {base}), notices(k, phrase, label, telling) AS (VALUES {notices}), needs(k, t) AS (VALUES {needs}),
pairs AS (SELECT k, phrase[t + 1] AS a, phrase[t + 2] AS b, t FROM (SELECT k, phrase, unnest(range(len(phrase) - 1)) AS t FROM notices)),
docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
placed AS (SELECT row, p, words[p + 1] AS w, words FROM (SELECT row, words, unnest(range(len(words))) AS p FROM docs)),
standing AS (SELECT row, p, label FROM placed JOIN base ON w = phrase[1] AND words[p + 1:p + len(phrase)] = phrase),
based AS (SELECT row, count(*) AS n, min(p) AS first, max(p) AS last FROM standing GROUP BY row),
hits AS (SELECT row, k, p, t FROM placed JOIN pairs ON w = a AND words[p + 2] = b),
starts AS (SELECT DISTINCT row, k, p - t AS start, len(phrase) - 1 AS n, telling FROM hits JOIN notices USING (k)),
near AS (
  SELECT s.row, s.k, s.start, s.n, s.telling, list([h.p] ORDER BY h.t, h.p DESC) AS places, count(DISTINCT h.t) FILTER ((h.k, h.t) IN (FROM needs)) AS told FROM starts s JOIN hits h
  ON s.row = h.row AND s.k = h.k AND h.p - h.t BETWEEN s.start AND s.start + CASE WHEN s.n > {SLACK} THEN {SLACK} ELSE 0 END GROUP BY ALL),
chains AS (
  SELECT row, k, len(list_reduce(places, lambda ends, v: list_concat(list_filter(ends, lambda x: x < v[1]), v, ends[len(list_filter(ends, lambda x: x < v[1])) + 2:]))) / n AS share
  FROM near WHERE len(places) >= {COVERAGE} * n AND told = telling),
noticed AS (SELECT row, label, max(share) AS share FROM chains JOIN notices USING (k) WHERE share >= {COVERAGE} GROUP BY ALL),
labelled AS (SELECT row, label, true AS base, 1.0 AS share FROM standing UNION ALL SELECT row, label, false, share FROM noticed),
per_row AS (
  SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM labelled GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(first AS BIGINT) AS first_word, CAST(last AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN based USING (row) LEFT JOIN per_row USING (row)
"""
