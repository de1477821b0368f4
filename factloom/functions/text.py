"""Column functions over names, predicates and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations that a predicate's words are written out from.
WORD_CANON = {"max": "maximum", "min": "minimum", "qty": "quantity", "num": "number", "amt": "amount", "addr": "address", "id": "identifier"}
#: Predicates with one value at a time.
FUNCTIONAL = (
    "age", "sex", "gender", "date_of_birth", "name", "status", "current_status", "diagnosis", "current_diagnosis", "diagnosed_with",
    "has_diagnosis", "primary_diagnosis", "active_medication", "active_treatment", "clinical_status", "disease_status", "zoning_limit",
    "maximum_building_height", "max_building_height", "current_value",
)
#: Words that stand for a missing value.
PLACEHOLDERS = ("nan", "none", "null", "n/a", "unknown")
#: Conditions looked for in a case text.
CONDITIONS = (
    "ARDS", "COVID-19", "pneumonia", "carcinoma", "lymphoma", "leukaemia", "leukemia", "sepsis", "stroke", "myocardial infarction", "tuberculosis",
    "diabetes", "hypertension", "melanoma", "sarcoma", "appendicitis", "pancreatitis", "hepatitis", "nephropathy", "anemia", "anaemia", "fracture",
)
#: Words that ask for history.
HISTORY_WORDS = ("history", "prior", "previous", "previously", "earlier", "before", "past", "initial", "superseded", "revoked", "resolved")
MAX_STRING = 512
CHUNK = 6000


def slug(s: Column, canon: bool = False, default: str | None = "unknown") -> Column:
    """Lower case with runs of anything but ASCII letters and digits as one underscore, none at the ends.

    ``canon`` writes abbreviations out word by word; an empty slug becomes ``default``, if there is one.
    """
    base = F.btrim(F.regexp_replace(F.lower(F.trim(s)), "[^a-z0-9]+", "_"), F.lit("_"))
    if canon:
        known = F.create_map(*[F.lit(x) for pair in WORD_CANON.items() for x in pair])
        base = F.array_join(F.transform(F.split(base, "_"), lambda w: F.coalesce(F.try_element_at(known, w), w)), "_")
    return F.coalesce(F.nullif(base, F.lit("")), F.lit(default)) if default is not None else base


def semantic_key(subject: Column, predicate: Column, obj: Column | None = None) -> Column:
    """subject::predicate for one value at a time, and with ::object for facts that stand side by side."""
    parts = [slug(subject), slug(predicate, canon=True)]
    return F.concat_ws("::", *parts, *([] if obj is None else [slug(obj)]))


def is_functional(predicate: Column) -> Column:
    """Whether a predicate has one value at a time, also with has_ before it."""
    s = slug(predicate, canon=True)
    return s.isin(*FUNCTIONAL) | (s.startswith("has_") & F.substring(s, 5, 1 << 30).isin(*FUNCTIONAL))


def is_entity_shaped(obj: Column, object_type: Column) -> Column:
    """Whether an object is worth a node: not blank, and typed or not just a number."""
    o = F.trim(obj)
    return F.coalesce((o != "") & ((F.trim(object_type) != "") | ~o.rlike(r"^[\s\d.,%$/-]+$")), F.lit(False))


def is_value_laden(predicate: Column) -> Column:
    """Whether a value or a date was folded into a predicate."""
    trimmed = F.btrim(predicate, F.lit(" \t\n\r\x0b\x0c"))
    n = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))
    low = F.lower(predicate)
    return (n > 6) | (predicate.rlike("[0-9]") & (n > 3)) | low.contains("effective") | low.contains("as of") | low.contains("as_of")


def string_fault(s: Column, most: int = MAX_STRING) -> Column:
    """Why a string can't stand in a fact (null: it can)."""
    t = F.trim(s)
    return (
        F.when(s.isNull(), "missing").when(t == "", "empty").when(F.char_length(t) > most, "too long").when(F.lower(t).isin(*PLACEHOLDERS), "placeholder")
    )


def alias_norm(key: Column) -> Column:
    """What keys that mean the same agree in: no underscores, one plural s less, sex as gender."""
    s = F.lower(F.replace(key, F.lit("_"), F.lit("")))
    one = F.when(s.endswith("ies"), F.concat(F.left(s, F.length(s) - 3), F.lit("y"))).when(s.endswith("s") & ~s.endswith("ss"), F.left(s, F.length(s) - 1)).otherwise(s)
    return F.replace(F.replace(one, F.lit("hassex"), F.lit("hasgender")), F.lit("sex"), F.lit("gender"))


def delta_clean(s: Column) -> Column:
    """Lower case, anything but letters, digits and underscores as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(s), r"(?U)[^\w]+", " "))


def chunks(text: Column, size: int = CHUNK) -> Column:
    """The trimmed text in pieces of ``size`` characters; none if it is blank."""
    t = F.trim(text)
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(t), F.lit(1)), F.lit(size))
    return F.when(F.coalesce(t, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.substring(t, i, F.lit(size))))


def between(text: Column, start: str, end: str) -> Column:
    """From the first ``start`` up to the next ``end`` or the end of the text; empty without ``start``."""
    at = F.locate(start, text)
    stop = F.locate(end, text, 1) if start == end else F.instr(F.substring(text, at + len(start), F.char_length(text)), F.lit(end))
    rest = F.substring(text, at, F.char_length(text))
    return F.when(at == 0, F.lit("")).when(stop == 0, rest).otherwise(F.substring(text, at, stop + len(start) - 1))


def condition_hint(text: Column) -> Column:
    """The first condition that a text names, in lower case; empty if none."""
    return F.lower(F.regexp_extract(text, rf"(?i)\b({'|'.join(CONDITIONS)})\b", 0))


def age_text(raw: Column) -> Column:
    """``[[60.0, 'year']]`` as ``60 years``, one as ``1 year``; anything else trimmed."""
    n = F.regexp_extract(raw, r"^\[\[\s*(\d+)(?:\.\d*)?\s*,\s*'(\w+)'", 1)
    unit = F.regexp_extract(raw, r"^\[\[\s*(\d+)(?:\.\d*)?\s*,\s*'(\w+)'", 2)
    return F.when(n == "", F.trim(raw)).when(n == "1", F.concat(F.lit("1 "), unit)).otherwise(F.concat(F.coalesce(F.nullif(F.ltrim(n, F.lit("0")), F.lit("")), F.lit("0")), F.lit(" "), unit, F.lit("s")))


def gender_text(raw: Column) -> Column:
    """M and F written out; anything else trimmed."""
    t = F.trim(raw)
    return F.when(t == "M", "male").when(t == "F", "female").otherwise(t)


def asks_for_history(query: Column) -> Column:
    """Whether a question is about what no longer holds."""
    return query.rlike(rf"(?i)\b({'|'.join(HISTORY_WORDS)})\b")


def truncated(s: Column, most: int) -> Column:
    """One line of at most ``most`` characters, with the number of those cut off."""
    flat = F.replace(s, F.lit("\n"), F.lit("\\n"))
    return F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…(+"), (F.char_length(flat) - most).cast("string"), F.lit(" chars)"))).otherwise(flat)


def judge_evaluation(reply: Column) -> Column:
    """What a judge's reply says between its two headings."""
    got = F.regexp_extract(reply, r"(?s)Evaluation:(.*?)Total rating:", 1)
    return F.when(reply.rlike(r"(?s)Evaluation:(.*?)Total rating:"), F.btrim(got, F.lit(" \t\n\r"))).otherwise("no match found")


def judge_score(reply: Column) -> Column:
    """The rating in a judge's reply, 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(reply, r"Total rating:\s*(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double"), F.lit(0.0))


def reward_map(reply: Column) -> Column:
    """``name:value,name:value`` as a map of doubles; of a repeated name the last counts, and what is no number is null."""
    pairs = F.transform(F.split(reply, ","), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("name"), F.trim(F.split_part(x, F.lit(":"), F.lit(2))).try_cast("double").alias("value")))
    named = F.filter(pairs, lambda x: F.trim(x["name"]) != "")
    last = F.filter(named, lambda x, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda y: y["name"] == x["name"]))
    return F.map_from_entries(last)


def record_id(key: Column, obj: Column, predicate: Column, owner: Column, parents: Column, seq: Column) -> Column:
    """A content-addressed id: equal content has equal ids, whatever the order of the parents."""
    body = F.to_json(F.struct(key.alias("k"), obj.alias("o"), owner.alias("owner"), predicate.alias("p"), F.array_sort(parents).alias("parents"), seq.alias("seq")), {"ignoreNullFields": "false"})
    return F.concat(F.lit("rec_"), F.substring(F.sha2(body, 256), 1, 32))


def distance(tier: Column, corroboration: Column) -> Column:
    """How far a fact is from what it is about: by tier, less for each further subject that has it."""
    return (tier + 1) / F.sqrt(1 + F.greatest(corroboration, F.lit(0)))


def edge_length(d: Column) -> Column:
    """A distance as a length to draw."""
    return F.least(F.greatest(d, F.lit(0.1)) * 40, F.lit(400.0))
