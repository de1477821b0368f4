"""Column functions over prose and over a model's requests and replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions.text import MAX_STRING, string_fault

#: What stands for the subject that a text is about.
SELF_REFERENCE = (
    r"(the\s+)?(patient(\s+\w+)?|pt[-\s]?\w+|subject|individual|client|person|he|she|him|her|his|the\s+man|the\s+woman|a\s+\d+[\s-]*y.*|\d+[\s-]*y.*|this\s+\d+[\s-]*year[\s-]*old.*)"
)
#: Words for a company, in the order of their replacement, with whether a possessive takes their place.
COMPANY_WORDS = ((" we ", False), (" us ", False), (" our ", True), (" the Company ", False), ("We ", False), ("Us ", False), ("Our ", True), ("The Company ", False))
#: Words for a patient, in the order of their replacement.
PATIENT_WORDS = (" the patient ", " this patient ", "The patient ", "This patient ", " The patient ", " This patient ")
#: Words of sentences about interventions and about outcomes.
INTERVENTION_WORDS = ("therapy", "treated", "administered", "surgery", "oxygen", "medication", "dose", "mg", "rehabilitation")
OUTCOME_WORDS = ("discharge", "recovered", "improved", "died", "death", "follow-up", "stable", "hospital")
#: Predicates of the standard ontology.
STANDARD_PREDICATES = ("has_age", "has_gender", "diagnosed_with", "presents_with", "receives")


def refers_to_subject(s: Column) -> Column:
    """Whether a name only stands for the subject of the text."""
    return F.trim(s).rlike(rf"(?i)^{SELF_REFERENCE}$")


def _replaced(text: Column, words, value) -> Column:
    for w, *how in words:
        text = F.replace(text, F.lit(w), value(w, *how))
    return text


def company_named(text: Column, name: Column) -> Column:
    """A text with a company's name for the words that stand for it between spaces or at a sentence's begin."""
    return _replaced(text, COMPANY_WORDS, lambda w, own: F.concat(F.lit(" " if w[0] == " " else ""), name, F.lit("'s " if own else " ")))


def patient_named(text: Column, name: Column) -> Column:
    """The trimmed text with a patient's name for the words that stand for them."""
    return _replaced(F.btrim(text, F.lit(" \t\n\r")), [(w,) for w in PATIENT_WORDS], lambda w: F.concat(F.lit(" " if w[0] == " " else ""), name, F.lit(" ")))


def repaired(content: Column) -> Column:
    """Nested content as plain ASCII text: escaped line ends as line ends, accents off, anything else beyond ASCII left out.

    Letters with accents are written apart by their decomposition, for Latin letters up to U+017F.
    """
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x180)]
    pairs = [(a, b) for a, b in pairs if b.isascii()]
    plain = F.translate(content, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    return F.regexp_replace(F.replace(plain, F.lit("\\n"), F.lit("\n")), r"[^\x00-\x7F]+", "")


def sentences(text: Column) -> Column:
    """The sentences of a text, cut after a stop with white space behind it; blank ones are left out."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+", -1), lambda s: F.btrim(s, F.lit(" \t\n\r\x0b\x0c")))
    return F.filter(parts, lambda s: s != "")


def sentence_with(parts: Column, words: tuple[str, ...], last: bool = False) -> Column:
    """The first of some sentences, or the last, that holds any of ``words``; null without one."""
    found = F.filter(parts, lambda s: F.exists(F.array(*map(F.lit, words)), lambda w: F.lower(s).contains(w)))
    return F.try_element_at(found, F.lit(-1 if last else 1))


def node_key(s: Column) -> Column:
    """A name as a node's key: ASCII letters, digits and underscores alone."""
    return F.regexp_replace(s, "[^a-zA-Z0-9_]", "")


def asked_entity(s: Column) -> Column:
    """A name as it is asked for: commas and line ends stay, spaces become underscores."""
    return F.replace(F.regexp_replace(s, "[^a-zA-Z0-9_ ,\n]", ""), F.lit(" "), F.lit("_"))


def object_label(label: Column, key: Column) -> Column:
    """What a fact says: its object's label, else the last part of its key."""
    return F.coalesce(F.nullif(label, F.lit("")), F.element_at(F.split(key, "::", -1), -1))


def is_patient(node: Column, label: Column) -> Column:
    """Whether an entity is a patient, by its id or label."""
    low = F.lower(node)
    named = F.lower(F.coalesce(label, node))
    return low.startswith("pt_") | low.startswith("pt-") | low.startswith("patient_") | named.contains("pt-") | named.contains("patient")


def context_items(s: Column) -> Column:
    """The trimmed items of a list with commas."""
    return F.transform(F.split(s, ",", -1), lambda x: F.btrim(x, F.lit(" \t\n\r")))


def digits(s: Column) -> Column:
    """The digits of a string, or the string if it has none."""
    only = F.regexp_replace(s, "[^0-9]", "")
    return F.when(only == "", s).otherwise(only)


def json_slice(reply: Column) -> Column:
    """The array or object in a reply, whichever begins first, up to its last bracket; null without one."""
    obj, arr = F.instr(reply, F.lit("{")), F.instr(reply, F.lit("["))
    array = (arr > 0) & ((obj == 0) | (arr < obj))
    start = F.when(array, arr).otherwise(obj)
    back = F.reverse(reply)
    last = lambda c: F.when(F.instr(back, F.lit(c)) > 0, F.char_length(reply) - F.instr(back, F.lit(c)) + 1).otherwise(0)
    end = F.when(array, last("]")).otherwise(last("}"))
    return F.when((start > 0) & (end >= start), F.substring(reply, start, end - start + 1))


def draft_fault(key: Column, record_type: Column, parents: Column, required: Column) -> Column:
    """Why a draft breaks what holds for all drafts (null: it doesn't)."""
    none = F.size(F.coalesce(parents, F.array().cast("array<string>"))) == 0
    return (
        F.when(~F.coalesce(required, F.lit(False)), "required field missing").when(~key.contains("::"), "key without attribute")
        .when(~F.coalesce(record_type, F.lit("")).isin("asserted", "derived"), "unknown record type").when((record_type == "derived") & none, "derived without parents")
    )


def delta_label(label: Column, rationale: Column) -> tuple[Column, Column]:
    """A reply's delta in capitals, null if there is no such one, and its rationale cut to the longest string."""
    big = F.upper(F.coalesce(label, F.lit("")))
    return F.when(big.isin(*schemas.DELTAS), big), F.substring(F.coalesce(rationale, F.lit("")), 1, MAX_STRING)


def asked_entities(found: Column, query: Column) -> Column:
    """The trimmed entities of a reply that the query names, whatever the case."""
    trimmed = F.transform(found, lambda e: F.trim(e))
    return F.filter(trimmed, lambda e: e.isNotNull() & (e != "") & F.lower(query).contains(F.lower(e)))


def row_fault(subject: Column, predicate: Column, obj: Column) -> Column:
    """Why a row of an extraction is skipped (null: it isn't)."""
    from factloom.functions.text import is_value_laden

    part = lambda name, c: F.when(string_fault(c).isNotNull(), F.concat(F.lit(f"{name}: "), string_fault(c)))
    return F.coalesce(part("subject", subject), part("predicate", predicate), part("object", obj), F.when(is_value_laden(predicate), "value-laden predicate"))


def prompt(template: str, text: Column, most: int = 4192) -> Column:
    """A prompt with the first ``most`` characters of a text, its line ends as stops, in the place of {text}."""
    before, _, after = template.partition("{text}")
    return F.concat(F.lit(before), F.substring(F.replace(text, F.lit("\n"), F.lit(".")), 1, most), F.lit(after))


def served(state: Column) -> Column:
    """Whether a record in this state is given out."""
    return F.coalesce(state == "ACTIVE", F.lit(False))


def is_derived(record_type: Column, parents: Column) -> Column:
    """Whether a record was derived from others, by its type or its parents."""
    return F.coalesce(record_type == "derived", F.lit(False)) | (F.size(F.coalesce(parents, F.array().cast("array<string>"))) > 0)


def as_list(s: Column) -> Column:
    """A JSON list of strings, or the string itself as the only item; empty for nothing."""
    return F.when(F.coalesce(s, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(s, "array<string>"), F.array(s)))
