"""Surrogates for private data.

Entities are found by pattern (and checksum, where the kind has one) and get keyed replacements of
their own kind: the same entity gets the same surrogate wherever it stands (coreference), written in
the format of the mention and, for names, in its script and gender; two entities never share a surrogate, and no
surrogate is an entity of the corpus (distinctness).  For names this holds over given names and surnames together.

Names are found after a title or a label (:data:`TITLES`, :data:`LABELS`), before a title that follows
(:data:`AFTER`), as a given name of :data:`GIVEN` with a capitalised word behind it, and then wherever they stand
in the same text; other names are not found.  What is a given name anywhere is one in all the corpus; its gender is
that of the list, else the one that titles all over the corpus agree on, else unknown.  A surname's is told by its
own ending.

Three steps.  *Find* reduces the corpus to its distinct entities, and settles the genders of given names.
*Settle* computes every entity's first surrogate and groups by it: where several entities meet, or a
surrogate is itself an entity of the corpus, the least entity keeps it and the others go on to their next one,
until all are settled; later ones widen the choice.  *Rewrite* computes first surrogates on the spot and looks
up only entities that had to go on and genders that a text alone doesn't tell.

Defined cases: a null text stays null; an empty text stays empty; repeated rows are rewritten alike;
an empty table gives an empty result; other columns pass through :func:`rewrite` unchanged, whatever
their names.  Time grows with a text's length, however many entities it has.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import checkpointed, fresh, needs_stored

KEY = "corpus-surrogates-1"
#: Up to so many entities that had to go on are broadcast; more are joined through a shuffle.
BROADCAST_ENTITIES = 100_000
MAX_ROUNDS = 60

EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
PHONE = re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}|\+\d{8,15}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])")
ADDRESS = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")
CARD = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])")
NATIONAL = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
SECRET = re.compile(r"""(?i)(?<![A-Za-z])(?:token|secret|passw(?:or)?d|passwd|(?:api|access|private|secret)[_ -]?key)["']?\s*[=:]\s*["']?([A-Za-z0-9+/_.~-]{8,})""")
BARE_SECRET = re.compile(r"(?<![\w])(?:[0-9a-f]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,})(?!\w)")

#: Titles before names, with the gender that they tell (u: none).
TITLES = {
    "Mr": "m", "Mr.": "m", "Sir": "m", "Mrs": "f", "Mrs.": "f", "Ms": "f", "Ms.": "f", "Miss": "f", "Lady": "f", "Dr.": "u", "Prof.": "u", "Doctor": "u", "Professor": "u",
    "Herr": "m", "Frau": "f", "Señor": "m", "Sr.": "m", "Señora": "f", "Sra.": "f", "Monsieur": "m", "Madame": "f", "Mme": "f",
    "господин": "m", "госпожа": "f", "κύριος": "m", "κυρία": "f", "السيد": "m", "السيدة": "f",
}
#: Titles behind names.
AFTER = {"先生": "m", "女士": "f", "小姐": "f"}
#: Labels before names.
LABELS = ("Name:", "name:", "name is", "Nombre:", "Nom:")
#: Given names by script and gender, and the syllables of surnames by script.
GIVEN = {
    ("latin", "m"): "Adrian Anton Bruno Carlos Daniel David Edgar Emil Felix Gustav Henry Hugo Ivan Jakob James John Karl Leon Louis Marco Martin Oliver Oscar Paul Peter Robert Simon Thomas Victor Walter".split(),
    ("latin", "f"): "Alice Amelia Anna Clara Diana Elena Emma Eva Flora Greta Hanna Helena Ida Irene Julia Laura Lena Lucia Maria Marie Mary Nina Nora Olga Paula Rosa Sara Sofia Teresa Vera".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Игорь Михаил Николай Павел Пётр Сергей".split(),
    ("cyrillic", "f"): "Алина Анна Вера Дарья Елена Ирина Мария Надежда Ольга Светлана Софья Татьяна".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Παύλος Πέτρος Σταύρος".split(),
    ("greek", "f"): "Άννα Βασιλική Ελένη Ειρήνη Κατερίνα Μαρία Σοφία Χριστίνα".split(),
    ("arabic", "m"): "أحمد حسن خالد سعيد علي عمر محمد يوسف".split(),
    ("arabic", "f"): "زينب سارة عائشة فاطمة ليلى مريم نور هدى".split(),
}
#: Characters of Han names, which are one word: of surnames, and of given names by gender.
HAN = {"surname": "王李张刘陈杨赵黄周吴徐孙", "m": "伟强军勇杰涛明超刚平", "f": "芳娜敏静丽艳娟霞燕玲"}
SYLLABLES = {
    "latin": "bal ber bran cor dal del dor fal fen gar hal har kel lan lor mar mel mor nor pel ral ren ros sal sel tal ter val ven wal".split(),
    "cyrillic": "бал бер вал вер гал дал дор зор кал кор лав лор мал мел нор пол рад сав тал яр".split(),
    "greek": "βαλ γαλ δαλ δορ καλ κορ λαμ λορ μαλ μελ νορ παλ ραλ σαλ ταλ φαλ".split(),
    "arabic": "بد حد خل رش سل شم صب عم فر كر مج نج".split(),
}
#: The endings of surnames by script and gender (u: either), and those that tell a gender.
ENDINGS = {
    ("latin", "u"): "son man ford ley ton er ini".split(), ("cyrillic", "m"): "ов ин ев".split(), ("cyrillic", "f"): "ова ина ева".split(), ("cyrillic", "u"): ["ко"],
    ("greek", "m"): "ης ος ίδης".split(), ("greek", "f"): "ου ίδου".split(), ("greek", "u"): ["ης"], ("arabic", "u"): "ان ي".split(),
}
TELLING = {"cyrillic": (("f", ("ова", "ева", "ёва", "ина", "ая")), ("m", ("ов", "ев", "ёв", "ин", "ий", "ый"))), "greek": (("f", ("ου", "ά", "ή")), ("m", ("ης", "ος", "ας")))}
#: Scripts by code points, from and below.
SCRIPTS = (
    ("cyrillic", 0x400, 0x530), ("greek", 0x370, 0x400), ("armenian", 0x531, 0x590), ("hebrew", 0x5D0, 0x5EB), ("arabic", 0x620, 0x6D4), ("devanagari", 0x904, 0x93A), ("bengali", 0x985, 0x9BA),
    ("thai", 0xE01, 0xE2F), ("georgian", 0x10D0, 0x10FB), ("hiragana", 0x3041, 0x3097), ("katakana", 0x30A1, 0x30FB), ("han", 0x4E00, 0x9FF0), ("hangul", 0xAC00, 0xD7A4),
)

_NAME = r"[^\W\d_a-zß-öø-ÿа-яёα-ωά-ώ][^\W\d_]+"
TITLED = re.compile(rf"(?<!\w)({'|'.join(sorted(map(re.escape, (*TITLES, *LABELS)), key=len, reverse=True))}) ({_NAME}(?: {_NAME}){{0,2}})(?!\w)")
BEFORE = re.compile(rf"(?<!\w)([一-鿯]{{2,3}})({'|'.join(AFTER)})")
LISTED = {x.lower(): g for (_, g), names in GIVEN.items() for x in names}
GIVEN_NAMES = {x for names in GIVEN.values() for x in names}
CAPITALISED = re.compile(rf"(?<!\w)({_NAME}) (?=({_NAME})(?!\w))")
_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")


def _luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _iban_remainder(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _script(word: str) -> str:
    c = ord(word[0])
    return next((name for name, low, high in SCRIPTS if low <= c < high), "latin" if c < 0x370 or 0x1E00 <= c < 0x1F00 else "other")


def _surname_gender(script: str, canon: str) -> str:
    return next((g for g, ends in TELLING.get(script, ()) if canon.endswith(ends)), "u")


def plain_kind(kind: str) -> str:
    """A kind without what a text tells of a name, its part and gender: what makes an entity, together with its canonical form."""
    return f"name:{kind.split(':')[1]}" if ":" in kind else kind


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities in ``text``, in order, without overlaps."""
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray()

    def add(start: int, end: int, kind: str, canon: str) -> None:
        nonlocal taken
        if not taken:
            taken = bytearray(len(text))
        if taken.find(1, start, end) < 0:
            taken[start:end] = b"\1" * (end - start)
            found.append((start, end, kind, canon))

    digits = re.search(r"\d", text) is not None
    lower = text.lower() if "=" in text or ":" in text else ""
    if any(x in lower for x in ("token", "secret", "passw", "key")):
        for m in SECRET.finditer(text):
            add(*m.span(1), "secret", m[1])
    if digits or "sk-" in text or "AKIA" in text:
        for m in BARE_SECRET.finditer(text):
            add(*m.span(), "secret", m[0])
    if "@" in text:
        for m in EMAIL.finditer(text):
            add(*m.span(), "email", m[0].lower())
    if digits:
        for m in IBAN.finditer(text):
            plain = m[0].replace(" ", "")
            if 15 <= len(plain) <= 34 and _iban_remainder(plain) == 1:
                add(*m.span(), "iban", plain)
        for m in CARD.finditer(text):
            plain = re.sub(r"\D", "", m[0])
            if _luhn(plain) or m[0] == plain and len(plain) == 16 and plain[0] in "3456":
                add(*m.span(), "card", plain)
        for m in NATIONAL.finditer(text):
            add(*m.span(), "national", m[0].replace("-", ""))
        for m in ADDRESS.finditer(text):
            if all(int(x) < 256 for x in m[0].split(".")):
                add(*m.span(), "address", ".".join(str(int(x)) for x in m[0].split(".")))
        for m in PHONE.finditer(text):
            plain = re.sub(r"\D", "", m[0])
            if 7 <= len(plain) <= 15:
                add(*m.span(), "phone", ("+" if m[0][0] == "+" else "") + plain)
    _names(text, add)
    return sorted(found)


def _names(text: str, add) -> None:
    """Names by their titles, labels or given names, and further mentions of these names in the same text."""
    people: dict[str, str] = {}

    def person(parts: list[str], gender: str) -> None:
        for i, part in enumerate(parts):
            script = _script(part)
            if script != "han" and i == len(parts) - 1 and (len(parts) > 1 or part.lower() not in LISTED):
                kind = f"surname:{script}:{_surname_gender(script, part.lower())}"
            else:
                kind = f"given:{script}:{LISTED.get(part.lower(), gender)}"
            people.setdefault(part, kind)

    if any(x + " " in text for x in TITLES) or any(x + " " in text for x in LABELS):
        for m in TITLED.finditer(text):
            person(m[2].split(" "), TITLES.get(m[1], "u"))
    if any(x in text for x in AFTER):
        for m in BEFORE.finditer(text):
            add(*m.span(1), f"given:han:{AFTER[m[2]]}", m[1])
            people.setdefault(m[1], f"given:han:{AFTER[m[2]]}")
    for m in CAPITALISED.finditer(text):
        if m[1] in GIVEN_NAMES:
            person([m[1], m[2]], "u")
    if people:
        for m in _WORD.finditer(text):
            kind = people.get(m[0])
            if kind:
                add(*m.span(), kind, m[0].lower())


class _Stream:
    """Keyed pseudo-random choices."""

    def __init__(self, key: str, *what: object):
        self.key, self.what, self.n, self.pool = key.encode(), "\x1f".join(map(str, what)).encode(), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 4:
            self.pool = int.from_bytes(hmac.new(self.key, self.what + self.n.to_bytes(4, "big"), hashlib.sha256).digest(), "big")
            self.n, self.left = self.n + 1, 16
        self.left -= 1
        self.pool, x = divmod(self.pool, 1 << 16)
        return x % n

    def of(self, items):
        return items[self.below(len(items))]

    def like(self, text: str) -> str:
        """Letters for letters of their script and digits for digits, hexadecimal ones if all are."""
        hexadecimal = len(text) >= 16 and not set(text) - set("0123456789abcdef")

        def one(c: str) -> str:
            if hexadecimal:
                return self.of("0123456789abcdef")
            if c.isdigit():
                return self.of("0123456789")
            if c.isascii():
                return self.of("abcdefghijklmnopqrstuvwxyz") if c.islower() else self.of("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isupper() else c
            return self.letter(_script(c), c)

        return "".join(map(one, text))

    def letter(self, script: str, like: str) -> str:
        """A letter of a script, of the category of ``like``; of an unknown script one of the same 64 code points."""
        low, high = next(((a, b) for name, a, b in SCRIPTS if name == script), (ord(like) & ~63, (ord(like) | 63) + 1))
        for _ in range(64):
            c = chr(low + self.below(high - low))
            if c.isalpha() and c.islower() == like.islower():
                return c
        return like


def surrogate(kind: str, canon: str, attempt: int, key: str = KEY) -> str:
    """The canonical form of an entity's surrogate.  Later attempts widen the choice where it could run out."""
    s, extra = _Stream(key, kind, canon, attempt), max(0, attempt - 8)
    if kind == "email":
        local, _, domain = canon.partition("@")
        host = _Stream(key, "domain", domain)
        return f"{s.like(local)}{''.join(s.of('abcdefghijklmnopqrstuvwxyz') for _ in range(extra))}@{host.like(domain.split('.')[0])}.example.{host.of(['com', 'net', 'org'])}"
    if kind == "phone":
        keep = 2 if canon.startswith("+1") else 3 if canon[0] == "+" else 0
        rest = "".join(s.of("0123456789") for _ in canon[keep:])
        return canon[:keep] + s.of("23456789") + rest[1:]
    if kind == "address":
        first, second, *_ = map(int, canon.split("."))
        private = 1 if (first, second) == (192, 168) else 2 if first == 172 and 16 <= second < 32 else 3 if first == 10 else 0
        if private:  # a private network that is used up gives way to the next larger one, and the last to the reserved addresses
            private = min(4, private + extra // 4)
            head = [[192, 168], [172, 16 + s.below(16)], [10], [240 + s.below(15)]][private - 1]
            return ".".join(map(str, [*head, *(s.below(256) for _ in range(4 - len(head)))]))
        return ".".join(map(str, [1 + s.below(223), *(1 + s.below(254) for _ in range(3))]))
    if kind == "card":
        body = canon[0] + "".join(s.of("0123456789") for _ in canon[2:])
        return next(body + c for c in "0123456789" if _luhn(body + c))
    if kind == "national":
        return ("9" if extra < 4 else s.of("0123456789")) + "".join(s.of("0123456789") for _ in canon[1:])
    if kind == "iban":
        body = s.like(canon[4:])
        return f"{canon[:2]}{98 - _iban_remainder(canon[:2] + '00' + body):02d}{body}"
    if kind == "secret":
        return s.like(canon)
    part, script, gender = kind.split(":")
    if script == "han":
        given = HAN[gender] if gender != "u" else HAN["m"] + HAN["f"]
        return s.of(HAN["surname"]) + "".join(s.of(given) for _ in range(max(1, len(canon) - 1) + attempt // 6))
    if script not in SYLLABLES:
        return s.like(canon) + "".join(s.letter(script, canon[-1]) for _ in range(extra))
    if part == "given":
        names = GIVEN[script, gender] if gender != "u" else GIVEN[script, "m"] + GIVEN[script, "f"]
        return (s.of(names) + "".join("-" + s.of(names) for _ in range((attempt + 1) // 3))).lower()
    return "".join(s.of(SYLLABLES[script]) for _ in range(2 + attempt // 4)) + s.of(ENDINGS.get((script, gender)) or ENDINGS[script, "u"])


def render(mention: str, kind: str, new: str) -> str:
    """The surrogate ``new`` in the format of ``mention``."""
    if kind in ("phone", "card", "national", "iban"):
        plain = iter(new.replace("+", ""))
        return "".join(next(plain) if c.isalnum() else c for c in mention)
    if kind == "email":
        return new.upper() if mention.isupper() else new
    if ":" in kind:
        return new.upper() if len(mention) > 1 and mention.isupper() else new.title()
    return new


def _private(text: str | None, known: dict, key: str) -> tuple[str | None, int, str]:
    """The text with surrogates, the number of mentions and their kinds; ``known``: (kind, attempt) where it isn't plain."""
    found = find(text) if text else []
    if not found:
        return text, 0, ""
    out, at, made = [], 0, {}
    for start, end, kind, canon in found:
        plain = plain_kind(kind)
        new = made.get((plain, canon))
        if new is None:
            real, attempt = known.get((plain, canon)) or (_settled_kind(kind, canon), 0)
            new = made[plain, canon] = surrogate(real, canon, attempt, key)
        out += [text[at:start], render(text[start:end], kind, new)]
        at = end
    return "".join([*out, text[at:]]), len(found), ",".join(sorted({k.partition(":")[0] for _, _, k, _ in found}))


def _settled_kind(kind: str, canon: str) -> str:
    """The kind that surrogates are made by where the corpus tells no more: a given name's gender is the list's or unknown."""
    return f"{kind[:-1]}{LISTED.get(canon, 'u')}" if kind.startswith("given:") else kind


ENTITY = "plain string, canon string"


def entities(docs: DataFrame) -> DataFrame:
    """The distinct entities (plain, canon, kind, told) of the corpus; each task sends each of its entities once a batch.

    ``kind`` is what surrogates are made by.  A name that is a given name anywhere is one, with the gender of the
    list, or the one that all titles before it agree on.  ``told`` says that a text alone might not tell this.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            here = sorted({(plain_kind(k), c, k) for t in batch.column(0).to_pylist() if t for _, _, k, c in find(t)})
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in here], pa.string()) for i in range(3)], names=["plain", "canon", "kind"])

    each = docs.select(F.col("text").cast("string")).mapInArrow(run, f"{ENTITY}, kind string")
    given = F.col("kind").startswith("given:")
    gender = F.when(given & ~F.col("kind").endswith(":u"), F.right("kind", F.lit(1)))
    found = each.groupBy("plain", "canon").agg(
        F.min(gender).alias("a"), F.max(gender).alias("b"), F.min(F.when(given, F.col("kind"))).alias("given"), F.min(F.when(~given, F.col("kind"))).alias("other")
    )
    listed = F.create_map(*[F.lit(x) for pair in LISTED.items() for x in pair])
    known = F.try_element_at(listed, F.col("canon"))
    agreed = F.coalesce(known, F.when(F.col("a") == F.col("b"), F.col("a")), F.lit("u"))
    kind = F.when(F.col("given").isNull(), F.col("other")).otherwise(F.concat(F.expr("left(given, length(given) - 1)"), agreed))
    told = F.col("given").isNotNull() & (F.col("other").isNotNull() | known.isNull() & (agreed != "u"))
    return found.select("plain", "canon", kind.alias("kind"), told.alias("told"))


def _with_surrogates(found: DataFrame, key: str) -> DataFrame:
    """(plain, canon, kind, attempt, class) with the surrogate of that attempt; names are one class."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(1, 4)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(kind, canon, attempt, key) for canon, kind, attempt in rows], pa.string())], names=["plain", "canon", "kind", "attempt", "new"])

    made = found.select("plain", "canon", "kind", "attempt").mapInArrow(run, f"{ENTITY}, kind string, attempt int, new string")
    return made.withColumn("class", _class())


def _class():
    """Names of all parts, scripts and genders are one class; other kinds are their own."""
    return F.when(F.col("plain").startswith("name:"), "name").otherwise(F.col("plain"))


def settle(found: DataFrame, key: str = KEY) -> DataFrame:
    """(plain, canon, kind, attempt) for the entities whose surrogate is not their first one."""
    real = checkpointed(found)
    taken = real.select(_class().alias("class"), F.col("canon").alias("new")).distinct()
    open_ = _with_surrogates(real.withColumn("attempt", F.lit(0)), key)
    settled = None
    for _ in range(MAX_ROUNDS):
        open_ = checkpointed(open_)
        ranked = open_.groupBy("class", "new").agg(F.min(F.struct("canon", "plain")).alias("first"))
        free = ranked.join(taken, ["class", "new"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("class", "new"), ["class", "new"], "left_anti")
        won = open_.join(free.select("class", "new", "first.canon", "first.plain"), ["class", "new", "canon", "plain"], "left_semi")
        settled = checkpointed(won if settled is None else settled.unionByName(won))
        lost = checkpointed(open_.join(settled, ["plain", "canon"], "left_anti"))
        if lost.isEmpty():
            return settled.where("attempt > 0").select("plain", "canon", "kind", "attempt")
        open_ = _with_surrogates(lost.withColumn("attempt", F.col("attempt") + 1), key)
    raise RuntimeError(f"{lost.count()} entities have no surrogate after {MAX_ROUNDS} rounds")


def _apply(docs: DataFrame, text: str, names: tuple[str, str], extra: str | None, known, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text`` and the two columns ``names``; ``extra``: a row's own table of attempts."""
    inputs = [f.name for f in docs.schema if f.name != extra]
    schema = T.StructType([*(f for f in docs.schema if f.name != extra), T.StructField(names[0], T.LongType()), T.StructField(names[1], T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shared = known.value if known is not None else {}
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(extra)).to_pylist() if extra else [None] * batch.num_rows
            done = [_private(t, {(x["plain"], x["canon"]): (x["kind"], x["attempt"]) for x in o} if o else shared, key) for t, o in zip(batch.column(batch.schema.get_field_index(text)).to_pylist(), own)]
            made = {text: pa.array([d[0] for d in done], pa.string()), names[0]: pa.array([d[1] for d in done], pa.int64()), names[1]: pa.array([d[2] for d in done], pa.string())}
            yield pa.RecordBatch.from_arrays([made.get(n) if n in made else batch.column(batch.schema.get_field_index(n)) for n in [*inputs, *names]], names=[*inputs, *names])

    return docs.mapInArrow(run, schema)


def _per_row(numbered: DataFrame, row: str, again: DataFrame) -> DataFrame:
    """For each row that mentions any of the entities ``again``: the array of their kinds and attempts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            here = [(r, k, c) for r, t in zip(*(batch.column(i).to_pylist() for i in range(2))) if t for k, c in {(plain_kind(x[2]), x[3]) for x in find(t)}]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in here], pa.int64()), *(pa.array([x[i] for x in here], pa.string()) for i in (1, 2))], names=["row", "plain", "canon"])

    mentions = numbered.select(row, F.col("text").cast("string")).mapInArrow(run, f"row long, {ENTITY}")
    return mentions.join(again, ["plain", "canon"]).groupBy("row").agg(F.collect_list(F.struct("plain", "canon", "kind", "attempt")).alias("own"))


def rewrite(docs: DataFrame, key: str = KEY, names: tuple[str, str] | None = None, broadcast_entities: int = BROADCAST_ENTITIES) -> DataFrame:
    """``docs`` with surrogates for private data in ``text``.

    ``names`` adds two columns, the number of mentions and their kinds.  Entities that had to go on to
    a later surrogate or whose gender the corpus tells are few; up to ``broadcast_entities`` of them are
    broadcast, and beyond that each row gets its own through joins.  ``docs`` must come straight from stored
    files, since the rows are numbered for these joins; anything else is refused.
    """
    needs_stored(docs)
    found = checkpointed(entities(docs))
    told = found.where("told").select("plain", "canon", "kind", F.lit(0).alias("attempt"))
    again = settle(found, key)
    again = checkpointed(again.unionByName(told.join(again, ["plain", "canon"], "left_anti")))
    added = names or (fresh(docs, "_n"), fresh(docs, "_kinds"))
    typed = docs.withColumn("text", F.col("text").cast("string"))
    if again.count() <= broadcast_entities:
        known = docs.sparkSession.sparkContext.broadcast({(r["plain"], r["canon"]): (r["kind"], r["attempt"]) for r in again.toLocalIterator()})
        out = _apply(typed, "text", added, None, known, key)
    else:
        row, own = fresh(docs, "_row"), fresh(docs, "_own")
        numbered = typed.withColumn(row, F.monotonically_increasing_id())
        each = _per_row(numbered, row, again).select(F.col("row").alias(row), F.col("own").alias(own))
        out = _apply(numbered.join(each, row, "left").drop(row), "text", added, own, None, key)
    return out if names else out.drop(*added)
