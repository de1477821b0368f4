"""Readers, sinks and the writes of the gate on small cases."""

import json

from pyspark.sql import functions as F

from factloom.functions import prose
from factloom.operators import commit, extract, gate, graph, lifecycle, triples
from factloom.sources import readers, sinks


def test_triple_files(spark, tmp_path):
    files = {
        "a.txt": {"filename": "a", "item_1a": [["s", "S", "p", "o", "O"], [None, "S", "p", "o", "O"]], "item_7": [["s", "S", "p", "x", "O"]]},
        "b.txt": {"filename": "b", "item_1a": None, "item_7": [["s", "S", "p", "y", "O"]]},
    }
    for name, content in files.items():
        (tmp_path / name).write_text(json.dumps(content))
    (tmp_path / "c.txt").write_text("{not json")
    got = readers.triple_files(spark, str(tmp_path)).collect()
    assert sorted((r.file, r.subject, r.predicate, r.object) for r in got) == [("a", "s", "p", "o"), ("a", "s", "p", "x")]


def test_tickers_and_sections(spark, tmp_path):
    for t, f in (("ABC", "ABC_10-K_x.txt"), ("ABC", "sub/q.txt"), ("XYZ", "y.txt")):
        (tmp_path / t / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / t / f).write_text(f"text of {f}\nline")
    got = readers.ticker_filings(spark, str(tmp_path), ["ABC"]).collect()
    assert sorted((r.ticker, r.file, r.form, r.text) for r in got) == [("ABC", "ABC_10-K_x.txt", "10-K", "text of ABC_10-K_x.txt\nline"), ("ABC", "q.txt", "10-Q", "text of sub/q.txt\nline")]
    assert {r.text for r in readers.texts(spark, str(tmp_path / "ABC"), "*.txt").collect()} == {"text of ABC_10-K_x.txt\nline"}
    raw = spark.createDataFrame([("a", " one "), ("b", None)], "file string, item_1 string")
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "n int, file string")
    assert {r.n: r.item_1 for r in readers.section(raw, names, "item_1").collect()} == {1: "one", 2: "", 3: ""}


def test_csv_sinks_and_manifest(spark, tmp_path):
    t = spark.createDataFrame([(0, "a", "X", "p", "b", "Y")], "ordinal long, subject string, subject_type string, predicate string, object string, object_type string")
    e, r = triples.entities(t), triples.relations(t)
    sinks.triple_csv(e, r, triples.over_ids(t, e, r), str(tmp_path / "g"))
    assert readers.csv_rows(spark, str(tmp_path / "g/triples"), "entity_id_1 long, relation_id long, entity_id_2 long").collect()[0] == (0, 0, 1)
    chunks = spark.createDataFrame([(1, 'a "quoted"\nline, more')], "id long, content string")
    sinks.chunk_csv(chunks, str(tmp_path / "c"))
    assert [tuple(x) for x in readers.csv_rows(spark, str(tmp_path / "c"), "id long, content string").collect()] == [(1, 'a "quoted"\nline, more')]
    sinks.manifest(spark, str(tmp_path / "m"), {"entities": e}, cut="x")
    row = spark.read.json(str(tmp_path / "m")).first()
    assert (row.n_entities, row.cut) == (2, "x")


def test_refused_drafts(spark):
    s = "draft_id string, semantic_key string, predicate string, obj string, tier int, source_id string, valid_from timestamp, writer string, parent_ids array<string>"
    rows = [("1", "k", "p", "o", 1, "s", "w", ["r1", "r9", "r8"]), ("2", "k", "p", "o", 1, "s", " ", []), ("3", "", "p", "o", 1, "s", "", []), ("4", "k", "p", "o", 1, "s", "w", []), ("5", "lost", "p", "o", 1, "s", "w", None)]
    df = spark.createDataFrame([(*r[:6], None, *r[6:]) for r in rows], s).withColumn("valid_from", F.lit("2024-01-01").cast("timestamp"))
    known = spark.createDataFrame([("r1",), ("h",)], "record_id string")
    heads = spark.createDataFrame([("k", "h"), ("lost", "gone")], "semantic_key string, record_id string")
    df = commit.unknown_heads(commit.missing_parents(df.withColumn("writer", F.trim("writer")), known), heads, known)
    got = {r.draft_id: r.reason for r in df.select("draft_id", gate.malformed(df).alias("reason")).collect()}
    assert got == {"1": "missing parent r9", "2": "no writer identity", "3": "required field missing", "4": None, "5": "lost head gone"}


def test_approvals_recheck_the_head(spark):
    items = spark.createDataFrame([("i1", "SUPERSESSION_REVIEW", "k", "a", "1"), ("i2", "SUPERSESSION_REVIEW", "k", "a", "2"), ("i3", "SUPERSESSION_REVIEW", "j", "old", "3"), ("i4", "CONTRADICTION", "k", "a", "4")], "item_id string, kind string, semantic_key string, active_id string, draft_id string")
    approvals = spark.createDataFrame([(f"i{n}", n) for n in (2, 1, 3, 4)] + [("i9", 9)], "item_id string, seq long")
    heads = spark.createDataFrame([("k", "a", 6), ("j", "new", 1)], "semantic_key string, record_id string, owner_seq long")
    got = {r.item_id: (r.disposition, r.record_id, r.prev_id, r.owner_seq) for r in commit.approve(items, approvals, heads).collect()}
    assert got == {"i1": ("AUTO_COMMIT", "rec_1", "a", 7), "i2": ("QUEUE_SYSTEM_2", None, None, None), "i3": ("QUEUE_SYSTEM_2", None, None, None)}


def test_reverts_write_heads_states_edges_and_flags(spark):
    import datetime

    day = datetime.datetime(2024, 1, 1)
    records = spark.createDataFrame([("v0", "z", 4, day), ("v1", "z", 4, day), ("u", "y", 0, day)], "record_id string, semantic_key string, tier int, created_at timestamp")
    states = spark.createDataFrame([("v0", "ARCHIVED"), ("v1", "ACTIVE")], "record_id string, state string")
    heads = spark.createDataFrame([("z", "v1", 5)], "semantic_key string, record_id string, owner_seq long")
    asked = spark.createDataFrame([("z", "v0", "SYSTEM_1"), ("z", "v1", "SYSTEM_2"), ("z", "none", "SYSTEM_2"), ("y", "u", "SYSTEM_1"), ("y", "u", "SYSTEM_2"), ("y", "v0", "SYSTEM_2")], "semantic_key string, target_id string, actor string")
    got = commit.revert(asked, records, states, heads, F.lit("2024-02-01").cast("timestamp"), 365)
    assert sorted((r.semantic_key, r.target_id, r.fault or "", r.moved, r.from_id or "", -1 if r.owner_seq is None else r.owner_seq) for r in got.collect()) == sorted([
        ("z", "v0", "", True, "v1", 6), ("z", "v1", "not archived", False, "", -1), ("z", "none", "unknown record", False, "", -1), ("y", "u", "needs SYSTEM_2", False, "", -1), ("y", "u", "", True, "", 0), ("y", "v0", "other key", False, "", -1),
    ])
    deps = spark.createDataFrame([("v1", "c"), ("v1", "d")], "parent string, child string")
    current = spark.createDataFrame([("c", "ACTIVE", 3), ("d", "ARCHIVED", 2)], "record_id string, state string, tier int")
    w = commit.revert_writes(got.where("semantic_key = 'z'"), deps, current)
    assert [tuple(r) for r in w["heads"].collect()] == [("z", "v0", 6)] and sorted(map(tuple, w["states"].collect())) == [("v0", "ACTIVE"), ("v1", "ARCHIVED")]
    assert [tuple(r) for r in w["edges"].collect()] == [("v0", "v1", "REVERTED_FROM")] and [tuple(r) for r in w["flagged"].collect()] == [("c", "v1", "SYSTEM_1")]
    # heads follow from their moves
    assert lifecycle.heads(heads.unionByName(w["heads"].select("semantic_key", "record_id", "owner_seq"))).first().record_id == "v0"


def test_entities_and_parents(spark):
    s = "record_id string, prev_id string, parent_ids array<string>, subject_ref string, subject_label string, subject_type string, object_ref string, object_label string, object_type string, arrival long"
    rows = [("r1", None, ["p", "p"], "a", "A", "", "b", "B", "T", 1), ("r2", "r1", None, "a", "A2", "PERSON", None, None, None, 2), ("r3", None, ["r1"], "r1", "clash", "", "a", "late", "LATE", 3)]
    df = spark.createDataFrame(rows, s)
    known, clashes = commit.entities(df)
    assert {r.entity: (r.label, r.entity_type) for r in known.collect()} == {"a": ("A", "PERSON"), "b": ("B", "T")} and [r.entity for r in clashes.collect()] == ["r1"]
    edges = commit.edges(df)
    assert sorted((r.src, r.dst, r.kind) for r in edges.collect()) == sorted([("r1", "a", "SUBJECT"), ("r1", "b", "OBJECT"), ("r1", "p", "DERIVED_FROM"), ("r2", "r1", "SUPERSEDES"), ("r2", "a", "SUBJECT"), ("r3", "r1", "SUBJECT"), ("r3", "a", "OBJECT"), ("r3", "r1", "DERIVED_FROM")])
    assert [tuple(r) for r in commit.materialised(edges, df).collect()] == [("p", "ARCHIVED")]
    assert {r.node_id: r.state for r in lifecycle.states(commit.audit(df)).collect()} == {"r1": "ARCHIVED", "r2": "ACTIVE", "r3": "ACTIVE"}


def test_lineage_checks(spark):
    reached = spark.createDataFrame([("x", "x", 0), ("x", "y", 1)], "root string, node string, depth int")
    wanted = spark.createDataFrame([("x", "y"), ("w", "y")], "root string, node string")
    assert {r.root: r.derives for r in graph.derives_from_all(reached, wanted).collect()} == {"x": True, "w": False}
    asked = spark.createDataFrame([("x", "a"), ("x", "b")], "root string, semantic_key string")
    found = spark.createDataFrame([("x", "a")], "root string, semantic_key string")
    assert [(r.root, r.missing) for r in graph.incomplete(asked, asked, found).collect()] == [("x", ["b"])]


def test_reply_variants():
    five = "('a', 'X', 'has_age', 'b', 'Y')"
    assert extract.parse_plain(f"[{five}, ('x',)]") == [("a", "X", "has_age", "b", "Y")] and extract.parse_plain("no") is None and extract.parse_plain("['abcde']") == [tuple("abcde")]
    assert extract.parse_plain("[1]") is None and extract.parse_plain(None) is None
    assert extract.parse_bracketed(f"{five}, {five}]") == [("a", "X", "has_age", "b", "Y")] * 2 and extract.parse_bracketed("oops") is None


def test_prose(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(prose.company_named(F.lit("We sold our shares to us and the Company left."), F.lit("Acme"))) == "Acme sold Acme's shares to Acme and Acme left."
    assert one(prose.patient_named(F.lit(" The patient said the patient slept. "), F.lit("P1"))) == "P1 said P1 slept."
    assert one(prose.sentences(F.lit("One. Two!  Three? four"))) == ["One.", "Two!", "Three?", "four"]
    assert one(prose.sentence_with(prose.sentences(F.lit("A cat. The dog. A dog.")), ("dog",), last=True)) == "A dog."
    assert one(prose.repaired(F.lit("Ünï\\ncödé — ok"))) == "Uni\ncode  ok"
    assert one(prose.json_slice(F.lit('x {"a": [1]} y'))) == '{"a": [1]}' and one(prose.json_slice(F.lit("none"))) is None
    assert one(prose.as_list(F.lit('["a","b"]'))) == ["a", "b"] and one(prose.as_list(F.lit("a"))) == ["a"] and one(prose.as_list(F.lit(""))) == []


def test_scored_replies(spark):
    five = "('a', 'X', 'Has_Age', 'b', 'Y')"
    whole, three = ("a", "X", "Has_Age", "b", "Y"), ("s", "UNKNOWN", "p", "o", "UNKNOWN")
    cases = [
        (f"[{five}]", True, True, [whole]), (f"Well:\n```\n[{five}, ('s', 'p', 'o')]\n```", False, False, [whole, three]), ("nothing", False, False, []), ("[]<|eot_id|>x", True, False, []), (None, False, False, []), ("", False, False, []),
        (f"first ```x``` then ```python\n[{five}]``` end", False, True, [whole]), (f"```python [{five}]", False, True, [whole]), (f"so [{five}] it is", False, True, [whole]), ("] [", False, False, []), (f" [{five}, 7, 'abcde', [1, 2]] ", True, True, [whole]),
        ("[(None, 1, 'x', 2.5, ' y ')]", True, False, [("None", "1", "x", "2.5", "y")]), ("```\n```", False, False, []), ("{'a': 1}", False, False, []), ("[" * 300, False, False, []),
    ]
    df = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)], "id int, reply string, strict_ string")
    for r in extract.parse_scores(df).collect():
        assert (r.strict, r.standard, [tuple(t) for t in r.triples]) == cases[r.id][1:], cases[r.id][0]
