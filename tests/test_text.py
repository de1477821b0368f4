"""Text functions on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.sources import readers


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("  Max Building-Height ", "max_building_height"), ("***", "unknown"), ("", "unknown"), ("é a", "a")])
def test_slug(spark, raw, want):
    assert one(spark, tx.slug(F.col("s")), s=raw) == want


def test_keys(spark):
    assert one(spark, tx.semantic_key(F.lit("Sector 4"), F.lit("Max Qty"))) == "sector_4::maximum_quantity"
    assert one(spark, tx.semantic_key(F.lit("A"), F.lit("likes"), F.lit("Max"))) == "a::likes::max"


@pytest.mark.parametrize("p, want", [("Age", True), ("has age", True), ("Max Building Height", True), ("presents with", False), ("has_cat", False)])
def test_functional(spark, p, want):
    assert one(spark, tx.is_functional(F.col("p")), p=p) is want


@pytest.mark.parametrize("o, t, want", [("Fever", "", True), ("10%", "", False), ("10%", "METRIC", True), ("  ", "X", False)])
def test_entity_shape(spark, o, t, want):
    assert one(spark, tx.is_entity_shaped(F.col("o"), F.col("t")), o=o, t=t) is want


@pytest.mark.parametrize("p, want", [("sets max height", False), ("sets max height to 45 stories", True), ("a b c d e f g", True), ("valid as of today", True), ("x 4", False)])
def test_value_laden(spark, p, want):
    assert one(spark, tx.is_value_laden(F.col("p")), p=p) is want


@pytest.mark.parametrize("s, want", [("ok", None), (" ", "empty"), ("N/A", "placeholder"), ("x" * 513, "too long"), (None, "missing")])
def test_string_fault(spark, s, want):
    assert one(spark, tx.string_fault(F.col("s").cast("string")), s=s) == want


@pytest.mark.parametrize("k, want", [("pt::has_sex", "pt::hasgender"), ("a::cities", "a::city"), ("a::class", "a::class"), ("a::items", "a::item")])
def test_alias_norm(spark, k, want):
    assert one(spark, tx.alias_norm(F.col("k")), k=k) == want


def test_chunks(spark):
    assert one(spark, tx.chunks(F.lit(" abcdefg "), 3)) == ["abc", "def", "g"]
    assert one(spark, tx.chunks(F.lit("  "))) == []
    assert one(spark, tx.chunks(F.lit(None).cast("string"))) == []


def test_between(spark):
    assert one(spark, tx.between(F.lit("x <a>one</a>"), "<a>", "</a>")) == "<a>one"
    assert one(spark, tx.between(F.lit("x <a>one"), "<a>", "</a>")) == "<a>one"
    assert one(spark, tx.between(F.lit("x"), "<a>", "</a>")) == ""


@pytest.mark.parametrize("raw, want", [("[[60.0, 'year']]", "60 years"), ("[[1.0, 'year']]", "1 year"), (" young ", "young")])
def test_age(spark, raw, want):
    assert one(spark, tx.age_text(F.col("a")), a=raw) == want


def test_hints(spark):
    assert one(spark, tx.condition_hint(F.lit("He had Sepsis and stroke"))) == "sepsis"
    assert one(spark, tx.condition_hint(F.lit("well"))) == ""
    assert one(spark, tx.asks_for_history(F.lit("What was the PRIOR dose?"))) is True
    assert one(spark, tx.judge_score(F.lit("Evaluation: fine Total rating: 4.5"))) == 4.5
    assert one(spark, tx.judge_evaluation(F.lit("Evaluation:\n fine \nTotal rating: 4"))) == "fine"
    assert one(spark, tx.judge_evaluation(F.lit("?"))) == "no match found"
    assert one(spark, tx.reward_map(F.lit("help:1.5,true:2"))) == {"help": 1.5, "true": 2.0}
    assert one(spark, tx.reward_map(F.lit("helpfulness:abc,a:1,a: 2 ,b,,c:1:2"))) == {"helpfulness": None, "a": 2.0, "b": None, "c": 1.0}
    assert one(spark, tx.reward_map(F.lit(""))) == {} and one(spark, tx.reward_map(F.lit(None).cast("string"))) is None
    assert one(spark, tx.age_text(F.lit("[[99999999999999999999999.5, 'year']]"))) == "99999999999999999999999 years" and one(spark, tx.age_text(F.lit("[[007, 'day']]"))) == "7 days"


@pytest.mark.parametrize("tier, c, want", [(0, 0, 1.0), (4, 0, 5.0), (4, 3, 2.5), (2, 8, 1.0), (0, -1, 1.0)])
def test_distance(spark, tier, c, want):
    assert one(spark, tx.distance(F.lit(tier), F.lit(c))) == pytest.approx(want)
    assert one(spark, tx.edge_length(F.lit(want))) == min(max(want, 0.1) * 40, 400)


def test_record_id(spark):
    ids = [one(spark, tx.record_id(F.lit("k"), F.lit("o"), F.lit("p"), F.lit("w"), F.array(*map(F.lit, parents)), F.lit(0))) for parents in (["a", "b"], ["b", "a"], ["a"])]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 36


def test_policies(spark):
    items = spark.createDataFrame([("policy:hr",), ("arxiv",), ("fax:1",), ("statute:7:1",)], "source_id string")
    over = spark.createDataFrame([("statute:7:1", 2, True, "x", 1), ("policy", 0, True, "a", 1), ("policy", 3, True, "b", 2)], "source string, tier int, auto_update boolean, tag string, seq long")
    got = {r.source_id: (r.tier, r.auto_update, r.tag) for r in readers.with_policy(items, readers.policies(spark, over)).collect()}
    assert got == {"policy:hr": (3, True, "b"), "arxiv": (2, True, "external"), "fax:1": (4, True, "observational"), "statute:7:1": (2, True, "x")}


def test_conversation(spark):
    rows = spark.createDataFrame([(1, 1, None, "b"), (1, 0, "user", None)], "conv_id long, turn long, role string, text string")
    assert readers.conversation_texts(rows).first().text == "user: \n?: b"


def test_readers(spark, tmp_path):
    (tmp_path / "e.json").write_text('[{"patient_id": "P1", "description": "", "emr_documents": [{"doc_id": "d1", "timestamp": "2026-01-02T03:04:05Z", "author_role": "Physician", "document_type": "n", "content": "c"}]}]')
    row = readers.emr_documents(spark, str(tmp_path / "e.json"), {"Physician": 1}).first()
    assert (row.patient_id, row.tier, row.valid_from.year) == ("P1", 1, 2026)
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in readers.json_lines(spark, str(tmp_path / "l.jsonl"), "a long").collect()) == [1, 2]
    (tmp_path / "r.csv").write_text('a,b\n1,"x, y"\n2\n3,z\n')
    assert sorted((r.a, r.b) for r in readers.csv_rows(spark, str(tmp_path / "r.csv"), "a int, b string").collect()) == [(1, "x, y"), (3, "z")]
    html = F.lit("<title> T </title><script>x</script><p>a &amp; b</p><ix:nonNumeric name='dei:Cik'>007</ix:nonNumeric>")
    got = spark.range(1).select(readers.visible_text(html).alias("v"), readers.tag_text(html, "title").alias("t"), readers.tagged_value(html, "dei:Cik").alias("c"), readers.tagged_value(html, "none").alias("n")).first()
    assert (got.v, got.t, got.c, got.n) == ("T a & b 007", "T", "007", None)


def test_clinical_policies(spark, tmp_path):
    docs = [{"doc_id": f"d{i}", "timestamp": t, "author_role": r, "document_type": "n", "content": "c"} for i, (r, t) in enumerate([("Nephrologist", "2026-01-02T03:04:05Z"), ("Triage_Nurse", "not a time"), ("Porter", None)])]
    (tmp_path / "e.json").write_text(json.dumps([{"patient_id": "P1", "description": "", "emr_documents": docs}]))
    got = {r.doc_id: (r.tier, r.valid_from is None) for r in readers.emr_documents(spark, str(tmp_path / "e.json")).collect()}
    assert got == {"d0": (1, False), "d1": (2, True), "d2": (4, True)}
    items = spark.createDataFrame([("Triage_Nurse:7",), ("statute:1",), ("Radiologist",), ("Porter:2",)], "source_id string")
    rows = {r.source_id: (r.tier, r.auto_update, r.tag) for r in readers.with_policy(items, readers.clinical_policies(spark)).collect()}
    assert rows == {"Triage_Nurse:7": (2, True, "clinical_triage"), "statute:1": (0, False, "canonical"), "Radiologist": (1, True, "clinical_imaging"), "Porter:2": (4, True, "observational")}
    assert readers.clinical_policies(spark).count() == len(readers.POLICIES) + len(readers.CLINICAL_POLICIES)
