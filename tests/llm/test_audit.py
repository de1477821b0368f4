"""The filter audit against a simulation of every order, document by document."""

import collections
import itertools
import random
import re

import pytest

from factloom.llm import audit


def masks(rows):
    """(part, failed letters, doc_id) by the definitions, one document at a time."""
    out = []
    for doc_id, text, source in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows),
        }
        out.append((source or "", {k for k, v in failed.items() if v}, doc_id))
    return out


def simulate(rows, labels):
    good, toxic = ({d for d, *x in labels if x[i] == 1 and d is not None} for i in (0, 1))
    found = masks(rows)
    out, shapley = {}, collections.Counter()
    for part in {p for p, _, _ in found}:
        own = [(f, d) for p, f, d in found if p == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [y for y in left if x in y[0]]
                left = [y for y in left if x not in y[0]]
                shapley[part, x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(x in f for f, _ in own) - len(gone), sum(f == {x} for f, _ in own), sum(d in good for _, d in gone), sum(d in toxic for _, d in gone)]
    return {(p, o, s): tuple(v + [shapley[p, o[s - 1]]]) for (p, o, s), v in out.items()}


def audited(docs, labels):
    rows = audit.audit(docs, labels).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert audited(docs, labels) == simulate([(r.doc_id, r.text, r.source) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40000))
    rows = [
        (1, None, None), (2, "", "a"), (3, "", ""), (None, "", "a"), (None, "", "a"), (4, "A b", "a"), (4, "A b", "a"), (5, "A b", "b"), (6, long, "b"), (7, long, "b"), (7, long, "a"), (8, "x " * 400, "é"),
        (9, "# " + long, "b"), (10, "a b c\x1cd \x0b\x0c e", "a"), (11, long + "\u0000É", "b"), (6, "other text", "b"), (12, "ÀÉÎ " * 300, "a"),
    ]
    labels = [(6, 1, 0), (6, 0, 1), (4, 0, 1), (None, 1, 1), (5, None, 1), (8, 1, None), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id int, text string, source string, part string, n int").repartition(3)
    marks = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, text string")
    assert audited(docs, marks) == simulate(rows, labels)
    assert audited(docs.limit(0), marks) == {} and len(audited(docs, marks.limit(0))) == 600 * 4


def test_diagram_of_any_masks():
    rng = random.Random(4)
    for _ in range(20):
        counts = {m: (rng.randint(1, 3), rng.randint(0, 1), rng.randint(0, 1)) for m in rng.sample(range(32), rng.randint(0, 32))}
        got = {(o, k): x for o, k, *x in audit.steps(counts)}
        assert len(got) == 600
        for (order, k), (kept, removed, *_) in got.items():
            bits = [1 << "ABCDE".index(x) for x in order]
            before = [(m, w) for m, w in counts.items() if not m & sum(bits[: k - 1])]
            assert kept == sum(w[0] for m, w in before if not m & bits[k - 1]) and removed == sum(w[0] for m, w in before if m & bits[k - 1])


def test_equal_parts_are_shared_and_swaps_are_undone():
    d = audit.Diagram({m: (1, 0, 0) for m in range(32)}, 5)
    assert [len(x) for x in d.levels] == [1] * 5
    before, edges = d.all_pass(), [set(x) for x in d.levels]
    d.swap(2)
    assert d.order == [0, 1, 3, 2, 4]
    d.swap(2)
    assert d.all_pass() == before and [len(x) for x in d.levels] == [len(x) for x in edges]


@pytest.mark.parametrize("n", range(1, 7))
def test_plain_changes(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for at in audit.plain_changes(n):
        order[at : at + 2] = order[at + 1], order[at]
        seen.add(tuple(order))
    assert len(seen) == len(list(itertools.permutations(range(n)))) == len(audit.plain_changes(n)) + 1
