"""Removal of repeated passages against all windows of all documents."""

import collections
import hashlib
import random
import re

import pytest

from factloom.llm import passages, queries


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, window):
    """(doc_id, number of words, removed words, kept words) for each of ``rows`` (doc_id, text)."""
    least = {}
    for d, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1 if d is not None else 0):
            key = tuple(w[i : i + window])
            least[key] = min(d, least.get(key, d))
    out = []
    for d, text in rows:
        w = words(text)
        gone = {p for i in range(len(w) - window + 1 if d is not None else 0) if least[tuple(w[i : i + window])] < d for p in range(i, i + window)}
        out.append((d, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return collections.Counter(out)


def removed(df, window):
    return collections.Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in passages.remove(df, window).collect())


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query(spark, folder):
    d = f"/root/testdata/{folder}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = collections.Counter((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(rows, 50))
    got = queries.op12_passages(spark, d).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(r.n_removed for r in got) > 1000


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("window", [6, 9, 20])
def test_planted_passages(spark, seed, window):
    rng = random.Random(seed)
    some = lambda n: [rng.choice("abcdefg") + str(rng.randrange(40)) for _ in range(n)]
    shared = [some(rng.randrange(window - 1, 4 * window)) for _ in range(6)] + [some(2) * 40]
    rows = []
    for d in range(60):
        text = some(rng.randrange(0, 30))
        for _ in range(rng.randrange(4)):
            a = rng.choice(shared)
            i = rng.randrange(len(a) // 2)
            text += a[i : rng.randrange(i, len(a) + 1)] + some(rng.choice([0, 1, 5, 30]))
        rows.append((d % 50, rng.choice([" ", "\n", " \t "]).join(text)))
    rows += [(70 + i, rows[5][1]) for i in range(5)] + [(80 + i, f"w{i} " + rows[5][1]) for i in range(5)] + [(3, rows[3][1]), (3, rows[3][1])]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert removed(df, window) == brute(rows, window)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    unlike = " ".join(f"é{i} {i}\x1c" for i in range(80))
    rows = [(1, None), (2, ""), (3, " \n"), (None, long), (None, long), (4, "x " * 60), (5, "x " * 49), (6, "x " * 200), (6, "y " * 60), (7, "y " * 60), (-5, unlike), (8, "\x0b" + unlike), (9, long[200000:] + " tail"), (10, long), (10, long), (11, "one " + long[:5000] + " two")]
    df = spark.createDataFrame([(d, t, "d", [1], "r", "s", "w", "w") for d, t in rows], "doc_id long, text string, d string, th array<int>, runs string, starts string, n_words string, K string").repartition(3)
    got = passages.remove(df)
    assert got.columns == [*df.columns, "n_words_", "n_removed"]
    assert collections.Counter((r.doc_id, r.n_words_, r.n_removed, r.text) for r in got.collect()) == brute(rows, 50)
    assert passages.remove(df.limit(0)).count() == 0


def test_covers():
    for period, cover in passages.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert passages.plan(50) == (31, 20)


def test_copies_cost_no_windows(spark):
    """Only the borders of passages are open: whole copies and the insides of passages are settled by their contexts."""
    rng = random.Random(1)
    some = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    text, passage = some(3000), some(2000)
    rows = [(i, text) for i in range(40)] + [(100 + i, f"{some(300)} {passage} {some(300)}") for i in range(10)]
    keyed = spark.createDataFrame([(d, hash(t), t) for d, t in rows], "d long, th long, text string").repartition(7)
    found = {r.d: r for r in passages.anchors(keyed).collect()}
    assert all(not found[i].opens and found[i].runs for i in range(1, 40)) and 0 not in found
    assert all(0 < len(found[100 + i].opens) <= 2 * 12 for i in range(10))


def test_slices():
    text = ("ab " * 10 + "c" * 50 + "\n") * 60000
    parts = list(passages.split(text.encode()))
    assert len(parts) > 3 and [w for p in parts for w in p] == text.encode().split()
    assert [w for p in passages.split(b"x" * (3 << 20)) for w in p] == [b"x" * (3 << 20)]


def test_texts_and_windows_that_meet_nothing_stay(spark, monkeypatch):
    """Only texts with open anchors or with something to take out are shuffled; of windows that many documents share a task passes on one document's."""
    rng = random.Random(2)
    some = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    passage = some(120)
    rows = [(i, some(200)) for i in range(200)] + [(300 + i, f"{some(60)} {passage} {some(60)}") for i in range(30)] + [(None, some(80))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keyed = df.where("doc_id is not null").selectExpr("doc_id as d", "xxhash64(text) as th", "text")
    told = passages.anchors(keyed)
    met, rest = passages._sides(keyed, ["d", "th"], told, ["d", "th"], 1000)
    assert {r.d for r in met.collect()} == set(range(300, 330)) and rest.count() == 200
    assert passages._sides(keyed, ["d", "th"], told, ["d", "th"], 5)[0].count() == 230
    shared = keyed.where("d >= 300").coalesce(1).join(told.where("size(opens) > 0").select("d", "th", "opens"), ["d", "th"]).coalesce(1)
    windows = shared.mapInArrow(passages._windows(50), "h1 long, h2 long, d long, th long, at int, to int").collect()
    by_hash = collections.Counter((r.h1, r.h2) for r in windows if not r.to)
    assert set(by_hash.values()) == {1} and sum(1 for r in windows if r.to) >= 29
    monkeypatch.setattr(passages, "HELD", 100)
    for most in (1000, 0):
        got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in passages.remove(df, 50, most).collect())
        assert got == brute(rows, 50)
