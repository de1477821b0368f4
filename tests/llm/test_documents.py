"""The document operators against brute force, and on the cases that break things."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from factloom.llm import licenses, mixing, nbest, ordinal, pii, rules, simhash, tokencount

SCHEMA = "doc_id long, text string, source string, M string, _ROW string, _words string, row string, f string, words string, label string, n_words string, _m string"
LONG = "word and another thing " * 30000
ROWS = [
    (1, None, "a"), (2, "", None), (3, " \n\t ", "b"), (4, "one", "a"), (5, "one two", "a"), (6, LONG, "a"), (6, LONG, "a"), (7, "Tie tie. " * 9, None),
    (None, "no id here at all", "b"), (None, "no id here at all", "b"), (8, "same text for three rows of it", "a"), (9, "same text for three rows of it", "c"), (10, "same text for three rows of it", "a"),
    (11, "Ünïcödé — ▁ text\u0000 with “marks” and 日本語 😀", "é"), (12, "call +1 (555) 201-3824 or mail Ann.Lee@Example.com, card 4111 1111 1111 1111", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *["x"] * 9) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ids(df):
    return collections.Counter(r.doc_id for r in df.select("doc_id").collect())


# --- quality rules


def measured(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_rules_measure(request, which):
    df = request.getfixturevalue(which)
    want = collections.Counter((r.doc_id, *measured(r.text)) for r in df.select("doc_id", "text").collect())
    got = rules.judge(df).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)


def test_rules_keep(docs, odd):
    for df in (docs, odd):
        kept = rules.keep(df)
        assert kept.columns == df.columns and kept.schema == df.schema
        assert ids(kept) == ids(rules.judge(df).where("kept"))
    assert rules.keep(docs.limit(0)).count() == 0 and rules.judge(docs.limit(0)).count() == 0


def test_rules_against_labels(docs, spark, sf):
    met = rules.judge(docs).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, junk = ([r.kept for r in met if r.quality == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.98
    assert not junk or sum(junk) / len(junk) < 0.15


def test_rules_on_more_documents(spark):
    path = "/root/testdata/sf0.01"
    met = rules.judge(spark.read.parquet(f"{path}/documents.parquet")).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, junk = ([r.kept for r in met if r.quality == q] for q in (1, 0))
    assert len(junk) > 20 and sum(good) / len(good) > 0.99 and sum(junk) / len(junk) < 0.1
    # several good votes outweigh a single bad one, so that this isn't all-must-pass filtering
    assert any(r.kept and -1 in r.votes for r in met) or not any(r.votes.count(-1) == 1 for r in met)


def test_one_bad_vote_among_good_ones(spark):
    n = len(rules.RULES)
    good, odd, junk = [1] * n, [1] * n, [1] * n
    odd[rules.RULES.index("sentences")] = -1  # prose of a script without these stops
    for r in ("symbols", "marks"):
        junk[rules.RULES.index(r)] = -1
    df = spark.createDataFrame([(v,) for v, k in ((good, 900), (odd, 15), (junk, 60)) for _ in range(k)], "v array<int>")
    counts = rules.fit(df)
    p = lambda v: posterior(counts, v)[0]
    assert p(good) > 0.99 and p(odd) > 0.5 > 0.05 > p(junk)
    assert rules.accuracies(counts)["signs"]["marks"] > 0.7 and rules.accuracies(counts)["good"]["marks"] < 0.02


def posterior(counts, v):
    import math

    total = sum(c[0] for c in counts)
    odds = []
    for c in counts:
        one = math.log(c[0] / total)
        for j, x in enumerate(v):
            if x:
                one += math.log(c[2 * j + (1 if x == -1 else 2)] / (c[2 * j + 1] + c[2 * j + 2]))
        odds.append(one)
    e = [math.exp(o - max(odds)) for o in odds]
    return [x / sum(e) for x in e]


def em(patterns, rounds):
    """Expectation-maximisation in plain Python."""
    prior = rules.priors()
    counts = prior
    for _ in range(rounds):
        new = [list(row) for row in prior]
        for v, n in patterns:
            for row, p in zip(new, posterior(counts, v)):
                row[0] += n * p
                for j, x in enumerate(v):
                    if x:
                        row[2 * j + (1 if x == -1 else 2)] += n * p
        counts = new
    return counts


def test_rules_estimates(spark):
    n = len(rules.RULES)
    patterns = [([1] * n, 500), ([1, 1, -1] + [1] * (n - 3), 40), ([0] * n, 7), ([-1] * n, 20), ([1, 0, 0, -1] + [1] * (n - 4), 33)]
    df = spark.createDataFrame([(v,) for v, k in patterns for _ in range(k)], "v array<int>")
    for got, want in zip(rules.fit(df), em(patterns, rules.ROUNDS)):
        assert got == pytest.approx(want, rel=1e-9)


# --- SimHash


def fingerprint(text):
    from xxhash import xxh64_intdigest

    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(rows):
    prints = {t: fingerprint(t) for t in {t for _, t in rows}}
    each = list(set(prints.values()))
    root = {f: f for f in each}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(each):
        for b in each[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, t in rows:
        r = find(prints[t])
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return collections.Counter((d, f"{prints[t]:016x}", least[find(prints[t])]) for d, t in rows)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_simhash(request, which):
    df = request.getfixturevalue(which)
    want = grouped([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert collections.Counter(map(tuple, simhash.group(df).collect())) == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert ids(kept) == collections.Counter({c for _, _, c in want})
    # the way beyond the size that is broadcast
    assert ids(simhash.keep_one(df, broadcast_rows=0)) == ids(kept)


def jaccard_groups(rows, least=0.8, k=5):
    """The least doc_id of each row's component of texts with a Jaccard similarity of at least ``least``."""

    def shingles(text):
        w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and len(a & b) >= least * len(a | b):
                root[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        names[r] = d if names.get(r) is None else names[r] if d is None else min(d, names[r])
    return collections.Counter(names.values())


def test_near_copies_by_similarity(spark, docs, odd, tmp_path):
    import random

    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for n in range(90):  # near copies with one to three words changed, some 0.8 alike or more and some less
        w = list(base) if n < 60 else [f"v{n % 5}_{i}" for i in range(120)]
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((10_000 + n, " ".join(w)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "near"))
    odd.write.parquet(str(tmp_path / "odd"))
    far = []  # edits of one text by so many words that only some reach it, and some only each other
    for n in range(260):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = rng.choice(["the", "and", "of", f"y{rng.randrange(10**6)}"])
        far.append((20_000 + n, " ".join(w)))
    far += [(21_000 + n, t.replace(" the ", " a ", 1)) for n, (_, t) in enumerate(far[:80])]
    spark.createDataFrame(far, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "far"))
    for df in (docs, *(spark.read.parquet(str(tmp_path / x)) for x in ("near", "odd", "far"))):
        want = jaccard_groups([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
        for rows_ in (1_000_000, 0):
            kept = simhash.keep_one(df, broadcast_rows=rows_, shingle=5, similarity=0.8)
            assert kept.columns == df.columns and ids(kept) == want
    assert simhash.keep_one(docs.limit(0), shingle=5, similarity=0.8).count() == 0


def test_near_copies_meet_by_fingerprints(spark, tmp_path, monkeypatch):
    """The stage on similarity goes through fingerprints and the grid first: each set meets one that is at most two bits away."""
    import random

    import corpus_pipeline as cp

    rng = random.Random(8)
    base = [[f"w{b}_{i}" for i in range(900)] for b in range(3)]
    rows = []
    for n in range(90):
        w = list(base[n % 3])
        w[rng.randrange(len(w))] = f"x{n % 40}"
        rows.append((n, " ".join(w)))
    rows += [(100 + n, f"only {n} stands here") for n in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    points = simhash.shingle_sets(df.selectExpr("doc_id", "doc_id as row", "text"), 5, True).selectExpr("doc_id as id", "s")
    s = {r.id: r.s for r in points.collect()}
    apart = lambda a, b: ((s[a] ^ s[b]) & (2**64 - 1)).bit_count()
    pairs = [(r.u, r.v) for r in simhash.by_prints(points).collect()]
    assert all(u < v and apart(u, v) <= 2 for u, v in pairs) and len(pairs) <= len(rows)
    near = {i for i in s if any(i != j and apart(i, j) <= 2 for j in s)}
    assert len(near) > 40 and {i for p in pairs for i in p} == near
    seen, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **b: seen.append(1) or links(*a, **b))
    assert ids(cp.distinct(spark, df, None)) == jaccard_groups(rows) and seen


def test_near_duplicate_stage(spark, sf, docs):
    import corpus_pipeline as cp

    assert ids(cp.distinct(spark, docs, sf)) == jaccard_groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_links_of_near_fingerprints(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base:
        for k in (1, 2, 3):
            x = b
            for bit in rng.sample(range(64), k):
                x ^= 1 << bit
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    got = [(r.u, r.v) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "f long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_long_chain_is_one_component(spark):
    from factloom.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 999), (5, 5), (999, 1000)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {999: 999, 1000: 999}
    assert components(edges.limit(0)).count() == 0


def test_few_links_leave_few_files(spark, monkeypatch):
    """What a few edges leave on disk doesn't follow the session's number of partitions; more edges take the same shuffles without broadcasts."""
    from factloom.llm import components as c

    rows = [(10 * n + 1, 10 * n + 2) for n in range(30)] + [(10 * n + 2, 10 * n + 3) for n in range(30)] + [(5, 400 + n) for n in range(40)]
    want = {x: 10 * n + 1 for n in range(30) for x in (10 * n + 1, 10 * n + 2, 10 * n + 3)} | dict.fromkeys([5, *range(400, 440)], 5)
    edges = spark.createDataFrame(rows, "u long, v long")
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        before = disk.getAllFiles().size()
        assert {r.node: r.root for r in c.components(edges).collect()} == want
        assert disk.getAllFiles().size() - before < 6 * 64
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    monkeypatch.setattr(c, "BROADCAST_ROWS", 0)
    assert {r.node: r.root for r in c.components(edges).collect()} == want


def test_near_copies_without_broadcast_roots(spark, sf, docs, monkeypatch):
    """Roots that are too many to be broadcast meet the cells through a shuffle: the same documents stay."""
    from factloom.llm import components as c

    kept = ids(simhash.keep_one(docs, shingle=5, similarity=0.8))
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(c, "BROADCAST_ROWS", -1)
    assert ids(simhash.keep_one(docs, shingle=5, similarity=0.8)) == kept


def test_simhash_of_nothing(docs):
    assert simhash.group(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


# --- mixing


def goals(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, done, free = sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(done.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > cap * sizes[s]]
        if not over:
            return done | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        for s in over:
            done[s] = cap * sizes[s]
            free.discard(s)
    return done


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mixing(request, which):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.source, len(words(r.text))) for r in df.select("doc_id", "source", "text").collect()]
    sizes = collections.Counter()
    for _, s, n in rows:
        sizes[s] += n
    goal = goals(sizes)
    got = mixing.plan(df).collect()
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((d, n) for d, _, n in rows)
    taken, source = collections.Counter(), {}
    for d, s, n in rows:
        source.setdefault((d, n), s)
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(goal[s]) and len(r.draws) <= 3
        taken[s] += r.size * len(r.draws)
    for s, n in sizes.items():
        largest = max([k for _, x, k in rows if x == s])
        assert abs(taken[s] - goal[s]) <= largest
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(df).collect()))


def test_mixing_passes_over_what_does_not_fit(spark, tmp_path):
    # the first source has one document of more words than its target, for some seed ahead of all others
    rows = [(i, "a", "w " * (30_000 if i == 0 else 1 + i % 40)) for i in range(900)] + [(1000 + i, "b", "w " * 8) for i in range(160)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).write.parquet(str(tmp_path / "mix"))
    df = spark.read.parquet(str(tmp_path / "mix"))
    for seed in (1, 2, 3):
        for settings in ({"weights": (1, 4), "cap": 12}, {"weights": (1, 2), "cap": 3}):
            got = mixing.plan(df, seed=seed, blocks=4, **settings).collect()
            for ids_ in (range(900), range(1000, 1160)):
                of = [r for r in got if r.doc_id in ids_]
                unused = [r.size for r in of if len(r.draws) <= int(of[0].target // of[0].source_size)]
                if unused:
                    assert abs(sum(r.size * len(r.draws) for r in of) - of[0].target) < min(unused)
                assert all(len(r.draws) == len({d["pass"] for d in r.draws}) for r in of)


def test_mixing_is_the_same_under_any_split(spark, docs, tmp_path):
    many = docs.select("doc_id", "source", "text").unionByName(docs.select((F.col("doc_id") + 100_000).alias("doc_id"), "source", F.lit("some few words").alias("text"))).unionByName(docs.select(F.lit(None).cast("long").alias("doc_id"), "source", "text"))
    many.coalesce(1).write.parquet(str(tmp_path / "one"))
    many.repartition(23, F.rand(5)).write.parquet(str(tmp_path / "split"))
    of = lambda name: sorted(map(str, mixing.plan(spark.read.parquet(str(tmp_path / name)), blocks=8).drop("row").collect()))
    assert of("one") == of("split")
    rows = lambda name: sorted((str(r.doc_id), r.source, r.text) for r in mixing.mix(spark.read.parquet(str(tmp_path / name)), blocks=8).collect())
    assert rows("one") == rows("split")


def test_mix_by_shard(docs):
    placed = mixing.mix(docs, order=True)
    whole = [r.doc_id for r in placed.orderBy("_shard", "_at").collect()]
    assert sorted(whole) == sorted(r.doc_id for r in mixing.mix(docs, shuffle=True).collect())
    by = collections.defaultdict(list)
    for r in placed.collect():
        by[r._shard].append(r.doc_id)
    assert len(by) > 8 and all(x != sorted(x) for x in [[r.doc_id for r in placed.where(F.col("_shard") == s).orderBy("_at").collect()] for s in list(by)[:2]])
    with pytest.raises(ValueError, match="stored files"):
        mixing.mix(docs.repartition(3))
    with pytest.raises(ValueError, match="stored files"):
        simhash.keep_one(docs.distinct())


def test_mix_rows(docs, odd):
    for df in (docs, odd):
        plan = mixing.plan(df).select("doc_id", F.size("draws").alias("k")).collect()
        want = collections.Counter()
        for r in plan:
            want[r.doc_id] += r.k
        got = mixing.mix(df)
        assert got.columns == df.columns and ids(got) == +want
        assert ids(mixing.mix(df, order=True)) == +want
    assert mixing.mix(docs.limit(0)).count() == 0


def test_capped_targets(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(goals({"a": 10, "b": 1000, "c": 0, None: 5}))
    assert sum(got.values()) == pytest.approx(1015)


def test_tree_hands_out_every_block(spark):
    n = {1: 1000, 2: 17, 3: 0, 4: 333}
    rows = mixing.split(spark.createDataFrame(list(n.items()), "id long, n long"), 16).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.id].append((r.shard, r.n, r.offset))
    for i, parts in by.items():
        parts.sort()
        assert sum(k for _, k, _ in parts) == n[i] and [o for _, _, o in parts] == [sum(k for _, k, _ in parts[:j]) for j in range(16)] and all(k >= 0 for _, k, _ in parts)
    totals = [sum(r.n for r in rows if r.shard == s) for s in range(16)]
    assert max(totals) - min(totals) <= 1


def test_hypergeometric_is_exact(spark):
    from math import comb

    k, m, n = 7, 11, 6
    cells = 4000
    u = (F.col("id") + 0.5) / cells
    got = collections.Counter(r.x for r in spark.range(cells).select(mixing._hypergeometric(F.lit(k), F.lit(m), F.lit(n), u).alias("x")).collect())
    for x in range(7):
        assert got[x] / cells == pytest.approx(comb(k, x) * comb(m, n - x) / comb(k + m, n), abs=2 / cells)


# --- private data


def test_pii_kinds():
    text = 'mail Bob.Ray+x@site.example.com now, ring +1 (743) 555-3824 from 10.1.2.3 with 4716 0597 8394 8264? token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" id 078-05-1120, Mrs. Anna Weber met Dr. Weber. Version 2.0.1 of 1234567890123456'
    found = pii.find(text)
    cards = ["card"] * pii._luhn("4716059783948264")
    assert [k for _, _, k, _ in found][: 5 + len(cards)] == ["email", "phone", "address", *cards, "secret", "national"] and [k for _, _, k, _ in found][-3:] == ["given:latin:f", "surname:latin:u", "surname:latin:u"][:3]
    new, n, kinds = pii._private(text, {}, "k")
    for secret in ("Bob.Ray", "743) 555-3824", "10.1.2.3", "24be64439e", "078-05-1120", "Anna", "Weber"):
        assert secret not in new
    assert "Version 2.0.1 of 1234567890123456" in new and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new)
    names = re.search(r"Mrs\. (\w+) (\w+) met Dr\. (\w+)\.", new)
    assert names and names[2] == names[3] and names[1] in pii.GIVEN["latin", "f"]


def test_pii_formats():
    s = lambda kind, canon: pii.surrogate(kind, canon, 0)
    assert pii._luhn(s("card", "4111111111111111")) and s("card", "4111111111111111")[0] == "4"
    assert s("address", "192.168.0.1").startswith("192.168.") and s("address", "10.0.0.1").startswith("10.")
    iban = s("iban", "DE89370400440532013000")
    assert iban[:2] == "DE" and pii._iban_remainder(iban) == 1 and len(iban) == 22
    assert re.fullmatch("[0-9a-f]{40}", s("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"))
    assert pii.render("ANN@X.COM", "email", "bob@y.example.com") == "BOB@Y.EXAMPLE.COM"
    assert pii.render("+1 (555) 201-3824", "phone", "+19998887777") == "+1 (999) 888-7777"
    host = lambda e: s("email", e).split("@")[1]
    assert host("a.b@corp.com") == host("cd@corp.com") != host("cd@other.com")


ENTITY = "plain string, canon string, kind string"


def settled(spark, found):
    return {(r.plain, r.canon): r.attempt for r in pii.settle(spark.createDataFrame(found, ENTITY)).collect()}


def test_pii_collisions_are_settled(spark):
    # 26 one-letter addresses can't keep distinct one-letter surrogates without going on
    found = [("email", f"{c}@x.com", "email") for c in "abcdefghijklmnopqrstuvwxyz"]
    later = settled(spark, found)
    final = [pii.surrogate(k, c, later.get((p, c), 0)) for p, c, k in found]
    assert len(set(final)) == 26 and later
    assert pii.settle(spark.createDataFrame(found, ENTITY).limit(0)).count() == 0


def test_pii_names_are_distinct_over_genders_and_parts(spark):
    import random

    rng = random.Random(4)
    found = {("name:latin", f"n{rng.randrange(10**6)}", f"given:latin:{g}") for g in "mfu" for _ in range(60)}
    found |= {("name:latin", "paul", "given:latin:m"), ("name:latin", "anna", "given:latin:f"), ("name:cyrillic", "paul", "surname:cyrillic:u"), ("name:latin", "moor", "surname:latin:u")}
    later = settled(spark, sorted(found))
    new = [pii.surrogate(k, c, later.get((p, c), 0)) for p, c, k in found]
    assert len(set(new)) == len(found) and not set(new) & {c for _, c, _ in found}


def test_pii_full_private_network(spark):
    found = [("address", f"192.168.{i}.{j}", "address") for i in range(256) for j in range(0, 256, 2)] + [("address", f"172.{i}.0.9", "address") for i in range(16, 32)]
    later = settled(spark, found)
    new = [pii.surrogate(k, c, later.get((p, c), 0)) for p, c, k in found]
    assert len(set(new)) == len(found) and not set(new) & {c for _, c, _ in found}


def test_pii_scripts_and_genders():
    one = lambda text: pii._private(text, {}, "k")[0]
    script = lambda text: {pii._script(c) for c in text if c.isalpha()}
    for text, own in (("Dr. 王小明", "han"), ("Mr. يوسف", "arabic"), ("Prof. 김철수", "hangul"), ("Prof. Σταύρος", "greek"), ("Mrs. Петрова", "cyrillic"), ("Dr. שרה", "hebrew"), ("Dr. Zoë", "latin")):
        new = one(text).split(" ", 1)[1]
        assert script(new) == {own} and new != text.split(" ", 1)[1]
    assert one("госпожа Петрова").split()[1].endswith(("ова", "ина", "ева")) and one("господин Петров").split()[1].endswith(("ов", "ин", "ев"))
    assert one("王小明先生 came").endswith("先生 came") and "王小明" not in one("王小明先生 came, and 王小明 left")
    assert one("Then Anna Weber came and Weber left.") != "Then Anna Weber came and Weber left." and "Weber" not in one("Then Anna Weber came and Weber left.")
    assert "Quill" not in one("my name is Jonah Quill") and one("Nothing of Anna here. Then Weber.") == "Nothing of Anna here. Then Weber."
    assert one("MRS. Anna WEBER or Mrs. WEBER").split()[-1].isupper()


def test_pii_coreference_over_documents(spark):
    # Alex is Dr. here, Mr. there, and without a title elsewhere: one entity, a man by the titles of the corpus
    rows = [(1, "Dr. Alex Moor came"), (2, "Mr. Alex Moor went"), (3, "Mr. Alex went"), (4, "Ms. Kim Moor"), (5, "Mr. Kim Lund"), (6, "Prof. Kim Lund")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (100_000, 0):
        got = {r.doc_id: r.text.split() for r in pii.rewrite(df, broadcast_entities=limit).collect()}
        assert got[1][1] == got[2][1] == got[3][1] and got[1][2] == got[2][2] == got[4][2] and got[4][1] == got[5][1] == got[6][1] and got[5][2] == got[6][2]
        assert set(got[1][1].split("-")) <= set(pii.GIVEN["latin", "m"])
        assert len({got[1][1], got[1][2], got[4][1], got[5][2]}) == 4


def test_pii_many_entities_in_one_text():
    import time

    text = " ".join(f"a{i}@mail.net 10.{i % 256}.{i // 256}.7 Mr. Name{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(20_000))
    began = time.perf_counter()
    found = pii.find(text)
    assert len(found) >= 55_000 and time.perf_counter() - began < 10


def test_pii_rewrites(docs, odd, texts):
    got = {r.doc_id: r for r in pii.rewrite(docs, names=("n", "kinds")).collect()}
    for d, t in texts.items():
        for _, _, kind, _ in pii.find(t):
            assert kind.partition(":")[0] in got[d].kinds
        if not pii.find(t):
            assert got[d].text == t
    out = pii.rewrite(odd)
    assert out.columns == odd.columns and ids(out) == ids(odd)
    by = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
    assert by[1] is None and by[2] == "" and "Ann.Lee" not in by[12] and "4111" not in by[12]
    assert pii.rewrite(docs.limit(0)).count() == 0


def test_pii_beyond_broadcast_is_the_same(spark):
    df = spark.createDataFrame([(i, f"write to {c}@x.com and {c}@x.com or z@x.com") for i, c in enumerate("abcdefghijklmnopqrst")], "doc_id long, text string")
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(pii.rewrite(df, broadcast_entities=0)) == rows(pii.rewrite(df))


# --- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return nbest.Vocabulary.load()


def test_pieces_round_trip(docs, odd):
    for df in (docs, odd):
        e = nbest.encode(df, check="exact")
        assert e.where("not exact").count() == 0 and ids(e) == ids(df)
    back = nbest.decode(nbest.encode(odd, keep=["doc_id", "text"]).withColumnRenamed("text", "was"))
    assert back.where("not (was <=> text)").count() == 0
    null = nbest.encode(odd, keep=["doc_id"]).where("doc_id = 1").first()
    empty = nbest.encode(odd, keep=["doc_id"]).where("doc_id = 2").first()
    assert null.ids is None and null.n_best is None and empty.ids == [] and empty.n_best[0].score == 0
    assert nbest.encode(docs.limit(0)).count() == 0


def test_ids_are_the_model_s(vocabulary, docs, texts):
    got = {r.doc_id: r for r in nbest.encode(docs, keep=["doc_id"]).collect()}
    for d, t in texts.items():
        assert got[d].ids == vocabulary.encoder.encode(t), t[:80]
        assert got[d].n_pieces == len(got[d].ids) and got[d].n_best[0].changes == [] and got[d].n_best[0].score == got[d].score
    for t in ["a  b\nc", " ", "\n\n", "日本 x", "\n a\n\nfoo  ", "x\0y é😀", "<s> </s> <0x41>", "x" * 100_000, "ab" * 60_000]:
        ids_, best = vocabulary.segment(t, 3)
        assert ids_ == vocabulary.encoder.encode(t) and vocabulary.decode(ids_) == t and len(best) <= 3
        assert all(vocabulary.decode(changed(ids_, c)) == t for _, c in best)
    marked, _ = vocabulary.segment("a▁b ▁", 2)
    assert vocabulary.decode(marked) == "a▁b ▁"


def changed(ids_, changes):
    path = list(ids_)
    for at, n, new in reversed(changes):
        path[at : at + n] = new
    return path


def path_score(vocabulary, path, own):
    """The score of ids: their pieces' scores, less what arcs off the own path lose."""
    steps = vocabulary._steps(path)
    kept = {(a, b) for a, b, _ in vocabulary._steps(own)}
    return sum((vocabulary.pieces[i][1] if i >= 0 else vocabulary.unknown) - (0 if (a, b) in kept else nbest.OFF * (b - a)) for a, b, i in steps)


def test_n_best_is_that_of_the_whole_text(vocabulary, texts):
    whole = nbest.Vocabulary(vocabulary.model)
    whole.atoms = re.compile("(?s).+")
    for t in sorted(texts.values(), key=len)[:60] + ["a  b\nc", " ", "\n\n", "日本 x", "no idea, tokens!\n in here: 12.5%"]:
        ids_, best = vocabulary.segment(t, 5)
        exact = whole.paths(nbest.MARK + t.replace(" ", nbest.MARK), 5) if t else [(0.0, ())]
        assert [s for s, _ in best] == pytest.approx([s for s, _ in exact])
        for score, changes in best:
            path = changed(ids_, changes)
            assert vocabulary.decode(path) == t and path_score(vocabulary, path, ids_) == pytest.approx(score)
        assert len({tuple(changed(ids_, c)) for _, c in best}) == len(best)


def test_n_best_by_brute_force(vocabulary):
    """All segmentations of short atoms, each scored apart."""

    def all_of(atom):
        if not atom:
            return [[]]
        heads = [k for k in range(1, len(atom) + 1) if atom[:k] in vocabulary.usable]
        return [[vocabulary.usable[atom[:k]][0], *rest] for k in heads for rest in all_of(atom[k:])]

    for atom in ["▁the", "▁quick", "▁▁a", "tokens", "▁1,25", "▁hello!"]:
        own = vocabulary.own([atom])[0]
        every = all_of(atom)
        scores = sorted((path_score(vocabulary, p, own) for p in every), reverse=True)
        found = vocabulary.paths(atom, 6)
        assert list(found[0][1]) == own
        assert [s for s, _ in found] == pytest.approx(scores[:6])
        assert len({p for _, p in found}) == len(found)


def test_bulk_search_is_the_single_one(vocabulary):
    import numpy as np

    atoms = ["▁abc", "▁the", "▁xyz", "▁zzz", "▁a-b", "▁1,2", "▁é!x", "▁▁▁q"]
    own = vocabulary.own(atoms)
    scores, losses = vocabulary.many(atoms, np.array([i for o in own for i in o]), np.array(list(map(len, own))))
    for a, o, s, loss in zip(atoms, own, scores, losses):
        assert (s, loss) == pytest.approx(vocabulary.two(a, vocabulary._steps(o)))


# --- licenses


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_licenses_base(request, which):
    df = request.getfixturevalue(which)
    want = collections.Counter()
    for r in df.select("doc_id", "text").collect():
        w = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m.group().lower(), r.text or ""))
        places = [(i, x) for p, x in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want[r.doc_id, len(w), len(places), min([i for i, _ in places], default=None), max([i for i, _ in places], default=None), ",".join(sorted({x for _, x in places}))] += 1
    got = licenses.scan(df).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} for r in got)


def test_licenses_with_changes(spark):
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files."
    rows = [(1, text), (2, text.replace("hereby ", "")), (3, "permission is granted"), (4, "CC-BY cc by Cc_By"), (5, "MIT licensed"), (6, None)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[2].labels == "mit" and 0.8 <= got[2].score < 1
    assert got[3].labels == got[5].labels == got[6].labels == "" and got[3].score == 0
    assert (got[4].n_base, got[4].first_word, got[4].last_word, got[4].labels) == (3, 0, 4, "cc-by")
    assert licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def noticed(text):
    """Scores of the notices in a text, by definition: for each start the longest chain of the word pairs near it."""
    w = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    out, need = {}, licenses.needed(licenses.default_templates())[len(licenses.BASE) :]
    for k, (phrase, label) in enumerate(licenses.NOTICES):
        n = phrase.split()
        hits = [(t, p) for t in range(len(n) - 1) for p in range(len(w) - 1) if w[p : p + 2] == n[t : t + 2]]
        width = licenses.SLACK if len(n) - 1 > licenses.SLACK else 0
        for start in {p - t for t, p in hits}:
            near = sorted((t, p) for t, p in hits if start <= p - t <= start + width)
            if not set(need[k]) <= {t for t, _ in near}:
                continue
            best = []
            for i, (t, p) in enumerate(near):
                best.append(1 + max([best[j] for j in range(i) if near[j][0] < t and near[j][1] < p], default=0))
            share = max(best) / (len(n) - 1)
            if share >= licenses.COVERAGE:
                out[label] = max(out.get(label, 0), share)
    return out


ADVERSARIAL = [
    "you may " * 30, "the license " * 20, "copy of the " * 40, "guava: Apache License; jackson: Apache License; " * 6, "under the X " * 9,
    "file except in compliance with the license you may not use this you may obtain a copy of the license at", "license the at obtain may you", "of the terms of the " * 12,
    "Licensed under the Apache License, Version 2.0", "licensed under the apache apache license really version 2 0", "Released under the MIT license. " * 3,
    "you may not use this file, except in full compliance with this license: you may obtain a copy of the license at", "LICENSED UNDER CC BY-NC 4.0", "licensed under cc by sa 3 0",
    "\u0130icensed under the apache license version 2 0 \u212a", "redistribution and use in source and binary forms, with or without modification are permitted if the following conditions are met",
]


CC = "This work is licensed under a Creative Commons {} International License."
PROGRAM = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License"
NEIGHBOURS = [
    (CC.format("Attribution 4.0"), "cc-by-4.0"), (CC.format("Attribution-NonCommercial 4.0"), "cc-by-nc-4.0"), (CC.format("Attribution-ShareAlike 4.0"), "cc-by-sa-4.0"), (CC.format("Attribution-NoDerivatives 4.0"), "cc-by-nd-4.0"),
    (CC.format("Attribution-NonCommercial-ShareAlike 4.0"), "cc-by-nc-sa-4.0"), (CC.format("Attribution-NonCommercial-NoDerivatives 4.0"), "cc-by-nc-nd-4.0"), (CC.format("Attribution 3.0"), ""), (CC.format("Attribution-NonCommercial 2.5"), ""),
    ("This work is licensed under the GNU General Public License version 2", "gpl,gpl-2.0"), ("This work is licensed under the GNU General Public License version 3", "gpl,gpl-3.0"), ("This work is licensed under the GNU General Public License version 9", "gpl"),
    ("the GNU Lesser General Public License version 2.1", "lgpl,lgpl-2.1"), ("the GNU Lesser General Public License version 3", "lgpl,lgpl-3.0"), ("the GNU Affero General Public License version 3", "agpl,agpl-3.0"),
    (PROGRAM.format(""), "gpl"), (PROGRAM.format("Lesser "), "lgpl"), (PROGRAM.format("Affero "), "agpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", "mpl-1.1"), ("The contents of this file are subject to the Mozilla Public License Version 1.1", "mpl-1.1"),
    ("Licensed under the Apache License, Version 2.0", "apache,apache-2.0"), ("Licensed under the Apache License, Version 1.1", "apache"),
    ("licensed under CC BY 4.0", "cc-by,cc-by-4.0"), ("licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"), ("licensed under CC BY-SA 4.0", "cc-by,cc-by-sa-4.0"), ("licensed under CC BY-SA 3.0", "cc-by"), ("licensed under CC BY 3.0", "cc-by"),
]


def test_neighbouring_licenses_are_told_apart(spark):
    rows = [(i, t) for i, (t, _) in enumerate(NEIGHBOURS)] + [(100 + i, f"Some words before it. {t} And some after it, not a license.") for i, (t, _) in enumerate(NEIGHBOURS)]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (text, want) in enumerate(NEIGHBOURS):
        assert (got[i], got[100 + i]) == (want, want), text


def test_licenses_by_brute_force(spark, docs):
    rows = [(i, t) for i, t in enumerate(ADVERSARIAL)] + [(1000 + r.doc_id, r.text) for r in docs.where("length(text) < 20000").collect()]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows:
        want = noticed(text)
        r = got[d]
        assert set(r.labels.split(",")) - {""} == set(want) | set(r.base_labels.split(",")) - {""}, text[:80]
        assert r.score == pytest.approx(max([1.0] * (r.n_base > 0) + list(want.values()), default=0.0))
    assert [got[i].labels for i in range(3)] == [""] * 3 and got[3].labels == "apache" and got[4].labels == got[5].labels == got[6].labels == got[7].labels == ""
    assert got[8].labels == "apache,apache-2.0" and got[10].labels == "mit" and got[12].labels == "cc-by,cc-by-nc-4.0"


# --- token counts


@pytest.mark.parametrize("block", [1, 5, 1 << 16])
def test_token_counts(docs, odd, block):
    encode = tokencount.encoding(tokencount.vocabulary()).encode_ordinary
    for df in (docs.limit(40) if block < 100 else docs, odd if block > 100 else odd.where("doc_id <> 6 or doc_id is null")):
        want = collections.Counter((r.doc_id, len(encode(r.text or ""))) for r in df.select("doc_id", "text").collect())
        assert collections.Counter((r.doc_id, r.n_tokens) for r in tokencount.count(tokencount.flatten(df, block=block)).collect()) == want


def test_token_files(spark, tmp_path):
    import numpy as np

    (tmp_path / "t").mkdir()
    np.array([5, 6, 9, 9, 7, 9, 8], "<u2").tofile(tmp_path / "t" / "a.bin")
    np.array([], "<u2").tofile(tmp_path / "t" / "b.bin")
    for block in (1, 2, 3, 100):
        got = tokencount.count(tokencount.read_files(spark, str(tmp_path / "t"), block), separator=9).collect()
        assert sorted((r.ordinal, r.n_tokens, r.doc_id) for r in got) == [(0, 2, None), (1, 0, None), (2, 1, None)]


def test_token_files_of_many_ranges(spark, tmp_path):
    import numpy as np

    (tmp_path / "t").mkdir()
    rng = np.random.default_rng(1)
    want = collections.Counter()
    for name, n, share in (("long", 50_000, 0.01), ("few", 9_001, 0.0003), ("none", 777, 0), ("only", 64, 1)):
        ids_ = np.where(rng.random(n) < share, 9, 10 + rng.integers(0, 50, n)).astype("<u2")
        ids_.tofile(tmp_path / "t" / f"{name}.bin")
        ends = np.flatnonzero(ids_ == 9)
        for k, length in enumerate(np.diff(ends, prepend=-1) - 1):
            want[name, k, int(length)] += 1
    got = tokencount.count(tokencount.read_files(spark, str(tmp_path / "t"), 64, blocks_a_range=5), separator=9).collect()
    assert collections.Counter((r.file.split("/")[-1][:-4], r.ordinal, r.n_tokens) for r in got) == want


def test_token_counts_of_nothing(docs):
    assert tokencount.count(tokencount.flatten(docs.limit(0))).count() == 0


def test_tokens_without_spaces(spark):
    df = spark.createDataFrame([(1, "x" * 50_000), (2, "日本" * 20_000), (3, "a")], "doc_id long, text string")
    encode = tokencount.encoding(tokencount.vocabulary()).encode_ordinary
    assert {r.doc_id: r.n_tokens for r in tokencount.count(tokencount.flatten(df)).collect()} == {r.doc_id: len(encode(r.text)) for r in df.collect()}


# --- classifier


def test_ordinal_held_out(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("extra", F.lit(1))
    far = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100000))
    met = ordinal.select(far, labels).join(labels, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1 and r.toxic == 0) for r in met) / len(met) > 0.9
    for r in met:
        assert 0 <= r.p_upper <= 1 and 0 <= r.expected_grade <= 2 and r.p_upper + r.p_lowest <= 1 + 1e-9


def test_ordinal_learns_grades():
    import random

    rng = random.Random(5)
    vocab = {0: ["vile", "awful"], 1: ["spam", "junk"], 2: ["fine", "clear"]}

    def text(g):
        return " ".join(rng.choice(vocab[g] + ["the", "of", "and"] * 3) for _ in range(60))

    slots = ordinal._Slots()
    rows = [(g, *(x.tobytes() for x in ordinal.features(text(g), slots))) for g in [0, 1, 2] * 60]
    model = ordinal.fit_rows(rows)
    assert list(model.thresholds) == sorted(model.thresholds)
    tails = model.tails([text(g) for g in [0, 1, 2] * 30], slots)
    want = [0, 1, 2] * 30
    assert sum((t > 0.5).sum() == g for t, g in zip(tails, want)) / 90 > 0.95
    with pytest.raises(ValueError):
        ordinal.fit_rows([r for r in rows if r[0] == 1])


def test_ordinal_odd(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (5, 0, None), (6, None, 1), (7, 0, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert ids(ordinal.select(odd, labels)) == ids(odd)
    assert ordinal.score(odd.limit(0), ordinal.fit(odd, labels)).count() == 0
    with pytest.raises(ValueError):
        ordinal.select(odd, labels.limit(0))
    for empty in (odd.limit(0), odd.where("doc_id = 77")):
        for given in (labels, labels.limit(0)):
            assert ordinal.select(empty, given).count() == 0


def test_ordinal_counts_a_repeated_document_once(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    many = spark.createDataFrame([(1, "fine and clear words")] * 50 + [(2, "spam spam")] * 3, "doc_id long, text string")
    assert ordinal.sampled(many, labels).count() == 2


def test_ordinal_gradient():
    import numpy as np

    rng = np.random.default_rng(2)
    y = np.array([0, 1, 2, 2, 1, 0, 2])
    at = rng.integers(0, 40, 7 * 5)
    values, starts, of = rng.random(35), np.arange(0, 35, 5), np.repeat(np.arange(7), 5)
    p = np.concatenate([rng.normal(0, 0.5, ordinal.SLOTS), [-0.4, 0.3]])
    _, gradient = ordinal.loss_and_gradient(p, y, at, values, starts, of, 0.01)
    for i in [*sorted(set(at.tolist()))[:12], ordinal.SLOTS, ordinal.SLOTS + 1]:
        ends = []
        for step in (1e-5, -1e-5):
            q = p.copy()
            q[i] += step
            ends.append(ordinal.loss_and_gradient(q, y, at, values, starts, of, 0.01)[0])
        assert gradient[i] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-4, abs=1e-7)
