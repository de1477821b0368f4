"""Exact top-k and chat formatting."""

import math
import random

import pytest
from oracle import compare

from factloom.llm import chat, queries, topk


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf, name):
    compare(spark, sf, name, queries.QUERIES[name], queries.ORACLES[name])


def brute(rows, wanted, k):
    def whole(v):
        return None if v is None or not v or any(x is None or math.isnan(x) or math.isinf(x) for x in v) else [math.floor(64 * x) for x in v]

    have = [(i, w) for i, v in rows if i is not None and (w := whole(v))]
    out = []
    for q, qv in {(i, tuple(w)) for i, v in wanted if i is not None and (w := whole(v))}:
        best = sorted((-sum(a * b for a, b in zip(qv, w)), i) for i, w in have if i != q and len(w) == len(qv))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_k(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(300)] + [(900 + i, [0.5] * 6) for i in range(40)]
    rows += [(500, None), (501, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, [0.1] * 6), (504, []), (505, [0.1, 0.2]), (506, [0.3, -0.2]), (3, [0.9] * 6)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    wanted = [r for r in rows if r[0] is None or r[0] % 20 == 0 or r[0] in (505, 502)]
    qs = spark.createDataFrame(wanted + wanted[:2], "vec_id long, embedding array<double>")
    for blocks in ({}, {"query_block": 7, "candidate_block": 30}):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, qs, 20, **blocks).collect())
        assert got == brute(rows, wanted, 20)
    assert topk.top_k(df.limit(0), qs).count() == 0 and topk.top_k(df, qs.limit(0)).count() == 0


def test_large_components(spark):
    rows = [(1, [1e9, -3e8]), (2, [1.0, 2.0]), (3, [4e5] * 2), (4, [1e300, -1e300]), (5, [-1e300, 7.0]), (20, [2e9, 1.0]), (40, [-1e300, 1e17])] + [(100 + i, [i * 1e6, 3.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    most = (1 << 63) - 1
    clip = lambda x: min(max(x, -most), most)
    whole = {i: [clip(math.floor(64 * x)) for x in v] for i, v in rows}
    want = []
    for q in (20, 40):
        best = sorted((-clip(sum(a * b for a, b in zip(whole[q], v))), i) for i, v in whole.items() if i != q)[:20]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    for block in (4, 4096):
        got = topk.top_k(df, df.where("vec_id in (20, 40)"), candidate_block=block).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_queries_of_one_id(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    qs = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, qs).collect()))
    assert got == sorted([(1, 1, 3, 4096), (1, 2, 2, 0), (1, 1, 2, 4096), (1, 2, 3, 4096)])


def test_search_stops_on_proof():
    import numpy as np

    rng = np.random.default_rng(0)
    centres = rng.integers(-30, 30, (8, 32))
    x = centres[rng.integers(0, 8, 3000)] + rng.integers(-2, 3, (3000, 32))
    ids = np.arange(3000)
    exact = x[:64] @ x.T
    exact[np.arange(64), np.arange(64)] = -(10**9)
    best, used = topk.Best(64, 20), []
    for block in (np.arange(0, 1500), np.arange(1500, 3000)):
        index = topk.Index.of(ids[block], x[block])
        again = topk.Index.from_parts(32, index.parts())
        who, what, score, level = topk.search_block(again, x[:64], ids[:64], 20, best.sure)
        assert (score == exact[who, block[what]]).all() and len(who) < 0.25 * 64 * 1500
        best.add(who, index.ids[what], score)
        used.append(level)
    assert min(used) < topk.LEVELS
    for i in range(64):
        assert (best.ids[best.who == i] == np.lexsort((ids, -exact[i]))[:20]).all()


def test_postings_are_in_the_order_of_impact():
    import numpy as np

    x = np.random.default_rng(3).integers(-40, 41, (500, 6))
    index = topk.Index.of(np.arange(500), x)
    impact = np.abs(x - index.mean)
    assert sorted((int(p), d) for s in range(topk.LEVELS * 6) for d in [s % 6] for p in index.postings[index.bounds[s] : index.bounds[s + 1]]) == [(i, d) for i in range(500) for d in range(6)]
    lows = []
    for level in range(topk.LEVELS):
        seen = [impact[p, d] for d in range(6) for p in index.postings[index.bounds[level * 6 + d] : index.bounds[level * 6 + d + 1]]]
        assert not seen or not lows or max(seen) <= min(lows) + 1e-9
        lows += seen
    assert np.allclose(index.left[0] ** 2, (impact**2).sum(axis=1)) and (index.left[-1] == 0).all()


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi", "x"), (1, 1, "assistant", "yes", "x"),
        (2, 0, "user", "hi", "x"), (2, 1, "assistant", "yes", "x"), (2, 2, "user", "more <|im_end|>", "x"),
        (3, 0, "user", "hi", "x"), (4, 0, "user", "yes", "x"), (4, 1, "assistant", "hi", "x"),
        (5, 0, "user", "yes", "x"), (5, 1, "assistant", "hi", "x"), (5, 1, "assistant", "hi", "x"),
        (6, 0, None, None, "x"), (7, 3, "user", "late", "x"), (7, 3, "assistant", "tie", "x"), (None, 0, "user", "lost", "x"), (None, 3, "user", "lost", "x"), (None, 0, "user", "hi", "x"), (None, 1, "user", "alone", "x"), (8, None, "user", "n" * 100000, "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long".replace("n long", "n string"))
    rows = chat.collapse(df).collect()
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in rows}
    assert set(got) == {2, 4, 6, 7, None, 8} and len(rows) == 7
    # rows without a conversation are conversations of one turn, and go where one begins like them
    assert sorted((r.n_turns, r.rendered) for r in rows if r.conv_id is None) == [(1, f"<|im_start|>user\n{x}<|im_end|>\n") for x in ("alone", "lost")]
    assert got[2] == (3, 1, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore < |im_end|><|im_end|>\n")
    assert got[4][:2] == (2, 2) and got[4][2].count("<|im_start|>") == 2
    assert got[6][2] == "<|im_start|>\n<|im_end|>\n" and got[7][2].startswith("<|im_start|>assistant\ntie")
    assert chat.collapse(df.limit(0)).count() == 0
