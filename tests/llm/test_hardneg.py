"""Hard negatives against all scores of all anchors."""

import math
import random

import pytest

from factloom.llm import hardneg

MOST = (1 << 63) - 1
SCHEMA = "vec_id long, embedding array<double>, label int, score string, tag string"


def brute(rows, anchors):
    clip = lambda x: min(max(x, -MOST), MOST)

    def takes_part(r):
        return None not in r[:1] + r[2:3] and r[1] and all(x is not None and math.isfinite(x) for x in r[1])

    whole = lambda r: (r[0], r[2], tuple(clip(math.floor(256 * x)) for x in r[1]))
    have, out = [whole(r) for r in rows if takes_part(r)], []
    for a, label, v in {whole(r) for r in anchors if takes_part(r)}:
        near = sorted((-clip(sum(x * y for x, y in zip(v, w))), i, other) for i, other, w in have if i != a and len(v) == len(w))
        for p, positive, _ in [x for x in near if x[2] == label][:5]:
            found = [(i, -s) for s, i, other in near if other != label and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(a, positive, k, i, -p, s) for k, (i, s) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, anchors, **blocks):
    dfs = [spark.createDataFrame([(*r, "x", "y") for r in x], SCHEMA) for x in (rows, anchors)]
    return sorted(map(tuple, hardneg.mine(*dfs, **blocks).collect()))


@pytest.mark.parametrize("blocks", [{}, {"anchor_block": 3, "row_block": 17}])
def test_mine(spark, blocks):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0.1, 0.1) for _ in range(5)], rng.randrange(3)) for i in range(250)]
    rows += [(300 + i, [0.1] * 5, i % 2) for i in range(20)]  # ties
    rows += [(400, None, 1), (401, [0.1, None, 0.0, 0.0, 0.0], 1), (402, [float("nan")] * 5, 1), (403, [float("inf")] * 5, 1), (404, [], 1), (405, [0.2] * 5, None), (None, [0.1] * 5, 1)]
    rows += [(406, [0.3, 0.1], 0), (407, [0.3, 0.1], 1), (408, [0.5, 0.0], 1), (409, [-0.1, 0.0], 2), (410, [-0.2, 0.0], 2), (411, [0.0, 0.0], 2), (412, [0.0, 0.0], 1)]
    rows += [(7, [0.2] * 5, 2), (7, [0.2] * 5, 2), (8, [0.2] * 5, 1), (8, [0.2] * 5, 1)]
    anchors = [r for r in rows if r[0] is None or r[0] % 20 == 0 or r[0] in (7, 401, 404, 405, 406, 408, 409, 410, 411)] + rows[:1]
    want = brute(rows, anchors)
    assert want and mined(spark, rows, anchors, **blocks) == want
    if not blocks:
        assert mined(spark, [], anchors) == mined(spark, rows, []) == []


def test_large_and_negative_scores(spark):
    rows = [(1, [1e9, -3e8], 0), (2, [1e9, -2e8], 0), (3, [7e8, 0.0], 1), (4, [1e300, -1e300], 0), (5, [5e8, 1.0], 1), (6, [-1e9, 0.0], 0), (7, [-4e8, 0.0], 1), (8, [6e299, 1.0], 1), (9, [1e8, 1e7], 1), (10, [1e8, 1e7], 0)]
    assert mined(spark, rows, rows, row_block=4) == brute(rows, rows)
    small = [(i, [x], i % 2) for i, x in enumerate([1.0, 0.5, -1.0, -0.5, 0.0, 0.0, 0.25, 0.75, -0.25])]
    assert mined(spark, small, small) == brute(small, small)


def test_keys_sort_as_the_walk_needs_them():
    rng = random.Random(3)
    some = lambda: rng.choice([-(1 << 63), -5, -1, 0, 1, 7, MOST])
    keys = [(some(), some(), max(some(), -MOST), rng.randrange(2), some()) for _ in range(500)]
    order = sorted(keys, key=lambda k: (k[0], k[1], -k[2], k[3], k[4]))
    assert [hardneg.unpacked(x) for x in sorted(hardneg.packed(*k) for k in keys)] == order


def test_walk_over_all_scores_gives_what_it_gives_over_the_best(spark):
    """The walk needs no selection before it: here it gets every score of two anchors."""
    rng = random.Random(5)
    scores = [(a, 0, rng.randrange(-20, 400), rng.randrange(2), i) for a in (1, 2) for i in range(300)]
    want = []
    for a in (1, 2):
        mine = sorted((-s, i, o) for b, _, s, o, i in scores if a == b)
        for p, positive, _ in [x for x in mine if not x[2]][:5]:
            want += [(a, positive, k, i, -p, -s) for k, (s, i, _) in enumerate([x for x in mine if x[2] and 50 * -p <= -100 * x[0] <= 95 * -p][:3], 1)]
    assert sorted(hardneg.walk(iter(sorted(hardneg.packed(*k) for k in scores)))) == sorted(want)
