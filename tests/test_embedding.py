"""Translation models against plain Python, and what training is worth on held-out triples."""

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions.frames import ensure_checkpoint_dir
from factloom.operators import embedding as em
from factloom.operators import vector


def planted(spark):
    """Sources of four groups like half of the things of one group and avoid half of those of another."""
    rng = random.Random(7)
    rows = []
    for g in range(4):
        for i in range(20):
            for relation, step in (("likes", 1), ("avoids", 3)):
                rows += [(f"s{g}_{i}", relation, f"t{(g + step) % 4}_{j}") for j in rng.sample(range(12), 6)]
    return spark.createDataFrame(rows, "subject string, predicate string, object string")


def split(triples):
    test = (F.col("h") * 31 + F.col("t") * 7) % 10 == 0
    return triples.where(~test), triples.where(test)


@pytest.mark.parametrize("projected", [False, True])
def test_an_epoch_equals_plain_python(spark, projected):
    model = em.Model(dim=4, batch=7, projected=projected, rate=0.1)
    nodes, relations, triples = em.indexed(planted(spark).limit(60))
    n, parts = nodes.count(), 3
    start = em.started(nodes, relations, model)
    values = {(r.kind, r.id): [r[c] for c in model.columns] for r in start.collect()}
    dealt = em.with_negatives(triples, n, parts, 2).collect()
    norm = lambda x: math.sqrt(sum(y * y for y in x))
    sums, loss = {}, 0.0
    for p in range(parts):
        mine, touched = {k: list(v) for k, v in values.items()}, set()
        rows = sorted((x for x in dealt if x.p == p), key=lambda x: (x.h, x.r, x.t))
        for i in range(0, len(rows), model.batch):
            step, spots = {}, set()

            def add(key, x):
                step[key] = [a + b for a, b in zip(step.get(key, [0.0] * 4), x)]

            for x in rows[i : i + model.batch]:
                hn, tn = (x.neg, x.t) if x.head else (x.h, x.neg)
                r, m = mine[1, x.r], [mine[2, x.r * 4 + k] for k in range(4)] if projected else None
                gap = [[a - b for a, b in zip(mine[0, h], mine[0, t])] for h, t in ((x.h, x.t), (hn, tn))]
                e = [[(sum(a * b for a, b in zip(m[k], g)) if projected else g[k]) + r[k] for k in range(4)] for g in gap]
                d = [norm(y) for y in e]
                spots |= {(0, x.h), (0, x.t), (0, hn), (0, tn), (1, x.r)}
                touched |= {(0, x.h), (0, x.t), (0, x.neg), (1, x.r)} | ({(2, x.r * 4 + k) for k in range(4)} if projected else set())
                if model.margin + d[0] - d[1] <= 0:
                    continue
                loss += model.margin + d[0] - d[1]
                u = [[y / z for y in v] if z else [0.0] * 4 for v, z in zip(e, d)]
                g = [[sum(m[k][j] * v[k] for k in range(4)) if projected else v[j] for j in range(4)] for v in u]
                add((0, x.h), g[0])
                add((0, x.t), [-y for y in g[0]])
                add((0, hn), [-y for y in g[1]])
                add((0, tn), g[1])
                add((1, x.r), [a - b for a, b in zip(*u)])
                for k in range(4 if projected else 0):
                    add((2, x.r * 4 + k), [u[0][k] * a - u[1][k] * b for a, b in zip(*gap)])
            for key, x in step.items():
                mine[key] = [a - model.rate * b for a, b in zip(mine[key], x)]
            for key in spots:
                mine[key] = [a / max(1.0, norm(mine[key])) for a in mine[key]]
        for key in touched:
            sums.setdefault(key, []).append(mine[key])
    want = values | {k: [sum(x) / len(x) for x in zip(*v)] for k, v in sums.items()}
    got = em.epoch_of(triples, start, n, parts, 2, model).collect()
    assert sum(r.v0 for r in got if r.kind == em.LOSS) == pytest.approx(loss) and sum(r.v1 for r in got if r.kind == em.LOSS) == len(dealt)
    got = {(r.kind, r.id): [r[c] for c in model.columns] for r in got if r.kind != em.LOSS}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_training_beats_means(spark):
    nodes, relations, triples = em.indexed(planted(spark))
    train, test = split(triples)
    model = em.Model(rate=0.1, batch=32)
    found, losses = em.train(train, nodes, relations, model, epochs=15)
    assert losses[-1] < 0.5 * losses[0] and sum(b < a for a, b in zip(losses, losses[1:])) > 10
    trained = em.hits(em.ranks(test, train, found, model)).first()
    names = lambda df: df.join(nodes.select(F.col("node").alias("subject"), F.col("id").alias("h")), "h").join(nodes.select(F.col("node").alias("object"), F.col("id").alias("t")), "t").join(relations.select(F.col("relation").alias("predicate"), F.col("id").alias("r")), "r")
    v, r = vector.translation_vectors(names(train), dim=16)
    spread = lambda df, key, kind, ids: df.join(ids, key).select(F.lit(kind).alias("kind"), "id", *[F.get("v", i).alias(c) for i, c in enumerate(model.columns)])
    means = spread(v, "node", em.NODE, nodes).unionByName(spread(r, "relation", em.RELATION, relations))
    plain = em.hits(em.ranks(test, train, means, model)).first()
    assert trained.n == plain.n > 50
    assert trained.hits_10 > 1.25 * plain.hits_10 and trained.mrr > plain.mrr


@pytest.mark.parametrize("projected", [False, True])
def test_ranks_equal_plain_python(spark, projected):
    nodes, relations, triples = em.indexed(planted(spark).limit(200))
    train, test = split(triples)
    model = em.Model(dim=4, projected=projected)
    found, _ = em.train(train, nodes, relations, model, epochs=2)
    v = {(r.kind, r.id): [r[c] for c in model.columns] for r in found.collect()}
    known = {(r.h, r.r, r.t) for r in triples.collect()}
    project = lambda r, x: [sum(a * b for a, b in zip(v[2, r * 4 + k], x)) for k in range(4)] if projected else x
    far = lambda h, r, t: math.dist([a + b for a, b in zip(project(r, v[0, h]), v[1, r])], project(r, v[0, t]))
    n = nodes.count()
    got = em.ranks(test, train, found, model, block=16).collect()
    assert len(got) == test.count() > 5
    for x in got:
        own = far(x.h, x.r, x.t)
        assert x["rank"] == 1 + sum(far(x.h, x.r, e) < own - 1e-12 for e in range(n) if (x.h, x.r, e) not in known)


def test_nearer_counts_what_rounding_could_decide():
    """Points with several distances among nodes of which many are equally far, against distances one by one."""
    rng = np.random.default_rng(3)
    e = rng.normal(size=(300, 4)).round(1)
    e = np.concatenate([e, e[:50], -e[:50]])
    at = np.concatenate([rng.normal(size=(40, 4)), np.zeros((1, 4))])
    own = [sorted(em._apart(p[None], e[rng.integers(0, len(e), 1 + i % 5)]).tolist()) for i, p in enumerate(at)]
    assert em._nearer(at, own, e) == [[int((em._apart(p[None], e) < d).sum()) for d in ds] for p, ds in zip(at, own)]


def test_triples_of_one_head_share_their_distances(spark, monkeypatch):
    """A point is measured against the nodes once, however many of its triples are asked for."""
    nodes, relations, triples = em.indexed(spark.createDataFrame([("hub", "has", f"t{i}") for i in range(40)], "subject string, predicate string, object string"))
    model = em.Model(dim=4)
    start = em.started(nodes, relations, model)
    got = em.ranks(triples, triples, start, model, block=8)
    assert {r["rank"] for r in got.collect()} <= {1, 2} and got.count() == 40  # only the hub itself isn't known
    sent = [r.n for r in spark.read.parquet(*[str(p) for p in last_written(spark, "qs")]).select(F.size("qs").alias("n")).collect()]
    assert sum(sent) == 1


def last_written(spark, column):
    """The newest written table with ``column``."""
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    found = sorted((p for p in folder.glob("written-*") if column in spark.read.parquet(str(p)).columns), key=lambda p: p.stat().st_mtime)
    return found[-1:]


def test_empty_and_null_triples(spark):
    none = spark.createDataFrame([(None, "r", "b"), ("a", None, "b"), ("a", "r", None)], "subject string, predicate string, object string")
    nodes, relations, triples = em.indexed(none)
    found, losses = em.train(triples, nodes, relations)
    assert found.count() == 0 and losses == [] and em.ranks(triples, triples, found).count() == 0
