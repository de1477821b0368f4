"""Embeddings of triples by translation, trained with a margin against negative samples, and the ranks they give to held-out triples.

Nodes, relations and, for relation-specific spaces, the rows of each relation's projection are parameters: rows of one table
(kind, id, v0, v1, ...).  An epoch deals the triples to tasks by hash, a bounded number each; a task gets the parameters that its
triples name, takes mini-batch steps on its own copies, and returns them; each parameter becomes the mean
over the tasks that changed it, summed before the shuffle, so that a hub is as many small rows as there are tasks.  Negatives are
drawn by a key made of triple and epoch.  Nothing but each epoch's loss reaches the driver, and every epoch's table is a checkpoint.

Ranks are filtered: an answer that is a known triple isn't counted as better.  Blocks of points (a head and a relation) meet blocks of nodes in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.frames import checkpointed, written
from factloom.operators.ordering import numbered

NODE, RELATION, PROJECTION, LOSS = range(4)
#: Triples that one task trains on, and rows in the blocks that meet for ranks.
TRIPLES, BLOCK = 50_000, 4096


@dataclass(frozen=True)
class Model:
    """Settings: ``projected`` gives each relation a space of its own (a square matrix that starts as the identity)."""

    dim: int = 16
    margin: float = 1.0
    rate: float = 0.02
    batch: int = 256
    projected: bool = False

    @property
    def columns(self) -> list[str]:
        return [f"v{i}" for i in range(self.dim)]

    @property
    def schema(self) -> str:
        return "kind int, id long, " + ", ".join(f"{c} double" for c in self.columns)


def _dense(names: DataFrame, column: str) -> DataFrame:
    """(column, id) with ids from 0 in the order of a 63-bit hash."""
    hashed = names.withColumn("_hash", F.shiftrightunsigned(F.xxhash64(column), 1))
    return numbered(hashed, "_hash", "id", 1 << 48).select(column, "id")


def indexed(triples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, id), (relation, id) and the distinct triples as (h, r, t), of ``triples`` (subject, predicate, object); rows with nulls are left out."""
    whole = triples.select("subject", "predicate", "object").dropna().distinct()
    nodes = checkpointed(_dense(whole.select(F.explode(F.array("subject", "object")).alias("node")).distinct(), "node"))
    relations = checkpointed(_dense(whole.select(F.col("predicate").alias("relation")).distinct(), "relation"))
    of = lambda df, name, column, new: df.select(F.col(name).alias(column), F.col("id").alias(new))
    met = whole.join(of(relations, "relation", "predicate", "r"), "predicate").join(of(nodes, "node", "subject", "h"), "subject").join(of(nodes, "node", "object", "t"), "object")
    return nodes, relations, checkpointed(met.select("h", "r", "t"))


def started(nodes: DataFrame, relations: DataFrame, model: Model) -> DataFrame:
    """The parameters before training: hashes of kind and id, evenly from -6 to 6 over the root of the dimension."""
    bound = 6 / model.dim**0.5
    kinds = nodes.select(F.lit(NODE).alias("kind"), "id").unionByName(relations.select(F.lit(RELATION).alias("kind"), "id"))
    start = [(F.pmod(F.xxhash64("kind", "id", F.lit(i)), F.lit(1 << 32)) / float(1 << 31) - 1) * bound for i in range(model.dim)]
    found = kinds.select("kind", "id", *[s.alias(c) for s, c in zip(start, model.columns)])
    if model.projected:
        rows = relations.select((F.col("id") * model.dim).alias("first"), F.explode(F.sequence(F.lit(0), F.lit(model.dim - 1))).alias("row"))
        found = found.unionByName(rows.select(F.lit(PROJECTION).alias("kind"), (F.col("first") + F.col("row")).alias("id"), *[(F.col("row") == i).cast("double").alias(c) for i, c in enumerate(model.columns)]))
    return checkpointed(found)


def with_negatives(triples: DataFrame, nodes: int, parts: int, epoch: int) -> DataFrame:
    """``triples`` with ``neg``, a node that takes the place of the tail or (``head``) the head, and ``p``, the task that trains on it."""
    key = lambda n: F.xxhash64("h", "r", "t", F.lit(epoch), F.lit(n))
    return triples.select("h", "r", "t", F.pmod(key(0), F.lit(nodes)).alias("neg"), (F.pmod(key(1), F.lit(2)) == 0).alias("head"), F.pmod(F.xxhash64("h", "r", "t"), F.lit(parts)).alias("p"))


def steps(h, r, t, neg, head, nodes, relations, projections, model: Model) -> float:
    """Mini-batch steps over triples given by places in ``nodes`` and ``relations``, which change in place; the sum of losses.

    A batch's gradient is the sum over its triples; nodes and relations are then brought back into the unit ball.
    """
    import numpy as np

    total = 0.0
    for i in range(0, len(h), model.batch):
        b = slice(i, i + model.batch)
        hn, tn = np.where(head[b], neg[b], h[b]), np.where(head[b], t[b], neg[b])
        gap, gap_n = nodes[h[b]] - nodes[t[b]], nodes[hn] - nodes[tn]
        if projections is not None:
            m = projections[r[b]]
            e, en = (np.einsum("nij,nj->ni", m, x) + relations[r[b]] for x in (gap, gap_n))
        else:
            e, en = gap + relations[r[b]], gap_n + relations[r[b]]
        d, dn = (np.sqrt((x * x).sum(axis=1)) for x in (e, en))
        loss = model.margin + d - dn
        on = (loss > 0)[:, None]
        total += float(loss[loss > 0].sum())
        u, un = (np.where(on & (x > 0)[:, None], y / np.maximum(x, 1e-300)[:, None], 0.0) for x, y in ((d, e), (dn, en)))
        if projections is not None:
            g, gn = (np.einsum("nij,ni->nj", m, x) for x in (u, un))
            change = u[:, :, None] * gap[:, None, :] - un[:, :, None] * gap_n[:, None, :]
            np.subtract.at(projections, r[b], model.rate * change)
        else:
            g, gn = u, un
        for at, x in ((h[b], g), (t[b], -g), (hn, -gn), (tn, gn)):
            np.subtract.at(nodes, at, model.rate * x)
        np.subtract.at(relations, r[b], model.rate * (u - un))
        for values, at in ((nodes, np.unique(np.concatenate([h[b], t[b], hn, tn]))), (relations, np.unique(r[b]))):
            values[at] /= np.maximum(1.0, np.sqrt((values[at] ** 2).sum(axis=1)))[:, None]
    return total


def _task(model: Model):
    def run(triples, known):
        import numpy as np
        import pandas as pd

        triples, known = triples.sort_values(["h", "r", "t"]), known.sort_values(["kind", "id"])
        if not len(triples):
            return pd.DataFrame(columns=["kind", "id", *model.columns])
        kinds, ids, values = known["kind"].to_numpy(), known["id"].to_numpy(), known[model.columns].to_numpy(float).copy()
        of = [np.flatnonzero(kinds == k) for k in (NODE, RELATION, PROJECTION)]
        nodes, relations, projections = (values[x] for x in of)
        place = lambda k, name: np.searchsorted(ids[of[k]], triples[name].to_numpy())
        cube = projections.reshape(len(relations), model.dim, model.dim) if model.projected else None
        loss = steps(place(NODE, "h"), place(RELATION, "r"), place(NODE, "t"), place(NODE, "neg"), triples["head"].to_numpy(bool), nodes, relations, cube, model)
        out = pd.DataFrame(np.concatenate([nodes, relations, projections]), columns=model.columns)
        out.insert(0, "id", np.concatenate([ids[x] for x in of]))
        out.insert(0, "kind", np.concatenate([kinds[x] for x in of]))
        said = pd.DataFrame([[LOSS, int(triples["p"].iloc[0]), loss, float(len(triples)), *[0.0] * (model.dim - 2)]], columns=out.columns)
        return pd.concat([out, said]).astype({"kind": "int32", "id": "int64"})

    return run


def epoch_of(triples: DataFrame, parameters: DataFrame, nodes: int, parts: int, epoch: int, model: Model) -> DataFrame:
    """The parameters after one epoch, with a row of kind ``LOSS`` (v0: sum of losses, v1: triples) for each task."""
    dealt = with_negatives(triples, nodes, parts, epoch)
    named = lambda k, c: F.struct(F.lit(k).alias("kind"), c.cast("long").alias("id"))
    wanted = [named(NODE, F.col(c)) for c in ("h", "t", "neg")] + [named(RELATION, F.col("r"))]
    needs = dealt.select("p", F.explode(F.array(*wanted)).alias("x")).select("p", "x.*").distinct()
    if model.projected:
        rows = needs.where(F.col("kind") == RELATION).select("p", F.explode(F.sequence(F.col("id") * model.dim, F.col("id") * model.dim + model.dim - 1)).alias("id"))
        needs = needs.unionByName(rows.withColumn("kind", F.lit(PROJECTION)))
    sent = needs.withColumnRenamed("p", "to").join(parameters.where(F.col("kind") < LOSS), ["kind", "id"])
    changed = dealt.groupBy("p").cogroup(sent.groupBy("to")).applyInPandas(_task(model), model.schema)
    mean = changed.groupBy("kind", "id").agg(*[F.avg(c).alias(f"new_{c}") for c in model.columns])
    now = parameters.where(F.col("kind") < LOSS).join(mean, ["kind", "id"], "left").select("kind", "id", *[F.coalesce(f"new_{c}", c).alias(c) for c in model.columns])
    # losses come out of the same pass over the tasks: both sides read one shuffle
    return now.unionByName(mean.where(F.col("kind") == LOSS).select("kind", "id", *[F.col(f"new_{c}").alias(c) for c in model.columns]))


def train(triples: DataFrame, nodes: DataFrame, relations: DataFrame, model: Model = Model(), epochs: int = 5, size: int = TRIPLES) -> tuple[DataFrame, list[float]]:
    """The parameters after ``epochs``, and the mean loss of each; ``triples`` is (h, r, t) over the ids of ``nodes`` and ``relations``."""
    n, parts = nodes.count(), max(1, -(-triples.count() // size))
    parameters, losses = started(nodes, relations, model), []
    for epoch in range(epochs if n else 0):
        parameters = checkpointed(epoch_of(triples, parameters, n, parts, epoch, model))
        said = parameters.where(F.col("kind") == LOSS).agg(F.sum("v0") / F.sum("v1")).first()
        losses.append(said[0] or 0.0)
    return parameters.where(F.col("kind") < LOSS), losses


def _projected(e, m):
    """The rows of ``e``, projected by ``m`` where there is one."""
    return e if m is None else (e[:, None, :] * m[None]).sum(axis=-1)  # row by row, whatever the block


def _apart(a, b):
    """Distances of rows."""
    import numpy as np

    return np.sqrt(((a - b) ** 2).sum(axis=-1))


def _rows(column, width: int):
    """An Arrow column of lists of ``width`` numbers as an array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _nearer(at, own, e, slack: int = 64):
    """For each of the points ``at`` how many rows of ``e`` are nearer than each of its distances ``own`` (a list for each point).

    Squared distances come from one product of matrices; what is so near to a bound that rounding could decide is measured again.
    """
    import numpy as np

    dim, found = at.shape[1], []
    right = np.concatenate([e, (e * e).sum(axis=1)[:, None]], axis=1).T.copy()
    reach = float(np.sqrt(right[-1].max(initial=0.0)))
    for i in range(0, len(at), 32):
        some = at[i : i + 32]
        squares = np.concatenate([-2 * some, np.ones((len(some), 1))], axis=1) @ right  # less the point's own square
        for p, row, bounds in zip(some, squares, own[i : i + 32]):
            base = float(p @ p)
            doubt = slack * dim * 2.0**-53 * (base**0.5 + reach + max(bounds)) ** 2
            counts = []
            for d in bounds:
                low, high = d * d - base - doubt, d * d - base + doubt
                n = np.count_nonzero(row < low)
                if np.count_nonzero(row <= high) != n:
                    n += int((_apart(p[None], e[(row >= low) & (row <= high)]) < d).sum())
                counts.append(n)
            found.append(counts)
    return found


def ranks(test: DataFrame, known: DataFrame, parameters: DataFrame, model: Model = Model(), block: int = BLOCK) -> DataFrame:
    """``test`` (h, r, t) with ``rank``: one more than the number of nodes that are nearer to head plus relation than the tail is.

    Nodes that make a triple of ``known`` or ``test`` with the same head and relation aren't counted.  Triples with a node or
    relation that the parameters lack are left out.  Every triple is measured once; those of one head and relation are put in order,
    which says how many known ones are nearer, and share the distances from their point to blocks of nodes.
    """
    listed = F.array(*model.columns)
    of = lambda k, id_, v: parameters.where(F.col("kind") == k).select(F.col("id").alias(id_), listed.alias(v))
    asked = test.select("h", "r", "t").distinct().withColumn("asked", F.lit(True))
    near = known.select("h", "r", "t").join(asked.select("h", "r").distinct(), ["h", "r"], "left_semi").withColumn("asked", F.lit(False))
    each = asked.unionByName(near).groupBy("h", "r", "t").agg(F.max("asked").alias("asked"))
    relations = of(RELATION, "r", "rv")
    if model.projected:
        rows = parameters.where(F.col("kind") == PROJECTION).select(F.expr(f"id div {model.dim}").alias("r"), F.struct("id", listed.alias("v")).alias("row"))
        relations = relations.join(rows.groupBy("r").agg(F.flatten(F.transform(F.array_sort(F.collect_list("row")), lambda x: x["v"])).alias("m")), "r")  # dim rows a relation
    else:
        relations = relations.withColumn("m", F.array().cast("array<double>"))
    dim, projected = model.dim, model.projected

    def measured(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            head, tail, step = (_rows(batch[c], dim) for c in ("hv", "tv", "rv"))
            if projected:
                m = _rows(batch["m"], dim * dim).reshape(-1, dim, dim)
                head, tail = ((x[:, None, :] * m).sum(axis=-1) for x in (head, tail))
            at = head + step
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype="int32") * dim), pa.array(at.reshape(-1)))
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in ("h", "r", "t", "asked")} | {"own": pa.array(_apart(at, tail)), "at": lists})

    shape = "h long, r long, t long, asked boolean, own double, at array<double>"
    vectors = each.join(relations, "r").join(of(NODE, "h", "hv"), "h").join(of(NODE, "t", "tv"), "t")
    found = vectors.select("h", "r", "t", "asked", "hv", "rv", "tv", "m").mapInArrow(measured, shape)
    better = F.rank().over(W.partitionBy("h", "r").orderBy("own")) - 1  # of the known ones
    scored = written(found.withColumn("known", better).where("asked"))
    points = scored.groupBy("h", "r").agg(F.first("at").alias("at"), F.sort_array(F.collect_set("own")).alias("owns")).join(relations.select("r", "m"), "r")  # the known ones of one head and relation
    parts = lambda df: F.lit(max(1, -(-df.count() // block)))
    queries = points.select(F.struct("h", "r", "at", "owns", "m").alias("q"), F.pmod(F.xxhash64("h", "r"), parts(scored)).alias("b"))
    packed = written(queries.groupBy("b").agg(F.collect_list("q").alias("qs")))
    nodes = parameters.where(F.col("kind") == NODE)
    node_blocks = nodes.select(listed.alias("v"), F.pmod(F.xxhash64("id"), parts(nodes)).alias("c"))
    packed_nodes = written(node_blocks.groupBy("c").agg(F.flatten(F.collect_list("v")).alias("es")))

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                qs, e = batch["qs"][i].values, _rows(batch["es"].slice(i, 1), 1).reshape(-1, dim)
                h, r, at = qs.field("h").to_numpy(), qs.field("r").to_numpy(), _rows(qs.field("at"), dim)
                owns, ms = qs.field("owns").to_pylist(), _rows(qs.field("m"), dim * dim).reshape(-1, dim, dim) if projected else None
                for one in np.unique(r) if projected else (None,):
                    mine = np.flatnonzero(r == one) if projected else np.arange(len(r))
                    counts = _nearer(at[mine], [owns[x] for x in mine], _projected(e, ms[mine[0]] if projected else None))
                    n = [len(x) for x in counts]
                    yield pa.RecordBatch.from_pydict({"h": np.repeat(h[mine], n), "r": np.repeat(r[mine], n), "own": np.concatenate([owns[x] for x in mine]), "nearer": np.concatenate(counts).astype("int64")})

    # blocks of the points with all blocks of nodes
    nearer = packed.select("qs").crossJoin(packed_nodes.select("es")).mapInArrow(count, "h long, r long, own double, nearer long").groupBy("h", "r", "own").agg(F.sum("nearer").alias("nearer"))
    return scored.join(nearer, ["h", "r", "own"]).select("h", "r", "t", (1 + F.col("nearer") - F.col("known")).alias("rank"))


def hits(found: DataFrame, ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """One row: the number of ranks, the mean of their reciprocals, and the share of ranks up to each k."""
    return found.agg(F.count("*").alias("n"), F.avg(1 / F.col("rank")).alias("mrr"), *[F.avg((F.col("rank") <= k).cast("double")).alias(f"hits_{k}") for k in ks])
