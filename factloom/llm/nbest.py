"""SentencePiece encoding and decoding with N-best segmentation.

The ids of a text are those of the model's own encoder.  Beside them stand the N best segmentations, the
model's own first: the lattice of a text has an arc for every place where a piece of the vocabulary stands;
forward Viterbi gives the best score of every prefix, and a backward A* search from the end uses these as its
heuristic, which is exact, so that the segmentations come out in the order of their scores and nothing is
expanded twice without need.

A merge model has no scores that may be summed, only the ranks of its merges.  A piece of rank r scores
-log(r + 2), as if words were as frequent as Zipf's law has it, and an arc that is not on the model's own path
loses ``OFF`` for each of its characters besides.  No piece costs as much as that, so the model's own path is
the best one and the others follow by how far they leave it, then by how likely their pieces are.  A unigram
model's scores are its own, and its best path is the best anyway.

No piece has a space mark after another character or holds a line end, so the lattice of a text is a
chain of the lattices of its atoms (a run of space marks with what follows, or a line end).  Atoms are
searched one by one and remembered within a task; the N best of the text are the N least sums of what
its atoms lose against their best.  Only the N - 1 atoms that lose least can be changed in them.  A
vocabulary for which this does not hold is searched over the whole text at once.

Where no piece covers a character it counts as unknown and is written as the byte pieces of its UTF-8
form.  The space mark itself (U+2581), standing in a text, is written in bytes too, where the model's encoder
would turn it into a space, so that decoding gives back the text exactly.  Equal scores come out in the order
of the search, which is fixed.

Defined cases: a null text gives nulls; an empty text has no pieces, score 0 and itself as the only
segmentation; repeated rows get equal results; an empty table gives an empty result; other columns
are ignored by :func:`segment` and passed through by :func:`encode` whatever their names.  A very long word is
one atom; time and memory grow with its length in proportion.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain, product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import fresh

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
MARK = "▁"
#: Losses from here on mean that there is no second segmentation.
ALONE = 1e200
#: Below any score.
NEVER = -1e300
#: Stands for a text's own mark within the search; no text in UTF-8 holds a lone surrogate.
OWN_MARK = "\ud800"
UNKNOWN_PENALTY = 10
#: What an arc off a merge model's own path loses for each character: more than any piece does by its rank.
OFF = 24.0
#: A Python worker remembers so many atoms, and so many searches for the N best; others are done again.
REMEMBERED, SEARCHED = 600_000, 50_000


class Vocabulary:
    """A model's pieces with ids and scores, its own encoder, and the search over the lattice of its pieces."""

    def __init__(self, model: bytes):
        """``model`` is the content of a model file that encodes what it doesn't know in bytes."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        self.model, self.merges = model, proto.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.encoder = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        usable = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in ids]
        score = (lambda x: -math.log(2 - x)) if self.merges else float
        self.pieces = [(sp.id_to_piece(i), score(sp.get_score(i)) if ok else 0.0, ok) for i, ok in zip(ids, usable)]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.off = OFF if self.merges else 0.0
        self.usable = {p: (i, s) for i, (p, s, ok) in enumerate(self.pieces) if ok}
        self.prefixes = {p[:k] for p in self.usable for k in range(1, len(p) + 1)}
        self.unknown = min((s for _, s in self.usable.values()), default=0) - UNKNOWN_PENALTY
        self.in_bytes = {i: b for b, i in enumerate(self.byte_ids)}
        # what each id adds to a text; a byte beyond ASCII is only a part of a character
        self.shown = [p.replace(MARK, " ") for p, _, _ in self.pieces]
        for b, i in enumerate(self.byte_ids):
            self.shown[i] = chr(b)
        self.partial = {i for b, i in enumerate(self.byte_ids) if b > 127}
        chained = not any(MARK in p.lstrip(MARK) or "\n" in p for p in self.usable)
        self.atoms = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n") if chained else re.compile("(?s).+")
        self._trie()
        self.forget()

    def forget(self) -> None:
        """Empty the memory of atoms: a number for each, and by number score, loss and place among all ids."""
        import numpy as np

        self.numbers: dict[str, int] = {}
        self.found = np.zeros((1024, 4))  # score, loss, start, length
        self.flat, self.used = np.zeros(4096, np.int32), 0
        self.searched: dict[tuple[str, int], list] = {}

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read())

    def __reduce__(self):
        return Vocabulary, (self.model,)

    def own(self, atoms: Sequence[str]) -> list[list[int]]:
        """The model's own ids of each atom."""
        # the encoder puts a space mark in front: it stands for the atom's first one, or is taken off again with the line end behind it
        texts = [a[1:].replace(MARK, " ") if a[0] == MARK else "\n" + a for a in atoms]
        lone = [OWN_MARK in t for t in texts]
        found = self.encoder.encode([" " if odd or not t else t for t, odd in zip(texts, lone)])
        mark = [self.usable[MARK][0]]
        out = []
        for atom, text, odd, ids in zip(atoms, texts, lone, found):
            if odd:  # what stands between the text's own marks is encoded apart
                ids = []
                for i, part in enumerate(atom.split(OWN_MARK)):
                    ids += [self.byte_ids[b] for b in MARK.encode()] if i else []
                    ids += self.own([part])[0] if part else []
                out.append(ids)
            else:
                out.append(mark if not text else ids if atom[0] == MARK else ids[2:])
        return out

    def _steps(self, ids: Sequence[int]) -> list[tuple[int, int, int]]:
        """The arcs (start, end, piece) of ids, a character in bytes as one arc of an unknown piece."""
        arcs, at, waiting = [], 0, 0
        for i in ids:
            b = self.in_bytes.get(i)
            if b is None:
                end = at + len(self.pieces[i][0])
                arcs.append((at, end, i))
                at = end
                continue
            waiting = waiting - 1 if waiting else 3 if b >= 0xF0 else 2 if b >= 0xE0 else 1 if b >= 0xC0 else 0
            if not waiting:
                arcs.append((at, at + 1, -1))
                at += 1
        return arcs

    def _trie(self) -> None:
        """The prefixes of the pieces as sorted transitions (node, character), for searches in bulk."""
        import numpy as np

        self.length = np.array([len(p) for p, _, _ in self.pieces], np.int64)
        self.is_byte = np.zeros(len(self.pieces), bool)
        self.is_byte[self.byte_ids] = True
        node = {"": 0} | {p: i for i, p in enumerate(sorted(self.prefixes), 1)}
        self.chars = np.zeros(0x110000, np.int32)  # 0: in no piece
        alphabet = sorted({c for p in self.prefixes for c in p})
        self.chars[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.width = len(alphabet) + 1
        moves = sorted((node[p[:-1]] * self.width + int(self.chars[ord(p[-1])]), i) for p, i in node.items() if p)
        self.moves = np.array([k for k, _ in moves] + [1 << 62], np.int64)
        self.to = np.array([i for _, i in moves] + [0], np.int64)
        self.piece_at = np.full(len(node), -1, np.int64)
        self.score_at = np.full(len(node), NEVER)
        for p, (i, score) in self.usable.items():
            self.piece_at[node[p]], self.score_at[node[p]] = i, score

    def many(self, atoms: Sequence[str], ids, counts):
        """:meth:`two` of atoms of one length, all at once: scores and losses, given the own ``ids`` of all and their ``counts``."""
        import numpy as np

        m, size = len(atoms), len(atoms[0])
        text = self.chars[np.frombuffer("".join(atoms).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, size)]
        best, after = np.full((m, size + 1), NEVER), np.full((m, size + 1), NEVER)
        best[:, 0], after[:, size] = 0, 0
        on = np.full((m, size + 1), -1, np.int64)  # where the own path's arc into a place begins
        ends = np.cumsum(self.length[ids]) - np.repeat(np.arange(m) * size, counts)
        on[np.repeat(np.arange(m), counts), ends] = ends - self.length[ids]
        arcs = []

        def arc(rows, start: int, end: int, score) -> None:
            score = score - np.where(on[rows, end] == start, 0.0, self.off * (end - start))
            arcs.append((rows, start, end, score))
            best[rows, end] = np.maximum(best[rows, end], best[rows, start] + score)

        everyone = np.arange(m)
        for start in range(size):
            rows, at = everyone, np.zeros(m, np.int64)
            for end in range(start + 1, size + 1):
                key = at * self.width + text[rows, end - 1]
                found = np.searchsorted(self.moves, key)
                there = self.moves[found] == key
                rows, at = rows[there], self.to[found[there]]
                hit = self.piece_at[at] >= 0
                if end == start + 1:
                    bare = np.ones(m, bool)
                    bare[rows[hit]] = False
                    if bare.any():
                        arc(everyone[bare], start, end, np.full(int(bare.sum()), float(self.unknown)))
                if not len(rows):
                    break
                if hit.any():
                    arc(rows[hit], start, end, self.score_at[at[hit]])
        for rows, start, end, score in reversed(arcs):
            after[rows, start] = np.maximum(after[rows, start], after[rows, end] + score)
        other, top = np.full(m, NEVER), np.zeros(m)
        for rows, start, end, score in arcs:
            off = on[rows, end] != start
            np.add.at(top, rows[~off], score[~off])
            rows = rows[off]
            other[rows] = np.maximum(other[rows], best[rows, start] + score[off] + after[rows, end])
        return top, top - other

    def _lattice(self, atom: str, path: Sequence[tuple[int, int, int]]) -> tuple[list[list[tuple[int, int, float]]], list[float]]:
        """The arcs (start, piece, score) into each end, longest first, and the best score of each prefix; ``path`` is the own one."""
        usable, prefixes, size, off = self.usable, self.prefixes, len(atom), self.off
        arcs: list[list[tuple[int, int, float]]] = [[] for _ in range(size + 1)]
        best: list[float] = [NEVER] * (size + 1)
        best[0] = 0.0
        on = {end: start for start, end, _ in path}
        for start in range(size):
            before, end = best[start], start + 1
            piece = atom[start]
            if piece not in usable:
                score = self.unknown - (0.0 if on.get(end) == start else off)
                arcs[end].append((start, -1, score))
                if before + score > best[end]:
                    best[end] = before + score
            while piece in prefixes:
                hit = usable.get(piece)
                if hit is not None:
                    score = hit[1] - (0.0 if on.get(end) == start else off * (end - start))
                    arcs[end].append((start, hit[0], score))
                    if before + score > best[end]:
                        best[end] = before + score
                if end == size:
                    break
                end += 1
                piece = atom[start:end]
        return arcs, best

    def _ids(self, atom: str, path) -> tuple[int, ...]:
        """The ids along (start, end, piece) arcs, unknown characters in bytes."""
        return tuple(chain.from_iterable([piece] if piece >= 0 else [self.byte_ids[b] for b in self._raw(atom[start:end])] for start, end, piece in path))

    def two(self, atom: str, path: Sequence[tuple[int, int, int]]) -> tuple[float, float]:
        """Of an atom with the own ``path``: that path's score, and what the second best loses.

        Any other path has an arc off it; forward and backward scores give the best path through each.
        """
        arcs, best = self._lattice(atom, path)
        size, on = len(atom), {end: start for start, end, _ in path}
        after = [NEVER] * size + [0.0]
        other, top = NEVER, 0.0
        for end in range(size, 0, -1):
            rest = after[end]
            for start, _, score in arcs[end]:
                if rest + score > after[start]:
                    after[start] = rest + score
                if on.get(end) == start:
                    top += score
                elif best[start] + score + rest > other:
                    other = best[start] + score + rest
        return top, top - other

    def paths(self, atom: str, n: int, own: Sequence[int] | None = None) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best (score, ids) of an atom, in order, by A* from its end."""
        arcs, best = self._lattice(atom, self._steps(self.own([atom])[0] if own is None else own))
        out: list[tuple[float, tuple[int, ...]]] = []
        heap = [(-best[-1], 0, len(atom), 0.0, None)]
        count = 0
        while heap and len(out) < n:
            least, _, at, after, path = heappop(heap)
            if at == 0:
                steps = []
                while path is not None:
                    step, path = path
                    steps.append(step)
                out.append((-least, self._ids(atom, steps)))
                continue
            for start, piece, score in arcs[at]:
                count -= 1  # of equals the last one found, so that a long atom is walked straight to its start
                heappush(heap, (-(best[start] + score + after), count, start, score + after, ((start, at, piece), path)))
        return out

    @staticmethod
    def _raw(char: str) -> bytes:
        return (MARK if char == OWN_MARK else char).encode()

    def _remember(self, atoms: Sequence[str], scores, losses, lengths, ids) -> None:
        import numpy as np

        n, first = len(atoms), len(self.numbers)
        while len(self.found) < first + n:
            self.found = np.concatenate([self.found, np.zeros_like(self.found)])
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        starts = self.used + np.cumsum(lengths) - lengths
        self.found[first : first + n] = np.stack([scores, losses, starts, lengths], axis=1)
        self.used += len(ids)
        self.numbers.update(zip(atoms, range(first, first + n)))

    def learn(self, atoms: set[str]) -> None:
        """Have ids, scores and losses at hand for all ``atoms``; when memory is full, for these alone."""
        import numpy as np

        if len(self.numbers) > REMEMBERED:
            self.forget()
        lengths: dict[int, list[str]] = {}
        for atom in atoms:
            if atom not in self.numbers:
                lengths.setdefault(len(atom), []).append(atom)
        for size, new in lengths.items():
            for at in range(0, len(new), 4096):
                part = new[at : at + 4096]
                own = self.own(part)
                counts = np.fromiter(map(len, own), np.int64, len(own))
                ids = np.fromiter(chain.from_iterable(own), np.int64, int(counts.sum()))
                scores, losses = np.zeros(len(part)), np.zeros(len(part))
                # in bulk where the atoms are short and many, and no character stands in bytes
                alone = np.full(len(part), size > 64 or len(part) < 8)
                alone[np.repeat(np.arange(len(part)), counts)[self.is_byte[ids]]] = True
                bulk = ~alone
                if bulk.any():
                    scores[bulk], losses[bulk] = self.many([part[i] for i in np.flatnonzero(bulk)], ids[np.repeat(bulk, counts)], counts[bulk])
                for i in np.flatnonzero(alone).tolist():
                    scores[i], losses[i] = self.two(part[i], self._steps(own[i]))
                self._remember(part, scores, losses, counts, ids)

    def _search(self, atom: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """:meth:`paths`, remembered."""
        found = self.searched.get((atom, n))
        if found is None:
            if len(self.searched) >= SEARCHED:
                self.searched.clear()
            i = self.numbers[atom]
            start, length = self.found[i, 2:].astype(int)
            found = self.searched[atom, n] = self.paths(atom, n, self.flat[start : start + length].tolist())
        return found

    def split(self, text: str) -> list[str]:
        """The atoms of a text."""
        return self.atoms.findall(MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK)) if text else []

    def segment_all(self, texts: Sequence[str], n: int):
        """(ids of all texts in one array, number of ids by text, the ``n`` best of each as (score, changes)).

        A change is (at, length, ids): so many pieces of the best segmentation from ``at`` on give way
        to these ids.
        """
        import numpy as np

        atoms = [self.split(t) for t in texts]
        self.learn(set(chain.from_iterable(atoms)))
        sizes = np.array([len(a) for a in atoms])
        which = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(atoms)), np.int64, int(sizes.sum()))
        scores, losses, starts, counts = self.found[which].T
        starts, counts = starts.astype(np.int64), counts.astype(np.int64)
        ends = np.cumsum(counts)
        ids = self.flat[np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)]
        out, lengths, at = [], [], 0
        for own, size in zip(atoms, sizes.tolist()):
            here = slice(at, at + size)
            out.append(self._combine(own, float(scores[here].sum()), losses[here], counts[here], n) if own else [(0.0, [])])
            lengths.append(int(counts[here].sum()))
            at += size
        return ids, lengths, out

    def segment(self, text: str, n: int) -> tuple[list[int], list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]:
        """The ids of the best segmentation of one text, and its ``n`` best as in :meth:`segment_all`."""
        ids, _, (best,) = self.segment_all([text], n)
        return ids.tolist(), best

    def _combine(self, atoms: list[str], score: float, losses, counts, n: int) -> list:
        """The ``n`` least sums of losses, over the n - 1 atoms that lose least (of equals the first ones)."""
        import numpy as np

        k = min(n - 1, len(atoms))
        if k <= 0:
            return [(score, [])]
        bound = np.partition(losses, k - 1)[k - 1]
        sure, ties = np.flatnonzero(losses < bound), np.flatnonzero(losses == bound)
        open_ = [int(i) for i in sorted([*sure, *ties[: k - len(sure)]]) if losses[i] < ALONE]
        choices = [[(best[0][0] - s, i, ids) for s, ids in best] for i in open_ for best in [self._search(atoms[i], n)]]
        lost = [[x[0] for x in c] for c in choices]
        ranked = []
        for at in _ranks(n, tuple(map(len, choices))):
            sums = [one[j] for one, j in zip(lost, at)]
            ranked.append((sum(sums), len(sums) - sums.count(0), at))
        ranked.sort()
        out = []
        for loss, _, at in ranked[:n]:
            changed = [(int(counts[: c[0][1]].sum()), c[0][2], c[j][2]) for c, j in zip(choices, at) if j]
            out.append((score - loss, [_difference(*c) for c in changed]))
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The text of the ids."""
        if self.partial.isdisjoint(ids):
            return "".join([self.shown[i] for i in ids])[1:]
        in_bytes, raw = self.in_bytes, bytearray()
        for i in ids:
            b = in_bytes.get(i)
            raw += bytes((b,)) if b is not None else self.shown[i].encode()
        return raw[1:].decode()


@lru_cache(4096)
def _ranks(n: int, lengths: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The places in lists of these lengths, each in order, that can make one of the ``n`` least sums: a choice has
    as many others before it as the product of its places, from 1, less one."""
    return [at for at in product(*map(range, lengths)) if math.prod([j + 1 for j in at]) <= n]


def _difference(at: int, old: Sequence[int], new: Sequence[int]) -> tuple[int, int, tuple[int, ...]]:
    """The change from ``old`` ids, from ``at`` on, to ``new`` ones without what both begin and end with."""
    least = min(len(old), len(new))
    head = next((i for i in range(least) if old[i] != new[i]), least)
    tail = next((i for i in range(least - head) if old[-1 - i] != new[-1 - i]), least - head)
    return at + head, len(old) - head - tail, tuple(new[head : len(new) - tail])


SEGMENTED = "ids array<int>, n_pieces long, score double, n_best array<struct<score:double,changes:array<struct<at:int,length:int,ids:array<int>>>>>"
#: Rows that are searched before their results leave a task.
ROWS = 512


def _shared(spark: SparkSession, vocabulary: Vocabulary):
    """The vocabulary on all executors: a few MB, by the size of its file."""
    return spark.sparkContext.broadcast(vocabulary)


def encode(docs: DataFrame, path: str = MODEL, n: int = N_BEST, check: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all but the text, unless given) with the columns of :data:`SEGMENTED`.

    ``check`` names a further column: whether decoding the ids gives back the text.  Columns of the
    result that a kept column's name would clash with get a longer name.
    """
    kept = [c for c in docs.columns if c != "text"] if keep is None else list(keep)
    text = fresh(docs, "_text")
    table = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").cast("string").alias(text))
    made = [T.StructField(fresh(docs.select(*[F.col(f"`{c}`") for c in kept]), f.name), f.dataType) for f in T._parse_datatype_string(SEGMENTED).fields]
    schema = T.StructType([*(f for f in table.schema if f.name != text), *made, *([T.StructField(check, T.BooleanType())] if check else [])])
    shared = _shared(docs.sparkSession, Vocabulary.load(path))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        vocabulary, arrow = shared.value, to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(part.num_columns - 1).to_pylist()
                ids, lengths, found = vocabulary.segment_all([t or "" for t in texts], n)
                null = [t is None for t in texts]
                best = [
                    None if none else [{"score": float(s), "changes": [{"at": x, "length": y, "ids": list(z)} for x, y, z in changes]} for s, changes in b]
                    for none, b in zip(null, found)
                ]
                offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int32)]).astype(np.int32)
                columns = [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=pa.array(null))]
                columns += [pa.array([None if x else k for x, k in zip(null, lengths)], pa.int64()), pa.array([None if b is None else b[0]["score"] for b in best], pa.float64())]
                columns.append(pa.array(best, arrow.field(len(kept) + 3).type))
                if check:
                    cut = zip(texts, offsets[:-1].tolist(), offsets[1:].tolist())
                    columns.append(pa.array([None if t is None else vocabulary.decode(ids[a:b].tolist()) == t for t, a, b in cut], pa.bool_()))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return table.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", text: str = "text", path: str = MODEL) -> DataFrame:
    """``encoded`` with the column ``text`` decoded from the array ``ids``."""
    shared = _shared(encoded.sparkSession, Vocabulary.load(path))
    table = encoded.drop(text)
    schema = T.StructType([*table.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        vocabulary = shared.value
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            made = pa.array([None if r is None else vocabulary.decode(r) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, text])

    return table.mapInArrow(run, schema)
