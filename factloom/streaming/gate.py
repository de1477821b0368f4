"""The reconciliation gate on a stream of drafts, with the head of each key as state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import delta_clean
from factloom.operators.gate import disposition_of, malformed, step

DECIDED = "semantic_key string, arrival long, reason string, head_arrival long, owner_seq long"
HEAD = "clean string, tier int, auto boolean, at timestamp, arrival long, owner_seq long"


def _decided(rows: list[tuple]):
    """Rows of :data:`DECIDED`; whole numbers stay exact beside nulls."""
    import pandas as pd

    columns = list(zip(*rows)) or [()] * 5
    kinds = ("object", "int64", "object", "Int64", "Int64")
    return pd.DataFrame({n: pd.array(list(c), dtype=k) for n, c, k in zip(("semantic_key", "arrival", "reason", "head_arrival", "owner_seq"), columns, kinds)})


def fold(drafts: DataFrame) -> DataFrame:
    """(semantic_key, arrival, reason, head_arrival, owner_seq, disposition) for each draft of a stream.

    Within a micro-batch a key's drafts go in the order of ``arrival``; over micro-batches the head is
    kept as state, so the result is that of the batch fold where arrivals come in order.  A draft older
    than its head is never dropped: it is judged, and its tier or instant rejects it.
    """
    import pandas as pd

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        head = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("arrival")
        out = []
        for r in rows.itertuples(index=False):
            before = head[4] if head else None
            reason, head = step(head, r.bad, r.clean, int(r.tier), bool(r.auto_update), r.valid_from, int(r.arrival))
            out.append((key[0], int(r.arrival), reason, before, head[5] if head else None))
        if head:
            state.update(head)
        yield _decided(out)

    given = _given(drafts)
    return given.groupBy("semantic_key").applyInPandasWithState(run, DECIDED, HEAD, "append", "NoTimeout").withColumn("disposition", disposition_of(F.col("reason")))


def _given(drafts: DataFrame, *more: str) -> DataFrame:
    return drafts.select("semantic_key", "tier", "auto_update", "valid_from", "arrival", *more, F.coalesce(malformed(drafts), F.lit("")).alias("bad"), delta_clean(F.col("obj")).alias("clean"))


def _reorder(delay_ms: int):
    from pyspark.sql.streaming import StatefulProcessor

    class Reorder(StatefulProcessor):
        """Holds a key's drafts until the watermark says that none before them can come, and its head."""

        def init(self, handle) -> None:
            self.handle = handle
            self.head = handle.getValueState("head", HEAD)
            self.held = handle.getListState("held", HELD)

        def handleInputRows(self, key, rows, timerValues):
            mark = timerValues.getCurrentWatermarkInMs() + delay_ms if timerValues.getCurrentWatermarkInMs() > 0 else -1
            late = []
            for frame in rows:
                for r in frame.itertuples(index=False):
                    at = int(r.seen_at.timestamp() * 1000)
                    if at <= mark:
                        late.append((key[0], int(r.arrival), "late", None, None))
                        continue
                    self.held.appendValue((r.bad, r.clean, int(r.tier), bool(r.auto_update), r.valid_from, at, int(r.arrival)))
                    self.handle.registerTimer(max(at - delay_ms, 1))
            if late:
                yield _decided(late)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            mark = timerValues.getCurrentWatermarkInMs() + delay_ms
            held = sorted(self.held.get(), key=lambda r: (r[5], r[6])) if self.held.exists() else []
            free, kept = [r for r in held if r[5] <= mark], [r for r in held if r[5] > mark]
            if not free:
                return
            head, out = (tuple(self.head.get()) if self.head.exists() else None), []
            for bad, clean, tier, auto, valid_from, _, arrival in free:
                before = head[4] if head else None
                reason, head = step(head, bad, clean, tier, auto, valid_from, arrival)
                out.append((key[0], arrival, reason, before, head[5] if head else None))
            if head:
                self.head.update(head)
            self.held.put(kept) if kept else self.held.clear()
            yield _decided(out)

        def close(self) -> None:
            pass

    return Reorder()


#: A held draft; the fields of its row, when it was seen and its place.
HELD = "bad string, clean string, tier int, auto boolean, at timestamp, seen long, arrival long"


def ordered_fold(drafts: DataFrame, delay_seconds: int) -> DataFrame:
    """The fold of a stream whose drafts come out of order by up to ``delay_seconds`` of their event time ``seen_at``.

    A draft waits in its key's buffer until the watermark has passed it by the delay, by a timer, so that idle keys are released too; those
    that are free are judged in the order of seen_at and arrival.  One that comes later than the delay isn't judged: it comes out with the
    reason *late*; one that is more than twice as late is dropped by Spark, which counts it.  Needs the state store of RocksDB.
    """
    timed = _given(drafts, "seen_at").withWatermark("seen_at", f"{2 * delay_seconds} seconds")
    told = timed.groupBy("semantic_key").transformWithStateInPandas(_reorder(1000 * delay_seconds), DECIDED, "append", "eventTime")
    return told.withColumn("disposition", F.when(F.col("reason") == "late", "LATE").otherwise(disposition_of(F.col("reason"))))
