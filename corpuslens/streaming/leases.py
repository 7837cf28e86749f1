"""Leases of a work queue as keyed state with timers.

Signs of ``(key, id, at, kind, worker)`` come as a stream in any order within the watermark's delay: a key is discovered,
claimed, kept alive by beats, and done or failed.  A key's signs are buffered until the watermark has passed them and then
followed in the order of time, so what comes out depends on the signs alone, not on how they fell into batches.  A claim
has a time; a timer at its end opens the key anew, unless a beat of the same worker moved that end.  The state lives in
the checkpoint, so a stream that is killed and started again loses and doubles nothing in a sink of the same checkpoint.

All times are whole milliseconds.  A claim ends at the very moment it expires, before any sign of that moment.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schemas import QUEUES

SIGNS = "key string, id long, at timestamp, kind string, worker string"
KINDS = ("discover", "claim", "beat", "done", "fail")
CHANGES = "key string, what string, at timestamp, worker string, attempts int"
OPEN, CLAIMED = QUEUES["status"][0], QUEUES["status"][1][0]
#: The state store that holds values, lists and timers of keys.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Lease:
    """One key's state, and what a sign changes in it."""

    def __init__(self, status: str | None = None, worker: str | None = None, until: int = 0, attempts: int = 0):
        self.status, self.worker, self.until, self.attempts = status, worker, until, attempts

    def expire(self, now: int) -> Iterator[tuple[str, int, str | None, int]]:
        if self.status == CLAIMED and self.until <= now:
            yield "expired", self.until, self.worker, self.attempts
            self.status, self.worker = OPEN, None

    def sign(self, at: int, kind: str, worker: str | None, ttl: int, retry: int) -> Iterator[tuple[str, int, str | None, int]]:
        """``until`` is the end of a claim, or of the wait after a failure."""
        yield from self.expire(at)
        held = self.status == CLAIMED and self.worker == worker
        if kind == "discover" and self.status is None:
            self.status = OPEN
            yield "discovered", at, None, 0
        elif kind == "claim" and (self.status == OPEN or self.status == "failed" and self.until <= at):
            self.status, self.worker, self.until, self.attempts = CLAIMED, worker, at + ttl, self.attempts + 1
            yield "claimed", at, worker, self.attempts
        elif kind == "beat" and held:
            self.until = max(self.until, at + ttl)
        elif kind in ("done", "fail") and held:
            self.status, self.until = ("fetched", 0) if kind == "done" else ("failed", at + retry)
            yield self.status, at, worker, self.attempts
            self.worker = None


class LeaseProcessor(StatefulProcessor):
    def __init__(self, ttl_seconds: int, retry_seconds: int):
        self.ttl, self.retry = 1000 * ttl_seconds, 1000 * retry_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "status string, worker string, until long, attempts int")
        self.waiting = handle.getListState("waiting", "at long, id long, kind string, worker string")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int | None) -> None:
        """One timer a key, at the first moment that something is due."""
        set_ = self.timer.get()[0] if self.timer.exists() else None
        if set_ == at:
            return
        if set_ is not None:
            self.handle.deleteTimer(set_)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def _due(self, lease: Lease, waiting: list[tuple]) -> int | None:
        due = [r[0] for r in waiting] + ([lease.until] if lease.status == CLAIMED else [])
        return min(due) if due else None

    def _read(self) -> tuple[Lease, list[tuple]]:
        lease = Lease(*self.lease.get()) if self.lease.exists() else Lease()
        return lease, [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.at_ms, r.id, r.kind, r.worker) for r in rows]
        self.waiting.appendList(new)
        set_ = self.timer.get()[0] if self.timer.exists() else None
        self._wake(min([r[0] for r in new] + ([set_] if set_ is not None else [])))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        lease, waiting = self._read()
        out = []
        for at, id_, kind, worker in sorted(waiting, key=lambda r: r[:2]):
            if at <= now:
                out += lease.sign(at, kind, worker, self.ttl, self.retry)
        out += lease.expire(now)
        left = [r for r in waiting if r[0] > now]
        self.waiting.put(left) if left else self.waiting.clear()
        if lease.status is not None:
            self.lease.update((lease.status, lease.worker, lease.until, lease.attempts))
        self._wake(self._due(lease, left))
        return iter([Row(key=key[0], what=what, at_ms=at, worker=worker, attempts=n) for what, at, worker, n in out])

    def close(self) -> None:
        pass


def lease_changes(signs: DataFrame, ttl_seconds: int, retry_seconds: int = 0, late: str = "0 seconds") -> DataFrame:
    """``CHANGES`` of a stream of ``SIGNS``: keys discovered, claimed, fetched, failed and expired.

    Signs of a null key, time or kind are left out; those of one moment go by id.  The session's state store must be the
    one that ``PROVIDER`` names.  A batch's signs of one key lie in one task; ``files_per_trigger`` bounds them.
    """
    ms = F.unix_millis("at")
    sound = signs.filter("key is not null and at is not null and kind is not null")
    rows = sound.select("key", "id", F.timestamp_millis(ms).alias("at"), ms.alias("at_ms"), "kind", "worker").withWatermark("at", late)
    out = rows.groupBy("key").transformWithState(
        statefulProcessor=LeaseProcessor(ttl_seconds, retry_seconds), outputStructType="key string, what string, at_ms long, worker string, attempts int", outputMode="Append", timeMode="EventTime"
    )
    return out.select("key", "what", F.timestamp_millis("at_ms").alias("at"), "worker", "attempts")


def lease_states(changes: DataFrame) -> DataFrame:
    """``(key, status, worker, attempts)``: where each key stands after its last change."""
    last = F.row_number().over(W.partitionBy("key").orderBy(F.desc("at"), F.desc(F.array_position(F.array(*map(F.lit, ("expired", "discovered", "claimed", "failed", "fetched"))), F.col("what")))))
    one = changes.withColumn("__n", last).filter("__n = 1")
    status = F.when(F.col("what").isin("expired", "discovered"), OPEN).otherwise(F.col("what"))
    return one.select("key", status.alias("status"), F.when(F.col("what") == CLAIMED, F.col("worker")).alias("worker"), "attempts")
