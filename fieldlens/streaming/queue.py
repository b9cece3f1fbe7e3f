"""The job queue on event-time timers: results expire, and the longest waiting job of a pool takes the place (ST7)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sequential import fold_batches
from .association import STATE_STORE

OUT = "pool string, job_id bigint, state string, at timestamp"


def decisions(rows: list[tuple]) -> pd.DataFrame:
    """Rows with times in milliseconds; texts as plain objects, which is all that stateful processors take."""
    out = pd.DataFrame(rows, columns=["pool", "job_id", "state", "at"]).astype({"pool": object, "job_id": "int64", "state": object, "at": "int64"})
    return out.assign(at=out["at"].to_numpy().astype("datetime64[ms]").astype("datetime64[ns]"))


#: Milliseconds whose jobs are kept together.
HOUR = 3_600_000


class Desk(StatefulProcessor):
    """A pool's jobs by the hour: when results expire, and who waits.

    One timer stands for the earliest expiry.  It goes through all expiries that the watermark has passed, each of which promotes one of those that waited by then, so an
    hour's jobs are read and written once for a micro-batch, not for each expiry.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ready = handle.getMapState("ready", "hour bigint", "expires array<bigint>, jobs array<bigint>")
        self.waiting = handle.getMapState("waiting", "hour bigint", "created array<bigint>, jobs array<bigint>")
        self.timer = handle.getValueState("timer", "due bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came: tuple[dict, dict] = {}, {}
        for pdf in rows:
            for job, state, created, expires in zip(pdf["job_id"], pdf["state"], pdf["created_ms"], pdf["expires_ms"]):
                if state == "ready" and not pd.isna(expires):
                    came[0].setdefault(int(expires) // HOUR, []).append((int(expires), int(job)))
                elif state == "quota_waiting":
                    came[1].setdefault(int(created) // HOUR, []).append((int(created), int(job)))
        for kept, new in zip((self.ready, self.waiting), came):
            for hour, jobs in new.items():
                self._keep(kept, hour, self._jobs(kept, hour) + jobs)
        if came[0]:
            self._due(min([min(came[0][min(came[0])])[0], *(self.timer.get() if self.timer.exists() else ())]))
        yield decisions([])

    def _due(self, at: int | None) -> None:
        """The one timer is for ``at``; none if nothing expires."""
        was = self.timer.get()[0] if self.timer.exists() else None
        if at == was:
            return
        if was is not None:
            self.handle.deleteTimer(was)
            self.timer.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    @staticmethod
    def _jobs(kept, hour: int) -> list[tuple[int, int]]:
        return sorted(zip(*kept.getValue((hour,)))) if kept.containsKey((hour,)) else []

    @staticmethod
    def _keep(kept, hour: int, jobs: list[tuple[int, int]]) -> None:
        if jobs:
            kept.updateValue((hour,), tuple(map(list, zip(*jobs))))
        else:
            kept.removeKey((hour,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.timer.exists() and self.timer.get()[0] == expiredTimerInfo.getExpiryTimeInMs():  # it is gone by itself
            self.timer.clear()
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        hours, waits = (sorted(k[0] for k in kept.keys()) for kept in (self.ready, self.waiting))
        hour, turn, i, due = None, [], 0, None
        for h in hours:
            held = self._jobs(self.ready, h)
            n = sum(at <= until for at, _ in held)
            rows = []
            for at, job in held[:n]:
                rows.append((key[0], job, "expired", at))
                if i == len(turn) and waits and waits[0] <= at // HOUR:
                    if hour is not None:
                        self._keep(self.waiting, hour, [])
                    hour = waits.pop(0)
                    turn, i = self._jobs(self.waiting, hour), 0
                if i < len(turn) and turn[i][0] <= at:
                    rows.append((key[0], turn[i][1], "approved", at))
                    i += 1
            if n:
                self._keep(self.ready, h, held[n:])
            yield decisions(rows)
            if n < len(held):
                due = held[n][0]
                break
        if hour is not None and i:
            self._keep(self.waiting, hour, turn[i:])
        self._due(due)

    def close(self) -> None:
        pass


def in_milliseconds(jobs: DataFrame) -> DataFrame:
    return jobs.select("pool", "job_id", "state", "created_at", F.unix_millis(F.col("created_at").cast("timestamp")).alias("created_ms"), F.unix_millis(F.col("expires_at").cast("timestamp")).alias("expires_ms"))


def queue_stream(jobs: DataFrame, late: str = "1 hour") -> DataFrame:
    """``pool, job_id, state, at`` as results expire and waiting jobs are approved, from a stream of jobs (pool, job_id, state, created_at, expires_at)."""
    jobs.sparkSession.conf.set(*STATE_STORE)
    rows = in_milliseconds(jobs).withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    return rows.groupBy("pool").transformWithStateInPandas(Desk(), OUT, "append", "EventTime")


def queue_batch(jobs: DataFrame, until) -> DataFrame:
    """The same from a table, for all that expires at or before ``until`` (a timestamp column): waiting jobs and expiries are folded in the order of their times."""
    rows = in_milliseconds(jobs).where("state = 'quota_waiting' or state = 'ready' and expires_ms is not null")
    waits = F.col("state") == "quota_waiting"
    rows = rows.select("pool", F.when(waits, F.col("created_ms")).otherwise(F.col("expires_ms")).alias("at_ms"), F.when(waits, 0).otherwise(1).alias("kind"), "job_id", F.unix_millis(until).alias("until"))

    def step(waiting: deque, pdf: pd.DataFrame) -> tuple:
        out = []
        for pool, at, kind, job, until_ms in zip(*(pdf[c] for c in ("pool", "at_ms", "kind", "job_id", "until"))):
            if kind == 0:
                waiting.append(job)
            elif at <= until_ms:
                out.append((pool, job, "expired", at))
                if waiting:
                    out.append((pool, waiting.popleft(), "approved", at))
        return waiting, decisions(out)

    return fold_batches(rows, ["pool"], ["at_ms", "kind", "job_id"], deque, step, OUT)
