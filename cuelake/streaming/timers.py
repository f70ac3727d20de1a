"""Stages that take too long, told by timers: no further event of theirs is needed.

A job's state is the attempt that runs now and when its time is up. It is there while the attempt runs and goes with its end, so state
is as large as what is under way, whatever the number of jobs so far; attempts without a limit of their own go after ``FORGET``.
Timers run on processing time and survive a restart with the query's checkpoint: time spent down counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuelake.operators.stages import START_SECONDS

#: Stages whose attempts may be made again after their time was up. A recognition over its limit isn't.
AGAIN = ("init",)
FORGET = 7 * 24 * 3600.0

EVENT = "job_id string, attempt_no long, seq long, stage string, event string"
OUTCOME = "job_id string, attempt_no long, stage string, outcome string, retry boolean"


def use_keyed_state(spark: SparkSession) -> None:
    """The state store that stateful processors need; to be set before their queries start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class StageTimers(StatefulProcessor):
    """Events started and ended of one job become outcomes ended and <stage>_timeout."""

    def __init__(self, limits: Mapping[str, float], forget: float):
        self.limits, self.forget = dict(limits), forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "attempt_no long, stage string", ttlDurationMs=int(1000 * self.forget))

    def _stop(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.running.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        events = pd.concat(list(rows)).sort_values("seq")
        for attempt, stage, event in zip(events["attempt_no"], events["stage"], events["event"], strict=True):
            now = self.running.get() if self.running.exists() else None
            if event == "started" and (now is None or attempt >= now[0]):
                self._stop()
                self.running.update((int(attempt), stage))
                if stage in self.limits:
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.limits[stage]))
            elif event == "ended" and now is not None and (attempt, stage) == tuple(now):
                self._stop()
                out.append((key[0], int(attempt), stage, "ended", None))
        # An end of an attempt that is over already, or was never begun, is no outcome: nothing of it is committed.
        yield pd.DataFrame(out, columns=["job_id", "attempt_no", "stage", "outcome", "retry"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.running.exists():
            attempt, stage = self.running.get()
            self.running.clear()
            yield pd.DataFrame([(key[0], attempt, stage, f"{stage}_timeout", stage in AGAIN)], columns=["job_id", "attempt_no", "stage", "outcome", "retry"])

    def close(self) -> None:
        pass


def stage_outcomes(events: DataFrame, limits: Mapping[str, float] | None = None, *, forget: float = FORGET) -> DataFrame:
    """Outcomes (job_id, attempt_no, stage, outcome, retry) of a stream of events (job_id, attempt_no, seq, stage, event).

    ``limits`` are seconds by stage; a stage without one may take any time. An attempt that is begun takes the place of the job's
    earlier ones, whose ends are late from then on.
    """
    limits = {"init": START_SECONDS} if limits is None else limits
    return events.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=StageTimers(limits, forget), outputStructType=OUTCOME, outputMode="Append", timeMode="ProcessingTime"
    )
