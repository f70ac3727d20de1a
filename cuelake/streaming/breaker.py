"""Budgets and breakers over a stream: what has happened in a batch decides what it may begin next.

Keyed by batch, the state counts restarts and each file's retries and remembers which stages are paused. Requests to begin a
stage come in the same stream as results and failures and are answered in order, so a micro-batch after a refusal of the service
begins no translation. The state is the query's checkpointed one: a micro-batch that is run again finds the state it found
before and gives the same answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuelake.operators.stages import BLOCKING_STATUS, DISK_FULL, LEAST_FREE_BYTES

EVENT = (
    "batch string, seq long, kind string, job string, stage string, status int, error string, free_bytes long, startup boolean, lasting boolean"
)
ANSWER = "batch string, seq long, kind string, job string, stage string, answer string"


class Breaker(StatefulProcessor):
    """Answers: of dispatch admit or hold; of failure retry, fail, restart or block; of result noted or pause."""

    def __init__(self, most_per_file: int, most_restarts: int):
        self.most_per_file, self.most_restarts = most_per_file, most_restarts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.batch = handle.getValueState("batch", "restarts long, paused string")
        self.retries = handle.getMapState("retries", "job string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        restarts, held = self.batch.get() if self.batch.exists() else (0, "")
        paused = set(filter(None, held.split(",")))
        out = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            if row.kind == "dispatch":
                answer = "hold" if row.stage in paused else "admit"
            elif row.kind == "failure":
                answer, restarts = self._failed(row, restarts, paused)
            else:
                answer = "pause" if self._pauses(row) else "noted"
                if answer == "pause":
                    paused.add(row.stage)
            out.append((key[0], row.seq, row.kind, row.job, row.stage, answer))
        self.batch.update((int(restarts), ",".join(sorted(paused))))
        yield pd.DataFrame(out, columns=["batch", "seq", "kind", "job", "stage", "answer"])

    def _failed(self, row, restarts: int, paused: set[str]) -> tuple[str, int]:
        """The worker has failed, with or without a file in hand. A retry needs both budgets; the last restart pauses recognition."""
        has_job = isinstance(row.job, str)
        used = self.retries.getValue((row.job,))[0] if has_job and self.retries.containsKey((row.job,)) else 0
        retried = has_job and not _is(row.lasting) and used < self.most_per_file and restarts < self.most_restarts
        if retried:
            self.retries.updateValue((row.job,), (int(used) + 1,))
        over = _is(row.startup) or restarts >= self.most_restarts
        if over:
            paused.add("stt")
        answer = ("retry" if retried else "fail") if has_job else ("block" if over else "restart")
        return answer, restarts if over else restarts + 1

    @staticmethod
    def _pauses(row) -> bool:
        """A refusal that asking on can't mend, or a disk that is full or nearly so."""
        if row.stage == "translate":
            return not pd.isna(row.status) and int(row.status) in BLOCKING_STATUS
        said = row.error.lower() if isinstance(row.error, str) else ""
        full = any(part in said for part in DISK_FULL) or (not pd.isna(row.free_bytes) and row.free_bytes < LEAST_FREE_BYTES)
        return row.stage == "extract" and full

    def close(self) -> None:
        pass


def _is(flag) -> bool:
    return flag is not None and not pd.isna(flag) and bool(flag)


def gated(events: DataFrame, *, most_per_file: int = 1, most_restarts: int = 2) -> DataFrame:
    """Answers (batch, seq, kind, job, stage, answer) to a stream of requests, failures and results, each batch's in order of seq."""
    return events.groupBy("batch").transformWithStateInPandas(
        statefulProcessor=Breaker(most_per_file, most_restarts), outputStructType=ANSWER, outputMode="Append", timeMode="None"
    )
