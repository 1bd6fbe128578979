"""A ledger of streaming runs: one row for each batch of a run, also for empty and failed ones, written by a query listener."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "run_id string, query_id string, batch long, state string, rows long, seconds double, message string"


class Ledger(StreamingQueryListener):
    """Rows lie in the shared folder, a file for each run and batch, written over if an event comes twice.

    States: started (batch -1), done, failed (the batch after the last that was done) and ended (batch -2).
    """

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, f"{at}/ledger"
        self._last: dict[str, int] = {}
        self._over: dict[str, threading.Event] = {}

    def _put(self, run_id, query_id, batch: int, state: str, rows: int = 0, seconds: float = 0.0, message: str | None = None) -> None:
        row = {"run_id": str(run_id), "query_id": str(query_id), "batch": batch, "state": state, "rows": rows, "seconds": seconds, "message": message}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{run_id}_{batch}.json")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(json.dumps(row).encode()))
        out.close()

    def onQueryStarted(self, event) -> None:
        self._over.setdefault(str(event.runId), threading.Event())
        self._put(event.runId, event.id, -1, "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._last[str(p.runId)] = p.batchId
        self._put(p.runId, p.id, p.batchId, "done", p.numInputRows, (p.batchDuration or 0) / 1000)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception is None:
            self._put(event.runId, event.id, -2, "ended")
        else:
            self._put(event.runId, event.id, self._last.get(str(event.runId), -1) + 1, "failed", message=event.exception.splitlines()[0][:500])
        self._over.setdefault(str(event.runId), threading.Event()).set()

    def __enter__(self) -> Ledger:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *failure) -> None:
        """Waits until the runs that have started are written to their end; events come in a thread of their own."""
        for over in list(self._over.values()):
            over.wait(30)
        self.spark.streams.removeListener(self)

    def rows(self) -> DataFrame:
        """What the ledger holds, of all runs that shared its place."""
        return self.spark.read.schema(SCHEMA).json(self.at).filter(F.col("run_id").isNotNull())
