"""Progress while a job runs: what each step has written, told when it ends, and the tasks that are done."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Progress:
    """Watches the steps of a job that runs in this thread.

    A step is a table that the job saves. Its rows, the texts in them and the errors are counted by observation, as the step runs: no job of
    their own, no second pass. `told(step, counts)` is called when a step ends.
    """

    def __init__(self, spark: SparkSession, told: Callable[[str, dict], None] | None = None):
        self.spark, self.told, self.counts, self.took, self._lock = spark, told, {}, {}, threading.Lock()
        self.tag = f"progress-{uuid.uuid4().hex}"
        spark.sparkContext.addJobTag(self.tag)

    def saver(self, save: Callable[[DataFrame, str], DataFrame]) -> Callable[[DataFrame, str], DataFrame]:
        """`save`, observed; it must write the table, not only plan it."""

        def keep(df: DataFrame, label: str) -> DataFrame:
            seen, began = Observation(), time.monotonic()
            metrics = [F.count(F.lit(1)).alias("rows")]
            for name in ("items", "translations"):
                if name in df.columns:
                    metrics.append(F.coalesce(F.sum(F.greatest(F.size(name), F.lit(0))), F.lit(0)).alias(name))
            if "error" in df.columns:
                metrics.append(F.count("error").alias("errors"))
            out = save(df.observe(seen, *metrics), label)
            with self._lock:
                self.counts[label], self.took[label] = dict(seen.get), time.monotonic() - began
            if self.told:
                self.told(label, self.counts[label])
            return out

        return keep

    def tasks(self) -> tuple[int, int]:
        """(done, all) tasks of the job's stages that have begun; to be asked from another thread."""
        tracker, done, total = self.spark.sparkContext._jsc.sc().statusTracker(), 0, 0
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForTag(self.tag)]
        for stage in {s for j in jobs if j.isDefined() for s in j.get().stageIds()}:
            if (info := tracker.getStageInfo(stage)).isDefined():
                done, total = done + info.get().numCompletedTasks(), total + info.get().numTasks()
        return done, total

    def table(self) -> DataFrame:
        """(step, rows, texts, errors) of the steps that have ended."""
        rows = [(step, c["rows"], c.get("items", c.get("translations")), c.get("errors")) for step, c in self.counts.items()]
        return self.spark.createDataFrame(rows, "step string, rows long, texts long, errors long")

    def stop(self) -> None:
        self.spark.sparkContext.removeJobTag(self.tag)
