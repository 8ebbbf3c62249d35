"""Sweeps that tell how far they are and can be cancelled: runs go in jobs of a few, each writes its part, and parts that ended stay."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence

from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.operators.strategy import Strategy
from barspark.operators.sweep import FIGURES, Params, run_all
from barspark.sources.scratch import folder, written


class SweepJob:
    """A sweep over all symbols, a part of the runs a job. Bars are written once; a part is there when its job has ended, and only then.

    on_progress(ended runs, all runs) is called after each part; if it returns False the sweep stops. cancel() stops it from any thread
    and ends the job that runs. What ended before can be read by results(), whatever came after.
    """

    def __init__(self, bars: DataFrame, make: Callable[[Params], Strategy], runs: Sequence[Params], per_job: int = 16, on_progress: Callable[[int, int], object] | None = None):
        if per_job < 1:
            raise ValueError("a job has at least one run")
        self.spark, self.make, self.runs, self.per_job, self.on_progress = bars.sparkSession, make, list(runs), per_job, on_progress
        self.symbol = bars.schema["symbol"].dataType.simpleString()
        self.bars, self.tag, self.where = bars, f"sweep-{uuid.uuid4().hex}", folder(bars.sparkSession, "sweep-parts")
        self.parts: list[str] = []
        self.ended, self.error = 0, None
        self._stop = threading.Event()
        self._thread = InheritableThread(target=self._work, session=self.spark)

    def start(self) -> SweepJob:
        self._thread.start()
        return self

    def cancel(self) -> None:
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def wait(self, seconds: float | None = None) -> bool:
        """Waits until the sweep has ended or was stopped; an error of a part is raised here. False if it still runs."""
        self._thread.join(seconds)
        if self.error is not None:
            raise self.error
        return not self._thread.is_alive()

    @property
    def cancelled(self) -> bool:
        return self._stop.is_set()

    def _work(self) -> None:
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        try:
            bars = written(self.bars, "sweep-bars")
            for start in range(0, len(self.runs), self.per_job):
                if self._stop.is_set():
                    return
                part = self.runs[start : start + self.per_job]
                path = f"{self.where}/{start}"
                run_all(bars, self.make, part).withColumn("run", F.col("run") + start).write.parquet(path)
                self.parts.append(path)
                self.ended += len(part)
                if self.on_progress is not None and self.on_progress(self.ended, len(self.runs)) is False:
                    self._stop.set()
        except Exception as e:
            if not self._stop.is_set():
                self.error = e
        finally:
            context.removeJobTag(self.tag)

    def results(self) -> DataFrame:
        """run, symbol and the figures of all runs of parts that have ended; run counts over the whole sweep."""
        schema = FIGURES.format(symbol=self.symbol)
        return self.spark.read.schema(schema).parquet(*self.parts) if self.parts else self.spark.createDataFrame([], schema)
