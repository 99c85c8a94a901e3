"""Cancelling what an engine does: by hand from another thread, or at a deadline.

All jobs that run within an Abort carry its tag. Cancelling interrupts them, with the Python workers that wait for a model in
them, and no further job is begun; the caller gets Aborted instead of the jobs' own errors. What was not committed is not there.
"""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import SparkSession


class Aborted(RuntimeError):
    """The work was cancelled, or its time was up."""


class Abort:
    """`with Abort(spark, seconds) as abort: ...`; abort.cancel() from any thread. seconds: a deadline from the beginning of the block on."""

    def __init__(self, spark: SparkSession, seconds: float | None = None) -> None:
        self.spark, self.seconds = spark, seconds
        self.tag = f"loam-{uuid.uuid4().hex}"
        self.reason: str | None = None
        self._inside = threading.Event()
        self._timer: threading.Timer | None = None

    def cancel(self, reason: str = "cancelled") -> None:
        if self.reason is None:
            self.reason = reason
            threading.Thread(target=self._interrupt, daemon=True).start()

    def _interrupt(self) -> None:
        """Until the block is left: a job that was being planned when the others were cancelled begins after them."""
        while self._inside.is_set():
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            time.sleep(0.1)

    def check(self) -> None:
        """Raise Aborted if it was cancelled: between jobs."""
        if self.reason is not None:
            raise Aborted(self.reason)

    def __enter__(self) -> Abort:
        self.check()
        self.spark.sparkContext.setInterruptOnCancel(True)
        self.spark.sparkContext.addJobTag(self.tag)
        self._inside.set()
        if self.seconds is not None:
            self._timer = threading.Timer(self.seconds, self.cancel, (f"over {self.seconds:g} seconds",))
            self._timer.daemon = True
            self._timer.start()
        return self

    def __exit__(self, kind, error, trace) -> None:
        self._inside.clear()
        if self._timer is not None:
            self._timer.cancel()
        self.spark.sparkContext.removeJobTag(self.tag)
        self.spark.sparkContext.setInterruptOnCancel(False)
        if self.reason is not None and not isinstance(error, Aborted):
            raise Aborted(self.reason) from error
