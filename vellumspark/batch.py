"""Work in batches of chapters: pause, resume and cancel between them, a failed batch apart from the others, progress."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Progress = Callable[[int, int, str, str], None]  # done, of, batch, state


class Cancelled(Exception):
    """Work was cancelled; nothing after it was begun."""


class Control:
    """Shared by the thread that works and the one that steers it."""

    def __init__(self, spark: SparkSession, group: str = "vellumspark-batch") -> None:
        self.spark, self.group = spark, group
        self._go, self._gone = threading.Event(), threading.Event()
        self._go.set()

    def pause(self) -> None:
        self._go.clear()

    def resume(self) -> None:
        self._go.set()

    def cancel(self) -> None:
        """Ends the jobs that run in the group and all batches after."""
        self._gone.set()
        self._go.set()
        self.spark.sparkContext.cancelJobGroup(self.group)

    def checkpoint(self) -> None:
        """Waits while paused; raises once cancelled."""
        self._go.wait()
        if self._gone.is_set():
            raise Cancelled


@dataclass
class Outcome:
    done: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)
    cancelled: bool = False

    def errors(self, spark: SparkSession) -> DataFrame:
        """batch, error of the failed ones."""
        return spark.createDataFrame(sorted(self.failed.items()), "batch string, error string")


def run_batches(spark: SparkSession, batches: Iterable[str], work: Callable[[str], None], control: Control | None = None, progress: Progress | None = None) -> Outcome:
    """``work`` on one batch after the other, such as a book or a group of chapters whose outputs it writes by key.

    What one batch raises is noted, and the others go on; a batch that ran before may be run again, as outputs are replaced
    by key. Cancelling ends the run with what was done so far. Batches are few: chapters in one batch share their jobs.
    """
    control = control or Control(spark)
    todo, out = list(batches), Outcome()
    for name in todo:
        try:
            control.checkpoint()
            spark.sparkContext.setJobGroup(control.group, f"{name} ({len(out.done) + len(out.failed) + 1} of {len(todo)})", True)
            work(name)
            control.checkpoint()
            out.done.append(name)
            state = "COMPLETED"
        except Cancelled:
            out.cancelled = True
            state = "CANCELLED"
        except Exception as e:  # noqa: BLE001 - whatever a batch raises is its own
            if control._gone.is_set():
                out.cancelled, state = True, "CANCELLED"
            else:
                out.failed[name], state = f"{type(e).__name__}: {e}"[:500], "FAILED"
        if progress is not None:
            progress(len(out.done) + len(out.failed), len(todo), name, state)
        if out.cancelled:
            break
    return out
