"""Progress of a diagnosis: each section runs as a job group of its own, and its start, tasks and end are told as they happen."""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Row, SparkSession

log = logging.getLogger("terralith.progress")


@dataclass(frozen=True)
class Event:
    """What has happened to a section: start, tasks, end or failed; its number among all, tasks done and known so far, seconds."""

    section: str
    what: str
    number: int
    sections: int
    done: int = 0
    known: int = 0
    seconds: float = 0.0

    @property
    def percent(self) -> float:
        """Of all sections, this one counted by its tasks."""
        part = 1.0 if self.what == "end" else self.done / self.known if self.known else 0.0
        return 100.0 * (self.number - 1 + part) / max(1, self.sections)


def tasks(spark: SparkSession, group: str) -> tuple[int, int]:
    """(tasks done, tasks known) of the jobs of a group, as the status tracker has them."""
    tracker, done, known = spark.sparkContext.statusTracker(), 0, 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in map(tracker.getStageInfo, info.stageIds if info else []):
            if stage:
                done, known = done + stage.numCompletedTasks, known + stage.numTasks
    return done, known


def collected(sections: dict[str, DataFrame], tell: Callable[[Event], None] | None = None, every: float = 0.5) -> dict[str, list[Row]]:
    """The rows of sections of a bounded size, one section after the other; ``tell`` gets each event, which is logged too.

    A section that fails tells so and raises its error; the ones before it have ended by then.
    """
    out: dict[str, list[Row]] = {}

    def say(event: Event) -> None:
        log.info("%s: %s (%d of %d, %d of %d tasks, %.1f s)", event.section, event.what, event.number, event.sections, event.done, event.known, event.seconds)
        if tell:
            tell(event)

    for number, (name, df) in enumerate(sections.items(), 1):
        spark, group, start = df.sparkSession, f"terralith-{uuid.uuid4().hex}", time.monotonic()
        error: list[BaseException] = []

        def run(df: DataFrame = df, name: str = name, spark: SparkSession = spark, group: str = group, error: list[BaseException] = error) -> None:
            spark.sparkContext.setJobGroup(group, name)
            try:
                out[name] = df.collect()
            except BaseException as e:  # noqa: BLE001  raised again by the caller's thread
                error.append(e)

        event = lambda what: Event(name, what, number, len(sections), *tasks(spark, group), time.monotonic() - start)  # noqa: B023, E731
        say(Event(name, "start", number, len(sections)))
        worker: threading.Thread = InheritableThread(target=run)
        worker.start()
        last = (0, 0)
        while worker.is_alive():
            worker.join(every)
            if worker.is_alive() and (now := tasks(spark, group)) != last:
                last = now
                say(event("tasks"))
        say(event("failed" if error else "end"))
        if error:
            raise error[0]
    return out
