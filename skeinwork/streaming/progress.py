"""How far a stream has come, while it runs: metrics that Spark observes on the way, without a second pass."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

NAME = "progress"


def observed(rows: DataFrame, **metrics: Column) -> DataFrame:
    """The rows, whose ``metrics`` (aggregates that can be added up) are observed in every batch that they pass."""
    return rows.observe(NAME, *(m.alias(n) for n, m in metrics.items()))


class Progress(StreamingQueryListener):
    """Running totals of the observed metrics, one entry for each batch with rows; ``tell`` is called with each."""

    def __init__(self, tell: Callable[[dict[str, int]], None] | None = None):
        self.totals: list[dict[str, int]] = []
        self.tell, self.ended = tell, threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802  the interface's names
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get(NAME)
        if seen is None or not event.progress.numInputRows:
            return
        last = self.totals[-1] if self.totals else {}
        total = {n: last.get(n, 0) + (v or 0) for n, v in seen.asDict().items()}
        self.totals.append(total)
        if self.tell is not None:
            self.tell(total)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.set()


def followed(spark: SparkSession, start: Callable[[], StreamingQuery], progress: Progress, wait: float = 60) -> None:
    """Run a query to its end while ``progress`` listens; returns when the last of it was heard."""
    spark.streams.addListener(progress)
    try:
        start().awaitTermination()
        progress.ended.wait(wait)
    finally:
        spark.streams.removeListener(progress)
