"""Sinks: one text a page, full snapshots, and rows handed to an outbound client."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def write_pages(docs: DataFrame, path: str) -> None:
    """Markdown under path/slug=.../, replacing what was there, each with a line end added; pages without text are passed over."""
    docs.filter(F.col("markdown").isNotNull()).select("slug", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("slug").text(path)


def snapshot(rows: DataFrame, path: str) -> None:
    """The whole state as JSON lines, replacing the last one. An empty frame clears it."""
    rows.write.mode("overwrite").json(path)


def send(rows: DataFrame, make_sender: Callable[[], Callable[[Row], int]]) -> None:
    """Hands each row to a sender made once a task; a status other than 200 fails the task, and Spark tries it again."""

    def part(items: Iterable[Row]) -> None:
        sender = make_sender()
        for row in items:
            status = sender(row)
            if status != 200:
                raise RuntimeError(f"sender answered {status}")

    rows.foreachPartition(part)
