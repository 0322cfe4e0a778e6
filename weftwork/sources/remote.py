"""Calls of a remote service from tasks, through a client that is handed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: A client takes a batch of request texts and gives (status, body) for each.
Client = Callable[[list[str]], list[tuple[int, str]]]


def call(requests: DataFrame, make_client: Callable[[], Client], column: str = "request") -> DataFrame:
    """requests with status, body and error. One client a task; a call that fails sets error on its rows and stops nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for frame in frames:
            try:
                got = client(frame[column].tolist())
                frame = frame.assign(status=[s for s, _ in got], body=[b for _, b in got], error=None)
            except Exception as e:  # noqa: BLE001  a remote fault is data here
                frame = frame.assign(status=None, body=None, error=str(e))
            yield frame

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema), "status int, body string, error string"])
    return requests.mapInPandas(run, schema)


def constant_client(answer: str) -> Client:
    """A client that gives the same answer to all, for tests and offline work."""
    return lambda texts: [(200, answer)] * len(texts)
