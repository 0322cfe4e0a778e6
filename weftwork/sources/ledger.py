"""Rows handed to an outbound client, with a ledger of what was sent."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Rows after which a task writes down what it has sent.
BLOCK = 500


def _read(fs: pafs.FileSystem, path: str) -> set[str]:
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return set()
    with fs.open_input_stream(path) as f:
        return set(f.read().decode().split())


def _put(fs: pafs.FileSystem, path: str, ids: Iterable[str]) -> None:
    """Written beside and renamed, so a file of the ledger is whole or absent. Names that begin with _ are no part of it."""
    folder, _, name = path.rpartition("/")
    beside = f"{folder}/_{name}-{hashlib.md5(''.join(ids).encode()).hexdigest()}"
    with fs.open_output_stream(beside) as f:
        f.write("".join(f"{i}\n" for i in ids).encode())
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(path)
    fs.move(beside, path)


def sent(spark, ledger: str) -> DataFrame:
    """(id): what the ledger holds, each once."""
    fs, folder = pafs.FileSystem.from_uri(ledger)
    fs.create_dir(folder)
    return spark.read.schema("value string").text(ledger).select(F.col("value").alias("id")).distinct()


def message_id(keys: Sequence[str]):
    """The id of a row: SHA-256 of its key columns as JSON, nulls included."""
    return F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)


def send_once(rows: DataFrame, keys: Sequence[str], make_sender: Callable[[], Callable[[Row, str], int]], ledger: str, block: int = BLOCK) -> None:
    """Hands each row that the ledger does not hold to a sender made once a task, as (row, id); a status other than 200 fails the task, and Spark tries it again.

    `keys` tell rows apart: of rows with equal keys one is sent. Tasks hold the rows in order of their ids, in blocks whose names follow from the ids in them, and write a
    block's ids to the folder `ledger` when it is sent, and those sent so far when the sender fails. So a task that is tried again, and a later run on the
    same or on more rows, sends nothing that was written down. Only if an executor is lost within a block are the rows sent since the block began sent
    again, with the same id, by which the receiver can tell; speculative execution has to be off, as two attempts would then send at the same time.
    """
    fields = [F.col(f"`{c.replace('`', '``')}`") for c in rows.columns]
    keyed = rows.select(F.struct(*fields).alias("row"), message_id(keys).alias("id")).dropDuplicates(["id"])
    left = keyed.join(sent(rows.sparkSession, ledger), "id", "left_anti").sortWithinPartitions("id")

    def part(items: Iterator[Row]) -> None:
        fs, folder = pafs.FileSystem.from_uri(ledger)
        sender = make_sender()
        while some := list(islice(items, block)):
            path = f"{folder}/{hashlib.sha256(''.join(r.id for r in some).encode()).hexdigest()}"
            done = _read(fs, path)
            had = len(done)
            try:
                for r in some:
                    if r.id not in done:
                        status = sender(r.row, r.id)
                        if status != 200:
                            raise RuntimeError(f"sender answered {status}")
                        done.add(r.id)
            finally:
                if len(done) > had:
                    _put(fs, path, sorted(done))

    left.foreachPartition(part)
