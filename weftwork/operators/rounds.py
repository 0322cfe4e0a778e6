"""Cutting lineage between the rounds of iterative operators."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir).

    Where that setting is absent and Spark runs in one process, as in tests, a temporary folder stands in; on a cluster that is an error.
    """
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own_dir = _own_dir or tempfile.mkdtemp(prefix="spark-")
        base = f"file://{_own_dir}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _bytes(size: str) -> int:
    """A size as Spark's settings write it: 64MB, 8m, 1024."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


@contextmanager
def small_tasks(spark: SparkSession, rows: int, per_task: int = 250_000) -> Iterator[None]:
    """Queries that run inside are dealt over more tasks the more rows there are, so what a task sorts or sums does not grow with the input."""
    most = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20, "spark.sql.files.maxPartitionBytes": 32 << 20}
    wanted = {name: f"{min(size, _bytes(spark.conf.get(name)))}b" for name, size in most.items()} | {"spark.sql.shuffle.partitions": str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_task)))}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to a scratch table and read it back: the lineage ends there and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, label)
    with shuffles_end(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch files."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_scratch(*tables: DataFrame) -> None:
    """Delete the files of tables made by cut that no later step reads."""
    for table in tables:
        if path := _paths.pop(table, None):
            delete(table.sparkSession, path)
