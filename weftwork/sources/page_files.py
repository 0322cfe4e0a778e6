"""One file a page, under its own name, put in place by a commit."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from weftwork.operators.rounds import cut

#: Most bytes of a name, so that it fits common file systems with its ending.
LONGEST_NAME = 240


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _gone(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type == pafs.FileType.NotFound


def _delete(fs: pafs.FileSystem, path: str) -> None:
    if not _gone(fs, path):
        fs.delete_dir(path)


@dataclass
class Written(WriterCommitMessage):
    files: int


class _Writer(DataSourceWriter):
    """An attempt of a task writes to a folder of its own and, once it has all its pages, moves them into the job's staging folder; a second attempt moves the
    same names again. The commit renames the staging folder, so readers see the old pages or the new ones, and moves no single files on the driver."""

    def __init__(self, path: str, ending: str):
        self.path, self.ending = path.rstrip("/"), ending
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, staging = _open(self.staging)
        own = f"{staging}.try-{TaskContext.get().taskAttemptId()}"
        fs.create_dir(own)
        names = []
        try:
            for name, text in iterator:
                with fs.open_output_stream(f"{own}/{name}{self.ending}") as out:
                    out.write(text.encode())
                names.append(name)
            fs.create_dir(staging)
            for name in names:
                fs.move(f"{own}/{name}{self.ending}", f"{staging}/{name}{self.ending}")
        finally:
            _delete(fs, own)
        return Written(len(names))

    def commit(self, messages: list[Written | None]) -> None:
        fs, staging = _open(self.staging)
        target, old = _open(self.path)[1], f"{_open(self.path)[1]}.old-{uuid.uuid4().hex}"
        fs.create_dir(staging)
        self._clear(fs, staging)
        had = not _gone(fs, target)
        if had:
            fs.move(target, old)
        fs.move(staging, target)
        if had:
            fs.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        fs, staging = _open(self.staging)
        self._clear(fs, staging)
        _delete(fs, staging)

    def _clear(self, fs: pafs.FileSystem, staging: str) -> None:
        """Folders that attempts left behind when their executor was lost."""
        for info in fs.get_file_info(pafs.FileSelector(staging.rpartition("/")[0])):
            if info.path.rpartition("/")[2].startswith(f"{staging.rpartition('/')[2]}.try-"):
                _delete(fs, info.path)


class PageFiles(DataSource):
    """format("page_files"): rows (name, text) as files name + option `ending` in the folder that save names, which they replace."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if not overwrite:
            raise ValueError("page_files replaces its folder: write with mode overwrite")
        return _Writer(self.options["path"], self.options.get("ending", ".md"))


def write_page_files(pages: DataFrame, path: str, ending: str = ".md", order: str = "name") -> DataFrame:
    """Writes pages(slug, markdown, ...) as path/slug.md, each text with a line end added, in place of what the folder held.

    Returns the report: (slug, pages, reason) with reason `clash` where several pages have one slug, of which the last by the column `order` (nulls first, ties to the greater text)
    is written, and `unfit` for slugs that are null, empty, too long or no plain file name, of which none is. Pages without text are passed over, as are other columns. An
    empty table leaves an empty folder. If a task fails for good the folder stays as it was. Paths are what pyarrow.fs reads: absolute paths, file:, hdfs:, s3: and the like;
    where a rename is a copy (object stores) the commit takes as long as one. A slug with very many pages is reduced before the shuffle.
    """
    spark = pages.sparkSession
    told = pages.filter(F.col("markdown").isNotNull()).select("slug", F.col("markdown").alias("_text"), F.col(order).alias("_order"))
    last = told.groupBy("slug").agg(F.max(F.struct("_order", "_text")).alias("_last"), F.count("*").alias("pages"))
    plain = F.coalesce(~F.col("slug").isin("", ".", "..") & ~F.col("slug").rlike(r"[/\\\x00-\x1f]") & (F.octet_length("slug") <= LONGEST_NAME), F.lit(False))
    kept = cut(last.select("slug", F.col("_last._text").alias("text"), "pages", plain.alias("fit")), "pages")
    spark.dataSource.register(PageFiles)
    kept.filter("fit").select(F.col("slug").alias("name"), F.concat("text", F.lit("\n")).alias("text")).write.format("page_files").option("ending", ending).mode("overwrite").save(path)
    return kept.filter("NOT fit OR pages > 1").select("slug", "pages", F.when(F.col("fit"), "clash").otherwise("unfit").alias("reason"))
