"""Files with content from rows, all of them or none.

A Python data source that Spark's writer drives: each task stages its files in a folder of its
own, and only when all tasks have succeeded are they renamed to where they belong. What a failed
or repeated task has staged is deleted with the staging folder.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "siftwell_files"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path on it) of a URI or a local path; whatever pyarrow has a file system for, such as file, hdfs, s3 and gs."""
    local = re.match(r"(?:file:/*)?(/.*|[^:/][^:]*)\Z", uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + re.sub("^file:/*", "", uri)
    return (fs.LocalFileSystem(), uri) if local else fs.FileSystem.from_uri(uri)


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]


class FileWriter(DataSourceArrowWriter):
    def __init__(self, target: str, run: str):
        self.target, self.run = target, run

    def _staging(self, base: str) -> str:
        return posixpath.join(base, f"_staged-{self.run}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, base = opened(self.target)
        own = posixpath.join(self._staging(base), uuid.uuid4().hex)
        system.create_dir(own, recursive=True)
        files = []
        for batch in iterator:
            for name, content in zip(batch["new_path"], batch["content"], strict=True):
                name = name.as_py()
                if not name or name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"not a path below the target: {name}")
                staged = posixpath.join(own, str(len(files)))
                with system.open_output_stream(staged) as f:
                    f.write(content.as_buffer() if content.is_valid else b"")
                files.append((staged, name))
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        system, base = opened(self.target)
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("several rows for the same file")
        for folder in {posixpath.dirname(posixpath.join(base, name)) for name in names}:
            system.create_dir(folder, recursive=True)
        for staged, name in files:
            system.move(staged, posixpath.join(base, name))
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, base = opened(self.target)
        if system.get_file_info(self._staging(base)).type != fs.FileType.NotFound:
            system.delete_dir(self._staging(base))


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], uuid.uuid4().hex)


def write_files(rows: DataFrame, target: str) -> None:
    """Write the content of each row to ``target``/new_path; files that are there are replaced, others stay.

    If the job fails, none of its files is there; a task that ran twice leaves no double. Names have to
    differ. Null content is an empty file; other columns don't count.
    """
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(FileSink)
    rows.select("new_path", "content").write.format(FORMAT).mode("append").option("path", target).save()
