"""Files put together from parts that tasks have encoded: ``path, at, data``, in the order of ``at``.

Encoders deal an image to many tasks and give its parts as bytes; a file is then one stream that a task copies from rows
sorted by Spark, so neither an image nor a file lies in the memory of a task.  Finished files are moved to their names
when all tasks are done.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)  # (where it was written, where it belongs)


class Commit:
    """Files of a job under ``_temporary``: a lost or repeated task leaves nothing, two files of one name are refused."""

    def __init__(self, root: str):
        self.root, self.job = root.rstrip("/"), uuid.uuid4().hex

    def place(self) -> str:
        store, root = store_of(self.root)
        store.create_dir(f"{root}/_temporary/{self.job}")
        return f"{root}/_temporary/{self.job}/{uuid.uuid4().hex}"

    def clear(self) -> None:
        store, root = store_of(self.root)
        if store.get_file_info(f"{root}/_temporary/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_temporary/{self.job}")

    def commit(self, messages: list[Written | None]) -> None:
        store, root = store_of(self.root)
        files = [f for m in messages if m for f in m.files]
        targets = [target for _, target in files]
        if len(set(targets)) < len(targets):
            self.clear()
            raise ValueError("a file was written twice")
        store.create_dir(root)
        for place, target in files:
            if store.get_file_info(target).is_file:
                store.delete_file(target)
            store.move(place, target)
        self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()


class _Writer(Commit, DataSourceArrowWriter):
    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = store_of(self.root)
        out, now, file = Written(), None, None
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("data")):
                if path != now:
                    if file is not None:
                        file.close()
                    now = path
                    out.files.append((self.place(), f"{root}/{path.rstrip('/').rsplit('/', 1)[-1]}"))
                    file = store.open_output_stream(out.files[-1][0])
                file.write(data.as_buffer())
        if file is not None:
            file.close()
        return out


class PartsSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "parts"

    def schema(self) -> str:
        return "path string, data binary"

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def write_parts(parts: DataFrame, folder: str) -> None:
    """Write rows ``path, at, data`` as one file for each path, named by its last part, in the order of ``at``."""
    parts.sparkSession.dataSource.register(PartsSink)
    rows = parts.repartition("path").sortWithinPartitions("path", "at").select("path", "data")
    rows.write.format("parts").mode("append").save(folder)


def spanned(px: DataFrame) -> DataFrame:
    """``path, height, width, channels, header``: those columns of pixels, or the largest places of each image."""
    from pyspark.sql import functions as F

    sizes = [(F.max(n) if n in px.columns else F.max(k) + 1).cast("int").alias(n) for k, n in (("y", "height"), ("x", "width"), ("c", "channels"))]
    header = F.first("header", True) if "header" in px.columns else F.lit(None).cast("map<string,string>")
    return px.groupBy("path").agg(*sizes, header.alias("header"))
