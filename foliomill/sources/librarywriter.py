"""Export of records as JSON lines with a manifest, as a data source that commits once.

Each task writes a file of its own under ``staging`` and reports its ids and the
file's digest.  When all tasks are done the reported files move to ``records`` and
``manifest.json`` appears last; a folder without it is no export.  A task that is
lost or tried twice leaves a file that nobody reports, which goes with ``staging``.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def _files(path: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """A task's file: its name, records, digest, and the smallest and largest id."""

    name: str
    records: int
    sha256: str
    first_id: int | None
    last_id: int | None


class LibraryWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.key, self.overwrite = options["path"].rstrip("/"), options.get("key", "id"), overwrite
        self.library = options.get("library", "")
        self.staging = f"staging-{uuid.uuid4().hex[:12]}"
        self.names = schema.fieldNames()

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, root = _files(self.path)
        task = TaskContext.get()
        name = f"part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex[:8]}.jsonl"
        fs.create_dir(f"{root}/{self.staging}", recursive=True)
        digest, n, low, high = hashlib.sha256(), 0, None, None
        with fs.open_output_stream(f"{root}/{self.staging}/{name}") as out:
            for row in iterator:
                record = row.asDict(recursive=True)
                line = json.dumps(record, ensure_ascii=False, default=str, sort_keys=True).encode() + b"\n"
                out.write(line)
                digest.update(line)
                n += 1
                i = record.get(self.key)
                if i is not None:
                    low, high = (i if low is None else min(low, i)), (i if high is None else max(high, i))
        return Written(name, n, digest.hexdigest(), low, high)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _files(self.path)
        manifest = f"{root}/manifest.json"
        from pyarrow.fs import FileType

        if fs.get_file_info(manifest).type != FileType.NotFound and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.path} holds an export")
        done = sorted((m for m in messages if m and m.records), key=lambda m: m.name)
        if self.overwrite and fs.get_file_info(manifest).type != FileType.NotFound:
            fs.delete_file(manifest)  # from here on the folder is no export until the new manifest
            fs.delete_dir(f"{root}/records")
        fs.create_dir(f"{root}/records", recursive=True)
        for m in done:
            fs.move(f"{root}/{self.staging}/{m.name}", f"{root}/records/{m.name}")
        ids = [x for m in done for x in (m.first_id, m.last_id) if x is not None]
        whole = {
            "version": "1.0", "library": self.library, "columns": self.names, "total_books": sum(m.records for m in done), "first_id": min(ids, default=None), "last_id": max(ids, default=None),
            "files": [{"name": m.name, "records": m.records, "sha256": m.sha256} for m in done],
        }
        with fs.open_output_stream(f"{root}/{self.staging}/manifest.json") as out:
            out.write(json.dumps(whole, indent=2).encode())
        fs.move(f"{root}/{self.staging}/manifest.json", manifest)
        fs.delete_dir(f"{root}/{self.staging}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _files(self.path)
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{root}/{self.staging}").type != FileType.NotFound:
            fs.delete_dir(f"{root}/{self.staging}")


class LibraryFormat(DataSource):
    @classmethod
    def name(cls) -> str:
        return "library_export"

    def writer(self, schema: StructType, overwrite: bool) -> LibraryWriter:
        return LibraryWriter(self.options, schema, overwrite)


def export(books: DataFrame, path: str, ids: DataFrame | None = None, library: str = "", overwrite: bool = False) -> None:
    """All books, or those whose ids are given, to ``path``, which every executor reaches."""
    spark = books.sparkSession
    spark.dataSource.register(LibraryFormat)
    rows = books if ids is None else books.join(ids.select("id").distinct(), "id", "left_semi")
    rows.write.format("library_export").mode("overwrite" if overwrite else "append").option("path", path).option("library", library).save()


def read_manifest(path: str) -> dict:
    """The manifest of a whole export; an error where there is none."""
    fs, root = _files(path.rstrip("/"))
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records that the manifest names, and no others."""
    names = [f["name"] for f in read_manifest(path)["files"]]
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path.rstrip('/')}/records/{n}" for n in names])
