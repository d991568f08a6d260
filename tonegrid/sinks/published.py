"""Streams of chunks as files that appear at once: a Spark data sink with commit.

``df.write.format("stream_chunks").mode("append").save(folder)`` takes rows of stream_id, chunk_no, offset and content. A task
writes its chunks to a file of its own and their places beside it, under a name that no other attempt has. The commit
puts one list of the attempts that succeeded into the folder; what isn't on it is no part of the result, so a task that
fails and runs again leaves no byte twice, and a job that fails leaves nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FIELDS = "stream_id long, chunk_no long, offset long, content binary"
PLACES = pa.schema([("stream_id", pa.int64()), ("chunk_no", pa.int64()), ("offset", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("bytes", pa.int64())])
LISTED = "_committed-"


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    name: str
    chunks: int
    bytes: int


class ChunkWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        system, folder = located(self.path)
        system.create_dir(folder, recursive=True)
        name, places, at = f"{self.job}-{uuid.uuid4().hex}", [], 0
        with system.open_output_stream(f"{folder}/{name}.bin") as out:
            for r in rows:
                out.write(r.content)
                places.append((r.stream_id, r.chunk_no, r.offset, f"{name}.bin", at, len(r.content)))
                at += len(r.content)
        table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*places), PLACES)] if places else [pa.array([], f.type) for f in PLACES], schema=PLACES)
        pq.write_table(table, f"{folder}/{name}.places.parquet", filesystem=system)
        return Written(name, len(places), at)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = located(self.path)
        system.create_dir(folder, recursive=True)
        kept = [m for m in messages if m is not None]
        before = [f.path for f in system.get_file_info(pafs.FileSelector(folder)) if f.base_name.startswith(LISTED)]
        with system.open_output_stream(f"{folder}/.{self.job}") as out:
            out.write(json.dumps([{"name": m.name, "chunks": m.chunks, "bytes": m.bytes} for m in kept]).encode())
        system.move(f"{folder}/.{self.job}", f"{folder}/{LISTED}{self.job}")
        for old in before if self.overwrite else []:
            system.delete_file(old)
        self.clear({m.name for m in kept})

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(set())

    def clear(self, kept: set[str]) -> None:
        """Removes what other attempts of this job left."""
        system, folder = located(self.path)
        for f in system.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if f.base_name.startswith(self.job) and f.base_name.partition(".")[0] not in kept:
                system.delete_file(f.path)


class StreamChunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stream_chunks"

    def schema(self) -> str:
        return FIELDS

    def writer(self, schema: object, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StreamChunks)


def published(spark: SparkSession, path: str) -> DataFrame:
    """stream_id, chunk_no, offset, file, at and bytes of all chunks that commits have listed: the folder's index."""
    system, folder = located(path)
    names = []
    for f in system.get_file_info(pafs.FileSelector(folder)):
        if f.base_name.startswith(LISTED):
            with system.open_input_stream(f.path) as listed:
                names += [m["name"] for m in json.loads(listed.read())]
    if not names:
        return spark.createDataFrame([], "stream_id long, chunk_no long, offset long, file string, at long, bytes long")
    return spark.read.parquet(*[f"{path}/{n}.places.parquet" for n in names])
