"""Feather (Arrow IPC) files as a Spark data source.

Reading plans one partition per record batch from the file footers, so a large
file is split; writing stages one file per task and moves only the files of
successful attempts into place.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

SUFFIX = ".feather"
STAGING = "_staging"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The data files under a path; staged and hidden files are skipped."""
    fs, base = _open(path)
    info = fs.get_file_info(base)
    if info.type == pafs.FileType.File:
        return [base]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pafs.FileSelector(base))
    return sorted(f.path for f in found if f.path.endswith(SUFFIX) and not f.base_name.startswith(("_", ".")))


@dataclass
class RecordBatchPartition(InputPartition):
    file: str
    batch: int


class FeatherReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path = path
        self.target = to_arrow_schema(schema)

    def partitions(self) -> list[RecordBatchPartition]:
        fs, _ = _open(self.path)
        plan = []
        for file in _files(self.path):
            with fs.open_input_file(file) as source:
                batches = pa.ipc.open_file(source).num_record_batches
            plan += [RecordBatchPartition(file, i) for i in range(batches)]
        return plan

    def read(self, partition: RecordBatchPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        with fs.open_input_file(partition.file) as source:
            batch = pa.ipc.open_file(source).get_batch(partition.batch)
            table = pa.Table.from_batches([batch]).select(self.target.names)
            yield from table.cast(self.target, safe=False).combine_chunks().to_batches()


@dataclass
class WrittenFile(WriterCommitMessage):
    name: str | None


class FeatherWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path = path
        self.target = to_arrow_schema(schema)
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex

    def _staged(self) -> tuple[pafs.FileSystem, str, str]:
        fs, base = _open(self.path)
        return fs, base, f"{base}/{STAGING}/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFile:
        fs, _, staging = self._staged()
        first = next(iterator, None)
        if first is None:
            return WrittenFile(None)
        fs.create_dir(staging, recursive=True)
        name = f"part-{uuid.uuid4().hex}{SUFFIX}"
        with fs.open_output_stream(f"{staging}/{name}") as sink, pa.ipc.new_file(sink, self.target) as out:
            for batch in _chain(first, iterator):
                out.write_table(pa.Table.from_batches([batch]).cast(self.target, safe=False))
        return WrittenFile(name)

    def commit(self, messages: list[WrittenFile]) -> None:
        fs, base, staging = self._staged()
        fs.create_dir(base, recursive=True)
        replaced = _files(self.path) if self.overwrite else []
        for message in messages:
            if message is not None and message.name:
                fs.move(f"{staging}/{message.name}", f"{base}/{message.name}")
        for old in replaced:
            fs.delete_file(old)
        self._clear(fs, staging)

    def abort(self, messages: list[WrittenFile]) -> None:
        fs, _, staging = self._staged()
        self._clear(fs, staging)

    @staticmethod
    def _clear(fs: pafs.FileSystem, staging: str) -> None:
        if fs.get_file_info(staging).type == pafs.FileType.Directory:
            fs.delete_dir(staging)


def _chain(first, rest):
    yield first
    yield from rest


class FeatherSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feather"

    def schema(self) -> StructType:
        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no {SUFFIX} files under {self.options['path']}")
        fs, _ = _open(self.options["path"])
        with fs.open_input_file(files[0]) as source:
            found = pa.ipc.open_file(source).schema
        plain = pa.schema([(f.name, _plain_type(f.type)) for f in found])
        return from_arrow_schema(plain, prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> FeatherReader:
        return FeatherReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> FeatherWriter:
        return FeatherWriter(self.options["path"], schema, overwrite)


def _plain_type(kind: pa.DataType) -> pa.DataType:
    if pa.types.is_dictionary(kind):
        return kind.value_type
    if pa.types.is_timestamp(kind):
        return pa.timestamp("us", kind.tz)
    return kind


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeatherSource)


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("feather").load(path)


def write_feather(df: DataFrame, path: str) -> None:
    register(df.sparkSession)
    df.write.format("feather").mode("overwrite").save(path)
