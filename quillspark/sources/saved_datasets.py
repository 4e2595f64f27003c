"""Datasets saved as Arrow stream files with a state file that names them in order, as tables.

Reading: a partition is a file, decoded batch by batch; only the columns asked for leave it. Writing: a task writes a file
beside the final names, and the state file, which marks the dataset as whole, comes last, after the files have their
names. A folder without a state file is no dataset.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from .tensor_files import opened

#: The state file, its list of files, and what describes the columns.
STATE, FILES, INFO = "state.json", "_data_files", "dataset_info.json"


def exists(path: str) -> bool:
    files, folder = opened(path)
    return files.get_file_info(f"{folder}/{STATE}").is_file


def named(path: str) -> list[str]:
    """The dataset's files in order."""
    files, folder = opened(path)
    with files.open_input_file(f"{folder}/{STATE}") as f:
        return [f"{folder}/{x['filename']}" for x in json.loads(f.read())[FILES]]


@dataclass
class File(InputPartition):
    file: str
    number: int


class SavedReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns

    def partitions(self) -> list[File]:
        return [File(name, k) for k, name in enumerate(named(self.path))]

    def read(self, p: File) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        at = 0
        with files.open_input_stream(p.file) as f, pa.ipc.open_stream(f) as batches:
            for b in batches:
                n = b.num_rows
                own = [b.column(b.schema.get_field_index(c)) for c in self.columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array([p.number] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())], [*self.columns, "_file", "_row"])
                at += n


@dataclass
class Part(WriterCommitMessage):
    number: int
    file: str | None
    rows: int


class SavedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema):
        self.path, self.schema, self.job = options["path"], to_arrow_schema(schema), f"_writing-{uuid.uuid4().hex}"
        files, folder = opened(self.path)
        files.create_dir(f"{folder}/{self.job}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        files, folder = opened(self.path)
        at, n, out = f"{folder}/{self.job}/{uuid.uuid4().hex}", 0, None
        number = TaskContext.get().partitionId()
        for b in iterator:
            if out is None:
                sink = files.open_output_stream(at)
                out = pa.ipc.new_stream(sink, b.schema)
            out.write_batch(b)
            n += b.num_rows
        if out is not None:
            out.close()
            sink.close()
        return Part(number, at if out is not None else None, n)

    def commit(self, messages: list[Part | None]) -> None:
        files, folder = opened(self.path)
        parts = sorted((m for m in messages if m is not None and m.file), key=lambda m: m.number)
        for i in files.get_file_info(arrow_fs.FileSelector(folder)):
            if i.is_file and (i.base_name == STATE or i.base_name.endswith(".arrow")):
                files.delete_file(i.path)
        if not parts:
            empty = f"{folder}/{self.job}/empty"
            with files.open_output_stream(empty) as sink, pa.ipc.new_stream(sink, self.schema):
                pass
            parts = [Part(0, empty, 0)]
        names = [f"data-{k:05d}-of-{len(parts):05d}.arrow" for k in range(len(parts))]
        for m, name in zip(parts, names, strict=True):
            files.move(m.file, f"{folder}/{name}")
        for name, body in ((INFO, {"num_rows": sum(m.rows for m in parts), "columns": self.schema.names}), (STATE, {FILES: [{"filename": n} for n in names]})):
            with files.open_output_stream(f"{folder}/{name}") as f:
                f.write(json.dumps(body, indent=2).encode())
        files.delete_dir(f"{folder}/{self.job}")

    def abort(self, messages: list) -> None:
        files, folder = opened(self.path)
        files.delete_dir(f"{folder}/{self.job}")


class SavedDatasets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "saved"

    def _columns(self) -> pa.Schema:
        files, _ = opened(self.options["path"])
        with files.open_input_stream(named(self.options["path"])[0]) as f, pa.ipc.open_stream(f) as s:
            every = s.schema
        if "columns" not in self.options:
            return every
        return pa.schema([every.field(c) for c in json.loads(self.options["columns"])])

    def schema(self):
        return from_arrow_schema(self._columns()).add("_file", "long").add("_row", "long")

    def reader(self, schema) -> SavedReader:
        return SavedReader(self.options, [c for c in schema.names if c not in ("_file", "_row")])

    def writer(self, schema, overwrite: bool) -> SavedWriter:
        return SavedWriter(self.options, schema)


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of a saved dataset with `idx`, their position from 0 in its files. Only a count a file meets in one place."""
    spark.dataSource.register(SavedDatasets)
    r = spark.read.format("saved")
    rows = (r if columns is None else r.option("columns", json.dumps(columns))).load(path)
    counts = r.option("columns", "[]").load(path).groupBy("_file").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_file").alias("_at"), F.coalesce(F.sum("_n").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(before, F.col("_file") == F.col("_at")).withColumn("idx", F.col("_before") + F.col("_row")).drop("_file", "_row", "_at", "_before")


def save(df: DataFrame, path: str) -> None:
    """Write df, a file a partition in their order; what the folder had of a dataset before is replaced."""
    df.sparkSession.dataSource.register(SavedDatasets)
    df.write.format("saved").mode("append").option("path", path).save()
