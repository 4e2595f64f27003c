"""Tensor files (a header of JSON before raw numbers, several shards with an index) as tables of tiles.

Reading: `spark.read.format("tensors").load(folder)`; a partition is a tensor, or some rows of a large one, and reads its
own bytes alone, strip by strip. Writing: `save`; a shard is written by one task, strip by strip, beside the folder's
final names, and gets its name when all tasks have ended. A task that fails leaves nothing that a reader would take.

Files are opened through Arrow's file systems, so the folder may be local to all (a shared mount) or an address.
A tensor of one dimension is a row; of several, the first is rows and the others together columns.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.tiles import SIZE

#: Names within a model's folder, and bytes of a number of each type.
INDEX, SUFFIX = "model.safetensors.index.json", ".safetensors"
WIDTHS = {"F64": 8, "F32": 4, "F16": 2, "BF16": 2, "I64": 8, "I32": 4, "I16": 2, "I8": 1, "U8": 1, "BOOL": 1}
#: Bytes of a partition, about.
PARTITION = 128 << 20
SCHEMA = "shard string, module string, dtype string, shape array<long>, bi long, bj long, rows int, cols int, data binary"


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def header(files: arrow_fs.FileSystem, path: str) -> tuple[dict, int]:
    """The tensors of a shard, and where their bytes begin."""
    with files.open_input_file(path) as f:
        (size,) = struct.unpack("<Q", f.read(8))
        named = json.loads(f.read(size))
    named.pop("__metadata__", None)
    return named, 8 + size


def extent(shape: list[int]) -> tuple[int, int]:
    return (1, math.prod(shape)) if len(shape) < 2 else (shape[0], math.prod(shape[1:]))


@dataclass
class Rows(InputPartition):
    file: str
    shard: str
    module: str
    dtype: str
    shape: list[int]
    begin: int  # of the tensor's bytes in the file
    first: int  # the rows of the tensor that this partition has
    end: int


class TensorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("size", SIZE))

    def partitions(self) -> list[Rows]:
        files, folder = opened(self.path)
        names = {i.base_name for i in files.get_file_info(arrow_fs.FileSelector(folder)) if i.is_file}
        index = None
        if INDEX in names:
            with files.open_input_file(f"{folder}/{INDEX}") as f:
                index = json.loads(f.read())["weight_map"]
        out = []
        for name in sorted(n for n in names if n.endswith(SUFFIX)) if index is None else sorted(set(index.values())):
            named, at = header(files, f"{folder}/{name}")
            for module, t in sorted(named.items()):
                if index is not None and index.get(module) != name:
                    continue  # a tensor elsewhere than the index says does not count
                rows, cols = extent(t["shape"])
                step = max(1, PARTITION // max(1, cols * WIDTHS[t["dtype"]] * self.size)) * self.size
                out += [Rows(f"{folder}/{name}", name, module, t["dtype"], t["shape"], at + t["data_offsets"][0], lo, min(rows, lo + step)) for lo in range(0, rows, step)]
        return out

    def read(self, p: Rows) -> Iterator[tuple]:
        files, _ = opened(self.path)
        _, cols = extent(p.shape)
        width = WIDTHS[p.dtype]
        with files.open_input_file(p.file) as f:
            for lo in range(p.first, p.end, self.size):
                rows = min(self.size, p.end - lo)
                f.seek(p.begin + lo * cols * width)
                strip = np.frombuffer(f.read(rows * cols * width), np.uint8).reshape(rows, cols * width)
                for bj in range(-(-cols // self.size)):
                    block = strip[:, bj * self.size * width : (bj + 1) * self.size * width]
                    yield p.shard, p.module, p.dtype, p.shape, lo // self.size, bj, rows, block.shape[1] // width, block.tobytes()


@dataclass
class Written(WriterCommitMessage):
    shards: dict[str, str]  # names and where they are kept until then
    tensors: dict[str, str]  # their shards
    size: int


class Shard:
    """A shard on its way: numbers go to one file as they come, the header is known at the end."""

    def __init__(self, files: arrow_fs.FileSystem, folder: str):
        self.files, self.at = files, f"{folder}/{uuid.uuid4().hex}"
        self.data = files.open_output_stream(f"{self.at}.data")
        self.tensors: dict[str, dict] = {}
        self.size, self.strip, self.module, self.block = 0, [], None, None

    def add(self, row) -> None:
        if (row["module"], row["bi"]) != (self.module, self.block):
            self.flush()
            if row["module"] != self.module and row["module"] in self.tensors:
                raise ValueError(f"rows of tensor {row['module']} are not together")
            self.module, self.block = row["module"], row["bi"]
            self.tensors.setdefault(row["module"], {"dtype": row["dtype"], "shape": list(row["shape"]), "data_offsets": [self.size, self.size]})
        self.strip.append(np.frombuffer(row["data"], np.uint8).reshape(row["rows"], -1))

    def flush(self) -> None:
        if self.strip:
            body = np.hstack(self.strip).tobytes()
            self.data.write(body)
            self.size += len(body)
            self.tensors[self.module]["data_offsets"][1] = self.size
            self.strip = []

    def close(self) -> str:
        self.flush()
        self.data.close()
        for name, t in self.tensors.items():
            begin, end = t["data_offsets"]
            if end - begin != math.prod(t["shape"]) * WIDTHS[t["dtype"]]:
                raise ValueError(f"tensor {name} lacks tiles")
        head = json.dumps(self.tensors, separators=(",", ":")).encode()
        head += b" " * (-len(head) % 8)
        with self.files.open_output_stream(f"{self.at}.whole") as out, self.files.open_input_stream(f"{self.at}.data") as body:
            out.write(struct.pack("<Q", len(head)) + head)
            while part := body.read(1 << 24):
                out.write(part)
        self.files.delete_file(f"{self.at}.data")
        return f"{self.at}.whole"


class TensorWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.sidecars = options["path"], options.get("sidecars")
        self.job = f"_writing-{uuid.uuid4().hex}"
        files, folder = opened(self.path)
        files.create_dir(f"{folder}/{self.job}", recursive=True)

    def write(self, iterator: Iterator) -> Written:
        files, folder = opened(self.path)
        done: dict[str, str] = {}
        tensors, size, shard, now = {}, 0, None, None

        def close() -> int:
            if shard is None:
                return 0
            done[now] = shard.close()
            tensors.update(dict.fromkeys(shard.tensors, now))
            return shard.size

        for row in iterator:
            if row["shard"] != now:
                size += close()
                if row["shard"] in done:
                    raise ValueError(f"rows of shard {row['shard']} are not together")
                shard, now = Shard(files, f"{folder}/{self.job}"), row["shard"]
            shard.add(row)
        size += close()
        return Written(done, tensors, size)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = opened(self.path)
        messages = [m for m in messages if m is not None]
        where = {t: shard for m in messages for t, shard in m.tensors.items()}
        if sum(len(m.shards) for m in messages) != len({s for m in messages for s in m.shards}):
            raise ValueError("a shard was written by several tasks")
        for i in files.get_file_info(arrow_fs.FileSelector(folder)):
            if i.is_file and (i.base_name.endswith(SUFFIX) or i.base_name == INDEX):
                files.delete_file(i.path)
        for m in messages:
            for name, at in m.shards.items():
                files.move(at, f"{folder}/{name}")
        if self.sidecars:
            other, source = opened(self.sidecars)
            for i in other.get_file_info(arrow_fs.FileSelector(source)):
                if i.is_file and not i.base_name.endswith(SUFFIX) and i.base_name != INDEX and i.base_name[0] not in "._":
                    arrow_fs.copy_files(i.path, f"{folder}/{i.base_name}", source_filesystem=other, destination_filesystem=files)
        with files.open_output_stream(f"{folder}/{INDEX}") as out:
            out.write(json.dumps({"metadata": {"total_size": sum(m.size for m in messages)}, "weight_map": dict(sorted(where.items()))}, indent=2).encode())
        files.delete_dir(f"{folder}/{self.job}")

    def abort(self, messages: list) -> None:
        files, folder = opened(self.path)
        files.delete_dir(f"{folder}/{self.job}")


class TensorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TensorReader:
        return TensorReader(self.options)

    def writer(self, schema, overwrite: bool) -> TensorWriter:
        return TensorWriter(self.options)


def read(spark: SparkSession, path: str, size: int = SIZE) -> DataFrame:
    """Tiles (shard, module, dtype, shape, bi, bj, rows, cols, data) of a model's folder."""
    spark.dataSource.register(TensorFiles)
    return spark.read.format("tensors").option("size", size).load(path)


def save(tiles: DataFrame, path: str, sidecars: str | None = None) -> None:
    """Write tiles (as read) into the shards that they name; the index comes last. sidecars: a folder whose other files
    are copied along. What the folder had of shards before is replaced."""
    tiles.sparkSession.dataSource.register(TensorFiles)
    rows = tiles.select(*[c.split()[0] for c in SCHEMA.split(", ")]).repartition("shard").sortWithinPartitions("shard", "module", "bi", "bj")
    options = {"path": path} | ({"sidecars": sidecars} if sidecars else {})
    rows.write.format("tensors").mode("append").options(**options).save()
