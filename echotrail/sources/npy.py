"""``.npy`` matrices as a Spark data source: the header is read once, rows by byte ranges in many tasks.

``spark.read.format("npy").load(path)`` gives ``(row, vector)``. Files must lie where the driver and all executors
can open them, as on a mounted file system. Two-dimensional matrices of floats or integers are read; one in Fortran
order is laid out by columns, so each of its tasks gathers its rows from every column.
"""

from __future__ import annotations

import ast
import glob
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# What a file begins with, and the bytes that hold the header's length by major version.
MAGIC = b"\x93NUMPY"
LENGTH_BYTES = {1: 2, 2: 4, 3: 4}
SPLIT_BYTES = 64 * 1024 * 1024
BATCH_BYTES = 4 * 1024 * 1024


@dataclass(frozen=True)
class Header:
    kind: np.dtype
    by_column: bool
    rows: int
    width: int
    start: int


def read_header(path: str) -> Header:
    """Kind of number, order, shape and first data byte; refuses what is no matrix of numbers."""
    with open(path, "rb") as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no .npy file")
        major, _ = f.read(2)
        if major not in LENGTH_BYTES:
            raise ValueError(f"{path} has a header of unknown version {major}")
        length = int.from_bytes(f.read(LENGTH_BYTES[major]), "little")
        said = ast.literal_eval(f.read(length).decode("utf-8" if major == 3 else "latin-1"))
        start = f.tell()
    if not isinstance(said, dict) or not isinstance(said.get("descr"), str) or not re.fullmatch(r"[<>|=]?[fiu][1248]", said["descr"]):
        raise ValueError(f"{path} does not hold plain numbers")
    shape = said.get("shape")
    if not isinstance(shape, tuple) or len(shape) != 2:
        raise ValueError(f"{path} holds no matrix: its shape is {shape}")
    kind = np.dtype(said["descr"])
    if os.path.getsize(path) - start < kind.itemsize * shape[0] * shape[1]:
        raise ValueError(f"{path} is cut short")
    return Header(kind, bool(said["fortran_order"]), shape[0], shape[1], start)


def read_rows(path: str, header: Header, begin: int, end: int) -> np.ndarray:
    """Rows ``begin`` to ``end`` as float64; only their bytes are read."""
    n, size = end - begin, header.kind.itemsize
    with open(path, "rb") as f:
        if not header.by_column:
            f.seek(header.start + begin * header.width * size)
            data = np.frombuffer(f.read(n * header.width * size), header.kind).reshape(n, header.width)
        else:
            columns = []
            for c in range(header.width):
                f.seek(header.start + (c * header.rows + begin) * size)
                columns.append(np.frombuffer(f.read(n * size), header.kind))
            data = np.column_stack(columns) if columns else np.zeros((n, 0))
    return data.astype(np.float64)


class Rows(InputPartition):
    def __init__(self, path: str, header: Header, begin: int, end: int, first: int):
        self.path, self.header, self.begin, self.end, self.first = path, header, begin, end, first


def local_path(path: str) -> str:
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"{path}: .npy files are read from mounted file systems")
    return unquote(parsed.path) if parsed.scheme else path


class NpyReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = local_path(path), split_bytes

    def partitions(self) -> list[InputPartition]:
        """Row ranges of about ``split_bytes``; rows are numbered over all files in the order of their names."""
        files = sorted(glob.glob(os.path.join(self.path, "*.npy"))) if os.path.isdir(self.path) else [self.path]
        found, first = [], 0
        for path in files:
            h = read_header(path)
            step = max(1, self.split_bytes // max(1, h.width * h.kind.itemsize))
            found += [Rows(path, h, begin, min(h.rows, begin + step), first + begin) for begin in range(0, h.rows, step)]
            first += h.rows
        return found or [Rows("", Header(np.dtype("f8"), False, 0, 0, 0), 0, 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH_BYTES // max(1, 8 * part.header.width))
        for begin in range(part.begin, part.end, step):
            rows = read_rows(part.path, part.header, begin, min(part.end, begin + step))
            number = part.first + begin - part.begin
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * part.header.width
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(number, number + len(rows))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))], names=["row", "vector"])


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("row", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return NpyReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def read_npy(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(row, vector)`` of one ``.npy`` file or of all in a folder, rows numbered from 0 in file order."""
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("splitBytes", str(split_bytes)).load(path)
