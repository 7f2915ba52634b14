"""Reader for vector files as a Python data source: spark.read.format("vecs").load("file.fvecs").

Each record is a little-endian count and that many numbers: float32 in .fvecs, int32 in .ivecs. Records have one
size, so a file splits at multiples of it and reads in parallel.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 64 << 20


class Part(InputPartition):
    def __init__(self, path: str, begin: int, end: int, width: int):
        self.path, self.begin, self.end, self.width = path, begin, end, width


class VectorReader(DataSourceReader):
    def __init__(self, path: str, integers: bool):
        self.path, self.integers = path, integers

    def partitions(self):
        import os

        size = os.path.getsize(self.path)
        if not size:
            return []
        with open(self.path, "rb") as f:
            width = 4 + 4 * struct.unpack("<i", f.read(4))[0]
        if size % width:
            raise ValueError("records of different sizes")
        step = max(1, SPLIT_BYTES // width) * width
        return [Part(self.path, a, min(a + step, size), width) for a in range(0, size, step)]

    def read(self, part: Part):
        with open(part.path, "rb") as f:
            f.seek(part.begin)
            raw = f.read(part.end - part.begin)
        kind = np.dtype("<i4" if self.integers else "<f4")
        rows = np.frombuffer(raw, np.uint8).reshape(-1, part.width)[:, 4:].copy().view(kind)
        first = part.begin // part.width
        values = pa.array(rows.ravel().astype(np.int32 if self.integers else np.float32))
        offsets = pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(rows))), pa.ListArray.from_arrays(offsets, values)], ["vec_id", "embedding"])


class VectorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecs"

    def _integers(self) -> bool:
        return self.options["path"].endswith(".ivecs")

    def schema(self) -> str:
        return f"vec_id long, embedding array<{'int' if self._integers() else 'float'}>"

    def reader(self, schema) -> DataSourceReader:
        return VectorReader(self.options["path"], self._integers())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorFiles)
