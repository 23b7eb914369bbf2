"""BAM files as a Python data source: ``spark.read.format("bam").load(path)``."""

from __future__ import annotations

import glob
import gzip
import itertools
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "qname string, flag int, rname string, pos long, mapq int, rnext string, pnext long, tlen long"

NAMES = [field.split()[0] for field in SCHEMA.split(", ")]
TYPES = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[field.split()[1]] for field in SCHEMA.split(", ")]
ROWS = 10_000


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class BamReader(DataSourceReader):
    """One partition per file; blocks are decompressed as a stream, so a task holds one batch of records at a time."""

    def __init__(self, path: str):
        self.files = sorted(glob.glob(os.path.join(path, "*.bam"))) if os.path.isdir(path) else [path]

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in self.files]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        """Arrow batches of ``ROWS`` records."""
        rows = self._records(partition.path)
        while some := list(itertools.islice(rows, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), TYPES, strict=True)], names=NAMES)

    def _records(self, path: str) -> Iterator[tuple]:
        with gzip.open(path, "rb") as data:
            if data.read(4) != b"BAM\x01":
                raise ValueError(f"{path} is no BAM file")
            data.read(struct.unpack("<i", data.read(4))[0])
            names = []
            for _ in range(struct.unpack("<i", data.read(4))[0]):
                names.append(data.read(struct.unpack("<i", data.read(4))[0])[:-1].decode())
                data.read(4)
            name = lambda k: names[k] if k >= 0 else "*"
            while len(size := data.read(4)) == 4:
                body = data.read(struct.unpack("<i", size)[0])
                ref, pos, l_name, mapq, _, _, flag, _, mate, mate_pos, tlen = struct.unpack("<iiBBHHHiiii", body[:32])
                yield body[32 : 32 + l_name - 1].decode(), flag, name(ref), pos + 1, mapq, name(mate), mate_pos + 1, tlen


class BamSource(DataSource):
    """Name ``bam``; path: one file or a folder of ``*.bam`` that all executors can read."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"].removeprefix("file://"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)
