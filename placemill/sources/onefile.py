"""One file made of the rows of a DataFrame, none of which passes the driver.

Tasks write their rows as pieces beside the file and report a piece's bytes, rows and checksum. From these few numbers, a line a task, the driver knows where
each piece starts and writes what stands around them; tasks of a second job copy the pieces to their places. The file gets its name once it is whole.

It needs a folder that driver and executors share as a file system with random access (a mounted one; ``file:`` or no scheme); elsewhere rows stay in parts.
A task that runs twice writes two pieces, and only the one it reported is used. An empty table gives what stands around the rows; nulls are empty.
"""

from __future__ import annotations

import os
import shutil
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placemill import ship
from placemill.storage import written

CHUNK = 1 << 20
#: The polynomial of CRC-32 as ZIP has it, and x to the eighth, bits reversed.
_POLYNOMIAL, _BYTE = 0xEDB88320, 0x00800000


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of the checksum; the highest bit is the constant term."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, size: int) -> int:
    """The CRC-32 of two texts in a row, from theirs and the size of the second."""
    power, square = 0x80000000, _BYTE
    while size:
        if size & 1:
            power = _times(power, square)
        square, size = _times(square, square), size >> 1
    return _times(power, first) ^ second


def local_path(path: str) -> str:
    at = urlparse(path)
    if at.scheme not in ("", "file"):
        raise ValueError(f"one file needs a shared folder with random access, not {at.scheme}:")
    return at.path


def write_one(lines: DataFrame, path: str, around: Callable[[BinaryIO, int, int], int]) -> int:
    """The first column of ``lines``, in order, as one file; the number of rows.

    ``around(file, size, crc)`` writes the rest of the file, knowing the size and checksum of all rows, and returns where they start.
    """
    spark, path = lines.sparkSession, local_path(path)
    ship(spark)
    folder = f"{path}.{uuid.uuid4().hex}"
    os.makedirs(folder)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size, rows, crc = f"{TaskContext.get().partitionId():09d}-{uuid.uuid4().hex}", 0, 0, 0
        with open(f"{folder}/{name}", "wb") as f:
            for batch in batches:
                data = b"".join(x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist())
                size, rows, crc = size + f.write(data), rows + batch.num_rows, zlib.crc32(data, crc)
        yield pa.RecordBatch.from_pydict({"name": [name], "size": [size], "rows": [rows], "crc": [crc]})

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.to_pylist():
                with open(f"{folder}/{piece['name']}", "rb") as source, open(f"{folder}/whole", "r+b") as to:
                    to.seek(piece["at"])
                    shutil.copyfileobj(source, to, CHUNK)
                    copied = to.tell() - piece["at"]
                yield pa.RecordBatch.from_pydict({"copied": [copied]})

    try:
        pieces = sorted(lines.mapInArrow(cut, "name string, size long, rows long, crc long").collect())  # names begin with the partition's number
        size, crc = sum(p.size for p in pieces), 0
        for p in pieces:
            crc = joined_crc(crc, p.crc, p.size)
        with open(f"{folder}/whole", "wb") as f:
            at = around(f, size, crc)
        placed = []
        for p in pieces:
            placed.append((p.name, at))
            at += p.size
        if size:
            todo = spark.createDataFrame(placed, "name string, at long").repartition(len(placed), "name")
            copied = todo.mapInArrow(copy, "copied long").agg(F.sum("copied")).first()[0]
            if copied != size:
                raise OSError(f"{copied} of {size} bytes were copied to {path}")
        os.replace(f"{folder}/whole", path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return sum(p.rows for p in pieces)


def numbered(rows: DataFrame) -> DataFrame:
    """Ordered ``rows`` as ``n, whole``: numbers from one, in order, and all columns in a struct. Partitions are counted, not gathered."""
    kept = written(rows.select(F.struct("*").alias("whole"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")), "ordered")
    counts = kept.groupBy("part").agg(F.count("*").alias("rows"), F.min("id").alias("first"))  # a row a task
    starts = counts.select("part", "first", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("start"))
    return kept.join(F.broadcast(starts), "part").select((F.col("start") + F.col("id") - F.col("first") + 1).alias("n"), "whole").orderBy("n")


def lines_of(spark: SparkSession, path: str, end: str) -> DataFrame:
    """``n, value``: the lines of one file, numbered from zero, however many tasks read it."""
    lines = spark.read.option("lineSep", end).text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    counts = lines.groupBy("block").agg(F.count("*").alias("rows"), F.min("id").alias("first"))  # a row a split
    starts = counts.select("block", "first", (F.sum("rows").over(Window.orderBy("block")) - F.col("rows")).alias("start"))
    return lines.join(starts, "block").select((F.col("start") + F.col("id") - F.col("first")).alias("n"), "value")
