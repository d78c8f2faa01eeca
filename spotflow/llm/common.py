"""Helpers shared by the corpus operators: reading tables, Arrow maps, stored intermediate tables."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import forget, stored  # noqa: F401  for the operators

#: Byte values that separate words in most operators: blank and 0x09-0x0D, which is what bytes.split() uses.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of texts in one slice of a batch, however few rows that makes.
SLICE = 4 << 20


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of the strings and binaries of each row."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return total


def slices(batch: pa.RecordBatch, rows: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """batch in parts of at most `rows` rows and about `size` bytes; a row is never cut."""
    if not batch.num_rows:
        return
    upto = np.cumsum(row_bytes(batch))
    begin = 0
    while begin < batch.num_rows:
        before = int(upto[begin - 1]) if begin else 0
        end = min(begin + rows, max(begin + 1, int(np.searchsorted(upto, before + size, side="right"))))
        yield batch.slice(begin, end - begin)
        begin = end


def map_rows(df: DataFrame, fn: Callable, schema: str, rows: int = 2000) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows and about SLICE bytes: fn(iterator of RecordBatch) yields RecordBatch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(part for b in batches for part in slices(b, rows))
        returned()

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores in front as it takes to clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame, column: str, name: str = "numbered") -> DataFrame:
    """df with a number for each row, stored: whatever reads it sees the same rows under the same numbers.

    Numbers given in passing differ between two readings of an input that isn't stored, whose rows may come
    in another order or in other partitions.
    """
    return stored(df.withColumn(column, F.monotonically_increasing_id()), name)


def input_bytes(df: DataFrame, column: str) -> int:
    """Catalyst's size estimate of df's sources, for choosing bucket counts; where it has none, the column's bytes."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return known if known < 1 << 55 else int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def crc_mod(col, n: int):
    """crc32 of the id as text, modulo n: the fixed way in which rows are held out. Null stays null."""
    return F.crc32(col.cast("string").cast("binary")) % n


_kept: dict = {}


def once(key: str, make: Callable):
    """What make() returns, made once in each Python worker; only the latest key is kept."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def returned() -> None:
    """Gives memory that a finished task has freed back to the system: its worker may idle beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def send(spark: SparkSession, value):
    """Broadcast (key, value); the key is for once()."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, value))


#: Bits of a filter of members; of fixed size.
FILTER_BITS = 1 << 26


def _filter_places(keys: np.ndarray) -> list[np.ndarray]:
    from .substr import mix

    return [(mix(keys + np.uint64(seed)) % np.uint64(FILTER_BITS)).astype(np.int64) for seed in (1, 2)]


class Members:
    """A filter of whole numbers: has() is true for all members, and for few others while these are fewer than some millions."""

    def __init__(self, sent):
        self.sent = sent

    def has(self, keys: np.ndarray) -> np.ndarray:
        table, out = self.sent.value[1], np.ones(len(keys), bool)
        for at in _filter_places(keys.view(np.uint64)):
            out &= (table[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return out


def member_filter(rows: DataFrame, column: str) -> Members:
    """A filter of the column's values, made by the tasks and sent to them: FILTER_BITS / 8 bytes, however many there are."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_filter_places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))
            word = at >> 6
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))[: len(at)]
            held = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), begin) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word[begin].astype(np.int32)), pa.array(held.view(np.int64))], ["word", "bits"])

    found = rows.select(column).mapInArrow(bits, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Members(send(rows.sparkSession, table))
