"""Counts, and a bitmap, over all rows in a table of fixed size, put together by Spark in blocks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 1 << 14


class Tally:
    """Counts of hashed keys; updates gather until they pay for a pass over the table."""

    def __init__(self, size: int):
        self.table, self.held, self.waiting = np.zeros(size, np.int64), [], 0

    def add(self, slots: np.ndarray) -> None:
        self.held.append(slots)
        self.waiting += len(slots)
        if self.waiting >= 1 << 20:
            self.settle()

    def settle(self) -> None:
        if self.held:
            self.table += np.bincount(np.concatenate(self.held), minlength=len(self.table))
            self.held, self.waiting = [], 0

    def blocks(self) -> list[tuple[int, bytes]]:
        """``(block, counts)`` of the blocks that are not all zero, as packed 32-bit integers."""
        self.settle()
        counts = np.minimum(self.table, np.iinfo(np.uint32).max).astype("<u4").reshape(-1, BLOCK)
        return [(k, zlib.compress(row.tobytes(), 1)) for k, row in enumerate(counts) if row.any()]


def total(blocks: DataFrame, size: int) -> np.ndarray:
    """Sums rows ``(block, counts)``: a row for each block reaches the driver, ``8 * size`` bytes in all."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = np.frombuffer(zlib.decompress(raw.as_py()), "<u4").astype(np.int64)
                sums[k] = sums[k] + row if k in sums else row
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["block", "counts"]
            )

    table = np.zeros(size, np.int64)
    for k, raw in blocks.select("block", "counts").repartition("block").mapInArrow(add, "block int, counts binary").collect():
        table[k * BLOCK : (k + 1) * BLOCK] += np.frombuffer(bytes(raw), np.int64)
    return table


def _packed(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())], names=["block", "bits"])


def bitmap(hashes: DataFrame, most: int) -> np.ndarray:
    """A bitmap of the one column of 64-bit ``hashes``, 16 bits a row or more, ``most`` bits (a power of two) at most."""
    size = 1 << max(17, min(most.bit_length() - 1, (16 * hashes.count()).bit_length()))
    width = 1 << 14  # bytes of a block

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size >> 3, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) & np.uint64(size - 1)
            np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        yield _packed({k: row for k, row in enumerate(table.reshape(-1, width)) if row.any()})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = np.frombuffer(raw.as_py(), np.uint8)
                blocks[k] = blocks[k] | row if k in blocks else row
        yield _packed(blocks)

    table = np.zeros(size >> 3, np.uint8)
    made = hashes.mapInArrow(mark, "block int, bits binary").repartition("block").mapInArrow(merge, "block int, bits binary")
    for k, raw in made.collect():
        table[k * width : (k + 1) * width] |= np.frombuffer(bytes(raw), np.uint8)
    return table


def bits_of(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    at = hashes.view(np.uint64) & np.uint64(8 * len(table) - 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
