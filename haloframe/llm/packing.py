"""Best-fit packing of tokenised documents into fixed-length sequences.

``pieces`` tokenises (no shuffle), ``place`` packs by bounded-space online best-fit.  Only narrow
rows (no ids, no text) are shuffled for packing; many packers work side by side, each over a hash
share of the pieces, so no packer sees more than ``share`` pieces whatever the corpus size.

Nulls: a null text is an empty one and makes one piece holding only the end id; a null ``doc_id`` is
kept and packed like any other.  Repeated rows are packed once each.  An empty table gives no rows.
Texts of any length are encoded whole; a special token's string in a text gets that token's id, as the plain
tokenizer gives it.  Extra columns of the input are not carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haloframe.llm import bpe
from haloframe.llm.common import cut, ensure_small_batches

CAPACITY = 2048
END_ID = 0
OPEN_BINS = 512
SHARE = 100_000
_CHUNK_IDS = 2_000_000

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"
_PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def cut_points(total: int, capacity: int) -> list[int]:
    """Starts of a document's pieces: all full but the first, which takes the remainder."""
    first = total % capacity or min(total, capacity)
    return [0, *range(first, total, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit ids)."""
    ensure_small_batches(docs.sparkSession)
    paths = paths or bpe.default_paths()
    end = np.asarray([END_ID], dtype="<u4")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
    )

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.concatenate([bpe.encode(text.as_py() or "", paths, special=True), end])
                starts = cut_points(len(ids), capacity)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append((doc_id.as_py(), k, a, b - a, ids[a:b].tobytes()))
                held += len(ids)
                if held >= _CHUNK_IDS:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tokenised, _PIECES)


class OpenBins:
    """A fixed number of open bins, kept by free space; a bitset tells which free spaces occur."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.open, self.made, self.mask = capacity, most, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_id = stack.pop()
        if not stack:
            self.mask &= ~(1 << free)
        return bin_id

    def put(self, length: int) -> tuple[int, int]:
        """The bin and offset of a piece: the fullest open bin it fits in, else a new one."""
        fitting = self.mask >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open == self.most:  # the fullest bin closes first
                self._take((self.mask & -self.mask).bit_length() - 1)
                self.open -= 1
            bin_id, free = self.made, self.capacity
            self.made += 1
            self.open += 1
        left = free - length
        if left:
            self.by_free[left].append(bin_id)
            self.mask |= 1 << left
        else:
            self.open -= 1
        return bin_id, self.capacity - free


def place(parts: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, share: int = SHARE, numbered: bool = False) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows ``doc_id, piece, start, length, ids_crc32``, and ``row`` if they are ``numbered``."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            put = [bins.put(n) for n in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + b for b, _ in put], pa.int64()), pa.array([o for _, o in put], pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    rows = cut(parts.select("doc_id", "piece", "start", "length", "ids_crc32", *["row"] * numbered))
    packers = max(1, -(-rows.count() // share))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    schema = _PLACED.replace("sequence_id", "row bigint, sequence_id") if numbered else _PLACED
    return rows.repartition(packers, order).sortWithinPartitions(order).mapInArrow(packed, schema)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed(docs: DataFrame) -> DataFrame:
    """All documents packed; the ids leave the tokenising tasks only as their checksum."""
    return place(pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece with its place and its ``ids`` (little-endian unsigned 32-bit), ready to be read sequence by sequence.

    Pieces are numbered and packed without their ids, which then join their places by number.
    """
    parts = cut(pieces(docs).withColumn("ids_crc32", F.crc32("ids")).withColumn("row", F.monotonically_increasing_id()))
    placed = place(parts.drop("ids"), numbered=True)
    return placed.join(parts.select("row", "ids"), "row").drop("row")
