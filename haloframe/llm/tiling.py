"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased and punctuation becomes white space.  Seeds are the benchmark's windows of
``MIN_MATCH`` words, joined with the documents' by running Karp-Rabin hashes.  Where the seeds of an item that a
document shares could cover enough of the item, the two are tiled: the longest match of unmarked
words is marked again and again, until none of ``MIN_MATCH`` words is left.  A document is contaminated
if tiles cover ``COVERAGE`` of an item's words, in whatever order they stand.  An item of fewer words has no
window; it is matched whole, by a document that says nothing else.

A benchmark of ``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` at most (counted first) is held by each task as an index
of seeds, and documents are never shuffled.  A larger one stays in Spark: its seeds are a table that joins the
windows of documents, less those that a bitmap of all seeds rules out, and only pairs that share enough seeds are
brought together and tiled.  Both ways give the same rows.

Nulls: null and empty texts match nothing; a null id is reported as null.  Repeated rows, of documents and of
items, are each reported.  Texts of any length are used whole.  ``clean`` carries extra columns along,
``contaminated`` does not; none clashes.  Empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haloframe.llm.common import cut, ensure_small_batches, join_hot, join_side, text_key
from haloframe.llm.counting import bitmap, bits_of
from haloframe.llm.words import hash_words, mix, power_tables

MIN_MATCH = 4
COVERAGE = 0.6
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 32 << 20
#: Bits of the bitmap of seeds: at least 16 a seed, up to this many.
MOST_BITS = 1 << 26

_FOUND = "doc_id bigint, item_id bigint, item_words int, covered_words int, coverage double, tiles int"


def normal(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}\s]+", " "))


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``width`` words, from prefix sums."""
    count = len(words) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    up, down = power_tables(len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
    return mix((sums[width:] - sums[:count]) * down[:count])


def tile(item: np.ndarray, doc: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(item start, doc start, length)`` of non-overlapping matches, longest first."""
    ih, dh = rolling(item, least), rolling(doc, least)
    at = np.flatnonzero(np.isin(dh, ih))
    order = np.argsort(ih, kind="stable")
    lo, hi = np.searchsorted(ih[order], dh[at], "left"), np.searchsorted(ih[order], dh[at], "right")
    reps = hi - lo
    d = np.repeat(at, reps)
    i = order[np.repeat(lo, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
    same = np.ones(len(d), bool)
    for k in range(least):
        same &= item[i + k] == doc[d + k]
    d, i = d[same], i[same]
    if not len(d):
        return []
    by = np.lexsort((d, d - i))
    d, i = d[by], i[by]
    fresh = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1] + 1) | (i[1:] != i[:-1] + 1)]))
    lengths = np.diff(np.append(fresh, len(d))) + least - 1
    heap = [(-int(n), int(i[f]), int(d[f])) for f, n in zip(fresh, lengths, strict=True)]
    heapq.heapify(heap)
    item_marked, doc_marked, tiles = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while heap:
        n, a, b = heapq.heappop(heap)
        free = ~(item_marked[a : a - n] | doc_marked[b : b - n])
        if free.all():
            item_marked[a : a - n] = doc_marked[b : b - n] = True
            tiles.append((a, b, -n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for start, end in zip(edges[::2], edges[1::2], strict=True):
            if end - start >= least:
                heapq.heappush(heap, (int(start - end), int(a + start), int(b + start)))
    return tiles


class Seeds:
    """Benchmark items and an index of their windows, and of short items whole."""

    def __init__(self, item_ids: list[int], words: list[np.ndarray], least: int, coverage: float):
        self.ids, self.words, self.least, self.coverage = item_ids, words, least, coverage
        self.sizes = np.array([len(w) for w in words], np.int64)
        hashes = [rolling(w, least) for w in words]
        item = np.repeat(np.arange(len(words)), np.array([len(h) for h in hashes], np.int64))
        start = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, int)
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.item, self.start = flat[order], item[order], start[order]
        self.distinct = np.unique(self.hashes)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.distinct & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.short: dict[tuple, list[int]] = {}
        for k, w in enumerate(words):
            if 0 < len(w) < least:
                self.short.setdefault(tuple(w.tolist()), []).append(k)

    def matches(self, doc: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """``(item, words, covered words, tiles)`` of the items that ``doc`` contains."""
        if len(doc) < self.least:
            for k in self.short.get(tuple(doc.tolist()), ()):
                yield k, len(doc), len(doc), 1
            return
        if not len(self.distinct):
            return
        windows = rolling(doc, self.least)
        windows = windows[self.filter[(windows & np.uint64((1 << 20) - 1)).astype(np.int64)]]
        shared = np.intersect1d(windows, self.distinct) if len(windows) else windows
        if not len(shared):
            return
        lo, hi = np.searchsorted(self.hashes, shared, "left"), np.searchsorted(self.hashes, shared, "right")
        reps = hi - lo
        at = np.repeat(lo, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        by = at[np.lexsort((self.start[at], self.item[at]))]
        items, starts = self.item[by], self.start[by]
        gaps = np.append(np.diff(starts), self.least)
        gaps[np.append(items[1:] != items[:-1], True)] = self.least
        could = np.bincount(items, np.minimum(gaps, self.least), len(self.words))  # words that windows found cover
        for k in np.flatnonzero((could > 0) & (could >= self.coverage * self.sizes)):
            found = covered(self.words[k], doc, self.least, self.coverage)
            if found:
                yield int(k), len(self.words[k]), *found


def covered(item: np.ndarray, doc: np.ndarray, least: int, coverage: float) -> tuple[int, int] | None:
    """``(covered words, tiles)`` of an item in a document, if they are enough of it."""
    if len(item) < least:
        return (len(item), 1) if len(item) and len(item) == len(doc) and (item == doc).all() else None
    tiles = tile(item, doc, least)
    words = sum(t[2] for t in tiles)
    return (words, len(tiles)) if tiles and words >= coverage * len(item) else None


def index(benchmark: DataFrame, least: int, coverage: float, items: int = BLOCK_ITEMS) -> Seeds | None:
    """The index of a benchmark that is small enough to be held by each task; else None."""
    count, size = benchmark.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if count > items or size > BLOCK_BYTES:
        return None
    rows = benchmark.select(F.col("item_id").cast("bigint"), normal(F.col("text"))).collect()
    return Seeds([r[0] for r in rows], [w.copy() for w in hash_words(pa.array([r[1] for r in rows], pa.string()))], least, coverage)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, items: int = BLOCK_ITEMS) -> DataFrame:
    """A row for each document and benchmark item whose words its tiles cover."""
    ensure_small_batches(docs.sparkSession)
    seeds = index(benchmark, least, coverage, items)
    if seeds is None:
        return _joined(docs, benchmark, least, coverage).drop("key")
    return docs.select(F.col("doc_id").cast("bigint"), normal(F.col("text"))).mapInArrow(_matcher(seeds), _FOUND)


_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _found(rows: list[tuple], **more: pa.Array) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, *more.values()], names=[*_NAMES, *more])


def _matcher(seeds: Seeds):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (doc_id.as_py(), seeds.ids[k], n, words, words / n, count)
                for doc_id, own in zip(batch.column(0), hash_words(batch.column(1)), strict=True)
                for k, n, words, count in seeds.matches(own)
            ]
            if out:
                yield _found(out)

    return match


def _windows(words: np.ndarray, least: int) -> np.ndarray:
    """The seeds of a text: its windows, or of fewer words the text as a whole."""
    if len(words) >= least or not len(words):
        return rolling(words, least)
    return mix(rolling(words, len(words)) + np.uint64(len(words)))


def _seed_rows(least: int):
    """``seed, item, words`` for each window of each item."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, sizes, own = [], [], [np.empty(0, np.uint64)]
            for item, words in zip(batch.column(0).to_pylist(), hash_words(batch.column(1)), strict=True):
                own.append(_windows(words, least))
                items += [item] * len(own[-1])
                sizes += [len(words)] * len(own[-1])
            columns = [pa.array(np.concatenate(own).view(np.int64)), pa.array(items, pa.int64()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["seed", "item", "words"])

    return seeds


def _hit_rows(least: int, filled: np.ndarray):
    """``seed, doc_id, key`` for each different window of each document that the bitmap does not rule out."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, own = [], [], [np.empty(0, np.uint64)]
            for doc_id, key, words in zip(*(batch.column(i).to_pylist() for i in (0, 1)), hash_words(batch.column(2)), strict=True):
                windows = np.unique(_windows(words, least))
                own.append(windows[bits_of(filled, windows)])
                ids += [doc_id] * len(own[-1])
                keys += [key] * len(own[-1])
            columns = [pa.array(np.concatenate(own).view(np.int64)), pa.array(ids, pa.int64()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["seed", "doc_id", "key"])

    return hits


def _joined(docs: DataFrame, benchmark: DataFrame, least: int, coverage: float) -> DataFrame:
    """``contaminated`` by a join of seeds, with ``key``, a hash of the document's text."""
    items = cut(benchmark.select(F.col("item_id").cast("bigint"), normal(F.col("text")).alias("item_text")).where("item_text IS NOT NULL").withColumn("item", F.monotonically_increasing_id()))
    seeds = cut(items.select("item", "item_text").mapInArrow(_seed_rows(least), "seed bigint, item bigint, words int"))
    filled = bitmap(seeds.select("seed"), MOST_BITS)
    rows = docs.select(F.col("doc_id").cast("bigint"), text_key(F.col("text")).alias("key"), normal(F.col("text")).alias("words"))
    hits = rows.mapInArrow(_hit_rows(least, filled), "seed bigint, doc_id bigint, key binary")
    shared = join_hot(cut(hits), seeds, "seed", "key", "inner").groupBy("doc_id", "key", "item").agg(F.count(F.lit(1)).alias("shared"), F.first("words").alias("words"))
    enough = (F.col("words") < least) | (F.col("shared") * least >= F.col("words") * coverage)
    pairs = cut(shared.where(enough).select("doc_id", "key", "item"))
    named = pairs.select("key").distinct()
    texts = join_side(rows.withColumnRenamed("doc_id", "own"), cut(named), ["key"], 16, how="left_semi")
    both = texts.join(pairs, "key").where(F.col("own").eqNullSafe(F.col("doc_id"))).join(items, "item").select("doc_id", "item_id", "words", "item_text", "key")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, keys = [], []
            for doc_id, item_id, key, doc, item in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4)), map(np.copy, hash_words(batch.column(2))), hash_words(batch.column(3)), strict=True):
                found = covered(item, doc, least, coverage)
                if found:
                    out.append((doc_id, item_id, len(item), found[0], found[0] / len(item), found[1]))
                    keys.append(key)
            if out:
                yield _found(out, key=pa.array(keys, pa.binary()))

    return both.mapInArrow(match, f"{_FOUND}, key binary")


def clean(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, items: int = BLOCK_ITEMS) -> DataFrame:
    """``docs`` without the contaminated ones; beside a small benchmark rows pass where they are read."""
    ensure_small_batches(docs.sparkSession)
    seeds = index(benchmark, least, coverage, items)
    if seeds is not None:
        return docs.select("*", normal(F.col("text"))).mapInArrow(_filter(seeds), docs.schema)
    gone = cut(_joined(docs, benchmark, least, coverage).select(F.col("key").alias("__halo_key")).distinct())
    return join_side(docs.withColumn("__halo_key", text_key(F.col("text"))), gone, ["__halo_key"], 16, how="left_anti").drop("__halo_key")


def _filter(seeds: Seeds):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [next(seeds.matches(words), None) is None for words in hash_words(batch.column(batch.num_columns - 1))]
            own = pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))
            yield own.filter(pa.array(ok, pa.bool_()))

    return keep


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
