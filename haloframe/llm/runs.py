"""Periodic runs of words, found by uniting suffix classes in descending order of their common prefixes.

A run is a longest stretch of words with smallest period ``q`` that holds at least ``max(LEAST, 2 * q)`` words.
Adjacent suffixes of the suffix array are united, as Kruskal's algorithm does, from the longest common prefix downwards.
Each class keeps its positions in order, the smaller class moves into the larger one, and whenever two positions ``i < j``
become neighbours at prefix length ``m`` with ``j - i <= m``, the words from ``i`` on have period ``j - i`` for ``j - i + m`` words.
Neighbours make that period the smallest one, and a run's first position and the one a period later do meet as neighbours
(the period, being primitive, does not occur between them), so the pairs that no word before them extends are the runs, once each.

A run's two first positions share at least ``LEAST / 2`` words, so texts in which no such window recurs have no run and need
no suffix array, and prefixes shorter than that unite nothing.

Rows are independent: nothing is shuffled, and a lost task is simply run again.  A null or empty text has no words and no runs.
A row with a null id is never rewritten.  Repeated rows give the same result each.  Texts of any length are used whole.  Of
runs of equal length the first (then the one of smaller period) is the longest.  Columns besides ``doc_id`` and ``text`` are
not read.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haloframe.llm.common import ensure_small_batches
from haloframe.llm.words import mix, windows

LEAST = 12
#: Positions in a part of an ordered set; a part of twice as many is halved.
PART = 512

SCHEMA = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)


class Positions:
    """An ordered set of positions in short parts, so that an insertion moves few of them."""

    __slots__ = ("firsts", "parts", "size")

    def __init__(self, position: int):
        self.firsts, self.parts, self.size = [position], [[position]], 1

    def insert(self, x: int) -> tuple[int | None, int | None]:
        """Adds ``x`` and returns its neighbours."""
        k = max(0, bisect_right(self.firsts, x) - 1)
        part = self.parts[k]
        at = bisect_left(part, x)
        before = part[at - 1] if at else self.parts[k - 1][-1] if k else None
        after = part[at] if at < len(part) else self.parts[k + 1][0] if k + 1 < len(self.parts) else None
        part.insert(at, x)
        self.size += 1
        if not at:
            self.firsts[k] = x
        if len(part) > 2 * PART:
            self.parts[k : k + 1] = [part[:PART], part[PART:]]
            self.firsts.insert(k + 1, part[PART])
        return before, after


def suffix_order(ids: np.ndarray) -> np.ndarray:
    """The suffix array by doubling: ranks of twice as many words from ranks of two halves."""
    n, width = len(ids), 1
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    while True:
        beyond = np.full(n, 0, np.int64)
        beyond[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + beyond
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, np.int64)
        fresh[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(fresh) - 1
        width *= 2
        if fresh.all() or width >= n:
            return order


def common_prefixes(ids: list[int], order: list[int]) -> list[int]:
    """Words that each suffix of ``order`` shares with the one before it (the first: 0)."""
    n, shared = len(ids), 0
    rank, prefixes = [0] * n, [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    for i in range(n):
        r = rank[i]
        if not r:
            shared = 0
            continue
        j = order[r - 1]
        most = n - max(i, j)
        while shared < most and ids[i + shared] == ids[j + shared]:
            shared += 1
        prefixes[r] = shared
        if shared:
            shared -= 1
    return prefixes


def find_runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of the words ``ids`` (equal words, equal ids), by start, then period."""
    half = (least + 1) // 2
    n = len(ids)
    if n < least or n < 2 * half - 1:
        return []
    seeds = np.sort(windows(mix(ids.astype(np.uint64)), half))
    if not (seeds[1:] == seeds[:-1]).any():
        return []
    order = suffix_order(ids)
    words, places = ids.tolist(), order.tolist()
    prefixes = np.array(common_prefixes(words, places), np.int64)
    ranks = np.flatnonzero(prefixes >= half)
    ranks = ranks[np.argsort(-prefixes[ranks], kind="stable")]
    parent, sets, found = {}, {}, []

    def root(i: int) -> int:
        while (up := parent.get(i, i)) != i:
            parent[i] = i = parent.get(up, up)
        return i

    for r, m in zip(ranks.tolist(), prefixes[ranks].tolist(), strict=True):
        a, b = root(places[r - 1]), root(places[r])
        larger, smaller = sets.pop(a, None) or Positions(a), sets.pop(b, None) or Positions(b)
        if larger.size < smaller.size:
            a, b, larger, smaller = b, a, smaller, larger
        parent[b], sets[a] = a, larger
        own, before_it = [x for part in smaller.parts for x in part], None
        for x, next_ in zip(own, [*own[1:], n], strict=True):
            before, after = larger.insert(x)
            # Neighbours from one class have met before, at a longer prefix; those with a position to come between do not meet.
            met = [(before, x)] if before is not None and before != before_it else []
            if after is not None and after < next_:
                met.append((x, after))
            for i, j in met:
                if j - i <= m and j - i + m >= least and not (i and words[i - 1] == words[j - 1]):
                    found.append((i, j - i + m, j - i))
            before_it = x
    return sorted(found, key=lambda run: (run[0], run[2]))


def periodic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, in one of ten texts (told by the id's checksum) with a periodic rest."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    at = np.array(runs, np.int64)
    np.add.at(depth, at[:, 0] + at[:, 2], 1)
    np.add.at(depth, at[:, 0] + at[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()
    return [words[k] for k in kept]


def _digest(words: list[bytes]) -> tuple:
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    runs = find_runs(ids)
    best = min(runs, key=lambda run: (-run[1], run[0], run[2]), default=(None, None, None))
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (
        len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest(),
    )


def run_digests(docs: DataFrame, rewrite: bool = False) -> DataFrame:
    """One row a document: number of runs, the longest one, digests of all runs and of the text without repetitions."""
    ensure_small_batches(docs.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for doc_id, text in zip(ids, batch.column(1).cast(pa.large_binary()), strict=True):
                words = (text.as_py() or b"").split()  # bytes are split at 0x20 and 0x09 to 0x0D only
                rows.append((doc_id, *_digest(periodic(words, doc_id) if rewrite else words)))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(digest, SCHEMA)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return run_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), rewrite=True)
