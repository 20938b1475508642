"""Ranked lexical search of a query set over all documents, by best positions in impact lists.

The first pass counts the queries' terms in every document.  Statistics of the whole corpus follow from that table.  The second
pass lays the documents of each task, some at a time, out as one list a term, in descending order of impact, and searches each
query there: all its lists are read down together, each document met is scored whole by direct accesses, which also tell its
position in every list.  A list's best position is the end of its unbroken run of seen positions.  A document not yet seen lies
beyond all best positions, so the impacts there add up to a bound of its score; the search ends when that bound is strictly below
the k-th score, so that ties are still told by id.  The k-th score carries over from one lot of a task to the next.  Each task
returns its best ``k`` a query, which are merged in two levels.

Queries are taken in blocks of ``BLOCK_BYTES`` of text, each a pass over the documents; one query is the least block.
Neither pass shuffles documents, and a task holds ``LOT`` postings (or one document), whatever its terms' frequencies.

A null text has no terms and a document without terms is not counted.  Each row is a document of its own: rows sharing an id
are ranked one by one, a null id behind all others of its score.  A query row is a query of its own too, ranked from 1; one
without known terms has no result.  Other columns are not read.  Empty tables give an empty result.  Terms are told by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haloframe.llm.common import cut, ensure_small_batches
from haloframe.llm.words import hash_words

TOP = 10
BLOCK_BYTES = 4 << 20
LOT = 1 << 20
#: Entries of each list that the first round reads; every further round doubles the depth.
DEPTH = 16
MERGE_SALTS = 64

_POSTINGS = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
_HITS = "query int, item_id bigint, doc_id bigint, score bigint"

#: Bytes as they are within terms (ASCII letters and digits, all of other scripts), a blank for the others.
_KEPT = np.arange(256, dtype=np.uint8)
_KEPT[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


def hash_terms(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the hashes of its terms in order; only A-Z are lower-cased."""
    texts = texts.cast(pa.large_string())
    valid, offsets, body = texts.buffers()
    kept = pa.py_buffer(_KEPT[np.frombuffer(body, np.uint8)]) if body is not None else None
    return hash_words(pa.Array.from_buffers(pa.large_string(), len(texts), [valid, offsets, kept], offset=texts.offset))


class Query(NamedTuple):
    item_id: int | None
    terms: np.ndarray  # numbers of distinct terms
    times: np.ndarray  # how often each stands in the query


def query_block(rows: list[tuple[int | None, str | None]]) -> tuple[np.ndarray, list[Query]]:
    """The sorted hashes of all terms, and the queries with terms as numbers in there."""
    hashed = list(hash_terms(pa.array([text for _, text in rows], pa.string())))
    known = np.unique(np.concatenate([*hashed, np.empty(0, np.uint64)]))
    queries = []
    for (item_id, _), own in zip(rows, hashed, strict=True):
        terms, times = np.unique(np.searchsorted(known, own), return_counts=True)
        queries.append(Query(item_id, terms, times))
    return known, queries


def postings(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """A row for each document with terms: their number, and the known ones with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        size = np.int64(max(1, len(vocabulary)))
        for batch in batches:
            own = list(hash_terms(batch.column(1)))
            lengths = np.array([len(h) for h in own], np.int64)
            keys = []
            for k, hashes in enumerate(own):
                at = np.minimum(np.searchsorted(vocabulary, hashes), size - 1)
                hit = at[vocabulary[at] == hashes] if len(vocabulary) else at[:0]
                keys.append(k * size + hit)
            pairs, counts = np.unique(np.concatenate([*keys, np.empty(0, np.int64)]), return_counts=True)
            offsets = pa.array(np.searchsorted(pairs, np.arange(len(own) + 1) * size).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (pairs % size, counts)]
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths), *lists], names=["doc_id", "n", "terms", "counts"])
            yield made.filter(pa.array(lengths > 0))

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(count, _POSTINGS)


class Corpus(NamedTuple):
    documents: int
    terms: int
    weights: np.ndarray  # of each known term


def statistics(counted: DataFrame, known: int) -> Corpus:
    """Over all documents; a row for each known term reaches the driver."""
    total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    documents = int(total[0])
    weights = np.zeros(known, np.int64)
    for term, holding in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))
    return Corpus(documents, int(total[1]), weights)


def impacts(terms: np.ndarray, counts: np.ndarray, n: np.ndarray, corpus: Corpus) -> np.ndarray:
    """What each posting adds to the score of its document (``n``: terms of that document)."""
    m = 25 + (75 * n * corpus.documents) // corpus.terms
    return corpus.weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m))


class Lists:
    """The documents of one lot as impact lists, which also give direct access by document."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, added: np.ndarray, known: int):
        self.starts, self.terms, self.added = starts, terms, added  # in order of documents
        order = np.lexsort((-added, terms))
        sizes = np.bincount(terms, minlength=known)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.position = np.empty(len(terms), np.int64)
        self.position[order] = np.arange(len(terms)) - self.first[terms[order]]
        self.document = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[order]
        self.impact = added[order]
        self.place = np.full(known, -1, np.int64)  # of a term among those of the query at hand

    def search(self, query: Query, better, kth) -> None:
        """Hands documents and scores to ``better`` until none unseen can reach ``kth()``."""
        at = self.first[query.terms]
        sizes = self.first[query.terms + 1] - at
        used = sizes > 0
        terms, times, at, sizes = query.terms[used], query.times[used], at[used], sizes[used]
        if not len(terms):
            return
        self.place[terms] = np.arange(len(terms))
        base = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]  # a list's end is never seen
        seen = np.zeros(int((sizes + 1).sum()), bool)
        met = np.zeros(len(self.starts) - 1, bool)
        best, depth = np.zeros(len(terms), np.int64), 0
        try:
            while True:
                upto = max(DEPTH, 2 * depth)
                rows = np.concatenate([self.document[a + min(depth, s) : a + min(upto, s)] for a, s in zip(at.tolist(), sizes.tolist(), strict=True)])
                depth = upto
                fresh = np.unique(rows[~met[rows]])
                met[fresh] = True
                counts = self.starts[fresh + 1] - self.starts[fresh]
                ends = np.cumsum(counts)
                flat = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[fresh] - (ends - counts), counts)
                place = self.place[self.terms[flat]]
                own = place >= 0
                sums = np.concatenate([[0], np.cumsum(np.where(own, self.added[flat] * times[place], 0))])
                better(fresh, sums[ends] - sums[ends - counts])
                seen[base[place[own]] + self.position[flat[own]]] = True
                for k, (b, s) in enumerate(zip(base.tolist(), sizes.tolist(), strict=True)):
                    if best[k] < s:
                        best[k] += int(np.argmin(seen[b + best[k] : b + s + 1]))
                left = best < sizes
                if not left.any() or int((times * self.impact[at + best - 1])[left].sum()) < kth():
                    return
        finally:
            self.place[terms] = -1


class Best:
    """The best ``top`` documents of a query so far, by score, then id (a null one last)."""

    __slots__ = ("ids", "none", "scores", "top")

    def __init__(self, top: int):
        self.top, self.scores, self.ids, self.none = top, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        fit = scores >= max(1, self.least())
        if fit.any():
            scores, ids, none = (np.concatenate(pair) for pair in ((self.scores, scores[fit]), (self.ids, ids[fit]), (self.none, none[fit])))
            order = np.lexsort((ids, none, -scores))[: self.top]
            self.scores, self.ids, self.none = scores[order], ids[order], none[order]

    def least(self) -> int:
        """The last score, once there are ``top``; before, nothing is too low."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 0


def best_of_tasks(counted: DataFrame, queries: list[Query], corpus: Corpus, top: int = TOP, lot_postings: int = LOT) -> DataFrame:
    """``(query, item_id, doc_id, score)``: the best ``top`` documents of each query in each task."""
    shared = counted.sparkSession.sparkContext.broadcast((queries, corpus))

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, postings_held = [], 0
        for batch in batches:
            for at in range(0, len(batch), 256):  # a batch may be larger than a lot
                part = batch.slice(at, 256)
                held.append(part)
                postings_held += part.column(2).value_lengths().to_numpy().sum()
                if postings_held >= lot_postings:
                    yield pa.Table.from_batches(held)
                    held, postings_held = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, corpus = shared.value
        best = [Best(top) for _ in queries]
        for lot in lots(batches):
            lot = lot.combine_chunks()
            ids = lot.column(0).combine_chunks()
            none = np.asarray(ids.is_null())
            ids = ids.fill_null(0).to_numpy()
            sizes = lot.column(2).combine_chunks().value_lengths().to_numpy()
            terms, counts = (lot.column(k).combine_chunks().flatten().to_numpy().astype(np.int64) for k in (2, 3))
            added = impacts(terms, counts, np.repeat(lot.column(1).to_numpy(), sizes), corpus)
            lists = Lists(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), terms, added, len(corpus.weights))
            for query, own in zip(queries, best, strict=True):
                lists.search(query, lambda rows, scores, own=own: own.add(scores, ids[rows], none[rows]), own.least)
        for k, (query, own) in enumerate(zip(queries, best, strict=True)):
            if n := len(own.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * n, pa.int32()), pa.array([query.item_id] * n, pa.int64()), pa.array(own.ids, mask=own.none), pa.array(own.scores)],
                    names=["query", "item_id", "doc_id", "score"],
                )

    return counted.mapInArrow(search, _HITS)


def ranked(hits: DataFrame, top: int = TOP) -> DataFrame:
    """The best ``top`` of each query, first within salts of the ids, then among those."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = Window.partitionBy("query", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_SALTS))).orderBy(*order)
    whole = Window.partitionBy("query").orderBy(*order)
    some = hits.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES, lot_postings: int = LOT) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each row of ``items`` the best documents, of all rows of ``docs``."""
    spark = docs.sparkSession
    ensure_small_batches(spark)
    items = items.select(F.col("item_id").cast("bigint"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, found = -(-size // block_bytes), spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        known, queries = query_block([tuple(r) for r in rows])
        counted = cut(postings(docs, known))
        corpus = statistics(counted, len(known))
        if corpus.documents:
            found = found.unionByName(ranked(best_of_tasks(counted, queries, corpus, top, lot_postings), top))
    return found


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
