"""Ranked search against a brute force over all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from haloframe.llm import ranking

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _brute(docs, items, top=10):
    own = [(d, Counter(_terms(t)), len(_terms(t))) for d, t in docs if _terms(t)]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    found = []
    for item, text in items:
        scored = []
        for d, counts, n in own:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in _terms(text) if t in counts)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        found += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:top])]
    return sorted(found, key=str)


def _got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_bytes,lot_postings", [(ranking.BLOCK_BYTES, ranking.LOT), (700, 1)])
def test_whole_tables(spark, block_bytes, lot_postings):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = ranking.search(docs, items, block_bytes=block_bytes, lot_postings=lot_postings)
    assert _got(got) == _brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])


def test_odd_rows(spark):
    words = "Ein groß Haus, a big HOUSE; x1 42 maison_é 家 "
    docs = [(k, " ".join(words.split()[: k % 9 + 1]) * (k % 3 + 1)) for k in range(40)]
    docs += [(3, docs[3][1]), (None, words), (None, words), (50, None), (51, ""), (52, "--- !!"), (53, words), (54, words * 30_000)]
    items = [(0, words), (1, "haus haus GROß"), (1, "big"), (None, "42 x1"), (2, None), (3, ""), (4, "unknown"), (5, "家 " * 3)]
    wide = spark.createDataFrame([(d, t, 0, "n", 1) for d, t in docs], "doc_id long, text string, n int, terms string, score int")
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    assert _got(ranking.search(wide, asked)) == _brute(docs, items)
    assert _got(ranking.search(wide, asked, top=3, lot_postings=5)) == _brute(docs, items, 3)
    assert ranking.search(wide.limit(0), asked).count() == 0 and ranking.search(wide, asked.limit(0)).count() == 0
    assert ranking.search(wide.where("doc_id = 52"), asked).count() == 0


def test_search_ends_before_the_lists_do():
    """Documents with both terms lead both lists, so the bound falls below the best score early; the rest is not scored."""
    n = 20_000
    starts = np.concatenate([[0], np.cumsum(np.where(np.arange(n) < 50, 2, 1))])
    terms = np.concatenate([np.tile([0, 1], 50), np.arange(n - 50) % 2])
    added = np.concatenate([np.full(100, 1000), np.linspace(600, 1, n - 50).astype(np.int64)])
    lists, best, scored = ranking.Lists(starts, terms, added, 2), ranking.Best(10), []

    def better(rows, scores):
        scored.extend(rows.tolist())
        best.add(scores, rows, np.zeros(len(rows), bool))

    lists.search(ranking.Query(0, np.array([0, 1]), np.array([1, 1])), better, best.least)
    assert best.ids.tolist() == list(range(10)) and best.scores.tolist() == [2000] * 10 and len(scored) < 500 and (lists.place == -1).all()


def test_best_positions_go_beyond_the_depth_read():
    """A list whose head is known from direct accesses has its best position behind what was read of it."""
    # Documents 0 to 31 lead list 0 in this order and list 1 in the reverse one: 16 entries of each show all 32.
    starts = np.arange(0, 2 * 33, 2)
    terms, order = np.tile([0, 1], 32), np.arange(32)
    added = np.stack([100 - order, 69 + order], 1).ravel()
    rounds = []
    ranking.Lists(starts, terms, added, 2).search(ranking.Query(0, np.array([0, 1]), np.array([1, 1])), lambda rows, scores: rounds.append(len(rows)), lambda: 0)
    assert rounds == [32]
