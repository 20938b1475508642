"""Periodic runs against a search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from haloframe.llm import runs

SF = "/root/testdata/sf0.001"


def _brute(w, least=12):
    n, found = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] == w[i + q]:
                j = i
                while j + q < n and w[j] == w[j + q]:
                    j += 1
                size = j - i + q
                if size >= max(least, 2 * q) and not any(all(w[i + k] == w[i + k + p] for k in range(size - p)) for p in range(1, q)):
                    found.add((i, size, q))
                i = j
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def _expected(doc_id, text, rewrite=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if rewrite and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = _brute(w)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
    kept = [x for k, x in enumerate(w) if not any(s + q <= k < s + m for s, m, q in found)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(kept)))


@pytest.mark.parametrize("least", [2, 4, 7, 12])
def test_random_words(least):
    rng = random.Random(least)
    for _ in range(1500):
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 50))]
        if w and rng.random() < 0.5:
            s, p = rng.randrange(len(w)), rng.randint(1, 1 + len(w) // 3)
            w = w[:s] + [w[min(len(w) - 1, s + i % p)] for i in range(len(w) - s)]
        assert runs.find_runs(np.array(w, np.int64), least) == _brute(w, least)


def test_long_words():
    for size, period in ((150_000, 1), (150_000, 1_000), (150_001, 75_000)):
        assert runs.find_runs(np.arange(size) % period) == [(0, size, period)]
    assert runs.find_runs(np.arange(150_000)) == []
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert runs.find_runs(np.array(b)) == _brute(b)


def test_positions_keep_their_order():
    rng, own, seen = random.Random(3), runs.Positions(500), [500]
    for x in rng.sample([k for k in range(5000) if k != 500], 4000):
        below, above = [s for s in seen if s < x], [s for s in seen if s > x]
        assert own.insert(x) == (max(below, default=None), min(above, default=None))
        seen.append(x)
    assert [x for part in own.parts for x in part] == sorted(seen) and own.firsts == [part[0] for part in own.parts] and own.size == len(seen)


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in runs.op13_periodic_runs(spark, SF).collect())
    assert got == sorted(_expected(d, t) for d, t in docs)


def test_odd_rows(spark):
    line = "so it goes on and on "
    rows = [(1, None), (2, ""), (3, " \t\n\v\f\r "), (4, line * 4), (4, line * 4), (None, line * 3 + "end"), (5, "a b  " * 12), (6, "x " * 12), (7, "X x " * 5), (None, None), (8, "x " * 11)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, start int, length int")
    for rewrite in (False, True):
        got = sorted((tuple(r) for r in runs.run_digests(docs, rewrite).collect()), key=str)
        assert got == sorted((_expected(d, t, rewrite) for d, t in rows), key=str)
    assert runs.run_digests(docs.limit(0)).count() == 0
