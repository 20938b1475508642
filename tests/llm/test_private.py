"""Personal data: the stated patterns against ``re``, the fitted model against plain loops, and what the method adds."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from haloframe.llm import private

SF = "/root/testdata/sf0.001"
BASE = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def _luhn(digits):
    doubled = [int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def _base(text):
    found = []
    for k, pattern in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (True, k != 1 or all(int(x) <= 255 for x in m[0].split(".")), k != 2 or 12 <= len(digits) <= 19 and _luhn(digits), k != 3 or 9 <= len(digits) <= 15)[k]
            if ok:
                found.append((m.start(), k, m.end()))
    return [f"{private.KINDS[k]}:{a}:{z}" for a, k, z in sorted(found)]


def _check(rows, got):
    """``got`` of distinct texts: base spans, counts and digests."""
    for r, text in zip(got, rows, strict=True):
        own = _base(text)
        assert r["base_sha256"] == hashlib.sha256(",".join(own).encode()).hexdigest(), (text, own)
        assert [r[f"n_{k}"] for k in private.KINDS] == [sum(s.startswith(k) for s in own) for k in private.KINDS]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(own) <= set(spans) and spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), private.KINDS.index(s.split(":")[0])))
        for kind, a, z in (s.split(":") for s in set(spans) - set(own)):
            assert all(int(z) <= int(s.split(":")[1]) or int(a) >= int(s.split(":")[2]) for s in own)


def _run(spark, folder, texts):
    docs = spark.createDataFrame([(k, t, 0, 0) for k, t in enumerate(texts)], "doc_id long, text string, row int, kind int")
    docs.write.parquet(f"{folder}/documents.parquet")
    return sorted(private.op12_private_data(spark, str(folder)).collect(), key=lambda r: r["doc_id"])


def test_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = sorted(private.op12_private_data(spark, SF).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in got] == sorted(docs)
    _check([docs[k] for k in sorted(docs)], got)
    assert all(r["spans"] == "" for r in got if not re.search("[0-9@]", docs[r["doc_id"]] or ""))


def test_patterns_at_their_edges(spark, tmp_path):
    rng = random.Random(4)
    made = ["".join(rng.choice(["1", "25", "256", "0", ".", "..", " ", "-", "+", "(", ")", "@", "a", "B.c", "é", "家", "_", "%", "4111", "1111", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(600)]
    edges = [
        "a@b.c_d@e.f", "a@b.c@d.e", "x.y@z", "@a.b", "a@-.-", "..@a.b..c", "é1@ü.de a@b.c-.d", "1.2.3.4.5.6.7.8", "300.1.1.1", "1.1.1.256", "0001.002.0003.04", f"{'9' * 400}.1.1.1",
        "4111 1111 1111 1111", "4111-1111 1111-1111", "4111  1111", "41111111111111112", "0" * 12, "0" * 11, "0" * 19, "0" * 20, "+1 (555) 555-1234", "+1555", "+1 ( 2", "++12 345 678 9", "+12345678 9012345 6", None, "", "a@b.c" * 50,
    ]
    got = _run(spark, tmp_path, made + edges)
    _check(made + edges, got)


def test_odd_rows(spark, tmp_path):
    digits = "9" * 300_000
    rows = [(1, "mail a@b.org"), (1, "mail a@b.org"), (None, "10.0.0.1"), (2, None), (3, "word " * 60_000 + "me@x.org"), (4, digits), (5, "a" * 300_000 + "@"), (6, "." * 300_000), (7, "1 " * 100_000), (8, "+" + "1 " * 100_000), (9, "a@b" + ".c" * 100_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r["doc_id"] or 0, r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in private.op12_private_data(spark, str(tmp_path)).collect()))
    assert got == [(0, 0, 1, 0, 0), (1, 1, 0, 0, 0), (1, 1, 0, 0, 0), (2, 0, 0, 0, 0), (3, 1, 0, 0, 0), *[(k, 0, 0, 0, 0) for k in (4, 5, 6, 7, 8)], (9, 1, 0, 0, 0)]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert private.op12_private_data(spark, f"{tmp_path}/none").count() == 0


def test_what_the_method_adds(spark, tmp_path):
    """Swallowed, written-out and unmarked data are found; numbers that only look alike, and clean texts, are left alone."""
    card, other = "4539578763621486", "5500005555555559"
    assert _luhn(card) and _luhn(other)
    texts = [f"say number {k} to {card} then +1 (555) 010-{1000 + k} or u{k}@mail.example.com from 10.1.{k}.9 end" for k in range(60)]
    texts += [f"two of them {card} {other} here", "call +1 (555) 010-2000 10.9.8.7 now", "write to jane.doe [at] mail.example.org today", "order 4539578763621487 done", "nothing here but words", "version 1.2.3 of 2024", 'token = "4539578763621486ab"']
    got = [r["spans"].split(",") if r["spans"] else [] for r in _run(spark, tmp_path, texts)][60:]
    named = [[(s.split(":")[0], t[int(s.split(":")[1]) : int(s.split(":")[2])]) for s in spans] for spans, t in zip(got, texts[60:], strict=True)]
    assert named[0] == [("card", card), ("card", other)]
    assert named[1] == [("phone", "+1 (555) 010-2000"), ("ip", "10.9.8.7")]
    assert named[2] == [("email", "jane.doe [at] mail.example.org")]
    assert named[3:6] == [[], [], []]


def _sigmoid(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def test_model_against_plain_loops(spark):
    rng = random.Random(6)
    rows = []
    for k in range(60):
        true = k % 3 > 0
        votes = [rng.choices([0, 1, 2], [1, 6, 1] if true else [1, 1, 6])[0] for _ in range(private.LABELERS)]
        rows.append((2, *votes, rng.randrange(64) * 2 + 1 | (128 if true else 0), rng.randint(1, 50)))
    merged = {}
    for *key, n in rows:
        merged[tuple(key)] = merged.get(tuple(key), 0) + n
    counts = spark.createDataFrame([(*k, n) for k, n in merged.items()], "kind int, " + ", ".join(f"v{k} int" for k in range(private.LABELERS)) + ", bits int, n long")
    got = private.model(counts).first()
    rates, prior = [[0.0, 1.0, -1.0] for _ in range(private.LABELERS)], 0.0
    own = [(k[1:-1], k[-1], n) for k, n in merged.items()]
    for _ in range(private.EM_ROUNDS):
        p = [_sigmoid(prior + sum(rates[i][v] for i, v in enumerate(votes))) for votes, _, _ in own]
        t, f = sum(n * x for (_, _, n), x in zip(own, p, strict=True)), sum(n * (1 - x) for (_, _, n), x in zip(own, p, strict=True))
        rates = [[math.log((sum(n * x for (v, _, n), x in zip(own, p, strict=True) if v[i] == c) + 1) / (t + 3)) - math.log((sum(n * (1 - x) for (v, _, n), x in zip(own, p, strict=True) if v[i] == c) + 1) / (f + 3)) for c in range(3)] for i in range(private.LABELERS)]
        prior = math.log((t + 1) / (f + 1))
    assert got["kind"] == 2 and got["rates"][-1][0] == pytest.approx(prior) and all(got["rates"][i] == pytest.approx(rates[i]) for i in range(private.LABELERS))
    y = [_sigmoid(prior + sum(rates[i][v] for i, v in enumerate(votes))) for votes, _, _ in own]
    x = [[bits >> k & 1 for k in range(private.FEATURES)] for _, bits, _ in own]
    # At the weights, the penalised loss is near its least value: its slope is small against that at zero.
    slope = lambda w: [sum(n * (c - _sigmoid(sum(a * b for a, b in zip(w, row, strict=True)))) * row[k] for (_, _, n), c, row in zip(own, y, x, strict=True)) - w[k] for k in range(private.FEATURES)]
    size = lambda g: math.sqrt(sum(a * a for a in g))
    assert size(slope(got["weights"])) < 0.02 * size(slope([0.0] * private.FEATURES))
    scored = spark.createDataFrame([(b,) for _, b, _ in own], "bits int").select(private.score(private.features(F.col("bits")), F.array(*map(F.lit, got["weights"]))).alias("p"))
    assert [r["p"] for r in scored.collect()] == pytest.approx([_sigmoid(sum(a * b for a, b in zip(got["weights"], row, strict=True))) for row in x])
