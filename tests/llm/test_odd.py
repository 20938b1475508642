"""Very long texts, empty tables, repeated rows, ties, nulls and clashing columns at each operator."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from haloframe.llm import bpe, chat, fingerprints, html, jaccard, lines, packing, quality, sharding, tiling, urls, words

DOCS = "doc_id long, text string"
#: Over 256 KiB and over 1 MiB.
LONG = [" ".join(f"w{k % 9973}x{k % 7}" for k in range(n)) for n in (45_000, 180_000)]
WIDE = "text2 string, doc int, node int, key int, salt int, shard int, count int, host int, item_id int, score int, quality int, piece int, length int"


@pytest.fixture(scope="module")
def long_docs(spark):
    rows = [(1, LONG[0]), (2, LONG[1]), (3, LONG[1]), (4, LONG[0] + " more"), (5, None), (6, ""), (None, "short one of a few words")]
    return spark.createDataFrame(rows, DOCS)


def _wide(df):
    """The frame with columns whose names the operators use themselves."""
    names = [c.split()[0] for c in WIDE.split(", ")]
    return df.select("*", *[F.lit(None).cast("int").alias(c) for c in names if c not in df.columns])


def test_slices_of_long_texts_agree():
    whole = [w for t in LONG for w in t.split()]
    got = [int(x) for own in words.hash_words(pa.array(LONG)) for x in own]
    one = {w: int(next(words.hash_words(pa.array([w])))[0]) for w in set(whole)}
    assert got == [one[w] for w in whole]
    run = "y" * (3 * words.SLICE)
    assert len(next(words.hash_words(pa.array([f"a {run} b"])))) == 3


def test_chat_of_long_and_repeated_turns(spark):
    paths, text = bpe.default_paths(), LONG[1] + "</s>[INST]"
    rows = [(1, 0, "assistant", text), (1, 0, "assistant", text), (2, 0, "user", "tie"), (2, 0, "user", "tie"), (2, 0, "assistant", "a")]
    chats = _wide(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(chat.format_chats(chats))).collect()}
    assert got[1]["n_turns"] == 2 and got[1]["loss_chars"] == 2 * len(text)
    assert got[1]["turns_sha256"] == hashlib.sha256(f"assistant\n{text}\n".encode() * 2).hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"assistant\na\nuser\ntie\nuser\ntie\n").hexdigest()
    assert bpe.decode(bpe.encode(text, paths), paths) == text


def test_sharding(spark, tmp_path, long_docs):
    _wide(long_docs.union(long_docs)).write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op2_sharding(spark, str(tmp_path)).collect()
    assert len(got) == 14 and sum(r["size"] for r in got) == 2 * (2 * len(LONG[0]) + 5 + 2 * len(LONG[1]) + len("short one of a few words") + 7)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    long_docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert sharding.op2_sharding(spark, f"{tmp_path}/none").count() == 0


def test_decontamination(spark, long_docs):
    bench = _wide(spark.createDataFrame([(1, LONG[0][:400]), (2, LONG[1][-3000:]), (2, LONG[1][-3000:])], "item_id long, text string"))
    got = sorted((r["doc_id"], r["item_id"]) for r in tiling.contaminated(_wide(long_docs), bench).collect())
    # Words repeat after 69,811, so the shorter text holds the end of the longer one too; an item row that is given twice counts twice.
    assert got == [(k, i) for k in (1, 2, 3, 4) for i in (1, 2, 2)]
    assert tiling.contaminated(long_docs.limit(0), bench).count() == 0
    assert {r["doc_id"] for r in tiling.clean(long_docs, bench).collect()} == {5, 6, None}


def test_urls(spark):
    rows = [(1, "http://a.com/x", "<p>" + LONG[1] + '<link rel="canonical" href="http://z.net/q">'), (1, "http://a.com/x", None), (None, None, None)]
    pages = _wide(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert [r["verdict"] for r in urls.judge(pages, urls.links_of(pages)).orderBy("page_id").collect()] == ["allow", "block", "block"]
    assert urls.judge(pages.limit(0), urls.links_of(pages.limit(0))).count() == 0


def test_lines(spark, long_docs):
    got = {r["doc_id"]: r["text"] for r in lines.dedup(_wide(long_docs)).collect()}
    assert got[2] == LONG[1] and got[3] == "" and got[5] is None and got[6] == ""
    assert lines.dedup(_wide(long_docs)).columns[:-1] == _wide(long_docs).columns
    assert lines.dedup(long_docs.limit(0)).count() == 0


def test_fingerprints(spark, tmp_path):
    rows = [(1, LONG[0]), (1, LONG[0]), (2, LONG[0]), (3, LONG[1])]
    _wide(spark.createDataFrame(rows, DOCS)).write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprints.op6_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == 4 and len({r["fingerprint"] for r in got if r["doc_id"] < 3}) == 1
    assert all(r["near_next"] == 1.0 for r in got if r["doc_id"] == 1)
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert fingerprints.op6_fingerprints(spark, f"{tmp_path}/none").count() == 0


def test_quality(spark, long_docs):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 200)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    docs = _wide(long_docs.union(spark.createDataFrame([(k, f"good word {k}" if k % 2 else f"BAD!! {k}") for k in range(7, 200)], DOCS)))
    model = quality.fit(docs, labels)
    got = quality.scores(docs, model).collect()
    assert len(got) == docs.count() and len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1 and len({r["score"] for r in got if r["doc_id"] in (5, 6)}) == 1
    assert quality.keep(docs, model).columns == docs.columns
    few = quality.fit(docs, labels, fit_slots=60_000)
    assert few.weights.any() and quality.scores(docs.limit(0), few).count() == 0
    assert not quality.fit(docs, labels.limit(0)).weights.any()


def test_html(spark):
    page = "<body><article><p>{}</p></article></body>".format
    rows = [(1, "http://a.com/1", page(LONG[1])), (1, "http://a.com/1", page(LONG[1])), (1, "http://a.com/2", page("tie")), (2, "http://b.com", None), (None, None, page("no url"))]
    pages = _wide(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted((str(r["page_id"]), len(r["text"])) for r in html.extract(pages).collect())
    assert got == [("1", 3), ("1", len(LONG[1])), ("1", len(LONG[1])), ("2", 0), ("None", 6)]
    assert html.extract(pages.limit(0)).count() == 0


def test_packing(spark, long_docs):
    paths = bpe.default_paths()
    got = packing.packed(_wide(long_docs)).collect()
    lengths = {}
    for r in got:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths[2] == lengths[3] == len(bpe.encode(LONG[1], paths)) + 1 and lengths[5] == lengths[6] == 1
    assert packing.packed(long_docs.limit(0)).count() == 0


def test_jaccard(spark, long_docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(_wide(long_docs)).collect()}
    assert got[3][1] == 2 and got[4][1] == 1 and got[1][1] == 1 and got[2][1] == 2 and got[5] == (0, 5) and got[None] == (2, None)
    own = LONG[1].split()
    assert got[2][0] == len({tuple(own[k : k + 5]) for k in range(len(own) - 4)})
