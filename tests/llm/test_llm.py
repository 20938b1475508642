"""The training-data operators against brute force, round trips and odd rows."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from haloframe.llm import bpe, chat, fingerprints, html, jaccard, lines, packing, quality, sharding, tiling, urls
from haloframe.llm.common import components, join_hot, text_key
from haloframe.llm.words import hash_words, shingles

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (None, "a b c d e f g")]


@pytest.fixture(scope="session")
def paths():
    return bpe.default_paths()


def test_ids_are_the_tokenizers(paths):
    """The plain tokenizer's ids, special tokens and texts on both sides of the length for another library included."""
    from tokenizers import Tokenizer

    plain, ordinary = Tokenizer.from_file(paths[0]), Tokenizer.from_file(paths[0])
    ordinary.encode_special_tokens = True
    texts = ["", "Hello  world\n\n x", "é ñ 漢字 🙂 <|endoftext|>", "<|endoftext|> hello<|endoftext|><|endo", "a" * 3000, "don't  1234 %%%"]
    texts += [("word é<|endoftext|> " * bpe.LONG_TEXT)[: bpe.LONG_TEXT + k] for k in (0, 1)]
    for text in texts:
        assert bpe.encode(text, paths, special=True).tolist() == plain.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text, paths).tolist() == ordinary.encode(text, add_special_tokens=False).ids
        assert bpe.decode(bpe.encode(text, paths), paths) == bpe.decode(bpe.encode(text, paths, special=True), paths) == text


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "<\\/s>[/INST", ""])
def test_escape_round_trip(text, paths):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROLS)
    for role in ("user", "assistant", "[ROLE]\\"):
        ids, mask, _ = chat.assemble([(role, text)], paths)
        assert chat.parse_turn(ids, paths) == (role, text)
        assert chat.unescape(bpe.decode(ids[mask.astype(bool)], paths)) == (text if role == "assistant" else "")


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, None, None, "x"), (None, 0, "assistant", "</s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(chat.format_chats(df))).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest() and got[1]["n_turns"] == 2
    assert got[None]["loss_chars"] == 4 and got[2]["loss_chars"] == 0
    assert chat.digests(chat.read_back(chat.format_chats(df.limit(0)))).count() == 0


@pytest.mark.parametrize("seed, local", [(0, 100), (1, 0), (2, 3)])
def test_sharding_is_minimax(spark, seed, local):
    dice = random.Random(seed)
    texts = ["x" * dice.randint(0, 40) + str(dice.randint(0, 30)) for _ in range(120)] + ["hot"] * 30 + [None] * 3
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"), text_key(F.col("text")).alias("key"), (F.col("doc_id") % 4).cast("int").alias("salt")
    )
    rows = sharding.shard(df, 5, 4, local_sums=local).collect()
    assert len(rows) == len(texts)
    groups = {}
    for r in rows:
        groups.setdefault(bytes(r["key"]), []).append(r)
    sizes = [sum(r["size"] for r in groups[k]) for k in sorted(groups)]
    sums = np.cumsum(sizes).tolist()
    least = next(c for c in range(max(sizes), sum(sizes) + 1) if sharding.greedy_cuts(sums, c, 5, sums[-1]) is not None)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert max(sum(r["size"] for r in v) for v in by.values()) == least
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    assert all(len({r["shard"] for r in v}) == 1 for v in groups.values())


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (3, 1), (7, 7), (None, 2)] + [(20 + i, 21 + i) for i in range(30)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, **{20 + i: 20 for i in range(31)}}


def test_urls(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "https://a.com/en/1?x=1#f", link("http://b.example.com/de/9")),
        (2, "http://A.ORG/fr/x", '<meta http-equiv="refresh" content="0; url=https://a.com/en/1?x=1">'),
        (3, "http://m.example.net/en/1", None),
        (4, "http://q.net", None),
        (5, None, None),
        (6, "nonsense", ""),
        (7, "http://clean.com/a", link("/b")),
        (8, "http://notexample.com/de/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, urls.links_of(pages)).collect()}
    assert got[1] == ("a.com", "/en/1", None, "block")
    assert got[2] == ("a.org", "/fr/x", "org/fr/", "allow")
    assert got[3][2:] == ("example.net/en/", "allow")
    assert got[4] == ("q.net", "", None, "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7][3] == got[8][3] == "allow"


def test_line_dedup(spark):
    passage = " ".join(f"w{i}" for i in range(55)).replace("w1 ", "w ")
    own = lambda i: " ".join(f"{chr(97 + i)}{k}" for k in range(9))
    rows = [(i, f"{own(i)}\n{passage}\nPage {i} of the long report") for i in range(1, 8)]
    rows += [(100, None), (101, ""), (102, "all of this line is clean\nshort one"), (None, "nothing like it stands elsewhere")]
    got = {r["doc_id"]: r for r in lines.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert passage in got[1]["text"] and all(passage not in got[i]["text"] for i in range(2, 8))
    assert "Page 1" in got[1]["text"] and all("Page" not in got[i]["text"] and own(i) in got[i]["text"] for i in range(2, 8))
    assert got[100]["text"] is None and got[102]["text"] == rows[9][1] and got[None]["__halo_n"] == 0


def _signature_by_hand(text):
    """Order MinHash with the hashes chained as Spark's are."""
    low = (1 << 35) - 1
    hash_of = lambda data, seed=42: xxhash.xxh64(data, seed=seed).intdigest()
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    seen, kmers = {}, []
    for i in range(max(len(words) - 1, min(len(words), 1))):
        h = hash_of(words[i].encode())
        if i + 1 < len(words):
            h = hash_of(words[i + 1].encode(), h)
        h &= low
        number = seen[h] = seen.get(h, -1) + 1
        if number:
            h = hash_of(struct.pack("<i", number - 1), hash_of(struct.pack("<q", h))) & low
        kmers.append((h, i))
    out = []
    for k in range(fingerprints.BINS if kmers else 0):
        circle = [x for x in sorted(kmers) if x[0] >> 30 >= k] + [x for x in sorted(kmers) if x[0] >> 30 < k]
        seed = 42
        for h, _ in sorted(circle[: fingerprints.TUPLE], key=lambda x: x[1]):
            seed = hash_of(struct.pack("<q", h), seed)
        out.append(k << 58 | seed & ((1 << 58) - 1))
    return out


def test_fingerprints_against_brute_force(spark):
    dice = random.Random(4)
    texts = [" ".join(dice.choice(["a", "b", "c", f"w{dice.randint(0, 200)}"]) for _ in range(n)) for n in (0, 1, 2, 3, 10, 60, 400, 3000)]
    texts += ["x " * 500, "\t\n ", "é ü\x0b漢字  🙂"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", fingerprints.signature(F.col("text")).alias("s"))
    assert all(r["s"] == _signature_by_hand(r["text"]) for r in df.collect())


CLASHES = ["doc", "raw", "leaf", "key", "keep", "gone", "template", "node", "n", "component", "component_id", "n_shingles", "score", "quality", "block", "item_id", "count", "line", "ids"]


@pytest.mark.parametrize("name, left", [("quality_classifier", None), ("line_dedup", 6), ("jaccard_join", 5), ("decontamination", 6), ("packing", 6)])
def test_stages_on_odd_rows(spark, name, left):
    """Nulls, empty texts, repeated rows, clashing names and an empty table at every stage."""
    import corpus_pipeline

    rows = [(*r, None, "web", None, *[i if i % 2 else None] * len(CLASHES)) for i, r in enumerate(ODD)]
    docs = spark.createDataFrame(rows, f"{DOCS}, lang string, source string, n_chars long, {', '.join(f'{c} int' for c in CLASHES)}")
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, "/root/testdata/sf0.001")
    assert name == "packing" or got.columns == docs.columns
    assert left is None or got.count() == left
    assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def _longest_by_hand(item, doc, item_marked, doc_marked):
    """The length of the longest match of unmarked words, cell by cell."""
    best = 0
    for i in range(len(item)):
        for d in range(len(doc)):
            n = 0
            while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not item_marked[i + n] and not doc_marked[d + n]:
                n += 1
            best = max(best, n)
    return best


def test_tiling_is_greedy():
    """Each tile is as long as the longest match then left, and none of the least length stays."""
    dice = random.Random(3)
    for _ in range(60):
        letters = dice.choice([2, 4, 8])
        item = np.array([dice.randint(0, letters) for _ in range(dice.randint(0, 20))], np.uint64)
        doc = np.array([dice.randint(0, letters) for _ in range(dice.randint(0, 30))], np.uint64)
        item_marked, doc_marked = np.zeros(len(item), bool), np.zeros(len(doc), bool)
        for a, b, n in tiling.tile(item, doc, 3):
            assert n == _longest_by_hand(item, doc, item_marked, doc_marked) and (item[a : a + n] == doc[b : b + n]).all()
            assert not item_marked[a : a + n].any() and not doc_marked[b : b + n].any()
            item_marked[a : a + n] = doc_marked[b : b + n] = True
        assert _longest_by_hand(item, doc, item_marked, doc_marked) < 3


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon. zeta eta theta iota kappa! lambda mu nu xi omicron"
    moved = "Lambda mu nu xi omicron, filler ALPHA beta gamma delta epsilon more zeta eta theta iota kappa"
    rows = [(1, moved), (2, "alpha beta gamma delta and nothing else"), *[(k + 10 if k else None, t) for k, t in ODD]]
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame([(7, item), (8, None), (9, "two words")], "item_id long, text string")
    got = tiling.contaminated(docs, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["covered_words"], r["tiles"]) for r in got] == [(1, 7, 15, 3)]
    kept = tiling.clean(docs.withColumn("item_id", F.lit(0)), bench)
    assert kept.count() == docs.count() - 1 and kept.columns == ["doc_id", "text", "item_id"]
    assert tiling.contaminated(docs, bench.limit(0)).count() == 0


def test_large_benchmark_by_joined_seeds(spark):
    """A benchmark beyond one block gives the same rows, repeated rows, null ids and short items included."""
    dice = random.Random(12)
    word = lambda: f"v{dice.randint(0, 30)}"
    items = [(k, " ".join(word() for _ in range(dice.choice([1, 2, 3, 5, 12, 40])))) for k in range(60)] + [(3, "one two"), (None, "p q r s t u"), (70, None), (71, " ")]
    items.append(items[5])
    rows = [(k, " ".join(word() for _ in range(30)) + " " + ", ".join(dice.choice(items)[1] or "" for _ in range(2))) for k in range(60)]
    rows += ODD + [(None, "P Q! R s t u"), (None, "P Q! R s t u"), (90, items[0][1])]
    docs, bench = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    own, joined = (sorted(map(str, tiling.contaminated(docs, bench, items=n).collect())) for n in (1000, 0))
    assert own == joined and sum("doc_id=None" in x for x in own) == 2 and sum("doc_id=4, item_id=3, item_words=2" in x for x in own) == 2
    assert sorted(map(str, tiling.clean(docs, bench).collect())) == sorted(map(str, tiling.clean(docs, bench, items=0).collect()))


def test_fingerprints(spark, tmp_path):
    long = " ".join(f"word{i % 150}" for i in range(400))
    rows = [(1, long), (2, long), (3, None), (4, "a a a a a a"), (5, "b " * 300), (None, "x y")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in fingerprints.op6_fingerprints(spark, str(tmp_path)).collect()}
    n = len(long)
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[1]["near_next"] == 1.0
    assert got[1]["edited_sha256"] == hashlib.sha256((long[: n - n // 4] + long[: n // 4]).encode()).hexdigest()
    assert got[5]["edited_sha256"] == hashlib.sha256((("b " * 300)[:450] + long[:150]).encode()).hexdigest()
    assert got[3]["n_chars"] == 0 and got[3]["near_edited"] == 1.0 and got[3]["near_next"] == 0.0 and got[None]["near_next"] is None


def test_short_texts_tell_order(spark):
    """Sections of a short text change places: every tuple tells order, whatever the text's length."""
    words = [f"w{k}" for k in range(24)]
    df = spark.createDataFrame([(" ".join(words),), (" ".join(words[12:] + words[:12]),)], "text string").select(fingerprints.signature(F.col("text")).alias("s"))
    a, b = (set(r["s"]) for r in df.collect())
    assert len(a & b) < 0.85 * fingerprints.BINS


def test_occurrences_count(spark):
    df = spark.createDataFrame([("a b " * 5,), ("a b " * 9,)], "text string").select(fingerprints.signature(F.col("text")).alias("s"))
    few, many = (r["s"] for r in df.collect())
    assert len(few) == len(many) == fingerprints.BINS and few != many


def test_quality_on_held_out(spark):
    got = quality.op7_quality(spark, "/root/testdata/sf0.01").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    right = got.join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right >= 0.95
    model = quality.Model(np.zeros(1 << quality.BITS), np.zeros(1 << quality.BITS), 0.0, 1.0, 0.0)
    assert {r["score"] for r in quality.scores(spark.createDataFrame(ODD, DOCS), model).collect()} == {0.5}


def test_ratios_and_dual_solution():
    """Ratios against plain counts; the fit's objective against projected gradient steps on the whole dual."""
    dice = random.Random(6)
    rows = [np.array(sorted(dice.sample(range(40) if k % 2 else range(25, 60), 12)), np.int32) for k in range(80)]
    signs = np.array([1.0 if k % 2 else -1.0 for k in range(80)])
    counts = np.zeros((2, 1 << quality.BITS), np.int64)
    for r, y in zip(rows, signs, strict=True):
        counts[int(y > 0), r] += 1
    ratios = quality.log_ratios(counts.reshape(-1))
    seen = [Counter(int(x) for r, y in zip(rows, signs, strict=True) if (y > 0) == c for x in r) for c in (0, 1)]
    sums = [sum(s.values()) + (1 << quality.BITS) for s in seen]
    for x in (3, 30, 59, 70):
        assert ratios[x] == pytest.approx(np.log((seen[1][x] + 1) / sums[1]) - np.log((seen[0][x] + 1) / sums[0]))
    values = [ratios[r] / np.sqrt((ratios[r] ** 2).sum()) for r in rows]
    costs = np.full(80, 0.7)
    weights, bias = quality.descend(rows, values, signs, costs, 400)
    full = np.zeros((80, 61))
    for i, (r, v) in enumerate(zip(rows, values, strict=True)):
        full[i, r] = v
    full[:, 60] = 1.0
    gram, duals = (full @ full.T) * np.outer(signs, signs), np.zeros(80)
    step = 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(20000):
        duals = np.clip(duals - step * (gram @ duals - 1), 0, costs)

    def objective(w):
        return w @ w / 2 + (costs * np.maximum(0, 1 - signs * (full @ w))).sum()

    own = np.append(weights[:60], bias)
    assert objective(own) == pytest.approx(objective(full.T @ (duals * signs)), rel=1e-4) and not weights[60:].any()


def test_html():
    page = """<html><head><title>t</title><style>p{}</style></head><body><nav><a>menu</a></nav><div class="cookie-notice">ok?</div>
    <article><header><h1>Head &amp; more</h1></header><p>One <b>two<br>three<p>Four<script>x("</p>")</script> five<aside>side</aside>
    <form><p>mail</p></form><ul><li>item 1<li>item&nbsp;2</ul><div id="comments"><p>reader</p></div></article><footer>f</footer></body></html>"""
    root = html.parse(page)
    assert html.blocks(root, html.flat(root), set()) == ["Head & more", "One two three", "Four five", "item 1", "item 2"]
    for odd in ("", "plain", "<p", "<!-- open", "<script>never ends", "</div></div>x"):
        root = html.parse(odd)
        html.blocks(root, html.flat(root), set())


def test_wrapper_induction(spark):
    page = "<body><div><p>Shared menu text</p></div><div><p>Story {0}</p><p>Words {0} go on</p></div></body>".format
    rows = [(i, f"http://h.com/{i}", page(i)) for i in range(8)] + [(8, "http://h.com/x", None), (9, None, "<p>alone</p>")]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3\n\nWords 3 go on" and got[8] == "" and got[9] == "alone"


def test_packing(spark, paths):
    dice = random.Random(1)
    texts = [" ".join(dice.choice(["alpha", "beta", "of", "123"]) for _ in range(dice.randint(0, 900))) for _ in range(60)] + [None, "long " * 6000]
    rows = packing.packed(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    sequences, docs = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    for k, text in enumerate(texts):
        ids = [*bpe.encode(text or "", paths, special=True).tolist(), packing.END_ID]
        for _, start, length, crc in sorted(docs[k]):
            assert crc == zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))
        assert [(n, a) for n, a, _, _ in sorted(docs[k])] == list(enumerate(packing.cut_points(len(ids), packing.CAPACITY)))
        assert sum(p[2] for p in docs[k]) == len(ids)
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= 1.1 * total / packing.CAPACITY + 1


def test_packing_is_best_fit(spark):
    """The places of a plain best-fit that scans all open bins, in the packer's order."""
    dice = random.Random(8)
    rows = [(k, 0, 0, dice.choice([dice.randint(1, 100), dice.randint(60, 100), 100]), k) for k in range(400)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = {r["doc_id"]: (r["sequence_id"], r["offset"]) for r in packing.place(parts, 100, 6, 1000).collect()}
    bins, made, turn, want = [], 0, 0, {}
    for r in parts.orderBy(F.xxhash64("doc_id", "piece", "ids_crc32")).collect():
        turn += 1
        fits = [b for b in bins if b[0] >= r["length"]]
        if fits:
            best = min(fits, key=lambda b: (b[0], -b[1]))
        else:
            if len(bins) == 6:
                bins.remove(min(bins, key=lambda b: (b[0], -b[1])))
            best = [100, 0, made]
            bins.append(best)
            made += 1
        want[r["doc_id"]] = (best[2], 100 - best[0])
        best[0], best[1] = best[0] - r["length"], turn
        if not best[0]:
            bins.remove(best)
    names = {}
    assert {d: (names.setdefault(s, want[d][0]), o) for d, (s, o) in got.items()} == want and len(set(names.values())) == len(names)


def _brute(rows):
    sets = [set(map(int, shingles(w, 5))) for w in hash_words(pa.array([t for _, t in rows], pa.string()))]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), low[find(i)]) for i, (doc, _) in enumerate(rows))


def test_jaccard_against_brute_force(spark, monkeypatch):
    dice = random.Random(5)
    monkeypatch.setattr(jaccard, "SHORT_LIST", 6)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 8000)
    rows, doc = [], 0
    for size in (6, 9, 12, 15, 30, 120):
        base = [f"{size}w{i}" for i in range(size)]
        for _ in range(25):
            words = list(base)
            for _ in range(dice.randint(0, max(1, size // 40))):
                words[dice.randrange(size)] = f"n{dice.randint(0, 9)}"
            rows.append((doc, " ".join(words[: size - dice.randint(0, 2)])))
            doc += 1
    rows += [(1000, None), (1001, " "), (1002, "one two"), (1003, "ONE  two"), (1004, "three")]
    got = sorted(tuple(r) for r in jaccard.join(spark.createDataFrame(rows, DOCS)).collect())
    assert got == _brute(rows)
    assert jaccard.join(spark.createDataFrame([], DOCS)).count() == 0


def test_subsets_alone_find_links(spark, monkeypatch):
    """Small sets only: no set is in an inverted list, and subsets find what a comparison of all pairs finds."""
    monkeypatch.setattr(jaccard, "boundary", lambda *_: jaccard.SMALL_MOST)
    found = []
    light = jaccard._small_links
    monkeypatch.setattr(jaccard, "_small_links", lambda signed: found.append((signed.where("size(listed) > 0").count(), light(signed).count())) or light(signed))
    dice, rows = random.Random(7), []
    for k in range(120):
        base = [f"{k % 6}w{i}" for i in range(9 + k % 5)]
        if dice.random() < 0.6:
            base.append(f"n{dice.randint(0, 5)}")
        rows.append((k, " ".join(base)))
    got = sorted(tuple(r) for r in jaccard.join(spark.createDataFrame(rows, DOCS)).collect())
    assert got == _brute(rows) and found[0][0] == 0 and found[0][1] > 0


def test_blocks_of_one_component(spark, monkeypatch):
    """A large component of long lists, and others apart from it in the same lists."""
    monkeypatch.setattr(jaccard, "SHORT_LIST", 4)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 4000)
    base, rows = [f"w{i}" for i in range(100)], []
    for k in range(60):
        rows.append((k, " ".join([*base, *(f"x{k}y{i}" for i in range(k % 5))])))
    for k in range(60, 100):
        own = 18 + k % 12
        rows.append((k, " ".join([*base, *(f"x{k if k % 3 else 60}y{i}" for i in range(own))])))
    assert sorted(tuple(r) for r in jaccard.join(spark.createDataFrame(rows, DOCS)).collect()) == _brute(rows)


def test_pipeline_against_brute_force(spark, tmp_path, paths):
    """Each stage against a plain rule on its own input, and the run as a whole against the last."""
    import test_lines

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    inputs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, inputs[-1], sf).write.parquet(f"{tmp_path}/{name}")
        inputs.append(spark.read.parquet(f"{tmp_path}/{name}"))
    texts = [{r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()} for df in inputs[:-1]]
    model = quality.fit(inputs[0], spark.read.parquet(f"{sf}/labels.parquet"))
    score = {d: model.score(next(quality.features(pa.array([t], pa.string())))) for d, t in texts[0].items()}
    assert set(texts[1]) == {d for d, x in score.items() if x >= quality.THRESHOLD}
    by_hand = test_lines.by_hand(sorted(texts[1].items()))
    assert texts[2] == {d: t for d, t in by_hand.items() if t == texts[1][d] or t.strip(" ")}
    assert set(texts[3]) == {d for d, _, low in _brute(sorted(texts[2].items())) if d == low}
    plain = lambda t: hash_words(pa.array([re.sub(r"[^\w\s]|_", " ", t or "").lower()]))
    items = [next(iter(plain(r["text"]))).copy() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = set()
    for d, t in texts[3].items():
        words = next(iter(plain(t))).copy()
        if any(len(w) >= tiling.MIN_MATCH and sum(x[2] for x in tiling.tile(w, words)) >= tiling.COVERAGE * len(w) for w in items):
            leaks.add(d)
    assert set(texts[4]) == set(texts[3]) - leaks
    lengths = {r["doc_id"]: r["n"] for r in inputs[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert lengths == {d: len(bpe.encode(t or "", paths)) + 1 for d, t in texts[4].items()}
    stored = [(zlib.crc32(bytes(r["ids"])), len(r["ids"])) == (r["ids_crc32"], 4 * r["length"]) for r in inputs[5].collect()]
    assert stored and all(stored)
    order = lambda df: sorted(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert order(corpus_pipeline.run(spark, sf)) == order(inputs[5])


def test_deep_pages_align(spark):
    deep = "<div>" * 4000 + "<p>Deep {0} words</p>" + "</div>" * 4000
    rows = [(i, f"http://d.com/{i}", deep.format(i)) for i in range(7)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Deep {i} words" for i in range(7)}


def test_join_of_hot_keys(spark):
    left = spark.createDataFrame([(7 if i % 3 else i, i) for i in range(900)] + [(None, 5)], "k long, id long")
    right = spark.createDataFrame([(i, i * 2) for i in range(0, 900, 2)] + [(7, 14)], "k long, v long")
    order = lambda df: sorted(map(str, df.select("k", "id", "v").collect()))
    assert order(join_hot(left, right, "k", "id")) == order(left.join(right, "k", "left"))
    assert join_hot(left.limit(0), right, "k", "id").count() == 0
