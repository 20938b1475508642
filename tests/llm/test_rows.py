"""The Jaccard stage on rows that their ids do not tell apart."""

from haloframe.llm import jaccard

DOCS = "doc_id long, text string"


def _words(letter, n=40):
    return " ".join(f"{letter}{k}" for k in range(n))


def _kept(spark, rows):
    return sorted(map(tuple, jaccard.stage(spark, spark.createDataFrame(rows, DOCS), "").collect()), key=str)


def test_copies_without_ids_stay_once(spark):
    rows = [(None, _words("a"))] * 3 + [(None, _words("b")), (5, _words("b")), (None, _words("a") + " more")]
    got = _kept(spark, rows)
    assert len(got) == 2 and (5, _words("b")) in got
    assert [t for d, t in got if d is None] in ([_words("a")], [_words("a") + " more"])


def test_a_shared_id_takes_no_other_text_along(spark):
    rows = [(1, _words("a")), (2, _words("a")), (2, _words("c")), (2, _words("c"))]
    assert _kept(spark, rows) == [(1, _words("a")), (2, _words("c"))]


def test_near_copies_of_one_id_stay_once(spark):
    got = _kept(spark, [(7, _words("a")), (7, _words("a") + " more"), (8, _words("d"))])
    assert [d for d, _ in got] == [7, 8] and got[1][1] == _words("d")


def test_texts_without_shingles(spark):
    rows = [(1, None), (2, None), (2, None), (None, ""), (None, ""), (3, " ")]
    assert _kept(spark, rows) == sorted([(1, None), (2, None), (None, ""), (3, " ")], key=str)
