"""Line dedup: short lines, forms with several fields, fields whose values recur."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from haloframe.llm import common, lines

DOCS = "doc_id long, text string"
MONTHS = "January February March April May June July August September October November December".split()


def _dedup(spark, rows):
    return {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, DOCS)).collect()}


def test_short_lines_that_recur_go(spark):
    rows = [(i, f"own{chr(97 + i)}\nAll rights reserved.\n\nNext") for i in range(4)]
    got = _dedup(spark, rows)
    assert got == {0: rows[0][1]} | {i: f"own{chr(97 + i)}\n" for i in range(1, 4)}


def test_copies_leave_no_husk(spark):
    text = "one two three four five six\n\nAnd so.\nEnd"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "quite another line of words")], DOCS)
    assert {r["doc_id"] for r in lines.stage(spark, docs, "").collect()} == {1, 3}


def test_fields_do_not_count_against_a_template(spark):
    forms = ["Page {} of {}", "User {} logged in from host {} today", "see the {} page now {}"]
    rows = [(i, "\n".join(f.format(i + 100, 3 * i + 7) for f in forms)) for i in range(1, 8)]
    rows.append((50, "Only {} numbers 5 here".format(4)))
    rows += [(60 + i, f"{i} {i + 10} {i + 20} {i + 30}") for i in range(9)]
    got = _dedup(spark, rows)
    assert got == {1: rows[0][1]} | {i: "" for i in range(2, 8)} | dict(rows[7:])


def test_values_that_recur_stay_variable(spark):
    """Every month and name is in over five lines, most pairs of them in fewer than five documents."""
    names = [f"Name{c}" for c in "abcdefghijk"]
    line = "This is the yearly report on the state of the firm for {} by {} and all".format
    rows = [(i, line(MONTHS[i % 12], names[i % 11])) for i in range(132)]
    rare = [(500 + i, f"This is the very old log of {i} things seen by all of us in the hall") for i in range(6)]
    got = _dedup(spark, rows + rare)
    assert sorted(d for d, t in got.items() if t) == [0, 500]


def test_rare_form_in_a_large_leaf(spark):
    big = [(i, f"We have seen item {i} in the main store of the town") for i in range(200)]
    rare = [(1000 + i, f"We have seen nobody {i} at a far shop near some village") for i in range(6)]
    got = _dedup(spark, big + rare)
    assert sorted(d for d, t in got.items() if t) == [0, 1000]


def by_hand(rows):
    """The rule of line dedup, row by row: the texts of ``(doc_id, text)`` without recurring lines."""
    mask = lambda t: "<*>" if re.search(r"\d", t) else t
    words = lambda x: tuple(re.split(r"[ \t\n\x0b\f\r]+", x))
    own, leaf = {}, {}
    for doc, text in rows:
        for line in {line.strip(" ") for line in (text or "").split("\n")} - {""}:
            own.setdefault(line, []).append(doc)
    for x in own:
        leaf.setdefault((len(words(x)), *map(mask, words(x)[: lines.LEAD])), []).append(x)
    shapes = {}
    for where, variants in leaf.items():
        number = sum(len(own[x]) for x in variants)
        if len(variants) < 2 or number < lines.TEMPLATE_DOCS:
            continue
        support = Counter()
        for x in variants:
            support.update({(k, mask(t)): len(own[x]) for k, t in enumerate(words(x))})
        for x in variants:
            plain = [(k, t) for k, t in enumerate(map(mask, words(x))) if t != "<*>"]
            for half in range(1, 63):
                level = max(lines.TEMPLATE_DOCS, -(-number // 2**half))
                shape = tuple(p for p in plain if support[p] >= level)
                if shape and len(shape) >= lines.CONSTANT * len(plain):
                    shapes.setdefault(x, set()).add((where, shape))
    spread = {}
    for x, found in shapes.items():
        for t in found:
            spread.setdefault(t, set()).update(own[x])
    key = {}
    for x, found in shapes.items():
        if recurring := [t for t in found if len(spread[t]) >= lines.TEMPLATE_DOCS]:
            key[x] = min(recurring, key=lambda t: len(t[1]))
    key |= {x: x for x in own if x not in key and len(set(own[x])) >= lines.LINE_DOCS}
    keep = {}
    for x, t in key.items():
        keep[t] = min(own[x] + ([keep[t]] if t in keep else []))
    stays = lambda doc, x: x not in key or keep[key[x]] == doc
    return {doc: text and "\n".join(x for x in text.split("\n") if stays(doc, x.strip(" "))) for doc, text in rows}


def test_against_brute_force(spark):
    dice = random.Random(11)
    word = lambda n=40: f"w{chr(97 + dice.randint(0, n) % 26)}{chr(97 + dice.randint(0, n) // 26)}"
    fixed = [" ".join(word() for _ in range(dice.randint(1, 12))) for _ in range(6)]
    forms = ["User {} logged in from host {} today", "total of {} items were sold by {} in all of may", "see the {} page now {}", "Page {} of {}"]
    rows = []
    for doc in range(90):
        out = [" ".join(word(600) for _ in range(dice.randint(0, 9))) for _ in range(3)]
        out += dice.sample(fixed, dice.randint(0, 2)) + [dice.choice(forms).format(dice.choice([dice.randint(1, 99), word(4)]), dice.randint(1, 9)) for _ in range(dice.randint(0, 3))]
        dice.shuffle(out)
        rows.append((doc, "\n".join(out)))
    rows += [(90, None), (91, ""), (92, "\n\n")]
    got = _dedup(spark, rows)
    assert got == by_hand(rows) and sum(t != got[d] for d, t in rows) > 40


def test_both_settings_of_keep_first(spark):
    rows = [(i, f"own{chr(97 + i)}\nUser {i} logged in today\nAll of it") for i in range(7)] + [(None, "All of it\nhere"), (None, "All of it\nhere")]
    docs = spark.createDataFrame(rows, DOCS)
    kept = {r["text"] for r in lines.dedup(docs).collect()}
    assert kept == {"ownb", "owna\nUser 0 logged in today", "All of it\nhere", *(f"own{c}" for c in "cdefg")}
    dropped = {r["text"] for r in lines.dedup(docs, keep_first=False).collect()}
    assert dropped == {"here", *(f"own{c}" for c in "abcdefg")}


def test_templates_decide(spark, monkeypatch):
    """Lines that differ in their fields go through the tree alone; without it they stay."""
    rows = [(i, f"Page {i} of {2 * i}\nown{chr(97 + i)}") for i in range(6)]
    assert sum("Page" in t for t in _dedup(spark, rows).values()) == 1
    monkeypatch.setattr(lines, "_templates", lambda docs, lines, literal: literal.limit(0).select("raw", F.col("raw").alias("template")))
    assert sum("Page" in t for t in _dedup(spark, rows).values()) == 6


def test_repeats_in_one_document_count_once(spark):
    """Five documents make a token constant and a template recur, not five lines of one."""
    rows = [(1, "\n".join(f"Log {k} of it" for k in range(9))), (2, "Log 77 of it"), (3, "own line")]
    assert _dedup(spark, rows) == dict(rows)


def test_hot_keys_without_broadcast(spark, monkeypatch):
    """The same rows where no side is small enough to be broadcast."""
    rows = [(i, f"Page {i} of {2 * i}\nAll rights reserved\nown{chr(97 + i)}") for i in range(9)]
    want = _dedup(spark, rows)
    for name in ("BROADCAST_ROWS", "BROADCAST_BYTES"):
        monkeypatch.setattr(common, name, -1)
    monkeypatch.setattr(lines, "BROADCAST_ROWS", -1)
    assert _dedup(spark, rows) == want
