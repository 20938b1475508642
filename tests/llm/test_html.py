"""Tree matching of any size, and wrapper induction whatever a host's first page is."""

import random

from haloframe.llm import html


def _best(a, b):
    """The size of a largest match, by plain recursion over all children."""
    if a.tag != b.tag:
        return 0
    table = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, c in enumerate(a.children):
        for j, d in enumerate(b.children):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + _best(c, d))
    return 1 + table[-1][-1]


def _tree(dice, depth):
    node = html.Node(dice.choice(["div", "p"]), False, False)
    node.children = [_tree(dice, depth - 1) for _ in range(dice.randint(0, 4) if depth else 0)]
    return node


def test_matches_are_largest(monkeypatch):
    dice = random.Random(2)
    for k in range(300):
        monkeypatch.setattr(html, "ALIGN_CELLS", [250_000, 1, 4][k % 3])
        a, b = _tree(dice, 3), _tree(dice, 3)
        a.tag = b.tag = "body"
        pairs = html.match(a, b)
        assert len(pairs) == _best(a, b) and all(x.tag == y.tag for x, y in pairs)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)


def test_long_pages_align_behind_an_insertion(spark):
    """More siblings than a table holds: a constant block stays template whatever number of paragraphs stands before it."""

    def page(i):
        own = "".join(f"<p>story {i} paragraph {k}</p>" + ("<h2>part</h2>" if k == 300 + i else "") for k in range(600 + i))
        return f"<body><div>{own}<blockquote>Read this too</blockquote><p>All rights reserved</p></div></body>"

    rows = [(i, f"http://l.com/{i}", page(i)) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Read this" not in t and "rights" not in t and f"story {i} paragraph {599 + i}" in t for i, t in got.items())


def _extract(spark, rows):
    return {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


PAGE = "<body><div><p>Shared menu text</p></div><div><p>Story {0} is told here at length</p><p>Words {0} go on</p></div></body>".format


def test_smallest_page_is_null(spark):
    rows = [(0, "http://n.com/0", None), (1, "http://n.com/1", ""), (None, "http://n.com/2", None)] + [(i, f"http://n.com/{i}", PAGE(i)) for i in range(2, 9)]
    got = _extract(spark, rows)
    assert got[0] == got[1] == got[None] == "" and all(got[i] == f"Story {i} is told here at length\n\nWords {i} go on" for i in range(2, 9))


def test_smallest_page_has_another_layout(spark):
    rows = [(0, "http://o.com/0", "<body><table><tr><td>Odd one out</td></tr></table></body>")] + [(i, f"http://o.com/{i}", PAGE(i)) for i in range(1, 20)]
    got = _extract(spark, rows)
    assert got[0] == "Odd one out" and all(got[i] == f"Story {i} is told here at length\n\nWords {i} go on" for i in range(1, 20))


def test_two_pages_are_enough(spark):
    got = _extract(spark, [(i, f"http://t.com/{i}", PAGE(i)) for i in (1, 2)] + [(i, "http://c.com/", f"<p>All of this long story stands on both of the two pages</p><p>{i}</p>") for i in (5, 6)])
    assert got[1] == "Story 1 is told here at length\n\nWords 1 go on" and got[2] == "Story 2 is told here at length\n\nWords 2 go on"
    assert all("All of this long story" in got[i] for i in (5, 6))


NAMED = ['section class="related-work"', 'div id="notice-of-motion"', 'div class="social-history"', 'section id="menu-design"', 'div class="comment-theory"']


def test_names_do_not_decide_inside_an_article(spark):
    """A name that only has a boilerplate word as a part, on one page of a host or on its only page."""
    page = "<body><article><h1>Head {0}</h1><{1}><p>Kept text {0}</p></{2}><p>Last words {0}</p></article></body>".format
    rows = [(k, f"http://e.com/{k}", page(k, tag, tag.split()[0])) for k, tag in enumerate(NAMED)]
    rows += [(k + 10, f"http://e{k}.com/", page(k, tag, tag.split()[0])) for k, tag in enumerate(NAMED)]
    rows += [(20, "http://f.com/", page(20, 'div data-x="a hidden id class=ad b" title="comments"', "div"))]
    got = _extract(spark, rows)
    assert all(f"Kept text {i % 10}" in t and f"Last words {i % 10}" in t for i, t in got.items() if i < 20) and "Kept text 20" in got[20]


def test_hints_count_where_the_host_repeats_them(spark):
    """Reader comments in an element of a hinting name, on each page of a host other ones, go by alignment alone."""
    page = "<body><article><p>Story {0} goes here</p>{1}</article></body>".format
    block = '<div class="comment-list"><p>Reader {0} says so</p></div>'.format
    rows = [(i, f"http://h.com/{i}", page(i, block(i))) for i in range(9)] + [(20, "http://one.com/1", page(20, block(20)))]
    got = _extract(spark, rows)
    assert all(got[i] == f"Story {i} goes here" for i in range(9)) and "Reader 20" in got[20]


def test_ablation_of_templates(spark, monkeypatch):
    """Induced templates change what is extracted, from pages with and without an article element."""
    body = "<p>Only {0} here</p><p>Also told by {0}</p><ul><li>Subscribe to our paper today</li></ul>".format
    rows = [(i, f"http://a.com/{i}", f"<body><article>{body(i)}</article></body>") for i in range(7)]
    rows += [(i, f"http://b.com/{i}", f"<body><div>{body(i)}</div></body>") for i in range(10, 17)]
    got = _extract(spark, rows)
    assert all(t == f"Only {i} here\n\nAlso told by {i}" for i, t in got.items())
    plain = html.template
    monkeypatch.setattr(html, "template", lambda counts, **how: plain(counts.limit(0), **how))
    assert all("Subscribe" in t for t in _extract(spark, rows).values())


def test_shapes_are_held_across_pages():
    """Gains remembered from other pages give matches as large as fresh ones."""
    dice, shapes = random.Random(9), html.Shapes()
    for _ in range(150):
        a, b = _tree(dice, 3), _tree(dice, 3)
        a.tag = b.tag = "body"
        pairs = shapes.pairs(a, shapes.of(html.flat(a)), b, shapes.of(html.flat(b)))
        assert len(pairs) == _best(a, b)


QUOTE = "<p>The same words, quoted on both pages, belong to the story</p>"


def test_blocks_that_a_host_repeats_amid_its_articles_stay(spark):
    """A quotation on both pages of a host, and the headings of eight recipes."""
    story = "<body><article><h1>Title {0}</h1><p>Before {0}</p>{1}<p>Behind {0}</p></article></body>".format
    recipe = "<body><main><h1>Dish {0}</h1><h2>Ingredients</h2><ul><li>{0} eggs</li></ul><h2>Method</h2><p>Boil for {0} hours</p><p>Follow our kitchen</p></main></body>".format
    got = _extract(spark, [(i, f"http://q.com/{i}", story(i, QUOTE)) for i in (1, 2)] + [(i, f"http://r.com/{i}", recipe(i)) for i in range(10, 18)])
    assert all("quoted on both pages" in got[i] for i in (1, 2))
    assert all(got[i] == f"Dish {i}\n\nIngredients\n\n{i} eggs\n\nMethod\n\nBoil for {i} hours" for i in range(10, 18))


TEN = ['div class="social"', 'div id="notice"', 'div id="header"', 'div class="share"', 'div class="ad"', 'div id="reply"', 'div class="modal"', 'div class="widget"', 'section id="promotion"', 'div class="story banner"']


def test_a_name_alone_deletes_nothing_in_an_article(spark):
    page = "<body><article><h1>Head {0}</h1><{1}><p>Kept text {0}</p></{2}><p>Last words {0}</p></article></body>".format
    rows = [(k, f"http://{host}.com/{k}", page(k, tag, tag.split()[0])) for k, tag in enumerate(TEN) for host in ("t", f"t{k}")]
    rows += [(k + 20, f"http://u{k // 2}.com/{k}", page(k + 20, 'div class="story banner"', "div")) for k in range(2)]
    texts = [(r["page_id"], r["text"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(texts) == 22 and all(t == f"Head {k}\n\nKept text {k}\n\nLast words {k}" for k, t in texts)


def test_names_decide_where_nothing_marks_content(spark):
    page = "<body><div class='ad'><p>Buy {0}</p></div><div><p>Story {0}</p></div></body>".format
    got = _extract(spark, [(i, f"http://m{i % 2}.com/{i}", page(i)) for i in range(3)])
    assert all(t == f"Story {i}" for i, t in got.items())


def test_comment_articles_go(spark):
    comment = ['<article class="comment"><p>First!</p></article>', '<div class="comments"><p>First!</p></div>', '<article itemprop="comment"><p>First!</p></article>', '<article itemtype="https://schema.org/Comment"><p>First!</p></article>']
    rows = [(k, f"http://c{k}.com/", f"<body><article><p>Story {k}</p>{c}</article></body>") for k, c in enumerate(comment)]
    rows += [(k + 10, f"http://c{k}.org/", f"<body><article><p>Story {k + 10}</p></article>{c}</body>") for k, c in enumerate(comment)]
    rows += [(20, "http://d.com/", '<body><article class="comment"><p>Story 20</p></article></body>')]
    assert all(t == f"Story {i}" for i, t in _extract(spark, rows).items())


def test_alignment_decides_within_articles(spark):
    """A notice and a closing line that a host repeats around its texts go, in pages that markup does not tell apart."""
    page = "<body><article><p>You are reading our archive</p><h1>Head {0}</h1><p>Text {0}</p><p>All rights stay with us</p><h4>More</h4></article></body>".format
    got = _extract(spark, [(i, f"http://w.com/{i}", page(i)) for i in range(9)] + [(20 + i, f"http://x.com/{i}", page(20 + i)) for i in range(3)])
    assert all(got[i] == f"Head {i}\n\nText {i}" for i in range(9)) and all("archive" in got[i] and "rights" in got[i] for i in range(20, 23))
