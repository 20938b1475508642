"""Link decisions against union-find and against the query's SQL, on generated linked pages."""

import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import duckdb
import pandas as pd

from haloframe.llm import queries, urls

PAGES = "page_id long, url string, html string"


def _linked_pages():
    """Chains, a hub, pairs and loops over four kinds of hosts; links of every form."""
    dice = random.Random(13)
    hosts = ["a.com", "b.org", "c.net", "m.example.net", "x.example.com", "D.example.org"]
    own = [f"http{'s' * (k % 2)}://{dice.choice(hosts)}/{dice.choice(['en', 'de', 'fr'])}/{k}{dice.choice(['', '?q=1&r=2', '#top'])}" for k in range(90)]
    canonical = ['<link rel="canonical" href="{}">', "<LINK href='{}' data-x=1 rel=canonical>", "<link\nrel = canonical href={} />"]
    refresh = ['<meta http-equiv="refresh" content="0; url={}">', "<META content='5;URL={}' http-equiv=Refresh>"]
    rows = []
    for k, url in enumerate(own):
        if k < 20:
            link = own[k + 1] if k < 19 else own[0]
        elif k < 50:
            link = own[50]
        else:
            link = dice.choice([own[dice.randrange(50, 90)], "", "/en/7", "other", f"//{dice.choice(hosts)}/fr/z", "?p=2", "#part", "http://blocked.net/x", "https://nowhere.com/y"])
        html = f"<html>{dice.choice(canonical + refresh).format(link.replace('&', '&amp;'))}</html>" if link and dice.random() < 0.8 else dice.choice([None, "", "<p>no refresh</p>"])
        rows.append((k, url, html))
    return rows + [(200, None, "<link rel=canonical href=http://c.net/>"), (201, "nothing", '<link rel="canonical" href="/x">'), (202, "http://q.com", '<link rel="canonical" href="rel">'), (203, own[3], rows[3][2]), (203, own[3], rows[3][2]), (None, own[7], None)]


def _judged(spark, rows):
    pages = spark.createDataFrame(rows, PAGES)
    return sorted(map(tuple, urls.judge(pages, urls.links_of(pages)).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)


def test_links_against_sql(spark):
    rows = _linked_pages()
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLES['op4_url_filter']})").fetchall()
    got = _judged(spark, rows)
    assert got == sorted(want, key=str) and sum(r[3] is None and r[4] == "block" for r in got) > 9


def test_links_against_union_find(spark):
    """Absolute links only, followed by hand; rules by hand; explicit allow stays."""
    dice = random.Random(3)
    hosts = ["a.com", "b.org", "c.net", "m.example.net", "x.example.com"]
    nodes = [f"{dice.choice(hosts)}/{dice.choice(['en', 'de', 'fr'])}/{k}" for k in range(150)]
    edges = [(k, dice.randrange(150)) for k in range(150) if dice.random() < 0.6] + [(k, k + 1) for k in range(40)] + [(k, 149) for k in range(60, 75)]
    rows = [(k, f"http://{n}", "".join(f'<link rel="canonical" href="http://{nodes[b]}">' for a, b in edges if a == k)[: 10**6]) for k, n in enumerate(nodes)]
    root = list(range(150))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:  # all canonical links of a page count
        root[find(a)] = find(b)

    def rule(node):
        host, _, path = node.partition("/")
        fits = [(len(h + p), v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits)[1] if fits else None

    alone = {k for k in range(150)} - {k for edge in edges for k in edge}
    bad = {find(k) for k in range(150) if rule(nodes[k]) == "block" and k not in alone}
    want = {k: rule(n) or ("block" if find(k) in bad and k not in alone else "allow") for k, n in enumerate(nodes)}
    assert {r[0]: r[4] for r in _judged(spark, rows)} == want and len(set(want.values())) == 2


def test_equally_long_rules(spark):
    """Of two rules as long the one that sorts last wins."""
    pages = spark.createDataFrame([(1, "http://ab.cd/x", None)], PAGES)
    got = urls.judge(pages, urls.links_of(pages), (("block", "ab.cd", "/"), ("allow", "cd", "/x"), ("allow", "ab.cd", ""))).first()
    assert (got["rule"], got["verdict"]) == ("ab.cd/", "block")
    got = urls.judge(pages, urls.links_of(pages), (("block", "b.cd", "/"), ("allow", "ab.cd", ""))).first()
    assert (got["rule"], got["verdict"]) == ("ab.cd", "allow")


class _Reader(HTMLParser):
    """Links as the standard library's parser sees them."""

    def __init__(self):
        super().__init__()
        self.links = []

    def handle_starttag(self, tag, attrs):
        own = {}
        for name, value in attrs:
            own.setdefault(name, value or "")
        if tag == "link" and "canonical" in own.get("rel", "").lower().split():
            self.links.append(own.get("href", "").strip())
        if tag == "meta" and own.get("http-equiv", "").strip().lower() == "refresh":
            self.links += re.findall(r"(?i)\burl\s*=\s*[\"']?\s*([^\"'\s]+)", own.get("content", ""))[:1]


FORMS = [
    '<link rel="canonical" href="http://a.com/1"><link rel="canonical" href="http://b.com/2">',
    '<!-- <link rel="canonical" href="http://gone.net/"> --><p>x</p><link rel="canonical" href="c">',
    "<!-- open <link rel=canonical href=http://gone.net/>",
    '<link data-href="http://gone.net/" rel="canonical" href="/kept">',
    '<link title="x rel=other href=http://gone.net/" rel="canonical" href="kept2">',
    '<link rel="alternate canonical" href="http://e.com/x"><link rel="noncanonical" href="http://gone.net/">',
    '<link rel="canonical" href="../up"><link rel="canonical" href="./same/./x/../y?q=../z"><link rel=canonical href="/a/b/../../../c/.."><link rel=canonical href="..">',
    '<link rel="canonical" href="http://F.com/a/../b/."><link rel="canonical" href="//g.com/./x"><link rel="canonical" href="?p=1"><link rel="canonical" href="#f">',
    '<meta http-equiv="refresh" content="0; url=http://h.com/x?a=1&amp;b=2"><META HTTP-EQUIV=Refresh CONTENT="5;URL=\'next;v=1\'">',
    '<meta name="refresh" content="0; url=http://gone.net/"><meta http-equiv="refresh" content="5">',
    '<link title="a > b" rel="canonical" href=" http://i.com/ "/>',
    '<linkrel="canonical" href="http://gone.net/"><link rel="canonical"><link href="http://gone.net/">',
    '<link rel="canonical" href="http:k"><link\n\trel\n=\n"canonical"\nhref\n=\n"/white"\n>',
]


def test_links_against_a_parser(spark):
    base = "https://Start.org/d/e/page?q=1#top"
    rows = [(k, base, form) for k, form in enumerate(FORMS)]
    con = duckdb.connect()
    for k, _, form in rows:
        reader = _Reader()
        reader.feed(re.sub(r"(?s)<!--.*?(-->|\Z)", "", form))
        want = set()
        for link in reader.links:
            if not link:
                continue
            whole = link if "://" in link else ("https://start.org/d/e/" + link if re.match(r"[a-z]+:", link) else urljoin("https://start.org/d/e/page?q=1", link))
            host, path, query = re.match(r"[^:]*://([^/?#]*)([^?#]*)(\?[^#]*)?", whole).groups()
            # urljoin leaves the dots of absolute links
            want.add(host.lower() + (urlsplit(urljoin(f"http://{host}/", path)).path if path else "") + (query or ""))
        pages = spark.createDataFrame([(k, base, form)], PAGES)
        assert {r["b"] for r in urls.links_of(pages).collect()} == want, form
        con.register("pages", pd.DataFrame([(k, base, form)], columns=["page_id", "url", "html"]))
        sql = queries.ORACLES["op4_url_filter"]
        inner = sql[: sql.index("), links AS (SELECT a, b FROM edges")] + ") SELECT b FROM edges"
        assert {r[0] for r in con.execute(inner).fetchall()} == want, form
