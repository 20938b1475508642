"""URL filtering by host and path rules, with decisions carried over redirects; DataFrame functions only.

A page's own rule decides first: the longest rule (host and path together; of two as long, the one that sorts
last) whose host is the page's or a parent domain of it and whose path starts the page's path.  Pages without a rule take the method's verdict: pages and
link targets are nodes (host, path and query), redirect (``meta refresh``) and canonical links are
edges, and a connected component that holds a blocked node blocks its members.  An explicit allow
of a page's own rule always stays.  What is left is allowed.

All canonical and refresh links of a page count, but for those within comments.  Tags are read attribute by attribute, ``rel`` as a
list of words.  A relative link is resolved against the page's url (``//``, ``/``, ``?``, ``#`` at its start, or its folder), and
``.`` and ``..`` are followed in every target's path.  Of character references only ``&amp;`` is decoded; ``base`` elements are not read.

Nulls: a null url, or one without ``://``, has an empty host and path, fits no rule, is no node and is
allowed; null html has no links; a null id is kept.  Repeated rows are each judged.  Html of any length is read
whole.  Extra columns are not carried along.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haloframe.llm.common import components, cut, join_side

#: (verdict, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*[^?#]*(\?[^#]*)", 1)


def node_of(url: Column) -> Column:
    """Host, path and query; null for what is no absolute url."""
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query_of(url)))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The struct (rule, verdict) of the longest rule that fits, or null; rules are few and inline."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


#: A comment; a tag of a link or a meta element; an attribute with its value.  Without backtracking, so that long tags do not recurse.
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
TAG = r"""(?is)<(?:link|meta)\s(?:"[^"]*"|'[^']*'|[^"'>])*+>"""
ATTRIBUTE = r"""(?s)[\s"']([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _value(attributes: Column, name: str) -> Column:
    """The first value of an attribute of that name, without its quotes."""
    own = F.filter(attributes, lambda p: F.lower(p["names"]) == name)
    return F.regexp_replace(F.get(own, F.lit(0))["values"], r"""^["']|["']$""", "")


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` followed."""
    parts = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    last = F.element_at(F.split(path, "/"), -1)
    up = lambda held: F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda held, x: F.when(x == "..", up(held)).when(x == ".", held).otherwise(F.concat(held, F.array(x))))
    whole = F.concat(kept, F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(whole, "/"))).otherwise(path)


def links_of(pages: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between nodes: each page and the targets of its redirect and canonical links.

    Every step names its columns, so that no expression is worked out twice.
    """
    likely = F.coalesce(F.lower("html").contains("canonical") | F.lower("html").contains("refresh"), F.lit(False))
    said = pages.where(likely).select("url", F.regexp_replace("html", COMMENT, "").alias("html"))
    tags = said.select("url", F.explode(F.regexp_extract_all("html", F.lit(TAG), F.lit(0))).alias("tag"))
    names, values = (F.regexp_extract_all("tag", F.lit(ATTRIBUTE), F.lit(k)).alias(n) for k, n in ((1, "names"), (2, "values")))
    read = tags.select("url", F.lower(F.substring("tag", 2, 4)).alias("kind"), names, values).select("url", "kind", F.arrays_zip("names", "values").alias("all"))
    own = read.select("url", "kind", *[_value(F.col("all"), n).alias(c) for n, c in (("rel", "rel"), ("href", "href"), ("http-equiv", "equiv"), ("content", "content"))])
    canonical = (F.col("kind") == "link") & F.array_contains(F.split(F.lower("rel"), r"\s+"), "canonical")
    refresh = (F.col("kind") == "meta") & (F.trim(F.lower("equiv")) == "refresh")
    moved = F.regexp_extract("content", r"""(?is)\burl\s*=\s*["']?\s*([^"'\s]+)""", 1)
    found = own.select("url", F.when(canonical, F.regexp_replace("href", r"^\s+|\s+$", "")).when(refresh, moved).alias("link")).where("link <> ''")
    url = F.col("url")
    links = found.select("url", F.replace("link", F.lit("&amp;"), F.lit("&")).alias("link"))
    parts = links.select("link", F.regexp_extract("url", "^([^:]*)://", 1).alias("scheme"), host_of(url).alias("host"), path_of(url).alias("path"), query_of(url).alias("query"))
    known = parts.where("host <> ''")
    site = F.concat(F.col("scheme"), F.lit("://"), F.col("host"))
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*/)?", 0)).otherwise("/")
    start = lambda x: F.col("link").startswith(x)
    absolute = (
        F.when(F.col("link").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("link"))
        .when(start("//"), F.concat("scheme", F.lit(":"), "link"))
        .when(start("/"), F.concat(site, "link"))
        .when(start("?"), F.concat(site, "path", "link"))
        .when(start("#"), F.concat(site, "path", "query", "link"))
        .otherwise(F.concat(site, folder, "link"))
    )
    link = F.col("link")
    ends = known.select(F.concat("host", "path", "query").alias("a"), absolute.alias("link"))
    split = ends.select("a", host_of(link).alias("host"), path_of(link).alias("path"), query_of(link).alias("query")).where("host <> ''")
    return split.select("a", F.concat("host", without_dots(F.col("path")), "query").alias("b")).distinct()


def judge(pages: DataFrame, edges: DataFrame, rules=RULES) -> DataFrame:
    """Per page ``page_id, host, path, rule, verdict``; ``edges`` as ``links_of`` makes them."""
    url = F.col("url")
    named = pages.select(F.col("page_id").cast("bigint"), host_of(url).alias("host"), path_of(url).alias("path"), query_of(url).alias("query"))
    judged = named.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    found = ["page_id", "host", "path", F.col("own.rule").alias("rule")]
    edges = cut(edges)
    if edges.isEmpty():
        return judged.select(*found, F.coalesce("own.verdict", F.lit("allow")).alias("verdict"))
    members = cut(components(edges))
    at = F.concat(F.lit("://"), F.col("node"))
    placed = members.select("component", host_of(at).alias("host"), path_of(at).alias("path"))
    blocked = placed.where(rule_of(F.col("host"), F.col("path"), rules)["verdict"] == "block").select("component").distinct()
    tainted = cut(members.join(blocked, "component", "left_semi").select("node", F.lit(True).alias("tainted")))
    node = F.when(F.col("host") != "", F.concat("host", "path", "query"))
    joined = join_side(judged.withColumn("node", node), tainted, ["node"], F.octet_length("node"), spread="page_id")
    return joined.select(*found, F.coalesce("own.verdict", F.when(F.col("tainted"), "block").otherwise("allow")).alias("verdict"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge(pages, links_of(pages))
