"""Line dedup by a log-template tree of fixed depth; DataFrame functions only.

Every line goes down the tree by its token count and its first ``LEAD`` tokens, a token with a digit standing
for a variable field.  In a leaf where several different lines meet, a token is constant at its position if
enough of the leaf's lines have it, each counted once a document: ``TEMPLATE_DOCS``, or a share of 1/2, 1/4 and so
on down to that number, each giving a template of its own, so values of a field stay variable however often
each recurs, and a form that is rare in its leaf is still seen.  A line has a template if ``CONSTANT`` of
its tokens without digits are constant, and at least one is.  The most special template of a line is the line
itself, without variables.  A template recurs if documents of ``TEMPLATE_DOCS`` ids have it, one without
variables if those of ``LINE_DOCS`` have; a line goes by its most general recurring one.  Recurring templates
are dropped from all documents but the one with the smallest id (``keep_first``), so that nothing vanishes from
the corpus altogether, or else from all.

A line that a document repeats counts once in it; rows sharing an id are one document where ids are counted.
Nulls: a null text has no lines and stays null; a document without an id is told by its text and stands before
all others.  Lines of white space are left alone.  An empty table gives no rows.  Texts and lines of any length are used
whole.  Extra columns are carried along; a column named like a helper column does not clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haloframe.llm.common import BROADCAST_ROWS, cut, join_keyed, join_side, small

LEAD = 3
LINE_DOCS = 2
TEMPLATE_DOCS = 5
CONSTANT = 0.8
#: Documents without an id are told by a number from here downwards.
_NO_ID = -(1 << 62)


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _masked(token: Column) -> Column:
    return F.when(token.rlike(r"\p{N}"), "<*>").otherwise(token)


def _identity() -> Column:
    """The id, or for a null one a hash of the text, below all ids in use."""
    return F.coalesce(F.col("doc_id").cast("bigint"), _NO_ID - F.shiftrightunsigned(F.xxhash64("text"), 3))


def _lines(docs: DataFrame) -> DataFrame:
    """``doc, line, raw`` of every different line with a text, white space at its ends left out."""
    own = F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))
    each = docs.select(_identity().alias("doc"), F.explode(own).alias("line"))
    return each.where("line <> ''").withColumn("raw", _line_hash(F.col("line")))


def _tokens(line: str) -> Column:
    return F.split(line, r"\s+")


def _leaf(tokens: str) -> Column:
    """The leaf of a line: its token count and first tokens."""
    lead = F.transform(F.slice(tokens, 1, LEAD), _masked)
    return F.xxhash64(F.size(tokens), F.array_join(lead, " "))


def _templates(docs: DataFrame, lines: DataFrame, literal: DataFrame) -> DataFrame:
    """``raw, template`` of the lines whose generalised template recurs."""
    leaves = cut(
        literal.groupBy("leaf")
        .agg(F.count(F.lit(1)).alias("variants"), F.sum("seen").alias("all"))
        .where((F.col("variants") > 1) & (F.col("all") >= TEMPLATE_DOCS))
        .select("leaf", "all")
    )
    variants = cut(literal.join(small(leaves), "leaf").select("leaf", "raw", "seen", "all"))
    # Only lines that a template may generalise are read again and cut into tokens, each of them once.
    again = _lines(docs).select("raw", "line")
    if variants.count() <= BROADCAST_ROWS:
        again = again.join(F.broadcast(variants.select("raw")), "raw", "left_semi")
    wanted = again.groupBy("raw").agg(F.first("line").alias("line")).join(variants, "raw").withColumn("tokens", F.transform(_tokens("line"), _masked))
    plain = F.size(F.filter("tokens", lambda t: t != "<*>")).alias("plain")
    each = wanted.select("leaf", "raw", "seen", "all", plain, F.posexplode("tokens").alias("at", "token")).where("token <> '<*>'")
    fields = cut(each.select("raw", "seen", "all", "plain", "at", F.xxhash64("leaf", "at", "token").alias("slot")))
    support = cut(fields.groupBy("slot").agg(F.sum("seen").alias("support")).where(F.col("support") >= TEMPLATE_DOCS))
    halved = F.transform(F.sequence(F.lit(1), F.lit(62)), lambda k: F.ceil(F.col("all") / F.pow(F.lit(2.0), k)))
    levels = F.array_distinct(F.transform(halved, lambda x: F.greatest(x, F.lit(TEMPLATE_DOCS).cast("bigint"))))
    shape = F.transform(F.filter("items", lambda x: x["support"] >= F.col("level")), lambda x: x["slot"])
    template = cut(
        join_keyed(fields, support, "slot", "raw")
        .groupBy("raw", "plain", "all")
        .agg(F.sort_array(F.collect_list(F.struct("at", "slot", "support"))).alias("items"))
        .where(F.size("items") >= CONSTANT * F.col("plain"))
        .withColumn("level", F.explode(levels))
        .select("raw", "plain", shape.alias("shape"))
        .select("raw", "plain", F.size("shape").alias("fixed"), F.xxhash64("shape").alias("template"))
        .where((F.col("fixed") > 0) & (F.col("fixed") >= CONSTANT * F.col("plain")))
        .select("raw", "fixed", "template")
        .distinct()
    )
    spread = join_keyed(lines, template, "raw", "doc").select("template", "doc").distinct()
    recurring = cut(spread.groupBy("template").count().where(F.col("count") >= TEMPLATE_DOCS).select("template"))
    general = join_keyed(template, recurring, "template", "raw").groupBy("raw").agg(F.min(F.struct("fixed", "template")).alias("t"))
    return general.select("raw", F.col("t.template").alias("template"))


def dropped_lines(docs: DataFrame, keep_first: bool = True) -> DataFrame:
    """Per document (``doc``) the hashes of its lines that go."""
    parsed = _lines(docs).withColumn("tokens", _tokens("line"))
    lines = cut(parsed.select("doc", _leaf("tokens").alias("leaf"), "raw"))
    literal = cut(
        lines.groupBy("raw", "leaf").agg(F.count(F.lit(1)).alias("seen"), F.min("doc").alias("first"), F.max("doc").alias("last"))
    )
    lines = lines.select("doc", "raw")
    # A line without a more general template goes by the one without variables: itself, in two ids or more.
    named = literal.join(_templates(docs, lines, literal), "raw", "left").where("template IS NOT NULL OR first <> last")
    named = cut(named.select("raw", F.coalesce("template", "raw").alias("key"), "first"))
    if not keep_first:
        return join_keyed(lines, named.select("raw"), "raw", "doc").groupBy("doc").agg(F.collect_set("raw").alias("gone"))
    keep = cut(named.groupBy("key").agg(F.min("first").alias("keep")))
    recurring = cut(join_keyed(named, keep, "key", "raw").select("raw", "keep"))
    return join_keyed(lines, recurring, "raw", "doc").where("doc <> keep").groupBy("doc").agg(F.collect_set("raw").alias("gone"))


def dedup(docs: DataFrame, keep_first: bool = True) -> DataFrame:
    """``docs`` with recurring lines dropped from ``text``, and the last column telling how many."""
    gone = cut(dropped_lines(docs, keep_first).withColumnsRenamed({"doc": "__halo_doc", "gone": "__halo_gone"}))
    named = docs.withColumn("__halo_doc", _identity())
    joined = join_side(named, gone, ["__halo_doc"], 8 * F.size("__halo_gone"), spread="text")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("__halo_gone", _line_hash(x)), F.lit(False)))
    fewer = F.col("__halo_gone").isNotNull() & F.col("text").isNotNull()
    return (
        joined.withColumn("__halo_kept", F.when(fewer, kept))
        .withColumn("__halo_n", F.when(fewer, F.size(lines) - F.size("__halo_kept")).otherwise(0))
        .withColumn("text", F.when(fewer, F.array_join("__halo_kept", "\n")).otherwise(F.col("text")))
        .select(*docs.columns, "__halo_n")
    )


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).withColumnRenamed("__halo_n", "dropped_lines")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines; those of which nothing but white space is left go."""
    cleaned = dedup(docs).where((F.col("__halo_n") == 0) | F.col("text").rlike(r"\S"))
    return cleaned.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)
