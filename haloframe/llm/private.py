"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier learns from the result; DataFrame functions only.

Base spans are the valid matches of four fixed patterns.  Beside them, broader patterns (``BROAD``: mail addresses with written-out
signs, numbers that a strict pattern swallowed together with a neighbour, telephone numbers without a plus) propose candidates of the
same kinds.  Six labelers vote yes, no or nothing on each: a strict form, a checksum or plausible size, a gazetteer (issuer
and country codes, address blocks, top-level domains), words before that speak for it, words before that speak against it, and its
edges.  Votes are counted by kind and pattern over the whole table, and expectation-maximisation on these counts gives each
labeler's rates of every vote among true and false candidates and the candidates' chances.  A logistic classifier of each kind is
fitted to these chances by damped Newton steps, on features of the span and its surroundings.  Candidates that it finds likely, whose
checksum or size fits their kind and that overlap no base span are added; of added ones that overlap, the first stays (at one place
the first listed kind).  Base spans are never taken away.

Patterns are written without backtracking, so that long runs of characters neither recurse nor take square time.  All counts come
from tables of at most ``4 * 3**6 * 2**7`` rows; texts are read once and never shuffled, only the spans of one row meet.

A null text is empty and has no spans.  Rows with null or repeated ids are judged one by one and returned each.  Texts of
any length are read whole.  Columns besides ``doc_id`` and ``text`` are not read.  An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haloframe.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: The start of a run, or what a match before it has left of a run.
_LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|(?=[._%+]))[A-Za-z0-9._%+-]++"
#: The stated patterns; a run of local characters or digits is entered at its start only, as a later start in it matches no more.
BASE = (
    _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?=[0-9])(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
BROAD = (
    _LOCAL + r"(?:@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
    r"|\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}])\x20?[A-Za-z0-9-]++)++"
    r"|\x20(?:at|AT)\x20[A-Za-z0-9-]++(?:\x20(?:dot|DOT)\x20[A-Za-z0-9-]++)++)",
    r"(?=[0-9])(?<![0-9A-Za-z.])[0-9]{1,3}+(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}+){3}+(?![0-9A-Za-z])",
    r"(?=[0-9])(?<![0-9A-Za-z])(?:[0-9]{4}([\x20.-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[0-9]{3}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}|[0-9]{12,19})(?![0-9A-Za-z])",
    r"(?=[+(0-9])(?<![0-9A-Za-z+.-])(?:\+[0-9]{1,3}+[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])",
)
#: Words that speak for a kind when they stand before a span, and words that speak against all kinds.
FOR = (
    r"(?i)(e-?mail|contact|write|mailto|address)\W*(\w+\W+)?$",
    r"(?i)\b(ip|ipv4|host|server|client|address|addr|from)\W*(\w+\W+)?$",
    r"(?i)\b(cards?|visa|credit|debit|mastercard|amex|payment|pan)\W*(\w+\W+)?$",
    r"(?i)\b(tel|phone|telephone|call|fax|mobile|cell|dial)\W*(\w+\W+)?$",
)
AGAINST = r"(?i)\b(version|v|release|licen[cs]e|token|key|sha|hash|order|invoice|isbn|issn|serial|id|ref|section|figure|page|total)\W*$"
#: Gazetteers: fixed values of public registries.
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6(011|4[4-9]|5))"
COUNTRIES = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-38]|2[2-6][0-9]|35[0-9]|37[0-9]|38[0-9]|42[013]|97[0-9])"
DOMAINS = r"(?i)\b(com|org|net|edu|gov|info|io|biz|eu|uk|us|ca|au|de|fr|es|it|nl|be|ch|at|pl|pt|se|no|fi|dk|ie|ru|jp|cn|in|br|mx)$"

CONTEXT = 32
ABSTAIN, YES, NO = range(3)
LABELERS = 6
FEATURES = 8
EM_ROUNDS = 12
FIT_ROUNDS = 400
LIKELY = 0.5


def _let(value: Column, use) -> Column:
    """``use`` applied to ``value``, which is evaluated once."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, pattern: str, kind: int, broad: bool) -> Column:
    """All matches in order: what lies between the last one and this (its length, its end), the match, and what follows."""
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def located(p: Column) -> Column:
        gap = lambda i: F.get(p["gaps"], i)
        return F.transform(
            p["hits"],
            lambda hit, i: F.struct(
                F.lit(kind).alias("kind"), F.lit(broad).alias("broad"), i.alias("i"), F.char_length(gap(i)).alias("gap"), F.char_length(hit).alias("size"),
                F.right(gap(i), F.lit(CONTEXT)).alias("before"), hit.alias("hit"), F.left(gap(i + 1), F.lit(2)).alias("after"),
            ),
        )

    return F.when(_worth(text, kind, broad), _let(parts, located))


def _worth(text: Column, kind: int, broad: bool) -> Column:
    """Whether a text has the characters that every match of the pattern holds; a cheap look before a dear one."""
    has = lambda *parts: reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in parts])
    if kind == EMAIL:
        at = has("@")
        return at | has("(at", "( at", "[at", "[ at", "{at", "{ at", "(AT", "( AT", "[AT", "[ AT", "{AT", "{ AT") | (has(" at ", " AT ") & has(" dot ", " DOT ")) if broad else at
    if kind == PHONE and not broad:
        return has("+")
    return text.rlike("[0-9]") & has(".") if kind == IP else text.rlike("[0-9]")


def luhn(digits: Column) -> Column:
    """Whether the check digit fits; ``digits`` are few."""
    twice = F.translate(digits, "0123456789", "0246813579")
    odd = F.char_length(digits) % 2
    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), lambda total, k: total + F.when(k % 2 == odd, digits.substr(k, F.lit(1))).otherwise(twice.substr(k, F.lit(1))).cast("int")) % 10 == 0


def _octets(hit: Column) -> Column:
    """Whether all numbers of a dotted address are at most 255, however long."""
    parts = F.transform(F.split(hit, r"[^0-9]+"), lambda x: F.ltrim(x, F.lit("0")))
    return F.forall(parts, lambda x: (F.char_length(x) < 3) | ((F.char_length(x) == 3) & (x <= "255")))


def _by_kind(kind: Column, *values: Column) -> Column:
    return reduce(lambda rest, k: rest.when(kind == k, values[k]), range(1, 4), F.when(kind == 0, values[0]))


def _card(digits: Column) -> Column:
    return F.when(F.char_length(digits).between(12, 19), luhn(digits)).otherwise(False)


def spans_of(docs: DataFrame) -> DataFrame:
    """A row for each base match and candidate, and one (``kind`` null) for each row of ``docs``.

    Columns: ``row``, ``doc_id``, ``kind``, ``broad``, ``i``, ``gap``, ``size``, ``valid`` (of base matches), the votes ``v0`` to ``v5``
    and the features as bits.
    """
    text = F.coalesce("text", F.lit(""))
    # Each pattern has an array of its own, so that one without a match costs nothing more.
    found = F.filter(F.array(*[matches(text, p, k, broad) for broad, patterns in ((False, BASE), (True, BROAD)) for k, p in enumerate(patterns)]), lambda x: x.isNotNull())
    digits = F.regexp_replace("hit", r"[^0-9]", "")
    rows = (
        docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), F.flatten(found).alias("found"))
        .select("row", "doc_id", F.explode_outer("found").alias("s"))
        .select("row", "doc_id", "s.*")
        .withColumn("digits", digits)
    )
    kind, hit, before, after, n = F.col("kind"), F.col("hit"), F.col("before"), F.col("after"), F.char_length("digits")
    valid = _by_kind(kind, F.lit(True), _octets(hit), _card(F.col("digits")), n.between(9, 15))
    yes_no = lambda c: F.when(c, F.lit(YES)).otherwise(F.lit(NO))
    or_none = lambda c, vote=YES: F.when(c, F.lit(vote)).otherwise(F.lit(ABSTAIN))
    plus, first = F.startswith(hit, F.lit("+")), F.regexp_extract(hit, r"^[0-9]+", 0)
    loose = before.rlike(r"[A-Za-z0-9_=\"'/@]$") | after.rlike(r"^[A-Za-z0-9_=\"'/@]|^[.-][0-9]")
    usual = _by_kind(kind, F.contains(hit, F.lit("@")), ~F.contains(hit, F.lit("[")), n.isin(15, 16), n.isin(10, 11, 12))
    votes = (
        or_none(_by_kind(kind, hit.rlike(r"^\S+@\S+$"), hit.rlike(r"^[0-9.]+$"), hit.rlike(r"^[0-9]+$|^[0-9]{4}(?:[\x20-][0-9]{4}){3}$"), plus)),
        yes_no(_by_kind(kind, hit.rlike(r"[A-Za-z]{2,}$"), _octets(hit), _card(F.col("digits")), n.between(9, 13))),
        _by_kind(
            kind, or_none(hit.rlike(DOMAINS)), F.when(first.isin("0", "127", "255"), F.lit(NO)).otherwise(yes_no(~F.startswith(first, F.lit("0")))),
            yes_no(F.col("digits").rlike(ISSUERS)), F.when(plus, yes_no(hit.rlike(COUNTRIES))).otherwise(F.lit(ABSTAIN)),
        ),
        or_none(_by_kind(kind, *[before.rlike(p) for p in FOR])),
        or_none(before.rlike(AGAINST), NO),
        yes_no(~loose),
    )
    voted = rows.select(
        "row", "doc_id", "kind", "broad", "i", "gap", "size", F.when(~F.col("broad"), valid).alias("valid"), usual.alias("usual"), hit.rlike(r"[^0-9A-Za-z]").alias("parted"),
        *[F.when(F.col("broad"), v).alias(f"v{k}") for k, v in enumerate(votes)],
    )
    features = [F.lit(True), F.col("v1") == YES, F.col("v2") == YES, F.col("v3") == YES, F.col("v4") == NO, F.col("v5") == YES, F.col("usual"), F.col("parted")]
    bits = reduce(Column.bitwiseOR, [F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(features)])
    return voted.withColumn("bits", bits).drop("usual", "parted")


def _sigmoid(odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))


def _sum(rows: Column, of) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda total, x: total + of(x))


def chance(votes: Column, rates: Column) -> Column:
    """The chance that a candidate is true; ``rates`` are log-odds by labeler and vote, the last of them the prior (of vote 0)."""
    return _sigmoid(_sum(F.zip_with(votes, rates, lambda v, r: F.get(r, v)), lambda x: x))


def score(features: Column, weights: Column) -> Column:
    """The classifier's chance of a candidate."""
    return _sigmoid(_sum(F.zip_with(features, weights, lambda x, w: x * w), lambda x: x))


def reliabilities(counts: Column, rounds: int = EM_ROUNDS) -> Column:
    """Log-odds of each labeler's votes, and of the prior, by expectation-maximisation from a majority vote onwards.

    ``counts``: an array of ``votes`` and their number ``n``, for one kind.
    """
    majority = F.array(*[F.array(F.lit(0.0), F.lit(1.0), F.lit(-1.0))] * LABELERS, F.array(F.lit(0.0)))

    def maximised(rows: Column) -> Column:
        def of(totals: Column) -> Column:
            def rate(side: str, k: Column, v: Column) -> Column:
                return F.log((_sum(rows, lambda x: F.when(F.get(x["votes"], k) == v, x[side]).otherwise(0.0)) + 1) / (totals[side] + 3))

            by_vote = F.transform(F.sequence(F.lit(0), F.lit(LABELERS - 1)), lambda k: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda v: rate("t", k, v) - rate("f", k, v)))
            return F.concat(by_vote, F.array(F.array(F.log((totals["t"] + 1) / (totals["f"] + 1)))))

        return _let(F.struct(_sum(rows, lambda x: x["t"]).alias("t"), _sum(rows, lambda x: x["f"]).alias("f")), of)

    def step(rates: Column, _: Column) -> Column:
        weigh = lambda x: _let(chance(x["votes"], rates), lambda p: F.struct(x["votes"].alias("votes"), (x["n"] * p).alias("t"), (x["n"] * (1 - p)).alias("f")))
        return _let(F.transform(counts, weigh), maximised)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), majority, step)


def span_weights(counts: Column, rates: Column, rounds: int = FIT_ROUNDS, ridge: float = 1.0) -> Column:
    """Logistic weights for one kind, fitted to the chances that ``rates`` give its ``counts`` (``votes``, ``features`` and ``n``).

    All weights take a Newton step of their own, each a share of the whole (the number of features bounds how far they add up).
    """

    def fit(rows: Column) -> Column:
        def step(weights: Column, _: Column) -> Column:
            def moved(slopes: Column) -> Column:
                def one(w: Column, k: Column) -> Column:
                    rise = _sum(slopes, lambda x: x["d"] * F.get(x["features"], k)) - ridge * w
                    return w + rise / (FEATURES * _sum(slopes, lambda x: x["c"] * F.get(x["features"], k)) + ridge)

                return F.transform(weights, one)

            slope = lambda x: _let(
                score(x["features"], weights), lambda p: F.struct(x["features"].alias("features"), (x["n"] * (x["y"] - p)).alias("d"), (x["n"] * p * (1 - p)).alias("c"))
            )
            return _let(F.transform(rows, slope), moved)

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(*[F.lit(0.0)] * FEATURES), step)

    return _let(F.transform(counts, lambda x: F.struct(x["features"].alias("features"), x["n"].alias("n"), chance(x["votes"], rates).alias("y"))), fit)


def features(bits: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(FEATURES - 1)), lambda k: F.getbit(bits, k).cast("double"))


def model(counts: DataFrame) -> DataFrame:
    """A row for each kind: ``rates`` of its labelers and ``weights`` of its classifier."""
    votes = F.array(*[F.col(f"v{k}") for k in range(LABELERS)], F.lit(0))
    own = counts.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct(votes.alias("votes"), "bits", F.col("n").cast("double").alias("n")))).alias("rows"))
    rows = F.transform("rows", lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), features(x["bits"]).alias("features")))
    rated = own.select("kind", rows.alias("rows")).withColumn("rates", reliabilities(F.col("rows")))
    return cut(rated.select("kind", "rates", span_weights(F.col("rows"), F.col("rates")).alias("weights")))


def vote_counts(spans: DataFrame) -> DataFrame:
    """Candidates by kind, votes and features; a bounded table."""
    return spans.where("broad").groupBy("kind", *[f"v{k}" for k in range(LABELERS)], "bits").agg(F.count(F.lit(1)).alias("n"))


def placed(spans: DataFrame, fitted: DataFrame) -> DataFrame:
    """Adds ``start``, ``end`` (code points, exclusive) and ``kept``: valid base matches, and likely candidates of a fitting size apart from them and from earlier ones."""
    likely = score(features(F.col("bits")), F.col("weights")) >= LIKELY
    spans = spans.join(F.broadcast(fitted.select("kind", "weights")), "kind", "left").repartition("row")  # a row for each of four kinds
    along = Window.partitionBy("row", "kind", "broad").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = spans.withColumn("end", F.sum((F.col("gap") + F.col("size")).cast("bigint")).over(along)).withColumn("start", F.col("end") - F.col("size"))
    at = at.withColumn("likely", F.coalesce(F.col("broad") & likely & (F.col("v1") == YES), F.lit(False))).drop("weights")
    ordered = Window.partitionBy("row").rowsBetween(Window.unboundedPreceding, -1)
    up = ordered.orderBy(F.asc_nulls_first("start"), "kind", "broad", "i")
    down = ordered.orderBy(F.desc_nulls_first("start"), F.desc("kind"), F.desc("broad"), F.desc("i"))
    apart = (F.coalesce(F.max(F.when(F.col("valid"), F.col("end"))).over(up), F.lit(0)) <= F.col("start")) & ~F.coalesce(
        F.min(F.when(F.col("valid"), F.col("start"))).over(down) < F.col("end"), F.lit(False)
    )
    alone = at.withColumn("added", F.col("likely") & apart)
    first = F.coalesce(F.max(F.when(F.col("added"), F.col("end"))).over(up), F.lit(0)) <= F.col("start")
    return alone.withColumn("kept", F.coalesce("valid", F.lit(False)) | (F.col("added") & first))


def find(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, base, spans)`` for each row of ``docs``: sorted arrays of ``(start, kind, end)``."""
    spans = cut(spans_of(docs))
    span = F.struct("start", "kind", "end")
    return (
        placed(spans, model(vote_counts(spans)))
        .groupBy("row", "doc_id")
        .agg(F.sort_array(F.collect_list(F.when(F.col("valid"), span))).alias("base"), F.sort_array(F.collect_list(F.when(F.col("kept"), span))).alias("spans"))
    )


def listed(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    name = lambda k: F.get(F.array(*map(F.lit, KINDS)), k)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_private_data(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    of_kind = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(of_kind, k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
