"""Order MinHash fingerprints of texts; DataFrame functions only.

k-mers are ``WORDS`` words long and numbered by their occurrence, so that each stands once.  A hash
puts all k-mers of a text in order on a circle; each of ``BINS`` places on it, evenly spaced, selects the first
``TUPLE`` k-mers from there on, keeps them in the order of the text and hashes the tuple.  So every tuple is drawn
from all k-mers, by an order of its own (the same one, turned), whatever the text's length.  The fingerprint lists
the tuples' hashes.  Two texts' likeness is the share of equal ones.

Nulls: a null text is empty.  A text without words has no tuples; two such are alike (1.0), one such and
another text are not (0.0).  Texts of any length are used whole.  A null id has no next document: its
edited text has lost its last quarter and its likeness to the next is null.  Rows sharing an id have
the same next document, which is the first text (in text order) of the next larger id.  Repeated rows give equal rows each.
Columns besides ``doc_id`` and ``text`` are not read, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haloframe.llm.common import cut

WORDS = 2
BINS = 32
TUPLE = 2
_POSITION_BITS = 28
_HASH_BITS = 35
_BIN_BITS = 5


def _let(value: Column, use) -> Column:
    """``use`` applied to ``value``, which is evaluated once."""
    return F.transform(F.array(value), use)[0]


def signature(text: Column, words: int = WORDS, size: int = TUPLE) -> Column:
    """The array of tuple hashes; the top bits of each hold its place on the circle."""
    low = (1 << _POSITION_BITS) - 1
    kmer_hash = lambda x: F.shiftright(x, _POSITION_BITS)
    bin_of = lambda x: F.shiftright(x, _POSITION_BITS + _HASH_BITS - _BIN_BITS)
    packed = lambda h, position: F.shiftleft(h.bitwiseAND(F.lit((1 << _HASH_BITS) - 1)), _POSITION_BITS).bitwiseOR(position)

    tokens = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def kmers(w: Column) -> Column:
        count = F.greatest(F.size(w) - (words - 1), F.least(F.size(w), F.lit(1)))
        return F.sort_array(
            F.transform(
                F.slice(w, 1, count),
                lambda x, i: packed(F.xxhash64(x, *[F.get(w, i + j) for j in range(1, words)]), i.cast("bigint")),
            )
        )

    def numbered(s: Column) -> Column:
        """Repeated k-mers hashed again with their occurrence; the others as they are."""
        again = lambda x, j: (j > 0) & (kmer_hash(x) == kmer_hash(F.get(s, j - 1)))

        def renumber(dup: Column) -> Column:
            fresh = lambda j: (j == 0) | (kmer_hash(F.get(dup, j)) != kmer_hash(F.get(dup, j - 1)))
            starts = F.filter(F.sequence(F.lit(0), F.size(dup) - 1), fresh)

            def runs(at: Column) -> Column:
                return F.flatten(
                    F.transform(
                        at,
                        lambda a, k: F.transform(
                            F.slice(dup, a + 1, F.coalesce(F.get(at, k + 1), F.size(dup)) - a),
                            lambda x, o: packed(F.xxhash64(kmer_hash(x), o), x.bitwiseAND(F.lit(low))),
                        ),
                    )
                )

            first = F.filter(s, lambda x, j: ~again(x, j))
            return F.when(F.size(dup) == 0, s).otherwise(F.sort_array(F.concat(first, _let(starts, runs))))

        return _let(F.filter(s, again), renumber)

    def tuples(s: Column) -> Column:
        # The first of each bin are all that a place can select, its own bin or bins further on being empty.
        chosen = F.filter(s, lambda x, j: (j < size) | (bin_of(x) != bin_of(F.get(s, j - size))))

        def hashed(q: Column) -> Column:
            circle = F.concat(q, F.slice(q, 1, size - 1))

            def one(b: Column) -> Column:
                start = F.size(F.filter(q, lambda x: bin_of(x) < b)) % F.size(q)
                mates = F.slice(circle, start + 1, F.least(F.size(q), F.lit(size)))
                in_text = F.sort_array(
                    F.transform(mates, lambda y: F.shiftleft(y.bitwiseAND(F.lit(low)), _HASH_BITS).bitwiseOR(kmer_hash(y)))
                )
                order = F.transform(in_text, lambda y: y.bitwiseAND(F.lit((1 << _HASH_BITS) - 1)))
                mask = F.lit((1 << (63 - _BIN_BITS)) - 1)
                return F.shiftleft(b, 63 - _BIN_BITS).bitwiseOR(F.xxhash64(order).bitwiseAND(mask))

            places = F.sequence(F.lit(0).cast("bigint"), F.lit(BINS - 1).cast("bigint"))
            return F.transform(F.when(F.size(q) > 0, places).otherwise(F.array().cast("array<bigint>")), one)

        return _let(chosen, hashed)

    return _let(_let(_let(tokens, kmers), numbered), tuples)


def likeness(a: Column, b: Column) -> Column:
    """Share of places with equal hashes, among the places that either signature has."""
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, 63 - _BIN_BITS))
    used = F.size(F.array_union(bins(a), bins(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(used, F.lit(1)))


def fingerprint(signature_: Column) -> Column:
    return F.array_join(F.transform(signature_, lambda x: F.lower(F.hex(x))), "-")


def next_ids(ids: DataFrame, partitions: int | None = None) -> DataFrame:
    """``doc_id, next_id`` in ascending order, the first behind the last; ids are distinct, not null.

    Ids are dealt out by range; each range is windowed apart, and the ranges' first ids (one row a
    range) join their ends.
    """
    count = partitions or max(1, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(ids.repartitionByRange(count, "doc_id").withColumn("part", F.spark_partition_id()))
    firsts = sorted(tuple(r) for r in ranged.groupBy("part").agg(F.min("doc_id")).collect())
    if not firsts:
        return ranged.select("doc_id", F.col("doc_id").alias("next_id"))
    follow = {part: firsts[(k + 1) % len(firsts)][1] for k, (part, _) in enumerate(firsts)}
    across = ids.sparkSession.createDataFrame(list(follow.items()), "part int, follow bigint")
    ordered = Window.partitionBy("part").orderBy("doc_id")
    return (
        ranged.withColumn("next_id", F.lead("doc_id").over(ordered))
        .join(F.broadcast(across), "part")
        .select("doc_id", F.coalesce("next_id", "follow").alias("next_id"))
    )


def with_next_heads(docs: DataFrame) -> DataFrame:
    """Adds ``next_id`` and ``head``: as much of the next document's start as the edit needs.

    Both joins use one exchange of the texts by ``doc_id``, so rows without an id stay out of them.
    """
    named = docs.where("doc_id IS NOT NULL")
    need = (F.max(F.char_length("text")) / 4).cast("int")
    wanted = cut(named.groupBy("doc_id").agg(need.alias("need")))
    pairs = next_ids(wanted.select("doc_id")).join(wanted, "doc_id").select(F.col("doc_id").alias("to"), "next_id", "need")
    # Renamed here and in the query alike: only equal projections share an exchange.
    following = named.select(F.col("doc_id").alias("next_id"), "text")
    heads = (
        following.join(pairs.hint("merge"), "next_id")
        .select(F.col("to").alias("doc_id"), "next_id", F.expr("left(text, need)").alias("head"))
        .groupBy("doc_id", "next_id")
        .agg(F.min("head").alias("head"))
    )
    unnamed = docs.where("doc_id IS NULL").select("*", F.lit(None).cast("bigint").alias("next_id"), F.lit("").alias("head"))
    return named.join(heads.hint("merge"), "doc_id").unionByName(unnamed)


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")
    )
    size = F.char_length("text")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(char_length(text) div 4 as int))"), F.coalesce(F.expr("left(head, cast(char_length(text) div 4 as int))"), F.lit("")))
    own = cut(
        with_next_heads(docs)
        .select("doc_id", "next_id", "text", edited.alias("edited"), size.cast("bigint").alias("n_chars"))
        .select(
            "doc_id",
            "next_id",
            "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            signature(F.col("text")).alias("own"),
            signature(F.col("edited")).alias("changed"),
        )
    )
    following = own.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("next_id")).agg(F.min("own").alias("following"))
    return own.join(following, "next_id", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
