"""N-gram Jaccard join: the size-aware heavy-light join over sets of word shingles.

Documents with equal sets are one node.  Small sets (up to a size chosen by cost from the sizes of
all sets) enumerate their subsets of the sizes that a link requires: two that meet in one are linked.
Large sets, and the small ones that large ones may link with, go into inverted lists.  Only the
rarest shingles of a set, as many as a link can miss plus one, are listed; which shingles are rare is
taken from a table of counts over all documents.  Lists are scanned for pairs, whose whole sets are
then compared exactly.

Components are wanted, not all pairs.  So each list first compares its members with one of them (long
lists are split, and their parts' pivots compared); then all pairs of one list that are still in
different components are compared, so no link between different components is lost.  Members of long
lists are compared in blocks of bounded size, inside tasks that give back only what connects them.  A block
holds members of one large component, or of small ones, of about one size; two blocks meet if they share a
list, their sizes may link and they are not of one component.

Nulls: null and empty texts, and texts of white space, have no shingles, link with nothing and are
their own component; a null id has a null component, unless an equal or linked text has one.  Rows
sharing an id, and repeated rows, are each linked and given back.  An empty table gives no rows.  Texts of any
length are used whole.  Extra columns are not carried along by ``join`` and are by ``stage``; none clashes.
Hashes of shingles and of sets have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haloframe.llm.common import components, cut, ensure_small_batches, join_hot, join_side, small, text_key
from haloframe.llm.counting import Tally, total
from haloframe.llm.words import hash_words, mix, shingles

WIDTH = 5
PERCENT = 80
COUNTERS = 1 << 20
LIST_PART = 4096
SMALL_MOST = 12
VERIFY_COST = 8.0
SHORT_LIST = 32
BLOCK_SHINGLES = 400_000
BLOCK_LEAST = 400
_TAG = np.uint64(15)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """So many of a set's shingles that one must be shared by any set it links with."""
    return n - -(-n * percent // 100) + 1


def overlap(s: int, t: int, percent: int = PERCENT) -> int:
    """The smallest shared count that links sets of sizes ``s`` and ``t``."""
    return -(-percent * (s + t) // (100 + percent))


def subset_sizes(n: int, most: int, percent: int = PERCENT) -> list[int]:
    """The sizes of subsets that a set of ``n`` shares with a linked set of at most ``most``."""
    partners = range(-(-n * percent // 100), min(most, n * 100 // percent) + 1)
    return sorted({overlap(n, t, percent) for t in partners if t})


def boundary(sizes: dict[int, int], percent: int = PERCENT, most: int = SMALL_MOST) -> int:
    """The size up to which sets enumerate subsets: where the rows to shuffle and compare are fewest."""

    def cost(x: int) -> float:
        enumerate_ = sum(c * sum(comb(n, k) for k in subset_sizes(n, x, percent)) for n, c in sizes.items() if n <= x)
        return enumerate_ + sum(c * prefix_size(n, percent) * (1 + VERIFY_COST) for n, c in sizes.items() if x < n <= most)

    return min(range(most + 1), key=cost)


def _node(own: np.ndarray) -> int:
    """The identity of a set: a hash of its sorted shingles."""
    if not len(own):
        return 0
    sums = np.bitwise_xor.reduce(mix(own + np.uint64(1)), keepdims=True) + np.sum(own, keepdims=True) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(sums).view(np.int64)[0])


def _summary(width: int):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, names = Tally(COUNTERS), ["doc_id", "node", "n", "block", "counts", "key"]
        for batch in batches:
            nodes, sizes = [], []
            for words in hash_words(batch.column(1)):
                own = shingles(words, width)
                tally.add((own & np.uint64(COUNTERS - 1)).astype(np.int64))
                nodes.append(_node(own))
                sizes.append(len(own))
            none = [None] * len(nodes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(none, pa.int32()), pa.array(none, pa.binary()), batch.column(2)],
                names=names,
            )
        for k, counts in tally.blocks():
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in ((None, pa.int64()), (None, pa.int64()), (None, pa.int32()), (k, pa.int32()), (counts, pa.binary()), (None, pa.binary()))],
                names=names,
            )

    return summarise


def _signatures(width: int, percent: int, most: int, counts: np.ndarray):
    """Per row: node, size, listed shingles (rarest first), subset keys.

    The low four bits of a listed shingle hold the power of two of the parts its list is split into,
    those of a subset key the subset's size.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, lists, keys = [], [], [], []
            for words in hash_words(batch.column(0)):
                own = shingles(words, width)
                n = len(own)
                listed = own[:0]
                if n > most or 100 * n >= percent * (most + 1):
                    seen = counts[(own & np.uint64(COUNTERS - 1)).astype(np.int64)]
                    first = np.lexsort((own, seen))[: prefix_size(n, percent)] if n else []
                    parts = np.ceil(np.log2(np.maximum(seen[first] / LIST_PART, 1))).astype(np.uint64)
                    listed = (own[first] & ~_TAG) | np.minimum(parts, _TAG)
                subsets = [
                    (int(mix(np.sum(mix(own[list(s)] + np.uint64(k)), keepdims=True))[0]) & ~15) | k
                    for k in (subset_sizes(n, most, percent) if 0 < n <= most else ())
                    for s in combinations(range(n), k)
                ]
                nodes.append(_node(own))
                sizes.append(n)
                lists.append(listed.view(np.int64))
                keys.append(np.asarray(subsets, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(lists, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                names=["node", "n", "listed", "subsets"],
            )

    return sign


def _sets(width: int):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                own = [shingles(w, width) for w in hash_words(batch.column(0).slice(at, 200))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_node(o) for o in own], pa.int64()), pa.array([o.view(np.int64) for o in own], pa.list_(pa.int64()))],
                    names=["node", "shingles"],
                )

    return whole


def _small_links(signed: DataFrame) -> DataFrame:
    """Links between small sets: each subset links its members with the smallest of them."""
    rows = signed.select("node", "n", F.explode("subsets").alias("subset"))
    pivot = rows.groupBy("subset").agg(F.min(F.struct("n", "node")).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return (
        rows.join(pivot, "subset")
        .where("node <> p.node")
        .where(F.ceil(F.lit(PERCENT) * (F.col("n") + F.col("p.n")) / (100 + PERCENT)) <= F.col("subset").bitwiseAND(F.lit(15)))
        .select(F.col("node").alias("a"), F.col("p.node").alias("b"))
    )


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets are similar enough."""
    both = (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
        .select("a", "b", F.size("left").alias("m"), F.size("right").alias("n"), F.size(F.array_intersect("left", "right")).alias("both"))
    )
    return both.where((100 * F.col("both")).cast("bigint") >= percent * (F.col("m") + F.col("n") - F.col("both")).cast("bigint")).select("a", "b")


def _compatible(m: Column, n: Column, percent: int) -> Column:
    return F.least(m, n) * 100 >= F.greatest(m, n) * percent


def _could_link(m: Column, n: Column, shared: Column, percent: int) -> Column:
    """Whether sets of sizes ``m`` and ``n`` may be linked if they share so many listed shingles.

    Of the set whose listed shingles end first, what it shares is listed in both, or not listed.
    """
    rest = F.greatest(F.ceil(m * percent / 100), F.ceil(n * percent / 100)) - 1
    return shared + rest >= F.ceil((m + n) * percent / (100 + percent))


def _mixed(lists: DataFrame, found: DataFrame) -> DataFrame:
    """The lists whose members are in more than one component."""
    placed = lists.select("shingle", "node", "n").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = cut(placed.select("shingle", "node", "n", "component"))
    mixed = placed.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("members"))
    return cut(placed.join(mixed.where("x <> y").select("shingle", "members"), "shingle"))


def _stars(lists: DataFrame, percent: int) -> DataFrame:
    """Each node paired with the pivot that it shares most lists with."""
    heavy = lists.where(F.col("shingle").bitwiseAND(F.lit(15)) > 0)
    head = heavy.groupBy("shingle").agg(F.min("pivot").alias("first"))
    across = heavy.select("shingle", "pivot").distinct().join(head, "shingle").where("pivot.node <> first.node")
    across = across.select(F.col("first.node").alias("a"), F.col("pivot.node").alias("b"), F.col("first.n").alias("m"), F.col("pivot.n").alias("n"))
    own = lists.where("pivot.node <> node").groupBy(F.col("pivot.node").alias("a"), F.col("node").alias("b"), F.col("pivot.n").alias("m"), "n").count()
    possible = _compatible(F.col("m"), F.col("n"), percent) & _could_link(F.col("m"), F.col("n"), F.col("count"), percent)
    best = own.where(possible).groupBy("b").agg(F.max(F.struct("count", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    return best.unionByName(across.where(_compatible(F.col("m"), F.col("n"), percent)).select("a", "b")).distinct()


def _short_pairs(mixed: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Pairs of short lists in different components, without those that share too few of them.

    A pair that also shares a long list may be missed here; it meets in a block.
    """
    right = mixed.toDF("shingle", *(f"{c}_2" for c in mixed.columns[1:]))
    apart = (F.col("node") < F.col("node_2")) & (F.col("component") != F.col("component_2"))
    pairs = (
        mixed.join(right, "shingle")
        .where(apart & _compatible(F.col("n"), F.col("n_2"), percent))
        .groupBy(F.col("node").alias("a"), F.col("node_2").alias("b"), "n", "n_2")
        .count()
        .where(_could_link(F.col("n"), F.col("n_2"), F.col("count"), percent))
        .select("a", "b")
    )
    return pairs.join(tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")


def _blocks(mixed: DataFrame, percent: int) -> DataFrame:
    """The members of long lists in pairs of blocks: ``i, j, node, side``.

    A unit is the members of one component and size band that fill a block of their own, or else those that
    have the same longest list; a hash deals a unit into blocks of about ``BLOCK_SHINGLES`` shingles or
    ``BLOCK_SHINGLES / BLOCK_LEAST`` sets.  So a task holds two blocks, however large a list is.
    """
    step = 1.001 * 100 / percent  # sets more than a band apart are too unequal to link
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(step))).cast("int")
    nodes = cut(mixed.groupBy("node", "n", "component").agg(F.max(F.struct("members", "shingle"))["shingle"].alias("longest")).withColumn("band", band))
    weight = F.sum(F.greatest("n", F.lit(BLOCK_LEAST)).cast("bigint")).alias("weight")
    large = nodes.groupBy("component", "band").agg(weight).where(F.col("weight") >= BLOCK_SHINGLES)
    large = cut(large.select(F.xxhash64("component", "band").alias("key"), F.lit(True).alias("pure")))
    keyed = join_side(nodes.withColumn("key", F.xxhash64("component", "band")), large, ["key"], 16, spread="node")
    united = keyed.withColumn("pure", F.coalesce("pure", F.lit(False))).withColumn("unit", F.when(F.col("pure"), F.col("key")).otherwise(F.xxhash64("longest", "band", F.lit("pool"))))
    united = cut(united.select("node", "n", "component", "band", "pure", "unit"))
    blocks = cut(united.groupBy("unit").agg(weight).select("unit", F.ceil(F.col("weight") / BLOCK_SHINGLES).alias("blocks")))
    number = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = join_side(united, blocks, ["unit"], 16, spread="node").select("node", "component", "band", "pure", F.xxhash64("unit", number).alias("block"))
    dealt = cut(dealt)
    only = F.when(F.col("pure"), F.col("component")).alias("only")
    seen = cut(mixed.select("shingle", "node").join(dealt, "node").select("shingle", "block", "band", only).distinct())
    other = seen.toDF("shingle", "block_2", "band_2", "only_2")
    apart = (F.abs(F.col("band") - F.col("band_2")) <= 1) & ~F.coalesce(F.col("only") == F.col("only_2"), F.lit(False))
    pairs = cut(seen.join(other, "shingle").where((F.col("block") <= F.col("block_2")) & apart).select(F.col("block").alias("i"), F.col("block_2").alias("j")).distinct())
    member = dealt.select("block", "node")
    left = pairs.join(member.withColumnRenamed("block", "i"), "i").select("i", "j", "node", F.lit(0).alias("side"))
    right = pairs.where("i <> j").join(member.withColumnRenamed("block", "j"), "j").select("i", "j", "node", F.lit(1).alias("side"))
    return cut(left.unionByName(right))


def _block_links(percent: int):
    """Links between two blocks, or inside one, as few as connect what is linked."""

    def compare(table: pa.Table) -> pa.Table:
        nodes, side = table.column("node").to_numpy(), table.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        lists = table.column("shingles").combine_chunks()
        flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.argsort(order), sizes)  # places after sorting by side
        nodes, sizes, first = nodes[order], sizes[order], int((side == 0).sum())
        second = first if first < len(nodes) else 0  # one block is compared with itself
        _, slot, seen = np.unique(flat, return_inverse=True, return_counts=True)
        shared = seen[slot] > 1
        _, slot = np.unique(slot[shared], return_inverse=True)
        owner, both = owner[shared], np.zeros((first, len(nodes) - second), np.float32)
        by = np.argsort(slot, kind="stable")
        slot, owner = slot[by], owner[by]
        for at in range(0, int(slot[-1]) + 1 if len(slot) else 0, 512):
            lo, hi = np.searchsorted(slot, [at, at + 512])
            held = np.zeros((len(nodes), 512), np.float32)
            held[owner[lo:hi], slot[lo:hi] - at] = 1
            both += held[:first] @ held[second:].T
        union = sizes[:first, None] + sizes[None, second:] - both
        linked = 100 * both >= percent * union
        a, b, waiting = [], [], np.ones(len(nodes), bool)
        for start in range(first):
            if waiting[start]:
                front, waiting[start] = np.array([start]), False
                while len(front):
                    there = np.flatnonzero(linked[front[front < first]].any(axis=0)) + second
                    back = np.flatnonzero(linked[:, front[front >= second] - second].any(axis=1))
                    found = np.union1d(there, back)
                    found = found[waiting[found]]
                    waiting[found] = False
                    a += [nodes[start]] * len(found)
                    b += nodes[found].tolist()
                    front = found
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return compare


def _in_lists(listed: DataFrame, by: list[str]) -> DataFrame:
    """``shingle, node, n`` with the count and the smallest node of the list (or its part) as its pivot."""
    own = Window.partitionBy(*by)
    pivot = F.min(F.struct("node", "n")).over(own)
    return listed.withColumn("c", F.count(F.lit(1)).over(own)).withColumn("pivot", pivot).select("shingle", "node", "n", "c", "pivot")


def _linked(docs: DataFrame, width: int, percent: int, key: Column) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs`` ``doc_id, node, n, key``, and ``node, component`` of the nodes with links."""
    ensure_small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", key.alias("key"))
    summary = cut(rows.mapInArrow(_summary(width), "doc_id bigint, node bigint, n int, block int, counts binary, key binary"))
    members = summary.where("block IS NULL").select("doc_id", "node", "n", "key")
    counts = np.minimum(total(summary.where("block IS NOT NULL"), COUNTERS), (1 << 32) - 1).astype(np.uint32)
    sizes = members.where(F.col("n").between(1, SMALL_MOST)).groupBy("n").agg(F.countDistinct("node")).collect()
    most = boundary(dict(map(tuple, sizes)), percent)

    signed = (
        rows.select("text")
        .mapInArrow(_signatures(width, percent, most, counts), "node bigint, n int, listed array<bigint>, subsets array<bigint>")
        .where("n > 0")
        .dropDuplicates(["node"])
    )
    signed = cut(signed)

    exponent = F.col("shingle").bitwiseAND(F.lit(15))
    listed = signed.select("node", "n", F.explode("listed").alias("shingle"))
    lists = cut(
        _in_lists(listed.where(exponent == 0), ["shingle"])
        .where("c > 1")
        .unionByName(_in_lists(listed.where(exponent > 0).withColumn("part", F.pmod("node", F.pow(F.lit(2), exponent).cast("bigint"))), ["shingle", "part"]))
        .drop("c")
    )
    no_id = F.lit(-(1 << 63))
    holders = cut(members.where("n > 0").groupBy("node").agg(F.min(F.coalesce("doc_id", no_id)).alias("holder")))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), no_id).alias("holder"), "text")
    once = members.agg(F.count(F.lit(1)) == F.countDistinct("doc_id")).first()[0]

    def sets_of(nodes: DataFrame) -> DataFrame:
        """The whole sets of ``nodes``, hashed again from the texts, so that no others are ever written."""
        wanted = cut(holders.join(nodes.distinct(), "node", "left_semi").select("holder").distinct())
        sets = texts.join(small(wanted), "holder", "left_semi").select("text").mapInArrow(_sets(width), "node bigint, shingles array<bigint>")
        return cut(sets if once else sets.dropDuplicates(["node"]))

    starred = cut(_stars(lists, percent))
    links = _small_links(signed).unionByName(_verified(starred, sets_of(_ends(starred)), percent))
    found = cut(components(links))
    mixed = _mixed(lists, found)
    if mixed.isEmpty():
        return members, found
    short = cut(_short_pairs(mixed.where(F.col("members") <= SHORT_LIST).drop("members"), starred, percent))
    wanted, blocks = _ends(short), None
    long = mixed.where(F.col("members") > SHORT_LIST)
    if not long.isEmpty():
        blocks = _blocks(long, percent)
        wanted = wanted.unionByName(blocks.select("node"))
    sets = sets_of(wanted)
    extra = _verified(short, sets, percent)
    if blocks is not None:
        extra = extra.unionByName(blocks.join(sets, "node").groupBy("i", "j").applyInArrow(_block_links(percent), "a bigint, b bigint"))
    return members, components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(extra))


def _lowest(present: DataFrame, final: DataFrame, value: Column) -> DataFrame:
    """``node, low``: the smallest ``value`` among all rows of the node's component."""
    own = present.groupBy("node").agg(F.min(value).alias("low"))
    placed = cut(own.join(final, "node", "left").select("node", "low", F.coalesce("component", "node").alias("root")))
    smallest = placed.groupBy("root").agg(F.min("low").alias("lowest"))
    return cut(join_hot(placed, smallest, "root", "node").select("node", F.col("lowest").alias("low")))


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``."""
    members, final = _linked(docs, width, percent, F.lit(None).cast("binary"))
    present = members.where("n > 0")
    named = _lowest(present, final, F.col("doc_id")).withColumnRenamed("low", "component_id")
    linked = join_hot(present, named, "node", "doc_id").select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id")
    alone = members.where("n = 0").select("doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the one with the smallest id (nulls last), then the smallest hash of its text.

    A row is told by its id and a hash of its whole text, so texts that share an id, or have none, are judged
    each on its own.  Rows equal in both are one.  Rows without shingles are linked with no other text.
    """
    members, final = _linked(docs, WIDTH, PERCENT, text_key(F.col("text")))
    rows = cut(members.groupBy("doc_id", "key", "node", "n").agg(F.count(F.lit(1)).alias("times")))
    present = rows.where("n > 0")
    own = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    lowest = present.groupBy("node").agg(own.alias("low")).join(final, "node", "left").groupBy(F.coalesce("component", "node").alias("root")).agg(F.min("low").alias("low"))
    mark = [F.col("doc_id").alias("__halo_doc"), F.col("key").alias("__halo_key")]
    first = lowest.select(F.col("low.doc_id").alias("__halo_doc"), F.col("low.key").alias("__halo_key"))
    named = present.select(*mark)
    gone = named.join(first, named["__halo_doc"].eqNullSafe(first["__halo_doc"]) & (named["__halo_key"] == first["__halo_key"]), "left_anti")
    repeated = cut(rows.where("times > 1").select(*mark))
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col("__halo_doc")) & (text_key(docs["text"]) == F.col("__halo_key"))
    kept = docs.join(small(cut(gone)), same, "left_anti")
    if repeated.isEmpty():
        return kept
    repeated = small(repeated)
    return kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))
