"""Running values of long ordered series, in two passes over blocks of them.

Rows are ranged by key and order into blocks, one a task.  Each block is scanned by itself, its totals are put together, and what
comes before a block is added to its values.  So a series of any length is spread over all tasks: every window has the block
among its keys.  Only series that reach over a block's end have totals to add, two rows a block at most.

Values: ``sum``, ``count``, ``min``, ``max`` and ``last`` (the last one that is not null).  Nulls add nothing; where nothing has been
seen, a count is 0 and all else null.  Rows of one place in the order are taken in any order, but never parted from each other's
block.  Null keys make a series of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haloframe.plans.session import cut

#: Blocks where no number is given: as many as the session's shuffles have tasks, but no more than this.
MOST_BLOCKS = 2_000

_TOGETHER = {
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "count": lambda a, b: a + b,
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
    "last": lambda a, b: F.coalesce(b, a),
}


def blocked(rows: DataFrame, keys: list[str], order: list[str], blocks: int | None = None) -> DataFrame:
    """``rows`` with ``block``, written to the shared folder: ranges by ``keys`` and ``order``, numbered in that order."""
    count = blocks or min(MOST_BLOCKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(rows.repartitionByRange(count, *keys, *order).withColumn("block", F.spark_partition_id()))


def scan(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]], inclusive: bool = True, reverse: bool = False) -> DataFrame:
    """``rows`` of ``blocked`` with a column for each of ``values`` (a kind and what it is of), over the rows up to each one.

    Not ``inclusive``: over the rows before it.  In ``reverse``: from the end backwards.  The keys may be finer than the blocks'
    (they begin with the same ones), as long as each series lies in one stretch of the blocks' order.
    """
    ends = [F.desc(c) if reverse else F.asc(c) for c in order]
    within = Window.partitionBy(*keys, "block").orderBy(*ends).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    windowed = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    place = F.struct(*order)

    def whole(kind: str, c: Column) -> Column:
        if kind != "last":
            return windowed[kind](c)
        return (F.min_by if reverse else F.max_by)(c, F.when(c.isNotNull(), place))

    totals = rows.groupBy(*keys, "block").agg(*[whole(kind, c).alias(f"total{k}") for k, (kind, c) in enumerate(values.values())])
    block = F.struct("block", *[f"total{k}" for k in range(len(values))])
    series = totals.groupBy(*keys).agg(F.sort_array(F.collect_list(block), asc=not reverse).alias("held")).where(F.size("held") > 1)

    def before(k: int, kind: str, i: Column) -> Column:
        start = F.get(F.transform("held", lambda x: x[f"total{k}"]), F.lit(0))
        rest = F.transform(F.slice("held", 2, i - 1), lambda x: x[f"total{k}"])
        return F.aggregate(rest, start, lambda a, b: _TOGETHER[kind](a, b).cast(totals.schema[f"total{k}"].dataType))

    offsets = F.transform("held", lambda x, i: F.when(i > 0, F.struct(x["block"].alias("block"), *[before(k, kind, i).alias(f"before{k}") for k, (kind, _) in enumerate(values.values())])))
    added = series.select(*[F.col(c).alias(f"of_{c}") for c in keys], F.explode(F.filter(offsets, lambda x: x.isNotNull())).alias("x")).select(*[f"of_{c}" for c in keys], F.col("x.block").alias("of_block"), *[f"x.before{k}" for k in range(len(values))])
    local = rows.withColumns({f"own{k}": windowed[kind](c).over(within) for k, (kind, c) in enumerate(values.values())})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in keys], F.col("block") == F.col("of_block"))
    joined = local.join(F.broadcast(added), same, "left")  # at most two rows a block
    found = {}
    for k, (name, (kind, _)) in enumerate(values.items()):
        first = F.coalesce(f"before{k}", F.lit(0)) if kind == "count" else F.col(f"before{k}")
        found[name] = _TOGETHER[kind](first, F.col(f"own{k}")).cast(totals.schema[f"total{k}"].dataType)
    return joined.select(*rows.columns, *[c.alias(name) for name, c in found.items()])
