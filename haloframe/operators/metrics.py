"""Metrics of a trace, and rebalancing criteria as folds over it.

Windows have no key beyond the run because a run is one short series: an entry for each iteration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haloframe.sources.traces import RANKS


def iteration_stats(trace: DataFrame, ranks: int = RANKS, keys: tuple[str, ...] = ("iteration",)) -> DataFrame:
    """Per iteration (of each run, with ``run`` among ``keys``) the times of its ranks; the mean is over ``ranks``, present or not."""
    own = trace.groupBy(*keys).agg(F.max("it_time").alias("max_it"), F.min("it_time").alias("min_it"), F.sum("it_time").alias("sum_it"))
    avg = F.col("sum_it") / F.lit(float(ranks))
    return own.withColumn("avg_it", avg).withColumn("imbalance", F.try_divide("max_it", avg) - 1).withColumn("imbalance_time", F.col("max_it") - avg).withColumn(
        "efficiency", F.try_divide(avg, F.col("max_it"))
    )


def ordered(run: str = "run") -> Window:
    return Window.partitionBy(run).orderBy("iteration")


def epochs(stats: DataFrame, every: int) -> DataFrame:
    """Cumulative series since the last rebalancing, for one every ``every`` iterations."""
    own = stats.withColumn("lb", (F.col("iteration") + 1) % every == 0).withColumn("epoch", F.sum(F.col("lb").cast("int")).over(ordered()))
    since = Window.partitionBy("run", "epoch").orderBy("iteration")
    own = own.withColumn("baseline", F.first("imbalance_time").over(since))
    return own.withColumns(
        {
            "cum_imbalance": F.sum(F.greatest(F.lit(0.0), F.col("imbalance_time") - F.col("baseline"))).over(since),
            "van_cum_imbalance": F.sum("imbalance_time").over(since),
            "lb_interval_time": F.sum("max_it").over(since),
            "lb_effort": F.sum("max_it").over(since) / F.count(F.lit(1)).over(since),
        }
    )


def lagged(stats: DataFrame) -> DataFrame:
    """Decisions are taken before an iteration, from the metrics of the one before (0 at first)."""
    return stats.select(
        "run",
        "iteration",
        F.lag("max_it", 1, 0.0).over(ordered()).alias("max_it"),
        F.lag("min_it", 1, 0.0).over(ordered()).alias("min_it"),
        F.lag("sum_it", 1, 0.0).over(ordered()).alias("sum_it"),
    ).withColumn("u", F.col("max_it") - F.col("sum_it") / F.lit(float(RANKS)))


#: The last three values of the series since the last rebalancing, the row's own included.
_TAIL = "concat(if(size(s.tail) = 3, slice(s.tail, 2, 2), s.tail), array(x.max_it))"

#: Per criterion the state's start and, as SQL over ``s`` (state) and ``x`` (row), the next state; ``dec`` is the decision.
FOLDS: dict[str, tuple[dict[str, str], dict[str, str], str]] = {
    "menon": ({"cum": "0D"}, {"cum": "s.cum + x.u"}, "n.cum >= {c}"),
    "improved": (
        {"cum": "0D", "base": "0D", "fresh": "true"},
        {"base": "if(s.fresh, x.u, s.base)", "cum": "s.cum + greatest(0D, x.u - if(s.fresh, x.u, s.base))"},
        "n.cum >= {c}",
    ),
    "nomax": (
        {"cum": "0D", "base": "0D", "fresh": "true"},
        {"base": "if(s.fresh, x.u, s.base)", "cum": "s.cum + (x.u - if(s.fresh, x.u, s.base))"},
        "n.cum >= {c}",
    ),
    # The mean of a series' differences is its last value over its length, so the series need not be kept.
    # Intervals are unsigned 32-bit numbers: an imbalance that does not grow asks for the largest one.
    "offline": (
        {"prev": "0L", "n": "0L"},
        {"prev": "s.prev", "n": "s.n + if(x.iteration > 0, 1L, 0L)"},
        "pmod(n.prev + if(n.n > 0 and x.u > 0, cast(floor(sqrt(2 * {c} / (x.u / greatest(n.n, 1L)))) as bigint), 4294967295L), 4294967296L) <= x.iteration",
    ),
    "zhai": (
        {"cum": "0D", "total": "0D", "n": "0L", "tail": "cast(array() as array<double>)"},
        {
            "cum": f"s.cum + if(x.iteration > 0, element_at(array_sort({_TAIL}), cast(size({_TAIL}) div 2 as int) + 1) - (s.total + x.max_it) / (s.n + 1), 0D)",
            "total": "s.total + if(x.iteration > 0, x.max_it, 0D)",
            "n": "s.n + if(x.iteration > 0, 1L, 0L)",
            "tail": f"if(x.iteration > 0, {_TAIL}, s.tail)",
        },
        "n.cum >= {c}",
    ),
    "bastien": ({"cum": "0D", "tau": "1L"}, {"cum": "s.cum + x.u", "tau": "s.tau"}, "n.tau * x.u - n.cum >= {c}"),
}


def fold(rows: DataFrame, kind: str, cost: float) -> DataFrame:
    """``run, iteration, decision``: the criterion replayed over each run's ordered series."""
    start, update, decide = FOLDS[kind]
    dec = decide.format(c=f"{cost}D")
    names = [k for k in start if k != "fresh"]
    begin = ", ".join(f"'{k}', {v}" for k, v in start.items())
    new = ", ".join(f"'{k}', {update[k]}" for k in names)
    reset = {
        "tau": "if(n.dec, 1L, n.tau + 1)",
        "cum": "if(n.dec, 0D, n.cum)",
        "base": "n.base",
        "prev": "if(n.dec, x.iteration, n.prev)",
        "n": "if(n.dec, 0L, n.n)",
        "total": "if(n.dec, 0D, n.total)",
        "tail": "if(n.dec, cast(array() as array<double>), n.tail)",
    }
    kept = ", ".join(f"'{k}', {reset[k]}" for k in names) + (", 'fresh', n.dec or x.iteration = 0" if "fresh" in start else "")
    # The new state is bound once by a one-element transform, the decision beside it.
    merge = (
        f"transform(transform(array(named_struct({new})), n -> named_struct({', '.join(f"'{k}', n.{k}" for k in names)}, 'dec', {dec})),"
        f" n -> named_struct({kept}, 'found', if(n.dec, concat(s.found, array(x.iteration)), s.found)))[0]"
    )
    series = rows.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("iteration", "u", "max_it"))).alias("series"))
    folded = series.select(
        "run",
        F.expr(f"aggregate(series, named_struct({begin}, 'found', cast(array() as array<bigint>)), (s, x) -> {merge})").alias("end"),
    )
    return folded.select("run", F.explode("end.found").alias("iteration"))


def procassini(stats: DataFrame, factors: list[float], cost: float, frame: int, initial: float = 1.0) -> DataFrame:
    """``run, iteration, at, arg, decision`` for each factor (``arg``, at place ``at``): whether the last frame's time, scaled by the last efficiency over the mean of all so
    far (``initial`` being the one before the first iteration) plus the cost, is less than the factor times that frame's time."""
    seen = ordered().rowsBetween(Window.unboundedPreceding, -1)
    efficiency = F.coalesce("efficiency", F.lit(0.0))
    own = stats.select(
        "run",
        "iteration",
        (F.col("iteration") - F.col("iteration") % frame).alias("start"),
        F.lag(efficiency).over(ordered()).alias("last"),
        ((F.coalesce(F.sum(efficiency).over(seen), F.lit(0.0)) + initial) / (F.count(F.lit(1)).over(seen) + 1)).alias("mean"),
    )
    times = stats.groupBy("run", (F.col("iteration") - F.col("iteration") % frame + frame).alias("start")).agg(F.sum("max_it").alias("time"))
    joined = own.join(times, ["run", "start"], "left").select("*", F.posexplode(F.array(*[F.lit(float(f)) for f in factors])).alias("at", "arg"))
    fires = F.col("time") * F.try_divide("last", "mean") + F.lit(float(cost)) < F.col("arg") * F.col("time")
    return joined.select("run", "iteration", "at", "arg", F.coalesce(fires, F.lit(False)).alias("decision"))


def reproduce(stats: DataFrame, scenario: DataFrame) -> DataFrame:
    """``iteration, decision``: the iterations that a scenario (``iteration``) names."""
    fires = scenario.select("iteration", F.lit(True).alias("fires")).distinct()
    return stats.join(fires, "iteration", "left").select("iteration", F.coalesce("fires", F.lit(False)).alias("decision"))


def produced(steps: list[tuple[int, int]]) -> list[int]:
    """Running sums of steps, each taken so many times."""
    out, at = [], 0
    for step, times in steps:
        for _ in range(times):
            at += step
            out.append(at)
    return out


# The default sweep's (step, repetitions) of each kind with an argument.
PERIODS = [1, *produced([(25, 4), (50, 10), (100, 4)])]
FACTORS = [x / 100 for x in produced([(25, 6), (50, 9), (100, 5), (200, 2)])]
TOLERANCES = [x / 100 for x in produced([(500, 1), (100, 5), (125, 4), (250, 2), (500, 2), (1000, 1)])]
# The sweep's criteria without an argument, in its order.
PLAIN = [("BBCriterion", "bastien"), ("Static", None), ("VMenon", "menon"), ("OMenon", "offline"), ("PMenon", "nomax"), ("ZMenon", "zhai"), ("BBCriterion", "bastien")]


def sweep(stats: DataFrame, cost: float, frame: int) -> DataFrame:
    """``config, name, decisions``: how often each configuration of the default sweep would rebalance a trace."""
    rows, at = lagged(stats), len(PLAIN)
    total = lambda df, config, name: df.agg(F.count(F.lit(1)).alias("decisions")).select(F.lit(config).cast("bigint").alias("config"), F.lit(name).alias("name"), "decisions")
    parts = [total(fold(rows, kind, cost) if kind else rows.limit(0), k, name) for k, (name, kind) in enumerate(PLAIN)]

    def named(df: DataFrame, prefix: str, start: int, scale: int) -> DataFrame:
        label = F.concat(F.lit(prefix), (F.col("arg") * scale).cast("int").cast("string"))
        hits = df.groupBy("at", "arg").agg(F.count_if("decision").alias("decisions"))
        return hits.select((F.col("at") + start).cast("bigint").alias("config"), label.alias("name"), "decisions")

    each = lambda df, values: df.select("*", F.posexplode(F.array(*[F.lit(float(v)) for v in values])).alias("at", "arg"))
    avg = F.col("sum_it") / F.lit(float(RANKS))
    parts.append(named(each(rows, PERIODS).withColumn("decision", (F.col("iteration") + 1) % F.col("arg") == 0), "Periodic_", at, 1))
    own = procassini(stats, FACTORS, cost, frame)
    parts.append(named(own, "Procassini_", at + len(PERIODS), 100))
    outside = (F.col("min_it") < avg * (1 - F.col("arg"))) | (avg * (1 + F.col("arg")) < F.col("max_it"))
    parts.append(named(each(rows, TOLERANCES).withColumn("decision", outside), "Marquez_", at + len(PERIODS) + len(FACTORS), 100))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
