"""Exact percentiles of weighted values per group in bounded memory.

A percentile aggregate keeps every distinct value of a group in one buffer. Here a group whose values
are few is given to it as before; groups with more are narrowed down by histograms first: each round
counts the weight in `BINS` equal steps between the least and largest value that may still be the
answer, and goes on inside the step that holds the wanted rank. A task keeps `BINS` counters a wanted
rank, however many values there are, and the result is the same to the last digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelstat import session

BINS = 1_024
MAX_VALUES = 100_000  # distinct values of a group that one buffer may hold


def weighted(df: DataFrame, keys: list[str], value: str, n: str, shares: list[float], name: str, max_values: int = MAX_VALUES) -> DataFrame:
    """(keys, name): array of the percentiles ``shares`` of ``value``, each row standing for ``n`` equal ones.

    Between two ranks the values are interpolated. Rows without a value, or standing for none, take no
    part; a group without others has no row. Runs jobs; ``df`` is run once.
    """
    cells = df.where(F.col(value).isNotNull() & (F.col(n) > 0)).groupBy(*keys, F.col(value).cast("double").alias("__v"))
    cells = session.checkpoint(cells.agg(F.sum(F.col(n).cast("long")).alias("__n")))
    sizes = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__values"), F.sum("__n").alias("__total"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")
    )
    largest = sizes.agg(F.max("__values")).first()[0] or 0
    if largest <= max_values:
        return cells.groupBy(*keys).agg(F.percentile("__v", F.array(*[F.lit(float(q)) for q in shares]), F.col("__n")).alias(name))
    place = [F.struct(F.lit(i).alias("__q"), ((F.col("__total") - 1) * F.lit(float(q))).alias("__at")) for i, q in enumerate(shares)]
    wanted = session.checkpoint(sizes.select(*keys, "__lo", "__hi", "__total", F.inline(F.array(*place))))
    ranks = wanted.select(
        *keys, "__lo", "__hi", F.explode(F.array_distinct(F.array(F.floor("__at"), F.ceil("__at")))).alias("__rank")
    ).distinct()
    found = _ranked(cells, ranks, keys)
    # both neighbours of a place between two ranks
    both = wanted.withColumn("__rank", F.explode(F.array_distinct(F.array(F.floor("__at"), F.ceil("__at")))))
    both = both.drop("__lo", "__hi").join(session.small_side(found), [*keys, "__rank"]) if keys else both.drop("__lo", "__hi").join(found, "__rank")
    low, high = F.floor("__at"), F.ceil("__at")
    share = F.when(low == high, 1.0).when(F.col("__rank") == low, high - F.col("__at")).otherwise(F.col("__at") - low)
    each = both.groupBy(*keys, "__q").agg(F.sum(share * F.col("__v")).alias("__x"))
    ordered = F.array_sort(F.collect_list(F.struct("__q", "__x")))
    return each.groupBy(*keys).agg(F.transform(ordered, lambda x: x["__x"]).alias(name))


def _ranked(cells: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __rank, __v): the value at each rank (from 0) of (keys, __lo, __hi, __rank) rows."""
    at = [*keys, "__rank"]
    state = session.checkpoint(ranks.withColumn("__left", F.col("__rank")))
    done = []
    while True:
        settled = F.col("__lo") == F.col("__hi")
        done.append(state.where(settled).select(*at, F.col("__lo").alias("__v")))
        state = state.where(~settled)
        if state.isEmpty():
            break
        side = session.small_side(state)
        met = cells.join(side, keys) if keys else cells.join(F.broadcast(state), F.col("__v").between(F.col("__lo"), F.col("__hi")))
        met = met.where(F.col("__v").between(F.col("__lo"), F.col("__hi")))
        # halves keep the span of extreme values finite
        step = (F.col("__v") / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2) * BINS
        step = F.when(F.col("__v") == F.col("__hi"), BINS).otherwise(F.least(F.floor(step), F.lit(BINS - 1)))
        bins = met.groupBy(*at, "__left", step.alias("__bin")).agg(
            F.sum("__n").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")
        )
        upto = F.sum("__n").over(W.partitionBy(*at).orderBy("__bin"))
        bins = bins.withColumn("__upto", upto).where((F.col("__upto") > F.col("__left")) & (F.col("__upto") - F.col("__n") <= F.col("__left")))
        state = session.checkpoint(
            bins.select(*at, "__lo", "__hi", (F.col("__left") - F.col("__upto") + F.col("__n")).alias("__left"))
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return session.checkpoint(out)
