"""Rows dealt to parts that follow an order, so that neighbours and ranks are found part by part."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most parts: bounds the list of boundaries that the driver and the plan hold.
MOST_PARTS = 20_000


def part_count(rows: DataFrame) -> int:
    """Four parts a shuffle partition."""
    return min(MOST_PARTS, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def below(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are less than value, by two short lists instead of one long."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    runs = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    numbers = lambda run: F.array(*[F.lit(x).cast("long") for x in run])
    whole = F.size(F.filter(numbers([run[-1] for run in runs]), lambda x: x < value))
    rest = F.size(F.filter(F.get(F.array(*[numbers(run) for run in runs]), whole), lambda x: x < value))
    return F.when(whole < len(runs), whole * step + rest).otherwise(len(bounds))


def order_parts(rows: DataFrame, first: Column, second: Column, n: int) -> Column:
    """A number of each row's part: rows with less (first, second) have a less number or the same.

    first and second are long and not null. Boundaries are quantiles of first. A value that holds several of them is
    common; its rows are dealt by quantiles of second, so no value of first makes a part large. Two jobs at most, over
    the columns of first and second; the driver gets the boundaries.
    """
    if n < 2:
        return F.lit(0).cast("long")
    odds = F.lit([i / n for i in range(1, n)])
    keys = rows.select(first.alias("first"), second.alias("second"))
    met = Counter(keys.agg(F.percentile_approx("first", odds, 20 * n)).first()[0] or [])
    common = {v: c for v, c in met.items() if c > 1}
    part = below(sorted(met), first).cast("long") * (n + 1)
    if not common:
        return part
    found = keys.filter(F.col("first").isin(*common)).groupBy("first").agg(F.percentile_approx("second", odds, 20 * n).alias("at")).collect()
    inner = F.lit(0).cast("long")
    for r in found:
        step = max(1, n // common[r["first"]])
        cuts = sorted(set(r["at"][step - 1 :: step]))
        inner = F.when(first == r["first"], 1 + below(cuts, second)).otherwise(inner)
    return part + inner
