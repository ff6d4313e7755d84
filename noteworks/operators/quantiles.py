"""Exact quantiles of whole columns without gathering or sorting them.

A wanted rank is caught in an interval of values that shrinks by a histogram a round: every task counts its rows in
each bin and notes their least and greatest value, and the bin that holds the rank is the next interval. Only
bins travel; a value that fills its bin ends the search, so ties end it at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteworks.session import cut_lineage

BINS = 512


def _bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin of a value between two finite bounds; halves, where their distance would overflow."""
    if math.isinf(high - low):
        share = (value / 2 - low / 2) / (high / 2 - low / 2)
    else:
        share = (value - F.lit(low)) / F.lit(high - low)
    return F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")


def order_statistics(values: DataFrame, ranks: list[int], bins: int = BINS) -> dict[int, float]:
    """Values at 0-based ``ranks`` of the ascending order of ``values(v double)``, which has no nulls and no NaN.

    Infinite values are counted, not binned. Each round scans the column once; a round splits every interval into
    at least two, and by ``bins`` if the values are spread evenly. Ranks outside the column are left out.
    """
    finite = (F.col("v") > -math.inf) & (F.col("v") < math.inf)
    inner = F.when(finite, F.col("v"))
    n, below, above, low, high = values.agg(
        F.count("*"), F.count_if(F.col("v") == -math.inf), F.count_if(F.col("v") == math.inf), F.min(inner), F.max(inner)).first()
    found: dict[int, float] = {}
    open_: dict[tuple[float, float, int], list[int]] = {}
    for rank in {r for r in ranks if 0 <= r < n}:
        if rank < below:
            found[rank] = -math.inf
        elif rank >= n - above:
            found[rank] = math.inf
        else:
            open_.setdefault((low, high, below), []).append(rank)
    while open_:
        for (lo, hi, _), wanted in list(open_.items()):
            if lo == hi:
                found |= dict.fromkeys(wanted, lo)
        intervals = [key for key in open_ if key[0] < key[1]]
        if not intervals:
            break
        inside = F.array(*[
            F.when(F.col("v").between(lo, hi), F.struct(F.lit(i).alias("part"), _bin(F.col("v"), lo, hi, bins).alias("bin")))
            for i, (lo, hi, _) in enumerate(intervals)
        ])
        hit = values.where(finite).select("v", F.explode(F.filter(inside, lambda x: x.isNotNull())).alias("x"))
        counts = hit.groupBy("x.part", "x.bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("part", "bin").collect()
        following: dict[tuple[float, float, int], list[int]] = {}
        for i, key in enumerate(intervals):
            before = key[2]
            for row in (c for c in counts if c["part"] == i):
                own = [r for r in open_[key] if before <= r < before + row["n"]]
                if own:
                    following[row["lo"], row["hi"], before] = own
                before += row["n"]
        open_ = following
    return found


def exact_quantiles(df: DataFrame, value: str | Column, shares: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation between neighbours, as the ``percentile`` aggregate has them.

    Nulls and NaN do not count; without a value all quantiles are None. The column alone is written once, so that
    a costly ``df`` is computed once.
    """
    column = F.col(value) if isinstance(value, str) else value
    values = cut_lineage(df.select(column.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")))
    n = values.count()
    if not n:
        return [None] * len(shares)
    places = [share * (n - 1) for share in shares]
    at = order_statistics(values, [r for p in places for r in (math.floor(p), math.ceil(p))])
    out = []
    for p in places:
        low, high = at[math.floor(p)], at[math.ceil(p)]
        out.append(low if low == high else (math.ceil(p) - p) * low + (p - math.floor(p)) * high)
    return out
