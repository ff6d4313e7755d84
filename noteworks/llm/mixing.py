"""Mixing sources to target weights by balanced sampling: the cube method, flown in bounded groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteworks.session import cut_lineage, small_table

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
GROUP_ROWS = 20_000
NEAR = 1e-9


def source_targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Per source: place, rows, size and target. All targets add up to all sizes.

    The level ``x`` at which a source gets ``min(most * size, x * weight)`` rises until no source is above its
    bound; only sums over sources come to the driver.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = cut_lineage(sums.withColumn("place", place).withColumn("weight", F.get(cycle, F.pmod("place", F.lit(len(weights))))))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    bound, level, capped = F.col("source_size") * most, 0.0, -1
    while total:
        full = (bound < F.lit(level) * F.col("weight")) if capped >= 0 else F.lit(False)
        n, used, open_weight = table.agg(
            F.count_if(full), F.sum(F.when(full, bound).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (total - used) / open_weight
    return table.withColumn("target", F.least(bound.cast("double"), F.lit(float(level)) * F.col("weight")))


def flight(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move chances along directions that keep their sum and the sum of chance * size, until at most two stay
    between 0 and 1. At any time three rows are in play, so this is linear in the rows."""
    out, play = chance.copy(), []
    draws = rng.random(2 * len(out) + 2)
    turn = 0
    waiting = iter(np.flatnonzero((out > NEAR) & (out < 1 - NEAR)).tolist())
    while True:
        while len(play) < 3 and (i := next(waiting, None)) is not None:
            play.append(i)
        s = [size[i] for i in play]
        twins = next(((a, b) for a in range(len(s)) for b in range(a) if s[a] == s[b]), None)
        if twins:  # two rows of one size: move one against the other
            step = [0.0] * len(play)
            step[twins[0]], step[twins[1]] = 1.0, -1.0
        elif len(play) == 3:
            step = [s[1] - s[2], s[2] - s[0], s[0] - s[1]]
        else:
            return out
        moved = [(out[i], d) for i, d in zip(play, step) if d]
        up = min((1 - p) / d if d > 0 else p / -d for p, d in moved)
        down = min(p / d if d > 0 else (1 - p) / -d for p, d in moved)
        by = up if draws[turn] * (up + down) < down else -down
        turn += 1
        for i, d in zip(play, step):
            out[i] = min(1.0, max(0.0, out[i] + by * d))
            if out[i] <= NEAR or out[i] >= 1 - NEAR:
                out[i] = round(out[i])
        play = [i for i in play if 0 < out[i] < 1]


def land(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle the last two rows: the combination that misses the size, then the count, the least."""
    out = chance.copy()
    left = np.flatnonzero((out > 0) & (out < 1))
    if len(left):
        choice = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        miss = np.abs(choice @ size[left] - (out[left] * size[left]).sum())
        count = np.abs(choice.sum(axis=1) - out[left].sum())
        out[left] = choice[np.lexsort((count, miss))[0]]
    return out


def _fly(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["size", "order", "copy"], ascending=[False, True, True], kind="stable")
    seed = [int(group["place"].iloc[0]), int(group["bucket"].iloc[0]), int(group["level"].iloc[0])]
    size = group["size"].to_numpy(np.float64)
    chance = flight(group["chance"].to_numpy(np.float64), size, np.random.default_rng(seed))
    if group["buckets"].iloc[0] == 1:
        chance = land(chance, size)
    return group.assign(chance=chance)


def mix_sources(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """How often each row is taken, so that every source comes near its target and nobody exceeds ``most``.

    ``rows`` has ``id``, ``source`` and ``size`` (words). A row's expected copies are its source's target over
    its source's size; the whole part is certain, the fraction is its chance. Chances are flown in groups of
    about ``GROUP_ROWS`` rows of one source, what stays open (two rows a group) is flown again, and the last
    group of a source lands. Groups follow hashes of the rows and seeds follow the groups, so reruns agree.
    Repeated rows are told apart by number; null ids, sources and sizes are values like others (a null size is
    zero); a source without words takes none; an empty table gives no rows. Returns id, source, size,
    source_size, target, copies; only these narrow rows are shuffled.
    """
    narrow = rows.select("id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"))
    counted = cut_lineage(narrow.groupBy("id", "source", "size").agg(F.count("*").alias("_n")))
    every = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n")
    targets = source_targets(every, weights, most).withColumnRenamed("source", "_source")
    joined = every.join(small_table(targets), F.col("source").eqNullSafe(F.col("_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    state = joined.withColumn("rate", F.least(rate, F.lit(float(most)))).select(
        "id", "source", "size", "source_size", "target", "place", "copy", F.floor("rate").cast("long").alias("whole"),
        (F.col("rate") - F.floor("rate")).alias("chance"), F.xxhash64("id", "size", "copy").alias("order"),
        F.ceil(F.col("source_rows") / GROUP_ROWS).cast("long").alias("buckets"),
    )
    most_rows = targets.agg(F.max("source_rows")).first()[0] or 0
    buckets, level, done = -(-most_rows // GROUP_ROWS), 0, []
    while True:
        keyed = state.withColumn("bucket", F.pmod(F.xxhash64("order", F.lit(level)), F.col("buckets"))).withColumn("level", F.lit(level))
        flown = cut_lineage(keyed.groupBy("place", "bucket").applyInPandas(_fly, keyed.schema))
        open_row = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(flown.where(~open_row))
        if buckets <= 1:
            break
        buckets, level = -(-2 * buckets // GROUP_ROWS), level + 1
        state = flown.where(open_row).drop("bucket", "level").withColumn("buckets", F.ceil(2 * F.col("buckets") / GROUP_ROWS).cast("long"))
    settled = done[0]
    for more in done[1:]:
        settled = settled.unionByName(more)
    copies = F.col("whole") + F.round("chance").cast("long")
    return settled.select("id", "source", "size", "source_size", "target", copies.alias("copies"))
