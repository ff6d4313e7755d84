"""Global positions, top-k per group, dense codes: without ever pulling all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteworks.operators.quantiles import exact_quantiles
from noteworks.session import cut_lineage


def _ordered(keys: list[str | Column]) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def global_index(df: DataFrame, keys: list[str | Column], name: str = "idx") -> DataFrame:
    """0-based position of every row in the total order of ``keys`` (which must have no ties).

    Rows are range-partitioned and sorted; each partition numbers its own rows, and a table with one row
    per partition supplies the offsets. The partitioned rows are checkpointed so that both reads agree.
    """
    order = _ordered(keys)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = cut_lineage(ranged.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    # One row per partition: this window is as small as the partition count.
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        numbered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        .withColumn(name, local + F.col("_offset")).drop("_row", "_part", "_offset")
    )


def top_per_group(df: DataFrame, group: list[str], order: list[str | Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group. Spark cuts every partition to ``k`` rows a group before it shuffles."""
    window = Window.partitionBy(*group).orderBy(*_ordered(order))
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def first_per_group(df: DataFrame, group: list[str], order: Column | str) -> DataFrame:
    """The row that comes first in each group, by a partial aggregate instead of a sort."""
    rest = [c for c in df.columns if c not in group]
    picked = df.groupBy(*group).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return picked.select(*group, *[F.col("_first")[c].alias(c) for c in rest])


def normalize_by_max(df: DataFrame, group: list[str], value: str, name: str, digits: int = 3) -> DataFrame:
    """``value`` over the group's maximum. The maxima are aggregated first, so a hot group is not gathered."""
    top = df.groupBy(*group).agg(F.max(value).alias("_max"))
    scaled = F.when(F.col("_max") > 0, F.round(F.col(value) / F.col("_max"), digits)).otherwise(F.lit(0.0))
    return df.join(top, group).withColumn(name, scaled).drop("_max")


def quartile_segment(df: DataFrame, value: str, names: tuple[str, ...] = ("Bronze", "Silver", "Gold", "Platinum"),
                     name: str = "value_segment") -> DataFrame:
    """Right-closed quartile bands with linear interpolation, the lowest value included.

    The three cut points are exact, found by shrinking histograms, and used as literals.
    """
    cuts = exact_quantiles(df, value, [0.25, 0.5, 0.75])
    if cuts[0] is None:
        return df.withColumn(name, F.lit(None).cast("string"))
    band = F.when(F.col(value) <= cuts[0], names[0]).when(F.col(value) <= cuts[1], names[1])
    band = band.when(F.col(value) <= cuts[2], names[2]).when(F.col(value).isNotNull(), names[3])
    return df.withColumn(name, band)
