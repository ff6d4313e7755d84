"""Sharding along a Hilbert curve: quantised metadata, one curve index, equal runs of the sorted order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteworks.llm import common
from noteworks.operators.ranking import global_index

SHARDS = 16
BITS = 6


def curve_index(df: DataFrame, dims: list[str], bits: int = BITS, name: str = "curve") -> DataFrame:
    """Hilbert index of integer coordinates ``0 .. 2**bits - 1`` in the columns ``dims``, as a long.

    The axes-to-transpose transform, level by level; every step is a projection of shifts and masks.
    """
    x = [f"_x{i}" for i in range(len(dims))]
    df = df.select("*", *[F.col(d).cast("long").alias(c) for d, c in zip(dims, x)])
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for i in range(len(x)):
            high = F.shiftright(F.col(x[i]), level).bitwiseAND(F.lit(1)) == 1
            first, own = F.col(x[0]), F.col(x[i])
            swap = first.bitwiseXOR(own).bitwiseAND(F.lit(below))
            new = {x[0]: F.when(high, first.bitwiseXOR(F.lit(below))).otherwise(first.bitwiseXOR(swap))}
            if i:
                new[x[i]] = F.when(high, own).otherwise(own.bitwiseXOR(swap))
            df = df.withColumns(new)
    for i in range(1, len(x)):
        df = df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    gray: Column = F.lit(0).cast("long")
    for level in range(bits - 1, 0, -1):
        odd = F.shiftright(F.col(x[-1]), level).bitwiseAND(F.lit(1)) == 1
        gray = gray.bitwiseXOR(F.when(odd, F.lit((1 << level) - 1)).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn("_gray", gray).withColumns({c: F.col(c).bitwiseXOR(F.col("_gray")) for c in x})
    index: Column = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for c in x:
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(F.col(c), level).bitwiseAND(F.lit(1)))
    return df.withColumn(name, index).drop("_gray", *x)


def quantised(value: Column, low: Column, high: Column, bits: int = BITS) -> Column:
    """``value`` as a step of ``low .. high``; null is the last step."""
    steps = (1 << bits) - 1
    span = F.when(high > low, (high - low).cast("double")).otherwise(F.lit(1.0))
    step = F.floor((value - low).cast("double") / span * steps)
    return F.coalesce(F.least(F.greatest(step, F.lit(0)), F.lit(steps)), F.lit(steps)).cast("long")


def shard_rows(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document with size, checksum, curve index, shard and slot; law ``rows``.

    Coordinates: language, source (both by hash, so that equal names meet and no name table is needed), the
    logarithm of the size, and the position of the key in its range. Documents are ordered along the curve,
    ties by checksum, key and size, and the order is cut into ``shards`` runs whose counts differ by one at
    most. Null keys, languages and sources take the last step of their axis; repeated rows get slots of their
    own; an empty table gives no rows. Only narrow columns are shuffled, never texts.
    """
    t = common.text_or_empty(text)
    last = (1 << BITS) - 1

    def hashed(name: str) -> Column:
        if name not in docs.columns:
            return F.lit(last).cast("long")
        return F.coalesce(F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(last + 1)), F.lit(last)).cast("long")

    narrow = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"), hashed("lang").alias("_lang"), hashed("source").alias("_source"),
    )
    ends = docs.agg(F.min(key), F.max(key)).first()
    low, high = (F.lit(v).cast("long") for v in ends)
    placed = narrow.withColumn("_size", F.least(F.floor(F.log2(F.col("size")) * 2), F.lit(last)).cast("long"))
    placed = placed.withColumn("_key", quantised(F.col("doc_id").cast("long"), low, high))
    curved = curve_index(placed, ["_lang", "_source", "_size", "_key"]).drop("_lang", "_source", "_size", "_key")
    order = ["curve", "text_crc32", F.col("doc_id").asc_nulls_last(), "size"]
    ranked = global_index(curved, order, "_at")
    n = narrow.count()
    small, more = divmod(n, shards)  # the first ``more`` shards hold one row more
    edge = more * (small + 1)
    at = F.col("_at")
    later = F.floor((at - edge) / F.lit(max(small, 1))).cast("long")
    shard = F.when(at < edge, F.floor(at / F.lit(small + 1)).cast("long")).otherwise(later + more)
    start = F.when(F.col("shard") < more, F.col("shard") * (small + 1)).otherwise(F.lit(edge) + (F.col("shard") - more) * small)
    return (
        ranked.withColumn("shard", shard).withColumn("slot", at - start).drop("_at")
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
    )
