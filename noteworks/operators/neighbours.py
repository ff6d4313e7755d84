"""Approximate nearest neighbours by random hyperplanes: the mode for tables too large for the exact one.

A table of hyperplanes gives every vector a key of sign bits; vectors that point the same way share keys with a chance
that falls with their angle. Candidates are the vectors of one's bucket in any table, compared by a matrix product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteworks.functions import vectors as V
from noteworks.operators.ranking import top_per_group
from noteworks.operators.vectors import BLOCK, _best, distinct_points
from noteworks.session import cut_lineage

TABLES = 16
BUCKET_ROWS = 256  # rows a bucket should hold, from which the number of bits follows


def _key_batches(planes: np.ndarray, tables: int):
    bits = planes.shape[1] // tables if tables else 0
    weight = 1 << np.arange(bits, dtype=np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
            signs = (flat @ planes > 0).reshape(len(flat), tables, bits)
            keys = [(signs[:, t, :] @ weight) * tables + t for t in range(tables)]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([batch.column(0)] * tables), pa.concat_arrays([vectors] * tables), pa.array(np.concatenate(keys))], ["id", "vec", "key"])

    return work


def approximate_neighbours(points: DataFrame, k: int = 5, tables: int = TABLES, bits: int | None = None, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """Up to ``k`` most cosine-similar other vectors of every ``(id, vec)`` among those that share a bucket.

    Recall is a matter of ``tables`` and ``bits`` (by default as many as leave ``BUCKET_ROWS`` to an average bucket):
    two vectors at angle ``w`` meet with the chance ``1 - (1 - (1 - w / pi) ** bits) ** tables``. Nothing else is
    dropped: copies of a vector are collapsed and all kept, and a bucket beyond ``block`` rows is compared in
    bounded blocks. Zero vectors and vectors that meet nobody have no neighbours; ties go by id.
    """
    unit = points.select(F.col("id").cast("long").alias("id"), V.l2_normalize(F.col("vec").cast("array<double>")).alias("vec"))
    unit = unit.where(F.exists("vec", lambda x: x != 0))
    reps, keyed = distinct_points(unit, k + 1)
    keyed, reps = cut_lineage(keyed), cut_lineage(reps)
    head = reps.select(F.size("vec").alias("d")).first()
    empty = "id long, other long, similarity double, rank int"
    if head is None:
        return points.sparkSession.createDataFrame([], empty)
    if bits is None:
        bits = max(1, math.ceil(math.log2(max(2, reps.count() / BUCKET_ROWS))))
    planes = np.random.default_rng(seed).standard_normal((head["d"], tables * bits))
    rows = reps.select("id", "vec").mapInArrow(_key_batches(planes, tables), "id long, vec array<double>, key long")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    held = rows.join(sizes, "key").withColumn("chunks", F.ceil(F.col("n") / block).cast("int"))
    homes = held.select("id", "vec", "key", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"))
    renamed = [F.col(c).alias(c) for c in ("id", "vec", "key")]  # columns of their own, so that both sides are told apart
    visitors = held.select(*renamed, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
                           F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("part"))
    met = homes.groupBy("key", "chunk").cogroup(visitors.groupBy("key", "chunk")).applyInPandas(
        _best(k, lambda a, b: a @ b.T), "id long, other long, score double")
    best = met.groupBy("id", "other").agg(F.max("score").alias("score"))
    near = top_per_group(best, ["id"], [F.desc("score"), "other"], k).drop("rank")
    firsts = top_per_group(keyed, ["rep"], ["id"], k + 1).select("rep", F.col("id").alias("other_id"))
    own = keyed.select("id", "rep", F.col("rep").alias("other"), F.lit(1.0).alias("score"))
    other = keyed.select("id", "rep").join(near.withColumnRenamed("id", "rep"), "rep").select("id", "rep", "other", "score")
    listed = own.unionByName(other).join(firsts.withColumnRenamed("rep", "other"), "other").where("id <> other_id")
    return top_per_group(listed, ["id"], [F.desc("score"), "other_id"], k).select(
        "id", F.col("other_id").alias("other"), F.col("score").alias("similarity"), "rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found, counting others that are just as similar."""
    worst = exact.groupBy("id").agg(F.min("similarity").alias("least"), F.count("*").alias("wanted"))
    good = found.join(worst, "id").where(F.col("similarity") >= F.col("least") - 1e-9).groupBy("id").agg(F.count("*").alias("got"))
    both = worst.join(good, "id", "left")
    return both.agg(F.sum("wanted").alias("wanted"), F.sum(F.least(F.coalesce("got", F.lit(0)), F.col("wanted"))).alias("got")).withColumn(
        "recall", F.col("got") / F.col("wanted"))
