"""Segments, density clusters, projection."""

from __future__ import annotations

import math
from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteworks import config
from noteworks.functions import text as T
from noteworks.functions import vectors as V
from noteworks.operators.ranking import top_per_group
from noteworks.operators.vectors import (
    BLOCK,
    PIVOTS,
    _distances,
    assign_cells,
    block_join,
    choose_pivots,
    client_vector_mean,
    distinct_points,
)
from noteworks.session import cut_lineage


# Seeded runs fitted at the same time; each keeps its own copy of the rows in memory or on disk.
FITS = 4


def choose_k(n: int, override: int = 0) -> int:
    """Number of clusters for ``n`` rows; below two everything is one cluster."""
    k = override if override > 0 else min(8, max(3, int(math.sqrt(n / 2))))
    return max(1, min(k, n))


def kmeans_segments(vectors: DataFrame, k: int, seed: int = 42, starts: int = 10, key: str = "client_id") -> tuple[DataFrame, list]:
    """Assign ``cluster_id``; the best of ``starts`` seeded runs by cost. Rows are ordered by id before fitting."""
    if k < 2:
        return vectors.withColumn("cluster_id", F.lit(0)), []
    data = vectors.withColumn("features", array_to_vector("embedding")).repartitionByRange(key).sortWithinPartitions(key)
    data = cut_lineage(data)

    def fit(i: int) -> tuple[float, KMeansModel]:
        model = KMeans(k=k, seed=seed + i, maxIter=300, featuresCol="features", predictionCol="cluster_id").fit(data)
        return model.summary.trainingCost, model

    # A run is a chain of hundreds of short jobs; others fill the cores that one leaves idle between them.
    with ThreadPool(FITS) as pool:
        runs = pool.map(inheritable_thread_target(data.sparkSession)(fit), range(starts))
    best = min(runs, key=lambda run: run[0])[1]  # of equal ones the first
    return best.transform(data).drop("features"), [list(map(float, c)) for c in best.clusterCenters()]


def silhouette(clustered: DataFrame) -> float:
    """Mean silhouette on squared euclidean distance (a different number from the plain distance)."""
    data = clustered.withColumn("features", array_to_vector("embedding"))
    return ClusteringEvaluator(featuresCol="features", predictionCol="cluster_id").evaluate(data)


def assignment_confidence(clustered: DataFrame, centres: list[list[float]]) -> DataFrame:
    """1 / (1 + distance to the own centre); the centres are a literal of k rows."""
    own = F.get(F.array(*[F.lit([float(x) for x in c]) for c in centres]), F.col("cluster_id"))
    return clustered.withColumn("confidence", F.round(1 / (1 + V.euclidean(F.col("embedding"), own)), 4))


def client_tags(concepts: DataFrame, limit: int = 12) -> DataFrame:
    """Distinct tags of a client, ignoring case, first spelling kept, budgets first, at most ``limit``."""
    tag = F.trim(F.coalesce(F.nullif("matched_alias", F.lit("")), "label", "concept_id"))
    place = F.struct("note_id", "span_start")
    seen = concepts.select("client_id", "concept_id", tag.alias("tag"), place.alias("at")).where(F.length("tag") >= 2)
    first = seen.groupBy("client_id", F.lower("tag").alias("_low")).agg(
        F.min_by(F.struct("tag", "concept_id"), "at").alias("f"), F.min("at").alias("at")
    ).select("client_id", "f.tag", (F.col("f.concept_id") != config.BUDGET_CONCEPT_ID).cast("int").alias("other"), "at")
    kept = top_per_group(first, ["client_id"], ["other", "at", "tag"], limit)
    return kept.groupBy("client_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda s: s["tag"]).alias("tags")
    )


def segment_clients(vectors: DataFrame, concepts: DataFrame, k: int = 0, seed: int = 42, starts: int = 10) -> DataFrame:
    """Client profiles: cluster, profile type from its three commonest labels, tags, confidence."""
    means = cut_lineage(client_vector_mean(vectors))
    size = choose_k(means.count(), k)
    clustered, centres = kmeans_segments(means, size, seed, starts)
    scored = assignment_confidence(clustered, centres) if size > 1 else clustered.withColumn("confidence", F.lit(1.0))
    counts = (
        concepts.groupBy("client_id", "label").agg(F.count("*").alias("n"))
        .join(clustered.select("client_id", "cluster_id"), "client_id").groupBy("cluster_id", "label").agg(F.sum("n").alias("n"))
    )
    top = top_per_group(counts, ["cluster_id"], [F.desc("n"), "label"], 3).groupBy("cluster_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda s: s["label"]).alias("labels")
    )
    return (
        scored.join(top, "cluster_id", "left").join(client_tags(concepts), "client_id", "left")
        .select("client_id", "cluster_id", T.format_profile_type(F.col("labels")).alias("profile_type"),
                F.coalesce("tags", F.array().cast("array<string>")).alias("top_concepts"), "confidence")
    )


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Least id of each component. Every round takes the least label among neighbours and then jumps to the
    label of the label; the state is checkpointed, so the plan stays short and survives lost executors."""
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = nodes.select("id", F.col("id").alias("label"))
    while True:
        offers = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("offer"))
        least = labels.join(offers, F.col("id") == F.col("a"), "left").select(
            "id", F.col("label").alias("old"), F.least("label", F.coalesce("offer", "label")).alias("label")
        )
        target = least.select(F.col("id").alias("_t"), F.col("label").alias("_jump"))
        moved = cut_lineage(least.join(target, F.col("label") == F.col("_t")).select("id", "old", F.least("label", "_jump").alias("label")))
        labels = moved.select("id", "label")
        if moved.where("old <> label").limit(1).count() == 0:
            return labels


def _forest(eps: float):
    """Work function: edges that join, within reach ``eps``, all that this block and chunk can join. At most
    one edge per vector leaves, never all pairs."""

    def work(ids: np.ndarray, vecs: np.ndarray, homes: Iterator[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for others, matrix, mask in homes:
            near = _distances(vecs[mask], matrix) <= eps
            group = np.arange(len(others))
            for guest, row in zip(ids[mask], near):
                met = np.flatnonzero(row)
                if len(met):
                    found, first = np.unique(group[met], return_index=True)
                    out += [(guest, others[met[i]]) for i in first]
                    group[np.isin(group, found)] = found[0]
        pairs = pd.DataFrame(out, columns=["a", "b"]).astype("int64")
        return pairs[pairs["a"] != pairs["b"]]

    return work


def dbscan(points: DataFrame, eps: float = 0.3, block: int = BLOCK, n_pivots: int = PIVOTS) -> DataFrame:
    """Density clusters for at least two points per neighbourhood: components of the graph of distances up to
    ``eps``; a point alone gets -1. The label of a cluster is its least id."""
    typed = points.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    reps, keyed = distinct_points(typed, 1)
    reps, keyed = cut_lineage(reps), cut_lineage(keyed)
    pivots = choose_pivots(reps, n_pivots, block)
    cells = assign_cells(reps.select("id", "vec"), pivots)
    edges = block_join(cells.withColumn("reach", F.lit(float(eps))), pivots, _forest(eps), "a long, b long", block)
    labels = connected_components(reps, edges)
    members = keyed.join(labels.withColumnRenamed("id", "rep"), "rep")
    sizes = members.groupBy("label").agg(F.count("*").alias("n"))
    return members.join(sizes, "label").select("id", F.when(F.col("n") > 1, F.col("label")).otherwise(-1).alias("cluster_id"))


def project_3d(vectors: DataFrame, key: str = "client_id") -> DataFrame:
    """First three principal components as x, y, z (each axis points so that its largest loading is positive)."""
    data = vectors.withColumn("features", array_to_vector("embedding"))
    model = PCA(k=3, inputCol="features", outputCol="pc").fit(data)
    loads = model.pc.toArray()
    signs = [1.0 if loads[np.abs(loads[:, i]).argmax(), i] >= 0 else -1.0 for i in range(loads.shape[1])]
    pc = vector_to_array("pc")

    def axis(i: int) -> Column:
        return (F.get(pc, F.lit(i)) * signs[i]) if i < len(signs) else F.lit(0.0)

    return model.transform(data).select(key, axis(0).alias("x"), axis(1).alias("y"), axis(2).alias("z"))


def cluster_summary(clustered: DataFrame, as_of: str) -> DataFrame:
    """Time, number of clients and of clusters as one JSON row; the map itself stays a table."""
    return clustered.agg(
        F.count("*").alias("num_clients"), F.count_distinct("cluster_id").alias("num_clusters")
    ).select(F.to_json(F.struct(F.lit(as_of).alias("timestamp"), "num_clients", "num_clusters")).alias("document"))
