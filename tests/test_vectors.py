"""Exact neighbours, density clusters and linkage against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from noteworks.functions import vectors as VF
from noteworks.operators import clustering as CL
from noteworks.operators import lexicon as L
from noteworks.operators import vectors as V


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    data = np.vstack([c + 0.15 * rng.normal(size=(25, 8)) for c in centres] + [np.repeat(centres[:1], 60, axis=0)])  # 60 copies
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    return data, spark.createDataFrame(rows, "id long, vec array<double>").repartition(5)


def test_neighbours(points):
    data, df = points
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 9)
    got = {}
    for r in V.nearest_neighbours(df, 4, block=20, n_pivots=7).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["other"], round(r["similarity"], 9))
    for i in range(len(data)):
        order = sorted((j for j in range(len(data)) if j != i), key=lambda j: (-sims[i, j], j))[:4]
        best = [sims[i, j] for j in order]
        assert np.allclose([got[i][k + 1][1] for k in range(4)], best, atol=1e-8), i
        assert i not in [got[i][k][0] for k in got[i]]


def test_dbscan(points):
    data, df = points
    eps = 0.45
    near = np.linalg.norm(data[:, None] - data[None], axis=2) <= eps
    label = np.arange(len(data))
    for _ in range(len(data)):
        new = np.array([label[near[i]].min() for i in range(len(data))])
        if (new == label).all():
            break
        label = new
    want = {i: (int(label[i]) if (label == label[i]).sum() > 1 else -1) for i in range(len(data))}
    assert {r["id"]: r["cluster_id"] for r in CL.dbscan(df, eps, block=20, n_pivots=7).collect()} == want
    assert -1 in want.values() or len(set(want.values())) > 1


def linkage(data, cut):
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    groups = [[i] for i in range(len(data))]
    while len(groups) > 1:
        means = np.array([unit[g].mean(0) for g in groups])
        d = 1 - means @ means.T
        np.fill_diagonal(d, np.inf)
        a, b = np.unravel_index(d.argmin(), d.shape)
        if d[a, b] >= cut:
            break
        groups[a] += groups[b]
        del groups[b]
    return {frozenset(g) for g in groups}


def test_cluster_terms(spark, points):
    data, _ = points
    some = data[:90]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(some)], "id long, vec array<double>")
    found = {}
    for r in L.cluster_terms(df, 0.02, block=16, n_pivots=5).collect():
        found.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(g) for g in found.values()} == linkage(some, 0.02)
    assert 1 < len(found) < 90


def test_large_catalogue_agrees(spark, points, monkeypatch):
    data, df = points
    clients = df.selectExpr("id AS client_id", "vec AS embedding")
    items = spark.createDataFrame([(i, "a", 1.0, [float(x) for x in data[i]]) for i in range(30)], "product_id long, category string, price double, vec array<double>")
    pick = lambda d: {(r["client_id"], r["rank"]): r["product_id"] for r in d.collect()}
    small = pick(V.recommend_products(clients, items, 3))
    monkeypatch.setattr(V, "CATALOGUE_LIMIT", 5)
    monkeypatch.setattr(V, "BLOCK", 16)
    assert pick(V.recommend_products(clients, items, 3)) == small


def test_kmeans_is_stable(spark, points):
    _, df = points
    rows = df.selectExpr("id AS client_id", "vec AS embedding")
    one, centres = CL.kmeans_segments(rows, 6, starts=2)
    two, _ = CL.kmeans_segments(rows.repartition(9), 6, starts=2)
    as_sets = lambda d: {frozenset(r["client_id"] for r in g) for g in _groups(d)}
    assert as_sets(one) == as_sets(two) and len(centres) == 6
    assert CL.silhouette(one) > 0.3
    confidence = CL.assignment_confidence(one, centres).agg({"confidence": "min"}).first()[0]
    assert 0 < confidence <= 1


def _groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cluster_id"], []).append(r)
    return out.values()


@pytest.mark.parametrize("n, want", [(1, 1), (2, 2), (10, 3), (50, 5), (1000, 8)])
def test_choose_k(n, want):
    assert CL.choose_k(n) == want


def test_vector_functions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    from pyspark.sql import functions as F

    got = row.select(VF.norm(F.col("a")).alias("n"), VF.l2_normalize(F.col("b")).alias("z"), VF.cosine(F.col("a"), F.col("b")).alias("c"),
                     VF.clip_norm(F.col("a"), 1.0).alias("k"), VF.laplace_noise(F.col("a"), F.array(F.lit(0.0), F.lit(0.25)), 1.0).alias("l")).first()
    assert got["n"] == 5.0 and got["z"] == [0.0, 0.0] and got["c"] == 0.0
    assert np.allclose(got["k"], [0.6, 0.8]) and got["l"][0] == 3.0 and got["l"][1] == pytest.approx(4 + np.log(2))


def test_zero_vectors_are_like_nothing(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])]
    found = V.nearest_neighbours(spark.createDataFrame(rows, "id long, vec array<double>"), k=3).collect()
    assert {r["similarity"] for r in found} == {0.0}


def test_lexicon_from_candidates(spark):
    """Equal spellings meet, strangers that a model puts together part again, and nothing in gives nothing out."""
    ddl = "candidate string, freq_notes long, languages array<string>, example_note_ids array<long>"
    rows = [("Rose Garden", 3, ["FR"], [1, 2]), ("rose garden", 5, ["EN"], [3]), ("oak", 5, ["EN"], [4]), (None, 9, [], []), ("???", 1, ["DE"], [5])]
    got = {r.label: r for r in L.lexicon_from_candidates(spark.createDataFrame(rows, ddl)).collect()}
    assert set(got) == {"rose garden", "oak", "???"}
    assert (got["rose garden"].aliases, got["rose garden"].freq_notes, got["rose garden"].languages) == (["Rose Garden"], 8, ["EN", "FR"])
    assert sorted(got["rose garden"].examples) == [1, 2, 3]
    assert [r.label for r in sorted(got.values(), key=lambda r: r.concept_id)] == ["rose garden", "oak", "???"]

    @F.pandas_udf("array<double>")
    def alike(texts: pd.Series) -> pd.Series:
        return texts.map(lambda _: [1.0, 0.0])

    apart = L.lexicon_from_candidates(spark.createDataFrame([rows[1], rows[2]], ddl), model=alike).collect()
    assert sorted((r.label, r.freq_notes) for r in apart) == [("oak", 5), ("rose garden", 5)]
    assert L.lexicon_from_candidates(spark.createDataFrame([], ddl)).count() == 0


def test_visits_leave_in_bounded_frames(points):
    """A batch used to leave as one frame, as large as all its visits to all cells together."""
    data, _ = points
    pivots = np.array(data[:7])
    d = V._distances(np.array(data), pivots)
    batch = pd.DataFrame({"id": range(len(data)), "vec": list(data), "dist": d.min(1), "reach": 4.0})
    frames = list(V._visits(batch, pivots, np.full(7, 9.0), 16))
    assert max(len(f) for f in frames) <= 16
    got = pd.concat(frames)
    assert sorted(zip(got["id"], got["cell"])) == [(i, c) for i in range(len(data)) for c in range(7)]
    assert all((v == data[i]).all() for i, v in zip(got["id"], got["vec"]))


def test_finished_clusters_leave_the_rounds(spark, points, monkeypatch):
    """Vectors that are close to nothing were compared with all others in every round, and every round was distributed."""
    seen, place = [], L.assign_cells
    monkeypatch.setattr(L, "assign_cells", lambda points, pivots: (seen.append(points.count()), place(points, pivots))[1])
    rows = [(i, [float(i == j) for j in range(12)]) for i in range(10)]
    rows += [(20 + i, [0.0] * 10 + [1.0, 0.05 * i]) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {r["id"]: r["cluster"] for r in L.cluster_terms(df, 0.1, block=2).collect()}
    assert [got[i] for i in range(10)] == list(range(10)) and {got[20 + i] for i in range(4)} == {20}
    assert seen[0] == 14 and max(seen[1:]) <= 4
    seen.clear()
    assert {r["id"]: r["cluster"] for r in L.cluster_terms(df, 0.1).collect()} == got and seen == [14]
    some, found = points[0][:90], {}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(some)], "id long, vec array<double>")
    for r in L.cluster_terms(df, 0.02).collect():
        found.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(g) for g in found.values()} == linkage(some, 0.02) and all(min(g) == c for c, g in found.items())


def test_vectors_are_not_shuffled_once_for_each_block(spark, points, monkeypatch):
    """Every block met a copy of all its visitors in a shuffle of its own, so that the disk grew with the square."""
    data, _ = points
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, vec array<double>")
    want = V.nearest_neighbours(df, 3).orderBy("id", "rank").collect()
    made, write = [], V.cut_lineage
    monkeypatch.setattr(V, "cut_lineage", lambda frame: (made.append(write(frame)), made[-1])[1])
    monkeypatch.setattr(V.block_join, "__defaults__", (16, 3))
    assert V.nearest_neighbours(df, 3, block=16, n_pivots=5).orderBy("id", "rank").collect() == want
    places = max(f.count() for f in made if "vecs" in f.columns)
    met = [f for f in made if f.columns == ["id", "other", "score"]]
    assert len(met) == -(-places // 3) and max(f.count() for f in met) <= 3 * len(data)
