"""State changes, ranking, streams, sources and models."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from noteworks.operators import features as X
from noteworks.operators import lexicon as L
from noteworks.operators import models as M
from noteworks.operators import ranking as R
from noteworks.operators import state as S
from noteworks.plans import feature_queries as fq
from noteworks.plans import tables as t
from noteworks.sources import notes as N
from noteworks.sources import profile as Pr
from noteworks.streaming import uploads as U


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_twice_is_the_same(spark, folder):
    from noteworks.plans.crm_queries import _delta

    base, delta = t.clients_core(spark, folder), _delta(spark, folder)
    once = S.upsert_clients(base, delta)
    again = S.upsert_clients(once, delta)
    assert once.exceptAll(again).count() == 0 and again.exceptAll(once).count() == 0


def test_replace_keeps_completed(spark):
    base = spark.createDataFrame([(1, "old", True), (1, "open", False), (2, "open", False)], "client_id long, a string, done boolean")
    new = spark.createDataFrame([(1, "new", False), (1, "new", False), (3, "stray", False)], "client_id long, a string, done boolean")
    ids = spark.createDataFrame([(1,)], "client_id long")
    got = S.replace_children(base, new, ids, unique=["client_id", "a"], protect=F.col("done"))
    assert rows(got) == [(1, "new", False), (1, "old", True), (2, "open", False)]


def test_erase_covers_every_table(spark):
    tables = {"a": spark.createDataFrame([(1,), (2,)], "client_id long"), "b": spark.createDataFrame([(1,), (1,)], "client_id long")}
    ids = spark.createDataFrame([(1,)], "client_id long")
    assert {n: d.count() for n, d in S.erase(tables, ids).items()} == {"a": 1, "b": 0}
    assert rows(S.erase_counts(tables, ids)) == [("a", 1, 1), ("b", 2, 0)]


def test_global_index_is_total(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = [r["i"] for r in R.global_index(df, ["k"], "i").orderBy("k").collect()]
    assert got == list(range(1000))


def test_quartiles_close_right(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 9)], "v double")
    got = [r["value_segment"] for r in R.quartile_segment(df, "v").orderBy("v").collect()]
    assert got == ["Bronze"] * 2 + ["Silver"] * 2 + ["Gold"] * 2 + ["Platinum"] * 2


def test_prune_and_labels(spark):
    members = spark.createDataFrame([(1, "sac", 9, [1.0, 0.0]), (1, "duffle sac", 2, [0.9, 0.1]), (1, "taupe", 2, [0.8, 0.3]), (1, "bag", 1, [0.7, 0.3])],
                                    "cluster long, term string, freq long, vec array<double>")
    labels = L.select_labels(members)
    assert rows(labels) == [(1, "sac")]
    got = {r["term"]: r["label"] for r in L.prune_clusters(members, labels).collect()}
    assert got == {"sac": "sac", "duffle sac": "sac", "taupe": "taupe", "bag": "sac"}


def test_cooccurrence_fallback_agrees(spark, folder):
    seen = fq.mentions(spark, folder)
    for multiset in (False, True):
        assert rows(X.cooccurrence(seen, 20, multiset)) == rows(X.cooccurrence(seen, 20, multiset, limit=3))


def test_csv_and_lexicon_round_trip(spark, tmp_path):
    (tmp_path / "b.csv").write_text('ID,Date,Duration,Language,Length,Transcription\nSA_1,2025-10-12,45,french,medium,"Two\nlines, a@b.com"\nSA_2,bad,1,EN,short,\n')
    (tmp_path / "c.csv").write_text("x\n1\n")
    path = N.find_notes_csv(spark, str(tmp_path))
    assert path.endswith("b.csv")
    notes = N.ingest(N.scan_notes_csv(spark, path))
    got = {r["note_id"]: r for r in notes.collect()}
    assert got["SA_1"]["text"] == "Two lines, [EMAIL]" and got["SA_1"]["language"] == "FR" and got["SA_2"]["date"] is None
    quality = N.notes_quality(notes).first()
    assert (quality["notes"], quality["invalid_dates"], quality["empty_texts"]) == (2, 1, 1)
    with pytest.raises(ValueError, match="Transcription"):
        N.require_columns(spark.range(1))
    lexicon = spark.createDataFrame([("C1", "Noir", ["black"], ["FR"], 3, ["n1"], "preferences")],
                                    "concept_id string, label string, aliases array<string>, languages array<string>, freq_notes long, examples array<string>, bucket string")
    N.write_lexicon_json(lexicon, str(tmp_path / "lex"))
    assert N.read_lexicon_lines(spark, str(tmp_path / "lex")).collect() == lexicon.collect()
    N.write_csv(lexicon, str(tmp_path / "out"), ["concept_id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["aliases"] == "black"
    assert len(N.load_playbook(None)) > 0 and N.load_playbook(str(tmp_path / "none.yml"))


def test_standardize_numbers_equal_rows(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "t string")
    assert [(r["note_id"], r["text"]) for r in Pr.standardize(df, "t").orderBy("note_id").collect()] == [("NOTE_0000", "a"), ("NOTE_0001", "b"), ("NOTE_0002", "b")]


def test_session_status(spark):
    log = spark.createDataFrame([(1, "started", 0, "2024-01-01 00:00:00"), (1, "completed", 5, "2024-01-01 00:00:09"), (2, "failed", 0, "2024-01-01 00:00:00")],
                                "upload_session_id long, status string, records long, at string").withColumn("at", F.to_timestamp("at"))
    assert rows(U.session_status(log).select("upload_session_id", "status", "records", "elapsed")) == [(1, "completed", 5, 9.0), (2, "failed", 0, 0.0)]
    assert U.status_events(log).columns == ["key", "value"]


def test_models(spark, folder, tmp_path):
    data = fq.training_rows(spark, folder)
    model, metrics = M.train_purchase(data, trees=5, depth=3)
    churn, _ = M.train_churn(data, trees=5, depth=3)
    clv, errors = M.train_clv(data, trees=5, depth=3)
    assert 0 <= metrics["accuracy"] <= 1 and metrics["importances"] and "r2" in errors
    scored = M.predict(data.select("client_id", "features"), model, churn, clv)
    assert scored.where("purchase_prob < 0 OR purchase_prob > 1 OR churn_risk IS NULL OR predicted_clv IS NULL").count() == 0
    assert scored.count() == data.count()
    again, _ = M.train_purchase(data.repartition(3), trees=5, depth=3)
    one = {r["client_id"]: round(r["purchase_prob"], 9) for r in scored.collect()}
    two = {r["client_id"]: round(r["purchase_prob"], 9) for r in M.predict(data.select("client_id", "features"), again, churn, clv).collect()}
    assert one == two
    forests = M.incremental_update(model, data, "purchased", trees=3, depth=3)
    assert M.vote_forests(forests, data.select("client_id", "features")).where("probability_mean BETWEEN 0 AND 1").count() == data.count()
    compared = M.compare_models(model, again, data, "purchased")
    assert compared["improvement_pct"] == 0 and not compared["better"]
    M.save_version(model, "purchase", "v1", {"accuracy": 0.5}, str(tmp_path), spark)
    M.save_version(model, "purchase", "v2", {"accuracy": 0.7}, str(tmp_path), spark)
    assert M.best_model(M.training_history(spark, str(tmp_path))).first()["version"] == "v2"


def test_regression_vote_and_head(spark, folder):
    data = fq.training_rows(spark, folder)
    models, errors = M.ensemble_regressor(data, "lifetime_value", trees=5, depth=3)
    assert len(models) == 3 and errors["rmse"] > 0
    named = data.withColumn("category", F.when(F.col("purchased") == 1, "HEALTH_DATA").otherwise("SAFE"))
    head = M.train_sensitive_head(named.limit(60), layers=(4,))
    assert head.transform(named).select("prediction").distinct().count() >= 1


def test_model_search(spark, folder):
    data = fq.training_rows(spark, folder)
    name, model, metrics = M.model_search(data, "purchased", draws=1, folds=2)
    assert name in metrics and set(metrics) == {"forest", "boosted", "logistic"}
    assert metrics[name]["auc"] == max(m["auc"] for m in metrics.values())
    assert model.transform(data.limit(5)).count() == 5


def test_append_predictions(spark, folder):
    from pyspark.ml.feature import VectorAssembler

    notes = t.notes(spark, folder)
    table = X.text_features(notes, "text", "note_id")
    made = VectorAssembler(inputCols=[c for c in table.columns if c != "client_id"], outputCol="features").transform(table)
    labels = made.select("client_id", "features", (F.col("num_concepts") > 100).cast("int").alias("purchased"),
                         (F.col("num_concepts") < 50).cast("int").alias("churned"), F.col("num_concepts").cast("double").alias("lifetime_value"))
    models = [train(labels, trees=3, depth=3)[0] for train in (M.train_purchase, M.train_churn, M.train_clv)]
    got = M.append_predictions(notes, "text", "note_id", *models)
    assert got.count() == notes.count() and {"text", "purchase_prob", "value_segment"} <= set(got.columns)
    assert M.value_quartiles(got.withColumnRenamed("client_id", "owner")).where("quartile IS NULL").count() == 0


def test_graph_brands(spark):
    from noteworks.operators import graph as G

    lexicon = spark.createDataFrame([("C1", "travel bag", "preferences", 3), ("C2", "golf", "lifestyle", 1), ("C3", "house mark", "preferences", 1)],
                                    "concept_id string, label string, bucket string, freq_notes long")
    nodes, edges = G.concept_layer(lexicon, ("bag", "mark"))
    kinds = {r["id"]: r["type"] for r in nodes.collect()}
    assert kinds["concept:C1"] == "brand" and kinds["concept:C2"] == "concept" and kinds["concept:C3"] == "brand"
    assert edges.count() == 3 and sum(k == "bucket" for k in kinds.values()) == 7


def test_only_bounded_rows_cross_the_shuffle(spark, folder):
    """Top-k per group is cut in every partition before the shuffle."""
    orders = t.read(spark, folder, "orders")
    plan = R.top_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_matching_shuffles_no_text(spark, folder):
    from noteworks.operators import concepts as C

    docs = t.read(spark, folder, "documents").select(F.col("doc_id").alias("note_id"), F.col("doc_id").alias("client_id"), "text")
    plan = C.match_aliases(docs, C.alias_map(t.lexicon(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(note_id" not in plan and "Exchange hashpartitioning(text" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_late_uploads_are_kept_and_redelivered_ones_dropped(spark, tmp_path):
    import datetime as dt

    from noteworks.streaming import uploads

    stamp = dt.datetime(2024, 1, 10)
    schema = "upload_session_id long, client_id long, language string, text string, _ts timestamp"
    seen = []
    for batch_id, (sessions, day) in enumerate([([1, 1], 0), ([2, 1], -4), ([3, 2], -1)]):
        rows = [(s, s, "FR", "texte", stamp + dt.timedelta(days=day)) for s in sessions]
        batch = uploads.dedup_uploads(spark.createDataFrame(rows, schema), str(tmp_path), batch_id)
        got = batch.select("upload_session_id")
        seen.append([r[0] for r in got.collect()])
        got.write.mode("overwrite").parquet(f"{tmp_path}/sessions/batch_id={batch_id}")
    assert seen == [[1], [2], [3]]
