"""Exact quantiles, nested pages, stratified splits and session states against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteworks.operators import models as M
from noteworks.operators import nested as N
from noteworks.operators import quantiles as Q
from noteworks.streaming import uploads as U


@pytest.mark.parametrize("bins", [8, 512])
def test_quantiles(spark, bins):
    rng = random.Random(bins)
    columns = {
        "ties": [float(rng.choice([1, 1, 1, 2, 900])) for _ in range(300)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 308) for _ in range(60)],
        "near": [1.0 + k * 2.0**-52 for k in range(50)] + [k * 5e-324 for k in range(9)],
        "one": [3.5],
    }
    for values in columns.values():
        df = spark.createDataFrame([(v,) for v in values], "v double")
        want = dict(enumerate(sorted(values)))
        ranks = sorted({0, 1, len(values) // 3, len(values) // 2, len(values) - 1} & set(want))
        assert Q.order_statistics(df, [-1, *ranks, len(values)], bins) == {r: want[r] for r in ranks}


def test_interpolated_quantiles(spark):
    rng = random.Random(1)
    values = [rng.uniform(-5, 5) for _ in range(400)]
    shares = [0.0, 0.25, 0.5, 0.999]
    df = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "v double")
    assert np.allclose(Q.exact_quantiles(df, "v", shares), np.quantile(values, shares), rtol=1e-12)
    assert Q.exact_quantiles(df.where("v IS NULL"), "v", shares) == [None] * len(shares)


def test_quantiles_of_infinite_values(spark):
    values = [-math.inf, -math.inf, 1.0, 2.0, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert Q.order_statistics(df, list(range(5))) == dict(enumerate(values))
    assert Q.order_statistics(df.where("v = double('inf')"), [0]) == {0: math.inf}


def test_nested_pages(spark):
    rng = random.Random(3)
    parents = spark.createDataFrame([(i, f"p{i}") for i in range(30)] + [(None, "nobody")], "client_id long, name string")
    rows = [(0 if rng.random() < 0.5 else rng.randint(0, 40), i, rng.choice("xyz")) for i in range(900)] + [(None, 5, "x")]
    first = spark.createDataFrame(rows, "client_id long, n long, word string")
    second = first.where("client_id < 3").select("client_id", F.col("n").alias("m"))
    got = N.nest(parents, "client_id", {"words": (first, [F.desc("n")]), "few": (second, ["m"])}, page=16).collect()
    for client in [*range(30), None]:
        own = sorted((r for r in got if r.client_id == client), key=lambda r: r.page)
        want = sorted(((n, w) for c, n, w in rows if c == client and c is not None), reverse=True)
        assert [r.page for r in own] == list(range(max(1, -(-len(want) // 16))))
        assert [(w.n, w.word) for r in own for w in r.words] == want
        assert all(r.n_words == len(want) and len(r.words) <= 16 and r.name == (f"p{client}" if client is not None else "nobody") for r in own)
        few = sorted(n for n, _ in want) if client is not None and client < 3 else []
        assert [x.m for r in own for x in r.few] == few and all(r.n_few == len(few) for r in own)
    assert N.nest(parents.limit(0), "client_id", {"words": (first, ["n"])}).count() == 0


def test_deleted_clients(spark):
    clients = spark.createDataFrame([(1, None, None, None, True), (2, 4, "a|b", "IT", None)],
                                    "client_id long, segment_id int, top_concepts string, language string, is_deleted boolean")
    concepts = spark.createDataFrame([(1, 7, "C1", None, None, None, 3)],
                                     "client_id long, note_id long, concept_id string, label string, matched_alias string, span_start int, span_end int")
    actions = spark.createDataFrame([(1, 9, None, None, "low", False, None), (1, 8, "t", "CRM", "high", True, None)],
                                    "client_id long, action_id long, title string, channel string, priority string, is_completed boolean, created_on date")
    assert [r.client_id for r in N.list_clients(clients, concepts, actions).collect()] == [2]
    both = {r.client_id: r for r in N.list_clients(clients, concepts, actions, include_deleted=True).collect()}
    assert [a.action_id for a in both[1].actions] == [8, 9] and both[1].concepts[0].concept == "C1" and both[1].concepts[0].span_start == 0
    assert both[2].top_concepts == ["a", "b"] and both[2].actions == [] and both[1].language == "FR"


def test_stratified_split(spark):
    labels = ["a"] * 903 + ["b"] * 97 + ["c"] * 3 + [None] * 10
    rows = spark.createDataFrame(list(enumerate(labels)), "client_id long, label string")
    train, test = M.split(rows, label="label")
    assert Counter(r.label for r in test.collect()) == {"a": 181, "b": 19, "c": 1, None: 2}
    assert train.count() + test.count() == len(labels) and not train.join(test, "client_id").count()
    again = M.split(rows.repartition(7), label="label")[1]
    assert {r.client_id for r in again.collect()} == {r.client_id for r in test.collect()}


def test_session_states_do_not_depend_on_order(spark, tmp_path):
    rng = random.Random(5)
    log = [(rng.randint(0, 8), rng.choice([*U.LIFE, "odd"]), rng.choice(["s1", "s2", None]), rng.choice([None, 4]), f"e{i}", f"2024-01-01 00:00:{rng.randint(0, 20):02d}") for i in range(200)]
    schema = "session_id long, kind string, stage string, records long, error string, at string"
    events = spark.createDataFrame(log, schema).withColumn("at", F.to_timestamp("at"))
    got = {r.session_id: r for r in U.session_states(events).collect()}
    rank = {k: i for i, k in enumerate(("odd", *U.LIFE))}
    for session, row in got.items():
        own = sorted((r for r in log if r[0] == session), key=lambda r: (r[5], rank[r[1]], r[1]))
        assert row.status == own[-1][1] and row.events == len(own) and row.failures == sum(r[1] == "failed" for r in own)
        assert row.elapsed == int(own[-1][5][-2:]) - int(own[0][5][-2:])
    events.repartition(5).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    U.follow_sessions(source, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    followed = {r.session_id: (r.status, r.events, r.failures, r.elapsed) for r in U.current_sessions(spark, f"{tmp_path}/out").collect()}
    assert followed == {s: (r.status, r.events, r.failures, r.elapsed) for s, r in got.items()}


def test_an_upload_without_text_fails(spark, tmp_path):
    schema = "upload_type string, upload_session_id long, client_id long, language string, text string, _ts timestamp"
    rows = spark.createDataFrame([("csv", 1, 1, "fr", "the way", None), ("csv", 2, 1, "fr", " ", None), ("csv", 3, 2, None, None, None)], schema)
    rows.write.json(f"{tmp_path}/in")
    aliases = spark.createDataFrame([("the", "C1")], "alias string, concept_id string")
    U.process_uploads(U.read_uploads_files(spark, f"{tmp_path}/in"), aliases, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    states = {r.session_id: (r.status, r.stage, r.records, r.error, r.events) for r in U.session_states(spark.read.parquet(f"{tmp_path}/out/sessions")).collect()}
    assert states[1] == ("completed", "detect_concepts", 1, None, 3)
    assert states[2] == states[3] == ("failed", "detect_concepts", 0, "no text", 3)
