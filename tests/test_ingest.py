"""CSV files to notes, client ids from notes, events with their targets: small cases with nulls and repeats."""

from __future__ import annotations

import datetime
import json

import pytest

from noteworks.operators import actions as A
from noteworks.operators import concepts as C
from noteworks.sources import notes as N

HEADER = "ID,Date,Duration,Language,Length,Transcription\n"


def test_run_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(HEADER + '1,05/01/2024,Short,french,Long,"two\n  lines, and ""quotes"""\n2,nonsense,,xx,Short,\n')
    (tmp_path / "in" / "b.csv").write_text(HEADER + "3,2024-02-03,Long, EN ,Short,mail me: a@example.com\n")
    stage = N.run_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert stage["status"] == "completed"
    assert json.loads(stage["counts"]) == {"rows": 3, "invalid_dates": 1, "unknown_languages": 1, "empty_texts": 1}
    rows = {r.note_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (rows["1"].client_id, rows["1"].language, rows["1"].text) == ("1", "FR", 'two lines, and "quotes"')
    assert rows["1"].date == datetime.datetime(2024, 1, 5) and rows["2"].date is None and rows["2"].text == ""
    assert "a@example.com" not in rows["3"].text


def test_run_ingest_refuses_empty_and_foreign_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text(HEADER)
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="no rows"):
        N.run_ingest(spark, str(tmp_path / "empty.csv"), str(tmp_path / "out1"))
    with pytest.raises(ValueError, match="missing columns"):
        N.run_ingest(spark, str(tmp_path / "other.csv"), str(tmp_path / "out2"))


def test_fill_client_ids(spark):
    notes = spark.createDataFrame([(1, 10), (2, 20), (2, 15), (None, 99)], "note_id long, client_id long")
    bare = spark.createDataFrame([("1", "x"), ("2", "x"), ("2", "x"), ("3", "y"), (None, "z")], "note_id string, concept_id string")
    got = sorted((r.note_id or "", r.client_id) for r in C.fill_client_ids(bare, notes).collect())
    assert [g for g in got if g[0] not in ("", "3")] == [("1", 10), ("2", 15), ("2", 15)]
    assert ("3", None) in got and ("", None) in got and len(got) == 5
    partly = spark.createDataFrame([("1", 7), ("1", None)], "note_id string, client_id long")
    assert sorted(r.client_id for r in C.fill_client_ids(partly, notes).collect()) == [7, 10]
    assert C.fill_client_ids(bare.limit(0), notes).count() == 0


def test_events_with_targets(spark):
    clients = spark.createDataFrame(
        [(1, "Rose|Oak", False, 0, "A", 0.5), (2, "oak", False, 1, "B", 0.4), (3, "Rose|Oak", True, 1, "B", 0.4), (4, None, False, 1, "B", 0.4)],
        "client_id long, top_concepts string, is_deleted boolean, segment_id int, profile_type string, confidence double")
    templates = spark.createDataFrame(
        [(7, "Garden", "CRM", ["rose", " Oak "], None), (8, "None", "CRM", None, datetime.date(2024, 5, 1))],
        "template_id long, title string, channel string, concepts array<string>, event_date date")
    events, targets = A.activate_and_match(templates, clients, "2024-01-01")
    assert {(r.event_id, str(r.event_date)) for r in events.collect()} == {(7, "2024-01-15"), (8, "2024-05-01")}
    state = spark.createDataFrame([(7, 2, "notified", "none", None)], "event_id long, client_id long, action_status string, outcome string, outcome_value double")
    rows = A.event_detail(events, targets, state, clients).collect()
    assert [(r.client_id, r.match_score, r.action_status, r.segment_id) for r in rows] == [(1, 1.0, "pending", 0), (2, 0.5, "notified", 1)]
