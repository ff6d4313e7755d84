"""Approximate neighbours against exact ones, runs on record, and dictionary matching from SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from noteworks.functions.tables import register_match_aliases
from noteworks.operators import concepts as C
from noteworks.operators import neighbours as A
from noteworks.operators import runs as R
from noteworks.operators import vectors as V
from noteworks.plans import tables as t


def test_recall_of_approximate_neighbours(spark, folder):
    points = t.vectors(spark, folder).select(F.col("note_id").alias("id"), F.col("embedding").alias("vec"))
    found, exact = A.approximate_neighbours(points, 5), V.nearest_neighbours(points, 5)
    assert A.recall(found, exact).first()["recall"] >= 0.9
    assert A.approximate_neighbours(points.limit(0)).count() == 0


def test_runs_on_record(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 3 else "x") for i in range(9)], "n long, word string")
    good = R.write_stage(rows, f"{tmp_path}/rows", "rows", {"words": F.count("word")})
    bad = R.write_stage(rows.select(F.raise_error(F.lit("no luck")).alias("n")), f"{tmp_path}/bad", "bad")
    assert json.loads(good["counts"]) == {"rows": 9, "words": 3} and good["seconds"] > 0
    assert bad["status"] == "failed" and "no luck" in bad["error"]
    R.log_run(spark, f"{tmp_path}/log", "r1", [good, bad])
    row = spark.read.parquet(f"{tmp_path}/log/runs").first()
    assert row.status == "failed" and set(json.loads(row.timings)) == {"rows", "bad"}
    assert spark.read.parquet(f"{tmp_path}/log/stages").count() == 2


def test_matching_from_sql(spark):
    notes = spark.createDataFrame([(1, 1, "Of the way, of THE the the the"), (2, 1, None), (3, 2, "other")], "note_id long, client_id long, text string")
    aliases = ["of the", "the", "of"]
    register_match_aliases(spark, C.trie_pattern(aliases), 3)
    notes.createOrReplaceTempView("sql_notes")
    got = spark.sql("SELECT n.note_id, m.* FROM sql_notes n, LATERAL match_aliases(lower(n.text)) m").collect()
    table = spark.createDataFrame([(a, "c") for a in aliases], "alias string, concept_id string")
    want = C.match_aliases(notes, table).select("note_id", "matched_alias", "span_start", "span_end").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 5
