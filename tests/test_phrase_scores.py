"""Phrases scored for many notes at once: notes across batches, one reading of the texts, no list of a whole note."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from noteworks.operators import keyphrases as K
from noteworks.operators import phrase_scores as P

WORDS = "silk bag red coat linen blue zip belt wool hat".split()
SCHEMA = "note_id long, language string, text string"


@pytest.fixture(scope="module")
def notes(spark):
    texts = [" ".join(WORDS[(i * 7 + j * j) % 10] + (". " if j % 5 == i % 5 else "") for j in range(30 + i)) for i in range(12)]
    rows = [(i // 2 if i < 6 else i, "FR" if i % 3 else "EN", t) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "EN", texts[0]), (20, "EN", None), (21, None, texts[1]), (22, "EN", " . ")], SCHEMA)


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_notes_may_lie_in_several_batches(spark, notes):
    made = {f.__name__: sorted(map(str, f(notes).collect())) for f in (K.keywords_yake, K.keywords_rake)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        assert made == {f.__name__: sorted(map(str, f(notes).collect())) for f in (K.keywords_yake, K.keywords_rake)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_runs_by_degree_over_frequency(notes):
    texts, want = defaultdict(list), {}
    for r in notes.collect():
        texts[r["note_id"]].append((r["language"], r["text"] or ""))
    for note, rows in texts.items():
        runs = [(lang, run) for lang, t in rows for run in dict.fromkeys(tuple(x.split()) for x in re.split(r"[^\w\s]+", t)) if 1 <= len(run) <= 4]
        words = [(w, len(run)) for _, run in runs for w in run]
        weight = {w: sum(n for x, n in words if x == w) / sum(x == w for x, _ in words) for w, _ in words}
        raw = defaultdict(float)
        for lang, run in runs:
            raw[lang, " ".join(run)] += sum(weight[w] for w in run)
        for (lang, phrase), x in raw.items():
            want[note, lang, phrase] = round(round(x, 6) / max(round(y, 6) for y in raw.values()), 6)
    got = K.keywords_rake(notes, top=1000, stopwords=["none"]).collect()
    assert {(r["note_id"], r["language"], r["candidate"]): round(r["score"], 6) for r in got} == want


def test_no_list_of_a_whole_note_is_gathered(notes):
    plan = _plan(K.keywords_yake(notes))
    assert "collect_list" not in plan and "Window" not in plan


def test_texts_are_mined_once(notes):
    plan = _plan(K.mine_candidates(notes, with_yake=False))
    assert plan.count("MapInArrow") == 1


def test_first_notes_of_a_candidate(spark):
    rows = [(i, "EN", "red leather bag, linen coat") for i in (9, 3, 40, 7, 22, 5, 18)] + [(None, "FR", "red leather bag, linen coat")]
    found = K.mine_candidates(spark.createDataFrame(rows, SCHEMA), known_words=[]).where("freq_notes = 8").collect()
    assert found and all(r["languages"] == ["EN", "FR"] and r["example_note_ids"] == [3, 5, 7, 9] for r in found)


def test_logarithms_and_deviations_are_those_of_spark(spark):
    """Weights that tie up to rounding keep their order only if every bit is the same."""
    values = [0.5 * i for i in range(2, 4000)] + [1.0 + 2.0**-30, 1e9, 1.4142135623730951]
    frame = spark.createDataFrame([(i, i // 40, v) for i, v in enumerate(values)], "i int, g int, v double").coalesce(1)
    logs = [r["x"] for r in frame.orderBy("i").select(F.log("v").alias("x")).collect()]
    assert [P._strict_log(v) for v in values] == logs
    over = Window.partitionBy("g").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    last = frame.withColumn("s", F.stddev_pop("v").over(over)).groupBy("g").agg(F.max_by("s", "i").alias("s")).orderBy("g").collect()
    groups = np.arange(len(values)) // 40
    assert P._spread(groups, np.array(values), groups.max() + 1).tolist() == [r["s"] for r in last]
