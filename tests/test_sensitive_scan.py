"""Scan for protected mentions that no pattern knows: classifier, contexts, overlaps, empty input."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteworks import config
from noteworks.operators import sensitive_scan as N
from noteworks.operators.grams import gram_batches, phrase_batches, phrase_slots
from noteworks.operators.privacy import ngrams_with_spans
from noteworks.plans.marked_queries import letter_vectors

TRAINING = [("HEALTH_DATA", "leukaemia"), ("HEALTH_DATA", "cancer"), ("SAFE", "handbag"), ("SAFE", "zip"), (None, "x"), ("SAFE", None)]
TEXTS = [(1, "Zip leukaemias zip"), (2, "Zip cancer zip"), (3, "fabric leukaemias"), (4, ""), (5, None), (None, "leukaemias"), (6, "Zip leukaemias zip")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(TRAINING, "category string, phrase string")


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(k, t, "x") for k, t in TEXTS], "note_id long, text string, label string")


def _found(hits):
    return sorted((r["note_id"], r["token"], r["label"], r["span_start"], r["span_end"]) for r in hits.collect())


def test_references_keep_labelled_phrases(rows):
    assert [c for c, _ in N.fit_references(rows, letter_vectors)] == ["HEALTH_DATA", "HEALTH_DATA", "SAFE", "SAFE"]
    with pytest.raises(ValueError):
        N.fit_references(rows, letter_vectors, limit=3)


def test_novel_hits_only(rows, texts):
    references = N.fit_references(rows, letter_vectors)
    novel = [(n, "leukaemias", "HEALTH_DATA", 4, 14) for n in (1, 6)]
    assert _found(N.sensitive_scan(texts, references, embed=letter_vectors)) == novel
    every = _found(N.sensitive_scan(texts, references, embed=letter_vectors, novel_only=False))
    assert every == [novel[0], (2, "cancer", "HEALTH_DATA", 4, 10), novel[1]]


def test_the_head_has_to_agree(rows, texts):
    references = N.fit_references(rows, letter_vectors)
    head = N.fit_head(rows, letter_vectors, layers=(8,))
    phrases = texts.sparkSession.createDataFrame([("leukaemias",), ("cancer",), ("zip",), ("handbags",)], "phrase string")
    near = {r["phrase"] for r in N.score_phrases(phrases, references, None, letter_vectors).collect()}
    judged = {r["phrase"] for r in N.score_phrases(phrases, references, head, letter_vectors).collect()}
    assert near == {"leukaemias", "cancer"} and judged <= near
    assert N.score_phrases(phrases, references, head, letter_vectors, confidence=1.1).count() == 0


def test_nothing_to_scan(texts, rows):
    assert N.sensitive_scan(texts, [("SAFE", [1.0] * 26)], embed=letter_vectors).count() == 0
    assert N.sensitive_scan(texts.limit(0), N.fit_references(rows, letter_vectors), embed=letter_vectors).count() == 0


def test_each_phrase_is_embedded_once(spark, rows):
    references = N.fit_references(rows, letter_vectors)
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def unit(phrase):
        made.add(1)
        return [1.0] + [0.0] * 25

    texts = spark.createDataFrame([(i, "cancer " * 50) for i in range(4)], "note_id long, text string").repartition(4)
    N.sensitive_scan(texts, references, embed=lambda phrases: phrases.withColumn("embedding", unit("phrase"))).count()
    assert made.value == 3


def test_runs_of_a_batch_are_those_of_each_text(spark):
    texts = ["L'été -- d'Été, été", "'-'", "", None, "a-b' c\U0001f600d ÿ-×", "the of", "x\ncancer the\tx cancer the", "İK straße"]
    word, want = re.compile(r"[A-Za-zÀ-ÿ](?:[A-Za-zÀ-ÿ'-]*[A-Za-zÀ-ÿ])?"), []
    for key, text in enumerate(texts):
        spans = [m.span() for m in word.finditer(text or "")]
        for n in (1, 2, 3):
            for i in range(len(spans) - n + 1):
                phrase = " ".join(text[a:b] for a, b in spans[i : i + n])
                if n > 1 or phrase.lower() not in config.SKIP_WORDS:
                    want.append((key, phrase, spans[i][0], spans[i + n - 1][1]))
    frame = spark.createDataFrame(list(enumerate(texts)), "note_id int, text string").coalesce(1)
    assert sorted(map(tuple, ngrams_with_spans(frame).collect())) == sorted(want)
    phrases = frame.select("text").mapInArrow(phrase_batches(3), "phrase string")
    assert sorted(r["phrase"] for r in phrases.collect()) == sorted({w[1] for w in want})
    held = phrases.where("phrase LIKE '%cancer%'")
    slots = phrase_slots(held)
    assert np.unpackbits(slots).sum() == held.count()
    some = frame.mapInArrow(gram_batches(3, slots), "note_id int, phrase string, span_start int, span_end int")
    assert sorted(map(tuple, some.collect())) == sorted(w for w in want if "cancer" in w[1])
