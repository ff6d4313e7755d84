"""Redaction and audit on literals."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from noteworks import patterns
from noteworks.functions.spans import context, find_spans
from noteworks.operators import privacy as P


def redact(spark, text, **kw):
    return spark.range(1).select(P.redact_pii(F.lit(text), P.RedactionConfig(**kw)).alias("r")).first()["r"]


@pytest.mark.parametrize("text, want", [
    ("Write to jean.dupont@example.com now", "Write to [EMAIL] now"),
    ("Call 06 12 34 56 78 or +33 6 12 34 56 78", "Call [PHONE] or [PHONE]"),
    ("Call (212) 555-1234", "Call [PHONE]"),
    ("Card 4111 1111 1111 1111 ok", "Card [CREDIT_CARD] ok"),
    ("Née le 12/03/1980", "[DATE_OF_BIRTH]"),
    ("From 192.168.1.10 today", "From [IP_ADDRESS] today"),
    ("M. Jean Dupont came", "[PERSON] came"),
    ("Lives at 12 rue de la Paix, 75002 Paris", "Lives at [ADDRESS], [POSTAL_CODE] [CITY]"),
    ("She has diabetes", "She has [SENSITIVE:HEALTH_DATA]"),
    ("nothing  to\nsee", "nothing to see"),
    ("", ""),
])
def test_redact(spark, text, want):
    assert redact(spark, text) == want


def test_redact_options(spark):
    assert redact(spark, "a@b.com", emails=False) == "a@b.com"
    assert redact(spark, "mail a@b.com", placeholder="") == "mail"
    assert redact(spark, "mail a@b.com", placeholder="[***]") == "mail [***]"
    assert redact(spark, "has cancer", sensitive_mode="log") == "has cancer"
    assert redact(spark, "has cancer", sensitive_mode="redact") == "has [SENSITIVE_HEALTH_DATA]"
    assert redact(spark, "mme durand left", name_case_sensitive=False) == "[PERSON]"


def test_harmless_context_and_spans(spark):
    df = spark.createDataFrame([(1, "tissu motif temple"), (2, "an allergy, and a divorce last year")], "note_id long, text string")
    got = {(r["note_id"], r["category"], r["matched"], r["span_start"], r["span_end"]) for r in P.detect_sensitive(df).collect()}
    assert got == {(2, "HEALTH_DATA", "allergy", 3, 10), (2, "FAMILY_CONFLICT", "divorce", 18, 25)}


def test_audit_levels(spark):
    rows = [(1, "plain words"), (2, "a@b.com and c@d.org"), (3, "75002 Paris"), (4, "cancer and diabetes a@b.com")]
    got = {r["note_id"]: (r["violation_count"], r["risk_level"]) for r in P.audit_text(spark.createDataFrame(rows, "note_id long, text string")).collect()}
    assert got == {1: (0, "compliant"), 2: (2, "high"), 3: (1, "medium"), 4: (2, "critical")}


def test_similarity_hits(spark):
    phrases = spark.createDataFrame(
        [(1, "sick leave", 0, 10, [1.0, 0.0]), (1, "leave", 5, 10, [0.9, 0.436]), (1, "nice bag", 20, 28, [0.0, 1.0]), (2, "blue", 0, 4, [0.5, 0.866])],
        "note_id long, phrase string, span_start int, span_end int, embedding array<double>")
    refs = [("HEALTH_DATA", [1.0, 0.0]), ("SAFE", [0.0, 1.0])]
    texts = spark.createDataFrame([(1, "sick leave and then nice bag"), (2, "blue")], "note_id long, text string")
    got = P.sensitive_by_similarity(phrases, refs, texts).collect()
    assert [(r["note_id"], r["token"], r["label"]) for r in got] == [(1, "sick leave", "HEALTH_DATA")]
    done = P.apply_hits(texts, P.sensitive_by_similarity(phrases, refs, texts))
    assert {r["text"] for r in done.collect()} == {"[SENSITIVE:HEALTH_DATA] and then nice bag", "blue"}


def test_strict_mode(spark):
    df = spark.createDataFrame([(1, "a@b.com")], "note_id long, text string")
    with pytest.raises(ValueError):
        P.sanitize_training_data(df, enabled=False)
    assert P.sanitize_training_data(df).first()["text"] == "[EMAIL]"


def test_artifacts(spark):
    rows = [("m.json", '{"loss": 0.9324999999999999, "mail": "x@y.com"}'), ("clean.json", '{"accuracy": 0.061234567891}')]
    got = P.audit_artifacts(spark.createDataFrame(rows, "path string, text string")).collect()
    assert [(r["path"], r["violations"], r["risk_level"]) for r in got] == [("m.json", 1, "high")]


def test_findings_are_those_of_every_pattern(spark):
    """One scan finds what 43 scans find: overlapping patterns, other cases and alphabets, marks, far places."""
    odd = ["trade union member trade union", "TRADE\n UNION", "union  member of party", "ordonnance de protection", "anorexique",
           "\u017fyndicat", "\u212aosher", "\u0130nfraction", "\ue000cancer\ue001", "fichier Banque  de France", "xcancer cancerx", "cancer\u0301 de",
           "commentaire sur le physique", "non-binary non binaire", "tissu cancer", "garde des enfants", "LGBTQ lgbt", "opérations médicales",
           "comité d'entreprise", "over-indebted", "condamnation", "\U0001f600 gay", "vie sexuelle", "dettes dette", "crimes crime", "fichie FICP"]
    plain = ["and", "of", "house", "fabrics", ",", "  ", "the", "z" * 30]
    rng = random.Random(5)
    texts = [*odd, "", *[" ".join(rng.choices(odd + plain * 3, k=rng.choice((5, 60, 400)))) for _ in range(30)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "note_id long, text string").cache()
    got = {tuple(r) for r in P.detect_sensitive(df).collect()}
    want = set()
    for category, regexes in patterns.SENSITIVE.items():
        for regex in regexes:
            rows = df.select("note_id", "text", F.explode(find_spans(F.col("text"), "(?iU)" + regex)).alias("s")).where(
                ~context(F.col("text"), F.col("s.start"), F.col("s.end"), 40).rlike(patterns.HARMLESS_CONTEXT))
            want |= {(r.note_id, category, r.s.match, r.s.start, r.s.end) for r in rows.collect()}
    assert got == want and len(want) > 500


def test_long_texts_take_linear_time(spark):
    """A text with many findings took a walk from its start, and a look at all the others, for each of them."""
    text = "a divorce, some cancer and debts of x@y.com. " * 4000
    df = spark.createDataFrame([(1, text)], "note_id long, text string")
    begun = time.time()
    assert P.audit_text(df).first()["violation_count"] == 4003
    assert P.sanitize_training_data(df).first()["text"].count("[SENSITIVE:") == 12000
    assert time.time() - begun < 40


def test_report_of_rows_with_and_without_violations(spark):
    rows = [(1, "plain"), (2, "a@b.com c@d.org cancer"), (3, None), (4, "75002 Paris a@b.com")]
    audited = P.audit_text(spark.createDataFrame(rows, "note_id long, text string"))
    assert P.sanitize_report(audited).first()["report"] == '{"total":4,"filtered":2,"pii_types":{"ADDRESS":1,"EMAIL":3,"HEALTH_DATA":1}}'
    assert P.sanitize_report(audited.where("false")).first()["report"] == '{"total":0,"filtered":0,"pii_types":{}}'
    reads = P.sanitize_report(audited)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert reads == 1
