"""Scalar functions, spans, entities and candidates on small literals."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from noteworks import config
from noteworks.functions import rules, spans
from noteworks.functions import text as T
from noteworks.operators import concepts as C
from noteworks.operators import keyphrases as K


def value(spark, column, **given):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]) if given else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, want", [(None, ""), ("  a \n\t b c ", "a b c"), ("", "")])
def test_clean_text(spark, raw, want):
    assert value(spark, T.clean_text(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw, want", [(" français ", "FR"), ("Deutsch", "DE"), ("portuguese", "PO"), ("x", "X")])
def test_normalize_language(spark, raw, want):
    assert value(spark, T.normalize_language(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw, want", [("2025-10-12", "2025-10-12"), ("12/10/2025", "2025-10-12"), ("soon", None)])
def test_parse_date(spark, raw, want):
    got = value(spark, T.parse_date(F.col("x")).cast("date").cast("string"), x=raw)
    assert got == want


@pytest.mark.parametrize("raw, want", [
    ("leather bag", "cuir sac"), ("vip event", "événement vip"), ("Black", "noir"), ("something", "something")])
def test_standardize(spark, raw, want):
    assert value(spark, T.standardize_terms(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw, want", [
    ("ab", False), ("12 34", False), ("the", False), ("the of", False), ("budget", False), ("50 ans", False), ("10k", False),
    ("cuir", True), ("smith", False), ("red velvet", True), ("слово там", False)])
def test_valid_candidate(spark, raw, want):
    assert value(spark, T.is_valid_candidate(F.col("x")), x=raw) is want


def test_snippet_and_profile(spark):
    long = "a" * 50 + " golf " + "b" * 80
    got = value(spark, T.snippet(F.col("x"), F.lit("golf")), x=long)
    assert got.startswith("…") and got.endswith("…") and "golf" in got
    assert value(spark, T.snippet(F.col("x"), F.lit("nothing")), x=long) == ""
    assert value(spark, T.format_profile_type(F.array(F.lit("rose_gold"), F.lit("art")))) == "Rose Gold | Art"
    assert value(spark, T.format_profile_type(F.array().cast("array<string>"))) == "General"


def test_bands_and_numbers(spark):
    assert value(spark, rules.cut_value_segment(F.lit(3000.0))) == "Low Value"
    assert value(spark, rules.cut_value_segment(F.lit(15001.0))) == "VIP"
    assert value(spark, rules.cut_risk_level(F.lit(0.0))) is None
    assert value(spark, rules.cut_risk_segment(F.lit(0.81))) == "Critical"
    assert value(spark, T.safe_float(F.lit("x"), 1.5)) == 1.5
    assert value(spark, T.safe_float(F.lit("2.5"))) == 2.5
    assert value(spark, T.split_terms(F.lit(" a | |b "))) == ["a", "b"]
    assert value(spark, T.bucket_from_rule(F.lit("bucket=intent x"))) == "intent"
    assert value(spark, T.known_synonym(F.lit("Noir"), F.lit("black"))) is True
    assert value(spark, T.share_stem(F.lit("collection"), F.lit("recollect"))) is True
    assert value(spark, T.share_stem(F.lit("taupe"), F.lit("végan"))) is False


def test_find_spans_equals_finditer(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab 1é.") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for pattern in (r"[ab]+", r"\d", r"a ?b", r"é+[ab]?"):
        got = {r["i"]: [(s["match"], s["start"], s["end"]) for s in r["s"]] for r in df.select("i", spans.find_spans(F.col("t"), pattern).alias("s")).collect()}
        for i, text in enumerate(texts):
            assert got[i] == [(m.group(), m.start(), m.end()) for m in re.finditer(pattern, text)]


ALIASES = {"leather bag": "A", "leather": "B", "bag of": "C", "of the day": "D", "rose gold": "E", "mi-4k": "F", "été": "G", "a": "H", "the": "I"}


def boundary(text, at):
    word = lambda i: 0 <= i < len(text) and bool(re.match(r"\w", text[i]))
    return word(at - 1) != word(at)


def occurrences(text, alias):
    return [m.start() for m in re.finditer(f"(?={re.escape(alias)})", text) if boundary(text, m.start()) and boundary(text, m.start() + len(alias))]


def leftmost(text, cap=3):
    low, at, out, used = text.lower(), 0, [], {}
    usable = sorted((a for a in ALIASES if len(a) >= 2), key=lambda a: -len(a))
    while at < len(low):
        hit = next((a for a in usable if low.startswith(a, at) and boundary(low, at) and boundary(low, at + len(a))), None)
        if hit is None:
            at += 1
            continue
        if used.setdefault(hit, 0) < cap:
            out.append((hit, at, at + len(hit)))
        used[hit] += 1
        at += len(hit)
    return sorted(out, key=lambda m: m[1])


def longest_first(text, cap=3):
    low, taken, out = text.lower(), [], []
    for alias in sorted((a for a in ALIASES if len(a) >= 2), key=lambda a: (-len(a), a)):
        used = 0
        for m in re.finditer(rf"\b{re.escape(alias)}\b", low):
            if any(m.start() < e and m.end() > s for s, e in taken) or used >= cap:
                continue
            taken.append(m.span())
            out.append((alias, *m.span()))
            used += 1
    return sorted(out, key=lambda m: m[1])


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    words = ["Leather", "bag", "of", "the", "day", "rose", "gold", "mi-4k", "ÉTÉ", "satin", "a", "x.", "leather,", "\n"]
    texts = ["Satin leather bag, LEATHER and bag of the day leather leather leather leather", "", "a"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    return texts, spark.createDataFrame([(i, i // 3, t) for i, t in enumerate(texts)], "note_id long, client_id long, text string")


@pytest.fixture(scope="module")
def aliases(spark):
    rows = [(c, a, [], i) for i, (a, c) in enumerate(ALIASES.items())]
    return C.alias_map(spark.createDataFrame(rows, "concept_id string, label string, aliases array<string>, ord int"))


def by_note(df):
    out = {}
    for r in df.collect():
        assert r["concept_id"] == ALIASES[r["matched_alias"]]
        out.setdefault(r["note_id"], []).append((r["matched_alias"], r["span_start"], r["span_end"]))
    return {k: sorted(v, key=lambda m: m[1]) for k, v in out.items()}


def test_matcher_is_leftmost_longest(corpus, aliases):
    texts, notes = corpus
    got = by_note(C.match_aliases(notes, aliases))
    for i, text in enumerate(texts):
        assert got.get(i, []) == leftmost(text), text


def test_large_dictionary_path_agrees(corpus, aliases, monkeypatch):
    texts, notes = corpus
    monkeypatch.setattr(C, "INLINE_ALIAS_LIMIT", 3)
    got = by_note(C.match_aliases(notes, aliases))
    for i, text in enumerate(texts):
        assert got.get(i, []) == leftmost(text), text


def test_longest_first(corpus, aliases):
    texts, notes = corpus
    got = by_note(C.match_aliases_longest_first(notes, aliases))
    for i, text in enumerate(texts):
        assert got.get(i, []) == longest_first(text), text


def test_last_alias_wins(spark):
    rows = [("A", "Noir", ["black"], 1), ("B", "black", ["Noir ", ""], 2)]
    got = C.alias_map(spark.createDataFrame(rows, "concept_id string, label string, aliases array<string>, ord int"))
    assert {r["alias"]: r["concept_id"] for r in got.collect()} == {"noir": "B", "black": "B"}


def test_budgets(spark):
    rows = [(1, 1, "Budget 3-4K, budget environ 4000€; prix: about 25K+ . Budget 5000 euros"), (2, 1, "no money"), (3, 1, "budget 5K then Budget 5K")]
    got = C.extract_budgets(spark.createDataFrame(rows, "note_id long, client_id long, text string")).orderBy("note_id", "span_start").collect()
    assert [(r["note_id"], r["matched_alias"]) for r in got] == [
        (1, "budget 3-4k"), (1, "budget 4000€"), (1, "budget 25k+"), (1, "budget 5000 eur"), (3, "budget 5k")]  # EUR comes first in the pattern
    assert (got[0]["span_start"], got[0]["span_end"]) == (0, 11)


def test_entities(spark):
    text = "Mari, 50 ans, budget around 5K, allergy to nuts, vegan, high potential. Allergie aux noix"
    got = {r["candidate"] for r in K.extract_entities(spark.createDataFrame([(1, "FR", text)], "note_id long, language string, text string")).collect()}
    assert {"mari 50 ans", "budget 5000€", "allergie noix", "végan", "client vip"} <= got


def test_yake_keeps_the_best_and_unlike(spark):
    text = "Luxury watch collection in Geneva. The luxury watch collection was shown. Geneva hosts watch makers every spring."
    rows = K.keywords_yake(spark.createDataFrame([(1, "EN", text), (2, "EN", "")], "note_id long, language string, text string"), top=5).collect()
    assert 0 < len(rows) <= 5 and all(0 < r["score"] <= 1 for r in rows)
    assert all(not set(r["candidate"].split()[:1]) & {"the", "in"} for r in rows)


def test_clean_extracted(spark):
    rows = [(1, "gold watch for a birthday", 0, " Gold Watch ", "Preferences", "0.9", "gold watch"), (1, "x", 1, "gold watch", "intent", "0.5", ""),
            (1, "x", 2, "a_b_c", "intent", "1", ""), (1, "x", 3, "thing 12", "intent", "1", ""), (1, "x", 4, "yacht", "nowhere", "1", ""),
            (1, "nothing alike", 5, "boat", "intent", "0.9", "a very big boat"), (1, "x", 6, "safe", "intent", "bad", None)]
    got = C.clean_extracted_concepts(spark.createDataFrame(rows, "note_id long, text string, pos int, label string, bucket string, confidence string, evidence string"))
    assert {(r["label"], r["bucket"], r["confidence"]) for r in got.collect()} == {("gold watch", "preferences", 0.9), ("boat", "intent", 0.6), ("safe", "intent", 0.5)}


def test_spans_of_many_pieces(spark):
    """Offsets go on over any number of pieces, and the time grows with the text, not with its square."""
    import re
    import time

    from noteworks.functions.spans import find_spans, marked_spans

    text = " é".join(f"w{i % 97}" for i in range(40_000)) + " "
    rows = spark.createDataFrame([(text,), ("",), ("é",), (None,), ("w1",)], "text string").repartition(1)
    started = time.time()
    for spans in (find_spans, marked_spans):
        got = rows.select("text", spans(F.col("text"), r"w[0-9]+").alias("s")).collect()
        for r in got:
            expected = [(m.group(), m.start(), m.end()) for m in re.finditer(r"w[0-9]+", r["text"] or "")]
            assert [tuple(x) for x in r["s"] or []] == expected
    assert time.time() - started < 60


def test_yake_moves_only_texts(spark):
    """Words stay where their text is: one exchange, however many steps follow."""
    notes = spark.createDataFrame([(1, "EN", "The Red Ring is here. A red ring is gold. Gold rings shine."), (None, "EN", "Gold rings shine.")],
                                  "note_id long, language string, text string")
    made = K.keywords_yake(notes)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    found = made.collect()
    assert found and all(r["note_id"] == 1 for r in found)  # notes without an id have no phrase


def test_entities_are_those_of_plain_patterns(spark):
    """Patterns tried at the beginnings of words only, and where their last part stands at all, find the same."""
    bits = ["paul", "anna", "12", "34 ans", ", 12 ans", "12 ansanna 15 ans", "0112 ans", "the 20 ans", "years old", "40 year old", "77jahre", "5 anni", "é1 22 años",
            "nuts allergy", "the allergy", "allergie aux noix", "allergy au pollen", "intolérance au lait", "budget 5k", "budget de environ 10 - 20 k",
            "presupuesto de 7 €", "9k flexible", "3 - 4 k budget", "a\u0301b 33 ans", "\U0001f600 44 ans", ",", "\n", "vegan", "VIP"]
    rng = random.Random(3)
    texts = ["", "x", *[rng.choice(("", " ")).join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(250)],
             *[" ".join(rng.choices(bits, k=60)) for _ in range(50)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "note_id long, text string").cache()
    low = F.lower("text")
    families = [config.BUDGET_ENTITY_PATTERNS, config.AGE_ENTITY_PATTERNS, config.ALLERGY_ENTITY_PATTERNS]
    found = 0
    for pattern in [p for family in families for p in family]:
        rows = df.select(K._all(low, pattern, 1).alias("a"), F.transform(F.regexp_extract_all(low, F.lit("(?U)" + pattern), F.lit(1)), lambda m: F.trim(m)).alias("b")).collect()
        assert [(t, r.a, r.b) for t, r in zip([*texts, None], rows) if r.a != r.b] == []
        found += sum(len(r.b or []) for r in rows)
    assert found > 300
    for pattern in config.AGE_ENTITY_PATTERNS:
        for n in (1, 2):
            whole = F.regexp_extract_all(low, F.lit("(?U)" + pattern), F.lit(n))
            again = F.transform(K._all(low, pattern, 0), lambda m: F.regexp_extract(m, "(?U)" + pattern, n))  # noqa: B023
            assert all(r.a == r.b for r in df.select(whole.alias("a"), again.alias("b")).collect())


def test_entities_of_a_long_word(spark):
    """Each letter of a word was tried as the beginning of a name, to the end of the word."""
    begun = time.time()
    got = value(spark, K.entities(F.concat(F.repeat(F.col("x"), 400000), F.lit(" paul 12 ans"))), x="a")
    assert [e["entity"] for e in got] == ["paul 12 ans"] and time.time() - begun < 30
