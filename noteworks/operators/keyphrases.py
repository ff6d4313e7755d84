"""Keyphrase mining: entities, statistical phrases, stop-word phrases, tf-idf and a domain scan.

Whole texts are hashed by note once; every per-note group and window after that finds its rows already
in place. Corpus-wide counts are aggregated before they travel.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteworks import config
from noteworks.functions import text as T
from noteworks.functions.spans import explode_items, let
from noteworks.operators.concepts import trie_pattern
from noteworks.operators.phrase_scores import rake_batches, yake_batches
from noteworks.session import literal_table


def by_note(notes: DataFrame) -> DataFrame:
    """Notes hashed by ``note_id``: the one exchange all per-note work below shares. Texts grow many times over once
    they are words, so the number of tasks is fixed: small partitions of text must not be put together."""
    parts = int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return notes.repartition(max(parts, 4 * notes.rdd.getNumPartitions()), "note_id")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    """What ``group`` saw at every match. A pattern that begins with a word is tried only where a word, or what the
    last match left of it, begins: the first letter that fits is always such a place. Where a part that no match can
    do without is missing, the text is not searched letter by letter."""
    first = r"(?U)(?:\b|\G)" if pattern.startswith(r"(\w+)") else "(?U)"
    found = F.transform(F.regexp_extract_all(text, F.lit(first + pattern), F.lit(group)), lambda m: F.trim(m))
    return F.when(_may_hold(text, pattern), found).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))


def _may_hold(text: Column, pattern: str) -> Column:
    """Whether ``text`` holds what ``pattern`` can't do without: its first plain word, or all that follows one."""
    if pattern.startswith(r"(\w+)"):
        rest = pattern.removeprefix(r"(\w+)").removeprefix(r"\s*,?\s*").removeprefix(r"\s+")
        return F.contains(text, F.lit(rest)) if rest.isalpha() else text.rlike("(?U)" + rest)
    plain = re.match(r"[^\W\d_]+(?![?*(\[{|])", pattern)
    return F.contains(text, F.lit(plain[0])) if plain else F.lit(True)


def _entity(label: Column, family: str) -> Column:
    return F.struct(label.alias("entity"), F.lit(config.ENTITY_SCORES[family]).alias("score"))


def entities(text: Column) -> Column:
    """Array of (entity, score): budgets, ages of people, allergies, diets, loyalty."""
    low = F.lower(text)
    groups = []
    for pattern in config.BUDGET_ENTITY_PATTERNS:
        groups.append(
            F.transform(
                _all(low, pattern),
                lambda m: _entity(F.concat(F.lit("budget "), F.regexp_replace(m, r"(\d+)\s*[kK]", "$1000€")), "budget"),
            )
        )
    for pattern in config.AGE_ENTITY_PATTERNS:
        people = F.transform(_all(low, pattern, 0), lambda m: F.struct(
            *[F.regexp_extract(m, "(?U)" + pattern, n).alias(name) for n, name in ((1, "person"), (2, "age"))]))
        pairs = F.filter(people, lambda p: ~p["person"].isin(*config.STOPWORDS) & ~p["person"].rlike(r"(?U)^\d+$"))
        groups.append(F.transform(pairs, lambda p: _entity(F.concat_ws(" ", p["person"], p["age"], F.lit("ans")), "age")))
    for pattern in config.ALLERGY_ENTITY_PATTERNS:
        words = F.filter(_all(low, pattern), lambda w: ~w.isin(*config.STOPWORDS))
        groups.append(F.transform(words, lambda w: _entity(F.concat(F.lit("allergie "), w), "allergy")))
    none = F.array().cast("array<struct<entity:string,score:double>>")
    flags = [(p, label, "diet") for p, label in config.DIET_ENTITY_PATTERNS]
    flags.append((config.LOYALTY_ENTITY_PATTERN, "client vip", "loyalty"))
    for pattern, label, family in flags:
        groups.append(F.when(low.rlike("(?U)" + pattern), F.array(_entity(F.lit(label), family))).otherwise(none))
    return F.concat(*groups)


def extract_entities(notes: DataFrame) -> DataFrame:
    rows = explode_items(notes, entities(F.col("text")), "e", "note_id", "language")
    return rows.select("note_id", "language", F.col("e.entity").alias("candidate"), "e.score")


def stopword_phrases(text: Column, stopwords: list[str] | None = None, max_words: int = 4) -> Column:
    """Distinct runs of up to ``max_words`` words between stop words and punctuation, as arrays of words."""
    return F.array_distinct(_stopword_runs(text, stopwords, max_words))


def _stopword_runs(text: Column, stopwords: list[str] | None, max_words: int) -> Column:
    """The same runs, copies too: lists are told apart one by one, so copies are better dropped where they are numbers."""
    given = config.STOPWORDS if stopwords is None else stopwords
    stop = trie_pattern(sorted(set(given))) if given and all(w.isalnum() for w in given) else "|".join(given)
    bare = F.regexp_replace(F.lower(text), rf"(?U)\b(?:{stop})\b", "|")
    runs = F.transform(F.split(bare, r"(?U)[^\w\s]+", -1), T.words)
    return F.filter(runs, lambda r: (F.size(r) >= 1) & (F.size(r) <= max_words))


def keywords_rake(notes: DataFrame, top: int = 20, stopwords: list[str] | None = None, max_words: int = 4) -> DataFrame:
    """Phrases scored by the degree over frequency of their words, scaled by the best of the note."""
    runs = _stopword_runs(F.col("text"), stopwords, max_words)
    rows = by_note(notes).sortWithinPartitions("note_id").select("note_id", "language", runs.alias("runs"))
    kinds = {f.name: f.dataType.simpleString() for f in notes.schema}
    return rows.mapInArrow(rake_batches(top), f"note_id {kinds['note_id']}, language {kinds['language']}, candidate string, score double")


def _ngrams(words: Column, low: int, high: int) -> Column:
    def of_size(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, cut).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of_size(n) for n in range(low, high + 1)])


# Above this many frequent words the n-gram passes count everything instead of carrying the words as a literal.
FREQUENT_WORD_LIMIT = 20_000


def _term_stats(notes: DataFrame, terms: Column) -> DataFrame:
    """Corpus and note frequency of the terms of each note, added up in the tasks before anything is shuffled."""

    def flagged(found: Column) -> Column:
        return F.concat(
            F.transform(found, lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df"))),
            F.transform(F.array_distinct(found), lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df"))),
        )

    rows = explode_items(notes, let(terms, flagged), "t")
    return rows.groupBy(F.col("t.term").alias("term")).agg(F.sum("t.tf").alias("corpus_tf"), F.sum("t.df").alias("df"))


def _words(pattern: str = config.TFIDF_TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))


def _frequent_ngrams(words: Column, frequent: list[str] | None, high: int) -> Column:
    """2..``high``-grams all of whose words are frequent; ``None`` means every word is."""
    if frequent is None:
        return let(words, lambda w: _ngrams(w, 2, high))

    def grams(w: Column) -> Column:
        def of_size(n: int, marks: Column) -> Column:
            starts = F.filter(
                F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.forall(F.slice(marks, i, n), lambda m: m)
            )
            cut = F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))
            return F.when(F.size(w) >= n, cut).otherwise(F.array().cast("array<string>"))

        # A word is looked up in a hash set, not in a list that grows with the note.
        known_words = F.transform(w, lambda x: x.isin(frequent))
        return let(known_words, lambda marks: F.concat(*[of_size(n, marks) for n in range(2, high + 1)]))

    return let(words, grams)


def tfidf_vocabulary(notes: DataFrame, features: int = 500, max_df: float = 0.9, min_df: int = 1, high: int = 3,
                     n_notes: int | None = None) -> tuple[list[dict], list[str] | None]:
    """The ``features`` commonest 1..``high``-grams with their counts, and the words that n-grams are made of.

    A phrase cannot be commoner than its rarest word. So single words are counted first, and longer phrases only
    where all their words reach the count of the last single word on the list. The result is exact.
    """
    total = notes.count() if n_notes is None else n_notes
    singles = _term_stats(notes, _words()).persist()
    fits = (F.col("df") <= max_df * total) & (F.col("df") >= min_df)
    order = [F.desc("corpus_tf"), F.col("term")]
    best = singles.where(fits).orderBy(*order).limit(features).collect()
    least = best[-1]["corpus_tf"] if len(best) == features else 1
    rows = singles.where(F.col("corpus_tf") >= least).select("term").limit(FREQUENT_WORD_LIMIT + 1).collect()
    frequent = sorted(r["term"] for r in rows) if len(rows) <= FREQUENT_WORD_LIMIT else None
    merged = list(best)
    if high > 1:
        longer = _term_stats(notes, _frequent_ngrams(_words(), frequent, high))
        merged += longer.where(fits & (F.col("corpus_tf") >= least)).orderBy(*order).limit(features).collect()
    singles.unpersist()
    merged.sort(key=lambda r: (-r["corpus_tf"], r["term"].encode()))
    chosen = [
        {"term": r["term"], "corpus_tf": r["corpus_tf"], "df": r["df"], "idf": math.log((1.0 + total) / (1 + r["df"])) + 1}
        for r in merged[:features]
    ]
    return chosen, frequent


def keywords_tfidf(notes: DataFrame, features: int = 500, max_df: float = 0.9, top: int = config.MAX_CANDIDATES_PER_NOTE,
                   high: int = 3) -> DataFrame:
    """Best terms of each note by tf-idf, unit length per note over the chosen vocabulary.

    The vocabulary is a table of at most ``features`` terms.
    """
    vocabulary, frequent = tfidf_vocabulary(notes, features, max_df, high=high)
    words = _words()
    every = let(words, lambda w: F.concat(w, _frequent_ngrams(w, frequent, high))) if high > 1 else words
    table = literal_table(notes.sparkSession, [(v["term"], v["idf"]) for v in vocabulary], "term string, idf double")
    # The small table is hashed in every task, so only the terms of the vocabulary reach the shuffle.
    counts = explode_items(notes, every, "term", "note_id").join(table, "term").groupBy("note_id", "term").agg(
        F.count("*").alias("tf"), F.first("idf").alias("idf")
    )
    weighted = counts.withColumn("w", F.col("tf") * F.col("idf"))
    note = Window.partitionBy("note_id")
    scaled = weighted.withColumn("score", F.round(F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(note)), 6))
    order = note.orderBy(F.desc("score"), "term")
    return scaled.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= top).select(
        "note_id", F.col("term").alias("candidate"), "score"
    )


def latin_phrases(text: Column, stopwords: list[str] | None = None) -> Column:
    """Latin runs inside mixed-script text, cut at delimiters, stop words dropped."""
    stop = list(config.STOPWORDS if stopwords is None else stopwords)  # a hash set, not a list that each word is compared with
    runs = F.regexp_extract_all(text, F.lit(config.LATIN_RUN_PATTERN), F.lit(0))
    parts = F.flatten(F.transform(runs, lambda r: F.split(r, r"[.。,،;:|/]", -1)))
    long_parts = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(p) >= 3)
    kept = F.transform(long_parts, lambda p: F.array_join(F.filter(T.words(p), lambda w: ~F.lower(w).isin(stop)), " "))
    return F.filter(kept, lambda p: p != "")


def extract_latin_phrases(notes: DataFrame) -> DataFrame:
    rows = explode_items(notes, latin_phrases(F.col("text")), "candidate", "note_id", "language")
    return rows.withColumn("score", F.lit(0.7))


def scan_terms(text: Column, terms: dict[str, str]) -> Column:
    """Standard form of each known term that stands in ``text`` as whole words; one entry per term."""
    low = F.lower(text)
    single = sorted(t for t in terms if _is_word(t))
    several = sorted(t for t in terms if not _is_word(t))
    lookup = F.create_map(*[F.lit(x) for t in single for x in (t, terms[t])])
    words = F.regexp_extract_all(low, F.lit(r"(?U)\w+"), F.lit(0))
    hits = F.transform(F.array_intersect(words, F.lit(single)), lambda w: lookup[w])
    none = F.array().cast("array<string>")
    extra = [
        F.when(low.rlike(rf"(?U)\b{_escape(t)}\b"), F.array(F.lit(terms[t]))).otherwise(none) for t in several
    ]
    return F.concat(hits, *extra) if extra else hits


def _is_word(term: str) -> bool:
    return all(c.isalnum() or c == "_" for c in term)


def _escape(term: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in term)


def domain_terms() -> dict[str, str]:
    """Default terms of the scan: every foreign term and every known word, stop words and short ones aside."""
    terms = {t.lower(): form for t, form in config.STANDARD_TERMS.items()}
    for word in config.KNOWN_WORDS:
        terms.setdefault(word.lower(), config.STANDARD_TERMS.get(word.lower(), word.lower()))
    return {t: f for t, f in terms.items() if len(t) >= 3 and t not in config.STOPWORDS}


def domain_scan(notes: DataFrame, terms: dict[str, str] | None = None) -> DataFrame:
    table = domain_terms() if terms is None else {t.lower(): f for t, f in terms.items()}
    rows = explode_items(notes, scan_terms(F.col("text"), table), "candidate", "note_id", "language")
    return rows.withColumn("score", F.lit(0.8))


def keywords_yake(notes: DataFrame, top: int = 20, max_words: int = 3, similar: float = 0.7,
                  stopwords: list[str] | None = None) -> DataFrame:
    """Single-document keyphrases from case, position, frequency, context and spread of their words.

    Follows the published feature definitions; a lower raw weight is better, the score is 1/(1+weight).
    """
    stop = list(config.STOPWORDS if stopwords is None else stopwords)
    sentences = F.filter(F.split("text", r"[.!?\n]+", -1), lambda s: F.trim(s) != "")
    words = F.transform(sentences, lambda s: F.regexp_extract_all(s, F.lit(r"(?U)\w+"), F.lit(0)))

    def flag(token: Column) -> Column:
        capital = F.when(token.rlike(r"(?U)^\p{Lu}{2,}$"), 1).when(token.rlike(r"(?U)^\p{Lu}"), 2).otherwise(0)
        return F.when(token == F.lower(token), 0).otherwise(capital)

    # A note without an id has no phrases, and a text that is null no sentences.
    kinds = {f.name: f.dataType.simpleString() for f in notes.schema}
    rows = by_note(notes.where(F.col("note_id").isNotNull() & F.col("text").isNotNull())).sortWithinPartitions("note_id")
    rows = rows.select("note_id", "language", words.alias("words")).select(
        "note_id", "language", F.transform("words", F.size).alias("sizes"), F.flatten("words").alias("tokens"))
    # The first word of a sentence may be an acronym, but no proper name.
    listed = rows.select("note_id", "language", "sizes", F.transform("tokens", F.lower), F.transform("tokens", flag)).mapInArrow(
        yake_batches(max_words, stop),
        f"note_id {kinds['note_id']}, language {kinds['language']}, list array<struct<weight:double,phrase:string>>")

    def alike(a: Column, b: Column) -> Column:
        return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)) > similar

    kept = F.aggregate(
        "list", F.array().cast("array<struct<weight:double,phrase:string>>"),
        lambda acc, c: F.when((F.size(acc) >= top) | F.exists(acc, lambda k: alike(k["phrase"], c["phrase"])), acc)
        .otherwise(F.concat(acc, F.array(c))),
    )
    return listed.select("note_id", "language", F.explode(kept).alias("k")).select(
        "note_id", "language", F.col("k.phrase").alias("candidate"), (1 / (1 + F.col("k.weight"))).alias("score")
    )


EXAMPLES = 5  # notes shown for a candidate
SHARES = 16  # groups that the notes of one candidate are dealt to


def mine_candidates(notes: DataFrame, min_notes: int = config.MIN_CANDIDATE_FREQ, with_yake: bool = True,
                    terms: dict[str, str] | None = None, known_words: list[str] | None = None) -> DataFrame:
    """All sources together: clean, validate, standardise, group, keep phrases of at least ``min_notes`` notes.

    Entities and domain terms skip validation. ``example_note_ids`` are the five smallest note ids.
    """
    usable = notes.where(F.length(F.trim("text")) >= 10)
    latin = F.col("language").isin(*config.SUPPORTED_LANGUAGES)
    languages = notes.select("note_id", "language")
    mined = [keywords_rake(usable.where(latin)), extract_latin_phrases(usable.where(~latin)),
             keywords_tfidf(notes).join(languages, "note_id").select("note_id", "language", "candidate", "score")]
    if with_yake:
        mined.append(keywords_yake(usable.where(latin)))
    checked = mined[0]
    for more in mined[1:]:
        checked = checked.unionByName(more)
    checked = checked.withColumn("candidate", T.clean_candidate(F.col("candidate"))).where(
        T.is_valid_candidate(F.col("candidate"), known_words=known_words)
    )
    trusted = extract_entities(usable).withColumn("candidate", T.clean_candidate(F.col("candidate"))).where("candidate <> ''")
    standard = checked.unionByName(trusted).withColumn("candidate", T.standardize_terms(F.col("candidate")))
    every = standard.unionByName(domain_scan(usable, terms))
    # Texts are read and mined once: a phrase's notes are dealt to ``SHARES`` groups, each of which gives its counts and
    # its first notes, so that a phrase found everywhere arrives at its group as a few rows.
    dealt = every.where("candidate IS NOT NULL").withColumn("share", F.pmod(F.xxhash64("note_id"), F.lit(SHARES)))
    per_note = dealt.repartition("candidate", "share").groupBy("candidate", "share", "note_id").agg(
        F.first("language").alias("language"), F.count("*").alias("n"),
        F.sum(F.round(F.col("score") * 1_000_000).cast("bigint")).alias("micros"),
    )
    order = Window.partitionBy("candidate", "share").orderBy("note_id")
    shares = per_note.withColumn("rn", F.row_number().over(order)).groupBy("candidate", "share").agg(
        F.collect_set("language").alias("languages"), F.count("*").alias("freq_notes"), F.sum("micros").alias("micros"), F.sum("n").alias("n"),
        F.collect_list(F.when(F.col("rn") <= EXAMPLES, F.struct("note_id"))).alias("examples"),
    )
    totals = shares.groupBy("candidate").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("languages")))).alias("languages"), F.sum("freq_notes").alias("freq_notes"),
        F.sum("micros").alias("micros"), F.sum("n").alias("n"),
        F.slice(F.array_sort(F.flatten(F.collect_list("examples"))), 1, EXAMPLES).alias("examples"),
    ).where(F.col("freq_notes") >= min_notes)
    # Whole-number arithmetic, half up: the mean does not depend on the order of addition.
    mean = F.expr("(2 * micros + 100 * n) div (200 * n)") / F.lit(10000.0)
    return totals.select("candidate", "languages", "freq_notes", mean.alias("avg_score"),
                         F.array_compact("examples.note_id").alias("example_note_ids"))
