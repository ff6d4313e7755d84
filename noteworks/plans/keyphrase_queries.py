"""Named queries: keyphrase mining."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from noteworks import config
from noteworks.operators import keyphrases as K
from noteworks.plans import tables
from noteworks.plans.registry import query
from noteworks.plans.tables import with_tables
from noteworks.session import literal_table

_CLASS = re.search(r"\[(.*)\]", config.TFIDF_TOKEN_PATTERN).group(1)

# Terms of the sample corpus for the scan, next to the built-in ones.
SCAN_TERMS = {**K.domain_terms(), "disgusting": "rejet", "nicht": "non", "ononst": "ononst", "of the": "du",
              "de los": "des", "thatin": "thatin", "être": "être"}

_STOP = "|".join(config.STOPWORDS)
_RAKE = f"""
bare AS (SELECT note_id, regexp_replace(regexp_replace(regexp_replace(lower(text),
           '([\\p{{L}}\\p{{N}}_]+)', '‹\\1›', 'g'), '‹(?:{_STOP})›', '|', 'g'), '[‹›]', '', 'g') AS body FROM notes),
runs AS (SELECT note_id, unnest(regexp_split_to_array(body, '[^\\p{{L}}\\p{{N}}_\\s]+')) AS run FROM bare),
lists AS (SELECT DISTINCT note_id, list_filter(regexp_split_to_array(run, '\\s+'), lambda w: w <> '') AS words
          FROM runs),
phrases AS (SELECT note_id, array_to_string(words, ' ') AS phrase, len(words) AS n, words FROM lists
            WHERE len(words) BETWEEN 1 AND 4),
words AS (SELECT note_id, phrase, n, unnest(words) AS word FROM phrases),
weights AS (SELECT *, sum(n) OVER (PARTITION BY note_id, word)::DOUBLE
                      / count(*) OVER (PARTITION BY note_id, word) AS w FROM words),
raw AS (SELECT note_id, phrase, round(sum(w), 6) AS raw FROM weights GROUP BY note_id, phrase),
ranked AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY raw DESC, encode(phrase) DESC) AS rn FROM raw),
rake AS (SELECT note_id, phrase AS candidate, raw / max(raw) OVER (PARTITION BY note_id) AS score
         FROM ranked WHERE rn <= 20)
"""


@query("rake_phrases", with_tables("notes", "," + _RAKE + """
SELECT note_id, candidate, round(score, 4) AS score FROM rake"""))
def rake_phrases(spark, folder):
    return K.keywords_rake(tables.notes(spark, folder)).select(
        "note_id", "candidate", F.round("score", 4).alias("score")
    )


_TFIDF = f"""
toks AS (SELECT note_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'),
                lambda w: regexp_full_match(w, '[{_CLASS}]{{2,}}')) AS t FROM notes),
grams AS (SELECT note_id, unnest(t) AS term FROM toks
  UNION ALL SELECT note_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM toks
  UNION ALL SELECT note_id, unnest(list_transform(range(1, len(t) - 1),
                   lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM toks),
counts AS (SELECT note_id, term, count(*) AS tf FROM grams WHERE term IS NOT NULL GROUP BY note_id, term),
vocab AS (SELECT term, sum(tf) AS corpus_tf, count(*) AS df FROM counts GROUP BY term
          HAVING count(*) <= 0.9 * (SELECT count(*) FROM notes) ORDER BY corpus_tf DESC, encode(term) LIMIT 500),
weighted AS (SELECT note_id, term, tf * (ln((1.0 + (SELECT count(*) FROM notes)) / (1 + df)) + 1) AS w
             FROM counts JOIN vocab USING (term)),
scaled AS (SELECT note_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY note_id)), 6) AS score FROM weighted),
best AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY score DESC, encode(term)) AS rn FROM scaled)
"""


@query("tfidf_terms", with_tables("notes", "," + _TFIDF + """
SELECT note_id, term AS candidate, score FROM best WHERE rn <= 30"""))
def tfidf_terms(spark, folder):
    return K.keywords_tfidf(tables.notes(spark, folder))


@query("tfidf_vocabulary", with_tables("notes", "," + _TFIDF + """
SELECT term, CAST(corpus_tf AS BIGINT) AS corpus_tf, CAST(df AS BIGINT) AS df FROM vocab"""))
def tfidf_vocabulary(spark, folder):
    rows, _ = K.tfidf_vocabulary(tables.notes(spark, folder))
    return literal_table(spark, [(r["term"], r["corpus_tf"], r["df"]) for r in rows], "term string, corpus_tf bigint, df bigint")


def _mark(term: str) -> str:
    return re.sub(r"(\w+)", r"‹\1›", term).replace("-", "\\-")


_SCAN_ROWS = ", ".join(f"('{_mark(t)}', '{f}')" for t, f in SCAN_TERMS.items())


@query("domain_scan", with_tables("notes", f""",
terms(pattern, form) AS (VALUES {_SCAN_ROWS}),
marked AS (SELECT note_id, regexp_replace(lower(text), '([\\p{{L}}\\p{{N}}_]+)', '‹\\1›', 'g') AS body FROM notes)
SELECT form AS candidate, count(*) AS hits, count(DISTINCT note_id) AS notes
FROM marked JOIN terms ON contains(body, replace(pattern, '\\-', '-')) GROUP BY form"""))
def domain_scan(spark, folder):
    return K.domain_scan(tables.notes(spark, folder), SCAN_TERMS).groupBy("candidate").agg(
        F.count("*").alias("hits"), F.count_distinct("note_id").alias("notes")
    )


@query("latin_phrases", with_tables("notes", f""",
runs AS (SELECT note_id, unnest(regexp_extract_all(text, '{config.LATIN_RUN_PATTERN}')) AS run FROM notes),
parts AS (SELECT note_id, list_filter(regexp_split_to_array(trim(run), '\\s+'), lambda w: w <> '') AS words FROM runs
          WHERE length(trim(run)) >= 3),
kept AS (SELECT note_id, array_to_string(list_filter(words, lambda w: NOT lower(w) IN (
         {", ".join(f"'{w}'" for w in config.STOPWORDS)})), ' ') AS phrase FROM parts)
SELECT note_id, count(*) AS phrases, count(DISTINCT phrase) AS distinct_phrases FROM kept WHERE phrase <> ''
GROUP BY note_id"""))
def latin_phrases(spark, folder):
    return K.extract_latin_phrases(tables.notes(spark, folder)).groupBy("note_id").agg(
        F.count("*").alias("phrases"), F.count_distinct("candidate").alias("distinct_phrases")
    )


@query("entity_mentions", with_tables("notes", """,
low AS (SELECT note_id, language, lower(text) AS t FROM notes),
ages AS (SELECT note_id, language, unnest(regexp_extract_all(t, '([\\p{L}\\p{N}_]+)\\s*,?\\s*(\\d{2})\\s*years?\\s*old', 1)) || ' '
            || unnest(regexp_extract_all(t, '([\\p{L}\\p{N}_]+)\\s*,?\\s*(\\d{2})\\s*years?\\s*old', 2)) || ' ans' AS candidate, 0.7 AS score
         FROM low),
diets AS (SELECT note_id, language, 'végan' AS candidate, 0.9 AS score FROM low WHERE regexp_matches(t, '\\b(vegan|vegano)\\b')),
vip AS (SELECT note_id, language, 'client vip' AS candidate, 0.8 AS score FROM low
        WHERE regexp_matches(t, '\\b(vip|fidèle|loyal|excellent\\s+client|high\\s+potential)\\b'))
SELECT candidate, count(*) AS mentions FROM (SELECT * FROM ages UNION ALL SELECT * FROM diets UNION ALL SELECT * FROM vip)
GROUP BY candidate"""))
def entity_mentions(spark, folder):
    return K.extract_entities(tables.notes(spark, folder)).groupBy("candidate").agg(F.count("*").alias("mentions"))


@query("yake_phrases")
def yake_phrases(spark, folder):
    """Rows only: the published features are statistical, checked by invariants in the tests."""
    return K.keywords_yake(tables.notes(spark, folder))


@query("mine_candidates", with_tables("notes", "," + _RAKE + "," + _TFIDF + f""",
terms(pattern, form) AS (VALUES {_SCAN_ROWS}),
marked AS (SELECT note_id, regexp_replace(lower(text), '([\\p{{L}}\\p{{N}}_]+)', '‹\\1›', 'g') AS body FROM notes
           WHERE length(trim(text)) >= 10),
long_rake AS (SELECT r.note_id, candidate, score FROM rake r JOIN notes n USING (note_id) WHERE length(trim(text)) >= 10),
raw_union AS (SELECT note_id, candidate, score FROM long_rake
              UNION ALL SELECT note_id, term, score FROM best WHERE rn <= 30),
stop(w) AS (VALUES {", ".join(f"('{w}')" for w in config.STOPWORDS)}),
valid AS (SELECT candidate FROM (SELECT DISTINCT candidate FROM raw_union)
          WHERE length(candidate) >= 3 AND regexp_full_match(candidate, '[a-zA-ZàâäéèêëïîôùûüçÀÂÄÉÈÊËÏÎÔÙÛÜÇáíóúñÁÍÓÚÑìòÌÒöÖßãõÃÕ@\\s\\-''.0-9]+')
            AND NOT regexp_full_match(replace(candidate, ' ', ''), '[0-9]+')
            AND candidate NOT IN (SELECT w FROM stop)
            AND len(list_filter(regexp_split_to_array(candidate, '\\s+'), lambda x: x NOT IN ({", ".join(f"'{w}'" for w in config.STOPWORDS)}))) > 0
            AND candidate NOT IN ({", ".join(f"'{w}'" for w in config.CONTEXT_REQUIRED_WORDS)})
            AND NOT regexp_full_match(candidate, '[0-9]+\\s*(ans|years|años|anni|jahre)')
            AND NOT regexp_full_match(candidate, '[0-9]+[kK]')
            AND (contains(candidate, ' ') OR candidate IN ({", ".join(f"'{w}'" for w in config.KNOWN_WORDS)}))),
standard(foreign_term, form) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in config.STANDARD_TERMS.items())}),
words_of AS (SELECT candidate, unnest(regexp_split_to_array(candidate, ' ')) AS w,
                    unnest(range(1, 1 + len(regexp_split_to_array(candidate, ' ')))) AS i FROM valid),
by_word AS (SELECT candidate, string_agg(coalesce(form, w), ' ' ORDER BY i) AS joined
            FROM words_of LEFT JOIN standard ON w = foreign_term GROUP BY candidate),
mapped AS (SELECT candidate, coalesce(form, joined) AS std FROM by_word LEFT JOIN standard ON candidate = foreign_term),
every AS (SELECT note_id, std AS candidate, score FROM raw_union JOIN mapped USING (candidate)
          UNION ALL SELECT note_id, form, 0.8 FROM marked JOIN terms ON contains(body, replace(pattern, '\\-', '-')))
SELECT candidate, count(DISTINCT note_id) AS freq_notes,
       CAST((2 * sum(CAST(round(score * 1000000) AS BIGINT)) + 100 * count(*)) // (200 * count(*)) AS BIGINT) / 10000.0
           AS avg_score
FROM every GROUP BY candidate HAVING count(DISTINCT note_id) >= 2"""))
def mine_candidates(spark, folder):
    """Without the statistical phrases, so that the whole result can be checked."""
    mined = K.mine_candidates(tables.notes(spark, folder), with_yake=False, terms=SCAN_TERMS)
    return mined.select("candidate", "freq_notes", "avg_score")


@query("mine_all_candidates")
def mine_all_candidates(spark, folder):
    """All sources, the statistical phrases too, with languages and example notes; rows only because of them."""
    mined = K.mine_candidates(tables.notes(spark, folder))
    return mined.withColumns({"languages": F.array_join("languages", "|"), "example_note_ids": F.array_join(F.transform("example_note_ids", lambda x: x.cast("string")), "|")})
