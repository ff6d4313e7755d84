"""Named queries: cleaning, dictionary matching, entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteworks import config
from noteworks.functions import text as T
from noteworks.operators import concepts as C
from noteworks.plans import tables
from noteworks.plans.registry import query
from noteworks.plans.tables import with_tables

# ---- SQL twin of the matcher: mark every word, then one leftmost alternation, longest first -------


def _mark(alias: str) -> str:
    import re

    return re.sub(r"(\w+)", r"‹\1›", alias)


def _alias_rows() -> dict[str, str]:
    last: dict[str, str] = {}
    for concept, label, aliases, _bucket, _ord in tables.LEXICON:
        for term in (label, *aliases):
            last[term.lower().strip()] = concept
    return last


_ALIASES = _alias_rows()
_PATTERN = "|".join(_mark(a) for a in sorted((a for a in _ALIASES if len(a) >= 2), key=lambda a: (-len(a), a)))
_ALIAS_VALUES = ", ".join(f"('{a}', '{c}')" for a, c in _ALIASES.items())

MATCHED = f"""
alias_map(alias, concept_id) AS (VALUES {_ALIAS_VALUES}),
marked AS (SELECT note_id, client_id, language,
                  regexp_replace(lower(text), '([\\p{{L}}\\p{{N}}_]+)', '‹\\1›', 'g') AS body FROM notes),
cut AS (SELECT note_id, client_id, language, regexp_extract_all(body, '{_PATTERN}') AS hits,
               regexp_split_to_array(body, '{_PATTERN}') AS gaps FROM marked),
walk AS (SELECT note_id, client_id, language, unnest(range(1, len(hits) + 1)) AS i,
                unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap FROM cut),
placed AS (SELECT note_id, client_id, language, i, regexp_replace(hit, '[‹›]', '', 'g') AS alias,
                  length(regexp_replace(hit, '[‹›]', '', 'g')) AS n,
                  length(regexp_replace(gap, '[‹›]', '', 'g')) AS g FROM walk),
ended AS (SELECT *, sum(n + g) OVER (PARTITION BY note_id ORDER BY i) AS stop,
                 row_number() OVER (PARTITION BY note_id, alias ORDER BY i) AS rn FROM placed),
matched AS (SELECT note_id, client_id, language, concept_id, alias AS matched_alias,
                   CAST(stop - n AS BIGINT) AS span_start, CAST(stop AS BIGINT) AS span_end
            FROM ended JOIN alias_map USING (alias) WHERE rn <= 3)
"""


def _aliases(spark):
    return C.alias_map(tables.lexicon(spark))


def _matches(spark, folder):
    return C.match_aliases(tables.notes(spark, folder), _aliases(spark))


@query("match_concepts", with_tables("notes", "," + MATCHED + """
SELECT note_id, client_id, concept_id, matched_alias, span_start, span_end FROM matched"""))
def match_concepts(spark, folder):
    return _matches(spark, folder).select(
        "note_id", "client_id", "concept_id", "matched_alias",
        F.col("span_start").cast("bigint").alias("span_start"), F.col("span_end").cast("bigint").alias("span_end"),
    )


@query("concept_counts_by_language", with_tables("notes", "," + MATCHED + """
SELECT concept_id, language, count(*) AS matches, count(DISTINCT note_id) AS notes
FROM matched GROUP BY concept_id, language"""))
def concept_counts_by_language(spark, folder):
    languages = tables.notes(spark, folder).select("note_id", "language")
    return (
        _matches(spark, folder).join(languages, "note_id").groupBy("concept_id", "language")
        .agg(F.count("*").alias("matches"), F.count_distinct("note_id").alias("notes"))
    )


@query("concept_coverage", with_tables("notes", "," + MATCHED + """
SELECT (SELECT count(*) FROM notes) AS notes, count(*) AS notes_with_concepts,
       round(count(*) * 100.0 / (SELECT count(*) FROM notes), 1) AS coverage_pct, round(avg(n), 4) AS avg_per_note
FROM (SELECT note_id, count(*) AS n FROM matched GROUP BY note_id)"""))
def concept_coverage(spark, folder):
    return C.detection_coverage(tables.notes(spark, folder), _matches(spark, folder))


@query("top_detected_concepts", with_tables("notes", "," + MATCHED + f""",
labels(concept_id, label) AS (VALUES {", ".join(f"('{c[0]}', '{c[1]}')" for c in tables.LEXICON)})
SELECT concept_id, label, matches FROM (
  SELECT concept_id, count(*) AS matches FROM matched GROUP BY 1 ORDER BY matches DESC, concept_id LIMIT 10)
JOIN labels USING (concept_id)"""))
def top_detected_concepts(spark, folder):
    return C.top_detected(_matches(spark, folder), tables.lexicon(spark))


@query("clean_text", r"""
SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS digest,
       CAST(length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS BIGINT) AS n_chars FROM documents""")
def clean_text(spark, folder):
    cleaned = T.clean_text(F.col("text"))
    return tables.read(spark, folder, "documents").select(
        "doc_id", F.md5(cleaned).alias("digest"), F.length(cleaned).cast("bigint").alias("n_chars")
    )
