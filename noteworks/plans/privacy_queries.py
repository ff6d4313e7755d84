"""Named queries: audit and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteworks import config, patterns
from noteworks.operators import privacy as P
from noteworks.plans import tables
from noteworks.plans.registry import query

# RE2 has ASCII word classes and no look-ahead; the twins spell out what the sample corpus needs.
_EMAIL = r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
_PHONES = (
    r"\b0[1-9](?:[\s.-]?\d{2}){4}\b",
    r"\+\d{1,3}[\s.-]?\d{1,4}(?:[\s.-]?\d{2,4}){2,4}\b",
    r"\(\d{2,3}\)[\s.-]?\d{3}[\s.-]?\d{4}\b",
)
_CARD = r"\b(?:\d{4}[\s-]?){3}\d{4}\b"
_IBAN = r"\b[A-Z]{2}\d{2}[\s]?(?:\d{4}[\s]?){3,7}\d{1,4}\b"
_ID = r"\b\d{12}\b"
_BIRTH = (
    r"(?i)\b(?:né|née|naissance|né le|née le)[:\s]+\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    r"\b\d{1,2}[/-]\d{1,2}[/-](?:19|20)\d{2}\b",
)
_IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
_CITY = f"[{patterns.UPPER}][{patterns.LOWER}]+"
_POSTAL = rf"(?i)\b\d{{5}}\s+{_CITY}(?:[\s-]{_CITY})*"
_STREETS = (
    r"(?i)\b\d+\s+(?:rue|avenue|av\.|boulevard|bd\.|place|impasse|allée|chemin|quai|cours)\s+[A-Za-zÀ-ÿ\s-]+"
    r"(\s*,|\s*\d{5}|\.|$)",
    r"(?i)\b(?:bâtiment|batiment|bat\.|appartement|appt\.|étage|escalier)\s+[A-Za-z0-9]+\b",
)
_NAME = patterns.NAME_AFTER_TITLE


def _quote(text: str) -> str:
    return text.replace("'", "''")


def _nest(column: str, steps: list[tuple[str, str]]) -> str:
    for pattern, mark in steps:
        column = f"regexp_replace({column}, '{_quote(pattern)}', '{mark}', 'g')"
    return column


_PERSONAL = _nest(
    "text",
    [(_EMAIL, "[EMAIL]"), *[(p, "[PHONE]") for p in _PHONES], (_CARD, "[CREDIT_CARD]"), (_IBAN, "[IBAN]"),
     (_ID, "[ID_NUMBER]"), *[(p, "[DATE_OF_BIRTH]") for p in _BIRTH], (_IP, "[IP_ADDRESS]"),
     (_POSTAL, "[POSTAL_CODE] [CITY]"), (_STREETS[0], r"[ADDRESS]\1"), (_STREETS[1], "[ADDRESS]"),
     (_NAME, "[PERSON]")],
)


@query("redact_personal", f"""
SELECT doc_id, md5(trim(regexp_replace({_PERSONAL}, '\\s+', ' ', 'g'))) AS digest,
       CAST(len(regexp_extract_all({_PERSONAL}, '\\[[A-Z_]+\\]')) AS BIGINT) AS marks FROM documents""")
def redact_personal(spark, folder):
    cfg = P.RedactionConfig(sensitive=False)
    docs = tables.spread(tables.read(spark, folder, "documents")).select("doc_id", "text")
    done = docs.withColumn("red", P.redact_pii(F.col("text"), cfg))
    return done.select(
        "doc_id", F.md5("red").alias("digest"),
        F.size(F.regexp_extract_all("red", F.lit(r"\[[A-Z_]+\]"), F.lit(0))).cast("bigint").alias("marks"),
    )


@query("redact_turns", f"""
SELECT conv_id, turn, md5(trim(regexp_replace({_PERSONAL}, '\\s+', ' ', 'g'))) AS digest FROM conversations""")
def redact_turns(spark, folder):
    """The full redaction, protected categories included, on conversations."""
    return tables.spread(tables.read(spark, folder, "conversations")).select(
        "conv_id", "turn", F.md5(P.redact_pii(F.col("text"))).alias("digest")
    )


_SENSITIVE_ROWS = ", ".join(
    f"('{category}', {i}, '(?i){_quote(p)}')"
    for i, (category, p) in enumerate((c, p) for c, ps in patterns.SENSITIVE.items() for p in ps)
)
_HARMLESS = _quote(patterns.HARMLESS_CONTEXT.replace("(?iU)", "(?i)"))
_FINDINGS = f"""
rules(category, rank, pattern) AS (VALUES {_SENSITIVE_ROWS}),
raw AS (SELECT doc_id, text, category, rank, regexp_extract_all(text, pattern) AS hits,
               regexp_split_to_array(text, pattern) AS gaps
        FROM documents JOIN rules ON regexp_matches(text, pattern)),
walk AS (SELECT doc_id, text, category, rank, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit,
                unnest(gaps[1:len(hits)]) AS gap FROM raw),
placed AS (SELECT doc_id, text, category, rank, hit,
                  CAST(sum(length(hit) + length(gap)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS BIGINT) AS stop
           FROM walk),
findings AS (SELECT doc_id, category, rank, hit AS matched, stop - length(hit) AS span_start, stop AS span_end
             FROM placed
             WHERE NOT regexp_matches(text[greatest(stop - length(hit) - 40, 0) + 1 : stop + 40], '{_HARMLESS}'))
"""


@query("detect_sensitive", "WITH " + _FINDINGS + """
SELECT doc_id, category, matched, span_start, span_end FROM findings""")
def detect_sensitive(spark, folder):
    docs = tables.spread(tables.read(spark, folder, "documents"))
    return P.detect_sensitive(docs, key="doc_id").select(
        "doc_id", "category", "matched", F.col("span_start").cast("bigint").alias("span_start"),
        F.col("span_end").cast("bigint").alias("span_end"),
    )


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{_quote(pattern)}'))"


_AUDITED = f"""
counted AS (SELECT doc_id, {_count(_EMAIL)} AS emails, {" + ".join(_count(p) for p in _PHONES)} AS phones,
                   {_count(_POSTAL)} AS places, CAST(regexp_matches(text, '{_CARD}') AS INTEGER) AS cards,
                   CAST(regexp_matches(text, '{_IBAN}') AS INTEGER) AS ibans FROM documents),
special AS (SELECT doc_id, count(DISTINCT category) AS n FROM findings GROUP BY doc_id),
audited AS (SELECT doc_id, emails, phones, places, cards, ibans, coalesce(n, 0) AS special,
                   emails + phones + places + cards + ibans + coalesce(n, 0) AS violation_count,
                   CASE WHEN cards + ibans + coalesce(n, 0) > 0 THEN 'critical' WHEN emails + phones > 0 THEN 'high'
                        WHEN places > 0 THEN 'medium' ELSE 'compliant' END AS risk_level
            FROM counted LEFT JOIN special USING (doc_id))
"""


def _audited(spark, folder):
    docs = tables.spread(tables.read(spark, folder, "documents")).select("doc_id", "text")
    return P.audit_text(docs)


@query("audit_texts", "WITH " + _FINDINGS + "," + _AUDITED + """
SELECT doc_id, CAST(violation_count AS BIGINT) AS violation_count, risk_level FROM audited""")
def audit_texts(spark, folder):
    return _audited(spark, folder).select(
        "doc_id", F.col("violation_count").cast("bigint").alias("violation_count"), "risk_level"
    )


@query("audit_summary", "WITH " + _FINDINGS + "," + _AUDITED + """
SELECT count(*) AS total_records, count_if(violation_count > 0)::BIGINT AS records_with_violations,
       CAST(sum(violation_count) AS BIGINT) AS total_violations,
       count_if(risk_level = 'medium')::BIGINT AS medium, count_if(risk_level = 'high')::BIGINT AS high,
       count_if(risk_level = 'critical')::BIGINT AS critical, count_if(risk_level = 'compliant')::BIGINT AS compliant,
       round(count_if(violation_count = 0) / count(*) * 100, 4) AS compliance_rate FROM audited""")
def audit_summary(spark, folder):
    return P.audit_summary(_audited(spark, folder))


@query("audit_violation_types", "WITH " + _FINDINGS + "," + _AUDITED + """
SELECT type, CAST(violations AS BIGINT) AS violations FROM (
  SELECT 'EMAIL' AS type, sum(emails) AS violations FROM audited
  UNION ALL SELECT 'PHONE', sum(phones) FROM audited UNION ALL SELECT 'ADDRESS', sum(places) FROM audited
  UNION ALL SELECT 'CREDIT_CARD', sum(cards) FROM audited UNION ALL SELECT 'IBAN', sum(ibans) FROM audited
  UNION ALL SELECT category, count(DISTINCT doc_id) FROM findings GROUP BY category) WHERE violations > 0""")
def audit_violation_types(spark, folder):
    return P.violation_types(_audited(spark, folder))


@query("audit_samples", "WITH " + _FINDINGS + "," + _AUDITED + """
SELECT doc_id, risk_level, CAST(violation_count AS BIGINT) AS violation_count FROM audited
WHERE violation_count > 0 ORDER BY doc_id LIMIT 10""")
def audit_samples(spark, folder):
    return P.audit_samples(_audited(spark, folder), "doc_id").withColumn(
        "violation_count", F.col("violation_count").cast("bigint")
    )


@query("sanitize_report", "WITH " + _FINDINGS + "," + _AUDITED + """,
kinds AS (SELECT type, CAST(violations AS BIGINT) AS violations FROM (
  SELECT 'EMAIL' AS type, sum(emails) AS violations FROM audited
  UNION ALL SELECT 'PHONE', sum(phones) FROM audited UNION ALL SELECT 'ADDRESS', sum(places) FROM audited
  UNION ALL SELECT 'CREDIT_CARD', sum(cards) FROM audited UNION ALL SELECT 'IBAN', sum(ibans) FROM audited
  UNION ALL SELECT category, count(DISTINCT doc_id) FROM findings GROUP BY category) WHERE violations > 0)
SELECT '{"total":' || (SELECT count(*) FROM audited) || ',"filtered":'
       || (SELECT count(*) FROM audited WHERE violation_count > 0) || ',"pii_types":{'
       || string_agg('"' || type || '":' || violations, ',' ORDER BY type) || '}}' AS report FROM kinds""")
def sanitize_report(spark, folder):
    return P.sanitize_report(_audited(spark, folder))


@query("sensitive_ngrams", r"""
WITH tokens AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-zÀ-ÿ](?:[A-Za-zÀ-ÿ''-]*[A-Za-zÀ-ÿ])?') AS w
                FROM documents),
sizes AS (SELECT doc_id, w, len(w) AS n FROM tokens),
skips AS (SELECT doc_id, n, len(list_filter(w, lambda x: lower(x) IN (SKIP))) AS s FROM sizes)
SELECT doc_id, CAST(greatest(n - s, 0) + greatest(n - 1, 0) + greatest(n - 2, 0) AS BIGINT) AS phrases
FROM skips WHERE greatest(n - s, 0) + greatest(n - 1, 0) + greatest(n - 2, 0) > 0""".replace(
    "SKIP", ", ".join(f"'{w}'" for w in config.SKIP_WORDS)))
def sensitive_ngrams(spark, folder):
    docs = tables.spread(tables.read(spark, folder, "documents"))
    return P.ngrams_with_spans(docs, key="doc_id").groupBy("doc_id").agg(F.count("*").alias("phrases"))


@query("clean_vocabulary", f"""
SELECT item_id FROM benchmark WHERE NOT regexp_matches(text, '{_quote(_EMAIL)}')
  AND NOT regexp_matches(text, '{_CARD}') AND NOT regexp_matches(text, '{_IBAN}')
  AND NOT regexp_matches(text, '{_POSTAL}') AND {" AND ".join(f"NOT regexp_matches(text, '{p}')" for p in _PHONES)}
  AND NOT EXISTS (SELECT 1 FROM (VALUES {_SENSITIVE_ROWS}) r(category, rank, pattern)
                  WHERE regexp_matches(text, pattern))""")
def clean_vocabulary(spark, folder):
    return P.filter_sensitive_keywords(tables.read(spark, folder, "benchmark"), "text").select("item_id")


@query("audit_pages")
def audit_pages(spark, folder):
    """Report over whole web pages scanned like files; rows-only, since the exclusions need positions in each file."""
    pages = tables.spread(tables.read(spark, folder, "pages"))
    return P.audit_report(pages.select(F.col("url").alias("path"), F.col("html").alias("text")))
