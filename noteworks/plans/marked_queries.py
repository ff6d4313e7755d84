"""Named queries: detection and redaction where there is something to find.

The sample documents hold no personal or protected data, so frequent words of theirs are replaced by such data, the
same way in Spark and in SQL, over the whole table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from noteworks import config, patterns
from noteworks.operators import keyphrases as K
from noteworks.operators import privacy as P
from noteworks.operators import sensitive_scan as N
from noteworks.plans import tables
from noteworks.plans.privacy_queries import _AUDITED, _CARD, _EMAIL, _FINDINGS, _IBAN, _PERSONAL, _PHONES, _quote
from noteworks.plans.registry import query
from noteworks.session import literal_table

MARKS = {
    "with": "fabric", "from": "divorce", "was": "trade union", "und": "cancer", "que": "casher", "zu": "prison", "by": "debts",
    "this": "jane.doe@example.org", "are": "01 23 45 67 89", "des": "75002 Paris.", "an": "4111 1111 1111 1111",
    "den": "FR76 3000 4000 5000 1000 1", "ein": "Mme Dupont,", "er": "192.168.1.10", "be": "born 12/03/1980,",
    "sch": "12 rue de la Paix,", "it": "fils, 12 ans", "on": "budget de 5k", "that": "allergie aux noix", "to": "vegan", "for": "client vip",
}


def _replaced(column: str) -> str:
    for word, mark in MARKS.items():
        column = f"replace({column}, ' {word} ', ' {mark} ')"
    return column


_MARKED = f"marked AS (SELECT doc_id, lang, {_replaced('text')} AS text FROM documents)"


def marked_documents(spark, folder):
    docs = tables.spread(tables.read(spark, folder, "documents").select("doc_id", "lang", "text"))
    return docs.withColumn("text", F.expr(_replaced("text")))


def _on(source: str, sql: str) -> str:
    return sql.replace("FROM documents", f"FROM {source}")


@query("detect_sensitive_marked", f"WITH {_MARKED}," + _on("marked", _FINDINGS) + """
SELECT doc_id, category, matched, span_start, span_end FROM findings""")
def detect_sensitive_marked(spark, folder):
    return P.detect_sensitive(marked_documents(spark, folder), key="doc_id").select(
        "doc_id", "category", "matched", F.col("span_start").cast("bigint").alias("span_start"),
        F.col("span_end").cast("bigint").alias("span_end"))


# Findings of one place: the first pattern wins; the text between them is put together again.
_REDACTED = f"""
personal AS (SELECT doc_id, {_PERSONAL} AS text FROM marked),
""" + _on("personal", _FINDINGS).replace("findings AS", "in_personal AS").replace("rules(", "rules2(").replace(
    "JOIN rules ", "JOIN rules2 ").replace("raw AS", "raw2 AS").replace("FROM raw)", "FROM raw2)").replace("walk AS", "walk2 AS").replace(
    "FROM walk)", "FROM walk2)").replace("placed AS", "placed2 AS").replace("FROM placed", "FROM placed2") + f""",
single AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, span_start ORDER BY category_order, rank) AS rn
                          FROM (SELECT *, list_position([{", ".join(f"'{c}'" for c in patterns.SENSITIVE)}], category) AS category_order FROM in_personal))
           WHERE rn = 1),
cut AS (SELECT doc_id, category, span_start, span_end, lag(span_end, 1, 0) OVER (PARTITION BY doc_id ORDER BY span_start) AS before FROM single),
body AS (SELECT doc_id, string_agg(text[before + 1 : span_start] || '[SENSITIVE:' || category || ']', '' ORDER BY span_start) AS head,
                max(span_end) AS last FROM cut JOIN personal USING (doc_id) GROUP BY doc_id),
redacted AS (SELECT doc_id, trim(regexp_replace(coalesce(head, '') || text[coalesce(last, 0) + 1 :], '\\s+', ' ', 'g')) AS text
             FROM personal LEFT JOIN body USING (doc_id))
"""


@query("redact_marked", f"WITH {_MARKED}," + _REDACTED + """
SELECT doc_id, md5(text) AS digest, CAST(len(regexp_extract_all(text, '\\[SENSITIVE:')) AS BIGINT) AS protected FROM redacted""")
def redact_marked(spark, folder):
    """The whole redaction, protected categories included, on texts that hold them."""
    done = marked_documents(spark, folder).select("doc_id", P.redact_pii(F.col("text")).alias("text"))
    return done.select("doc_id", F.md5("text").alias("digest"),
                       F.size(F.regexp_extract_all("text", F.lit(r"\[SENSITIVE:"), F.lit(0))).cast("bigint").alias("protected"))


@query("audit_marked", f"WITH {_MARKED}," + _on("marked", _FINDINGS + "," + _AUDITED) + """
SELECT doc_id, CAST(violation_count AS BIGINT) AS violation_count, risk_level FROM audited""")
def audit_marked(spark, folder):
    return P.audit_text(marked_documents(spark, folder)).select(
        "doc_id", F.col("violation_count").cast("bigint").alias("violation_count"), "risk_level")


@query("sanitize_training_rows", f"WITH {_MARKED}," + _on("marked", _FINDINGS + "," + _AUDITED) + "," + _REDACTED + """
SELECT doc_id, violation_count > 0 AS has_violations, md5(CASE WHEN violation_count > 0 THEN r.text ELSE m.text END) AS digest
FROM audited JOIN marked m USING (doc_id) JOIN redacted r USING (doc_id)""")
def sanitize_training_rows(spark, folder):
    """Rows as they go into training: redacted where the audit finds something, untouched elsewhere."""
    rows = P.sanitize_training_data(marked_documents(spark, folder).select("doc_id", "text"))
    return rows.select("doc_id", "has_violations", F.md5("text").alias("digest"))


def _unicode(pattern: str) -> str:
    return _quote(pattern.replace(r"\w", r"[\p{L}\p{N}_]"))


_STOP = "[" + ", ".join(f"'{_quote(w)}'" for w in config.STOPWORDS) + "]"
_BUDGETS = " UNION ALL ".join(
    f"SELECT doc_id, 'budget ' || regexp_replace(unnest(regexp_extract_all(t, '{_quote(p)}', 1)), '(\\d+)\\s*[kK]', '\\1000€', 'g') AS candidate, 0.9 AS score FROM low"
    for p in config.BUDGET_ENTITY_PATTERNS)
_AGES = " UNION ALL ".join(
    f"SELECT doc_id, unnest(regexp_extract_all(t, '{_unicode(p)}', 1)) AS who, unnest(regexp_extract_all(t, '{_unicode(p)}', 2)) AS age FROM low"
    for p in config.AGE_ENTITY_PATTERNS)
_ALLERGIES = " UNION ALL ".join(
    f"SELECT doc_id, unnest(regexp_extract_all(t, '{_unicode(p)}', 1)) AS w FROM low" for p in config.ALLERGY_ENTITY_PATTERNS)
_DIETS = " UNION ALL ".join(
    f"SELECT doc_id, '{name}' AS candidate, 0.9 AS score FROM low WHERE regexp_matches(t, '{_unicode(p)}')" for p, name in config.DIET_ENTITY_PATTERNS)


@query("entity_mentions_marked", f"WITH {_MARKED}," + f"""
low AS (SELECT doc_id, lower(text) AS t FROM marked),
found AS ({_BUDGETS}
  UNION ALL SELECT doc_id, who || ' ' || age || ' ans', 0.7 FROM ({_AGES}) WHERE NOT list_contains({_STOP}, who) AND NOT regexp_full_match(who, '[0-9]+')
  UNION ALL SELECT doc_id, 'allergie ' || w, 0.85 FROM ({_ALLERGIES}) WHERE NOT list_contains({_STOP}, w)
  UNION ALL {_DIETS}
  UNION ALL SELECT doc_id, 'client vip', 0.8 FROM low WHERE regexp_matches(t, '{_unicode(config.LOYALTY_ENTITY_PATTERN)}'))
SELECT doc_id, candidate, CAST(score AS DOUBLE) AS score, count(*) AS mentions FROM found GROUP BY ALL""")
def entity_mentions_marked(spark, folder):
    notes = marked_documents(spark, folder).select(F.col("doc_id").alias("note_id"), F.col("lang").alias("language"), "text")
    return K.extract_entities(notes).groupBy(F.col("note_id").alias("doc_id"), "candidate", "score").agg(F.count("*").alias("mentions"))


# Web pages as files: numbers inside loss curves and the like are no phone numbers.
PAGE_MARKS = {"the": "jane.doe@example.org", "and": "01 23 45 67 89", "to": "\"loss\": 01 23 45 67 89", "in": "4111 1111 1111 1111",
              "is": "0.4111 1111 1111 1111", "der": "FR76 3000 4000 5000 1000 1", "und": "4111-1111-1111-1111"}


def _page_text(column: str) -> str:
    for word, mark in PAGE_MARKS.items():
        column = f"replace({column}, ' {word} ', ' {mark} ')"
    return column


_NUMERIC = (".", '"loss"', '"accuracy"', '"epoch"', "e-", "E-")
_FILE_RULES = [("EMAIL", "high", _EMAIL, 0, ()), *[("PHONE", "high", p, 5, _NUMERIC) for p in _PHONES],
               ("CREDIT_CARD", "critical", _CARD, 10, ("0.", '": ')), ("IBAN", "critical", _IBAN, 10, (": 0.", ", 0.", "[0.", ": "))]
_FILE_ROWS = ", ".join(
    f"({i}, '{risk}', '{_quote(p)}', {width}, [{', '.join(repr(x) for x in bad)}]::VARCHAR[])" for i, (_, risk, p, width, bad) in enumerate(_FILE_RULES))


@query("audit_page_files", f"""
WITH files AS (SELECT url AS path, {_page_text('html')} AS text FROM pages),
rules(rank, risk, pattern, width, bad) AS (VALUES {_FILE_ROWS}),
raw AS (SELECT path, text, rank, risk, width, bad, regexp_extract_all(text, pattern) AS hits, regexp_split_to_array(text, pattern) AS gaps
        FROM files JOIN rules ON regexp_matches(text, pattern)),
walk AS (SELECT * EXCLUDE (hits, gaps), unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap FROM raw),
placed AS (SELECT *, CAST(sum(length(hit) + length(gap)) OVER (PARTITION BY path, rank ORDER BY i) AS BIGINT) AS stop FROM walk),
near AS (SELECT *, text[greatest(stop - length(hit) - width, 0) + 1 : stop + width] AS around FROM placed)
SELECT path, count(*) AS violations, CASE WHEN count_if(risk = 'critical') > 0 THEN 'critical' ELSE 'high' END AS risk_level
FROM near WHERE len(list_filter(bad, lambda x: contains(around, x))) = 0 GROUP BY path""")
def audit_page_files(spark, folder):
    """Findings file by file, beside the report of ``audit_pages``."""
    pages = tables.spread(tables.read(spark, folder, "pages").select("url", "html"))
    return P.audit_artifacts(pages.select(F.col("url").alias("path"), F.expr(_page_text("html")).alias("text")))


# ---- protected mentions that no pattern knows -----------------------------------------------------------

# Vectors of letter counts stand for a model: SQL can compute them, and words of the same letters are alike.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
TRAINING = [
    ("HEALTH_DATA", "cancer"), ("HEALTH_DATA", "cancer and tumor"), ("CRIMINAL_RECORD", "prison"), ("CRIMINAL_RECORD", "in the prison"),
    ("FINANCIAL_DIFFICULTY", "debts"), ("FINANCIAL_DIFFICULTY", "the debts"), ("FAMILY_CONFLICT", "divorce"),
    ("SAFE", "fabric"), ("SAFE", "the and of"), ("SAFE", "handle"), ("SAFE", "their"), ("SAFE", "into"), ("SAFE", "there is"),
]
_WORD = r"[A-Za-zÀ-ÿ](?:[A-Za-zÀ-ÿ'-]*[A-Za-zÀ-ÿ])?"


def letter_vectors(phrases):
    first, size = ord(LETTERS[0]), len(LETTERS)

    @F.arrow_udf("array<double>")
    def unit(low: pa.Array) -> pa.Array:
        data = low.cast(pa.large_binary())
        ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        letters = np.frombuffer(data.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.int64) - first
        row = np.repeat(np.arange(len(data)), np.diff(ends))
        known = (letters >= 0) & (letters < size)
        counts = np.bincount(row[known] * size + letters[known], minlength=len(data) * size).reshape(len(data), size).astype(np.float64)
        length = np.sqrt((counts * counts).sum(1))
        made = counts / np.where(length > 0, length, 1)[:, None]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(data) + 1, dtype=np.int32) * size), pa.array(made.ravel()))
        return pc.if_else(data.is_valid(), lists, None) if data.null_count else lists

    return phrases.withColumn("embedding", unit(F.lower("phrase")))


def training_phrases(spark):
    return literal_table(spark, TRAINING, "category string, phrase string")


_COUNTS = f"list_transform(string_split('{','.join(LETTERS)}', ','), lambda c: CAST(length(lower(phrase)) - length(replace(lower(phrase), c, '')) AS DOUBLE))"
_SCAN = f"""
toks AS (SELECT doc_id, regexp_extract_all(text, '{_quote(_WORD)}') AS hits, regexp_split_to_array(text, '{_quote(_WORD)}') AS gaps FROM marked),
flat AS (SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS w, unnest(gaps[1:len(hits)]) AS gap FROM toks),
words AS (SELECT doc_id, i, w, CAST(sum(length(w) + length(gap)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop FROM flat),
next AS (SELECT *, lead(w) OVER own AS w2, lead(stop) OVER own AS stop2, lead(w, 2) OVER own AS w3, lead(stop, 2) OVER own AS stop3
         FROM words WINDOW own AS (PARTITION BY doc_id ORDER BY i)),
grams AS (SELECT doc_id, w AS phrase, stop - length(w) AS s, stop AS e FROM next WHERE lower(w) NOT IN ({", ".join(f"'{w}'" for w in config.SKIP_WORDS)})
  UNION ALL SELECT doc_id, w || ' ' || w2, stop - length(w), stop2 FROM next WHERE w2 IS NOT NULL
  UNION ALL SELECT doc_id, w || ' ' || w2 || ' ' || w3, stop - length(w), stop3 FROM next WHERE w3 IS NOT NULL),
known(category, phrase) AS (VALUES {", ".join(f"('{c}', '{p}')" for c, p in TRAINING)}),
refs AS (SELECT category, {_COUNTS} AS v FROM known),
vectors AS (SELECT phrase, {_COUNTS} AS v FROM (SELECT DISTINCT phrase FROM grams)),
cosines AS (SELECT phrase, category, round(max(CASE WHEN list_sum(vectors.v) > 0 THEN list_cosine_similarity(vectors.v, refs.v) ELSE 0 END), 9) AS c
            FROM vectors, refs GROUP BY ALL),
scored AS (SELECT phrase, max(c) FILTER (WHERE category <> 'SAFE') AS score, max(c) FILTER (WHERE category = 'SAFE') AS safe,
                  arg_max(category, (c, -ascii(category[1]), -ascii(category[2]))) FILTER (WHERE category <> 'SAFE') AS label FROM cosines GROUP BY phrase),
good AS (SELECT * FROM scored WHERE score >= 0.82 AND score > safe + 0.05),
hits AS (SELECT doc_id, {{'k': -round(score, 4), 's': s, 'e': e, 'phrase': phrase, 'label': label}} AS h FROM grams JOIN good USING (phrase) JOIN marked USING (doc_id)
         WHERE NOT regexp_matches(text[greatest(s - 40, 0) + 1 : e + 40], '{_quote(patterns.HARMLESS_CONTEXT.replace("(?iU)", "(?i)"))}')),
greedy AS (SELECT doc_id, list(h ORDER BY h) AS todo, list(h)[1:0] AS kept FROM hits GROUP BY doc_id
  UNION ALL SELECT doc_id, list_filter(todo, lambda x: x.s >= todo[1].e OR x.e <= todo[1].s), list_append(kept, todo[1]) FROM greedy WHERE len(todo) > 0),
alone AS (SELECT doc_id, unnest(kept) AS h FROM greedy WHERE len(todo) = 0)
"""


def _scan_rows(hits):
    return hits.select("doc_id", "token", "label", "score", F.col("span_start").cast("bigint").alias("span_start"), F.col("span_end").cast("bigint").alias("span_end"))


_SHOWN = "SELECT doc_id, h.phrase AS token, h.label AS label, -h.k AS score, h.s AS span_start, h.e AS span_end FROM alone"


@query("sensitive_novel_hits", f"WITH RECURSIVE {_MARKED}," + _on("marked", _FINDINGS) + f",{_SCAN}{_SHOWN}" + """
WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.doc_id = alone.doc_id AND h.s < f.span_end AND h.e > f.span_start)""")
def sensitive_novel_hits(spark, folder):
    """The hits that no pattern finds."""
    references = N.fit_references(training_phrases(spark), letter_vectors)
    return _scan_rows(N.sensitive_scan(marked_documents(spark, folder), references, embed=letter_vectors, key="doc_id"))
