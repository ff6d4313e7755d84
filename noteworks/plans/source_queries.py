"""Named queries: profiling, quality, extraction merges, streams."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from noteworks.functions import tables as FT
from noteworks.functions import text as T
from noteworks.operators import concepts as C
from noteworks.operators import privacy as P
from noteworks.operators.runs import stage_rows
from noteworks.plans import tables as t
from noteworks.plans.registry import query
from noteworks.plans.tables import with_tables
from noteworks.plans.text_queries import _ALIAS_VALUES, MATCHED, _aliases, _matches
from noteworks.session import ensure_checkpoint_dir
from noteworks.sources import notes as N
from noteworks.sources import profile as Pr
from noteworks.streaming import uploads as U


@query("normalize_language", """
SELECT n_name, CASE upper(trim(w)) WHEN 'FRENCH' THEN 'FR' WHEN 'DEUTSCH' THEN 'DE' WHEN 'ESPAÑOL' THEN 'ES' ELSE left(upper(trim(w)), 2) END AS code
FROM (SELECT n_name, CASE n_regionkey WHEN 0 THEN ' French ' WHEN 1 THEN 'deutsch' WHEN 2 THEN 'español' WHEN 3 THEN lower(n_name) ELSE 'x' END AS w FROM nation)""")
def normalize_language(spark, folder):
    word = F.expr("CASE n_regionkey WHEN 0 THEN ' French ' WHEN 1 THEN 'deutsch' WHEN 2 THEN 'español' WHEN 3 THEN lower(n_name) ELSE 'x' END")
    return t.read(spark, folder, "nation").select("n_name", T.normalize_language(word).alias("code"))


@query("slugs", r"""
SELECT p_partkey, left(regexp_replace(regexp_replace(lower(trim(p_name || ' (' || p_brand || ')')), '[^\w\s-]', '', 'g'), '[\s-]+', '_', 'g'), 50) AS slug,
       left(regexp_replace(translate(lower(p_name || '-' || p_brand), ' -', '__'), '[^a-z0-9_]', '', 'g'), 30) AS concept_slug FROM part""")
def slugs(spark, folder):
    name = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return t.read(spark, folder, "part").select(
        "p_partkey", T.slugify(name).alias("slug"), T.concept_slug(F.concat("p_name", F.lit("-"), "p_brand")).alias("concept_slug"))


@query("notes_quality", with_tables("notes", """
SELECT count(*) AS notes, 0 AS invalid_dates, count(*) FILTER (WHERE language NOT IN ('FR', 'EN', 'IT', 'ES', 'DE', 'PT', 'NL')) AS unknown_languages,
       count(*) FILTER (WHERE coalesce(text, '') = '') AS empty_texts, round(count(*) FILTER (WHERE coalesce(text, '') = '') / count(*) * 100, 1) AS empty_pct
FROM notes"""))
def notes_quality(spark, folder):
    return N.notes_quality(t.notes(spark, folder)).withColumn("invalid_dates", F.col("invalid_dates").cast("int"))


@query("language_counts", with_tables("notes", "SELECT language, count(*) AS notes FROM notes GROUP BY language"))
def language_counts(spark, folder):
    return N.language_counts(t.notes(spark, folder))


def _profiled(table, columns, kinds):
    parts = []
    for i, c in enumerate(columns):
        parts.append(f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count,
            round(avg(length({c})), 1) AS avg_length, '{kinds[i]}' AS purpose FROM {table}""")
    return " UNION ALL ".join(parts)


@query("profile_documents", _profiled("documents", ["text", "lang", "source"], ["text", "language", "categorical"]))
def profile_documents(spark, folder):
    docs = t.spread(t.read(spark, folder, "documents")).select("text", "lang", "source")
    return Pr.profile_table(docs).drop("position", "dtype")


@query("profile_customers", """
SELECT 'c_custkey' AS "column", count(*) AS rows, count(*) - count(c_custkey) AS null_count, count(DISTINCT c_custkey) AS unique_count, 'categorical' AS purpose FROM customer
""".replace("'categorical' AS purpose", "'numeric' AS purpose") + """ UNION ALL
SELECT 'c_name', count(*), count(*) - count(c_name), count(DISTINCT c_name), 'categorical' FROM customer UNION ALL
SELECT 'c_acctbal', count(*), count(*) - count(c_acctbal), count(DISTINCT c_acctbal), 'numeric' FROM customer UNION ALL
SELECT 'c_mktsegment', count(*), count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment), 'categorical' FROM customer""")
def profile_customers(spark, folder):
    rows = t.read(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return Pr.profile_table(rows).drop("position", "dtype", "avg_length")


@query("recommend_mapping", """
SELECT 'text' AS text_column, 'doc_id' AS id_column, 'lang' AS language_column, CAST(NULL AS VARCHAR) AS date_column FROM documents LIMIT 1""")
def recommend_mapping(spark, folder):
    return Pr.recommend_mapping(Pr.profile_table(t.spread(t.read(spark, folder, "documents"))))


@query("sample_values", """
SELECT 'lang' AS "column", lang AS value, row_number() OVER (ORDER BY lang) AS rank FROM (SELECT DISTINCT lang FROM documents) QUALIFY rank <= 3
UNION ALL SELECT 'source', source, row_number() OVER (ORDER BY source) AS rank FROM (SELECT DISTINCT source FROM documents) QUALIFY rank <= 3""")
def sample_values(spark, folder):
    return Pr.sample_values(t.read(spark, folder, "documents").select("lang", "source")).withColumn("rank", F.col("rank").cast("bigint"))


@query("standardize", """
SELECT printf('NOTE_%04d', row_number() OVER (ORDER BY p_name, p_brand, p_partkey) - 1) AS note_id, p_name AS text, p_brand AS language FROM part""")
def standardize(spark, folder):
    rows = t.read(spark, folder, "part").select("p_name", "p_brand", F.format_string("%012d", "p_partkey").alias("p_partkey"))
    return Pr.standardize(rows, "p_name", language="p_brand").select("note_id", "text", "language")


# ---- concepts: the other entry points -----------------------------------------------------------------

_BUDGET_TEXT = """budgeted AS (SELECT o_orderkey AS note_id, o_custkey AS client_id,
   CASE WHEN o_orderpriority = '1-URGENT' THEN 'Prix: about ' || CAST(floor(o_totalprice / 1000) AS BIGINT) || 'K, budget ' || CAST(floor(o_totalprice / 1000) AS BIGINT) || 'K'
        WHEN o_orderpriority = '2-HIGH' THEN 'Budget around ' || CAST(floor(o_totalprice) AS BIGINT) || '€ flexible' ELSE 'no money here' END AS text FROM orders)"""


@query("extract_budgets", "WITH " + _BUDGET_TEXT + r""",
m AS (SELECT note_id, client_id, text, regexp_extract(text, '(?i)(budget|prix)[^.;\n]{0,50}?(\d[\d.,]*\s*[kK€$£]+)', 2) AS amount FROM budgeted)
SELECT note_id, client_id, 'budget ' || lower(amount) AS matched_alias, CAST(0 AS INTEGER) AS span_start,
       CAST(CASE WHEN text LIKE 'Prix%' THEN 12 + length(amount) ELSE 14 + length(amount) END AS INTEGER) AS span_end, 'BUDGET_AMOUNT' AS concept_id
FROM m WHERE amount <> ''""")
def extract_budgets(spark, folder):
    """Notes about money, one per order; a repeated amount counts once."""
    thousand, whole = F.floor(F.col("o_totalprice") / 1000).cast("string"), F.floor("o_totalprice").cast("string")
    text = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("Prix: about "), thousand, F.lit("K, budget "), thousand, F.lit("K")))
    text = text.when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("Budget around "), whole, F.lit("€ flexible"))).otherwise("no money here")
    orders = t.read(spark, folder, "orders").select(F.col("o_orderkey").alias("note_id"), F.col("o_custkey").alias("client_id"), text.alias("text"))
    return C.extract_budgets(orders)


@query("detect_concepts", with_tables("notes", "," + MATCHED + """
SELECT note_id, concept_id, matched_alias, CAST(span_start AS INTEGER) AS span_start, 'rule-based' AS detection_method, 1.0::DOUBLE AS confidence
FROM matched"""))
def detect_concepts(spark, folder):
    found = C.detect_concepts(t.notes(spark, folder), _aliases(spark))
    return found.select("note_id", "concept_id", "matched_alias", "span_start", "detection_method", "confidence")


@query("match_concepts_longest_first", with_tables("notes", f"""
, alias_map(alias, concept_id) AS (VALUES {_ALIAS_VALUES}),
tokens AS (SELECT note_id, client_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS tok FROM (
  SELECT note_id, client_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS w FROM notes)),
placed AS (SELECT *, sum(length(tok)) OVER p - length(tok) AS s, lead(tok, 1) OVER p AS t2, lead(tok, 2) OVER p AS t3 FROM tokens
           WINDOW p AS (PARTITION BY note_id ORDER BY i)),
grams AS (SELECT note_id, client_id, s, unnest([tok, tok || t2 || t3]) AS alias FROM placed),
cand AS (SELECT note_id, client_id, list([{{'a': alias, 's': s, 'e': s + length(alias)}}] ORDER BY length(alias) DESC, alias, s) AS c
         FROM grams JOIN alias_map USING (alias) WHERE length(alias) >= 2 GROUP BY note_id, client_id),
kept AS (SELECT note_id, client_id, unnest(list_reduce(c, lambda acc, x: CASE
           WHEN len(list_filter(acc, lambda k: k.s < x[1].e AND k.e > x[1].s)) > 0 OR len(list_filter(acc, lambda k: k.a = x[1].a)) >= 3
           THEN acc ELSE list_concat(acc, x) END)) AS k FROM cand)
SELECT note_id, client_id, k.a AS matched_alias, CAST(k.s AS INTEGER) AS span_start, CAST(k.e AS INTEGER) AS span_end, concept_id
FROM kept JOIN alias_map ON alias = k.a"""))
def match_concepts_longest_first(spark, folder):
    """Other precedence, checked against a plain loop in the tests."""
    return C.match_aliases_longest_first(t.notes(spark, folder), _aliases(spark))


_EXTRACTED = """
ext AS (SELECT conv_id AS note_id, turn AS pos, lower(trim(list_extract(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), 1))) AS label FROM conversations)
"""


def _extracted(spark, folder):
    """Suggestions from outside: the first word of every turn of a conversation."""
    word = F.get(F.split(F.regexp_replace("text", r"\s+", " "), " ", -1), F.lit(0))
    return t.read(spark, folder, "conversations").select(
        F.col("conv_id").alias("note_id"), F.col("turn").alias("pos"), word.alias("label"), F.lit("Intent").alias("bucket"),
        (F.col("turn") / 4).alias("confidence"), F.col("text").alias("evidence"), "text")


@query("clean_extracted_concepts", "WITH " + _EXTRACTED + r""",
ok AS (SELECT note_id, pos, label, round(greatest(0.1::DOUBLE, least(1.0::DOUBLE, pos / 4)), 2) AS confidence FROM ext
       WHERE label <> '' AND length(label) <= 50 AND length(label) - length(replace(label, '_', '')) < 2 AND NOT regexp_matches(label, '[_ ]([2-9]|1[0-9])$'))
SELECT note_id, label, 'intent' AS bucket, arg_min(confidence, pos) AS confidence FROM ok GROUP BY note_id, label""")
def clean_extracted_concepts(spark, folder):
    return C.clean_extracted_concepts(_extracted(spark, folder))


_TERM_ORDER = [(term.lower(), cid, o, p) for cid, label, aliases, _b, o in t.LEXICON for p, term in enumerate((label, *aliases))]
_LEX_VALUES = ", ".join(f"('{a}', '{c}', {o}, {p})" for a, c, o, p in _TERM_ORDER)


@query("merge_extractions", with_tables("notes", "," + MATCHED + "," + _EXTRACTED + f""",
terms0(term, concept_id, o, p) AS (VALUES {_LEX_VALUES}),
terms AS (SELECT term, arg_max(concept_id, o * 100 + p) AS concept_id, min(o * 100 + p) AS place FROM terms0 GROUP BY term),
fresh AS (SELECT note_id, label, arg_min(CAST(pos AS DOUBLE), pos) AS pos FROM ext WHERE label <> '' AND NOT EXISTS (
            SELECT 1 FROM matched m WHERE m.note_id = ext.note_id AND m.matched_alias = label) GROUP BY note_id, label),
near AS (SELECT label, arg_min(concept_id, place) AS concept_id FROM (SELECT DISTINCT label FROM fresh) JOIN terms ON contains(label, term) OR contains(term, label) GROUP BY label)
SELECT note_id, concept_id, matched_alias, span_start, 1.0::DOUBLE AS confidence, 'rule-based' AS detection_method FROM matched
UNION ALL SELECT f.note_id, coalesce(x.concept_id, n.concept_id, 'LLM_' || left(f.label, 30)), f.label, -1, 0.5::DOUBLE, 'llm-enhanced'
FROM fresh f LEFT JOIN terms x ON x.term = f.label LEFT JOIN near n ON n.label = f.label"""))
def merge_extractions(spark, folder):
    outside = _extracted(spark, folder).select("note_id", F.lower(F.trim("label")).alias("label"), F.lit(0.5).alias("confidence")).where("label <> ''")
    merged = C.merge_extractions(_matches(spark, folder), outside, t.lexicon(spark))
    return merged.select("note_id", "concept_id", "matched_alias", F.col("span_start").cast("bigint").alias("span_start"), "confidence", "detection_method")


@query("backfill_unprocessed", with_tables("notes", "," + MATCHED + """
SELECT note_id, concept_id, count(*) AS n FROM matched WHERE note_id NOT IN (SELECT conv_id FROM conversations) GROUP BY ALL
UNION ALL SELECT conv_id, 'X', count(*) FROM conversations GROUP BY conv_id"""))
def backfill_unprocessed(spark, folder):
    done = t.read(spark, folder, "conversations").select(F.col("conv_id").alias("note_id"), F.lit("X").alias("concept_id"))
    rules = _matches(spark, folder).select("note_id", "concept_id")
    return C.backfill_unprocessed(done, rules).groupBy("note_id", "concept_id").agg(F.count("*").alias("n"))


VARIANTS = {"articles": ["the ", "der ", "la "], "insults": ["disgusting", "Hateful"], "absent": ["handtas"]}


@query("variant_counts", " UNION ALL ".join(
    f"""SELECT '{c}' AS category, CAST({" + ".join(f"count(*) FILTER (WHERE contains(lower(text), '{v.lower()}'))" for v in vs)} AS BIGINT) AS notes FROM documents"""
    for c, vs in VARIANTS.items()))
def variant_counts(spark, folder):
    return C.variant_counts(t.notes(spark, folder), VARIANTS)


@query("parenthesised_types", r"SELECT DISTINCT unnest(regexp_extract_all(text, '\(([^)]+)\)', 1)) AS client_type FROM documents")
def parenthesised_types(spark, folder):
    return C.parenthesised_types(t.notes(spark, folder))


@query("coverage_by_method", with_tables("notes", "," + MATCHED + "SELECT 'rule-based' AS detection_method, count(*) AS matches, count(DISTINCT note_id) AS notes FROM matched"))
def coverage_by_method(spark, folder):
    return C.coverage_by_method(C.detect_concepts(t.notes(spark, folder), _aliases(spark)))


@query("novel_sensitive_hits", with_tables("notes", "," + MATCHED + """,
taken AS (SELECT note_id, span_start, span_end FROM matched WHERE concept_id = 'C001')
SELECT note_id, matched_alias, span_start, span_end FROM matched m WHERE NOT EXISTS (
  SELECT 1 FROM taken t WHERE t.note_id = m.note_id AND m.span_start < t.span_end AND m.span_end > t.span_start)"""))
def novel_sensitive_hits(spark, folder):
    """Hits of one detector that touch no hit of another: here, matches that touch none of concept C001."""
    found = _matches(spark, folder).select("note_id", "matched_alias", "concept_id", F.col("span_start").cast("bigint").alias("span_start"),
                                           F.col("span_end").cast("bigint").alias("span_end"))
    return P.sensitive_novel_only(found, found.where("concept_id = 'C001'")).drop("concept_id")


# ---- streams --------------------------------------------------------------------------------------------


def _work_folder(spark) -> str:
    """A fresh folder beside the checkpoints, which every executor can reach."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("/") or base.startswith("file:"):
        return tempfile.mkdtemp(prefix="stream-", dir=base.removeprefix("file:"))
    import uuid

    return f"{base}/stream-{uuid.uuid4().hex}"


def _write_uploads(spark, folder, target, broken=False):
    """The documents as upload events in JSON files; each session is delivered twice, some without a text on demand."""
    text = F.when(F.expr("doc_id % 97") == 0, F.lit(None).cast("string")).otherwise(F.col("text")) if broken else F.col("text")
    docs = t.spread(t.read(spark, folder, "documents")).select(
        F.lit("csv").alias("upload_type"), F.col("doc_id").alias("upload_session_id"), F.expr("doc_id div 5").alias("client_id"),
        F.col("lang").alias("language"), text.alias("text"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("doc_id") % 3000)).alias("_ts"))
    docs.unionByName(docs).write.mode("overwrite").json(target)


_CLEAN = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query("stream_upserts", f"""
SELECT client_id, arg_max(doc_id, (doc_id % 3000) * 1000000 + doc_id) AS note_id, arg_max(md5({_CLEAN}), (doc_id % 3000) * 1000000 + doc_id) AS digest
FROM (SELECT doc_id, doc_id // 5 AS client_id, text FROM documents) GROUP BY client_id""")
def stream_upserts(spark, folder):
    """Run the upload stream to its end over all documents, delivered twice, and read the newest note per client."""
    work = _work_folder(spark)
    _write_uploads(spark, folder, f"{work}/in")
    stream = U.read_uploads_files(spark, f"{work}/in")
    U.process_uploads(stream, _aliases(spark), f"{work}/out", f"{work}/state").awaitTermination()
    return U.current_notes(spark, f"{work}/out").select("client_id", "note_id", F.md5("text").alias("digest"))


@query("stream_sessions", """
SELECT CASE WHEN ok THEN 'completed' ELSE 'failed' END AS status, CASE WHEN ok THEN NULL ELSE 'no text' END AS error, count(*) AS sessions,
       CAST(3 * count(*) AS BIGINT) AS events
FROM (SELECT doc_id % 97 <> 0 AND regexp_matches(text, '\\S') AS ok FROM documents) GROUP BY ok""")
def stream_sessions(spark, folder):
    """Uploads of which some have no text, followed from their start to completion or failure."""
    work = _work_folder(spark)
    _write_uploads(spark, folder, f"{work}/in", broken=True)
    stream = U.read_uploads_files(spark, f"{work}/in")
    U.process_uploads(stream, _aliases(spark), f"{work}/out", f"{work}/state").awaitTermination()
    states = U.session_states(spark.read.parquet(f"{work}/out/sessions").drop("batch_id"))
    return states.groupBy("status", "error").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


_LIFE = """
e AS (SELECT *, CASE event_type WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'stage' END AS kind FROM events),
s AS (SELECT *, {'t': ts, 'r': list_position(['started', 'stage', 'completed', 'failed'], kind)} AS o FROM e),
states AS (SELECT user_id AS session_id, arg_max(kind, o) AS status, arg_max(event_type, o) FILTER (WHERE kind = 'stage') AS stage,
       count(*) AS events, count(*) FILTER (WHERE kind = 'failed') AS failures, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1) AS elapsed
FROM s GROUP BY user_id)
"""


def _follow(spark, folder):
    """The events as the life of one session a user, replayed in several batches regardless of their times."""
    work = _work_folder(spark)
    events = t.read(spark, folder, "events")
    kind = F.when(F.col("event_type") == "view", "started").when(F.col("event_type") == "purchase", "completed").when(
        F.col("event_type") == "error", "failed").otherwise("stage")
    log = events.select(F.col("user_id").alias("session_id"), kind.alias("kind"), F.when(kind == "stage", F.col("event_type")).alias("stage"),
                        F.lit(None).cast("long").alias("records"), F.when(kind == "failed", F.lit("reported")).alias("error"), F.col("ts").alias("at"))
    log.repartition(6).write.parquet(f"{work}/in")
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{work}/in")
    U.follow_sessions(source, f"{work}/out", f"{work}/state").awaitTermination()
    return U.current_sessions(spark, f"{work}/out"), work


@query("session_lifecycle", "WITH " + _LIFE + "SELECT session_id, status, stage, events, failures, elapsed FROM states")
def session_lifecycle(spark, folder):
    states, _ = _follow(spark, folder)
    return states.select("session_id", "status", "stage", "events", "failures", "elapsed")


@query("session_messages", "WITH " + _LIFE + "SELECT CAST(session_id AS VARCHAR) AS key, status, 'pipeline-status' AS topic, true AS stamped FROM states")
def session_messages(spark, folder):
    """States of sessions as keyed JSON messages, sent through the sink of the stream and read back."""
    states, work = _follow(spark, folder)
    states.write.parquet(f"{work}/states")
    source = spark.readStream.schema(states.schema).parquet(f"{work}/states")
    U.write_event_stream(U.status_events(source), f"{work}/sent", f"{work}/sent-state").awaitTermination()
    sent = spark.read.schema("key string, value string").json(f"{work}/sent")
    said = F.from_json("value", "status string, _topic string, _ts timestamp")
    return sent.select("key", said.alias("v")).select("key", "v.status", F.col("v._topic").alias("topic"), F.col("v._ts").isNotNull().alias("stamped"))


@query("stream_audit", "SELECT event_type AS action, count(*) AS n FROM events GROUP BY event_type")
def stream_audit(spark, folder):
    work = _work_folder(spark)
    t.read(spark, folder, "events").write.mode("overwrite").parquet(f"{work}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{work}/in").schema).parquet(f"{work}/in")
    rows = source.select(F.col("event_type").alias("action"), "user_id", "props", "ts")
    U.audit_stream(rows, f"{work}/out", f"{work}/state", ["user_id", "props"]).awaitTermination()
    return spark.read.parquet(f"{work}/out").groupBy("action").agg(F.count("*").alias("n"))


@query("transcript_notes", """
SELECT doc_id::VARCHAR AS "ID", CASE WHEN n_chars // 60 < 5 THEN 'Short' WHEN n_chars // 60 < 15 THEN 'Medium' ELSE 'Long' END AS "Duration",
  upper(lang)[1:2] AS "Language", CASE WHEN w < 50 THEN 'Short' WHEN w < 150 THEN 'Medium' ELSE 'Long' END AS "Length"
FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM documents)""".replace("\\\\", "\\"))
def transcript_notes(spark, folder):
    """Documents as voice transcripts; their length in characters stands for seconds."""
    docs = t.read(spark, folder, "documents").select(
        F.col("doc_id").alias("client_id"), F.col("n_chars").alias("duration_seconds"), F.col("lang").alias("language"),
        F.col("text").alias("transcript"), F.current_timestamp().alias("_ts"))
    return N.notes_from_transcripts(docs).select("ID", "Duration", "Language", "Length")


# ---- from CSV files to notes -----------------------------------------------------------------------------

_LANGUAGES = "CASE WHEN lang = 'fr' THEN ' French' ELSE lang END"


def _ingested(spark, folder):
    """The documents as CSV files with dates in three ways (those of one source unreadable), ingested without redaction."""
    work = _work_folder(spark)
    day = F.expr("date_add(date'2024-01-01', int(doc_id % 365))")
    dates = F.when(F.col("lang") == "de", F.date_format(day, "dd/MM/yyyy")).when(F.col("lang") == "en", F.date_format(day, "yyyy/MM/dd"))
    raw = t.spread(t.read(spark, folder, "documents")).select(
        F.col("doc_id").cast("string").alias("ID"),
        F.when(F.col("source") == "src3", F.lit("some day")).otherwise(dates.otherwise(day.cast("string"))).alias("Date"),
        F.lit("Short").alias("Duration"), F.expr(_LANGUAGES).alias("Language"), T.word_size_class(F.col("text")).alias("Length"),
        F.col("text").alias("Transcription"))
    raw.write.option("header", True).option("escape", '"').csv(f"{work}/csv")
    return N.run_ingest(spark, f"{work}/csv", f"{work}/notes", redact=None), f"{work}/notes"


_CSV_NOTES = f"""
SELECT CAST(doc_id AS VARCHAR) AS note_id, CAST(doc_id AS VARCHAR) AS client_id,
       CASE WHEN source IS DISTINCT FROM 'src3' THEN CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS VARCHAR) END AS day,
       upper(lang) AS language, 'Short' AS duration, {_CLEAN} AS text FROM documents"""


@query("ingest_notes_csv", f"SELECT note_id, client_id, day, language, duration, md5(text) AS digest FROM ({_CSV_NOTES})")
def ingest_notes_csv(spark, folder):
    """Clean notes from CSV files with quoted texts of several lines."""
    _, path = _ingested(spark, folder)
    return spark.read.parquet(path).select(
        "note_id", "client_id", F.date_format("date", "yyyy-MM-dd").alias("day"), "language", "duration", F.md5("text").alias("digest"))


@query("ingest_run_counts", f"""
SELECT 'ingest' AS stage, 'completed' AS status, count(*) AS rows, count(*) FILTER (WHERE day IS NULL) AS invalid_dates,
       count(*) FILTER (WHERE language NOT IN ('FR', 'EN', 'IT', 'ES', 'DE', 'PT', 'NL')) AS unknown_languages,
       count(*) FILTER (WHERE text = '') AS empty_texts FROM ({_CSV_NOTES})""")
def ingest_run_counts(spark, folder):
    """What the run log says of the same ingestion, observed while the notes were written."""
    stage, _ = _ingested(spark, folder)
    counts = F.from_json("counts", "rows bigint, invalid_dates bigint, unknown_languages bigint, empty_texts bigint")
    return stage_rows(spark, [stage]).select("stage", "status", counts.alias("c")).select("stage", "status", "c.*")


@query("backfill_client_ids", with_tables("notes", "," + MATCHED + """
SELECT m.note_id, concept_id, matched_alias, CAST(span_start AS BIGINT) AS span_start,
       CASE WHEN concept_id = 'C001' OR n.language <> 'DE' THEN m.note_id // 5 END AS client_id FROM matched m JOIN notes n ON n.note_id = m.note_id"""))
def backfill_client_ids(spark, folder):
    """Mentions of which only one concept's carry a client; the notes at hand lack one language."""
    client = F.when(F.col("concept_id") == "C001", F.expr("note_id div 5"))
    found = _matches(spark, folder).select("note_id", "concept_id", "matched_alias", F.col("span_start").cast("bigint").alias("span_start"), client.alias("client_id"))
    return C.fill_client_ids(found, t.notes(spark, folder).where("language <> 'DE'"))


# ---- a dictionary of thousands of aliases -------------------------------------------------------------


@query("match_large_dictionary", with_tables("notes", r"""
, dictionary AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS alias FROM benchmark),
tokens AS (SELECT note_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS tok FROM (
  SELECT note_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS w FROM notes)),
placed AS (SELECT note_id, tok, sum(length(tok)) OVER (PARTITION BY note_id ORDER BY i) - length(tok) AS s FROM tokens),
met AS (SELECT note_id, alias, s, row_number() OVER (PARTITION BY note_id, alias ORDER BY s) AS k FROM placed JOIN dictionary ON tok = alias WHERE length(alias) >= 2)
SELECT note_id, alias AS matched_alias, CAST(s AS BIGINT) AS span_start, 'B_' || alias AS concept_id FROM met WHERE k <= 3""".replace("\\\\", "\\")))
def match_large_dictionary(spark, folder):
    """Every word of the benchmark items as an alias of its own."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)))
    names = t.read(spark, folder, "benchmark").select(words.alias("alias")).distinct()
    found = C.match_aliases(t.notes(spark, folder), names.withColumn("concept_id", F.concat(F.lit("B_"), "alias")))
    return found.select("note_id", "matched_alias", F.col("span_start").cast("bigint").alias("span_start"), "concept_id")


@query("match_concepts_sql", with_tables("notes", "," + MATCHED + "SELECT note_id, matched_alias, CAST(span_start AS INTEGER) AS span_start, CAST(span_end AS INTEGER) AS span_end FROM matched"))
def match_concepts_sql(spark, folder):
    """The dictionary as a table function of SQL."""
    FT.register_match_aliases(spark, C.trie_pattern(sorted(r["alias"] for r in _aliases(spark).where("length(alias) >= 2").collect())), 3)
    t.notes(spark, folder).createOrReplaceTempView("notes_to_match")
    return spark.sql("SELECT n.note_id, m.* FROM notes_to_match n, LATERAL match_aliases(lower(n.text)) m")
