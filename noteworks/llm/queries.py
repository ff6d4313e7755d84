"""One query per operator, over whole tables, and SQL where it can express the operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteworks.llm import collocations, common, hilbert, langid, lm, mixing, pieces, quality, repair, secrets, simhash, sketch, suffixes, toxicity
from noteworks.llm.registry import CHECKS, QUERIES, query  # noqa: F401


@query("op1_simhash")
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(common.documents(spark, folder))


def vocabulary_path() -> str:
    """The public SentencePiece file, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op2_pieces")
def op2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back."""
    docs = common.documents(spark, folder).select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"))
    decoded = pieces.decode(pieces.encode(docs, vocabulary_path()), vocabulary_path(), keep=True)
    digest = F.sha2("text", 256)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids",
                          digest.alias("decoded_sha256"), digest.eqNullSafe(F.col("text_sha256")).alias("round_trip"))


@query("op3_secrets")
def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan_secrets(common.documents(spark, folder).select("doc_id", "text"))
    return found.select("doc_id", *[F.col("secrets")[c].alias(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked")])


@query("op4_langid")
def op4_langid(spark: SparkSession, folder: str) -> DataFrame:
    held_out = common.fold("doc_id", 4) == 2
    docs = common.documents(spark, folder).select("doc_id", "text", "lang", held_out.alias("held_out"))
    return langid.identify(docs, ["doc_id", "held_out"], ~F.col("held_out"))


@query("op5_lm")
def op5_lm(spark: SparkSession, folder: str) -> DataFrame:
    held_out = common.fold("doc_id", 7) == 2
    return lm.score_texts(common.documents(spark, folder).select("doc_id", "text", held_out.alias("held_out")))


@query("op6_mixing")
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.documents(spark, folder)
    sized = docs.select(F.col("doc_id").alias("id"), "source", common.word_count(common.text_or_empty()).alias("size"))
    mixed = mixing.mix_sources(sized)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


@query("op7_sketch")
def op7_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return sketch.compare_versions(common.documents(spark, folder)).drop("edited", "following")


_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

QUALITY_SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT r, unnest(string_split(x, chr(10))) AS line FROM t),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM lines
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
win AS (SELECT r, i, array_to_string(w[i + 1 : i + 8], ' ') AS k FROM (SELECT r, w, unnest(range(0, len(w) - 7)) AS i FROM t WHERE len(w) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, sum(least(8, nxt - i)) AS n FROM (SELECT r, i, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i), i + 8) AS nxt FROM rep) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         len(list_filter(w, lambda y: lower(y) IN ({_STOPS}))) AS stops,
         len(regexp_extract_all(x, '\p{{L}}')) AS letters, len(regexp_extract_all(x, '\p{{Lu}}')) AS capitals
  FROM t LEFT JOIN dup USING (r) LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.10
       AND (letters = 0 OR capitals / letters <= 0.40) AND (n_words < 50 OR stops / n_words >= 0.02)
       AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.30) AS kept
FROM b
"""


@query("op8_quality", QUALITY_SQL)
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.apply_rules(common.documents(spark, folder).select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col("quality")[c].alias(c) for c in names])


@query("op9_suffixes")
def op9_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(common.documents(spark, folder))


@query("op10_hilbert")
def op10_hilbert(spark: SparkSession, folder: str) -> DataFrame:
    return hilbert.shard_rows(common.documents(spark, folder))


@query("op11_toxicity")
def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    held_out = common.fold("doc_id", 3) == 1
    docs = common.documents(spark, folder).select("doc_id", "text", held_out.alias("held_out"))
    labelled = spark.read.parquet(f"{folder}/labels.parquet").where(~held_out).select("doc_id", "toxic")
    scored = toxicity.score_texts(docs, toxicity.fit(docs, labelled), ["doc_id", "held_out"])
    score = F.col("toxicity.score")
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= toxicity.PREDICT_FROM).cast("int").alias("predicted"),
                         F.size("toxicity.hits").cast("long").alias("n_hits"))


@query("op12_repair")
def op12_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_damaged(spark.read.parquet(f"{folder}/conversations.parquet"))


COLLOCATION_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
sizes(m) AS (VALUES (1), (2), (3), (4), (5)),
grams AS (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, sizes WHERE len(w) >= m),
f AS (SELECT lang, m, w[i : i + m - 1] AS g, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
cover AS (SELECT lang, g, max(a) AS c FROM (
  SELECT lang, g[1 : m - 1] AS g, a FROM f WHERE m >= 3 UNION ALL SELECT lang, g[2 : m] AS g, a FROM f WHERE m >= 3) GROUP BY ALL),
cand AS (SELECT f.lang, f.m, f.g, f.a, unnest(range(1, f.m)) AS k FROM f LEFT JOIN cover ON f.lang = cover.lang AND f.g = cover.g
         WHERE f.m >= 2 AND (c IS NULL OR 100 * c < 100 * f.a)),
cuts AS (SELECT cand.lang, cand.g, cand.a, k, x.a AS l, y.a AS r, n,
                CAST((CAST(1000 AS HUGEINT) * cand.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
         FROM cand JOIN totals ON cand.lang = totals.lang JOIN f x ON cand.lang = x.lang AND x.g = cand.g[1 : k]
         JOIN f y ON cand.lang = y.lang AND y.g = cand.g[k + 1 : cand.m]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM best)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM ranked QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


@query("op13_collocations", COLLOCATION_SQL)
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(common.documents(spark, folder))
