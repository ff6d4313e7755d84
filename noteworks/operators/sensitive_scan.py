"""From labelled phrases to the protected mentions that no pattern knows.

Training rows give a matrix of reference vectors and, if wanted, a classifier. Texts are cut into word runs; each
distinct run is embedded and scored once, a batch of runs against a block of references at a time, and only runs
that pass meet the texts again. What a text's hits still need (harmless context, overlaps, what patterns find
anyway) is settled inside the text's row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteworks import patterns
from noteworks.functions.spans import blocks, cut, explode_items, keep_disjoint, let, overlaps
from noteworks.operators.grams import gram_batches, phrase_batches, phrase_slots
from noteworks.operators.models import train_sensitive_head
from noteworks.operators.privacy import sensitive_findings
from noteworks.operators.vectors import embed_text
from noteworks.session import cut_lineage, small_table

SAFE = "SAFE"
ROWS, BLOCK = 4096, 2048  # runs and references of one matrix product
REFERENCE_LIMIT = 100_000
HIT_TYPE = "array<struct<key:double,start:int,end:int,phrase:string,label:string>>"

Embed = Callable[[DataFrame], DataFrame]


def _embed(phrases: DataFrame) -> DataFrame:
    return embed_text(phrases, "phrase")


def fit_references(rows: DataFrame, embed: Embed = _embed, limit: int = REFERENCE_LIMIT) -> list[tuple[str, list[float]]]:
    """Distinct (category, unit vector) of the training rows ``(category, phrase)``, category ``SAFE`` included.

    The references are a model: people write these rows, and more than ``limit`` are refused.
    """
    known = rows.where("category IS NOT NULL AND phrase IS NOT NULL").select("category", "phrase").distinct()
    found = embed(known).select("category", "embedding").distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} reference vectors")
    return sorted((r["category"], [float(x) for x in r["embedding"]]) for r in found)


def fit_head(rows: DataFrame, embed: Embed = _embed, layers: tuple[int, ...] = (128, 64), seed: int = 42) -> PipelineModel:
    """Perceptron over the embeddings of the same training rows."""
    known = rows.where("category IS NOT NULL AND phrase IS NOT NULL").select("category", "phrase").distinct()
    return train_sensitive_head(embed(known).select("category", array_to_vector("embedding").alias("features")), layers, seed)


def _near(references: list[tuple[str, list[float]]], similarity: float, margin: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: rows ``(phrase, embedding)`` to those near a protected reference, with its category and cosine.

    Cosines are rounded to nine digits, so that equal ones tie; the category first in the alphabet wins. Without a
    safe reference nothing is safe (-1).
    """
    names = sorted({c for c, _ in references if c != SAFE})
    matrix = np.array([v for _, v in references])
    codes = np.array([names.index(c) if c != SAFE else len(names) for c, _ in references])
    rows, block = ROWS, BLOCK

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.filter(batch.column(1).is_valid())
            for at in range(0, known.num_rows, rows):
                part = known.slice(at, rows)
                vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                best = np.full((len(vectors), len(names) + 1), -1.0)
                for first in range(0, len(matrix), block):
                    cosine = np.round(vectors @ matrix[first : first + block].T, 9)
                    own = codes[first : first + block]
                    for code in np.unique(own):
                        best[:, code] = np.maximum(best[:, code], cosine[:, own == code].max(axis=1))
                label, top = best[:, :-1].argmax(axis=1), best[:, :-1].max(axis=1)
                keep = np.flatnonzero((top >= similarity) & (top > best[:, -1] + margin))
                kept = part.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0), kept.column(1), pa.array(names, pa.string()).take(pa.array(label[keep])), pa.array(top[keep])],
                    ["phrase", "embedding", "label", "score"])

    return score


def score_phrases(phrases: DataFrame, references: list[tuple[str, list[float]]], head: PipelineModel | None = None, embed: Embed = _embed,
                  similarity: float = 0.82, margin: float = 0.05, confidence: float = 0.60) -> DataFrame:
    """``(phrase, label, score)`` of the distinct ``phrases`` that lie near a protected reference and clearly nearer
    than to a safe one. With a ``head`` its category counts, and it must be protected and sure."""
    if not any(category != SAFE for category, _ in references):
        return phrases.select("phrase", F.lit("").alias("label"), F.lit(0.0).alias("score")).limit(0)
    # What has no embedding is left out by the task function: a filter here would move below a ``distinct`` and embed
    # every occurrence of a phrase.
    vectors = embed(phrases.select("phrase")).select("phrase", F.col("embedding").cast("array<double>"))
    near = vectors.mapInArrow(_near(references, similarity, margin), "phrase string, embedding array<double>, label string, score double")
    if head is None:
        return near.select("phrase", "label", "score")
    labels = head.stages[0].labels
    judged = head.transform(near.drop("label").withColumn("features", array_to_vector("embedding")))
    sure = F.array_max(vector_to_array("probability"))
    named = judged.select("phrase", F.get(F.lit(labels), F.col("prediction").cast("int")).alias("label"), F.col("score").alias("near"), sure.alias("sure"))
    kept = named.where((F.col("label") != SAFE) & (F.col("sure") >= confidence))
    return kept.select("phrase", "label", F.greatest("near", "sure").alias("score"))


def sensitive_scan(texts: DataFrame, references: list[tuple[str, list[float]]], head: PipelineModel | None = None, embed: Embed = _embed,
                   key: str = "note_id", novel_only: bool = True, **thresholds: float) -> DataFrame:
    """Hits ``(key, token, label, score, span_start, span_end)`` in ``texts(key, text)``, disjoint in every text.

    Hits in a harmless context go first, then of hits that overlap the best stays (score to four digits, then the
    earlier, then the shorter), then, with ``novel_only``, those that touch a finding of the patterns go. Keys must
    be unique; rows without key or text have no hit; columns beside the two play no part.
    """
    bare = texts.select(key, "text").where(F.col(key).isNotNull() & F.col("text").isNotNull())
    phrases = bare.select("text").mapInArrow(phrase_batches(3), "phrase string").distinct()
    good = cut_lineage(score_phrases(phrases, references, head, embed, **thresholds))
    # Most runs are like nothing: what has no slot among the good phrases need not meet them.
    kind = bare.schema[key].dataType.simpleString()
    grams = bare.mapInArrow(gram_batches(3, phrase_slots(good)), f"`{key}` {kind}, phrase string, span_start int, span_end int")
    hits = grams.join(small_table(good), "phrase")
    span = F.struct((-F.round("score", 4)).alias("key"), F.col("span_start").alias("start"), F.col("span_end").alias("end"), "phrase", "label")
    # One list per text: it cannot grow beyond the word runs of that text.
    lists = hits.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(span)).cast(HIT_TYPE).alias("_hits"))
    both = bare.join(lists, F.col(key) == F.col("_key"))
    clear = let(blocks(F.col("text")), lambda parts: F.filter("_hits", lambda h: ~cut(
        parts, F.greatest(h["start"] - 40, F.lit(0)), h["end"] + 40).rlike(patterns.HARMLESS_CONTEXT)))
    disjoint = keep_disjoint(clear, HIT_TYPE)
    if novel_only:  # findings are made once a text, not once a hit
        disjoint = let(sensitive_findings(F.col("text")), lambda known: F.filter(disjoint, lambda h: ~F.exists(known, lambda k: overlaps(h, k))))
    rows = both.select(key, disjoint.alias("_hits"))
    return explode_items(rows, F.col("_hits"), "h", key).select(
        key, F.col("h.phrase").alias("token"), "h.label", (-F.col("h.key")).alias("score"),
        F.col("h.start").alias("span_start"), F.col("h.end").alias("span_end"))
