"""Building and maintaining the concept lexicon.

A lexicon row is ``(concept_id, label, aliases, languages, freq_notes, examples, bucket)``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteworks import config
from noteworks.functions import text as T
from noteworks.functions import vectors as V
from noteworks.operators.ranking import global_index, top_per_group
from noteworks.operators.vectors import BLOCK, PIVOTS, _matrix, _nearest, assign_cells, block_join, choose_pivots, embed_text
from noteworks.session import cut_lineage, literal_table


def _finish(distance: float):
    """Work function: the remaining rounds of a few clusters ``(id, n, vec)`` in memory; the cluster each ends in."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, size, mean = pdf["id"].to_numpy(), pdf["n"].to_numpy(), _matrix(pdf["vec"])
        row, names = np.arange(len(ids)), ids  # the row that holds each cluster given, and the name of each row
        while len(names) > 1:
            score = np.round(mean @ mean.T, 12)
            np.fill_diagonal(score, -np.inf)
            place, best = np.arange(len(names)), score.argmax(1)
            into = np.flatnonzero((score[place, best] > 1 - distance) & (best[best] == place) & (place < best))
            if not len(into):
                break
            gone = best[into]
            total = size[into] + size[gone]
            mean[into] = (mean[into] * size[into, None] + mean[gone] * size[gone, None]) / total[:, None]
            size[into] = total
            place[gone] = into
            left = np.setdiff1d(np.arange(len(names)), gone)
            row = np.searchsorted(left, place[row])
            names, size, mean = names[left], size[left], mean[left]
        return pd.DataFrame({"id": ids, "into": names[row]})

    return work


def cluster_terms(terms: DataFrame, distance: float = config.CONCEPT_DISTANCE, block: int = BLOCK,
                  n_pivots: int = PIVOTS) -> DataFrame:
    """Average-linkage clusters of ``(id, vec)`` on cosine distance, cut at ``distance``; exact and distributed.

    For unit vectors the average distance of two clusters is 1 - mean(A)·mean(B), so a cluster is its sum and
    its size. Average linkage never brings merged clusters closer to a third, so all pairs of mutual nearest
    neighbours can merge at once, round by round, until no pair is closer than ``distance``. Once no more than
    ``block`` clusters have a partner within reach, one task makes the rounds that are left.
    """
    unit = terms.select(F.col("id").cast("long").alias("id"), V.l2_normalize(F.col("vec").cast("array<double>")).alias("vec"))
    # Copies are at distance zero and merge first in any order.
    firsts = unit.groupBy("vec").agg(F.min("id").alias("cluster"), F.count("*").cast("double").alias("n"))
    members = cut_lineage(unit.join(firsts.select("vec", "cluster"), "vec").select("id", "cluster"))
    state = cut_lineage(firsts.select(F.col("cluster").alias("id"), "n", "vec"))
    while True:
        # ``vec`` is the mean of the cluster. Two means with a product above 1 - distance are at most
        # sqrt(2 * distance) apart, because no mean is longer than one.
        points = state.select("id", "vec")
        pivots = choose_pivots(points, n_pivots, block)
        cells = assign_cells(points, pivots)
        reach = cells.withColumn("reach", F.lit(float(np.sqrt(2 * distance))))
        pairs = block_join(reach, pivots, _nearest(1), "id long, other long, score double", block)
        close = pairs.where(F.col("score") > 1 - distance)
        nearest = cut_lineage(close.groupBy("id").agg(F.min_by("other", F.struct((-F.col("score")).alias("s"), "other")).alias("other")))
        # What is close to nothing stays so, since merging brings no cluster closer to a third: it is done.
        active = state.join(nearest.select("id"), "id", "left_semi")
        if nearest.limit(block + 1).count() <= block:
            ends = active.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_finish(distance), "id long, into long")
            return members.join(ends.withColumnRenamed("id", "cluster"), "cluster", "left").select("id", F.coalesce("into", "cluster").alias("cluster"))
        back = nearest.select(F.col("id").alias("other"), F.col("other").alias("id"))
        merges = cut_lineage(nearest.join(back, ["id", "other"], "left_semi").where("id < other").select(F.col("id").alias("into"), F.col("other").alias("id")))
        if merges.limit(1).count() == 0:
            break
        target = F.coalesce("into", "id")
        grouped = active.join(merges, "id", "left").select(target.alias("id"), "n", "vec")
        size = grouped.groupBy("id").agg(F.sum("n").alias("n"), F.collect_list(F.struct("n", "vec")).alias("parts"))
        # A merge joins exactly two clusters, so ``parts`` never has more than two entries.
        weighted = F.transform("parts", lambda p: F.transform(p["vec"], lambda x: x * p["n"]))
        summed = F.aggregate(F.slice(weighted, 2, 1), F.get(weighted, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
        state = cut_lineage(size.select("id", "n", F.transform(summed, lambda x: x / F.col("n")).alias("vec")))
        members = cut_lineage(
            members.join(merges.withColumnRenamed("id", "cluster"), "cluster", "left").select("id", F.coalesce("into", "cluster").alias("cluster"))
        )
    return members


def select_labels(members: DataFrame) -> DataFrame:
    """Label of each cluster from ``(cluster, term, freq, vec)``: most notes, then nearest to the centroid."""
    centres = members.groupBy("cluster").agg(vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("centre"))
    near = F.round(V.cosine(F.col("vec"), F.col("centre")), 12)
    scored = members.join(centres, "cluster").withColumn("near", near)
    return scored.groupBy("cluster").agg(F.min_by("term", F.struct((-F.col("freq")).alias("f"), (-F.col("near")).alias("s"), "term")).alias("label"))


def keeps_alias(label: Column, alias: Column) -> Column:
    """An alias stays when it or the label is long, or when the two share a synonym set, a word or a stem."""
    a, b = T.words(F.lower(label)), T.words(F.lower(alias))
    stem = F.exists(a, lambda x: F.exists(b, lambda y: T.share_stem(x, y)))
    return (F.size(a) >= 3) | (F.size(b) >= 3) | T.known_synonym(label, alias) | F.arrays_overlap(a, b) | stem


def prune_clusters(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Send short aliases without any tie to their label out as clusters of their own."""
    named = members.join(labels, "cluster")
    stays = (F.col("term") == F.col("label")) | keeps_alias(F.col("label"), F.col("term"))
    return named.select(
        F.when(stays, F.col("label")).otherwise(F.col("term")).alias("label"), "term",
        *[c for c in members.columns if c not in ("cluster", "term")],
    )


def build_lexicon(members: DataFrame, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """Lexicon rows from ``(label, term, freq, languages, examples)``, one row per kept term."""
    flat = members.groupBy("label").agg(
        F.array_sort(F.collect_set(F.when(F.col("term") != F.col("label"), F.col("term")))).alias("aliases"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("languages")))).alias("languages"),
        F.sum("freq").alias("freq_notes"),
    )
    examples = members.select("label", F.explode("examples").alias("e")).distinct()
    five = top_per_group(examples, ["label"], ["e"], 5).groupBy("label").agg(F.array_sort(F.collect_list("e")).alias("examples"))
    numbered = global_index(flat, [F.desc("freq_notes"), F.asc("label")], "idx").join(five, "label", "left")
    return numbered.select(
        T.concept_id(F.col("label"), F.col("idx")).alias("concept_id"), "label", "aliases", "languages", "freq_notes", "examples",
        T.assign_bucket(F.concat(F.array("label"), "aliases"), rules).alias("bucket"),
    )


def lexicon_from_candidates(candidates: DataFrame, distance: float = config.CONCEPT_DISTANCE, rules: dict[str, list[str]] | None = None,
                            model: Callable | None = None) -> DataFrame:
    """From mined candidates ``(candidate, freq_notes, languages, example_note_ids)``, one row each, to the lexicon:
    embed, cluster, name each cluster, send strangers out as concepts of their own, number by frequency.

    ``model`` is a pandas UDF of a user; without it words and word pairs are hashed. No candidate gives no concept.
    """
    terms = candidates.where("candidate IS NOT NULL").select(
        F.col("candidate").alias("term"), F.col("freq_notes").alias("freq"), "languages", F.col("example_note_ids").alias("examples"))
    embedded = cut_lineage(embed_text(global_index(terms, [F.asc("term")], "id"), "term", model=model))
    clusters = cluster_terms(embedded.select("id", F.col("embedding").alias("vec")), distance)
    members = cut_lineage(embedded.withColumnRenamed("embedding", "vec").join(clusters, "id").drop("id"))
    return build_lexicon(prune_clusters(members, select_labels(members)).drop("vec"), rules)


def merge_lexicon(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing concepts win; their counts and examples are refreshed by label; unseen labels are added."""
    old = existing.select(F.lower("label").alias("_k"), F.struct(*existing.columns).alias("o"))
    fresh = new.dropDuplicates(["label"]).select(F.lower("label").alias("_k"), F.struct(*existing.columns).alias("n"))
    refreshed = ("freq_notes", "examples")

    def value(c: str) -> Column:
        first, second = ("n", "o") if c in refreshed else ("o", "n")
        return F.when(F.col("o").isNull(), F.col("n")[c]).otherwise(F.coalesce(F.col(first)[c], F.col(second)[c]))

    return old.join(fresh, "_k", "full_outer").select(*[value(c).alias(c) for c in existing.columns])


def taxonomy(lexicon: DataFrame) -> DataFrame:
    """Concept ids of each bucket; unknown buckets count as other, empty buckets are listed."""
    bucket = F.when(F.col("bucket").isin(*config.BUCKETS), F.col("bucket")).otherwise("other")
    grouped = lexicon.groupBy(bucket.alias("bucket")).agg(F.array_sort(F.collect_list("concept_id")).alias("concept_ids"))
    every = literal_table(lexicon.sparkSession, [(b,) for b in config.BUCKETS], "bucket string")
    return every.join(grouped, "bucket", "left").select("bucket", F.coalesce("concept_ids", F.array().cast("array<string>")).alias("concept_ids"))


def lexicon_stats(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("bucket").agg(
        F.count("*").alias("concepts"), F.sum(F.size("aliases")).alias("aliases"), F.sum("freq_notes").alias("mentions")
    )


def lexicon_languages(lexicon: DataFrame) -> DataFrame:
    return lexicon.select(F.explode("languages").alias("language")).groupBy("language").agg(F.count("*").alias("concepts"))


def list_concepts(lexicon: DataFrame, bucket: str | None = None, limit: int = 20) -> DataFrame:
    rows = lexicon if bucket is None else lexicon.where(F.col("bucket") == bucket)
    return rows.orderBy(F.desc("freq_notes"), "concept_id").limit(limit)


def add_concepts(lexicon: DataFrame, terms: DataFrame) -> DataFrame:
    """Add ``(term, aliases, bucket)`` under slug ids; the term comes first among its aliases. Known ids stay."""
    rows = terms.select(
        T.concept_slug(F.col("term")).alias("concept_id"), F.col("term").alias("label"),
        F.array_distinct(F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("aliases"),
        F.array().cast("array<string>").alias("languages"), F.lit(0).cast("long").alias("freq_notes"),
        F.array().cast("array<string>").alias("examples"), "bucket",
    ).dropDuplicates(["concept_id"])
    return lexicon.unionByName(rows.join(lexicon.select("concept_id"), "concept_id", "left_anti").select(*lexicon.columns))


def remove_concepts(lexicon: DataFrame, ids: DataFrame) -> DataFrame:
    return lexicon.join(ids.select("concept_id").distinct(), "concept_id", "left_anti")


def import_concepts(lexicon: DataFrame, other: DataFrame) -> DataFrame:
    """Unite aliases of known ids, insert the rest."""
    mine = lexicon.select("concept_id", F.struct(*lexicon.columns).alias("o"))
    theirs = other.dropDuplicates(["concept_id"]).select("concept_id", F.struct(*lexicon.columns).alias("n"))

    def value(c: str) -> Column:
        if c == "aliases":
            none = F.array().cast("array<string>")
            return F.array_sort(F.array_union(F.coalesce(F.col("o")[c], none), F.coalesce(F.col("n")[c], none)))
        return F.coalesce(F.col("o")[c], F.col("n")[c])

    rest = [c for c in lexicon.columns if c != "concept_id"]
    return mine.join(theirs, "concept_id", "full_outer").select("concept_id", *[value(c).alias(c) for c in rest])


def apply_enrichment(lexicon: DataFrame, reclassified: DataFrame, aliases: DataFrame, discovered: DataFrame) -> DataFrame:
    """Apply outside suggestions: buckets (confidence at least .5, not other), extra aliases, new concepts."""
    moves = reclassified.where((F.col("bucket") != "other") & (F.col("confidence") >= 0.5)).groupBy("concept_id").agg(F.max("bucket").alias("_b"))
    extra = aliases.select("concept_id", F.explode("aliases").alias("a")).distinct().groupBy("concept_id").agg(F.collect_list("a").alias("_a"))
    merged = lexicon.join(moves, "concept_id", "left").join(extra, "concept_id", "left").select(
        *[c for c in lexicon.columns if c not in ("bucket", "aliases")],
        F.coalesce("_b", "bucket").alias("bucket"),
        F.array_sort(F.array_union("aliases", F.coalesce("_a", F.array().cast("array<string>")))).alias("aliases"),
    ).select(*lexicon.columns)
    return add_concepts(merged, discovered)


def novel_labels(candidates: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Candidates that are neither a label nor an alias yet."""
    known = lexicon.select(F.explode(F.concat(F.array("label"), "aliases")).alias("t")).select(F.lower("t").alias("_k")).distinct()
    return candidates.join(known, F.lower("label") == F.col("_k"), "left_anti")


def under_aliased(lexicon: DataFrame, least: int = 30) -> DataFrame:
    return lexicon.where(F.size("aliases") < least)


def search_lexicon(lexicon: DataFrame, q: str) -> DataFrame:
    """Concepts whose id, label or an alias contains ``q``, and which of them it was."""
    needle = F.lit(q.lower())
    alias = F.get(F.filter("aliases", lambda a: F.contains(F.lower(a), needle)), F.lit(0))
    where = (
        F.when(F.contains(F.lower("concept_id"), needle), "id").when(F.contains(F.lower("label"), needle), "label")
        .when(alias.isNotNull(), F.concat(F.lit("alias: "), alias))
    )
    return lexicon.withColumn("matched", where).where("matched IS NOT NULL")


def alias_examples(lexicon: DataFrame, limit: int = 10) -> DataFrame:
    """Concept and keyword pairs: the first ``limit`` aliases of a concept, those longer than two characters."""
    first = lexicon.select("label", "bucket", F.explode(F.slice("aliases", 1, limit)).alias("keyword"))
    return first.where(F.length("keyword") > 2)


def explode_sentences(notes: DataFrame, limit: int = 5) -> DataFrame:
    """First ``limit`` sentences of more than twenty characters."""
    parts = F.filter(F.transform(F.split("text", r"\.", -1), lambda s: F.trim(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))), lambda s: F.length(s) > 20)
    return notes.select("note_id", "client_id", "language", F.explode(F.slice(parts, 1, limit)).alias("sentence"))
