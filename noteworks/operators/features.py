"""Client features for the purchase, churn and value models.

All of them start from mentions ``(client_id, matched_alias)``. Mentions are counted per (client, alias) before
anything else, so a client that owns a third of the rows shrinks to at most one row per alias.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteworks import config
from noteworks.functions import text as T
from noteworks.functions.spans import explode_items, let
from noteworks.operators.ranking import global_index
from noteworks.session import BROADCAST_ROW_LIMIT, cut_lineage, small_table

PAIR_VOCABULARY_LIMIT = 4096
PAIR_PROBE = 512  # commonest terms whose pairs show what a winner must reach
PAIR_BUCKET = 8_000_000  # pairs, copies included, that one bucket counts
PAIR_TYPE = "a int, b int, pairs long"


def mention_counts(concepts: DataFrame) -> DataFrame:
    """Mentions of each client and term; a table that holds them already stays as it is."""
    if concepts.columns == ["client_id", "term", "n"]:
        return concepts
    return concepts.groupBy("client_id", F.col("matched_alias").alias("term")).agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Mentions:
    """Mentions as numbers: ``counts(client_id, code, n)`` and ``names(term, code)``, codes in the order of terms."""

    counts: DataFrame
    names: DataFrame


def code_mentions(concepts: DataFrame | Mentions) -> Mentions:
    """Each different term is numbered once, and mentions are counted once and kept, so that no later step carries
    terms as text or reads the mentions again. A mention without a term has no code."""
    if isinstance(concepts, Mentions):
        return concepts
    terms = concepts.where("matched_alias IS NOT NULL").select(F.col("matched_alias").alias("term")).distinct()
    names = cut_lineage(global_index(terms, ["term"], "code").select("term", F.col("code").cast("int").alias("code")))
    coded = concepts.select("client_id", F.col("matched_alias").alias("term")).join(small_table(names), "term", "left")
    return Mentions(cut_lineage(coded.groupBy("client_id", "code").agg(F.count("*").alias("n"))), names)


def by_client(counts: DataFrame, table: DataFrame, how: str = "left") -> DataFrame:
    """``counts`` with the columns of ``table(code, ...)``, the rows of a client in one task: groups of a client, and of
    a client with anything else, need no further exchange."""
    kept = cut_lineage(table)
    if kept.count() <= BROADCAST_ROW_LIMIT:
        return counts.repartition("client_id").join(F.broadcast(kept), "code", how)
    return counts.join(kept, "code", how).repartition("client_id")


def _any(term: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(term)
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(low, F.lit(word))
    return hit


def stat_features_fast(concepts: DataFrame) -> DataFrame:
    """Total and distinct mentions, and mentions of four term families."""
    families = [
        F.sum(F.when(_any(F.col("term"), words), F.col("n")).otherwise(0)).alias(name)
        for name, words in config.FAST_FAMILIES.items()
    ]
    return mention_counts(concepts).groupBy("client_id").agg(
        F.sum("n").alias("total_concepts"), F.count("*").alias("unique_concepts"), *families
    )


def stat_features_elite(concepts: DataFrame, families: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Fourteen features: counts, text length, families, ratios, flags."""
    table = config.ELITE_FAMILIES if families is None else families
    sums = [F.sum(F.when(_any(F.col("term"), words), F.col("n")).otherwise(0)).alias(f"{name}_count") for name, words in table.items()]
    flag = {name: F.max(_any(F.col("term"), words).cast("int")) for name, words in table.items()}
    base = mention_counts(concepts).groupBy("client_id").agg(
        F.sum("n").alias("total"), F.count("*").alias("distinct_terms"), F.sum(F.length("term") * F.col("n")).alias("_letters"),
        *sums, F.sum(F.when(F.length("term") > 20, F.col("n")).otherwise(0)).alias("_long"),
        F.max(_any(F.col("term"), config.UNLIMITED_BUDGET).cast("int")).alias("has_unlimited_budget"),
        flag["luxury"].alias("has_luxury"), flag["intent"].alias("has_intent"),
    )
    return base.select(
        "client_id", "total", "distinct_terms", (F.col("_letters") + F.col("total") - 1).alias("text_length"),
        *[f"{name}_count" for name in table],
        (F.col("distinct_terms") / F.col("total")).alias("uniqueness"), (F.col("_long") / F.col("total")).alias("long_ratio"),
        "has_unlimited_budget", "has_luxury", "has_intent",
    )


def inference_features(counts: DataFrame, active: int = 5, at_risk: int = 2, extended: bool = True) -> DataFrame:
    """Derived features from ``(client_id, n, u)``: number of items and of distinct items."""
    n, u = F.col("n"), F.col("u")
    repeat = n / F.greatest(u, F.lit(1))
    engagement = n * 1000
    base = [
        n.alias("num_concepts"), u.alias("unique_concepts"), repeat.alias("repeat_rate"),
        (n > active).cast("int").alias("is_active"), (n < at_risk).cast("int").alias("is_at_risk"), engagement.alias("engagement"),
    ]
    diversity = u / F.greatest(n, F.lit(1))
    more = [
        diversity.alias("diversity"), (n * n).alias("square"), F.log1p(n).alias("log_n"), F.sqrt(n).alias("sqrt_n"),
        (1 / F.greatest(n, F.lit(1))).alias("inverse"), (n * diversity).alias("spread"),
        (engagement / F.greatest(u, F.lit(1))).alias("engagement_per_concept"), (repeat * engagement).alias("weighted_engagement"),
    ]
    return counts.select("client_id", *base, *(more if extended else []))


def stat_features_inference(concepts: DataFrame, extended: bool = True) -> DataFrame:
    counts = mention_counts(concepts).groupBy("client_id").agg(F.sum("n").alias("n"), F.count("*").alias("u"))
    return inference_features(counts, extended=extended)


def text_features(rows: DataFrame, text: str, key: str = "client_id", extended: bool = True) -> DataFrame:
    """The same features over the words of one text column; empty text counts as the word unknown."""
    words = T.words(F.coalesce(F.nullif(F.col(text), F.lit("")), F.lit("unknown")))
    counts = rows.select(F.col(key).alias("client_id"), F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("u"))
    return inference_features(counts, active=10, at_risk=3, extended=extended)


def diversity(concepts: DataFrame) -> DataFrame:
    """Entropy of the mentions, largest count, terms seen once, terms seen more than twice."""
    counts = mention_counts(concepts)
    # entropy = ln(N) - sum(n ln n) / N needs only sums, which combine before the shuffle.
    return counts.groupBy("client_id").agg(
        F.sum("n").alias("_n"), F.sum(F.col("n") * F.log("n")).alias("_nl"), F.max("n").alias("max_freq"),
        F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") > 2).alias("repeated"),
    ).select("client_id", F.round(F.log("_n") - F.col("_nl") / F.col("_n"), 6).alias("entropy"), "max_freq", "singletons", "repeated")


def _pair_counts(counts: DataFrame, codes: list[int], multiset: bool) -> DataFrame:
    """Counts of pairs of a few terms. Each task adds up one small term-by-term matrix and emits its non-zero cells,
    so pairs are never spelled out per client."""
    index = {code: i for i, code in enumerate(codes)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(codes), len(codes)), dtype=np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf["items"].iloc[at : at + 1024]
                rows = np.zeros((len(part), len(codes)), dtype=np.int64)
                for i, pairs in enumerate(part):
                    for item in pairs:
                        rows[i, index[item["code"]]] = item["n"] if multiset else 1
                # Products of doubles are fast and exact as long as no sum can pass 2^53.
                exact = len(rows) * float(rows.max(initial=0)) ** 2 < 2.0**53
                both = rows.astype(np.float64) if exact else rows
                total += (both.T @ both).astype(np.int64)
                if multiset:  # a term with itself: n (n - 1) / 2 pairs
                    own = np.arange(len(codes))
                    total[own, own] += ((rows * (rows - 1)) // 2 - rows * rows).sum(0)
        a, b = np.nonzero(np.triu(total, 0 if multiset else 1))
        names = np.array(codes, dtype=np.int32)
        yield pd.DataFrame({"a": names[a], "b": names[b], "pairs": total[a, b]})

    # The list of one client holds each term once: it is bounded by the vocabulary.
    items = counts.where(F.col("code").isin(codes)).groupBy("client_id").agg(F.collect_list(F.struct("code", "n")).alias("items"))
    return items.select("items").mapInPandas(count, PAIR_TYPE).groupBy("a", "b").agg(F.sum("pairs").alias("pairs"))


def _best_pairs(counts: DataFrame, top: int, multiset: bool) -> DataFrame:
    """The best pairs of each bucket of first terms. A term travels once with those that follow it in a client, as
    one row of whole numbers; a bucket sees all pairs of its first terms, so that its counts are final."""
    lists = counts.groupBy("client_id").agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("items"))
    start = F.col("i") + (1 if multiset else 2)
    heads = lists.select("items", F.posexplode("items").alias("i", "x")).select(
        F.col("x.code").alias("a"), F.col("x.n").alias("m"), F.slice("items", start, F.size("items")).alias("y")
    ).where(F.size("y") > 0).select("a", "m", F.col("y.code").alias("b"), *([F.col("y.n").alias("k")] if multiset else []))
    size = F.count("*")
    spelled = counts.groupBy("client_id").agg(size.alias("s")).agg(F.sum(F.col("s") * (F.col("s") + 1) / 2)).first()[0] or 0
    buckets = max(1, -(-int(spelled) // PAIR_BUCKET))

    def count(table: pa.Table) -> pa.Table:
        columns = table.combine_chunks()
        b = columns.column("b").combine_chunks()
        many = b.value_lengths().to_numpy()
        key = (np.repeat(columns.column("a").to_numpy().astype(np.int64), many) << 32) | b.flatten().to_numpy()
        n = np.ones(len(key), dtype=np.int64)
        if multiset:
            own = key >> 32 == key & 0xFFFFFFFF
            m, k = np.repeat(columns.column("m").to_numpy(), many), columns.column("k").combine_chunks().flatten().to_numpy()
            n = np.where(own, k * (k - 1) // 2, m * k)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        pair, total = key[first], np.add.reduceat(n, first)
        best = np.lexsort((pair, -total))[:top]
        best = best[total[best] > 0]
        return pa.table({
            "a": pa.array(pair[best] >> 32, pa.int32()), "b": pa.array(pair[best] & 0xFFFFFFFF, pa.int32()),
            "pairs": pa.array(total[best], pa.int64()),
        })

    return heads.groupBy(F.pmod("a", F.lit(buckets)).alias("bucket")).applyInArrow(count, PAIR_TYPE)


def cooccurrence(concepts: DataFrame | Mentions, top: int = 50, multiset: bool = False, limit: int = PAIR_VOCABULARY_LIMIT) -> DataFrame:
    """The ``top`` pairs of terms that share a client: once per client, or once per pair of mentions.

    The best pairs of the commonest terms give a count that a winner reaches. A pair cannot be commoner than its
    rarer term, nor, by mentions, than the root of the product of its terms' sums of squares; terms that cannot reach
    that count are out. If no more than ``limit`` terms stay, tasks add up small matrices; else pairs meet by first term.
    """
    seen = code_mentions(concepts)
    counts = seen.counts.where("code IS NOT NULL")
    order = [F.desc("pairs"), F.col("a"), F.col("b")]
    weight = F.sum(F.col("n").cast("double") * F.col("n")) if multiset else F.count("*").cast("double")
    weights = counts.groupBy("code").agg(weight.alias("w"))
    common = weights.orderBy(F.desc("w"), "code").limit(min(limit, PAIR_PROBE)).collect()
    least = 0.0
    if len(common) == PAIR_PROBE < limit:
        found = _pair_counts(counts, sorted(r["code"] for r in common), multiset).orderBy(*order).limit(top).collect()
        if len(found) == top:
            least = float(found[-1]["pairs"])
    reach = F.sqrt(F.col("w") * common[0]["w"]) * (1 + 1e-9) if multiset and common else F.col("w")
    wanted = weights.where(reach >= least).select("code")
    codes = sorted(r["code"] for r in wanted.limit(limit + 1).collect())
    if not codes:
        best = counts.select(F.col("code").alias("a"), F.col("code").alias("b"), F.col("n").alias("pairs")).limit(0)
    elif len(codes) <= limit:
        best = _pair_counts(counts, codes, multiset).orderBy(*order).limit(top)
    else:
        best = _best_pairs(counts.join(small_table(wanted), "code", "left_semi"), top, multiset).orderBy(*order).limit(top)
    first, second = (seen.names.select(F.col("code").alias(c), F.col("term").alias(f"_{c}")) for c in "ab")
    best = F.broadcast(best)  # at most ``top`` rows
    named = second.join(first.join(best, "a"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "pairs")
    return named.orderBy(*order).limit(top)


def pair_features(concepts: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """One 0/1 column per pair: does the client mention both terms?"""
    wanted = sorted({t for p in pairs for t in p})
    has = concepts.where(F.col("matched_alias").isin(wanted)).groupBy("client_id").agg(F.collect_set("matched_alias").alias("t"))
    both = [
        (F.array_contains("t", a) & F.array_contains("t", b)).cast("int").alias(f"pair_{i}") for i, (a, b) in enumerate(pairs)
    ]
    return concepts.select("client_id").distinct().join(has, "client_id", "left").select("client_id", *both).na.fill(0)


def one_hot(concepts: DataFrame, terms: list[str]) -> DataFrame:
    """Client by term, 0 or 1, for a given short list of terms."""
    flags = [F.max((F.col("term") == t).cast("int")).alias(f"has_{t.replace(' ', '_')}") for t in terms]
    return mention_counts(concepts).groupBy("client_id").agg(*flags)


# ---- tf-idf of a client -----------------------------------------------------------------------------


def _grams(term: Column, high: int) -> Column:
    """Words and word runs of a term, repeats included."""
    words = F.regexp_extract_all(F.lower(term), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))

    def runs(w: Column, n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, cut).otherwise(F.array().cast("array<string>"))

    return let(words, lambda w: F.concat(*[runs(w, i) for i in range(1, high + 1)]))


def term_grams(names: DataFrame, high: int) -> DataFrame:
    """``(code, gram, times)``: the words and word runs inside each different term, read once a term."""
    flat = explode_items(names, _grams(F.col("term"), high), "gram", "code")
    return flat.groupBy("code", "gram").agg(F.count("*").alias("times"))


def client_grams(seen: Mentions, grams: DataFrame) -> DataFrame:
    """``(client_id, position, tf)`` of the ``grams(code, position, times)``, which are few for each code."""
    lists = grams.groupBy("code").agg(F.collect_list(F.struct("position", "times")).alias("items"))
    met = explode_items(by_client(seen.counts, lists, "inner"), F.col("items"), "x", "client_id", "n")
    return met.groupBy("client_id", F.col("x.position").alias("position")).agg(F.sum(F.col("n") * F.col("x.times")).alias("tf"))


def fit_vocabulary(concepts: DataFrame | Mentions, features: int = 500, high: int = 2, min_df: int = 2, max_df: float = 0.8) -> list[tuple[str, float]]:
    """The commonest terms with their smoothed idf. At most ``features`` rows: a model parameter, saved with the model.

    How often a run occurs follows from the counts of the different terms. Only the commonest runs are looked up in
    the clients, and more of them as long as too few pass.
    """
    seen = code_mentions(concepts)
    n = seen.counts.select("client_id").distinct().count()
    often = seen.counts.groupBy("code").agg(F.sum("n").alias("n"))
    grams = cut_lineage(term_grams(seen.names, high))
    totals = cut_lineage(
        grams.join(small_table(often), "code").groupBy("gram").agg(F.sum(F.col("n") * F.col("times")).alias("total")).where(F.col("total") >= min_df))
    different, most = totals.count(), 2 * features
    while True:
        best = totals.orderBy(F.desc("total"), "gram").limit(most) if most < different else totals
        tried = cut_lineage(global_index(best, ["gram"], "position"))
        known = grams.join(small_table(tried.select("gram", "position")), "gram").select("code", "position", "times")
        df = client_grams(seen, known).groupBy("position").agg(F.count("*").alias("df"))
        rows = (
            df.join(tried, "position").where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
            .orderBy(F.desc("total"), "gram").limit(features).collect()
        )
        if len(rows) == features or most >= different:
            return sorted((r["gram"], math.log((1 + n) / (1 + r["df"])) + 1) for r in rows)
        most *= 8


# ---- labels by rule -----------------------------------------------------------------------------------


def rule_scores(concepts: DataFrame, elite: bool = False) -> DataFrame:
    """Purchase score and value from keyword families: base plus weights, clipped. No randomness."""
    weights = config.ELITE_PURCHASE_WEIGHTS if elite else config.FAST_PURCHASE_WEIGHTS
    start, adds, floor = config.ELITE_VALUE_WEIGHTS if elite else config.FAST_VALUE_WEIGHTS
    flags = [F.max(_any(F.col("term"), words).cast("int")).alias(f"_p{i}") for i, (words, _) in enumerate(weights)]
    flags += [F.max(_any(F.col("term"), words).cast("int")).alias(f"_v{i}") for i, (words, _) in enumerate(adds)]
    seen = mention_counts(concepts).groupBy("client_id").agg(*flags)
    score = F.lit(0.3)
    for i, (_, w) in enumerate(weights):
        score = score + F.col(f"_p{i}") * w
    value = F.lit(start)
    for i, (_, w) in enumerate(adds):
        value = value + F.col(f"_v{i}") * w
    high = 0.95 if elite else 0.9
    return seen.select(
        "client_id", F.round(F.greatest(F.lit(0.1), F.least(F.lit(high), score)), 4).alias("purchase_score"),
        F.greatest(F.lit(floor), value).alias("value_score"),
    )


def rule_labels(concepts: DataFrame, elite: bool = False, seed: int = 42) -> DataFrame:
    """Weak labels drawn from the rule scores with seeded hashes, the same on any partitioning."""
    def uniform(salt: int) -> Column:
        return (F.pmod(F.xxhash64("client_id", F.lit(seed + salt)), F.lit(1_000_000)) + 0.5) / 1_000_000

    keep = 0.8 if elite else 1.0
    noise = F.sqrt(-2 * F.log(uniform(2))) * F.cos(2 * math.pi * uniform(3))
    spread, least = (1500.0, 500.0) if elite else (2000.0, 1000.0)
    return rule_scores(concepts, elite).select(
        "client_id", (uniform(0) < F.col("purchase_score")).cast("int").alias("purchased"),
        (uniform(1) < 1 - F.col("purchase_score") * keep).cast("int").alias("churned"),
        F.greatest(F.lit(least), F.col("value_score") + noise * spread).alias("lifetime_value"),
    )
