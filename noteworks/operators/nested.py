"""Parents with their children as nested arrays, in pages of bounded size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteworks.operators.ranking import global_index

PAGE = 100


def paged(children: DataFrame, key: str, order: list[str | Column], name: str, page: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """Children of each key cut into pages: ``(key, page, name)`` with at most ``page`` structs each, and the
    totals ``(key, n_name)``.

    Places come from the global order of key and ``order``, so the children of one key may fill any number of
    tasks; only a page is ever gathered.
    """
    keys = [F.col(f"`{key}`"), *order]
    placed = global_index(children, keys, "_at")
    totals = placed.groupBy(key).agg(F.count("*").alias(f"n_{name}"), F.min("_at").alias("_first"))
    own = placed.join(totals.select(key, "_first"), key).withColumn("_place", F.col("_at") - F.col("_first"))
    fields = [c for c in children.columns if c != key]
    body = F.array_sort(F.collect_list(F.struct("_place", F.struct(*fields).alias("item"))))
    pages = own.groupBy(key, F.floor(F.col("_place") / page).cast("long").alias("page")).agg(
        F.transform(body, lambda x: x["item"]).alias(name))
    return pages, totals.drop("_first")


def nest(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[str | Column]]], page: int = PAGE) -> DataFrame:
    """One row per parent and page: its columns, ``page``, and for each kind of child an array and a total.

    A parent without children has one page of empty arrays; a kind that has run out has empty arrays on later
    pages. Null keys have no children; children without a parent are left out.
    """
    parts = {name: paged(df.where(F.col(f"`{key}`").isNotNull()), key, order, name, page) for name, (df, order) in children.items()}
    kinds = {name: rows for name, (rows, _) in parts.items()}
    if not parts:
        return parents.withColumn("page", F.lit(0).cast("long"))
    # Every kind begins with page 0, so pages of all kinds meet once, and then their parents by the key alone.
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds.values())
    met = stacked.groupBy(key, "page").agg(*[F.first(name, ignorenulls=True).alias(name) for name in kinds])
    out = parents.join(met, key, "left").withColumn("page", F.coalesce("page", F.lit(0).cast("long")))
    for name, (rows, totals) in parts.items():
        empty = F.array().cast(rows.schema[name].dataType)
        out = out.join(totals, key, "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0).cast("long"))).withColumn(
            name, F.coalesce(name, empty))
    return out


def list_clients(clients: DataFrame, concepts: DataFrame, actions: DataFrame, include_deleted: bool = False, page: int = PAGE) -> DataFrame:
    """Clients with their concept evidence and their actions (most urgent first), ``page`` of each a row."""
    shown = clients if include_deleted else clients.where(~F.coalesce("is_deleted", F.lit(False)))
    empty = F.lit("")
    evidence = concepts.select(
        "client_id", F.coalesce("label", "concept_id").alias("concept"), F.coalesce("matched_alias", empty).alias("alias"),
        F.coalesce("span_start", F.lit(0)).alias("span_start"), F.coalesce("span_end", F.lit(0)).alias("span_end"), F.col("note_id").alias("note_id"))
    urgency = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    listed = actions.select(
        "client_id", "action_id", F.coalesce("title", empty).alias("title"), F.coalesce("channel", empty).alias("channel"),
        F.coalesce("priority", F.lit("low")).alias("priority"), "is_completed", "created_on")
    out = nest(shown, "client_id", {
        "concepts": (evidence, ["note_id", "span_start", "concept", "alias"]),
        "actions": (listed, [urgency, "created_on", "action_id"]),
    }, page)
    names = F.when(F.coalesce("top_concepts", empty) == "", F.array().cast("array<string>")).otherwise(F.split("top_concepts", r"\|"))
    return out.withColumn("top_concepts", names).withColumn("language", F.coalesce("language", F.lit("FR"))).withColumn(
        "segment_id", F.coalesce("segment_id", F.lit(0)))
