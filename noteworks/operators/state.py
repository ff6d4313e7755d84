"""Batch state changes: the next snapshot of a table from its base and a table of changes.

Nothing is updated in place. Each operator returns the new snapshot, to be written beside the old one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteworks.operators.ranking import top_per_group


def latest_change(delta: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """One row per key, the last by ``order``; a partial aggregate, so a hot key costs nothing extra."""
    rest = [c for c in delta.columns if c not in keys]
    picked = delta.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return picked.select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], keep_if_null: tuple[str, ...] = (),
           constants: dict[str, Column] | None = None, change: str | None = None) -> DataFrame:
    """Insert or update. Columns in ``keep_if_null`` keep the old value when the new one is null; columns
    missing from ``delta`` keep theirs; ``constants`` are set on every touched row. ``change`` names an extra
    column that says new, updated or kept."""
    rest = [c for c in base.columns if c not in keys]
    old = base.select(*keys, F.struct(*rest).alias("_old"), F.lit(True).alias("_has_old"))
    given = [c for c in delta.columns if c not in keys and c in rest]
    new = delta.select(*keys, F.struct(*given).alias("_new"), F.lit(True).alias("_has_new"))
    both = old.join(new, keys, "full_outer")
    touched = F.coalesce("_has_new", F.lit(False))

    def value(c: str) -> Column:
        before = F.col("_old")[c]
        if constants and c in constants:
            return F.when(touched, constants[c]).otherwise(before)
        if c not in given:
            return before
        after = F.coalesce(F.col("_new")[c], before) if c in keep_if_null else F.col("_new")[c]
        return F.when(touched, after).otherwise(before)

    out = [*keys, *[value(c).alias(c) for c in rest]]
    if change:
        state = F.when(~touched, "kept").when(F.coalesce("_has_old", F.lit(False)), "updated").otherwise("new")
        out.append(state.alias(change))
    return both.select(*out)


def upsert_clients(base: DataFrame, delta: DataFrame, change: str | None = None) -> DataFrame:
    """Clients come back from deletion when they are seen again; text fields survive a null."""
    return upsert(
        base, delta, ["client_id"], keep_if_null=("full_text", "language", "note_date"),
        constants={"is_deleted": F.lit(False)}, change=change,
    )


def incremental_diff(base: DataFrame, incoming: DataFrame, key: str = "note_id", text: str = "text") -> DataFrame:
    """``key`` and its state: new, changed or unchanged, by the digest of the text."""
    old = base.select(key, F.md5(text).alias("_old"))
    new = incoming.select(key, F.md5(text).alias("_new"))
    return new.join(old, key, "left").select(
        key,
        F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed").alias("state"),
    )


def replace_children(base: DataFrame, incoming: DataFrame, processed: DataFrame, parent: str = "client_id",
                     unique: list[str] | None = None, protect: Column | None = None) -> DataFrame:
    """Drop the rows of processed parents (except ``protect`` ones) and add the incoming rows of those parents."""
    ids = processed.select(parent).distinct()
    gone = base.where(~F.coalesce(protect, F.lit(False))) if protect is not None else base
    kept = gone.join(ids, parent, "left_anti")
    if protect is not None:
        kept = kept.unionByName(base.where(F.coalesce(protect, F.lit(False))))
    fresh = incoming.join(ids, parent, "left_semi")
    return kept.unionByName(fresh.dropDuplicates(unique) if unique else fresh)


def soft_delete(clients: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("client_id").distinct().withColumn("_hit", F.lit(True))
    return clients.join(hit, "client_id", "left").withColumn(
        "is_deleted", F.coalesce("_hit", "is_deleted")
    ).drop("_hit")


def erase(tables: dict[str, DataFrame], ids: DataFrame, key: str = "client_id") -> dict[str, DataFrame]:
    """Every table of the registry without the given ids."""
    gone = ids.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def erase_counts(tables: dict[str, DataFrame], ids: DataFrame, key: str = "client_id") -> DataFrame:
    """Rows to erase and rows that stay, per table."""
    gone = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    parts = [
        df.join(gone, key, "left").agg(
            F.lit(name).alias("table"), F.count_if("_hit").alias("erased"), F.count_if(F.col("_hit").isNull()).alias("kept")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def export_documents(tables: dict[str, DataFrame], ids: DataFrame, key: str = "client_id") -> DataFrame:
    """All data of the given ids as JSON records ``(key, section, record)``.

    A document is the records of one key; they stay separate rows, since one client can own any share of a table.
    """
    wanted = ids.select(key).distinct()
    parts = []
    for name, df in tables.items():
        record = F.to_json(F.struct(*sorted(df.columns)))
        parts.append(df.join(wanted, key, "left_semi").select(key, F.lit(name).alias("section"), record.alias("record")))
    return reduce(DataFrame.unionByName, parts)


def client_core(clients: DataFrame, segments: DataFrame, assigned: DataFrame, advisors: DataFrame) -> DataFrame:
    """Client with segment, creator and advisor; staff is joined twice under two names."""
    named = segments.select("segment_id", F.col("name").alias("segment_name"), F.col("client_count").alias("segment_size"))
    creator = advisors.select(F.col("advisor_id").alias("created_by"), F.col("advisor_name").alias("created_by_name"))
    return (
        clients.where(~F.coalesce("is_deleted", F.lit(False))).join(named, "segment_id", "left")
        .join(assigned.select("client_id", "advisor_id", "created_by"), "client_id", "left")
        .join(creator, "created_by", "left")
        .join(advisors.select("advisor_id", "advisor_name"), "advisor_id", "left")
    )


def similar_in_segment(clients: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most confident other clients of the same segment.

    Only the best k+1 of a segment can appear in anyone's list, so the segment is cut to them first and
    the join carries k+1 rows per segment, however many clients it has.
    """
    alive = clients.where(~F.coalesce("is_deleted", F.lit(False))).select("client_id", "segment_id", "confidence")
    best = top_per_group(alive, ["segment_id"], [F.desc("confidence"), "client_id"], k + 1, "place")
    listed = best.groupBy("segment_id").agg(
        F.array_sort(F.collect_list(F.struct("place", F.col("client_id").alias("similar_id"), F.col("confidence").alias("similar_confidence")))).alias("b")
    )
    others = F.slice(F.filter("b", lambda s: s["similar_id"] != F.col("client_id")), 1, k)
    return alive.join(listed, "segment_id").select("client_id", F.posexplode(others).alias("pos", "s")).select(
        "client_id", (F.col("pos") + 1).alias("rank"), "s.similar_id", "s.similar_confidence"
    )


def client_360(sections: dict[str, DataFrame], ids: DataFrame | None = None, key: str = "client_id") -> DataFrame:
    """All sections of a client view as JSON records; every section carries ``position``, its order inside."""
    parts = []
    for name, df in sections.items():
        body = [c for c in sorted(df.columns) if c not in (key, "position")]
        rows = df if ids is None else df.join(ids.select(key).distinct(), key, "left_semi")
        parts.append(rows.select(key, F.lit(name).alias("section"), F.col("position").cast("bigint").alias("position"),
                                 F.to_json(F.struct(*body)).alias("record")))
    return reduce(DataFrame.unionByName, parts)


def timeline(audit: DataFrame, k: int = 20) -> DataFrame:
    return top_per_group(audit, ["client_id"], [F.desc("ts"), F.desc("change_id")], k, "position")


def log_rows(entries: DataFrame, details: list[str], at: Column) -> DataFrame:
    """Audit or run rows with their details packed as JSON."""
    rest = [c for c in entries.columns if c not in details]
    return entries.select(*rest, F.to_json(F.struct(*details)).alias("details"), at.alias("created_at"))
