"""Playbook rules, event targeting, engagement scores and advisor assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteworks import config
from noteworks.functions import text as T

from noteworks.functions.rules import half_up, priority_rank, score_tier
from noteworks.functions.spans import let
from noteworks.operators.ranking import global_index
from noteworks.operators.state import upsert
from noteworks.session import BROADCAST_ROW_LIMIT

PLAYBOOK_SCHEMA = (
    "action_id string, title string, channel string, priority string, kpi string, buckets array<string>, "
    "keywords array<string>, min_confidence double, description string"
)


def _playbook_literal(playbook: list[tuple]) -> Column:
    names = [f.split()[0] for f in PLAYBOOK_SCHEMA.split(", ")]
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in playbook])


def _occurrences_weight(text: Column, aliases: Column) -> Column:
    """Half a point for each alias occurrence ``(alias, n)`` whose alias stands in the text."""
    low = F.lower(text)
    return F.aggregate(
        aliases, F.lit(0.0), lambda s, a: s + F.when(F.contains(low, F.lower(a["alias"])), 0.5 * a["n"]).otherwise(0.0)
    )


def client_evidence(concepts: DataFrame) -> DataFrame:
    """Per client the buckets and the aliases with their counts. Both lists are bounded by the lexicon: rows
    are first counted per (client, alias), which also disarms a client with most of the mentions."""
    counted = concepts.groupBy("client_id", "bucket", "matched_alias").agg(F.count("*").alias("n"))
    return counted.groupBy("client_id").agg(
        F.array_sort(F.collect_set("bucket")).alias("client_buckets"),
        F.array_sort(F.collect_list(F.struct(F.col("matched_alias").alias("alias"), "n"))).alias("aliases"),
    )


def recommend_actions(profiles: DataFrame, concepts: DataFrame, playbook: list[tuple] | None = None) -> DataFrame:
    """Match every client ``(client_id, profile_type, top_concepts, confidence, text)`` with the playbook.

    The playbook is a short literal, so clients are scored where they lie, one pass, no join with actions.
    Score: 2 per shared bucket, 1 per keyword contained, 0.5 per alias occurrence contained in the text.
    """
    rules = list(config.DEFAULT_PLAYBOOK if playbook is None else playbook)
    known = profiles.join(client_evidence(concepts), "client_id", "left")
    prepared = known.select(
        "client_id", "confidence", "top_concepts", "profile_type", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("client_buckets", F.array().cast("array<string>")).alias("client_buckets"),
        F.coalesce("aliases", F.array().cast("array<struct<alias:string,n:bigint>>")).alias("aliases"),
    )
    evidence = F.struct(
        F.lower(F.concat_ws(" ", F.coalesce("profile_type", F.lit("")), F.coalesce("top_concepts", F.lit("")), "text")).alias("haystack"),
        _occurrences_weight(F.col("text"), F.col("aliases")).alias("alias_score"), F.lower("text").alias("low"),
    )

    def rank(e: Column) -> Column:
        def match(a: Column) -> Column:
            shared = F.array_sort(F.array_intersect("client_buckets", a["buckets"]))
            words = F.filter(a["keywords"], lambda k: F.contains(e["haystack"], F.lower(k)))
            return let(
                F.struct(shared.alias("shared"), words.alias("words")),
                lambda m: F.struct(
                    priority_rank(a["priority"]).alias("priority_rank"),
                    (-(2.0 * F.size(m["shared"]) + F.size(m["words"]) + e["alias_score"])).alias("minus"),
                    a["action_id"].alias("action_id"), a.alias("action"), m["shared"].alias("shared"), m["words"].alias("words"),
                ),
            )

        allowed = F.filter(_playbook_literal(rules), lambda a: F.coalesce("confidence", F.lit(0.0)) >= a["min_confidence"])
        matched = F.array_sort(F.filter(F.transform(allowed, match), lambda m: m["minus"] < 0))

        def describe(m: Column) -> Column:
            triggers = F.slice(
                F.concat(F.transform(m["shared"], lambda b: F.concat(F.lit("bucket:"), b)),
                         F.transform(m["words"], lambda k: F.concat(F.lit("keyword:"), k))), 1, 5)
            a = m["action"]
            return F.struct(
                a["action_id"].alias("action_id"), a["title"].alias("title"), a["channel"].alias("channel"),
                a["priority"].alias("priority"), a["kpi"].alias("kpi"), F.array_join(triggers, " | ").alias("triggers"),
                rationale(a, e["low"]).alias("rationale"), m["minus"].alias("minus"),
            )

        return F.transform(matched, describe)

    # Ranked inside the row by priority, score, id: no action ever has to meet its siblings again in a shuffle.
    listed = prepared.select("client_id", F.posexplode_outer(let(evidence, rank)).alias("pos", "r"))
    return listed.where("r IS NOT NULL").select(
        "client_id", "r.action_id", "r.title", "r.channel", "r.priority", "r.kpi", "r.triggers", "r.rationale",
        (-F.col("r.minus")).alias("score"), (F.col("pos") + 1).alias("rank"),
    )


def rationale(action: Column, low: Column) -> Column:
    """Description, evidence words, profile concepts and a snippet around the first evidence word."""
    evidence = F.filter(action["keywords"], lambda k: F.contains(low, F.lower(k)))
    head = F.slice(T.split_terms(F.col("top_concepts")), 1, 3)
    excerpt = T.snippet(F.col("text"), F.get(evidence, F.lit(0)))
    return F.concat_ws(
        " ",
        F.coalesce(action["description"], action["title"]),
        F.when(F.size(evidence) > 0, F.concat(
            F.lit("Détecté chez "), F.col("client_id").cast("string"), F.lit(": "), F.array_join(F.slice(evidence, 1, 4), ", "), F.lit("."))),
        F.when(F.size(head) > 0, F.concat(F.lit("Profil : "), F.array_join(head, ", "), F.lit("."))),
        F.when((F.size(evidence) > 0) & (excerpt != ""), F.concat(F.lit('Extrait : "'), excerpt, F.lit('"'))),
    )


def client_texts(notes: DataFrame) -> DataFrame:
    """The text of a client: the last of its notes by date, by a partial aggregate."""
    return notes.groupBy("client_id").agg(F.max_by("text", F.struct("date", "note_id")).alias("text"))


def match_event_clients(calendar: DataFrame, clients: DataFrame) -> DataFrame:
    """Overlap of event concepts and client concepts as an equi-join on the concept.

    Pairs are only counted, next to where a client's concepts lie, and the reason is the intersection of two lists
    afterwards: no concept is ever shuffled once for each event that wants it.
    """
    wanted = calendar.select("event_id", F.explode("concepts").alias("c")).select("event_id", F.trim(F.lower("c")).alias("concept")).where("concept <> ''").distinct()
    near = F.broadcast if wanted.limit(BROADCAST_ROW_LIMIT + 1).count() <= BROADCAST_ROW_LIMIT else (lambda side: side)
    # A struct, since rows without a client id are a client too.
    have = clients.where(~F.coalesce("is_deleted", F.lit(False))).select(
        F.struct("client_id").alias("_who"), F.explode(T.split_terms(F.col("top_concepts"))).alias("c")
    ).groupBy("_who").agg(F.array_sort(F.collect_set(F.lower("c"))).alias("_have"))
    counted = have.select("_who", F.explode("_have").alias("concept")).join(near(wanted), "concept").groupBy(
        "_who", "event_id").agg(F.count("*").alias("overlap"))
    best = counted.groupBy("event_id").agg(F.max("overlap").alias("best"), F.count("*").alias("matched_count"))
    lists = wanted.groupBy("event_id").agg(F.collect_list("concept").alias("_want"))
    reason = F.array_join(F.array_intersect("_have", "_want"), " | ")
    return counted.join(have.hint("merge"), "_who").join(near(best.join(lists, "event_id")), "event_id").select(
        "event_id", "_who.client_id", reason.alias("match_reason"), F.round(F.col("overlap") / F.col("best"), 3).alias("match_score"), "matched_count"
    )


def update_events(calendar: DataFrame, changes: DataFrame, clients: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Create or update events; those whose concepts changed get their targets matched anew.

    Returns the next calendar and the next ``(event_id, client_id, match_reason, match_score)`` targets.
    """
    fields = tuple(c for c in calendar.columns if c != "event_id")
    updated = upsert(calendar, changes, ["event_id"], keep_if_null=fields)
    before = calendar.select("event_id", F.array_sort("concepts").alias("_before"))
    moved = updated.join(before, "event_id", "left").where(
        ~F.array_sort("concepts").eqNullSafe(F.col("_before"))
    ).select(*calendar.columns)
    fresh = match_event_clients(moved, clients).select("event_id", "client_id", "match_reason", "match_score")
    kept = targets.join(moved.select("event_id"), "event_id", "left_anti").select(*fresh.columns)
    return updated, kept.unionByName(fresh)


def complete_actions(actions: DataFrame, done: DataFrame) -> DataFrame:
    """Mark actions as completed from a log ``(client_id, action_id, completed_at)``; the first completion counts."""
    first = done.groupBy("client_id", "action_id").agg(F.min("completed_at").alias("_at"))
    joined = actions.join(first, ["client_id", "action_id"], "left")
    return joined.withColumn("is_completed", F.col("is_completed") | F.col("_at").isNotNull()).withColumnRenamed("_at", "completed_at")


def activate_playbook(templates: DataFrame, today: str, days: int = 14) -> DataFrame:
    """Events from playbook templates, two weeks ahead unless the template has a date."""
    return templates.select(
        F.col("template_id").alias("event_id"), "title", "channel", "concepts",
        F.coalesce("event_date", F.date_add(F.lit(today).cast("date"), days)).alias("event_date"),
        F.lit("scheduled").alias("status"),
    )


def activate_and_match(templates: DataFrame, clients: DataFrame, today: str, days: int = 14) -> tuple[DataFrame, DataFrame]:
    """Events from playbook templates and the clients that their concepts reach, with reason and score."""
    events = activate_playbook(templates, today, days)
    return events, match_event_clients(events, clients).select("event_id", "client_id", "match_reason", "match_score")


def event_detail(calendar: DataFrame, targets: DataFrame, state: DataFrame, clients: DataFrame) -> DataFrame:
    """Live target clients of every event with match, standing and segment, the best match first.

    ``targets`` come from ``match_event_clients``, ``state`` from ``apply_target_updates``; targets without a change
    are pending. Rows are ordered as a range sort, so a large event spreads over tasks.
    """
    live = clients.where(~F.coalesce("is_deleted", F.lit(False))).select("client_id", "segment_id", "profile_type", "confidence")
    standing = state.select("event_id", "client_id", "action_status", "outcome", "outcome_value")
    rows = targets.select("event_id", "client_id", "match_score", "match_reason").join(live, "client_id")
    rows = rows.join(standing, ["event_id", "client_id"], "left").join(calendar.select("event_id", "title", "status"), "event_id")
    rows = rows.withColumns({"action_status": F.coalesce("action_status", F.lit("pending")), "outcome": F.coalesce("outcome", F.lit("none"))})
    return rows.orderBy("event_id", F.col("match_score").desc(), "client_id")


def apply_target_updates(changes: DataFrame) -> DataFrame:
    """Latest state of every (event, client) from a log of changes, with the time of each milestone."""
    def last(value: str, when: Column) -> Column:
        return F.max(F.when(when, F.col(value)))

    return changes.groupBy("event_id", "client_id").agg(
        F.max_by(F.struct("action_status", "outcome", "outcome_value"), "change_id").alias("s"),
        last("ts", F.col("action_status") == "notified").alias("notified_at"),
        last("ts", F.col("action_status") == "responded").alias("responded_at"),
        last("ts", F.col("outcome") != "none").alias("outcome_at"),
    ).select("event_id", "client_id", "s.action_status", "s.outcome", "s.outcome_value", "notified_at", "responded_at", "outcome_at")


def notified_counts(targets: DataFrame) -> DataFrame:
    return targets.groupBy("event_id").agg(F.count_if(F.col("action_status").isin("notified", "responded")).alias("notified_count"))


STAFF_LITERAL_LIMIT = 10_000


def _give(placed: DataFrame, advisors: DataFrame) -> DataFrame:
    """Advisor of each row from its position ``i``, modulo the number of advisors who take clients."""
    staff = advisors.where(F.col("is_active") & F.col("role").isin("sales", "manager")).select("advisor_id")
    rows = staff.orderBy("advisor_id").limit(STAFF_LITERAL_LIMIT + 1).collect()
    if not rows:
        return placed.withColumn("advisor_id", F.lit(None).cast("bigint"))
    if len(rows) <= STAFF_LITERAL_LIMIT:
        ids = F.lit([r["advisor_id"] for r in rows]).cast("array<bigint>")
        return placed.withColumn("advisor_id", F.get(ids, (F.col("i") % F.size(ids)).cast("int")))
    indexed = global_index(staff, ["advisor_id"], "k")
    return placed.withColumn("k", F.col("i") % staff.count()).join(indexed, "k").drop("k")


def assign_round_robin(unassigned: DataFrame, advisors: DataFrame) -> DataFrame:
    """The i-th client, by id, goes to advisor i modulo n."""
    placed = global_index(unassigned.select("client_id"), ["client_id"], "i")
    return _give(placed, advisors).select("client_id", "advisor_id")


def assign_by_segment(unassigned: DataFrame, advisors: DataFrame) -> DataFrame:
    """All clients of a segment go to the same advisor; no segment counts as segment 0."""
    keyed = unassigned.select("client_id", F.coalesce("segment_id", F.lit(0)).alias("segment_id"))
    codes = _give(global_index(keyed.select("segment_id").distinct(), ["segment_id"], "i"), advisors)
    return keyed.join(codes, "segment_id").select("client_id", "advisor_id")


def reassign(assigned: DataFrame, changes: DataFrame) -> DataFrame:
    """Overwrite the advisor of the clients in ``changes``; a null advisor unassigns."""
    new = changes.select("client_id", F.col("advisor_id").alias("_new"), F.lit(True).alias("_hit"))
    return assigned.join(new, "client_id", "left").withColumn(
        "advisor_id", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("advisor_id"))
    ).drop("_new", "_hit")


def client_scores(clients: DataFrame, actions: DataFrame, targets: DataFrame, as_of: str) -> DataFrame:
    """Engagement, value and overall score of every live client, with tier and details."""
    acts = actions.groupBy("client_id").agg(
        F.count("*").alias("total_actions"), F.count_if("is_completed").alias("completed_actions"),
        F.count_if(F.col("priority") == "high").alias("high_actions"),
    )
    evts = targets.groupBy("client_id").agg(F.count("*").alias("event_count"))
    base = (
        clients.where(~F.coalesce("is_deleted", F.lit(False))).join(acts, "client_id", "left").join(evts, "client_id", "left")
        .na.fill(0, ["total_actions", "completed_actions", "high_actions", "event_count"])
    )

    def full(value: Column, size: float) -> Column:
        return F.least(value / size * 100, F.lit(100.0))

    n = F.size(T.split_terms(F.col("top_concepts")))
    age = F.date_diff(F.lit(as_of).cast("date"), F.col("note_date"))
    parts = {
        "concept_score": full(n, 8.0),
        "action_score": full(F.col("total_actions"), 10.0),
        "completion_rate": F.when(F.col("total_actions") > 0, F.col("completed_actions") / F.col("total_actions") * 100).otherwise(0.0),
        "event_score": full(F.col("event_count"), 3.0),
        "recency_score": F.when(age.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 - age / 365 * 100))).otherwise(0.0),
        "confidence_pct": F.coalesce("confidence", F.lit(0.0)) * 100,
        "priority_score": full(F.col("high_actions"), 5.0),
        "richness_score": full(n, 6.0),
    }
    scored = base.select("client_id", "segment_id", *[c.alias(k) for k, c in parts.items()])
    engagement = (
        F.col("concept_score") * 0.20 + F.col("action_score") * 0.20 + F.col("completion_rate") * 0.25
        + F.col("event_score") * 0.15 + F.col("recency_score") * 0.20
    )
    value = F.col("confidence_pct") * 0.40 + F.col("priority_score") * 0.30 + F.col("richness_score") * 0.30
    final = scored.withColumn("_e", engagement).withColumn("_v", value).withColumn("_o", F.col("_e") * 0.6 + F.col("_v") * 0.4)
    return final.select(
        "client_id", half_up(F.col("_e")).alias("engagement_score"), half_up(F.col("_v")).alias("value_score"),
        half_up(F.col("_o")).alias("overall_score"), score_tier(F.col("_o")).alias("tier"),
        F.struct(*[F.round(k, 1).alias(k) for k in parts]).alias("score_details"),
    )
