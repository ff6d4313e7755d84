"""Aggregates behind dashboards, KPI pages and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteworks import config
from noteworks.functions import text as T
from noteworks.functions.rules import mean_tenths, priority_rank, rate
from noteworks.operators.quantiles import exact_quantiles
from noteworks.operators.ranking import top_per_group
from noteworks.session import literal_table, one_row


def live(clients: DataFrame) -> DataFrame:
    return clients.where(~F.coalesce("is_deleted", F.lit(False)))


def segment_distribution(clients: DataFrame) -> DataFrame:
    """Size of each segment, its profile, and the first three concepts of its lowest client id."""
    first = F.min_by(F.struct("profile_type", "top_concepts"), "client_id")
    grouped = clients.groupBy("segment_id").agg(F.count("*").alias("value"), first.alias("f"))
    head = F.slice(T.split_terms(F.col("f.top_concepts")), 1, 3)
    fallback = F.coalesce(F.get(F.split("f.profile_type", r" \| "), F.lit(0)), F.concat(F.lit("Segment "), "segment_id"))
    return grouped.select(
        "segment_id",
        F.concat(F.lit("Segment "), "segment_id").alias("name"),
        "value",
        F.when(F.size(head) > 0, F.array_join(head, " | ")).otherwise(fallback).alias("profile"),
        F.col("f.profile_type").alias("full_profile"),
    )


def top_concepts(concepts: DataFrame, k: int) -> DataFrame:
    """Commonest labels with mentions and distinct clients. Pairs are counted before labels, so one label
    with most of the rows arrives as partial sums."""
    pairs = concepts.groupBy("label", "client_id").agg(F.count("*").alias("n"))
    return (
        pairs.groupBy("label").agg(F.sum("n").alias("mentions"), F.count("*").alias("clients"))
        .orderBy(F.desc("mentions"), "label").limit(k)
    )


def clients_of_concepts(concepts: DataFrame, top: DataFrame) -> DataFrame:
    """The clients behind each top concept in long form: a popular concept may have any number of them."""
    return concepts.join(F.broadcast(top.select("label")), "label", "left_semi").select("label", "client_id").distinct()


def concept_client_counts(clients: DataFrame) -> DataFrame:
    """Explode the concept list of the clients and count."""
    terms = clients.select(F.explode(T.split_terms(F.col("top_concepts"))).alias("concept"))
    return terms.groupBy("concept").agg(F.count("*").alias("client_count"))


def heatmap(concepts: DataFrame, clients: DataFrame, k: int = 8) -> DataFrame:
    """Segment by top-``k`` concept counts in long form, zero-filled."""
    top = [r["label"] for r in top_concepts(concepts, k).collect()]  # k rows
    counts = (
        concepts.where(F.col("label").isin(top)).groupBy("client_id", "label").agg(F.count("*").alias("n"))
        .join(clients.select("client_id", "segment_id"), "client_id")
        .groupBy("segment_id", "label").agg(F.sum("n").alias("n"))
    )
    grid = clients.select("segment_id").distinct().select("segment_id", F.explode(F.lit(top)).alias("label"))
    return grid.join(counts, ["segment_id", "label"], "left").select(
        "segment_id", "label", F.coalesce("n", F.lit(0)).alias("mentions")
    )


def metrics(clients: DataFrame, concepts: DataFrame) -> DataFrame:
    """Clients, segments, concepts, mean concepts per client, share of clients with concepts."""
    per_client = concepts.groupBy("client_id").agg(F.count("*").alias("n"))
    base = clients.agg(F.count("*").alias("clients"), F.count_distinct("segment_id").alias("segments"))
    use = per_client.agg(F.round(F.avg("n"), 1).alias("avg_concepts"), F.count("*").alias("covered"))
    kinds = concepts.agg(F.count_distinct("concept_id").alias("concepts"))
    return one_row(base, use, kinds).select(
        "clients", "segments", "concepts", "avg_concepts", rate(F.col("covered"), F.col("clients")).alias("coverage")
    )


def radar(concepts: DataFrame, clients: DataFrame, keywords: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Keyword dimensions by segment: hits per client, times 200, at most 100, one decimal."""
    table = config.RADAR_KEYWORDS if keywords is None else keywords
    spark = concepts.sparkSession
    rows = [(d, w.lower()) for d, words in table.items() for w in words]
    words = literal_table(spark, rows, "dimension string, word string")
    sizes = clients.groupBy("segment_id").agg(F.count_distinct("client_id").alias("n_clients"))
    hits = (
        concepts.groupBy("client_id", F.lower("label").alias("word")).agg(F.count("*").alias("n"))
        .join(words, "word").join(clients.select("client_id", "segment_id"), "client_id")
        .groupBy("segment_id", "dimension").agg(F.sum("n").alias("hits"))
    )
    grid = sizes.select("segment_id", "n_clients", F.explode(F.lit(list(table))).alias("dimension"))
    score = F.least(F.coalesce("hits", F.lit(0)) / F.greatest("n_clients", F.lit(1)) * 200, F.lit(100.0))
    return grid.join(hits, ["segment_id", "dimension"], "left").select(
        "dimension", "segment_id", F.round(score, 1).alias("score")
    )


def segment_concepts(concepts: DataFrame, clients: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` commonest labels of each segment."""
    counts = (
        concepts.groupBy("client_id", "label").agg(F.count("*").alias("n"))
        .join(clients.select("client_id", "segment_id"), "client_id")
        .groupBy("segment_id", "label").agg(F.sum("n").alias("mentions"))
    )
    return top_per_group(counts, ["segment_id"], [F.desc("mentions"), "label"], k)


def segment_details(concepts: DataFrame, clients: DataFrame, k: int = 3) -> DataFrame:
    top = segment_concepts(concepts, clients, k).groupBy("segment_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda s: s["label"]), "|").alias("top_concepts")
    )
    base = clients.groupBy("segment_id").agg(
        F.count("*").alias("clients"), F.min_by("profile_type", "client_id").alias("profile")
    )
    return base.join(top, "segment_id", "left")



def _is(column: str, *values: str) -> Column:
    return F.col(column).isin(*values)


def activation_metrics(targets: DataFrame) -> DataFrame:
    """One row of totals and rates over all event targets."""
    sold = _is("outcome", "purchased")
    totals = targets.agg(
        F.count("*").alias("total"),
        F.count_if(_is("action_status", "notified", "responded")).alias("notified"),
        F.count_if(_is("action_status", "responded")).alias("responded"),
        F.count_if(sold).alias("purchased"),
        F.count_if(_is("outcome", "visited")).alias("visited"),
        F.round(F.coalesce(F.sum(F.when(sold, F.col("outcome_value"))), F.lit(0.0)), 2).alias("total_revenue"),
    )
    total = F.col("total")
    return totals.select(
        "*", rate(F.col("notified"), total).alias("notification_rate"),
        rate(F.col("responded"), total).alias("response_rate"), rate(F.col("purchased"), total).alias("conversion_rate"),
    )


def _target_sums(targets: DataFrame) -> DataFrame:
    """Per event: the few sums every activation report is made of."""
    sold = _is("outcome", "purchased")
    return targets.groupBy("event_id").agg(
        F.count("*").alias("targets"),
        F.count_if(_is("action_status", "notified", "responded")).alias("notified"),
        F.count_if(sold).alias("purchased"),
        F.count_if(_is("outcome", "visited")).alias("visited"),
        F.coalesce(F.sum(F.when(sold, F.col("outcome_value"))), F.lit(0.0)).alias("revenue"),
    )


def activation_by_channel(targets: DataFrame, calendar: DataFrame) -> DataFrame:
    joined = _target_sums(targets).join(calendar.select("event_id", "channel"), "event_id")
    return joined.groupBy("channel").agg(
        F.sum("targets").alias("targets"), F.sum("purchased").alias("purchases"), F.round(F.sum("revenue"), 2).alias("revenue")
    )


def activation_by_event(targets: DataFrame, calendar: DataFrame) -> DataFrame:
    return calendar.select("event_id", "title", "event_date", "channel").join(_target_sums(targets), "event_id").withColumn(
        "revenue", F.round("revenue", 2)
    )


def kpi_counts(clients: DataFrame, segments: DataFrame, actions: DataFrame, calendar: DataFrame) -> DataFrame:
    """The six headline counts and the completion rate."""
    return one_row(
        live(clients).agg(F.count("*").alias("total_clients")),
        segments.agg(F.count("*").alias("total_segments")),
        actions.agg(F.count("*").alias("total_actions"), F.count_if("is_completed").alias("completed_actions")),
        calendar.agg(F.count("*").alias("total_events"), F.count_if(_is("status", "scheduled", "active")).alias("active_events")),
    ).withColumn("completion_rate", rate(F.col("completed_actions"), F.col("total_actions")))


def count_by(df: DataFrame, column: str, name: str = "cnt") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(name))


def languages(clients: DataFrame) -> DataFrame:
    return live(clients).groupBy(F.coalesce("language", F.lit("Unknown")).alias("language")).agg(F.count("*").alias("cnt"))


def confidence_by_segment(clients: DataFrame) -> DataFrame:
    return live(clients).groupBy("segment_id").agg(F.round(F.avg("confidence"), 3).alias("avg_confidence"), F.count("*").alias("cnt"))


def report_segments(clients: DataFrame, scores: DataFrame, segments: DataFrame) -> DataFrame:
    """Average score and gold and silver counts of each segment."""
    scored = live(clients).join(scores, "client_id", "left").groupBy("segment_id").agg(
        mean_tenths(F.col("overall_score")).alias("avg_score"),
        F.count_if(_is("tier", "gold")).alias("gold"), F.count_if(_is("tier", "silver")).alias("silver"),
    )
    return segments.select("segment_id", "name", "client_count").join(scored, "segment_id", "left").na.fill(0, ["gold", "silver"])


def report_actions(actions: DataFrame) -> DataFrame:
    totals = actions.agg(
        F.count("*").alias("total"), F.count_if("is_completed").alias("completed"),
        F.count_if(_is("priority", "high")).alias("high_priority"),
    )
    return totals.withColumn("completion_rate", rate(F.col("completed"), F.col("total")))


def report_tiers(scores: DataFrame) -> DataFrame:
    return scores.groupBy("tier").agg(F.count("*").alias("clients"), mean_tenths(F.col("overall_score")).alias("avg_score"))


def advisor_workload(advisors: DataFrame, assigned: DataFrame, scores: DataFrame) -> DataFrame:
    """Clients, tiers and mean score of each active advisor; ``assigned`` carries ``advisor_id``."""
    tiers = ("platinum", "gold", "silver", "bronze")
    work = live(assigned).join(scores, "client_id", "left").groupBy("advisor_id").agg(
        F.count("*").alias("total_clients"), *[F.count_if(_is("tier", t)).alias(t) for t in tiers],
        mean_tenths(F.col("overall_score")).alias("avg_score"),
    )
    staff = advisors.where(F.col("is_active") & _is("role", "sales", "manager", "admin"))
    return staff.join(work, "advisor_id", "left").na.fill(0, ["total_clients", *tiers]).drop("is_active")


def unassigned_count(assigned: DataFrame) -> DataFrame:
    return live(assigned).agg(F.count_if(F.col("advisor_id").isNull()).alias("unassigned"))


def score_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count("*").alias("scored"), *[F.count_if(_is("tier", t)).alias(t) for t in ("platinum", "gold", "silver", "bronze")],
        *[mean_tenths(F.col(f"{k}_score")).alias(f"avg_{k}") for k in ("engagement", "value", "overall")],
    )


def action_list(actions: DataFrame, clients: DataFrame) -> DataFrame:
    """All actions by priority, then by confidence of their client."""
    ranked = actions.join(clients.select("client_id", "confidence"), "client_id").withColumn(
        "priority_rank", priority_rank(F.col("priority"))
    )
    return ranked.orderBy("priority_rank", F.desc("confidence"), "action_id")


def action_list_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("priority").agg(F.count("*").alias("actions"), F.count_distinct("client_id").alias("clients"))


def score_page(scores: DataFrame, clients: DataFrame, tier: str | None = None, sort: str = "overall_score",
               limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of scores; only known columns may be sorted on."""
    if sort not in ("overall_score", "engagement_score", "value_score"):
        sort = "overall_score"
    rows = scores if tier is None else scores.where(F.col("tier") == tier)
    joined = rows.join(live(clients).select("client_id", "segment_id", "confidence"), "client_id")
    return joined.orderBy(F.desc(sort), "client_id").offset(offset).limit(limit)


def search_clients(clients: DataFrame, q: str = "", segment: int | None = None, sort: str = "confidence_desc",
                   page: int = 1, size: int = 24) -> DataFrame:
    """Case-insensitive search over id, concepts and text; one page of the sorted hits."""
    rows = clients if segment is None else clients.where(F.col("segment_id") == segment)
    if q:
        needle = F.lit(q.lower())
        rows = rows.where(
            F.contains(F.lower(F.col("client_id").cast("string")), needle)
            | F.exists(T.split_terms(F.col("top_concepts")), lambda c: F.contains(F.lower(c), needle))
            | F.contains(F.lower(F.coalesce("full_text", F.lit(""))), needle)
        )
    orders = {
        "confidence_asc": [F.asc("confidence"), F.asc("client_id")], "id_asc": [F.asc("client_id")],
        "id_desc": [F.desc("client_id")],
    }
    return rows.orderBy(*orders.get(sort, [F.desc("confidence"), F.asc("client_id")])).offset((page - 1) * size).limit(size)


def list_events(calendar: DataFrame, month: int | None = None, year: int | None = None, status: str | None = None) -> DataFrame:
    rules = [(F.month("event_date"), month), (F.year("event_date"), year), (F.col("status"), status)]
    return reduce(lambda df, r: df if r[1] is None else df.where(r[0] == r[1]), rules, calendar).orderBy("event_date", "event_id")


def clients_with_any(clients: DataFrame, concepts: DataFrame, wanted: list[str]) -> DataFrame:
    """Live clients that mention at least one of ``wanted`` (a semi join), with the number they mention."""
    names = [w.strip().lower() for w in wanted]
    hits = concepts.where(F.lower("label").isin(names)).select("client_id", F.lower("label").alias("label")).distinct()
    counted = hits.groupBy("client_id").agg(F.count("*").alias("matched"))
    return live(clients).select("client_id", "segment_id").join(counted, "client_id")


def latest(df: DataFrame, by: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(by)).limit(k)


def last_completed(runs: DataFrame) -> DataFrame:
    """The most recent completed run as one row."""
    done = runs.where(F.col("status") == "completed")
    return done.agg(F.max_by(F.struct(*runs.columns), "completed_at").alias("r")).select("r.*")


def table_counts(named: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.lit(name).alias("table"), F.count("*").alias("rows")) for name, df in named.items()]
    return reduce(DataFrame.unionByName, counts)


def client_export(clients: DataFrame, segments: DataFrame, scores: DataFrame, assigned: DataFrame, advisors: DataFrame,
                  actions: DataFrame, concepts: DataFrame) -> DataFrame:
    """One flat row per live client: segment, score, advisor, number of actions and concepts."""
    n_actions = actions.groupBy("client_id").agg(F.count("*").alias("action_count"))
    n_concepts = concepts.groupBy("client_id").agg(F.count("*").alias("concept_count"))
    return (
        live(clients).join(segments.select("segment_id", F.col("name").alias("segment_name")), "segment_id", "left")
        .join(scores.select("client_id", "overall_score", "tier"), "client_id", "left")
        .join(assigned.select("client_id", "advisor_id"), "client_id", "left")
        .join(advisors.select("advisor_id", "advisor_name"), "advisor_id", "left")
        .join(n_actions, "client_id", "left").join(n_concepts, "client_id", "left")
        .select("client_id", "segment_name", "confidence", "language", "overall_score", "tier", "advisor_name",
                F.coalesce("action_count", F.lit(0)).alias("action_count"),
                F.coalesce("concept_count", F.lit(0)).alias("concept_count"))
    )


def action_export(actions: DataFrame, clients: DataFrame, segments: DataFrame) -> DataFrame:
    return (
        actions.join(live(clients).select("client_id", "segment_id"), "client_id")
        .join(segments.select("segment_id", F.col("name").alias("segment_name")), "segment_id", "left")
        .select("client_id", "action_id", "title", "channel", "priority", "is_completed", "segment_name")
    )


def score_export(scores: DataFrame, clients: DataFrame, segments: DataFrame) -> DataFrame:
    return (
        scores.join(live(clients).select("client_id", "segment_id"), "client_id")
        .join(segments.select("segment_id", F.col("name").alias("segment_name")), "segment_id", "left")
        .select("client_id", "segment_name", "engagement_score", "value_score", "overall_score", "tier")
    )


def dashboard_bundle(parts: dict[str, DataFrame]) -> DataFrame:
    """All aggregates as one JSON document. Every part must already be an aggregate of bounded size."""
    packed = [
        df.agg(F.sort_array(F.collect_list(F.to_json(F.struct(*df.columns)))).alias(name)) for name, df in parts.items()
    ]
    row = one_row(*packed)
    return row.select(F.to_json(F.struct(*parts)).alias("document"))


def predictions_report(predictions: DataFrame) -> DataFrame:
    """Averages, medians, sums and band counts of the three predictions: one pass, and those of the exact median."""
    middle = exact_quantiles(predictions, "predicted_clv", [0.5])[0]
    p, c = F.col("purchase_prob"), F.col("churn_risk")
    return predictions.agg(
        F.count("*").alias("clients"),
        F.round(F.avg(p), 4).alias("avg_purchase"),
        F.count_if(p > 0.7).alias("high_intent"), F.count_if((p > 0.4) & (p <= 0.7)).alias("medium_intent"),
        F.count_if(p <= 0.4).alias("low_intent"),
        F.round(F.avg(c), 4).alias("avg_churn"),
        F.count_if(c > 0.8).alias("critical"), F.count_if((c > 0.6) & (c <= 0.8)).alias("at_risk"),
        F.count_if((c > 0.3) & (c <= 0.6)).alias("monitor"), F.count_if(c <= 0.3).alias("safe"),
        F.round(F.avg("predicted_clv"), 2).alias("avg_clv"), F.round(F.lit(middle).cast("double"), 2).alias("median_clv"),
        F.round(F.sum("predicted_clv"), 2).alias("total_clv"),
    )


def predictions_by_segment(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("value_segment").agg(
        F.count("*").alias("clients"), F.round(F.avg("predicted_clv"), 2).alias("avg_clv")
    )


def prediction_projection(predictions: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The wanted columns that exist; not-a-number becomes null."""
    types = dict(predictions.dtypes)
    return predictions.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if types[c] in ("double", "float") else F.col(c) for c in columns if c in types
    ])
