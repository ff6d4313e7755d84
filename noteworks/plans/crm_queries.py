"""Named queries: dashboards, activation, scores, assignment, state changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteworks.operators import actions as A
from noteworks.operators import dashboard as D
from noteworks.operators import models as M
from noteworks.operators import nested as N
from noteworks.operators import ranking as R
from noteworks.operators import state as S
from noteworks.operators.quantiles import exact_quantiles
from noteworks.plans import tables as t
from noteworks.plans.registry import query
from noteworks.plans.tables import with_tables
from noteworks.session import literal_table

AS_OF = "2025-01-15"
# Radar dimensions over the catalogue words of the sample data.
RADAR = {"Heat": ("hot gear", "hot rod", "hot plate"), "Colour": ("red ring", "blue ring", "red bolt", "blue bolt"),
         "Size": ("large rod", "small rod"), "Absent": ("golf",)}


@query("segment_distribution", with_tables("clients", """
SELECT segment_id, 'Segment ' || segment_id AS name, count(*) AS value,
       array_to_string(string_split(arg_min(coalesce(top_concepts, ''), client_id), '|')[1:3], ' | ') AS profile,
       arg_min(profile_type, client_id) AS full_profile FROM clients GROUP BY segment_id"""))
def segment_distribution(spark, folder):
    return D.segment_distribution(t.clients(spark, folder))


@query("top_concepts", with_tables("client_concepts", """
SELECT label, count(*) AS mentions, count(DISTINCT client_id) AS clients FROM client_concepts
GROUP BY label ORDER BY mentions DESC, label LIMIT 20"""))
def top_concepts(spark, folder):
    return D.top_concepts(t.client_concepts(spark, folder), 20)


@query("clients_of_top_concepts", with_tables("client_concepts", """
SELECT DISTINCT label, client_id FROM client_concepts WHERE label IN (
  SELECT label FROM client_concepts GROUP BY label ORDER BY count(*) DESC, label LIMIT 20)"""))
def clients_of_top_concepts(spark, folder):
    concepts = t.client_concepts(spark, folder)
    return D.clients_of_concepts(concepts, D.top_concepts(concepts, 20))


@query("concept_client_counts", with_tables("clients", """
SELECT concept, count(*) AS client_count FROM (SELECT unnest(string_split(top_concepts, '|')) AS concept FROM clients
  WHERE NOT is_deleted) GROUP BY concept"""))
def concept_client_counts(spark, folder):
    return D.concept_client_counts(D.live(t.clients(spark, folder)))


@query("heatmap", with_tables("client_concepts clients_core", """,
top8 AS (SELECT label FROM client_concepts GROUP BY label ORDER BY count(*) DESC, label LIMIT 8),
grid AS (SELECT segment_id, label FROM (SELECT DISTINCT segment_id FROM clients_core), top8)
SELECT g.segment_id, g.label, count(c.client_id) AS mentions FROM grid g LEFT JOIN (
  SELECT segment_id, label, client_id FROM client_concepts JOIN clients_core USING (client_id)) c
  ON c.segment_id = g.segment_id AND c.label = g.label GROUP BY ALL"""))
def heatmap(spark, folder):
    return D.heatmap(t.client_concepts(spark, folder), t.clients_core(spark, folder))


@query("dashboard_metrics", with_tables("client_concepts clients_core", """
SELECT (SELECT count(*) FROM clients_core) AS clients, (SELECT count(DISTINCT segment_id) FROM clients_core) AS segments,
       (SELECT count(DISTINCT concept_id) FROM client_concepts) AS concepts, round(avg(n), 1) AS avg_concepts,
       round(count(*) / (SELECT count(*) FROM clients_core) * 100, 1) AS coverage
FROM (SELECT client_id, count(*) AS n FROM client_concepts GROUP BY client_id)"""))
def dashboard_metrics(spark, folder):
    return D.metrics(t.clients_core(spark, folder), t.client_concepts(spark, folder))


_RADAR_ROWS = ", ".join(f"('{d}', '{w}')" for d, ws in RADAR.items() for w in ws)


@query("radar", with_tables("client_concepts clients_core", f""",
words(dimension, word) AS (VALUES {_RADAR_ROWS}),
sizes AS (SELECT segment_id, count(DISTINCT client_id) AS n FROM clients_core GROUP BY segment_id),
hits AS (SELECT segment_id, dimension, count(*) AS h FROM client_concepts JOIN words ON lower(label) = word
         JOIN clients_core USING (client_id) GROUP BY ALL)
SELECT d.dimension, s.segment_id, round(least(coalesce(h, 0) / greatest(n, 1) * 200, 100.0), 1) AS score
FROM sizes s CROSS JOIN (SELECT DISTINCT dimension FROM words) d
LEFT JOIN hits ON hits.segment_id = s.segment_id AND hits.dimension = d.dimension"""))
def radar(spark, folder):
    return D.radar(t.client_concepts(spark, folder), t.clients_core(spark, folder), RADAR)


@query("segment_details", with_tables("client_concepts clients_core", """,
counts AS (SELECT segment_id, label, count(*) AS n FROM client_concepts JOIN clients_core USING (client_id) GROUP BY ALL),
top AS (SELECT segment_id, label, row_number() OVER (PARTITION BY segment_id ORDER BY n DESC, label) AS rank FROM counts),
named AS (SELECT segment_id, string_agg(label, '|' ORDER BY rank) AS top_concepts FROM top WHERE rank <= 3 GROUP BY 1)
SELECT segment_id, count(*) AS clients, arg_min(profile_type, client_id) AS profile, any_value(top_concepts) AS top_concepts
FROM clients_core LEFT JOIN named USING (segment_id) GROUP BY segment_id"""))
def segment_details(spark, folder):
    return D.segment_details(t.client_concepts(spark, folder), t.clients_core(spark, folder))


@query("cluster_top_concepts", with_tables("client_concepts clients_core", """,
counts AS (SELECT segment_id, label, count(*) AS mentions FROM client_concepts JOIN clients_core USING (client_id) GROUP BY ALL)
SELECT segment_id, label, mentions, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY mentions DESC, label) AS rank FROM counts) WHERE rank <= 10"""))
def cluster_top_concepts(spark, folder):
    return D.segment_concepts(t.client_concepts(spark, folder), t.clients_core(spark, folder), 10).withColumn(
        "rank", F.col("rank").cast("bigint"))


@query("activation_metrics", with_tables("event_targets", """,
s AS (SELECT count(*) AS total, count(*) FILTER (WHERE action_status IN ('notified', 'responded')) AS notified,
             count(*) FILTER (WHERE action_status = 'responded') AS responded,
             count(*) FILTER (WHERE outcome = 'purchased') AS purchased, count(*) FILTER (WHERE outcome = 'visited') AS visited,
             round(coalesce(sum(outcome_value) FILTER (WHERE outcome = 'purchased'), 0), 2) AS total_revenue FROM event_targets)
SELECT *, round(notified / total * 100, 1) AS notification_rate, round(responded / total * 100, 1) AS response_rate,
       round(purchased / total * 100, 1) AS conversion_rate FROM s"""))
def activation_metrics(spark, folder):
    return D.activation_metrics(t.event_targets(spark, folder))


@query("activation_by_channel", with_tables("event_targets calendar", """
SELECT channel, count(*) AS targets, count(*) FILTER (WHERE outcome = 'purchased') AS purchases,
       round(coalesce(sum(outcome_value) FILTER (WHERE outcome = 'purchased'), 0), 2) AS revenue
FROM event_targets JOIN calendar USING (event_id) GROUP BY channel"""))
def activation_by_channel(spark, folder):
    return D.activation_by_channel(t.event_targets(spark, folder), t.calendar(spark, folder))


@query("activation_by_event", with_tables("event_targets calendar", """
SELECT event_id, title, CAST(event_date AS VARCHAR) AS event_date, channel, count(*) AS targets,
       count(*) FILTER (WHERE action_status IN ('notified', 'responded')) AS notified,
       count(*) FILTER (WHERE outcome = 'purchased') AS purchased, count(*) FILTER (WHERE outcome = 'visited') AS visited,
       round(coalesce(sum(outcome_value) FILTER (WHERE outcome = 'purchased'), 0), 2) AS revenue
FROM event_targets JOIN calendar USING (event_id) GROUP BY event_id, title, event_date, channel"""))
def activation_by_event(spark, folder):
    return D.activation_by_event(t.event_targets(spark, folder), t.calendar(spark, folder)).withColumn(
        "event_date", F.col("event_date").cast("string"))


@query("kpi_counts", with_tables("clients_core segments client_actions calendar", """,
k AS (SELECT (SELECT count(*) FROM clients_core WHERE NOT is_deleted) AS total_clients, (SELECT count(*) FROM segments) AS total_segments,
       (SELECT count(*) FROM client_actions) AS total_actions, (SELECT count(*) FROM client_actions WHERE is_completed) AS completed_actions,
       (SELECT count(*) FROM calendar) AS total_events,
       (SELECT count(*) FROM calendar WHERE status IN ('scheduled', 'active')) AS active_events)
SELECT *, round(completed_actions / total_actions * 100, 1) AS completion_rate FROM k"""))
def kpi_counts(spark, folder):
    return D.kpi_counts(t.clients_core(spark, folder), t.segments(spark, folder), t.client_actions(spark, folder), t.calendar(spark, folder))


@query("kpi_priority", with_tables("client_actions", "SELECT priority, count(*) AS cnt FROM client_actions GROUP BY priority"))
def kpi_priority(spark, folder):
    return D.count_by(t.client_actions(spark, folder), "priority")


@query("kpi_channel", with_tables("client_actions", "SELECT channel, count(*) AS cnt FROM client_actions GROUP BY channel"))
def kpi_channel(spark, folder):
    return D.count_by(t.client_actions(spark, folder), "channel")


@query("kpi_activation", with_tables("event_targets", "SELECT action_status, count(*) AS cnt FROM event_targets GROUP BY action_status"))
def kpi_activation(spark, folder):
    return D.count_by(t.event_targets(spark, folder), "action_status")


@query("kpi_languages", with_tables("clients_core", """
SELECT coalesce(language, 'Unknown') AS language, count(*) AS cnt FROM clients_core WHERE NOT is_deleted GROUP BY 1"""))
def kpi_languages(spark, folder):
    return D.languages(t.clients_core(spark, folder))


@query("kpi_confidence", with_tables("clients_core", """
SELECT segment_id, round(avg(confidence), 3) AS avg_confidence, count(*) AS cnt FROM clients_core WHERE NOT is_deleted GROUP BY 1"""))
def kpi_confidence(spark, folder):
    return D.confidence_by_segment(t.clients_core(spark, folder))


SCORES = f"""
acts AS (SELECT client_id, count(*) AS total_actions, count(*) FILTER (WHERE is_completed) AS completed_actions,
                count(*) FILTER (WHERE priority = 'high') AS high_actions FROM client_actions GROUP BY client_id),
evts AS (SELECT client_id, count(*) AS event_count FROM event_targets GROUP BY client_id),
parts AS (SELECT c.client_id, c.segment_id, CASE WHEN top_concepts IS NULL THEN 0 ELSE len(string_split(top_concepts, '|')) END AS n,
                 coalesce(total_actions, 0) AS ta, coalesce(completed_actions, 0) AS ca, coalesce(high_actions, 0) AS ha,
                 coalesce(event_count, 0) AS ec, date_diff('day', note_date, DATE '{AS_OF}') AS age, coalesce(confidence, 0) AS conf
          FROM clients c LEFT JOIN acts USING (client_id) LEFT JOIN evts USING (client_id) WHERE NOT is_deleted),
comp AS (SELECT client_id, least(n / 8.0::DOUBLE * 100, 100.0::DOUBLE) AS concept_score, least(ta / 10.0::DOUBLE * 100, 100.0::DOUBLE) AS action_score,
                CASE WHEN ta > 0 THEN ca / ta * 100 ELSE 0.0 END AS completion_rate,
                least(ec / 3.0::DOUBLE * 100, 100.0::DOUBLE) AS event_score,
                least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100 - age / 365 * 100)) AS recency_score, conf * 100 AS confidence_pct,
                least(ha / 5.0::DOUBLE * 100, 100.0::DOUBLE) AS priority_score, least(n / 6.0::DOUBLE * 100, 100.0::DOUBLE) AS richness_score FROM parts),
ev AS (SELECT *, concept_score * 0.20::DOUBLE + action_score * 0.20::DOUBLE + completion_rate * 0.25::DOUBLE + event_score * 0.15::DOUBLE
                 + recency_score * 0.20::DOUBLE AS e,
              confidence_pct * 0.40::DOUBLE + priority_score * 0.30::DOUBLE + richness_score * 0.30::DOUBLE AS v FROM comp),
ov AS (SELECT *, e * 0.6::DOUBLE + v * 0.4::DOUBLE AS o FROM ev),
client_scores AS (SELECT client_id, floor(e * 10 + 0.5::DOUBLE) / 10 AS engagement_score, floor(v * 10 + 0.5::DOUBLE) / 10 AS value_score,
                         floor(o * 10 + 0.5::DOUBLE) / 10 AS overall_score,
                         CASE WHEN o >= 80 THEN 'platinum' WHEN o >= 60 THEN 'gold' WHEN o >= 40 THEN 'silver' ELSE 'bronze' END AS tier
                  FROM ov)
"""
_SCORE_TABLES = "clients client_actions event_targets"


def scores(spark, folder):
    return A.client_scores(t.clients(spark, folder), t.client_actions(spark, folder), t.event_targets(spark, folder), AS_OF)


@query("client_scores", with_tables(_SCORE_TABLES, "," + SCORES + """
SELECT client_id, engagement_score, value_score, overall_score, tier FROM client_scores"""))
def client_scores(spark, folder):
    return scores(spark, folder).drop("score_details")


@query("score_summary", with_tables(_SCORE_TABLES, "," + SCORES + """
SELECT count(*) AS scored, count(*) FILTER (WHERE tier = 'platinum') AS platinum, count(*) FILTER (WHERE tier = 'gold') AS gold,
       count(*) FILTER (WHERE tier = 'silver') AS silver, count(*) FILTER (WHERE tier = 'bronze') AS bronze,
       ((2 * sum(CAST(round(engagement_score * 10) AS BIGINT)) + count(engagement_score)) // (2 * count(engagement_score)))::BIGINT / 10 AS avg_engagement, ((2 * sum(CAST(round(value_score * 10) AS BIGINT)) + count(value_score)) // (2 * count(value_score)))::BIGINT / 10 AS avg_value,
       ((2 * sum(CAST(round(overall_score * 10) AS BIGINT)) + count(overall_score)) // (2 * count(overall_score)))::BIGINT / 10 AS avg_overall FROM client_scores"""))
def score_summary(spark, folder):
    return D.score_summary(scores(spark, folder))


@query("score_page", with_tables(_SCORE_TABLES, "," + SCORES + """
SELECT s.client_id, engagement_score, value_score, overall_score, tier, segment_id, confidence FROM client_scores s
JOIN clients c USING (client_id) WHERE NOT is_deleted AND tier = 'silver' ORDER BY overall_score DESC, s.client_id LIMIT 50 OFFSET 20"""))
def score_page(spark, folder):
    page = D.score_page(scores(spark, folder), t.clients_core(spark, folder), "silver", limit=50, offset=20)
    return page.drop("score_details")


@query("report_segments", with_tables(_SCORE_TABLES + " segments", "," + SCORES + """
SELECT g.segment_id, g.name, g.client_count, ((2 * sum(CAST(round(overall_score * 10) AS BIGINT)) + count(overall_score)) // (2 * count(overall_score)))::BIGINT / 10 AS avg_score,
       count(*) FILTER (WHERE tier = 'gold') AS gold, count(*) FILTER (WHERE tier = 'silver') AS silver
FROM segments g LEFT JOIN (SELECT * FROM clients WHERE NOT is_deleted) c ON c.segment_id = g.segment_id
LEFT JOIN client_scores s ON s.client_id = c.client_id GROUP BY ALL"""))
def report_segments(spark, folder):
    return D.report_segments(t.clients_core(spark, folder), scores(spark, folder), t.segments(spark, folder))


@query("report_tiers", with_tables(_SCORE_TABLES, "," + SCORES + """
SELECT tier, count(*) AS clients, ((2 * sum(CAST(round(overall_score * 10) AS BIGINT)) + count(overall_score)) // (2 * count(overall_score)))::BIGINT / 10 AS avg_score FROM client_scores GROUP BY tier"""))
def report_tiers(spark, folder):
    return D.report_tiers(scores(spark, folder))


@query("report_actions", with_tables("client_actions", """
SELECT count(*) AS total, count(*) FILTER (WHERE is_completed) AS completed, count(*) FILTER (WHERE priority = 'high') AS high_priority,
       round(count_if(is_completed) / count(*) * 100, 1) AS completion_rate FROM client_actions"""))
def report_actions(spark, folder):
    return D.report_actions(t.client_actions(spark, folder))


ROUND_ROBIN = """
staff AS (SELECT advisor_id, row_number() OVER (ORDER BY advisor_id) - 1 AS k FROM advisors
          WHERE is_active AND role IN ('sales', 'manager')),
waiting AS (SELECT client_id, row_number() OVER (ORDER BY client_id) - 1 AS i FROM clients_core WHERE NOT is_deleted),
assigned AS (SELECT client_id, advisor_id FROM waiting JOIN staff ON k = i % (SELECT count(*) FROM staff))
"""


def assigned(spark, folder):
    return A.assign_round_robin(D.live(t.clients_core(spark, folder)), t.advisors(spark, folder))


@query("assign_round_robin", with_tables("clients_core advisors", "," + ROUND_ROBIN + "SELECT client_id, advisor_id FROM assigned"))
def assign_round_robin(spark, folder):
    return assigned(spark, folder)


@query("assign_by_segment", with_tables("clients_core advisors", """,
staff AS (SELECT advisor_id, row_number() OVER (ORDER BY advisor_id) - 1 AS k FROM advisors
          WHERE is_active AND role IN ('sales', 'manager')),
coded AS (SELECT client_id, dense_rank() OVER (ORDER BY coalesce(segment_id, 0)) - 1 AS i FROM clients_core WHERE NOT is_deleted)
SELECT client_id, advisor_id FROM coded JOIN staff ON k = i % (SELECT count(*) FROM staff)"""))
def assign_by_segment(spark, folder):
    return A.assign_by_segment(D.live(t.clients_core(spark, folder)), t.advisors(spark, folder))


@query("advisor_workload", with_tables(_SCORE_TABLES + " advisors", "," + SCORES + "," + ROUND_ROBIN + """
SELECT v.advisor_id, v.advisor_name, v.role, count(a.client_id) AS total_clients,
       count(*) FILTER (WHERE tier = 'platinum') AS platinum, count(*) FILTER (WHERE tier = 'gold') AS gold,
       count(*) FILTER (WHERE tier = 'silver') AS silver, count(*) FILTER (WHERE tier = 'bronze') AS bronze,
       ((2 * sum(CAST(round(overall_score * 10) AS BIGINT)) + count(overall_score)) // (2 * count(overall_score)))::BIGINT / 10 AS avg_score
FROM advisors v LEFT JOIN assigned a ON a.advisor_id = v.advisor_id LEFT JOIN client_scores s ON s.client_id = a.client_id
WHERE v.is_active AND role IN ('sales', 'manager', 'admin') GROUP BY ALL"""))
def advisor_workload(spark, folder):
    mine = t.clients_core(spark, folder).join(assigned(spark, folder), "client_id", "left")
    return D.advisor_workload(t.advisors(spark, folder), mine, scores(spark, folder))


@query("unassigned_count", with_tables("clients_core advisors", """
SELECT count(*) AS unassigned FROM clients_core WHERE NOT is_deleted AND confidence < 0.2"""))
def unassigned_count(spark, folder):
    """Clients below a confidence of 0.2 lose their advisor."""
    core = t.clients_core(spark, folder)
    gone = D.live(core).where("confidence < 0.2").select("client_id", F.lit(None).cast("bigint").alias("advisor_id"))
    left = A.reassign(assigned(spark, folder), gone)
    return D.unassigned_count(core.join(left, "client_id", "left"))


@query("action_list_counts", with_tables("client_actions", """
SELECT priority, count(*) AS actions, count(DISTINCT client_id) AS clients FROM client_actions GROUP BY priority"""))
def action_list_counts(spark, folder):
    return D.action_list_counts(t.client_actions(spark, folder))


@query("action_list", with_tables("client_actions clients_core", """
SELECT client_id, action_id, priority, CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END::BIGINT AS priority_rank,
       confidence FROM client_actions JOIN clients_core USING (client_id)"""))
def action_list(spark, folder):
    return D.action_list(t.client_actions(spark, folder), t.clients_core(spark, folder)).select(
        "client_id", "action_id", "priority", F.col("priority_rank").cast("bigint").alias("priority_rank"), "confidence")


@query("search_clients", with_tables("clients", """
SELECT client_id, confidence, segment_id FROM clients
WHERE contains(client_id::VARCHAR, 'hot gear') OR contains(lower(full_text), 'hot gear')
   OR list_contains(list_transform(string_split(top_concepts, '|'), lambda x: contains(lower(x), 'hot gear')), true)
ORDER BY confidence DESC, client_id LIMIT 24 OFFSET 24"""))
def search_clients(spark, folder):
    return D.search_clients(t.clients(spark, folder), "Hot Gear", page=2).select("client_id", "confidence", "segment_id")


@query("list_events", with_tables("calendar", """
SELECT event_id, title, channel, status, CAST(event_date AS VARCHAR) AS event_date FROM calendar
WHERE month(event_date) = 6 AND year(event_date) = 2024"""))
def list_events(spark, folder):
    return D.list_events(t.calendar(spark, folder), 6, 2024).select(
        "event_id", "title", "channel", "status", F.col("event_date").cast("string").alias("event_date"))


@query("clients_with_any_concept", with_tables("client_concepts clients_core", """
SELECT client_id, segment_id, count(DISTINCT label) AS matched FROM client_concepts JOIN clients_core USING (client_id)
WHERE label IN ('red ring', 'old anvil', 'hot rod') AND NOT is_deleted GROUP BY ALL"""))
def clients_with_any_concept(spark, folder):
    return D.clients_with_any(t.clients_core(spark, folder), t.client_concepts(spark, folder), ["Red Ring", "old anvil", "hot rod"])


@query("export_clients", with_tables(_SCORE_TABLES + " segments advisors", "," + SCORES + "," + ROUND_ROBIN + """
SELECT c.client_id, g.name AS segment_name, c.confidence, c.language, overall_score, tier, advisor_name,
       (SELECT count(*) FROM client_actions a WHERE a.client_id = c.client_id) AS action_count,
       (SELECT count(*) FROM client_concepts a WHERE a.client_id = c.client_id) AS concept_count
FROM clients c LEFT JOIN segments g ON g.segment_id = c.segment_id LEFT JOIN client_scores s ON s.client_id = c.client_id
LEFT JOIN assigned x ON x.client_id = c.client_id LEFT JOIN advisors v ON v.advisor_id = x.advisor_id WHERE NOT c.is_deleted"""))
def export_clients(spark, folder):
    return D.client_export(t.clients_core(spark, folder), t.segments(spark, folder), scores(spark, folder), assigned(spark, folder),
                           t.advisors(spark, folder), t.client_actions(spark, folder), t.client_concepts(spark, folder))


@query("export_actions", with_tables("client_actions clients_core segments", """
SELECT client_id, action_id, title, channel, priority, is_completed, name AS segment_name
FROM client_actions JOIN clients_core c USING (client_id) LEFT JOIN segments g ON g.segment_id = c.segment_id WHERE NOT is_deleted"""))
def export_actions(spark, folder):
    return D.action_export(t.client_actions(spark, folder), t.clients_core(spark, folder), t.segments(spark, folder))


@query("export_scores", with_tables(_SCORE_TABLES + " segments", "," + SCORES + """
SELECT s.client_id, name AS segment_name, engagement_score, value_score, overall_score, tier
FROM client_scores s JOIN clients_core c ON c.client_id = s.client_id LEFT JOIN segments g ON g.segment_id = c.segment_id
WHERE NOT c.is_deleted"""))
def export_scores(spark, folder):
    return D.score_export(scores(spark, folder), t.clients_core(spark, folder), t.segments(spark, folder))


@query("table_counts", """
SELECT 'documents' AS "table", count(*) AS rows FROM documents UNION ALL SELECT 'events', count(*) FROM events
UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem""")
def table_counts(spark, folder):
    return D.table_counts({n: t.read(spark, folder, n) for n in ("documents", "events", "orders", "lineitem")})


@query("upload_history", """
SELECT event_id, event_type, value FROM events ORDER BY ts DESC LIMIT 5""")
def upload_history(spark, folder):
    return D.latest(t.read(spark, folder, "events"), "ts", 5).select("event_id", "event_type", "value")


@query("last_completed_run", """
SELECT o_orderkey AS run_id, 'completed' AS status FROM orders WHERE o_orderstatus = 'F'
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1""")
def last_completed_run(spark, folder):
    runs = t.read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"),
        F.struct("o_orderdate", "o_orderkey").alias("completed_at"))
    return D.last_completed(runs).drop("completed_at")


_HITS = """,
want AS (SELECT DISTINCT event_id, lower(trim(c)) AS concept FROM (SELECT event_id, unnest(concepts) AS c FROM calendar)),
have AS (SELECT DISTINCT client_id, lower(trim(c)) AS concept
         FROM (SELECT client_id, unnest(string_split(top_concepts, '|')) AS c FROM clients WHERE NOT is_deleted)),
hits AS (SELECT event_id, client_id, count(*) AS overlap, string_agg(concept, ' | ' ORDER BY concept) AS match_reason
         FROM have JOIN want USING (concept) GROUP BY event_id, client_id)"""


@query("match_event_clients", with_tables("clients calendar", _HITS + """
SELECT event_id, client_id, md5(match_reason) AS reason, round(overlap / max(overlap) OVER (PARTITION BY event_id), 3) AS match_score,
       count(*) OVER (PARTITION BY event_id) AS matched_count FROM hits"""))
def match_event_clients(spark, folder):
    hits = A.match_event_clients(t.calendar(spark, folder), t.clients(spark, folder))
    return hits.withColumn("reason", F.md5("match_reason")).drop("match_reason")


@query("target_updates", with_tables("event_targets", """
SELECT event_id, client_id, arg_max(action_status, change_id) AS action_status, arg_max(outcome, change_id) AS outcome,
       arg_max(outcome_value, change_id) AS outcome_value,
       CAST(epoch_us(max(ts) FILTER (WHERE action_status = 'notified')) AS BIGINT) AS notified_us,
       CAST(epoch_us(max(ts) FILTER (WHERE action_status = 'responded')) AS BIGINT) AS responded_us
FROM event_targets GROUP BY event_id, client_id"""))
def target_updates(spark, folder):
    state = A.apply_target_updates(t.event_targets(spark, folder))
    return state.select("event_id", "client_id", "action_status", "outcome", "outcome_value",
                        F.unix_micros(F.col("notified_at").cast("timestamp")).alias("notified_us"),
                        F.unix_micros(F.col("responded_at").cast("timestamp")).alias("responded_us"))


@query("notified_counts", with_tables("event_targets", """,
s AS (SELECT event_id, client_id, arg_max(action_status, change_id) AS st FROM event_targets GROUP BY ALL)
SELECT event_id, count(*) FILTER (WHERE st IN ('notified', 'responded')) AS notified_count FROM s GROUP BY event_id"""))
def notified_counts(spark, folder):
    return A.notified_counts(A.apply_target_updates(t.event_targets(spark, folder)))


@query("event_detail", with_tables("event_targets clients calendar", """,
s AS (SELECT event_id, client_id, arg_max(action_status, change_id) AS action_status FROM event_targets GROUP BY ALL)
SELECT event_id, title, client_id, action_status, segment_id, confidence FROM s JOIN calendar USING (event_id)
JOIN clients USING (client_id) WHERE NOT is_deleted"""))
def event_detail(spark, folder):
    state = A.apply_target_updates(t.event_targets(spark, folder)).select("event_id", "client_id", "action_status")
    return state.join(t.calendar(spark, folder).select("event_id", "title"), "event_id").join(
        D.live(t.clients_core(spark, folder)).select("client_id", "segment_id", "confidence"), "client_id")


@query("activate_playbook", """
SELECT p_partkey AS event_id, p_name AS title, p_type AS channel, '2025-01-29' AS event_date, 'scheduled' AS status FROM part""")
def activate_playbook(spark, folder):
    templates = t.read(spark, folder, "part").select(
        F.col("p_partkey").alias("template_id"), F.col("p_name").alias("title"), F.col("p_type").alias("channel"),
        F.array("p_name").alias("concepts"), F.lit(None).cast("date").alias("event_date"))
    return A.activate_playbook(templates, AS_OF).drop("concepts").withColumn("event_date", F.col("event_date").cast("string"))


@query("activate_and_match", with_tables("clients calendar", _HITS + """
SELECT event_id, title, '2025-01-29' AS event_date, 'scheduled' AS status, client_id,
       round(overlap / max(overlap) OVER (PARTITION BY event_id), 3) AS match_score FROM hits JOIN calendar USING (event_id)"""))
def activate_and_match(spark, folder):
    """The calendar's concepts as playbooks, all activated at once."""
    templates = t.calendar(spark, folder).select(
        F.col("event_id").alias("template_id"), "title", "channel", "concepts", F.lit(None).cast("date").alias("event_date"))
    events, targets = A.activate_and_match(templates, t.clients(spark, folder), AS_OF)
    rows = events.select("event_id", "title", F.col("event_date").cast("string").alias("event_date"), "status")
    return rows.join(targets.drop("match_reason"), "event_id")


@query("event_detail_ranked", with_tables("event_targets clients calendar", _HITS + """,
s AS (SELECT event_id, client_id, arg_max(action_status, change_id) AS action_status, arg_max(outcome, change_id) AS outcome,
       arg_max(outcome_value, change_id) AS outcome_value FROM event_targets GROUP BY ALL),
m AS (SELECT event_id, client_id, round(overlap / max(overlap) OVER (PARTITION BY event_id), 3) AS match_score FROM hits)
SELECT event_id, title, status, client_id, match_score, segment_id, profile_type, confidence, coalesce(action_status, 'pending') AS action_status,
       coalesce(outcome, 'none') AS outcome, outcome_value
FROM m JOIN calendar USING (event_id) JOIN clients USING (client_id) LEFT JOIN s USING (event_id, client_id)"""))
def event_detail_ranked(spark, folder):
    calendar, clients = t.calendar(spark, folder), t.clients(spark, folder)
    state = A.apply_target_updates(t.event_targets(spark, folder))
    return A.event_detail(calendar, A.match_event_clients(calendar, clients), state, clients).drop("match_reason")


# ---- recommended actions ---------------------------------------------------------------------------

PLAYBOOK = [
    ("P1", "Large pieces", "Event", "High", "visits", ["large", "promo"], ["large rod", "customer#00000", "hot"], 0.5, "Invite to a viewing"),
    ("P2", "Small gifts", "CRM", "Medium", "sales", ["small", "economy"], ["small ring", "widget"], 0.2, "Offer a gift"),
    ("P3", "Follow up", "Email", "Low", "answers", ["standard"], ["anvil", "machinery"], 0.0, "Write a note"),
]


def _profiles(spark, folder):
    return D.live(t.clients(spark, folder)).select(
        "client_id", "profile_type", "top_concepts", "confidence", F.col("full_text").alias("text"))


_PLAYS = ", ".join(
    f"('{p[0]}', '{p[3]}', {p[5]!r}, {p[6]!r}, {p[7]}, {('High', 'Medium', 'Low').index(p[3])})" for p in PLAYBOOK)


@query("recommend_actions", with_tables("clients", f""",
plays(action_id, priority, buckets, keywords, min_confidence, pr) AS (VALUES {_PLAYS}),
ev AS (SELECT client_id, list(DISTINCT bucket) AS cb FROM client_concepts GROUP BY client_id),
al AS (SELECT client_id, sum(CASE WHEN contains(lower(full_text), lower(matched_alias)) THEN 0.5 ELSE 0.0 END) AS als
       FROM client_concepts JOIN clients USING (client_id) GROUP BY client_id),
base AS (SELECT c.client_id, p.action_id, p.priority, p.pr,
   len(list_intersect(coalesce(cb, []), p.buckets)) AS nb,
   len(list_filter(p.keywords, lambda k: contains(lower(concat_ws(' ', coalesce(profile_type, ''), coalesce(top_concepts, ''), full_text)), lower(k)))) AS nk,
   coalesce(als, 0) AS als
   FROM clients c CROSS JOIN plays p LEFT JOIN ev ON ev.client_id = c.client_id LEFT JOIN al ON al.client_id = c.client_id
   WHERE NOT is_deleted AND confidence >= min_confidence)
SELECT client_id, action_id, priority, CAST(2 * nb + nk + als AS DOUBLE) AS score,
       row_number() OVER (PARTITION BY client_id ORDER BY pr, 2 * nb + nk + als DESC, action_id) AS rank
FROM base WHERE 2 * nb + nk + als > 0"""))
def recommend_actions(spark, folder):
    found = A.recommend_actions(_profiles(spark, folder), t.client_concepts(spark, folder), PLAYBOOK)
    return found.select("client_id", "action_id", "priority", "score", F.col("rank").cast("bigint").alias("rank"))


@query("recommend_actions_on_notes")
def recommend_actions_on_notes(spark, folder):
    """Rationales over whole notes: rows only, the wording is checked in the tests."""
    from noteworks.plans.text_queries import _matches

    lexicon = t.lexicon(spark).select("concept_id", "bucket").dropDuplicates(["concept_id"])
    concepts = _matches(spark, folder).join(lexicon, "concept_id")
    profiles = A.client_texts(t.notes(spark, folder)).select(
        "client_id", F.lit("General").alias("profile_type"), F.lit("").alias("top_concepts"), F.lit(1.0).alias("confidence"), "text")
    return A.recommend_actions(profiles, concepts)


# ---- ranking ---------------------------------------------------------------------------------------


@query("value_segment_quartiles", with_tables("client_actions", """,
v AS (SELECT client_id, round(sum(amount), 2) AS clv FROM client_actions GROUP BY client_id),
q AS (SELECT quantile_cont(clv, 0.25) AS a, quantile_cont(clv, 0.5) AS b, quantile_cont(clv, 0.75) AS c FROM v)
SELECT client_id, clv, CASE WHEN clv <= a THEN 'Bronze' WHEN clv <= b THEN 'Silver' WHEN clv <= c THEN 'Gold' ELSE 'Platinum' END
       AS value_segment FROM v, q"""))
def value_segment_quartiles(spark, folder):
    clv = t.client_actions(spark, folder).groupBy("client_id").agg(F.round(F.sum("amount"), 2).alias("clv"))
    return R.quartile_segment(clv, "clv")


@query("value_and_risk_bands", with_tables("client_actions", """,
v AS (SELECT client_id, round(sum(amount), 2) AS clv, count_if(is_completed) / count(*) AS risk FROM client_actions GROUP BY client_id)
SELECT client_id, CASE WHEN clv <= 3000 THEN 'Low Value' WHEN clv <= 7000 THEN 'Medium Value' WHEN clv <= 15000 THEN 'High Value' ELSE 'VIP' END AS value_segment,
       CASE WHEN risk <= 0.3 THEN 'Safe' WHEN risk <= 0.6 THEN 'Monitor' WHEN risk <= 0.8 THEN 'At Risk' ELSE 'Critical' END AS risk_segment,
       CASE WHEN risk <= 0 THEN NULL WHEN risk <= 0.3 THEN 'Low' WHEN risk <= 0.7 THEN 'Medium' ELSE 'High' END AS risk_level FROM v"""))
def value_and_risk_bands(spark, folder):
    from noteworks.functions import rules

    v = t.client_actions(spark, folder).groupBy("client_id").agg(
        F.round(F.sum("amount"), 2).alias("clv"), (F.count_if("is_completed") / F.count("*")).alias("risk"))
    return v.select("client_id", rules.cut_value_segment(F.col("clv")).alias("value_segment"),
                    rules.cut_risk_segment(F.col("risk")).alias("risk_segment"), rules.cut_risk_level(F.col("risk")).alias("risk_level"))


@query("normalized_scores", with_tables("client_actions", """,
v AS (SELECT channel, client_id, count(*) AS n FROM client_actions GROUP BY ALL)
SELECT channel, client_id, round(n / max(n) OVER (PARTITION BY channel), 3) AS share FROM v"""))
def normalized_scores(spark, folder):
    n = t.client_actions(spark, folder).groupBy("channel", "client_id").agg(F.count("*").alias("n"))
    return R.normalize_by_max(n, ["channel"], "n", "share").drop("n")


@query("ranked_client_actions", with_tables("client_actions", """
SELECT client_id, action_id, rank FROM (SELECT client_id, action_id, row_number() OVER (PARTITION BY client_id
  ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, amount DESC, action_id) AS rank FROM client_actions)
WHERE rank <= 3"""))
def ranked_client_actions(spark, folder):
    from noteworks.functions.rules import priority_rank

    acts = t.client_actions(spark, folder).withColumn("p", priority_rank(F.col("priority")))
    return R.top_per_group(acts, ["client_id"], ["p", F.desc("amount"), "action_id"], 3).select(
        "client_id", "action_id", F.col("rank").cast("bigint").alias("rank"))


@query("first_seen_labels", with_tables("client_concepts", """
SELECT client_id, label, note_id, span_start FROM (SELECT *, row_number() OVER (PARTITION BY client_id, label
  ORDER BY note_id, span_start) AS rn FROM client_concepts) WHERE rn = 1"""))
def first_seen_labels(spark, folder):
    c = t.client_concepts(spark, folder).select("client_id", "label", "note_id", "span_start")
    return R.first_per_group(c, ["client_id", "label"], F.struct("note_id", "span_start"))


@query("global_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS idx FROM orders")
def global_index(spark, folder):
    orders = t.read(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return R.global_index(orders, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "idx")


# ---- state -----------------------------------------------------------------------------------------


def _delta(spark, folder):
    """Incoming clients: every supplier becomes a client again, under the next free ids for some."""
    return t.read(spark, folder, "supplier").select(
        (F.col("s_suppkey") * 20).alias("client_id"), F.lit(4).alias("segment_id"), F.lit("Machinery").alias("profile_type"),
        (F.floor((F.col("s_acctbal") + 1000) / 11000 * 10000) / 10000).alias("confidence"),
        F.when(F.col("s_nationkey") < 12, "DE").alias("language"), F.lit(None).cast("date").alias("note_date"),
        F.col("s_name").alias("full_text"))


_UPSERT = """,
delta AS (SELECT s_suppkey * 20 AS client_id, 4 AS segment_id, 'Machinery' AS profile_type,
                 floor((s_acctbal + 1000) / 11000 * 10000) / 10000 AS confidence, CASE WHEN s_nationkey < 12 THEN 'DE' END AS language,
                 CAST(NULL AS DATE) AS note_date, s_name AS full_text FROM supplier),
snapshot AS (SELECT coalesce(d.client_id, b.client_id) AS client_id,
       CASE WHEN d.client_id IS NULL THEN b.segment_id ELSE d.segment_id END AS segment_id,
       CASE WHEN d.client_id IS NULL THEN b.confidence ELSE d.confidence END AS confidence,
       coalesce(d.language, b.language) AS language, coalesce(d.note_date, b.note_date) AS note_date,
       coalesce(d.full_text, b.full_text) AS full_text,
       CASE WHEN d.client_id IS NULL THEN b.is_deleted ELSE false END AS is_deleted,
       CASE WHEN d.client_id IS NULL THEN 'kept' WHEN b.client_id IS NULL THEN 'new' ELSE 'updated' END AS change
FROM clients_core b FULL JOIN delta d ON b.client_id = d.client_id)
"""


@query("upsert_clients", with_tables("clients_core", _UPSERT + """
SELECT client_id, CAST(segment_id AS BIGINT) AS segment_id, confidence, language, CAST(note_date AS VARCHAR) AS note_date,
       full_text, is_deleted, change FROM snapshot"""))
def upsert_clients(spark, folder):
    done = S.upsert_clients(t.clients_core(spark, folder), _delta(spark, folder), "change")
    return done.drop("profile_type").withColumn("note_date", F.col("note_date").cast("string")).withColumn(
        "segment_id", F.col("segment_id").cast("bigint"))


@query("upsert_counts", with_tables("clients_core", _UPSERT + "SELECT change, count(*) AS clients FROM snapshot GROUP BY change"))
def upsert_counts(spark, folder):
    done = S.upsert_clients(t.clients_core(spark, folder), _delta(spark, folder), "change")
    return done.groupBy("change").agg(F.count("*").alias("clients"))


@query("incremental_diff", """
SELECT d.doc_id AS note_id, CASE WHEN p.page_id IS NULL THEN 'new' WHEN md5(p.html) = md5(d.text) THEN 'unchanged' ELSE 'changed' END AS state
FROM documents d LEFT JOIN (SELECT page_id, CASE WHEN length(html) > 3000 THEN html ELSE text END AS html FROM pages
     JOIN documents ON doc_id = page_id) p ON p.page_id = d.doc_id""")
def incremental_diff(spark, folder):
    """The stored notes are those with a page of the same number; a long page has replaced its text."""
    docs = t.read(spark, folder, "documents").select(F.col("doc_id").alias("note_id"), "text")
    pages = t.read(spark, folder, "pages").select(F.col("page_id").alias("note_id"), "html")
    stored = docs.join(pages, "note_id").select(
        "note_id", F.when(F.length("html") > 3000, F.col("html")).otherwise(F.col("text")).alias("text"))
    return S.incremental_diff(stored, docs)


@query("replace_concepts", with_tables("client_concepts", """,
fresh AS (SELECT DISTINCT o_custkey AS client_id, 'C_new' AS concept_id, 0 AS span_start FROM orders WHERE o_orderstatus = 'P')
SELECT client_id, concept_id, CAST(span_start AS BIGINT) AS span_start FROM client_concepts WHERE client_id NOT IN (SELECT client_id FROM fresh)
UNION ALL SELECT client_id, concept_id, span_start FROM fresh"""))
def replace_concepts(spark, folder):
    base = t.client_concepts(spark, folder).select("client_id", "concept_id", F.col("span_start").cast("bigint").alias("span_start"))
    fresh = t.read(spark, folder, "orders").where("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("client_id"), F.lit("C_new").alias("concept_id"), F.lit(0).cast("bigint").alias("span_start"))
    return S.replace_children(base, fresh, fresh, unique=["client_id", "concept_id", "span_start"])


@query("replace_open_actions", with_tables("client_actions", """,
done AS (SELECT s_suppkey AS client_id FROM supplier)
SELECT client_id, action_id FROM client_actions WHERE is_completed OR client_id NOT IN (SELECT client_id FROM done)
UNION ALL SELECT client_id, -1 FROM done"""))
def replace_open_actions(spark, folder):
    base = t.client_actions(spark, folder).select("client_id", "action_id", "is_completed")
    done = t.read(spark, folder, "supplier").select(F.col("s_suppkey").alias("client_id"))
    fresh = done.select("client_id", F.lit(-1).cast("bigint").alias("action_id"), F.lit(False).alias("is_completed"))
    return S.replace_children(base, fresh, done, protect=F.col("is_completed")).drop("is_completed")


def _registry(spark, folder):
    return {"clients": t.clients_core(spark, folder), "client_concepts": t.client_concepts(spark, folder),
            "client_actions": t.client_actions(spark, folder), "event_targets": t.event_targets(spark, folder)}


def _leavers(spark, folder):
    return t.clients_core(spark, folder).where("is_deleted").select("client_id")


@query("gdpr_erase_counts", with_tables("clients_core client_concepts client_actions event_targets", """,
gone AS (SELECT client_id FROM clients_core WHERE is_deleted),
every AS (SELECT 'clients' AS "table", client_id FROM clients_core UNION ALL SELECT 'client_concepts', client_id FROM client_concepts
          UNION ALL SELECT 'client_actions', client_id FROM client_actions UNION ALL SELECT 'event_targets', client_id FROM event_targets)
SELECT "table", count(*) FILTER (WHERE client_id IN (SELECT client_id FROM gone)) AS erased,
       count(*) FILTER (WHERE client_id NOT IN (SELECT client_id FROM gone)) AS kept FROM every GROUP BY "table" """))
def gdpr_erase_counts(spark, folder):
    return S.erase_counts(_registry(spark, folder), _leavers(spark, folder))


@query("gdpr_erase_actions", with_tables("clients_core client_actions", """
SELECT client_id, action_id FROM client_actions WHERE client_id NOT IN (SELECT client_id FROM clients_core WHERE is_deleted)"""))
def gdpr_erase_actions(spark, folder):
    return S.erase(_registry(spark, folder), _leavers(spark, folder))["client_actions"].select("client_id", "action_id")


@query("soft_delete", with_tables("clients_core", """
SELECT client_id, is_deleted OR client_id IN (SELECT s_suppkey FROM supplier) AS is_deleted FROM clients_core"""))
def soft_delete(spark, folder):
    ids = t.read(spark, folder, "supplier").select(F.col("s_suppkey").alias("client_id"))
    return S.soft_delete(t.clients_core(spark, folder), ids).select("client_id", "is_deleted")


@query("gdpr_export", with_tables("clients_core client_actions event_targets", """,
gone AS (SELECT client_id FROM clients_core WHERE is_deleted)
SELECT client_id, 'client_actions' AS section, '{"action_id":' || action_id || ',"channel":"' || channel || '","client_id":' || client_id
  || ',"priority":"' || priority || '"}' AS record FROM client_actions WHERE client_id IN (SELECT client_id FROM gone)
UNION ALL SELECT client_id, 'event_targets', '{"action_status":"' || action_status || '","client_id":' || client_id || ',"event_id":' || event_id
  || '}' FROM event_targets WHERE client_id IN (SELECT client_id FROM gone)"""))
def gdpr_export(spark, folder):
    parts = {"client_actions": t.client_actions(spark, folder).select("client_id", "action_id", "channel", "priority"),
             "event_targets": t.event_targets(spark, folder).select("client_id", "event_id", "action_status")}
    return S.export_documents(parts, _leavers(spark, folder))


@query("similar_in_segment", with_tables("clients_core", """,
alive AS (SELECT client_id, segment_id, confidence FROM clients_core WHERE NOT is_deleted),
ranked AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY confidence DESC, client_id) AS place FROM alive),
pairs AS (SELECT a.client_id, b.client_id AS similar_id, b.confidence AS similar_confidence,
                 row_number() OVER (PARTITION BY a.client_id ORDER BY b.place) AS rank
          FROM alive a JOIN ranked b ON a.segment_id = b.segment_id AND a.client_id <> b.client_id AND b.place <= 6)
SELECT client_id, rank, similar_id, similar_confidence FROM pairs WHERE rank <= 5"""))
def similar_in_segment(spark, folder):
    return S.similar_in_segment(t.clients_core(spark, folder)).withColumn("rank", F.col("rank").cast("bigint"))


def _client_sections(spark, folder):
    core, acts, targets = t.clients_core(spark, folder), t.client_actions(spark, folder), t.event_targets(spark, folder)
    from noteworks.functions.rules import priority_rank

    state = A.apply_target_updates(targets).select("client_id", "event_id", "action_status")
    return {
        "core": core.where("NOT is_deleted").select("client_id", "segment_id", "profile_type", F.lit(0).alias("position")),
        "concepts": t.client_concepts(spark, folder).select("client_id", "label", "span_start", F.col("note_id").alias("position")),
        "actions": acts.select("client_id", "action_id", "title", priority_rank(F.col("priority")).alias("position")),
        "events": state.select("client_id", "event_id", "action_status", F.col("event_id").alias("position")),
        "similar": S.similar_in_segment(core).select("client_id", "similar_id", F.col("rank").alias("position")),
        "timeline": S.timeline(targets).select("client_id", "change_id", "action_status", "position"),
        "score": scores(spark, folder).select("client_id", "overall_score", "tier", F.lit(0).alias("position")),
    }


@query("client_360", with_tables(_SCORE_TABLES, "," + SCORES + """,
line AS (SELECT client_id, change_id, row_number() OVER (PARTITION BY client_id ORDER BY ts DESC, change_id DESC) AS rn FROM event_targets),
alive AS (SELECT client_id, segment_id FROM clients_core WHERE NOT is_deleted),
every AS (SELECT client_id, 'core' AS section FROM alive
  UNION ALL SELECT client_id, 'concepts' FROM client_concepts UNION ALL SELECT client_id, 'actions' FROM client_actions
  UNION ALL SELECT DISTINCT ON (event_id, client_id) client_id, 'events' FROM event_targets
  UNION ALL SELECT client_id, 'timeline' FROM line WHERE rn <= 20 UNION ALL SELECT client_id, 'score' FROM client_scores
  UNION ALL SELECT client_id, 'similar' FROM (SELECT a.client_id, unnest(range(least(5, n - 1))) FROM alive a
            JOIN (SELECT segment_id, count(*) AS n FROM alive GROUP BY 1) USING (segment_id)))
SELECT client_id, section, count(*) AS records FROM every GROUP BY client_id, section"""))
def client_360(spark, folder):
    """Number of records in each section of every client's view."""
    return S.client_360(_client_sections(spark, folder)).groupBy("client_id", "section").agg(F.count("*").alias("records"))


@query("client_core", with_tables("clients_core segments advisors", "," + ROUND_ROBIN + """
SELECT c.client_id, g.name AS segment_name, g.client_count AS segment_size, u.advisor_name AS created_by_name, v.advisor_name
FROM clients_core c LEFT JOIN segments g ON g.segment_id = c.segment_id LEFT JOIN assigned x ON x.client_id = c.client_id
LEFT JOIN advisors u ON u.advisor_id = x.advisor_id + 1 LEFT JOIN advisors v ON v.advisor_id = x.advisor_id WHERE NOT c.is_deleted"""))
def client_core(spark, folder):
    owners = assigned(spark, folder).withColumn("created_by", F.col("advisor_id") + 1)
    return S.client_core(t.clients_core(spark, folder), t.segments(spark, folder), owners, t.advisors(spark, folder)).select(
        "client_id", "segment_name", "segment_size", "created_by_name", "advisor_name")


@query("audit_log_rows", """
SELECT event_id AS target_id, event_type AS action, '{"user_id":' || user_id || ',"props":' || to_json(props) || '}' AS details FROM events""")
def audit_log_rows(spark, folder):
    entries = t.read(spark, folder, "events").select(
        F.col("event_id").alias("target_id"), F.col("event_type").alias("action"), "user_id", "props", "ts")
    return S.log_rows(entries, ["user_id", "props"], F.col("ts")).select("target_id", "action", "details")


@query("dashboard_bundle")
def dashboard_bundle(spark, folder):
    concepts, core = t.client_concepts(spark, folder), t.clients_core(spark, folder)
    return D.dashboard_bundle({
        "segments": D.segment_distribution(t.clients(spark, folder)), "concepts": D.top_concepts(concepts, 12),
        "heatmap": D.heatmap(concepts, core), "metrics": D.metrics(core, concepts), "radar": D.radar(concepts, core, RADAR),
        "details": D.segment_details(concepts, core)})


_FRESH = """,
changed AS (SELECT CAST(n_nationkey AS BIGINT) AS event_id, 'changed' AS status, (SELECT list(DISTINCT p_name) FROM part WHERE contains(p_name, 'red')) AS concepts
            FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 100 + r_regionkey, 'new', ['hot rod', 'old ring'] FROM region),
next AS (SELECT coalesce(h.event_id, c.event_id) AS event_id, c.title, coalesce(h.status, c.status) AS status, coalesce(h.concepts, c.concepts) AS concepts
         FROM calendar c FULL JOIN changed h ON h.event_id = c.event_id)
"""


def _changes(spark, folder):
    """The events of one region turn to red things; every region gets a new event."""
    red = [r["p_name"] for r in t.read(spark, folder, "part").where(F.contains("p_name", F.lit("red"))).select("p_name").distinct().orderBy("p_name").collect()]
    old = t.read(spark, folder, "nation").where("n_regionkey = 2").select(
        F.col("n_nationkey").cast("bigint").alias("event_id"), F.lit("changed").alias("status"), F.lit(red).alias("concepts"))
    new = t.read(spark, folder, "region").select(
        (F.col("r_regionkey") + 100).cast("bigint").alias("event_id"), F.lit("new").alias("status"), F.lit(["hot rod", "old ring"]).alias("concepts"))
    return old.unionByName(new)


def _updated(spark, folder):
    calendar, clients = t.calendar(spark, folder), t.clients(spark, folder)
    targets = A.match_event_clients(calendar, clients)
    return A.update_events(calendar, _changes(spark, folder), clients, targets)


@query("update_events", with_tables("calendar", _FRESH + "SELECT event_id, title, status, CAST(len(concepts) AS BIGINT) AS n FROM next"))
def update_events(spark, folder):
    return _updated(spark, folder)[0].select("event_id", "title", "status", F.size("concepts").cast("bigint").alias("n"))


@query("rematch_events", with_tables("clients calendar", _FRESH + """,
want AS (SELECT DISTINCT event_id, unnest(concepts) AS concept FROM next),
have AS (SELECT DISTINCT client_id, unnest(string_split(top_concepts, '|')) AS concept FROM clients WHERE NOT is_deleted),
hits AS (SELECT event_id, client_id, count(*) AS overlap FROM have JOIN want USING (concept) GROUP BY event_id, client_id)
SELECT event_id, client_id, round(overlap / max(overlap) OVER (PARTITION BY event_id), 3) AS match_score FROM hits"""))
def rematch_events(spark, folder):
    return _updated(spark, folder)[1].select("event_id", "client_id", "match_score")


@query("complete_actions", with_tables("client_actions", """,
done AS (SELECT l_orderkey AS action_id, min(CAST(l_shipdate AS DATE)) AS closed_on FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT client_id, a.action_id, is_completed OR d.action_id IS NOT NULL AS is_completed, CAST(closed_on AS VARCHAR) AS completed_at
FROM client_actions a LEFT JOIN done d ON d.action_id = a.action_id"""))
def complete_actions(spark, folder):
    """A returned line closes the action of its order."""
    acts = t.client_actions(spark, folder).select("client_id", "action_id", "is_completed")
    lines = t.read(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("action_id"), F.to_date("l_shipdate").alias("completed_at"))
    log = lines.join(acts.select("client_id", "action_id"), "action_id")
    return A.complete_actions(acts, log).withColumn("completed_at", F.col("completed_at").cast("string"))


@query("prediction_projection", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END AS root FROM customer")
def prediction_projection(spark, folder):
    rows = t.read(spark, folder, "customer").withColumn("root", F.sqrt("c_acctbal"))
    return D.prediction_projection(rows, ("c_custkey", "root", "missing"))


_PAGE = 20


@query("list_clients_nested", with_tables("clients client_actions", f""",
shown AS (SELECT * FROM clients WHERE NOT is_deleted),
c AS (SELECT client_id, label || '~' || span_start AS item, row_number() OVER (PARTITION BY client_id ORDER BY note_id, span_start, label, matched_alias) - 1 AS pos FROM client_concepts),
a AS (SELECT client_id, action_id || '~' || priority || '~' || is_completed AS item, row_number() OVER (PARTITION BY client_id
        ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, created_on, action_id) - 1 AS pos FROM client_actions),
cp AS (SELECT client_id, pos // {_PAGE} AS page, string_agg(item, '|' ORDER BY pos) AS items FROM c GROUP BY ALL),
ap AS (SELECT client_id, pos // {_PAGE} AS page, string_agg(item, '|' ORDER BY pos) AS items FROM a GROUP BY ALL),
pages AS (SELECT client_id, page FROM cp UNION SELECT client_id, page FROM ap UNION SELECT client_id, 0 FROM shown)
SELECT client_id, page, coalesce(language, 'FR') AS language, CASE WHEN top_concepts IS NULL THEN 0 ELSE len(string_split(top_concepts, '|')) END AS n_top,
       (SELECT count(*) FROM c WHERE c.client_id = shown.client_id) AS n_concepts, (SELECT count(*) FROM a WHERE a.client_id = shown.client_id) AS n_actions,
       coalesce(cp.items, '') AS concepts, coalesce(ap.items, '') AS actions
FROM shown JOIN pages USING (client_id) LEFT JOIN cp USING (client_id, page) LEFT JOIN ap USING (client_id, page)"""))
def list_clients_nested(spark, folder):
    """Clients with their concepts and actions inside, twenty of each a row."""
    listed = N.list_clients(t.clients(spark, folder), t.client_concepts(spark, folder), t.client_actions(spark, folder), page=_PAGE)
    concepts = F.transform("concepts", lambda c: F.concat_ws("~", c["concept"], c["span_start"]))
    actions = F.transform("actions", lambda a: F.concat_ws("~", a["action_id"], a["priority"], a["is_completed"]))
    return listed.select("client_id", "page", "language", F.size("top_concepts").cast("bigint").alias("n_top"), "n_concepts", "n_actions",
                         F.array_join(concepts, "|").alias("concepts"), F.array_join(actions, "|").alias("actions"))


@query("stratified_split", with_tables("clients_core", "SELECT profile_type AS label, count(*) - CAST(round(count(*) * 0.2) AS BIGINT) AS train, CAST(round(count(*) * 0.2) AS BIGINT) AS test FROM clients_core GROUP BY 1"))
def stratified_split(spark, folder):
    train, test = M.split(t.clients_core(spark, folder), label="profile_type")
    both = train.withColumn("test", F.lit(0)).unionByName(test.withColumn("test", F.lit(1)))
    return both.groupBy(F.col("profile_type").alias("label")).agg(F.count_if(F.col("test") == 0).alias("train"), F.count_if(F.col("test") == 1).alias("test"))


@query("order_value_quantiles", """
SELECT quantile_cont(o_totalprice, 0.01) AS p01, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.999) AS p999 FROM orders""")
def order_value_quantiles(spark, folder):
    low, middle, high = exact_quantiles(t.read(spark, folder, "orders"), "o_totalprice", [0.01, 0.5, 0.999])
    return literal_table(spark, [(low, middle, high)], "p01 double, p50 double, p999 double")
