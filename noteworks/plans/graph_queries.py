"""Named queries: knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteworks.operators import dashboard as D
from noteworks.operators import graph as G
from noteworks.operators import ranking as R
from noteworks.functions.rules import priority_rank
from noteworks.plans import tables as t
from noteworks.plans.registry import query
from noteworks.plans.tables import with_tables

_GRAPH = """,
lex AS (SELECT 'C_' || replace(p_name, ' ', '_') AS concept_id, p_name AS label, count(*) AS freq_notes,
        CASE WHEN contains(p_name, 'red') THEN 'preferences' WHEN contains(p_name, 'hot') THEN 'lifestyle' ELSE 'none' END AS bucket FROM part GROUP BY p_name),
lb AS (SELECT concept_id, label, freq_notes, CASE WHEN bucket = 'none' THEN 'other' ELSE bucket END AS bucket FROM lex),
prof AS (SELECT client_id, segment_id, profile_type FROM clients_core WHERE NOT is_deleted),
cnt AS (SELECT client_id, concept_id, count(*) AS n FROM client_concepts GROUP BY ALL),
ci AS (SELECT client_id, concept_id, row_number() OVER (PARTITION BY client_id ORDER BY n DESC, concept_id) AS rn FROM cnt JOIN prof USING (client_id)),
si AS (SELECT segment_id, client_id, row_number() OVER (PARTITION BY segment_id ORDER BY client_id) AS rn FROM prof),
act AS (SELECT client_id, title AS action_id, title, min(channel) AS channel, min(priority) AS priority,
               row_number() OVER (PARTITION BY client_id ORDER BY min(CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END), title) AS rn
        FROM client_actions GROUP BY client_id, title),
ai AS (SELECT act.* FROM act JOIN prof USING (client_id) WHERE rn <= 3),
nodes AS (SELECT 'bucket:' || b AS id, 'bucket' AS type FROM (VALUES ('intent'), ('occasion'), ('preferences'), ('constraints'), ('lifestyle'), ('next_action'), ('other')) v(b)
  UNION ALL SELECT 'concept:' || concept_id, CASE WHEN bucket = 'preferences' AND regexp_matches(label, 'trunk|bag|watch|jewelry|perfume') THEN 'brand' ELSE 'concept' END FROM lb
  UNION ALL SELECT 'client:' || client_id, 'client' FROM prof UNION ALL SELECT DISTINCT 'segment:' || segment_id, 'segment' FROM prof
  UNION ALL SELECT DISTINCT 'action:' || action_id, 'action' FROM ai),
edges AS (SELECT 'concept:' || concept_id AS source, 'bucket:' || bucket AS target, 'BELONGS_TO' AS type FROM lb
  UNION ALL SELECT 'client:' || client_id, 'concept:' || concept_id, 'INTERESTED_IN' FROM ci WHERE rn <= 10
  UNION ALL SELECT 'segment:' || segment_id, 'client:' || client_id, 'INCLUDES' FROM si WHERE rn <= 5
  UNION ALL SELECT 'client:' || client_id, 'action:' || action_id, 'RECOMMENDED' FROM ai)
"""
_TABLES = "clients_core client_concepts client_actions"


def graph(spark, folder):
    lexicon = t.read(spark, folder, "part").groupBy("p_name").agg(F.count("*").alias("freq_notes")).select(
        F.concat(F.lit("C_"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("concept_id"), F.col("p_name").alias("label"), "freq_notes",
        F.when(F.contains("p_name", F.lit("red")), "preferences").when(F.contains("p_name", F.lit("hot")), "lifestyle").otherwise("none").alias("bucket"))
    profiles = D.live(t.clients_core(spark, folder)).select("client_id", "segment_id", "profile_type")
    acts = t.client_actions(spark, folder).groupBy("client_id", "title").agg(
        F.min("channel").alias("channel"), F.min("priority").alias("priority"), F.min(priority_rank(F.col("priority"))).alias("p")
    ).withColumn("action_id", F.col("title"))
    ranked = R.top_per_group(acts, ["client_id"], ["p", "title"], 3)
    return G.build_graph(lexicon, profiles, t.client_concepts(spark, folder), ranked)


@query("graph_nodes", with_tables(_TABLES, _GRAPH + "SELECT id, type FROM nodes"))
def graph_nodes(spark, folder):
    return graph(spark, folder)[0].select("id", "type")


@query("graph_edges", with_tables(_TABLES, _GRAPH + "SELECT source, target, type FROM edges"))
def graph_edges(spark, folder):
    return graph(spark, folder)[1].select("source", "target", "type")


@query("graph_node_types", with_tables(_TABLES, _GRAPH + "SELECT type, count(*) AS cnt FROM nodes GROUP BY type"))
def graph_node_types(spark, folder):
    return G.type_counts(graph(spark, folder)[0])


@query("graph_edge_types", with_tables(_TABLES, _GRAPH + "SELECT type, count(*) AS cnt FROM edges GROUP BY type"))
def graph_edge_types(spark, folder):
    return G.type_counts(graph(spark, folder)[1])


@query("graph_elements")
def graph_elements(spark, folder):
    return G.graph_elements(*graph(spark, folder))
