"""The business tables of the engine, mapped from the given parquet tables.

Each Spark mapping has a twin in ``SQL``, a set of common table expressions for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteworks.session import literal_table

# Concepts used on the sample corpus: common words and phrases in four languages, with overlaps.
LEXICON = (
    ("C001", "the", ["of the", "in the", "and the"], "preferences", 1),
    ("C002", "of", ["is of", "that of"], "intent", 2),
    ("C003", "de la", ["de", "de los"], "preferences", 3),
    ("C004", "la", ["a la"], "lifestyle", 4),
    ("C005", "der", ["in der", "von der"], "occasion", 5),
    ("C006", "und", ["und der"], "constraints", 6),
    ("C007", "that", ["that the", "for that"], "next_action", 7),
    ("C008", "est", ["elle est", "que"], "intent", 8),
    ("C009", "tion", ["ation", "ción"], "lifestyle", 9),
    ("C010", "disgusting", ["rewh", "orantion"], "other", 10),
    ("C011", "für", ["für die", "nicht"], "constraints", 11),
    ("C012", "être", ["été", "qui"], "occasion", 12),
    ("C013", "y de", ["por", "con la"], "preferences", 13),
    ("C014", "for", ["for", "is"], "other", 14),
    ("C015", "la", ["para la"], "other", 15),
)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give text work at least one partition per core when the input files have fewer row groups than that."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def lexicon(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, LEXICON, "concept_id string, label string, aliases array<string>, bucket string, ord int"
    )


def notes(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read(spark, folder, "documents")).select(
        F.col("doc_id").alias("note_id"),
        F.expr("doc_id div 5").alias("client_id"),
        F.upper("lang").alias("language"),
        "text",
        F.expr("date_add(date'2024-01-01', int(doc_id % 365))").alias("date"),
    )


def client_concepts(spark: SparkSession, folder: str) -> DataFrame:
    """Concept mentions of a client: the catalogue names on the order lines."""
    lines = read(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey")
    parts = read(spark, folder, "part").select("p_partkey", "p_name", "p_type")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("client_id"),
            F.col("o_orderkey").alias("note_id"),
            F.concat(F.lit("C_"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("concept_id"),
            F.col("p_name").alias("label"),
            F.col("p_name").alias("matched_alias"),
            F.lower("p_type").alias("bucket"),
            F.col("l_linenumber").cast("int").alias("span_start"),
            (F.col("l_linenumber") + F.length("p_name")).cast("int").alias("span_end"),
        )
    )


def segment_id(segment: F.Column) -> F.Column:
    names = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    lookup = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    return lookup[segment]


def clients_core(spark: SparkSession, folder: str) -> DataFrame:
    """Clients without their concept list."""
    return read(spark, folder, "customer").select(
        F.col("c_custkey").alias("client_id"),
        segment_id(F.col("c_mktsegment")).alias("segment_id"),
        F.initcap("c_mktsegment").alias("profile_type"),
        (F.floor((F.col("c_acctbal") + 1000) / 11000 * 10000) / 10000).alias("confidence"),
        F.expr(
            "CASE WHEN c_nationkey < 8 THEN 'FR' WHEN c_nationkey < 16 THEN 'EN' WHEN c_nationkey < 22 THEN 'IT' END"
        ).alias("language"),
        F.expr("date_add(date'2024-01-01', int(c_custkey % 365))").alias("note_date"),
        F.col("c_name").alias("full_text"),
        (F.col("c_acctbal") < -500).alias("is_deleted"),
    )


def clients(spark: SparkSession, folder: str) -> DataFrame:
    """Clients with ``top_concepts``: their distinct concept labels, sorted, joined by a bar."""
    labels = (
        client_concepts(spark, folder).groupBy("client_id")
        .agg(F.array_join(F.array_sort(F.collect_set("label")), "|").alias("top_concepts"))
    )
    return clients_core(spark, folder).join(labels, "client_id", "left")


def segments(spark: SparkSession, folder: str) -> DataFrame:
    return clients_core(spark, folder).groupBy("segment_id").agg(
        F.min("profile_type").alias("profile"), F.count("*").alias("client_count")
    ).select(
        "segment_id", F.concat(F.lit("Segment "), F.col("segment_id")).alias("name"), "profile", "client_count"
    )


def client_actions(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").select(
        F.col("o_custkey").alias("client_id"),
        F.col("o_orderkey").alias("action_id"),
        F.concat(F.lit("Action "), F.substring("o_orderpriority", 1, 1)).alias("title"),
        F.expr("CASE month(o_orderdate) % 3 WHEN 0 THEN 'CRM' WHEN 1 THEN 'Email' ELSE 'Event' END").alias("channel"),
        F.expr(
            "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' "
            "WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END"
        ).alias("priority"),
        (F.col("o_orderstatus") == "F").alias("is_completed"),
        F.col("o_totalprice").alias("amount"),
        F.to_date("o_orderdate").alias("created_on"),
    )


def calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Activation events: one per nation, about the catalogue names of one brand."""
    concepts = (
        read(spark, folder, "part").select("p_brand", "p_name").distinct()
        .groupBy("p_brand").agg(F.array_sort(F.collect_list("p_name")).alias("concepts"))
    )
    base = read(spark, folder, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("event_id"),
        F.col("n_name").alias("title"),
        F.expr("CASE n_regionkey WHEN 0 THEN 'CRM' WHEN 1 THEN 'Email' ELSE 'Event' END").alias("channel"),
        F.expr("CASE WHEN n_nationkey < 10 THEN 'completed' WHEN n_nationkey < 20 THEN 'scheduled' ELSE 'draft' END")
        .alias("status"),
        F.expr("date_add(date'2024-01-01', int(n_nationkey * 14))").alias("event_date"),
        F.concat(F.lit("Brand#"), F.col("n_nationkey") + 1).alias("p_brand"),
    )
    return base.join(concepts, "p_brand", "left").drop("p_brand")


def event_targets(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select(
        F.expr("event_id % 25").alias("event_id"),
        F.col("user_id").alias("client_id"),
        F.expr(
            "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'notified' WHEN 'error' THEN 'skipped' "
            "ELSE 'responded' END"
        ).alias("action_status"),
        F.expr("CASE event_type WHEN 'purchase' THEN 'purchased' WHEN 'signup' THEN 'visited' ELSE 'none' END")
        .alias("outcome"),
        F.col("value").alias("outcome_value"),
        F.col("event_id").alias("change_id"),
        F.col("ts"),
    )


def advisors(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("advisor_id"),
        F.col("s_name").alias("advisor_name"),
        F.expr("CASE WHEN s_nationkey < 12 THEN 'sales' WHEN s_nationkey < 20 THEN 'manager' ELSE 'admin' END")
        .alias("role"),
        (F.col("s_acctbal") >= 0).alias("is_active"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "embeddings").select(
        F.col("vec_id").alias("note_id"),
        F.expr("vec_id div 5").alias("client_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        "label",
    )


# ---- the same tables as common table expressions -------------------------------------------------

SQL = {
    "notes": """notes AS (
        SELECT doc_id AS note_id, doc_id // 5 AS client_id, upper(lang) AS language, text,
               DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS date FROM documents)""",
    "client_concepts": """client_concepts AS (
        SELECT o_custkey AS client_id, o_orderkey AS note_id, 'C_' || replace(p_name, ' ', '_') AS concept_id,
               p_name AS label, p_name AS matched_alias, lower(p_type) AS bucket,
               l_linenumber AS span_start, l_linenumber + length(p_name) AS span_end
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
    "clients_core": """clients_core AS (
        SELECT c_custkey AS client_id,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2
                    WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 END AS segment_id,
               c_mktsegment[1] || lower(c_mktsegment[2:]) AS profile_type,
               floor((c_acctbal + 1000) / 11000 * 10000) / 10000 AS confidence,
               CASE WHEN c_nationkey < 8 THEN 'FR' WHEN c_nationkey < 16 THEN 'EN'
                    WHEN c_nationkey < 22 THEN 'IT' END AS language,
               DATE '2024-01-01' + CAST(c_custkey % 365 AS INTEGER) AS note_date,
               c_name AS full_text, c_acctbal < -500 AS is_deleted FROM customer)""",
    "clients": """clients AS (
        SELECT c.*, t.top_concepts FROM clients_core c LEFT JOIN (
            SELECT client_id, string_agg(label, '|' ORDER BY label) AS top_concepts
            FROM (SELECT DISTINCT client_id, label FROM client_concepts) GROUP BY client_id) t USING (client_id))""",
    "segments": """segments AS (
        SELECT segment_id, 'Segment ' || segment_id AS name, min(profile_type) AS profile, count(*) AS client_count
        FROM clients_core GROUP BY segment_id)""",
    "client_actions": """client_actions AS (
        SELECT o_custkey AS client_id, o_orderkey AS action_id, 'Action ' || o_orderpriority[1] AS title,
               CASE month(o_orderdate) % 3 WHEN 0 THEN 'CRM' WHEN 1 THEN 'Email' ELSE 'Event' END AS channel,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high'
                    WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority,
               o_orderstatus = 'F' AS is_completed, o_totalprice AS amount,
               CAST(o_orderdate AS DATE) AS created_on FROM orders)""",
    "calendar": """calendar AS (
        SELECT CAST(n_nationkey AS BIGINT) AS event_id, n_name AS title,
               CASE n_regionkey WHEN 0 THEN 'CRM' WHEN 1 THEN 'Email' ELSE 'Event' END AS channel,
               CASE WHEN n_nationkey < 10 THEN 'completed' WHEN n_nationkey < 20 THEN 'scheduled'
                    ELSE 'draft' END AS status,
               DATE '2024-01-01' + CAST(n_nationkey * 14 AS INTEGER) AS event_date, concepts
        FROM nation LEFT JOIN (SELECT p_brand, list(DISTINCT p_name) AS concepts FROM part GROUP BY p_brand)
             ON p_brand = 'Brand#' || (n_nationkey + 1))""",
    "event_targets": """event_targets AS (
        SELECT event_id % 25 AS event_id, user_id AS client_id,
               CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'notified' WHEN 'error' THEN 'skipped'
                    ELSE 'responded' END AS action_status,
               CASE event_type WHEN 'purchase' THEN 'purchased' WHEN 'signup' THEN 'visited' ELSE 'none' END
                    AS outcome,
               value AS outcome_value, event_id AS change_id, ts FROM events)""",
    "advisors": """advisors AS (
        SELECT s_suppkey AS advisor_id, s_name AS advisor_name,
               CASE WHEN s_nationkey < 12 THEN 'sales' WHEN s_nationkey < 20 THEN 'manager' ELSE 'admin' END AS role,
               s_acctbal >= 0 AS is_active FROM supplier)""",
    "vectors": """vectors AS (
        SELECT vec_id AS note_id, vec_id // 5 AS client_id, CAST(embedding AS DOUBLE[]) AS embedding, label
        FROM embeddings)""",
}

_NEEDS = {"clients": ["client_concepts", "clients_core"], "segments": ["clients_core"]}


def with_tables(names: str, body: str) -> str:
    """``body`` preceded by the table expressions it uses, in dependency order."""
    order: list[str] = []
    for name in names.split():
        for each in [*_NEEDS.get(name, []), name]:
            if each not in order:
                order.append(each)
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in order) + body
