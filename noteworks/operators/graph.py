"""The knowledge graph as two tables: nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteworks import config
from noteworks.operators.ranking import first_per_group, top_per_group
from noteworks.session import literal_table


def _nodes(df: DataFrame, id_prefix: str, key: str, label: Column, kind: Column, attrs: dict[str, Column]) -> DataFrame:
    values = F.map_filter(
        F.create_map(*[x for n, c in attrs.items() for x in (F.lit(n), c.cast("string"))]), lambda k, v: v.isNotNull()
    )
    return df.select(
        F.concat(F.lit(id_prefix), F.col(key).cast("string")).alias("id"), label.cast("string").alias("label"), kind.alias("type"), values.alias("attrs")
    )


def _edges(df: DataFrame, source: Column, target: Column, kind: str, label: str) -> DataFrame:
    return df.select(
        F.concat_ws("|", source, F.lit(kind), target).alias("id"), source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), F.lit(label).alias("label")
    ).dropDuplicates(["id"])


def _ref(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def concept_layer(lexicon: DataFrame, brand_terms: tuple[str, ...] = config.BRAND_TERMS) -> tuple[DataFrame, DataFrame]:
    """Buckets, concepts (preferences that name one of ``brand_terms`` are brands) and BELONGS_TO."""
    known = lexicon.withColumn("bucket", F.when(F.col("bucket").isin(*config.BUCKETS), F.col("bucket")).otherwise("other"))
    counts = known.groupBy("bucket").agg(F.count("*").alias("n"))
    every = literal_table(lexicon.sparkSession, [(b,) for b in config.BUCKETS], "bucket string")
    buckets = _nodes(every.join(counts, "bucket", "left"), "bucket:", "bucket", F.initcap(F.replace("bucket", F.lit("_"), F.lit(" "))), F.lit("bucket"),
                     {"concept_count": F.coalesce("n", F.lit(0))})
    one = first_per_group(known.select("concept_id", "label", "bucket", "freq_notes"), ["concept_id"], "label")
    brand = (F.col("bucket") == "preferences") & F.exists(F.lit(list(brand_terms)), lambda b: F.contains(F.lower("label"), b))
    concepts = _nodes(one, "concept:", "concept_id", F.col("label"), F.when(brand, "brand").otherwise("concept"),
                      {"bucket": F.col("bucket"), "freq_notes": F.col("freq_notes")})
    edges = _edges(one, _ref("concept:", "concept_id"), _ref("bucket:", "bucket"), "BELONGS_TO", "in category")
    return buckets.unionByName(concepts), edges


def client_layer(profiles: DataFrame, concepts: DataFrame, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """Clients and at most ``limit`` INTERESTED_IN edges each, by number of mentions."""
    counted = concepts.groupBy("client_id", "concept_id").agg(F.count("*").alias("n"))
    sizes = counted.groupBy("client_id").agg(F.count("*").alias("concept_count"))
    nodes = _nodes(profiles.join(sizes, "client_id", "left"), "client:", "client_id", _ref("Client ", "client_id"), F.lit("client"),
                   {"segment": F.col("segment_id"), "profile_type": F.col("profile_type"), "concept_count": F.coalesce("concept_count", F.lit(0))})
    live = counted.join(profiles.select("client_id"), "client_id", "left_semi")
    best = top_per_group(live, ["client_id"], [F.desc("n"), "concept_id"], limit)
    return nodes, _edges(best, _ref("client:", "client_id"), _ref("concept:", "concept_id"), "INTERESTED_IN", "interested in")


def segment_layer(profiles: DataFrame, limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """Segments and INCLUDES edges to their first ``limit`` clients by id."""
    sizes = profiles.groupBy("segment_id").agg(F.count("*").alias("n"), F.min_by("profile_type", "client_id").alias("profile_type"))
    nodes = _nodes(sizes, "segment:", "segment_id", _ref("Segment ", "segment_id"), F.lit("segment"),
                   {"client_count": F.col("n"), "profile_type": F.col("profile_type")})
    few = top_per_group(profiles.select("segment_id", "client_id"), ["segment_id"], ["client_id"], limit)
    return nodes, _edges(few, _ref("segment:", "segment_id"), _ref("client:", "client_id"), "INCLUDES", "includes")


def action_layer(actions: DataFrame, profiles: DataFrame, limit: int = 3) -> tuple[DataFrame, DataFrame]:
    """Distinct actions and RECOMMENDED edges for the first ``limit`` of each known client. ``actions`` carry ``rank``."""
    top = actions.where(F.col("rank") <= limit).join(profiles.select("client_id"), "client_id", "left_semi")
    one = first_per_group(top.select("action_id", "title", "channel", "priority"), ["action_id"], F.struct("title", "channel", "priority"))
    nodes = _nodes(one, "action:", "action_id", F.col("title"), F.lit("action"), {"channel": F.col("channel"), "priority": F.col("priority")})
    return nodes, _edges(top, _ref("client:", "client_id"), _ref("action:", "action_id"), "RECOMMENDED", "recommended")


def build_graph(lexicon: DataFrame, profiles: DataFrame, concepts: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    layers = [concept_layer(lexicon), client_layer(profiles, concepts), segment_layer(profiles), action_layer(actions, profiles)]
    return reduce(DataFrame.unionByName, [n for n, _ in layers]), reduce(DataFrame.unionByName, [e for _, e in layers])


def type_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("type").agg(F.count("*").alias("cnt"))


def graph_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON element per row, nodes before edges when sorted by ``kind``."""
    n = nodes.select(F.lit("0_node").alias("kind"), F.to_json(F.struct(F.struct("id", "label", "type", "attrs").alias("data"))).alias("element"))
    e = edges.select(F.lit("1_edge").alias("kind"), F.to_json(F.struct(F.struct("id", "source", "target", "type", "label").alias("data"))).alias("element"))
    return n.unionByName(e)
