"""Named queries: vectors, clusters, lexicon."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteworks.functions import text as T
from noteworks.operators import clustering as C
from noteworks.operators import lexicon as L
from noteworks.operators import state as S
from noteworks.operators import vectors as V
from noteworks.operators.quantiles import exact_quantiles
from noteworks.plans import tables as t
from noteworks.plans.registry import query
from noteworks.plans.tables import with_tables

_MEANS = """
flat AS (SELECT client_id, unnest(range(1, 65)) AS pos, unnest(embedding) AS x FROM vectors),
mean AS (SELECT client_id, pos, avg(x) AS x FROM flat GROUP BY ALL),
unit AS (SELECT client_id, pos, x / sqrt(sum(x * x) OVER (PARTITION BY client_id)) AS x FROM mean),
means AS (SELECT client_id, list(x ORDER BY pos) AS embedding FROM unit GROUP BY client_id)
"""


@query("client_vector_mean", with_tables("vectors", "," + _MEANS + "SELECT client_id, pos, round(x, 6) AS value FROM unit"))
def client_vector_mean(spark, folder):
    means = V.client_vector_mean(t.vectors(spark, folder))
    return means.select("client_id", F.posexplode("embedding").alias("p", "x")).select(
        "client_id", (F.col("p") + 1).cast("bigint").alias("pos"), F.round("x", 6).alias("value"))


@query("vector_norm_stats", with_tables("vectors", """,
n AS (SELECT sqrt(list_sum(list_transform(embedding, lambda x: x * x))) AS s FROM vectors)
SELECT count(*) AS n, round(min(s), 6) AS min_norm, round(max(s), 6) AS max_norm, round(avg(s), 6) AS avg_norm FROM n"""))
def vector_norm_stats(spark, folder):
    return V.norm_stats(t.vectors(spark, folder))


def _points(spark, folder):
    return t.vectors(spark, folder).select(F.col("note_id").alias("id"), F.col("embedding").alias("vec"))


@query("similar_vectors_topk", with_tables("vectors", """,
pairs AS (SELECT a.note_id AS id, b.note_id AS other, round(list_cosine_similarity(a.embedding, b.embedding), 10) AS s
          FROM vectors a JOIN vectors b ON a.note_id <> b.note_id)
SELECT id, other, round(s, 6) AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS rank FROM pairs) WHERE rank <= 5"""))
def similar_vectors_topk(spark, folder):
    near = V.nearest_neighbours(_points(spark, folder), 5)
    return near.select("id", "other", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


_CENTRES = """
cflat AS (SELECT label, unnest(range(1, 65)) AS pos, unnest(embedding) AS x FROM vectors),
cmean AS (SELECT label, pos, avg(x) AS x FROM cflat GROUP BY ALL),
centres AS (SELECT label, list(x ORDER BY pos) AS centre FROM cmean GROUP BY label)
"""


def _label_means(spark, folder):
    v = t.vectors(spark, folder).select(F.col("label").alias("client_id"), "embedding")
    flat = v.select("client_id", F.posexplode("embedding").alias("p", "x")).groupBy("client_id", "p").agg(F.avg("x").alias("x"))
    return flat.groupBy("client_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("centre"))


@query("assignment_confidence", with_tables("vectors", "," + _CENTRES + """
SELECT note_id, label, round(1 / (1 + list_distance(embedding, centre)), 4) AS confidence FROM vectors JOIN centres USING (label)"""))
def assignment_confidence(spark, folder):
    centres = [r["centre"] for r in _label_means(spark, folder).orderBy("client_id").collect()]
    marked = t.vectors(spark, folder).withColumn("cluster_id", F.col("label"))
    return C.assignment_confidence(marked, centres).select("note_id", "label", "confidence")


@query("recommend_products", with_tables("vectors", "," + _MEANS + "," + _CENTRES + """,
pairs AS (SELECT client_id, label AS product_id, round(list_cosine_similarity(embedding, centre), 10) AS s FROM means CROSS JOIN centres)
SELECT client_id, CAST(product_id AS BIGINT) AS product_id, round(s, 6) AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY s DESC, product_id) AS rank FROM pairs) WHERE rank <= 3"""))
def recommend_products(spark, folder):
    """Products are the ten labels, each the mean of its vectors."""
    catalogue = _label_means(spark, folder).select(F.col("client_id").alias("product_id"), F.lit("any").alias("category"),
                                                   F.lit(None).cast("double").alias("price"), F.col("centre").alias("vec"))
    found = V.recommend_products(V.client_vector_mean(t.vectors(spark, folder)), catalogue, 3)
    return found.select("client_id", "product_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


def _purchases(spark, folder):
    lines = t.read(spark, folder, "lineitem").select("l_orderkey", F.col("l_partkey").alias("product_id"))
    orders = t.read(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("client_id"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("client_id", "product_id")


_SIMILAR = """
alive AS (SELECT client_id, segment_id, confidence FROM clients_core WHERE NOT is_deleted),
ranked AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY confidence DESC, client_id) AS place FROM alive),
pairs AS (SELECT a.client_id, b.client_id AS other, row_number() OVER (PARTITION BY a.client_id ORDER BY b.place) AS rank
          FROM alive a JOIN ranked b ON a.segment_id = b.segment_id AND a.client_id <> b.client_id AND b.place <= 6),
similar_five AS (SELECT client_id, other FROM pairs WHERE rank <= 5),
buys AS (SELECT o_custkey AS client_id, l_partkey AS product_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
         WHERE l_partkey IN (SELECT p_partkey FROM part) GROUP BY ALL),
votes AS (SELECT s.client_id, b.product_id, CAST(sum(n) AS BIGINT) AS votes FROM similar_five s JOIN buys b ON b.client_id = s.other GROUP BY ALL),
collab AS (SELECT client_id, product_id, votes, row_number() OVER (PARTITION BY client_id ORDER BY votes DESC, product_id) AS rank
           FROM votes v WHERE NOT EXISTS (SELECT 1 FROM buys b WHERE b.client_id = v.client_id AND b.product_id = v.product_id))
"""


def _collaborative(spark, folder):
    similar = S.similar_in_segment(t.clients_core(spark, folder)).select("client_id", F.col("similar_id").alias("other"))
    catalogue = t.read(spark, folder, "part").select(F.col("p_partkey").alias("product_id"))
    return V.collaborative_topk(similar, _purchases(spark, folder), catalogue, 5)


@query("collaborative_topk", with_tables("clients_core", "," + _SIMILAR + "SELECT * FROM collab WHERE rank <= 5"))
def collaborative_topk(spark, folder):
    return _collaborative(spark, folder).withColumn("rank", F.col("rank").cast("bigint"))


@query("explain_recommendation", with_tables("clients_core client_concepts", "," + _SIMILAR + """,
mine AS (SELECT client_id, string_agg(label, ', ' ORDER BY label) AS interests FROM (
   SELECT client_id, label, row_number() OVER (PARTITION BY client_id ORDER BY label) AS rn FROM (SELECT DISTINCT client_id, label FROM client_concepts))
   WHERE rn <= 3 GROUP BY client_id)
SELECT client_id, product_id, votes AS similarity, 'Based on your interests in ' || coalesce(interests, '') || ', we recommend ' || p_name AS explanation
FROM collab JOIN part ON p_partkey = product_id LEFT JOIN mine USING (client_id) WHERE rank <= 5"""))
def explain_recommendation(spark, folder):
    found = _collaborative(spark, folder).withColumnRenamed("votes", "similarity")
    products = t.read(spark, folder, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"))
    return V.explain_recommendation(found, products, t.client_concepts(spark, folder))


EPS = 0.85


@query("dbscan_components", with_tables("vectors", f""",
edges AS (SELECT a.note_id AS a, b.note_id AS b FROM vectors a JOIN vectors b ON a.note_id <> b.note_id
          WHERE list_distance(a.embedding, b.embedding) <= {EPS}),
reach(id, seen) AS (SELECT note_id, note_id FROM vectors UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.seen)
SELECT id, CASE WHEN count(*) > 1 THEN min(seen) ELSE -1 END AS cluster_id FROM reach GROUP BY id"""))
def dbscan_components(spark, folder):
    return C.dbscan(_points(spark, folder), EPS)


@query("client_tags", with_tables("client_concepts", """,
first AS (SELECT client_id, label, row_number() OVER (PARTITION BY client_id, label ORDER BY note_id, span_start) AS rn, note_id, span_start FROM client_concepts),
ranked AS (SELECT client_id, label, row_number() OVER (PARTITION BY client_id ORDER BY note_id, span_start, label) AS place FROM first WHERE rn = 1)
SELECT client_id, string_agg(label, '|' ORDER BY place) AS tags FROM ranked WHERE place <= 12 GROUP BY client_id"""))
def client_tags(spark, folder):
    return C.client_tags(t.client_concepts(spark, folder)).withColumn("tags", F.array_join("tags", "|"))


@query("kmeans_segments")
def kmeans_segments(spark, folder):
    means = V.client_vector_mean(t.vectors(spark, folder))
    clustered, _ = C.kmeans_segments(means, C.choose_k(means.count()), starts=10)
    return clustered.select("client_id", "cluster_id")


@query("segment_clients")
def segment_clients(spark, folder):
    return C.segment_clients(t.vectors(spark, folder), t.client_concepts(spark, folder), starts=10).withColumn(
        "top_concepts", F.array_join("top_concepts", "|"))


@query("pca_3d")
def pca_3d(spark, folder):
    return C.project_3d(V.client_vector_mean(t.vectors(spark, folder)))


@query("note_embeddings")
def note_embeddings(spark, folder):
    return V.norm_stats(V.embed_text(t.notes(spark, folder)))


# ---- lexicon -----------------------------------------------------------------------------------------

RULES = {"preferences": ["red", "blue"], "lifestyle": ["ring", "gear"], "intent": ["brand#7"]}

_LEX = """
lex0 AS (SELECT p_name AS label, list_sort(list(DISTINCT lower(p_brand))) AS aliases, list_sort(list(DISTINCT p_type)) AS languages,
                count(*) AS freq_notes FROM part GROUP BY p_name),
lex1 AS (SELECT *, row_number() OVER (ORDER BY freq_notes DESC, label) - 1 AS idx FROM lex0),
lex AS (SELECT printf('CONCEPT_%04d_', idx) || left(md5(label), 6) AS concept_id, label, aliases, languages, freq_notes,
        CASE WHEN contains(label, 'red') OR contains(label, 'blue') THEN 'preferences'
             WHEN contains(label, 'ring') OR contains(label, 'gear') THEN 'lifestyle'
             WHEN contains(label || ' ' || array_to_string(aliases, ' '), 'brand#7') THEN 'intent' ELSE 'other' END AS bucket FROM lex1)
"""


def part_lexicon(spark, folder):
    """A lexicon of the catalogue: names are labels, brands are aliases, types stand for languages."""
    members = t.read(spark, folder, "part").groupBy("p_name", F.lower("p_brand").alias("term"), "p_type").agg(F.count("*").alias("freq"))
    rows = members.select(F.col("p_name").alias("label"), "term", "freq", F.array("p_type").alias("languages"),
                          F.array(F.col("p_type")).alias("examples"))
    return L.build_lexicon(rows, RULES)


@query("build_lexicon", "WITH " + _LEX + """
SELECT concept_id, label, array_to_string(aliases, '|') AS aliases, array_to_string(languages, '|') AS languages, freq_notes, bucket,
       array_to_string(languages[1:5], '|') AS examples FROM lex""")
def build_lexicon(spark, folder):
    lex = part_lexicon(spark, folder)
    return lex.select("concept_id", "label", F.array_join("aliases", "|").alias("aliases"), F.array_join("languages", "|").alias("languages"),
                      "freq_notes", "bucket", F.array_join("examples", "|").alias("examples"))


@query("taxonomy", "WITH " + _LEX + """,
b(bucket) AS (VALUES ('intent'), ('occasion'), ('preferences'), ('constraints'), ('lifestyle'), ('next_action'), ('other'))
SELECT bucket, coalesce(string_agg(concept_id, '|' ORDER BY concept_id), '') AS concept_ids FROM b LEFT JOIN lex USING (bucket) GROUP BY bucket""")
def taxonomy(spark, folder):
    return L.taxonomy(part_lexicon(spark, folder)).withColumn("concept_ids", F.array_join("concept_ids", "|"))


@query("lexicon_stats", "WITH " + _LEX + """
SELECT bucket, count(*) AS concepts, CAST(sum(len(aliases)) AS BIGINT) AS aliases, CAST(sum(freq_notes) AS BIGINT) AS mentions FROM lex GROUP BY bucket""")
def lexicon_stats(spark, folder):
    return L.lexicon_stats(part_lexicon(spark, folder))


@query("lexicon_languages", "WITH " + _LEX + "SELECT language, count(*) AS concepts FROM (SELECT unnest(languages) AS language FROM lex) GROUP BY 1")
def lexicon_languages(spark, folder):
    return L.lexicon_languages(part_lexicon(spark, folder))


@query("list_concepts", "WITH " + _LEX + "SELECT concept_id, label, freq_notes FROM lex WHERE bucket = 'lifestyle' ORDER BY freq_notes DESC, concept_id LIMIT 20")
def list_concepts(spark, folder):
    return L.list_concepts(part_lexicon(spark, folder), "lifestyle").select("concept_id", "label", "freq_notes")


@query("search_lexicon", "WITH " + _LEX + """
SELECT concept_id, CASE WHEN contains(lower(concept_id), 'ring') THEN 'id' WHEN contains(label, 'ring') THEN 'label' ELSE 'alias' END AS matched
FROM lex WHERE contains(lower(concept_id), 'ring') OR contains(label, 'ring') OR len(list_filter(aliases, lambda a: contains(a, 'ring'))) > 0""")
def search_lexicon(spark, folder):
    return L.search_lexicon(part_lexicon(spark, folder), "RING").select("concept_id", F.substring_index("matched", ":", 1).alias("matched"))


def _supplied(spark, folder):
    """A second lexicon: the types of the catalogue, under the ids and labels of some names."""
    return t.read(spark, folder, "part").groupBy("p_name").agg(
        F.max("p_size").cast("bigint").alias("freq_notes"), F.array_sort(F.collect_set(F.lower("p_type"))).alias("aliases"), F.min("p_size").alias("s")
    ).select(F.concat(F.lit("X_"), F.substring_index("p_name", " ", 1)).alias("concept_id"),
             F.when(F.col("s") > 1, F.concat(F.lit("new "), "p_name")).otherwise(F.upper("p_name")).alias("label"), "aliases",
             F.array(F.lit("xx")).alias("languages"), "freq_notes", F.array(F.lit("e")).alias("examples"), F.lit("other").alias("bucket"))


_SUPPLIED = """
sup AS (SELECT 'X_' || string_split(p_name, ' ')[1] AS concept_id,
               CASE WHEN min(p_size) > 1 THEN 'new ' || p_name ELSE upper(p_name) END AS label,
               list_sort(list(DISTINCT lower(p_type))) AS aliases, CAST(max(p_size) AS BIGINT) AS freq_notes, 'other' AS bucket FROM part GROUP BY p_name)
"""


@query("merge_lexicon", "WITH " + _LEX + "," + _SUPPLIED + """
SELECT coalesce(l.concept_id, s.concept_id) AS concept_id, coalesce(l.label, s.label) AS label, coalesce(s.freq_notes, l.freq_notes) AS freq_notes,
       array_to_string(coalesce(l.aliases, s.aliases), '|') AS aliases, coalesce(l.bucket, s.bucket) AS bucket
FROM lex l FULL JOIN sup s ON lower(l.label) = lower(s.label)""")
def merge_lexicon(spark, folder):
    merged = L.merge_lexicon(part_lexicon(spark, folder), _supplied(spark, folder))
    return merged.select("concept_id", "label", "freq_notes", F.array_join("aliases", "|").alias("aliases"), "bucket")


@query("novel_labels", "WITH " + _LEX + "," + _SUPPLIED + "SELECT label FROM sup WHERE lower(label) NOT IN (SELECT label FROM lex)")
def novel_labels(spark, folder):
    return L.novel_labels(_supplied(spark, folder), part_lexicon(spark, folder)).select("label")


@query("import_concepts", "WITH " + _LEX + """,
inc AS (SELECT concept_id, ['extra ' || label, aliases[1]] AS extra FROM lex WHERE freq_notes >= (SELECT median(freq_notes) FROM lex)
        UNION ALL SELECT 'K_' || p_brand, ['b'] FROM (SELECT DISTINCT p_brand FROM part)),
united AS (SELECT coalesce(l.concept_id, i.concept_id) AS concept_id,
         list_sort(list_distinct(list_concat(coalesce(l.aliases, []), coalesce(i.extra, [])))) AS aliases FROM lex l FULL JOIN inc i ON l.concept_id = i.concept_id)
SELECT concept_id, array_to_string(aliases, '|') AS aliases FROM united""")
def import_concepts(spark, folder):
    lex = part_lexicon(spark, folder)
    middle = exact_quantiles(lex, "freq_notes", [0.5])[0]
    more = lex.where(F.col("freq_notes") >= middle).withColumn("aliases", F.array(F.concat(F.lit("extra "), "label"), F.get("aliases", F.lit(0))))
    brands = t.read(spark, folder, "part").select(F.concat(F.lit("K_"), "p_brand").alias("concept_id"), F.col("p_brand").alias("label")).distinct()
    fresh = brands.select("concept_id", "label", F.array(F.lit("b")).alias("aliases"), F.array().cast("array<string>").alias("languages"),
                          F.lit(0).cast("bigint").alias("freq_notes"), F.array().cast("array<string>").alias("examples"), F.lit("other").alias("bucket"))
    return L.import_concepts(lex, more.unionByName(fresh)).select("concept_id", F.array_join("aliases", "|").alias("aliases"))


@query("apply_enrichment", "WITH " + _LEX + """,
conf AS (SELECT concept_id, CASE WHEN freq_notes % 2 = 0 THEN 'occasion' ELSE 'other' END AS bucket, 1.0 / (1 + len(aliases) % 3) AS c FROM lex),
moved AS (SELECT l.concept_id, CASE WHEN c.bucket <> 'other' AND c.c >= 0.5 THEN c.bucket ELSE l.bucket END AS bucket,
                 list_sort(list_distinct(list_append(l.aliases, 'also ' || l.label))) AS aliases FROM lex l JOIN conf c USING (concept_id)),
added AS (SELECT DISTINCT left(replace(replace(lower(p_brand), '#', ''), ' ', '_'), 30) AS concept_id, 'other' AS bucket, [p_brand] AS aliases FROM part)
SELECT concept_id, bucket, array_to_string(aliases, '|') AS aliases FROM moved UNION ALL SELECT concept_id, bucket, array_to_string(aliases, '|') FROM added""")
def apply_enrichment(spark, folder):
    lex = part_lexicon(spark, folder)
    moves = lex.select("concept_id", F.when(F.col("freq_notes") % 2 == 0, "occasion").otherwise("other").alias("bucket"),
                       (1.0 / (1 + F.size("aliases") % 3)).alias("confidence"))
    more = lex.select("concept_id", F.array(F.concat(F.lit("also "), "label")).alias("aliases"))
    found = t.read(spark, folder, "part").select(F.col("p_brand").alias("term"), F.array().cast("array<string>").alias("aliases"), F.lit("other").alias("bucket")).distinct()
    return L.apply_enrichment(lex, moves, more, found).select("concept_id", "bucket", F.array_join("aliases", "|").alias("aliases"))


@query("remove_concepts", "WITH " + _LEX + "SELECT concept_id FROM lex WHERE bucket <> 'preferences'")
def remove_concepts(spark, folder):
    lex = part_lexicon(spark, folder)
    return L.remove_concepts(lex, lex.where("bucket = 'preferences'")).select("concept_id")


@query("alias_examples", "WITH " + _LEX + "SELECT label, bucket, unnest(aliases[1:10]) AS keyword FROM lex")
def alias_examples(spark, folder):
    return L.alias_examples(part_lexicon(spark, folder))


@query("under_aliased", "WITH " + _LEX + "SELECT concept_id, CAST(len(aliases) AS BIGINT) AS n FROM lex WHERE len(aliases) < 20")
def under_aliased(spark, folder):
    return L.under_aliased(part_lexicon(spark, folder), 20).select("concept_id", F.size("aliases").cast("bigint").alias("n"))


@query("term_ties", """
WITH p AS (SELECT DISTINCT p_name AS a, lower(p_type) AS b FROM part)
SELECT a, b, contains(a, b) OR contains(b, a) OR list_has_any(list_transform(range(1, length(a) - 2), lambda i: a[i:i + 3]),
       list_transform(range(1, length(b) - 2), lambda i: b[i:i + 3])) AS stem FROM p""")
def term_ties(spark, folder):
    p = t.read(spark, folder, "part").select(F.col("p_name").alias("a"), F.lower("p_type").alias("b")).distinct()
    return p.select("a", "b", T.share_stem(F.col("a"), F.col("b")).alias("stem"))


@query("sentences", with_tables("notes", r""",
parts AS (SELECT note_id, list_filter(list_transform(string_split(text, '.'), lambda s: trim(s, E' \n\t\r')), lambda s: length(s) > 20) AS p FROM notes)
SELECT note_id, md5(unnest(p[1:5])) AS digest FROM parts"""))
def sentences(spark, folder):
    return L.explode_sentences(t.notes(spark, folder)).select("note_id", F.md5("sentence").alias("digest"))


@query("cluster_terms")
def cluster_terms(spark, folder):
    """Rows only; checked against a brute-force linkage in the tests."""
    return L.cluster_terms(_points(spark, folder), 0.35)


@query("lexicon_from_candidates", """
WITH terms AS (SELECT p_name AS stem, p_name AS term, count(*) AS freq FROM part GROUP BY p_name
               UNION ALL SELECT p_name, upper(p_name), count(*) FROM part WHERE p_size >= 25 GROUP BY p_name),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY freq DESC, term) AS rn FROM terms),
spoken AS (SELECT p_name AS stem, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS languages FROM part GROUP BY p_name),
lex AS (SELECT stem, max(term) FILTER (WHERE rn = 1) AS label, coalesce(max(term) FILTER (WHERE rn = 2), '') AS aliases, CAST(sum(freq) AS BIGINT) AS freq_notes
        FROM ranked GROUP BY stem)
SELECT printf('CONCEPT_%04d_', row_number() OVER (ORDER BY freq_notes DESC, label) - 1) || left(md5(label), 6) AS concept_id, label, aliases, languages, freq_notes,
       CASE WHEN contains(stem, 'red') OR contains(stem, 'blue') THEN 'preferences' WHEN contains(stem, 'ring') OR contains(stem, 'gear') THEN 'lifestyle'
            ELSE 'other' END AS bucket FROM lex JOIN spoken USING (stem)""")
def lexicon_from_candidates(spark, folder):
    """Catalogue names as candidates in two spellings; those of one name embed alike and become one concept."""
    part = t.read(spark, folder, "part")
    types = F.array_sort(F.collect_set("p_type"))
    plain = part.groupBy(F.col("p_name").alias("candidate")).agg(F.count("*").alias("freq_notes"), types.alias("languages"))
    loud = part.where("p_size >= 25").groupBy(F.upper("p_name").alias("candidate")).agg(F.count("*").alias("freq_notes"), types.alias("languages"))
    lex = L.lexicon_from_candidates(plain.unionByName(loud).withColumn("example_note_ids", F.slice("languages", 1, 5)), rules=RULES)
    return lex.select("concept_id", "label", F.array_join("aliases", "|").alias("aliases"), F.array_join("languages", "|").alias("languages"), "freq_notes", "bucket")
