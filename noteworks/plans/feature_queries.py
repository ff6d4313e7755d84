"""Named queries: client features, labels, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteworks.functions.rules import cut_value_segment
from noteworks.operators import dashboard as D
from noteworks.operators import features as X
from noteworks.operators import models as M
from noteworks.operators import sparse as S
from noteworks.plans import tables as t
from noteworks.plans.registry import query
from noteworks.plans.tables import with_tables

# The sample catalogue knows no luxury or gifts: its words are renamed before they reach the rules.
_WORDS = {"red": "luxury", "blue": "gift", "hot": "budget", "cold": "looking for", "new": "hesitant", "old": "urgent", "gizmo": "allergy free luxury gizmo"}

_RENAMED = "p_name"
for _from, _to in _WORDS.items():
    _RENAMED = f"replace({_RENAMED}, '{_from}', '{_to}')"
_MENTIONS = f"""mentions AS (SELECT o_custkey AS client_id, {_RENAMED} AS term
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def mentions(spark, folder):
    alias = F.col("matched_alias")
    for old, new in _WORDS.items():
        alias = F.replace(alias, F.lit(old), F.lit(new))
    return t.client_concepts(spark, folder).select("client_id", alias.alias("matched_alias"))


def _has(words):
    return "(" + " OR ".join(f"contains(term, '{w}')" for w in words) + ")"


@query("stat_features_fast", "WITH " + _MENTIONS + f"""
SELECT client_id, count(*) AS total_concepts, count(DISTINCT term) AS unique_concepts,
       {", ".join(f"count(*) FILTER (WHERE {_has(w)}) AS {n}" for n, w in X.config.FAST_FAMILIES.items())} FROM mentions GROUP BY client_id""")
def stat_features_fast(spark, folder):
    return X.stat_features_fast(mentions(spark, folder))


@query("stat_features_elite", "WITH " + _MENTIONS + f"""
SELECT client_id, count(*) AS total, count(DISTINCT term) AS distinct_terms, CAST(sum(length(term)) + count(*) - 1 AS BIGINT) AS text_length,
       {", ".join(f"count(*) FILTER (WHERE {_has(w)}) AS {n}_count" for n, w in X.config.ELITE_FAMILIES.items())},
       count(DISTINCT term) / count(*) AS uniqueness, count(*) FILTER (WHERE length(term) > 20) / count(*) AS long_ratio,
       max(CAST({_has(X.config.UNLIMITED_BUDGET)} AS INTEGER)) AS has_unlimited_budget,
       max(CAST({_has(X.config.ELITE_FAMILIES["luxury"])} AS INTEGER)) AS has_luxury,
       max(CAST({_has(X.config.ELITE_FAMILIES["intent"])} AS INTEGER)) AS has_intent FROM mentions GROUP BY client_id""")
def stat_features_elite(spark, folder):
    return X.stat_features_elite(mentions(spark, folder))


_DERIVED = """
SELECT client_id, n AS num_concepts, u AS unique_concepts, round(n / greatest(u, 1), 6) AS repeat_rate, CAST(n > {active} AS INTEGER) AS is_active,
       CAST(n < {risk} AS INTEGER) AS is_at_risk, n * 1000 AS engagement, round(u / greatest(n, 1), 6) AS diversity, n * n AS square,
       round(ln(1 + n), 6) AS log_n, round(sqrt(n), 6) AS sqrt_n, round(1 / greatest(n, 1), 6) AS inverse,
       round(n * (u / greatest(n, 1)), 4) AS spread, round(n * 1000 / greatest(u, 1), 4) AS engagement_per_concept,
       round(n / greatest(u, 1) * (n * 1000), 4) AS weighted_engagement FROM c"""


def _rounded(df):
    digits = {"repeat_rate": 6, "diversity": 6, "log_n": 6, "sqrt_n": 6, "inverse": 6, "spread": 4, "engagement_per_concept": 4, "weighted_engagement": 4}
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in df.columns])


@query("stat_features_inference", "WITH " + _MENTIONS + """,
c AS (SELECT client_id, count(*) AS n, count(DISTINCT term) AS u FROM mentions GROUP BY client_id)""" + _DERIVED.format(active=5, risk=2))
def stat_features_inference(spark, folder):
    return _rounded(X.stat_features_inference(mentions(spark, folder)))


@query("text_features", with_tables("notes", r""",
w AS (SELECT note_id AS client_id, list_filter(regexp_split_to_array(coalesce(nullif(text, ''), 'unknown'), '\s+'), lambda x: x <> '') AS w FROM notes),
c AS (SELECT client_id, len(w) AS n, len(list_distinct(w)) AS u FROM w)""" + _DERIVED.format(active=10, risk=3)))
def text_features(spark, folder):
    made = _rounded(X.text_features(t.notes(spark, folder), "text", "note_id"))
    return made.select(*[F.col(c).cast("bigint").alias(c) if c in ("num_concepts", "unique_concepts", "engagement", "square") else c for c in made.columns])


@query("diversity_entropy", "WITH " + _MENTIONS + """,
c AS (SELECT client_id, term, count(*) AS n FROM mentions GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY client_id) AS total FROM c)
SELECT client_id, round(-sum(n / total * ln(n / total)), 6) AS entropy, max(n) AS max_freq, count(*) FILTER (WHERE n = 1) AS singletons,
       count(*) FILTER (WHERE n > 2) AS repeated FROM s GROUP BY client_id""")
def diversity_entropy(spark, folder):
    found = X.diversity(mentions(spark, folder))
    return found.withColumn("entropy", F.abs("entropy"))


@query("cooccurrence_pairs", "WITH " + _MENTIONS + """,
d AS (SELECT DISTINCT client_id, term FROM mentions)
SELECT x.term AS a, y.term AS b, count(*) AS pairs FROM d x JOIN d y ON x.client_id = y.client_id AND x.term < y.term
GROUP BY ALL ORDER BY pairs DESC, a, b LIMIT 50""")
def cooccurrence_pairs(spark, folder):
    return X.cooccurrence(mentions(spark, folder), 50)


@query("cooccurrence_mentions", "WITH " + _MENTIONS + """,
d AS (SELECT client_id, term, count(*) AS n FROM mentions GROUP BY ALL)
SELECT x.term AS a, y.term AS b, CAST(sum(CASE WHEN x.term = y.term THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END) AS BIGINT) AS pairs
FROM d x JOIN d y ON x.client_id = y.client_id AND x.term <= y.term GROUP BY ALL HAVING pairs > 0 ORDER BY pairs DESC, a, b LIMIT 100""")
def cooccurrence_mentions(spark, folder):
    return X.cooccurrence(mentions(spark, folder), 100, multiset=True)


@query("one_hot", with_tables("client_concepts", """
SELECT client_id, max(CAST(label = 'red ring' AS INTEGER)) AS has_red_ring, max(CAST(label = 'hot rod' AS INTEGER)) AS has_hot_rod
FROM client_concepts GROUP BY client_id"""))
def one_hot(spark, folder):
    return X.one_hot(t.client_concepts(spark, folder), ["red ring", "hot rod"])


@query("pair_features", with_tables("client_concepts", """
SELECT client_id, max(CAST(label = 'red ring' AS INTEGER)) * max(CAST(label = 'hot rod' AS INTEGER)) AS pair_0,
       max(CAST(label = 'old gear' AS INTEGER)) * max(CAST(label = 'new bolt' AS INTEGER)) AS pair_1 FROM client_concepts GROUP BY client_id"""))
def pair_features(spark, folder):
    return X.pair_features(t.client_concepts(spark, folder), [("red ring", "hot rod"), ("old gear", "new bolt")])


def _rule_sql(elite):
    weights = X.config.ELITE_PURCHASE_WEIGHTS if elite else X.config.FAST_PURCHASE_WEIGHTS
    start, adds, floor = X.config.ELITE_VALUE_WEIGHTS if elite else X.config.FAST_VALUE_WEIGHTS
    p = " + ".join(f"max(CAST({_has(w)} AS INTEGER)) * {x}::DOUBLE" for w, x in weights)
    v = " + ".join(f"max(CAST({_has(w)} AS INTEGER)) * {x}::DOUBLE" for w, x in adds)
    return "WITH " + _MENTIONS + f"""
SELECT client_id, round(greatest(0.1::DOUBLE, least({0.95 if elite else 0.9}::DOUBLE, 0.3::DOUBLE + {p})), 4) AS purchase_score,
       greatest({floor}::DOUBLE, {start}::DOUBLE + {v}) AS value_score FROM mentions GROUP BY client_id"""


@query("rule_scores", _rule_sql(False))
def rule_scores(spark, folder):
    return X.rule_scores(mentions(spark, folder))


@query("rule_scores_elite", _rule_sql(True))
def rule_scores_elite(spark, folder):
    return X.rule_scores(mentions(spark, folder), elite=True)


@query("client_vocabulary", "WITH " + _MENTIONS + r""",
toks AS (SELECT client_id, list_filter(regexp_extract_all(term, '[A-Za-z0-9_]+'), lambda w: length(w) > 1) AS w FROM mentions),
terms AS (SELECT client_id, unnest(w) AS term FROM toks
          UNION ALL SELECT client_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM toks),
c AS (SELECT client_id, term, count(*) AS tf FROM terms WHERE term IS NOT NULL GROUP BY ALL),
n AS (SELECT count(DISTINCT client_id) AS n FROM mentions)
SELECT term, round(ln((1 + n) / (1 + count(*))) + 1, 6) AS idf FROM c, n GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= 0.8 * n
ORDER BY sum(tf) DESC, term LIMIT 60""")
def client_vocabulary(spark, folder):
    rows = X.fit_vocabulary(mentions(spark, folder), 60)
    table = F.array(*[F.struct(F.lit(a).alias("term"), F.lit(b).alias("idf")) for a, b in rows])
    return spark.range(1).select(F.explode(table).alias("v")).select("v.term", F.round("v.idf", 6).alias("idf"))


def _outcomes(spark, folder):
    """Predictions and outcomes of a client from its orders: shares stand for probabilities, sums for value."""
    acts = t.client_actions(spark, folder)
    return acts.groupBy("client_id").agg(
        (F.count_if("is_completed") / F.count("*")).alias("purchase_prob"), (F.count_if(F.col("priority") == "low") / F.count("*")).alias("churn_risk"),
        F.round(F.sum("amount"), 2).alias("predicted_clv"), F.max(F.col("is_completed").cast("int")).alias("purchased_actual"),
        F.max((F.col("priority") == "low").cast("int")).alias("churned_actual"),
    ).withColumn("value_segment", cut_value_segment(F.col("predicted_clv")))


_OUTCOMES = """,
o AS (SELECT client_id, count(*) FILTER (WHERE is_completed) / count(*) AS p, count(*) FILTER (WHERE priority = 'low') / count(*) AS c,
             round(sum(amount), 2) AS v, max(CAST(is_completed AS INTEGER)) AS pa, max(CAST(priority = 'low' AS INTEGER)) AS ca FROM client_actions GROUP BY client_id)
"""


@query("predictions_report", with_tables("client_actions", _OUTCOMES + """
SELECT count(*) AS clients, round(avg(p), 4) AS avg_purchase, count(*) FILTER (WHERE p > 0.7) AS high_intent,
       count(*) FILTER (WHERE p > 0.4 AND p <= 0.7) AS medium_intent, count(*) FILTER (WHERE p <= 0.4) AS low_intent, round(avg(c), 4) AS avg_churn,
       count(*) FILTER (WHERE c > 0.8) AS critical, count(*) FILTER (WHERE c > 0.6 AND c <= 0.8) AS at_risk,
       count(*) FILTER (WHERE c > 0.3 AND c <= 0.6) AS monitor, count(*) FILTER (WHERE c <= 0.3) AS safe,
       round(avg(v), 2) AS avg_clv, round(median(v), 2) AS median_clv, round(sum(v), 2) AS total_clv FROM o"""))
def predictions_report(spark, folder):
    return D.predictions_report(_outcomes(spark, folder))


@query("predictions_by_segment", with_tables("client_actions", _OUTCOMES + """
SELECT CASE WHEN v <= 3000 THEN 'Low Value' WHEN v <= 7000 THEN 'Medium Value' WHEN v <= 15000 THEN 'High Value' ELSE 'VIP' END AS value_segment,
       count(*) AS clients, round(avg(v), 2) AS avg_clv FROM o GROUP BY 1"""))
def predictions_by_segment(spark, folder):
    return D.predictions_by_segment(_outcomes(spark, folder))


@query("prediction_accuracy", with_tables("client_actions", _OUTCOMES + """
SELECT count(*) AS rows, round(avg(CAST(CAST(p > 0.5 AS INTEGER) = pa AS INTEGER)), 4) AS purchase_accuracy,
       round(avg(CAST(CAST(c > 0.5 AS INTEGER) = ca AS INTEGER)), 4) AS churn_accuracy FROM o"""))
def prediction_accuracy(spark, folder):
    both = _outcomes(spark, folder)
    predicted = both.select("client_id", (F.col("purchase_prob") > 0.5).cast("int").alias("will_purchase"), (F.col("churn_risk") > 0.5).cast("int").alias("will_churn"))
    actual = both.select("client_id", "purchased_actual", "churned_actual")
    return M.prediction_accuracy(M.collect_labels(predicted, actual))


def training_rows(spark, folder, elite=False):
    seen = mentions(spark, folder)
    coded = X.code_mentions(seen)
    model = S.fit_features(coded, "elite" if elite else "fast")
    return S.feature_matrix(coded, model).join(X.rule_labels(seen, elite), "client_id").persist()


@query("train_and_score")
def train_and_score(spark, folder):
    """Train the three models on rule labels and score every client. Rows only: the models are seeded, not exact."""
    rows = training_rows(spark, folder)
    purchase, _ = M.train_purchase(rows, trees=10, depth=5)
    churn, _ = M.train_churn(rows, trees=10, depth=5)
    clv, _ = M.train_clv(rows, trees=10, depth=5)
    return M.predict(rows.select("client_id", "features"), purchase, churn, clv)


@query("ensemble_scores")
def ensemble_scores(spark, folder):
    rows = training_rows(spark, folder, elite=True)
    models, _ = M.ensemble_classifier(rows, "purchased", trees=10, depth=5)
    return M.vote_classes(models, rows.select("client_id", "features")).select("client_id", "probability_mean", "prediction")


# ---- whole feature sets, value by value -----------------------------------------------------------------

_LONG = "p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_size"
for _from, _to in _WORDS.items():
    _LONG = f"replace({_LONG}, '{_from}', '{_to}')"


def _long_mentions(spark, folder):
    """Clients mention whole descriptions of parts, so that there are words enough for 800 features."""
    alias = F.concat_ws(" ", "p_name", "p_type", "p_brand", F.col("p_size").cast("string"))
    for old, new in _WORDS.items():
        alias = F.replace(alias, F.lit(old), F.lit(new))
    parts = t.read(spark, folder, "part").select("p_partkey", alias.alias("matched_alias"))
    lines = t.read(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    orders = t.read(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("client_id"))
    bought = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return bought.select("client_id", "matched_alias")


def _set_sql(kind):
    """The set spelled out: n-grams, weights, unit length, statistics and pairs, numbered in the order of blocks."""
    p = S.PROFILES[kind]
    runs = " UNION ALL ".join(
        f"SELECT client_id, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i : i + {n - 1}], ' '))) AS term FROM toks"
        for n in range(1, p.words + 1))
    tf = "1 + ln(tf)" if p.sublinear else "tf"
    if kind == "elite":
        stats = [
            "count(*)", "count(DISTINCT term)", "sum(length(term)) + count(*) - 1",
            *[f"count(*) FILTER (WHERE {_has_low(w)})" for w in X.config.ELITE_FAMILIES.values()],
            "count(DISTINCT term) / count(*)", "count(*) FILTER (WHERE length(term) > 20) / count(*)",
            f"max(CAST({_has_low(X.config.UNLIMITED_BUDGET)} AS INTEGER))",
            f"max(CAST({_has_low(X.config.ELITE_FAMILIES['luxury'])} AS INTEGER))", f"max(CAST({_has_low(X.config.ELITE_FAMILIES['intent'])} AS INTEGER))",
        ]
    elif kind == "fast":
        stats = ["count(*)", "count(DISTINCT term)", *[f"count(*) FILTER (WHERE {_has_low(w)})" for w in X.config.FAST_FAMILIES.values()]]
    else:
        stats = ["count(*)", "count(DISTINCT term)", "count(DISTINCT term) / count(*)"]
    shown = ", ".join(f"CAST({s} AS DOUBLE)" for s in stats)
    times = "CASE WHEN x.term = y.term THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END" if p.by_mention else "1"
    own = "<=" if p.by_mention else "<"
    n_terms = "(SELECT count(*) FROM names)" if p.every_term else "0"
    n_vocab, n_pairs, n_stats = "(SELECT count(*) FROM vocabulary)", "(SELECT count(*) FROM pairs)", str(len(stats))
    tfidf_at = n_terms
    stats_at = f"{n_terms} + {n_vocab}" + (f" + {n_pairs}" if kind == "advanced" else "")
    pairs_at = f"{n_terms} + {n_vocab}" + ("" if kind == "advanced" else f" + {n_stats}")
    blocks = [
        f"SELECT client_id, {tfidf_at} + i AS position, w / sqrt(sum(w * w) OVER (PARTITION BY client_id)) AS value FROM weights",
        f"SELECT client_id, {stats_at} + unnest(range({n_stats})) AS position, unnest([{shown}]) AS value FROM mentions GROUP BY client_id",
    ]
    if p.pairs:
        blocks.append(f"""SELECT x.client_id, {pairs_at} + i AS position, 1 AS value FROM pairs JOIN c x ON x.term = a JOIN c y ON y.term = b AND y.client_id = x.client_id""")
    if p.every_term:
        blocks.append("SELECT client_id, i AS position, 1 AS value FROM c JOIN names USING (term)")
    if kind == "elite":
        blocks.append(f"""SELECT client_id, {n_vocab} + {n_stats} + {n_pairs} + unnest(range(4)) AS position,
          unnest([round(-sum(n / total * ln(n / total)), 6), max(n), count(*) FILTER (WHERE n = 1), count(*) FILTER (WHERE n > 2)]) AS value
          FROM (SELECT *, sum(n) OVER (PARTITION BY client_id) AS total FROM c) GROUP BY client_id""")
    return f"""
WITH mentions AS (SELECT o_custkey AS client_id, {_LONG} AS term FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
c AS (SELECT client_id, term, count(*) AS n FROM mentions GROUP BY ALL),
names AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS i FROM (SELECT DISTINCT term FROM c)),
toks AS (SELECT client_id, list_filter(regexp_extract_all(lower(term), '[a-z0-9_]+'), lambda w: length(w) > 1) AS w FROM mentions),
grams AS (SELECT client_id, term, count(*) AS tf FROM ({runs}) GROUP BY ALL),
chosen AS (SELECT term, count(*) AS df FROM grams GROUP BY term
  HAVING df >= {p.min_df} AND df <= {p.max_df} * (SELECT count(DISTINCT client_id) FROM mentions) ORDER BY sum(tf) DESC, term LIMIT {p.features}),
vocabulary AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS i,
  ln((1 + (SELECT count(DISTINCT client_id) FROM mentions)) / (1 + df)) + 1 AS idf FROM chosen),
weights AS (SELECT client_id, i, ({tf}) * idf AS w FROM grams JOIN vocabulary USING (term)),
best AS (SELECT x.term AS a, y.term AS b, sum({times}) AS n FROM c x JOIN c y ON x.client_id = y.client_id AND x.term {own} y.term
  GROUP BY ALL HAVING sum({times}) > 0 ORDER BY n DESC, a, b LIMIT {p.pairs}),
pairs AS (SELECT a, b, row_number() OVER (ORDER BY n DESC, a, b) - 1 AS i FROM best)
SELECT client_id, CAST(position AS INTEGER) AS position, round(CAST(value AS DOUBLE), 6) AS value
FROM ({" UNION ALL ".join(blocks)}) WHERE value <> 0"""


def _has_low(words):
    return "(" + " OR ".join(f"contains(lower(term), '{w.lower()}')" for w in words) + ")"


def _set_values(spark, folder, kind, **changes):
    seen = X.code_mentions(_long_mentions(spark, folder))
    matrix = S.feature_matrix(seen, S.fit_features(seen, kind, **changes))
    cells = matrix.select("client_id", F.explode(S.vector_items(F.col("features"))).alias("x"))
    return cells.select("client_id", "x.position", F.round(F.abs("x.value"), 6).alias("value"))


@query("feature_vectors_fast", _set_sql("fast"))
def feature_vectors_fast(spark, folder):
    return _set_values(spark, folder, "fast")


@query("feature_vectors_elite", _set_sql("elite"))
def feature_vectors_elite(spark, folder):
    return _set_values(spark, folder, "elite")


@query("feature_vectors_advanced", _set_sql("advanced"))
def feature_vectors_advanced(spark, folder):
    """Without the embedding, whose hashes SQL does not know; a test holds it to brute force."""
    return _set_values(spark, folder, "advanced", dims=0)
