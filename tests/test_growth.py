"""What is exchanged and kept by queries whose tables grow: results against plain Python, and the plans."""

from __future__ import annotations

import random
import re
import threading
from collections import Counter, defaultdict
from types import SimpleNamespace

from pyspark.sql import functions as F

from noteworks.operators import actions as A
from noteworks.operators import clustering as K
from noteworks.operators import concepts as C
from noteworks.operators import nested as N


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_event_matches(spark):
    """Counted beside the client's concepts: no pair of client and event is exchanged."""
    rng = random.Random(3)
    names = [f"name {i}" for i in range(12)]
    events = [(i, rng.choices(names, k=rng.randint(0, 6))) for i in range(6)] + [(6, None), (7, ["", " Name 1 "]), (7, ["name 2"])]
    people = [(rng.choice([None, *range(30)]), " | ".join(rng.choices([*names, "NAME 3", ""], k=rng.randint(0, 8))), rng.choice([True, False, None]))
              for _ in range(60)] + [(99, None, False)]
    got = A.match_event_clients(spark.createDataFrame(events, "event_id long, concepts array<string>"),
                                spark.createDataFrame(people, "client_id long, top_concepts string, is_deleted boolean"))
    have, want = defaultdict(set), defaultdict(set)
    for client, concepts, deleted in people:
        if not deleted:
            have[client] |= {c.strip().lower() for c in (concepts or "").split("|")} - {""}
    for event, concepts in events:
        want[event] |= {c.strip().lower() for c in concepts or []} - {""}
    met = {(e, c): sorted(want[e] & have[c]) for e in want for c in have if want[e] & have[c]}
    best = {e: max(len(v) for (x, _), v in met.items() if x == e) for e, _ in met}
    rows = {(e, c): (" | ".join(v), round(len(v) / best[e], 3), sum(x == e for x, _ in met)) for (e, c), v in met.items()}
    found = got.collect()
    assert len(found) == len(rows) and None in {r["client_id"] for r in found}
    assert {(r["event_id"], r["client_id"]): (r["match_reason"], r["match_score"], r["matched_count"]) for r in found} == rows
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", _plan(got))
    assert dealt and not [d for d in dealt if "event_id" in d and ("client_id" in d or "_who" in d)]


def test_dictionary_walk(spark):
    """Matches of a dictionary leave the marked text in one linear walk, not by a list folded step by step."""
    texts = [None, "", "no match", "😀 red fox, RED red red fox red", "été rouge " * 300, ""]
    notes = spark.createDataFrame([(i, i, x) for i, x in enumerate(texts)], "note_id long, client_id long, text string")
    names = ["red", "red fox", "été", "rouge"]
    found = C.match_aliases(notes, spark.createDataFrame([(n, "C") for n in names], "alias string, concept_id string"), 3)
    assert "aggregate(" not in _plan(found)
    want = []
    for i, text in enumerate(texts):
        seen = Counter()
        for m in re.finditer(r"\b(?:red fox|red|été|rouge)\b", (text or "").lower()):
            seen[m[0]] += 1
            want += [(i, m[0], m.start(), m.end())] if seen[m[0]] <= 3 else []
    assert [tuple(r) for r in found.select("note_id", "matched_alias", "span_start", "span_end").orderBy("note_id", "span_start").collect()] == want


def test_nested_pages_meet_once(spark):
    """Pages of all kinds are exchanged once by key and page, whatever the number of kinds."""
    rng = random.Random(5)
    parents = [(i, f"p{i}") for i in range(8)] + [(3, "again"), (None, "nobody")]
    kinds = {k: [(rng.choice([None, *range(10)]), n) for n in range(60)] for k in ("a", "b")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = N.nest(spark.createDataFrame(parents, "id long, name string"), "id",
                     {k: (spark.createDataFrame(v, f"id long, {k}_n long"), [f"{k}_n"]) for k, v in kinds.items()}, page=4)
        assert len(re.findall(r"Exchange hashpartitioning\([^)]*page", _plan(out))) <= 1
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = []
    for i, name in parents:
        own = {k: sorted(n for j, n in v if j == i and i is not None) for k, v in kinds.items()}
        pages = max(1, *(-(-len(v) // 4) for v in own.values()))
        want += [(str(i), name, p, *((len(v), v[4 * p : 4 * p + 4]) for v in own.values())) for p in range(pages)]
    got = [(str(r["id"]), r["name"], r["page"], *((r[f"n_{k}"], [x[f"{k}_n"] for x in r[k]]) for k in kinds)) for r in rows]
    assert sorted(got) == sorted(want)


def test_seeded_runs_overlap(spark, monkeypatch):
    """Seeded runs are fitted side by side, and the first of the cheapest wins."""
    met = threading.Barrier(2, timeout=60)

    class Fitted:
        def __init__(self, seed):
            self.seed, self.summary = seed, SimpleNamespace(trainingCost=[3.0, 1.0, 2.0, 1.0][seed - 7])

        def transform(self, data):
            return data.withColumn("cluster_id", F.lit(self.seed))

        def clusterCenters(self):
            return [[float(self.seed)]]

    class Waiting:
        def __init__(self, seed, **_):
            self.seed = seed

        def fit(self, data):
            met.wait()
            return Fitted(self.seed)

    monkeypatch.setattr(K, "KMeans", Waiting)
    rows = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "client_id long, embedding array<double>")
    out, centres = K.kmeans_segments(rows, 2, seed=7, starts=4)
    assert centres == [[8.0]] and {r["cluster_id"] for r in out.collect()} == {8}
