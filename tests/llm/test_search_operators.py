"""Toxicity, conversation repair and collocations against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteworks.llm import collocations, repair, toxicity

# ---- conversation repair --------------------------------------------------------------------------

INITIALS = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}


def cheapest(rows: str) -> tuple[int, str]:
    """Best (cost, edits) by uniform-cost search over places and states; edits in ASCII order break ties."""
    layer = {0: (0, "")}
    follow = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}

    def inserts(layer):
        out = dict(layer)
        for _ in range(3):
            for state, (cost, edits) in list(out.items()):
                way = (cost + 5, edits + "I")
                to = follow[state][1]
                if to not in out or way < out[to]:
                    out[to] = way
        return out

    for c in rows:
        new: dict[int, tuple[int, str]] = {}
        for state, (cost, edits) in inserts(layer).items():
            ways = [(cost + 2, edits + "D", state)]
            if c != "-":
                late = 5 if c.isupper() else 0
                ways.append((cost + late + 1, edits + "R", follow[state][1]))
                low = c.lower()
                if state == 0 and low == "s":
                    ways.append((cost + late, edits + "K", 1))
                elif low == follow[state][0][0]:
                    ways.append((cost + late, edits + "K", follow[state][1]))
            for a, b, to in ways:
                if to not in new or (a, b) < new[to]:
                    new[to] = (a, b)
        layer = new
    return min(way for state, way in inserts(layer).items() if state in (0, 3))


def test_search_finds_the_cheapest_ascii_least_edits():
    rng = random.Random(1)
    for _ in range(3000):
        rows = "".join(rng.choice("suauaua-xSUAX") for _ in range(rng.randint(0, 10)))
        want = cheapest(rows)
        assert repair.search(rows) == want, rows
        cuts = sorted(rng.sample(range(1, len(rows) + 1), min(len(rows), 2)))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)]) if b > a]
        if parts:
            cost, edits = repair.join_tables([repair.segment_table(p) for p in parts])
            assert (cost, "".join(edits)) == want, (rows, parts)


def test_search_is_quick_on_long_faulty_conversations():
    rng = random.Random(2)
    for rows in ("u" * 2000, "ua" * 500 + "a" * 200 + "u" * 201, "".join(rng.choice("uauauaua-xSUA") for _ in range(600))):
        assert repair.search(rows) == cheapest(rows)


def expected(rows: list[tuple]) -> dict:
    """The contract in plain Python: ``rows`` are (conv, turn, role, text)."""
    out = {conv: None for conv, *_ in rows}
    damaged = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        rule = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if rule == 0:
            continue
        text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
        damaged += [(conv, turn, "user" if rule == 4 else role, text)] * (2 if rule == 3 else 1)
    order = sorted(damaged, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    for conv, group in groupby(order, key=lambda r: r[0]):
        group, seen, codes, count = list(group), set(), "", Counter()
        for _, _, role, text in group:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            count[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        initials = [r[2][:1] for r in group]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [r[1] for r in group if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, edits = cheapest(codes)
        lines, state, i = [], 0, 0
        for e in edits:
            to = {0: 2, 1: 2, 2: 3, 3: 2}[state]
            name = "assistant" if to == 3 else "user"
            if e == "I":
                lines.append(name + ":")
                state = to
                continue
            _, _, role, text = group[i]
            if e == "R":
                lines.append(f"{name}:{text}")
                state = to
            elif e == "K":
                lines.append(f"{role}:{text}")
                state = 1 if role[0] == "s" else to
            i += 1
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, edits, digest)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {k: v or nothing for k, v in out.items()}


CONVERSATION = "conv_id long, turn long, role string, text string, conv string, `a.b` string"


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(4)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            text = rng.choice(["One. Two.", "no end", "", " \t", "Fine!", "été?", "Same.", f"Text {rng.randint(0, 99)}."])
            rows.append((conv, turn * rng.choice([1, 1, 2]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), text))
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"Turn {t % 37}.") for t in range(300)]
    rows += [(101, None, None, None), (101, 3, "", "Yes."), (None, 1, "user", "Hi."), (None, None, "assistant", "Hm."), (102, 5, "user", "x" * 50_000 + ".")]
    return rows + rows[7:12]


def test_repair(spark, conversations):
    table = spark.createDataFrame([(*r, "p", "q") for r in conversations], CONVERSATION)
    want = expected(conversations)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_damaged(table).collect()}
    assert got == want
    assert repair.repair_damaged(table.limit(0)).count() == 0


def test_repair_over_many_segments(spark, conversations):
    table = spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string")
    want = expected(conversations)
    got = repair.repair(repair.damage(table.repartition(7)), rows_limit=4, bytes_limit=200).collect()
    assert {r.conv: tuple(r)[1:] for r in got} == {k: v for k, v in want.items() if k in {r.conv for r in got}}
    assert len(got) >= len(want) - 6


# ---- collocations ---------------------------------------------------------------------------------


def phrase_counts(texts, least, depth=5):
    words, found = Counter(), {}
    for lang, text in texts:
        lang = lang or "und"
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, depth + 1):
                for i in range(len(w) - n + 1):
                    found.setdefault(lang, Counter())[tuple(w[i : i + n])] += 1
    return words, {k: {p: a for p, a in v.items() if a >= least} for k, v in found.items()}


def best_phrases(texts, least, top):
    words, found = phrase_counts(texts, least)
    out = []
    for lang, f in found.items():
        rows = []
        for p, a in f.items():
            if len(p) < 2 or any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in f.items()):
                continue
            score, k = min((1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        rows.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, words[lang], -s) for i, (s, a, p, l, r) in enumerate(rows[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_texts():
    rng = random.Random(6)
    words = ["the", "Of", "new", "york", "city", "été", "a*b", "\x01odd", "rouge", "of"]
    out = [(rng.choice(["en", "fr", None]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b"]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    out += [("en", None), ("en", ""), (None, " .;! "), ("fr", "x " * 5000)]
    return out + out[3:6]


def test_collocations(spark, phrase_texts):
    docs = spark.createDataFrame([(l, t, "n", "m") for l, t in phrase_texts], "lang string, text string, n string, `a.b` string")
    want = best_phrases(phrase_texts, 8, 40)
    assert len(want) > 60
    for size in (300, 1 << 20):  # many shards, and one a task
        got = collocations.collocations(docs, least=8, top=40, shard_words=size).collect()
        assert sorted(map(tuple, got)) == want
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.where("text IS NULL")).count() == 0


def test_three_words_of_frequent_pairs_are_counted_before_they_are_listed(spark, monkeypatch):
    """Pairs are frequent here, but hardly a phrase of three words: few of these may leave the shards."""
    rows = [(f"a{i % 60} m. m b{i % 60}. x y z",) for i in range(1200)] + [(f"a{i} m b{(7 * i) % 60}",) for i in range(60)]
    docs = spark.createDataFrame(rows, "text string").withColumn("lang", F.lit("en")).repartition(3)
    made, listed = {}, collocations._frequent

    def counted(found, keys, least):
        made[len(keys)] = found.count()
        return listed(found, keys, least)

    monkeypatch.setattr(collocations, "_frequent", counted)
    shards = collocations.index_shards(docs)
    phrases, _ = collocations.count_phrases(shards, least=20)
    sizes = {r["n"]: r["count"] for r in phrases.groupBy(F.size("g").alias("n")).count().collect()}
    assert sizes[2] == 122 and sizes[3] == 1  # a. m, m b., x y, y z; x y z
    assert made[3] <= 6  # the 60 windows "a. m b." occur once each


def test_slots_rule_out_nothing_frequent():
    rng = np.random.default_rng(7)
    texts = [np.concatenate(([0], rng.integers(0, 9, 400), [0])) for _ in range(3)]
    marks = rng.integers(0, 1 << 32, 8, np.uint32).tobytes()
    slots = np.concatenate([collocations.slots_of(t, marks, 16) for t in texts])
    windows = np.concatenate([np.column_stack([t[i : len(t) - 2 + i] for i in range(3)]) for t in texts])
    slot_of = {}
    for window, slot in zip(map(tuple, windows.tolist()), slots.tolist()):
        assert slot_of.setdefault(window, slot) == slot and 0 <= slot < 1 << 16
    assert len(collocations.slots_of(np.zeros(2, np.int64), marks, 16)) == 0



def test_exact_scores_beyond_64_bits(spark):
    counts = (7 * 10**14, 9 * 10**15 - 1, 8 * 10**14 + 1, 10**15 - 3)
    row = spark.createDataFrame([counts], "a long, n long, l long, r long")
    got = row.select(collocations._whole_quotient(*(F.col(c) for c in "anlr"))).first()[0]
    assert got == 1000 * counts[0] * counts[1] // (counts[2] * counts[3])


def test_intervals_grow_on_both_sides():
    rng = np.random.default_rng(8)
    ids = np.concatenate(([0], rng.integers(0, 5, 400), [0]))
    index = collocations.Index(ids)
    wanted = np.array([False, True, True, True, True])
    order, back = collocations.sort_rows(ids), collocations.sort_rows(ids[::-1])
    live = index.words(np.flatnonzero(wanted))
    for side in ("right", "left", "left", "right"):
        live = index.extend(live, side, wanted)
        n = live.words.shape[1]
        real = Counter(tuple(ids[i : i + n].tolist()) for i in range(len(ids) - n + 1) if (ids[i : i + n] > 0).all())
        assert {tuple(w): c for w, c in zip(live.words.tolist(), live.count.tolist())} == real
        for w, a, b, c in zip(live.words, live.forward, live.backward, live.count):
            assert all((ids[p : p + n] == w).all() for p in order[a : a + c])
            assert all((ids[::-1][p : p + n] == w[::-1]).all() for p in back[b : b + c])


# ---- toxicity -------------------------------------------------------------------------------------


def apart(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_agrees_with_edit_distances():
    rng = random.Random(10)
    terms = [("abcab", False), ("abc", False), ("cabbage", False), ("bacabacab", False), ("abca", True), ("bbcabc", True)]
    scanner = toxicity.Scanner(terms)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 11))) for _ in range(3000)]
    words += ["".join(x for x in t if rng.random() > 0.15) or "d" for t, _ in terms for _ in range(50)]
    for w in words:
        best = []
        for k, (term, stem) in enumerate(terms):
            d = min(apart(w[:i], term) for i in range(1, len(w) + 1)) if stem else apart(w, term)
            if d <= toxicity.edits_allowed(term, stem):
                best.append((d, k))
        assert [(e, t) for _, _, t, e, _ in scanner.scan([w])[0]] == ([min(best)] if best else []), w


def test_places_and_quotation():
    scanner = toxicity.Scanner([("nitwit", False)])
    text = 'İ You NITWIT, you nitwlt! He said "nitwit" once.\nn*twit'
    hits = scanner.scan([None, text, ""])[1]
    assert [text[a:b] for a, b, *_ in hits] == ["NITWIT", "nitwlt", "nitwit", "n*twit"]
    assert [e for *_, e, _ in hits] == [0, 1, 0, 1]
    assert [q >= 0.5 for *_, q in hits] == [False, False, True, False]
    assert toxicity.Scanner([("nitwit", False)], frozenset({"nitwlt"})).scan(["nitwlt"]) == [[]]


@pytest.fixture(scope="module")
def toxic_table(spark):
    rng = random.Random(12)
    plain = [f"w{i}q" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(plain, k=rng.randint(8, 60))
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["nitwit", "dunderhead", "blockhead"])
        rows.append((i, " ".join(words), "c"))
        labels.append((i, int(bad)))
    copied = " ".join(f"copied{j}" for j in range(80)) + " nitwit"
    rows += [(1000 + i, copied, "c") for i in range(60)]  # a copied toxic text makes none of its other words toxic
    labels += [(1000 + i, 1) for i in range(60)]
    rows += [(2000, "w1q w2q nitwitt w5q", "c"), (2001, "copied3 copied4 w3q", "c"), (2002, None, "c"), (2003, "", "c"), (None, "you dunderhaed!", "c"),
             (2004, "w1q " * 100_000 + "blockhead", "c"), (2005, 'w1q w2q the word "blockhead" w7q', "c")]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, toxicity string")
    return docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"), dict(labels)


def test_toxicity(spark, toxic_table):
    docs, labelled, truth = toxic_table
    model = toxicity.fit(docs, labelled.where("doc_id % 3 <> 1 OR doc_id IS NULL"))
    assert {t for t, _ in model.terms} <= {"nitwit", "dunderhead", "blockhead", "nitw", "dund", "bloc"} | {t for t, s in model.terms if s}
    got = toxicity.score_texts(docs, model, ["doc_id", "toxicity"], name="found").collect()
    assert len(got) == docs.count() and got[0].__fields__ == ["doc_id", "toxicity", "found"]
    assert all((r.found.score >= 0.7) == bool(truth[r.doc_id]) for r in got if r.doc_id in truth)
    by = {r.doc_id: r.found for r in got}
    assert by[2000].score >= 0.7 and by[2004].score >= 0.7 and by[None].score >= 0.7
    assert by[2001].score < 0.7 and by[2002].score < 0.7 and by[2003].score == by[2002].score
    assert by[2005].hits[0].quotation >= 0.5 > by[2004].hits[0].quotation and by[2005].score < by[2004].score
    empty = toxicity.fit(docs.limit(0), labelled.limit(0))
    assert toxicity.score_texts(docs.limit(0), empty, ["doc_id"]).count() == 0
    assert {r.toxicity.score for r in toxicity.score_texts(docs, empty, ["doc_id"]).collect()} == {0.0}
