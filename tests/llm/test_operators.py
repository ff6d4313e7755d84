"""The text operators against brute force on small tables with nulls, empties, repeats and long texts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from noteworks.llm import common, hilbert, langid, lm, mixing, pieces, quality, secrets, simhash, sketch, suffixes
from noteworks.llm.queries import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, quality string, secrets string"


def texts() -> list[str | None]:
    rng = random.Random(7)
    words = ["the", "of", "and", "Maison", "rouge", "été", "x" * 40, "token=abcdefghijklmnop", "AKIA" + "A1B2" * 4, "ab12" * 5]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(14)]
    near = base[0] + " tail"
    return [None, "", " ", "one", "two words", *base, near, base[1], base[2][:150] + "\n" + base[3], "▁ mark ▁", "a" * 3000, "é" * 700]


def rows_of(values):
    return [(i if i != 3 else None, t, ["fr", "en", None][i % 3], ["a", "b", None][i % 3], None, "x", "y", "z") for i, t in enumerate(values)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = rows_of(texts())
    return spark.createDataFrame([*rows, rows[7]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    rows = docs.collect()

    def mark(text):
        w = (text or "").encode().lower().split()
        parts = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    marks = [(r.doc_id, mark(r.text)) for r in rows]
    label = list(range(len(marks)))
    for _ in rows:
        for i, (_, a) in enumerate(marks):
            for j, (_, b) in enumerate(marks):
                if (a ^ b).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    least = {g: min((marks[i][0] for i in range(len(marks)) if label[i] == g and marks[i][0] is not None), default=None) for g in label}
    want = Counter((d, f"{m:016x}", least[label[i]]) for i, (d, m) in enumerate(marks))
    assert Counter(tuple(r) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_of_a_dense_class():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 1, np.uint64)[0]
    prints = np.unique(np.array([int(centre) ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)], np.uint64))
    links = simhash.spanning_links(np.zeros(len(prints), np.int64), prints)
    assert len(links) == len(prints) - 1
    pair = np.array([5, 5 ^ 0b111], np.uint64)
    assert (simhash.table_keys(pair)[0] == simhash.table_keys(pair)[1]).any()


def test_pieces(docs, empty):
    import sentencepiece

    path = vocabulary_path()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    v = pieces.Vocabulary(path)
    whole = pieces.encode(docs, path).collect()
    cut = pieces.encode(docs, path, chunk=40).collect()

    def score(ids):
        return None if ids is None else sum(v.score[i] for i in ids)

    assert sorted((r.doc_id is None, r.doc_id or 0, score(r.ids) or 0) for r in whole) == sorted((r.doc_id is None, r.doc_id or 0, score(r.ids) or 0) for r in cut)
    back = pieces.decode(pieces.encode(docs.select("doc_id", "text"), path, chunk=40), path).collect()
    assert Counter(map(tuple, back)) == Counter((r.doc_id, r.text) for r in docs.collect())
    encoded = pieces.encode(docs.select("doc_id", "text"), path)
    both = pieces.decode(encoded, path, keep=True)
    assert both.columns == ["doc_id", "ids", "text"]
    assert Counter((r.doc_id, r.text) for r in both.collect()) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert Counter(str(r.ids) for r in both.collect()) == Counter(str(r.ids) for r in encoded.collect())
    plain = next(r for r in whole if r.doc_id == 5)
    assert model.decode(list(plain.ids)) == texts()[5]
    assert pieces.encode(empty, path).count() == 0
    for text in (" house of red", " été maison"):  # best of all cuts
        best = [0] + [None] * len(text)
        for p in range(len(text)):
            for end, _, s in v.steps(text, p):
                best[end] = best[p] + s if best[end] is None else max(best[end], best[p] + s)
        assert score(np.frombuffer(v.unit(text), np.int32).tolist()) == best[-1]


def test_secrets(docs, empty):
    def github(seed: str) -> str:
        body, value, tail = seed * 15, zlib.crc32((seed * 15).encode()), ""
        for _ in range(6):
            value, d = divmod(value, 62)
            tail = secrets.DIGITS62[d] + tail
        return "ghp_" + body + tail

    machine = secrets.automaton()
    good = github("aZ")
    assert secrets.listed(secrets.scan(f"see {good} and {good[:-1]}!", machine)) == f"checksum:4:{4 + len(good)}"
    for text in ['pass passwd":"short token = x secret=passwd":"abcdefghijklmnop', "ſecret=abcdefghijklmnopq", "AKIA" + "Z" * 13 + " AKIA" + "9" * 14, "API_KEY: 'abc.def/ghi=jkl'"]:
        base = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 12]
        base += [(m.start(), 1, m.end()) for m in secrets.ACCESS.finditer(text) if len(m[0]) >= 18]
        base += [(m.start(), 2, m.end()) for m in secrets.HEX.finditer(text) if len(m[0]) >= 16]
        assert [s for s in secrets.scan(text, machine) if s[1] < 3] == sorted(base)
    found = secrets.scan_secrets(docs, mask="[secret]").collect()
    assert len(found) == docs.count() and not any("AKIAA1B2" in (r.secrets.clean_text or "") for r in found)
    assert secrets.scan_secrets(empty).count() == 0


def test_langid(spark, empty):
    rng = random.Random(3)
    own = {"en": "the and of with thing", "de": "und der ist nicht schön", "fr": "le la est où été"}
    rows = [(i, " ".join(rng.choices(own[l].split(), k=12)), l) for i, l in enumerate(list(own) * 20)]
    rows += [(90, None, "en"), (91, "123 !", "de"), (92, "the and of", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, ["doc_id"], F.col("doc_id") < 30).collect()}
    assert all(got[i].lang_pred == l for i, _, l in rows[:60]) and got[92].lang_pred == "en"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (90, 91))
    assert langid.identify(empty, ["doc_id"], F.lit(True)).count() == 0


def test_lm(docs, empty):
    marked = docs.select("doc_id", "text", (F.col("doc_id") % 4 == 2).alias("held_out"))
    rows = marked.collect()
    tokens = [[*(r.text or "").encode().lower().split(), None] for r in rows]
    counts = Counter(w for r, t in zip(rows, tokens) if not r.held_out for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((len(t), sum(counts[w] > 0 for w in t), round(sum(log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for t in tokens)
    got = lm.score_texts(marked).collect()
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert lm.score_texts(empty.select("doc_id", "text", F.lit(False).alias("held_out"))).count() == 0


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, ["a", "b", "c", None][min(3, i % 7)], rng.randint(0, 400)) for i in range(3000)]
    mixed = mixing.mix_sources(spark.createDataFrame([*rows, rows[0]], "id long, source string, size int"))
    got = mixed.collect()
    assert len(got) == 3001 and {r.copies for r in got} <= {0, 1, 2, 3}
    for source in ("a", "b", "c", None):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 400
        assert own[0].target <= 3 * own[0].source_size
    assert abs(sum({r.source: r.target for r in got}.values()) - sum(r.size for r in got)) < 1e-6
    assert sorted(map(tuple, mixed.repartition(5).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mix_sources(spark.createDataFrame([], "id long, source string, size int")).count() == 0


def test_sketch(docs, empty):
    def cut(text):
        lines = [re.findall(r"[^\x20\x09-\x0D]+", x) for x in (text or "").split("\n")]
        return {" ".join(w[i : i + 32]) for w in lines for i in range(0, len(w), 32)}

    def like(a, b):
        return 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))

    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    want = []
    for r, after in zip(rows, rows[1:] + rows[:1]):
        t, n = r.text or "", after.text or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        want.append((r.doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(cut(t), cut(edited)), 9), round(like(cut(t), cut(n)), 9)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in sketch.compare_versions(docs).collect()]
    assert Counter(got) == Counter(want)
    assert sketch.compare_versions(empty).count() == 0


def test_sketch_peels_the_digests(spark):
    """Digests that differ, their side and the retries, against sets; repeats count; printed sketches read back."""
    rng = random.Random(11)
    lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, 40))) for _ in range(3000)]

    def digests(text):
        words = [re.findall(r"[^\x20\x09-\x0D]+", x) for x in text.split("\n")]
        found = [xxhash.xxh64_intdigest(" ".join(w[i : i + 32]).encode(), 42) for w in words for i in range(0, len(w), 32)]
        return {d - (1 << 64) if d >> 63 else d for d in found}

    values = ["\n".join(x) for x in (lines[:3], lines[1:5], lines[:900], lines[10:905], lines[1000:1030], lines[1030:3000], lines[1030:3000:2])]
    got = sketch.compare_versions(spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")).collect()
    for r in got:
        a, b = digests(values[r.doc_id]), digests(values[(r.doc_id + 1) % len(values)])
        assert (set(r.following.lost), set(r.following.new)) == (a - b, b - a)
        assert (len(r.following.lost), len(r.following.new)) == (len(a - b), len(b - a))
    twice = spark.createDataFrame([(f"{lines[0]}\n{lines[1]}", f"{lines[1]}\n{lines[0]}\n{lines[1]}")], "a string, b string")
    cells = twice.select(*[sketch.sketch(sketch.digests(F.col(c))).alias(c) for c in "ab"])
    stored = cells.select(*[sketch.read_printed(sketch.printed(F.col(c))).alias(c) for c in "ab"])
    assert stored.collect() == cells.collect()
    found = stored.select(sketch.peel(sketch.subtract(F.col("a"), F.col("b"))).alias("d")).first().d
    assert (len(found.lost), len(found.new)) == (1, 1)


def test_quality(docs, empty):
    got = quality.apply_rules(docs).select("text", "quality.*").collect()
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(8)}
        assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(w), len(covered), sum(map(len, w)))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert quality.apply_rules(empty).count() == 0


def test_quality_judges_repeated_lines_of_short_texts(spark):
    """One line of two comes twice: the rule holds for texts of any number of lines."""
    words = " ".join(f"word{i} the" for i in range(30))
    rows = spark.createDataFrame([(0, f"{words}\nshort line\nshort line"), (1, f"{words}\nshort line")], "doc_id long, text string")
    got = {r["doc_id"]: (r["kept"], r["broken"]) for r in quality.apply_rules(rows).select("doc_id", "quality.*").collect()}
    assert got == {0: (False, "repeated_lines"), 1: (True, None)}


def test_suffixes(spark, docs, empty):
    rng = random.Random(9)
    shared = "".join(rng.choice("abcé ") for _ in range(260))
    values = [shared, "q" + shared[30:230] + "z", shared[:99], shared[:100] * 3, "ab" * 300, None, "", *(t for t in texts() if t)]
    values = values + [shared[100:] + "w" * 250 + shared]
    got = suffixes.remove_repeats(spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")).collect()
    seen = set()
    for r, text in zip(sorted(got, key=lambda r: r.doc_id), values):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (
            len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    repeated = suffixes.remove_repeats(docs).collect()
    assert len(repeated) == docs.count()
    assert suffixes.remove_repeats(empty).count() == 0


def test_hilbert(spark, docs, empty):
    cells = spark.createDataFrame([(a, b, c) for a in range(8) for b in range(8) for c in range(8)], "a long, b long, c long")
    path = [(r.a, r.b, r.c) for r in hilbert.curve_index(cells, ["a", "b", "c"], 3).orderBy("curve").collect()]
    assert len({r.curve for r in hilbert.curve_index(cells, ["a", "b", "c"], 3).collect()}) == 512
    assert all(sum(abs(x - y) for x, y in zip(p, q)) == 1 for p, q in zip(path, path[1:]))
    got = hilbert.shard_rows(docs).collect()
    per = Counter(r.shard for r in got)
    assert len(got) == docs.count() and set(per) <= set(range(16)) and max(per.values()) - min(per[s] for s in range(16)) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in per.items())
    assert hilbert.shard_rows(empty).count() == 0


def test_secrets_survive_hostile_texts():
    import base64
    import time

    machine = secrets.automaton()

    def block(kind: str, blob: bytes, headers: str = "") -> str:
        return f"-----BEGIN {kind}-----\n{headers}{base64.b64encode(blob).decode()}\n-----END {kind}-----"

    def field(data: bytes) -> bytes:
        return len(data).to_bytes(4, "big") + data

    openssh = secrets.OPENSSH_MAGIC + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 51) + field(b"s" * 136)
    for text in (block("OPENSSH PRIVATE KEY", openssh), block("RSA PRIVATE KEY", b"\x30\x05hello"),
                 block("RSA PRIVATE KEY", b"e" * 64, "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n")):
        assert secrets.listed(secrets.scan("a " + text, machine)) == f"private_key:2:{2 + len(text)}"
    assert secrets.scan(block("OPENSSH PRIVATE KEY", openssh[:-1]), machine) == []
    deep = base64.urlsafe_b64encode(b"[" * 90_000).decode().rstrip("=")
    head = base64.urlsafe_b64encode(b'{"alg": "x"}').decode().rstrip("=")
    signed = f"{head}.eyJx.y"
    assert secrets.listed(secrets.scan(f"EYJa{signed}", machine)) == f"signed:4:{4 + len(signed)}"
    begin = time.time()
    hostile = ("eyJ" * 300_000, "eyJ" * 300_000 + ".eyJx", f"eyJ{deep}.eyJx.y", "token" + " " * 1_000_000, "token" * 200_000,
               "-----BEGIN PRIVATE KEY-----\n" * 40_000, "-----BEGIN PRIVATE KEY-----\n" + "a:b\n" * 200_000)
    assert all(secrets.scan(text, machine) == [] for text in hostile)
    assert time.time() - begin < 10


def test_langid_functions_travel_by_value(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    langid.letters()
    (tmp_path / "f").write_bytes(cloudpickle.dumps(langid.ngrams))
    code = "import pickle, sys; print(len(pickle.load(open(sys.argv[1], 'rb'))('ab c')))"
    done = subprocess.run([sys.executable, "-c", code, tmp_path / "f"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.stdout.strip() == str(len(langid.ngrams("ab c"))), done.stderr


# ---- the pipeline: every stage against plain Python -----------------------------------------------

PIPELINE = "doc_id long, text string, lang string, source string, n_chars long, copies long, rows int, quality string, secrets string, ids int, `a.b` string, _row string"



def pipeline_rows() -> list[tuple]:
    rng = random.Random(21)
    stops = ["the", "of", "and", "is", "with"]
    out = []

    def text(n: int) -> str:
        return " ".join(rng.choice(stops) if i % 3 == 0 else f"word{rng.randint(0, 3000)}x" for i in range(n))

    for i in range(60):
        own = text(rng.choice([5, 30, 200]))
        out.append((i, own))
        if i % 4 == 0:
            out.append((1000 - i, own))  # an exact copy
        if i % 5 == 0:
            out.append((2000 + i, own + f" tail{i}"))  # a near one
        if i % 6 == 0:
            out.append((3000 + i, own + " token=abcdefghijklmnop AKIA" + "A1B2" * 4))
    out += [(4000, None), (4001, ""), (None, text(40)), (None, None), (4002, text(40_000)), (4003, "\n".join([text(30)] * 2 + [text(5)]))]
    rows = [(d, t, rng.choice(["en", None]), rng.choice(["a", "b", "c", None]), None if t is None else len(t), 7, 8, "q", "s", 9, "dot", "r") for d, t in out]
    return rows + [rows[3], rows[40], rows[40]]


def kept_by_rules(text: str | None) -> bool:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeats = len({i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)})
    if len(w) < 20 or 100 * repeats > 30 * len(w):
        return False
    letters = [c for c in text if c.isalpha()]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (2 <= sum(map(len, w)) / len(w) <= 14 and sum(c in "#*$%&|<>" for c in text) <= 0.1 * len(w)
            and sum(c.isupper() for c in letters) <= 0.4 * len(letters)
            and (len(w) < 50 or sum(x.lower() in quality.STOP_WORDS for x in w) >= 0.02 * len(w))
            and (len(lines) < 5 or len(lines) - len(set(lines)) <= 0.3 * len(lines)))


def simhash_mark(text: str | None) -> int:
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def deduplicated(rows: list[tuple]) -> list[int | None]:
    """The doc_id that stays of each group."""
    marks = [simhash_mark(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 3 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return [min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in sorted(set(group))]


def masked_text(text: str | None) -> str | None:
    if text is None:
        return None
    return re.sub(r"(?:token=[a-z]{12,}|AKIA[A-Z0-9]{14,})", "[secret]", text)


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    rows = pipeline_rows()
    docs = spark.createDataFrame(rows, PIPELINE)
    names = docs.columns
    kept = pipeline.quality_rules(spark, docs, "")
    want = [r for r in rows if kept_by_rules(r[1])]
    assert kept.columns == names and Counter(map(tuple, kept.collect())) == Counter(want) and 60 < len(want) < len(rows) - 10

    single = pipeline.near_dedup(spark, docs, "")
    got = [tuple(r) for r in single.collect()]
    ids = deduplicated(rows)
    assert single.columns == names and Counter(r[0] for r in got) == Counter(ids) and set(got) <= set(rows)
    assert len(ids) < len(rows) - 20
    assert Counter(r[0] for r in pipeline.near_dedup(spark, kept, "").collect()) == Counter(deduplicated(want))

    clean = pipeline.mask_secrets(spark, docs, "")
    expected = [(r[0], masked_text(r[1]), *r[2:4], None if r[1] is None else len(masked_text(r[1])), *r[5:]) for r in rows]
    assert clean.columns == names and Counter(map(tuple, clean.collect())) == Counter(expected)

    mixed = pipeline.mix_sources(spark, docs, "")
    taken = Counter(map(tuple, mixed.collect()))
    assert mixed.columns == names and set(taken) <= set(rows)
    assert all(n <= 3 * rows.count(r) for r, n in taken.items())
    words = {s: sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in ("a", "b", "c", None)}
    goal = dict(zip(("a", "b", "c", None), (5, 2, 1, 5)))
    open_, share, left = set(goal), {}, sum(words.values())
    while True:
        level = left / sum(goal[s] for s in open_)
        over = {s for s in open_ if level * goal[s] > 3 * words[s]}
        if not over:
            break
        for s in over:
            share[s] = 3 * words[s]
            left -= share[s]
        open_ -= over
    share |= {s: level * goal[s] for s in open_}
    longest = max(len((r[1] or "").split()) for r in rows)
    for s in goal:
        assert abs(sum(n * len((r[1] or "").split()) for r, n in taken.items() if r[3] == s) - share[s]) <= longest

    encoded = pipeline.encode_pieces(spark, docs, "")
    assert encoded.columns == ["doc_id", "lang", "source", "n_chars", "copies", "rows", "quality", "secrets", "own_ids", "a.b", "_row", "ids", "n_pieces"]
    back = pieces.decode(encoded.select("doc_id", "ids"), vocabulary_path()).collect()
    assert Counter(map(tuple, back)) == Counter((r[0], r[1]) for r in rows)
    assert all((r.n_pieces is None) if r.ids is None else r.n_pieces == len(r.ids) for r in encoded.collect())
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name


def test_pipeline_as_a_whole(spark, tmp_path):
    import corpus_pipeline as pipeline

    rows = pipeline_rows()
    spark.createDataFrame(rows, PIPELINE).write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path))
    back = pieces.decode(out.select("doc_id", "ids"), vocabulary_path()).collect()
    want = [r for r in rows if kept_by_rules(r[1])]
    ids = set(deduplicated(want))
    texts_of = {}
    for r in want:
        texts_of.setdefault(r[0], set()).add(masked_text(r[1]))
    assert back and all(r.doc_id in ids and r.text in texts_of[r.doc_id] for r in back)
    assert max(Counter(r.doc_id for r in back).values()) <= 3


def test_rows_are_taken_in_one_join(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (4, None)], "doc_id long, text string")
    keyed = common.row_key(rows)
    takes = keyed.groupBy("_row").agg(F.count("*").alias("_rows"), F.min("doc_id").alias("_copies")).where("_copies <> 3")
    taken = common.take_rows(keyed, takes.withColumn("_copies", F.expr("IF(_copies = 4, 0, _copies)")))
    assert sorted((r["doc_id"], r["text"]) for r in taken.collect()) == [(1, "a"), (2, "b"), (2, "b")]
    assert taken._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
