"""Toxicity by a learned lexicon, misspellings included.

The lexicon holds words and word beginnings that labelled toxic documents use and clean ones do not. It becomes a
trie, and the Levenshtein automaton of all its terms at once runs over the words of a text: a state is the set of
trie nodes within reach, each with the edits spent, made into a single table row when first met. Most words die
within a few letters. Every hit is weighed by its class (term, edits, quoted or not) as measured on the labelled
documents; a window of text around the hit tells quotation from abuse.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteworks.llm.common import WORD
from noteworks.session import cut_lineage, ensure_checkpoint_dir

FIT_TOXIC = 20_000  # labelled documents of each kind that the fit looks at, at most
FIT_CLEAN = 40_000
CANDIDATES = 2_000  # terms that compete for the lexicon
LEXICON_TERMS = 200
STEM_LENGTHS = range(4, 9)
LEAST_DOCUMENTS = 5
DOUBT = 0.05  # chance that any term gets in by luck
LEAST_ODDS = 20.0
ALREADY_TOLD = 0.5  # what a document still counts when one more chosen term is in it
PRIOR_DOCUMENTS = 2.0
PRIOR_PRECISION = (0.95, 0.85, 0.75)  # of hits with 0, 1 and 2 edits, before any is seen
QUOTED_SHARE = 0.4  # what is left of it inside a quotation
LEAST_PRECISION = 0.5  # classes below are no evidence
CLEAN_VARIANTS = 2  # clean documents that make a near-miss a word of its own
WINDOW = 100
SLICE_CHARS = 1 << 20
PREDICT_FROM = 0.7

OPENING, CLOSING, STRAIGHT = "«“„‹‘", "»”›’", '"'
REPORTING = frozenset(
    "said says called quote quoted quotes wrote writes term word sagte nannte schrieb zitat wort dit écrit mot cite dijo escribió palabra cita".split())
ADDRESS = frozenset("you your du dich ihr tu vous toi tú usted".split())


def edits_allowed(term: str, stem: bool) -> int:
    """Short terms must be met exactly, long ones may differ by two edits."""
    return (len(term) >= 6) if stem else (0 if len(term) < 5 else 1 if len(term) < 9 else 2)


class Letters:
    """Per code point: lower case (if that is one code point), and whether it belongs to words or joins them."""

    def __init__(self):
        import unicodedata

        top = 0x20000
        self.lower = np.arange(0x110000, dtype=np.uint32)
        self.kind = np.zeros(0x110000, np.uint8)  # 1 inside words, 2 only between such
        self.kind[top:] = 1
        for c in range(top):
            x = chr(c)
            low = x.lower()
            if len(low) == 1:
                self.lower[c] = ord(low)
            self.kind[c] = x.isalnum() or unicodedata.category(x)[0] == "M"
        for x in "@$*":
            self.kind[ord(x)] = 2

    def borders(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end."""
        kind = np.zeros(len(codes) + 2, np.uint8)
        kind[1:-1] = self.kind[codes]
        inside = kind == 1
        join = np.flatnonzero(kind == 2)
        inside[join[(kind[join - 1] == 1) & (kind[join + 1] == 1)]] = True
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        return edges[::2], edges[1::2]

    def words(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """The text in lower case, place by place, and where words begin and end."""
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        return self.fold(codes), *self.borders(codes)

    def fold(self, codes: np.ndarray) -> str:
        return self.lower[codes].tobytes().decode("utf-32-le", "replace")


def features(folded: str, starts: np.ndarray, ends: np.ndarray) -> set[str]:
    """Distinct words (marked by a trailing blank) and word beginnings of a text."""
    words = {folded[a:b] for a, b in zip(starts.tolist(), ends.tolist())}
    out = {w + " " for w in words if len(w) > 2}
    for n in STEM_LENGTHS:
        out.update(w[:n] for w in words if len(w) > n)
    return out


class Automaton:
    """All words within reach of a term. Row 0 of the table is the dead state, row 1 the start."""

    def __init__(self, terms: list[tuple[str, bool]], lower: np.ndarray):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach = [0]  # most edits that some term below allows
        for number, (term, stem) in enumerate(terms):
            node, allowed = 0, int(edits_allowed(term, stem))
            self.reach[0] = max(self.reach[0], allowed)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.children[node][letter]
                self.reach[node] = max(self.reach[node], allowed)
            self.ends[node].append(number)
        self.alphabet = sorted({x for term, _ in terms for x in term})
        folded = np.zeros(0x110000, np.uint8 if len(self.alphabet) < 255 else np.int32)  # class 0: letters of no term
        for i, x in enumerate(self.alphabet):
            folded[ord(x)] = i + 1
        self.klass = folded[lower]
        self.known: dict[tuple, int] = {(): 0}
        self.states: list[tuple] = [()]
        self.table = np.full((64, len(self.alphabet) + 1), -1, np.int32)
        self.table[0] = 0
        self.best = [[(-1, 9)], [(-1, 9)]]  # of a state: best term and edits if the word ends here; best stem in any case
        self.start = self._state({0: 0})

    def _state(self, spent: dict[int, int]) -> int:
        """Number of the state that holds ``spent``: edits so far for each node, letters left out included."""
        todo = sorted(spent.items(), key=lambda x: x[1])
        best = dict(spent)
        for node, edits in todo:
            if best[node] < edits:
                continue
            for child in self.children[node].values():
                if edits + 1 <= self.reach[child] and edits + 1 < best.get(child, 9):
                    best[child] = edits + 1
                    todo.append((child, edits + 1))
        key = tuple(sorted(best.items()))
        if key in self.known:
            return self.known[key]
        number = self.known[key] = len(self.states)
        self.states.append(key)
        if number >= len(self.table):
            self.table = np.concatenate((self.table, np.full_like(self.table, -1)))
        hits = [(edits, t) for node, edits in key for t in self.ends[node] if edits <= edits_allowed(*self.terms[t])]
        for out, stem in zip(self.best, (False, True)):
            edits, term = min(((e, t) for e, t in hits if self.terms[t][1] == stem), default=(9, -1))
            out.append((term, edits))
        return number

    def _fill(self, state: int, klass: int) -> None:
        letter = self.alphabet[klass - 1] if klass else None
        spent: dict[int, int] = {}

        def offer(node: int, edits: int) -> None:
            if edits <= self.reach[node] and edits < spent.get(node, 9):
                spent[node] = edits

        for node, edits in self.states[state]:
            offer(node, edits + 1)  # a letter too many
            for x, child in self.children[node].items():
                offer(child, edits + (x != letter))
        self.table[state, klass] = self._state(spent) if spent else 0

    def match(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that are hits, with term and edits; the fewest edits count, then the earlier term."""
        term, edits = np.full(len(starts), -1, np.int32), np.full(len(starts), 9, np.int8)
        live, place, state = np.arange(len(starts)), starts, np.full(len(starts), self.start, np.int32)
        best, counted = [np.array(b) for b in self.best], len(self.states)
        while len(live):
            klass = self.klass[codes[place]]
            after = self.table[state, klass]
            unknown = after < 0
            if unknown.any():
                for s, k in {*zip(state[unknown].tolist(), klass[unknown].tolist())}:
                    self._fill(s, k)
                after = self.table[state, klass]
                if len(self.states) > counted:
                    best, counted = [np.array(b) for b in self.best], len(self.states)
            kept = after > 0
            live, place, state = live[kept], place[kept] + 1, after[kept]
            done = place == ends[live]
            for hit, own, at in ((best[1], live, state), (best[0], live[done], state[done])):
                met = hit[at, 0] >= 0
                own, found = own[met], hit[at[met]]
                better = (found[:, 1] < edits[own]) | ((found[:, 1] == edits[own]) & (found[:, 0] < term[own]))
                term[own[better]], edits[own[better]] = found[better, 0], found[better, 1]
            live, place, state = live[~done], place[~done], state[~done]
        words = np.flatnonzero(term >= 0)
        return words, term[words], edits[words]


def quotation(text: str, start: int, end: int) -> float:
    """How much the window around a hit looks like quoting (0 to 1): inside quotation marks of its line, or next to
    words of reporting; words that address somebody speak against it."""
    left, right = text[max(0, start - WINDOW) : start].rsplit("\n", 1)[-1], text[end : end + WINDOW].split("\n", 1)[0]
    opened = max(left.rfind(x) for x in OPENING) > max(left.rfind(x) for x in CLOSING) or left.count(STRAIGHT) % 2 == 1
    closed = any(x in right for x in CLOSING + STRAIGHT)
    near = {w.strip(".,;:!?()\"'«»“”„") for w in (left + " " + right).lower().split()}
    return max(0.0, 0.6 * (opened and closed) + 0.5 * bool(near & REPORTING) - 0.3 * bool(near & ADDRESS))


class Scanner:
    """Finds the hits of a lexicon in texts."""

    def __init__(self, terms: list[tuple[str, bool]], clean: frozenset[str] = frozenset()):
        self.letters = Letters()
        self.automaton, self.clean = Automaton(terms, self.letters.lower), clean

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int, float]]]:
        """``(start, end, term, edits, quotation)`` of every hit in each text; near-misses that are clean words are
        none. Texts are walked side by side, about ``SLICE_CHARS`` at a time."""
        out: list[list[tuple[int, int, int, int, float]]] = [[] for _ in texts]
        first = 0
        while first < len(texts) and self.automaton.terms:
            last, size = first, 0
            while last < len(texts) and (last == first or size < SLICE_CHARS):
                size += len(texts[last] or "") + 1
                last += 1
            part = [t or "" for t in texts[first:last]]
            begins = np.cumsum([0, *(len(t) + 1 for t in part)])[:-1]
            codes = np.frombuffer("\n".join(part).encode("utf-32-le", "replace"), np.uint32)
            starts, ends = self.letters.borders(codes)
            words, terms, edits = self.automaton.match(codes, starts, ends)
            rows = np.searchsorted(begins, starts[words], "right") - 1
            for row, a, b, term, spent in zip(rows.tolist(), starts[words].tolist(), ends[words].tolist(), terms.tolist(), edits.tolist()):
                if spent and self.letters.fold(codes[a:b]) in self.clean:
                    continue
                a, b = a - int(begins[row]), b - int(begins[row])
                out[first + row].append((a, b, term, spent, quotation(part[row], a, b)))
            first = last
        return out


def _chance(t: Column, n: Column, share: float) -> Column:
    """Chernoff bound: minus the logarithm of the chance that so many of ``n`` documents are toxic by luck."""
    p = t / n
    rest = F.when(t < n, (n - t) * F.log((1 - p) / (1 - share))).otherwise(0.0)
    return t * F.log(p / share) + rest


class Model:
    """Lexicon, clean near-misses, and the precision of each class of hits."""

    def __init__(self, terms: list[tuple[str, bool]], clean: frozenset[str], precision: dict[tuple[int, int, bool], float], base: float):
        self.terms, self.clean, self.precision, self.base = terms, clean, precision, base

    def weigh(self, classes: set[tuple[int, int, bool]]) -> float:
        """Chance that a document with these classes of hits is toxic: the classes as independent witnesses."""
        miss = 1.0 - self.base
        for c in classes:
            p = self.precision.get(c, PRIOR_PRECISION[c[1]] * (QUOTED_SHARE if c[2] else 1.0))
            if p >= LEAST_PRECISION or c[2]:
                miss *= 1.0 - p
        return min(1.0, max(0.0, 1.0 - miss))


def sample_labelled(docs: DataFrame, labelled: DataFrame, key: str, text: str) -> tuple[DataFrame, float]:
    """Training texts with ``toxic``, and how many clean documents stand behind a sampled one.

    At most ``FIT_TOXIC`` and ``FIT_CLEAN`` documents by the hash of their key, so that their keys may be broadcast.
    Of near copies (same label and least five-word shingle) one is kept, lest a copied text looks like a rule.
    """
    known = labelled.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic")).where("_key IS NOT NULL AND _toxic IS NOT NULL")
    n_clean = known.where("_toxic = 0").count()
    picked = [known.where(F.col("_toxic") == label).orderBy(F.xxhash64("_key"), "_key").limit(n) for label, n in ((1, FIT_TOXIC), (0, FIT_CLEAN))]
    ids = F.broadcast(cut_lineage(picked[0].unionByName(picked[1])))
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text")).join(ids, "_key")
    words = F.regexp_extract_all(F.lower("_text"), F.lit(WORD), F.lit(0))
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - 4, F.lit(1))), lambda i: F.xxhash64(F.slice("_w", i, 5)))
    marked = rows.withColumn("_w", words).withColumn("_mark", F.array_min(shingles))
    return cut_lineage(marked.select("_toxic", "_text", "_mark").dropDuplicates(["_toxic", "_mark"]).select("_toxic", "_text")), max(1.0, n_clean / FIT_CLEAN)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters, counts = Letters(), (Counter(), Counter())

    def out() -> pa.RecordBatch:
        names = [*{**counts[0], **counts[1]}]
        rows = [pa.array(names, pa.string()), *(pa.array([counts[k][n] for n in names], pa.int64()) for k in (1, 0))]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(rows, ["feature", "t", "c"])

    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic > 0].update(features(*letters.words(text)))
        if len(counts[0]) + len(counts[1]) > 400_000:
            yield out()
    yield out()


def _presence_batches(wanted: dict[str, int]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                rows.append(sorted(wanted[f] for f in features(*letters.words(text)) if f in wanted))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["_toxic", "found"])

    return work


def choose_terms(toxic: np.ndarray, weight: np.ndarray, found: list[list[int]], names: list[str], share: float, least_gain: float,
                 clean_per_toxic: float) -> list[str]:
    """Cover the toxic documents greedily: always the term that tells most about what the chosen ones leave.

    A document counts less with each chosen term in it, so that terms that only ride along with chosen ones (other
    words of copied texts) have little left to tell. Of equal terms the first of ``names`` is taken.
    """
    where: list[list[int]] = [[] for _ in names]
    for row, own in enumerate(found):
        for f in own:
            where[f].append(row)
    rows = [np.array(w, np.int64) for w in where]
    counts, chosen = weight.astype(np.float64), []
    while len(chosen) < LEXICON_TERMS:
        best = (least_gain, None)
        for f, r in enumerate(rows):
            t, n = float((toxic[r] * counts[r]).sum()), float(counts[r].sum())
            if not t or t / n <= share or (t + 0.5) / (n - t + 0.5) * clean_per_toxic < LEAST_ODDS:
                continue
            p = t / n
            gain = t * math.log(p / share) + ((n - t) * math.log((1 - p) / (1 - share)) if n - t > 1e-9 else 0.0)
            if gain > best[0] + 1e-9:
                best = (gain, f)
        if best[1] is None:
            return chosen
        chosen.append(names[best[1]])
        counts[rows[best[1]]] *= ALREADY_TOLD
        rows[best[1]] = np.zeros(0, np.int64)
    return chosen


def _class_batches(terms: list[tuple[str, bool]], clean: frozenset[str], variants: bool):
    """Per document its classes of hits, or (``variants``) the near-misses by their spelling."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(terms, clean)
        for batch in batches:
            rows = []
            texts = batch.column(1).to_pylist()
            for text, hits in zip(texts, scanner.scan(texts)):
                if variants:
                    folded = scanner.letters.words(text)[0] if any(e for *_, e, _ in hits) else ""
                    rows.append(sorted({folded[a:b] for a, b, _, e, _ in hits if e}))
                else:
                    rows.append(sorted({f"{t}:{e}:{int(q >= 0.5)}" for _, _, t, e, q in hits}) or ["none"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], ["_toxic", "found"])

    return work


def _count(rows: DataFrame) -> dict[str, tuple[int, int]]:
    sums = rows.select("_toxic", F.explode("found").alias("f")).groupBy("f").agg(
        F.count_if(F.col("_toxic") > 0).alias("t"), F.count_if(F.col("_toxic") == 0).alias("c"))
    return {r["f"]: (r["t"], r["c"]) for r in sums.collect()}


def fit(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Learn from the documents of ``labelled(key, toxic)``; null labels and keys teach nothing, of several labels
    the greater counts. Without toxic or clean documents the model finds nothing. The driver sees at most
    ``CANDIDATES`` terms and the sampled documents' shares in them."""
    sample, behind = sample_labelled(docs, labelled, key, text)
    kinds = {r["_toxic"]: r["count"] for r in sample.groupBy("_toxic").count().collect()}
    n_toxic, n_clean = kinds.get(1, 0), kinds.get(0, 0)
    if not n_toxic or not n_clean:
        return Model([], frozenset(), {}, 0.0)
    counted = cut_lineage(sample.mapInArrow(_feature_batches, "feature string, t long, c long").groupBy("feature").agg(
        F.sum("t").alias("t"), (F.sum("c") * behind).alias("c")))
    all_t, all_c, tried = counted.agg(F.sum("t"), F.sum("c"), F.count_if(F.col("t") > 0)).first()
    share, least_gain = all_t / (all_t + all_c), math.log(max(tried, 1) / DOUBT)
    n = F.col("t") + F.col("c")
    odds = (F.col("t") + 0.5) / (F.col("c") + 0.5) * (n_clean * behind / n_toxic)
    strong = counted.where((F.col("t") >= LEAST_DOCUMENTS) & (F.col("t") / n > share) & (odds >= LEAST_ODDS)).withColumn("gain", _chance(F.col("t"), n, share))
    names = [r["feature"] for r in strong.where(F.col("gain") >= least_gain).orderBy(F.desc("gain"), F.desc(F.length("feature")), "feature").limit(CANDIDATES).collect()]
    seen = sample.mapInArrow(_presence_batches({f: i for i, f in enumerate(names)}), "_toxic int, found array<int>").where(
        (F.size("found") > 0)).toPandas()
    toxic = seen["_toxic"].to_numpy(np.int64)
    weight = np.where(toxic == 1, 1.0, behind)
    chosen = choose_terms(toxic, weight, [list(x) for x in seen["found"]], names, share, least_gain, n_clean * behind / n_toxic)
    terms = [(f.rstrip(" "), not f.endswith(" ")) for f in chosen]
    near = _count(sample.mapInArrow(_class_batches(terms, frozenset(), True), "_toxic int, found array<string>"))
    clean = frozenset(v for v, (t, c) in near.items() if c >= CLEAN_VARIANTS and t * n_clean < 5 * c * n_toxic)
    classes = _count(sample.mapInArrow(_class_batches(terms, clean, False), "_toxic int, found array<string>"))
    none_t, none_c = classes.pop("none", (0, 0))
    precision = {}
    for name, (t, c) in classes.items():
        term, edits, quoted = (int(x) for x in name.split(":"))
        prior = PRIOR_PRECISION[edits] * (QUOTED_SHARE if quoted else 1.0)
        precision[term, edits, bool(quoted)] = (t + PRIOR_DOCUMENTS * prior) / (t + c * behind + PRIOR_DOCUMENTS)
    return Model(terms, clean, precision, none_t / max(1.0, none_t + none_c * behind))


HIT = "struct<start:int,end:int,term:string,edits:int,quotation:double>"
SCORE = f"struct<score:double,hits:array<{HIT}>>"


def _score_batches(model: Model, keep: int):
    kind = pa.struct([("score", pa.float64()), ("hits", pa.list_(pa.struct(
        [("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("quotation", pa.float64())])))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model.terms, model.clean)
        for batch in batches:
            rows = []
            for hits in scanner.scan(batch.column(keep).to_pylist()):
                score = model.weigh({(t, e, q >= 0.5) for _, _, t, e, q in hits})
                rows.append({"score": score, "hits": [
                    {"start": a, "end": b, "term": model.terms[t][0], "edits": e, "quotation": q} for a, b, t, e, q in hits]})
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(rows, kind)], [f"c{i}" for i in range(keep)] + ["toxicity"])

    return work


def score_texts(docs: DataFrame, model: Model, columns: list[str], text: str = "text", name: str = "toxicity") -> DataFrame:
    """``columns`` of every document and ``name``: its score (0 to 1) and all hits with places in code points.

    The score looks at the text alone; null and empty texts score like texts without a hit; repeated rows score
    alike; an empty table gives no rows.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    picked = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col(f"`{text}`").cast("string").alias("t"))
    ddl = "".join(f"c{i} {f.dataType.simpleString()}, " for i, f in enumerate(picked.schema.fields[:-1]))
    scored = picked.mapInArrow(_score_batches(model, len(columns)), f"{ddl}toxicity {SCORE}")
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col("toxicity").alias(name))
