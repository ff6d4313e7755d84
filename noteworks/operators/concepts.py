"""Dictionary matching of a concept lexicon against notes, with evidence spans.

The matcher keeps every note in its own row. All aliases become one pattern, factored by their common
beginnings like a trie, so that a word of a note costs about the same whether the dictionary has
dozens or thousands of aliases; it is a literal that every task compiles once. Only finished matches
leave the row, so a scan of any size needs no shuffle of text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteworks import config
from noteworks.functions.spans import (
    CLOSE_MARK,
    OPEN_MARK,
    SPAN_TYPE,
    explode_items,
    find_spans,
    let,
    marked_spans,
    marked_text,
    no_spans,
    overlaps,
)
from noteworks.functions.rules import rate
from noteworks.session import BROADCAST_ROW_LIMIT, one_row

# Above this many aliases the index is joined as a table instead of being carried as a literal.
INLINE_ALIAS_LIMIT = 20_000

_FIRST_WORD = re.compile(r"\w+")


def alias_map(lexicon: DataFrame) -> DataFrame:
    """``lexicon(concept_id, label, aliases, ord)`` to unique lower-case aliases; the last row wins."""
    terms = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    return (
        lexicon.select("concept_id", "ord", F.posexplode(terms).alias("pos", "term"))
        .select("concept_id", "ord", "pos", F.trim(F.lower("term")).alias("alias"))
        .where("alias <> ''")
        .groupBy("alias")
        .agg(F.max_by("concept_id", F.struct("ord", "pos")).alias("concept_id"))
    )


def _escape(alias: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", alias)


def trie_pattern(aliases: list[str]) -> str:
    """A pattern for any of ``aliases``, the longest that fits first, in which common beginnings occur once."""
    root: dict = {}
    for alias in aliases:
        node = root
        for letter in alias:
            node = node.setdefault(letter, {})
        node[""] = {}

    def write(node: dict) -> str:
        chain = []
        while len(node) == 1 and "" not in node:  # one way on: plain letters
            (letter, node), = node.items()
            chain.append(_escape(letter))
        ways = [_escape(letter) + write(after) for letter, after in sorted(node.items()) if letter]
        if ways:
            chain.append(f"(?:{'|'.join(ways)})" + ("?" if "" in node else ""))
        return "".join(chain)

    return write(root)


def _dictionary(aliases: DataFrame) -> list[str] | None:
    """The aliases of two letters and more that hold a word, sorted; None if they are too many for a pattern."""
    head = [r["alias"] for r in aliases.select("alias").where(F.length("alias") >= 2).limit(INLINE_ALIAS_LIMIT + 1).collect()]
    return sorted(a for a in head if _FIRST_WORD.search(a)) if len(head) <= INLINE_ALIAS_LIMIT else None


def _alternation(alternatives: Column) -> Column:
    ordered = F.transform(F.array_sort(alternatives), lambda a: a["pattern"])
    return F.concat(F.lit(r"(?U)\b(?:"), F.array_join(ordered, "|"), F.lit(r")\b"))


def _first_per_alias(spans: Column, cap: int) -> Column:
    """The first ``cap`` spans of each distinct matched string, sorted by start."""

    def pick(ranked: Column) -> Column:
        kept = F.filter(ranked, lambda s, i: (i < cap) | (F.get(ranked, i - cap)["match"] != s["match"]))
        return F.array_sort(kept, lambda a, b: a["start"] - b["start"])

    return let(F.array_sort(spans), pick)  # by match, then start


def _first_marked(marked: Column, cap: int) -> Column:
    """As ``_first_per_alias`` for a text with marked matches: cut at the marks, an Arrow batch at a time. Places count
    code points, as everywhere."""

    def first(texts: pa.Array) -> pa.Array:
        ends, names, starts, stops = [0], [], [], []
        for text in texts.to_pylist():
            head, *pieces = (text or "").split(OPEN_MARK)
            at, seen = len(head), {}
            for piece in pieces:
                hit = piece[: piece.index(CLOSE_MARK)]
                seen[hit] = n = seen.get(hit, 0) + 1
                if n <= cap:
                    names.append(hit)
                    starts.append(at)
                    stops.append(at + len(hit))
                at += len(piece) - 1
            ends.append(len(names))
        spans = pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], ["match", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)

    # What holds no match does not travel.
    return F.arrow_udf(first, SPAN_TYPE)(let(marked, lambda m: F.when(F.contains(m, F.lit(OPEN_MARK)), m)))


def _with_alternatives(notes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add ``_alternatives`` from a dictionary too large for a pattern: notes and aliases meet on first words, as an
    equi-join of distinct words, and the short alias lists go back to their notes."""
    words = F.array_distinct(F.regexp_extract_all(F.col("_low"), F.lit(r"(?U)\w+"), F.lit(0)))
    usable = aliases.select("alias").where(F.length("alias") >= 2)
    escaped = F.regexp_replace("alias", r"(?U)([^\w\s])", r"\\$1")
    by_word = usable.select(
        F.regexp_extract("alias", r"(?U)\w+", 0).alias("word"),
        F.struct((-F.length("alias")).alias("rank"), escaped.alias("pattern")).alias("alt"),
    )
    found = (
        notes.select("note_id", F.explode(words).alias("word"))
        .join(by_word, "word")
        .groupBy("note_id")
        .agg(F.collect_list("alt").alias("_alternatives"))
    )
    return notes.join(found, "note_id", "left")


def _matched(notes: DataFrame, aliases: DataFrame, cap: int) -> DataFrame:
    """Add ``_spans``: resolved alias matches of each note."""
    lowered, known = notes.withColumn("_low", F.lower("text")), _dictionary(aliases)
    if known is not None:
        if not known:
            return lowered.withColumn("_spans", no_spans())
        marked = marked_text(F.col("_low"), rf"(?U)\b(?:{trie_pattern(known)})\b")
        return lowered.withColumn("_spans", _first_marked(marked, cap))
    prepared = _with_alternatives(lowered, aliases)
    spans = F.when(
        F.size("_alternatives") > 0,
        _first_per_alias(find_spans(F.col("_low"), _alternation(F.col("_alternatives"))), cap),
    ).otherwise(no_spans())
    return prepared.withColumn("_spans", spans)


def _attach_concepts(matches: DataFrame, aliases: DataFrame) -> DataFrame:
    small = aliases.limit(BROADCAST_ROW_LIMIT + 1).count() <= BROADCAST_ROW_LIMIT
    side = F.broadcast(aliases) if small else aliases
    return matches.join(side, matches["matched_alias"] == side["alias"], "left").drop("alias")


def match_aliases(
    notes: DataFrame, aliases: DataFrame, max_per_alias: int = config.MAX_ALIAS_MATCHES_PER_NOTE
) -> DataFrame:
    """Leftmost-longest, non-overlapping, word-bounded matches; at most ``max_per_alias`` of each per note."""
    rows = explode_items(
        _matched(notes, aliases, max_per_alias), F.col("_spans"), "s", "note_id", "client_id"
    ).select(
        "note_id",
        "client_id",
        F.col("s.match").alias("matched_alias"),
        F.col("s.start").alias("span_start"),
        F.col("s.end").alias("span_end"),
    )
    return _attach_concepts(rows, aliases)


def _boundary(text: str, at: int) -> bool:
    return bool(re.match(r"\w", text[at - 1])) != bool(re.match(r"\w", text[at]))


def _all_candidates(notes: DataFrame, aliases: DataFrame) -> tuple[DataFrame, Column]:
    """Every place of every alias, overlapping ones too: longest first, then by alias and place.

    One pass finds the longest alias at each place; the shorter ones there are its beginnings, which the
    dictionary knows beforehand.
    """
    low, known = F.col("_low"), _dictionary(aliases)
    if known is None:
        prepared = _with_alternatives(notes, aliases)
        ordered = F.array_sort("_alternatives")
        return prepared, F.flatten(F.transform(ordered, lambda a: find_spans(low, F.concat(F.lit(r"(?U)\b"), a["pattern"], F.lit(r"\b")))))
    if not known:
        return notes, no_spans()
    every, shorter = set(known), {}
    for alias in known:
        begins = [alias[:n] for n in range(2, len(alias)) if alias[:n] in every and _boundary(alias, n)]
        if begins:
            shorter[alias] = begins
    longest = marked_spans(low, rf"(?U)\b(?=({trie_pattern(known)})\b)", group=1)
    names = sorted(shorter)
    lookup = F.map_from_arrays(F.lit(names), F.array(*[F.lit(shorter[n]) for n in names])) if names else None

    def at_place(s: Column) -> Column:
        if lookup is None:
            return F.array(s)
        begins = F.coalesce(lookup[s["match"]], F.array().cast("array<string>"))
        return F.concat(F.array(s), F.transform(begins, lambda p: F.struct(
            p.alias("match"), s["start"].alias("start"), (s["start"] + F.length(p)).alias("end"))))

    def ranked(spans: Column) -> Column:
        keyed = F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("rank"), s["match"].alias("match"), s["start"].alias("start"), s["end"].alias("end")))
        return F.transform(F.array_sort(keyed), lambda s: F.struct(s["match"].alias("match"), s["start"].alias("start"), s["end"].alias("end")))

    candidates = ranked(F.flatten(F.transform(longest, at_place)))
    return notes, F.when(low.isNotNull(), candidates).otherwise(no_spans())


def match_aliases_longest_first(
    notes: DataFrame, aliases: DataFrame, max_per_alias: int = config.MAX_ALIAS_MATCHES_PER_NOTE
) -> DataFrame:
    """Same dictionary, other precedence: the longest alias anywhere in the note claims its text first."""
    prepared, every = _all_candidates(notes.withColumn("_low", F.lower("text")), aliases)

    def claim(kept: Column, s: Column) -> Column:
        taken = F.exists(kept, lambda k: overlaps(k, s))
        used = F.size(F.filter(kept, lambda k: k["match"] == s["match"]))
        return F.when(taken | (used >= max_per_alias), kept).otherwise(F.concat(kept, F.array(s)))

    spans = F.aggregate(every, no_spans(), claim)
    rows = explode_items(prepared, spans, "s", "note_id", "client_id").select(
        "note_id",
        "client_id",
        F.col("s.match").alias("matched_alias"),
        F.col("s.start").alias("span_start"),
        F.col("s.end").alias("span_end"),
    )
    return _attach_concepts(rows, aliases)


def budget_spans(text: Column) -> Column:
    """Budget mentions, one per distinct amount: array of (match = label, start, end)."""
    found = find_spans(text, config.BUDGET_PATTERN)
    amounts = F.transform(
        F.regexp_extract_all(text, F.lit(config.BUDGET_PATTERN), F.lit(1)), lambda a: F.trim(a)
    )

    def label(all_amounts: Column) -> Column:
        zipped = F.transform(
            found,
            lambda s, i: F.struct(
                F.get(all_amounts, i).alias("amount"), s["start"].alias("start"), s["end"].alias("end"),
                i.alias("i"),
            ),
        )
        first = F.filter(
            zipped, lambda z: (F.array_position(all_amounts, z["amount"]) == z["i"] + 1) & (z["amount"] != "")
        )
        return F.transform(
            first,
            lambda z: F.struct(
                F.concat(F.lit("budget "), F.lower(z["amount"])).alias("match"),
                z["start"].alias("start"),
                z["end"].alias("end"),
            ),
        )

    return F.when(text.rlike(config.BUDGET_PATTERN), let(amounts, label)).otherwise(no_spans())


def extract_budgets(notes: DataFrame) -> DataFrame:
    return explode_items(notes, budget_spans(F.col("text")), "s", "note_id", "client_id").select(
        "note_id",
        "client_id",
        F.col("s.match").alias("matched_alias"),
        F.col("s.start").alias("span_start"),
        F.col("s.end").alias("span_end"),
        F.lit(config.BUDGET_CONCEPT_ID).alias("concept_id"),
    )


def detect_concepts(notes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Alias matches plus budget amounts that do not sit on the very same span. One pass, no shuffle of text."""
    found = _matched(notes.where(F.coalesce(F.length("text"), F.lit(0)) > 0), aliases,
                     config.MAX_ALIAS_MATCHES_PER_NOTE)
    fresh = F.filter(
        budget_spans(F.col("text")),
        lambda b: ~F.exists("_spans", lambda s: (s["start"] == b["start"]) & (s["end"] == b["end"])),
    )
    tagged = F.concat(
        F.transform("_spans", lambda s: F.struct(s.alias("s"), F.lit(False).alias("is_budget"))),
        F.transform(fresh.cast(SPAN_TYPE), lambda s: F.struct(s.alias("s"), F.lit(True).alias("is_budget"))),
    )
    rows = explode_items(found, tagged, "t", "note_id", "client_id").select(
        "note_id",
        "client_id",
        F.col("t.s.match").alias("matched_alias"),
        F.col("t.s.start").alias("span_start"),
        F.col("t.s.end").alias("span_end"),
        "t.is_budget",
    )
    named = _attach_concepts(rows, aliases)
    return named.select(
        "note_id",
        "client_id",
        F.when(F.col("is_budget"), config.BUDGET_CONCEPT_ID).otherwise(F.col("concept_id")).alias("concept_id"),
        "matched_alias",
        "span_start",
        "span_end",
        F.lit("rule-based").alias("detection_method"),
        F.lit(1.0).alias("confidence"),
    )


def detection_coverage(notes: DataFrame, concepts: DataFrame) -> DataFrame:
    """Notes with a concept, their share, and the mean number of concepts of those that have any."""
    per_note = concepts.groupBy("note_id").agg(F.count("*").alias("n"))
    hit = per_note.agg(F.count("*").alias("notes_with_concepts"), F.avg("n").alias("avg_per_note"))
    return one_row(notes.agg(F.count("*").alias("notes")), hit).select(
        "notes",
        "notes_with_concepts",
        rate(F.col("notes_with_concepts"), F.col("notes")).alias("coverage_pct"),
        F.round("avg_per_note", 4).alias("avg_per_note"),
    )


def top_detected(concepts: DataFrame, lexicon: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` commonest concepts with their labels; an unlabelled concept shows its id."""
    top = F.broadcast(
        concepts.groupBy("concept_id").agg(F.count("*").alias("matches")).orderBy(F.desc("matches"), "concept_id").limit(k)
    )
    labels = lexicon.join(top, "concept_id", "left_semi").groupBy("concept_id").agg(F.min("label").alias("label"))
    return top.join(labels, "concept_id", "left").select(
        "concept_id", F.coalesce("label", "concept_id").alias("label"), "matches"
    )


def coverage_by_method(concepts: DataFrame) -> DataFrame:
    return concepts.groupBy("detection_method").agg(
        F.count("*").alias("matches"), F.count_distinct("note_id").alias("notes")
    )


def _parts(text: Column) -> Column:
    """All distinct substrings of a short text."""
    size = F.length(text)

    def from_(i: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substring(text, i, n))

    cut = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), size), from_)))
    return F.when(size > 0, cut).otherwise(F.array().cast("array<string>"))


def merge_extractions(rules: DataFrame, external: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rule matches keep confidence 1; external ``(note_id, label, confidence)`` rows add what is new.

    The concept of a new label is an exact alias, else the first lexicon term (in lexicon order) that
    contains it or that it contains, else a made-up id. Distinct labels, not rows, meet the lexicon.
    """
    terms = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    vocabulary = lexicon.select(
        "concept_id", F.struct("ord", F.lit(0)).alias("o"), F.posexplode(terms).alias("pos", "term")
    ).select("concept_id", F.struct("o.ord", "pos").alias("at"), F.lower("term").alias("term"))
    last = vocabulary.groupBy("term").agg(
        F.max_by("concept_id", "at").alias("concept_id"), F.min("at").alias("at")
    )
    known = rules.select("note_id", F.lower("matched_alias").alias("label")).distinct()
    fresh = external.dropDuplicates(["note_id", "label"]).join(known, ["note_id", "label"], "left_anti")
    made_up = F.concat(F.lit("LLM_"), F.left(F.replace(F.col("label"), F.lit(" "), F.lit("_")), F.lit(30)))
    labels = fresh.select("label").distinct()
    # Containment as two equi-joins: every part of a label that is a term, every part of a term that is a label.
    inside = labels.select("label", F.explode(_parts(F.col("label"))).alias("term")).join(last, "term")
    around = last.select("concept_id", "at", F.explode(_parts(F.col("term"))).alias("label")).join(labels, "label")
    exact = labels.join(last, F.col("label") == F.col("term")).select("label", F.col("concept_id").alias("_exact"))
    near = inside.select("label", "concept_id", "at").unionByName(around.select("label", "concept_id", "at")).groupBy("label").agg(
        F.min_by("concept_id", "at").alias("_near")
    )
    resolved = labels.join(exact, "label", "left").join(near, "label", "left").select(
        "label", F.coalesce("_exact", "_near", made_up).alias("concept_id")
    )
    added = fresh.join(resolved, "label").select(
        "note_id",
        "concept_id",
        F.col("label").alias("matched_alias"),
        F.lit(-1).alias("span_start"),
        F.lit(-1).alias("span_end"),
        F.lit("llm-enhanced").alias("detection_method"),
        F.col("confidence").cast("double").alias("confidence"),
    )
    kept = rules.select(
        "note_id", "concept_id", "matched_alias", "span_start", "span_end",
        F.lit("rule-based").alias("detection_method"), F.lit(1.0).alias("confidence"),
    )
    return kept.unionByName(added)


def backfill_unprocessed(enhanced: DataFrame, rules: DataFrame) -> DataFrame:
    """Add the rule rows of notes that never reached the enhanced output."""
    done = enhanced.select("note_id").distinct()
    return enhanced.unionByName(rules.join(done, "note_id", "left_anti").select(*enhanced.columns))


def clean_extracted_concepts(extracted: DataFrame) -> DataFrame:
    """Validate outside rows ``(note_id, text, pos, label, bucket, confidence, evidence)``."""
    label = F.trim(F.lower(F.coalesce("label", F.lit(""))))
    bucket = F.trim(F.lower(F.coalesce("bucket", F.lit(""))))
    base = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.5))))
    evidence = F.left(F.coalesce("evidence", F.lit("")), F.lit(200))

    def bag(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\s+", -1), lambda w: w != ""))

    proof = bag(evidence)
    shared = F.size(F.array_intersect(proof, bag(F.coalesce("text", F.lit("")))))
    weak = (F.size(proof) > 2) & (F.coalesce("text", F.lit("")) != "") & (shared < F.size(proof) * 0.3)
    checked = extracted.select(
        "note_id",
        "pos",
        label.alias("label"),
        bucket.alias("bucket"),
        F.round(F.when(weak, F.greatest(F.lit(0.3), base - 0.3)).otherwise(base), 2).alias("confidence"),
    ).where(
        (F.col("label") != "")
        & F.col("bucket").isin(*config.EXTRACTION_BUCKETS)
        & (F.length("label") - F.length(F.replace(F.col("label"), F.lit("_"), F.lit(""))) < 2)
        & (F.length("label") <= 50)
        & ~F.col("label").rlike(r"[_ ]([2-9]|1[0-9])$")
    )
    first = F.min_by(F.struct("bucket", "confidence"), "pos").alias("c")
    return checked.groupBy("note_id", "label").agg(first).select("note_id", "label", "c.bucket", "c.confidence")


def variant_counts(notes: DataFrame, variants: dict[str, list[str]]) -> DataFrame:
    """Per category, the sum over its spellings of the notes that contain each, ignoring case."""
    low = F.lower("text")
    sums = [
        sum((F.count_if(F.contains(low, F.lit(v.lower()))) for v in spellings), F.lit(0)).alias(category)
        for category, spellings in variants.items()
    ]
    wide = notes.agg(*sums)
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"`{c}`").alias("notes")) for c in variants])
    return wide.select(F.explode(pairs).alias("p")).select("p.category", "p.notes")


def parenthesised_types(notes: DataFrame) -> DataFrame:
    inner = F.regexp_extract_all("text", F.lit(r"\(([^)]+)\)"), F.lit(1))
    return notes.select(F.explode(inner).alias("client_type")).distinct()


def fill_client_ids(found: DataFrame, notes: DataFrame) -> DataFrame:
    """``found`` with the client of its note wherever ``client_id`` is missing or null; note ids compare as text.

    Rows of unknown notes stay without a client. Of a repeated note id the least client counts, so no row doubles.
    Rows that need no client do not take part in the join, so they cannot pile up on a null key.
    """
    if "client_id" not in found.columns:
        found = found.withColumn("client_id", F.lit(None).cast(notes.schema["client_id"].dataType))
    clients = notes.where("note_id IS NOT NULL").groupBy(F.col("note_id").cast("string").alias("_note")).agg(F.min("client_id").alias("_client"))
    lacks = F.col("client_id").isNull() & F.col("note_id").isNotNull()
    filled = found.where(lacks).withColumn("_note", F.col("note_id").cast("string")).join(clients, "_note", "left")
    return found.where(~lacks).unionByName(filled.withColumn("client_id", F.col("_client")).select(*found.columns))
