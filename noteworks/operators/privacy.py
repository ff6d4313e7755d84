"""Audit and redaction of personal data and of specially protected categories.

All detectors are column expressions, so a whole corpus is audited or redacted in one scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteworks import patterns
from noteworks.functions.spans import (
    blocks,
    context,
    cut,
    explode_items,
    find_spans,
    keep_apart,
    keep_disjoint,
    let,
    marked_tails,
    no_spans,
    replace_spans,
)
from noteworks.functions.rules import rate
from noteworks.functions.vectors import dot
from noteworks.operators.concepts import trie_pattern
from noteworks.operators.grams import gram_batches
from noteworks.session import one_row

TAGGED_TYPE = "array<struct<start:int,end:int,label:string>>"
FINDING_TYPE = "array<struct<category:string,match:string,start:int,end:int>>"
VIOLATION_TYPE = "array<struct<type:string,match:string,start:int,end:int,risk:string>>"
RISK_ORDER = ("medium", "high", "critical")


@dataclass(frozen=True)
class RedactionConfig:
    """What to redact and how. ``name_case_sensitive=False`` lets any words after a title count as a name."""

    names: bool = True
    emails: bool = True
    phones: bool = True
    addresses: bool = True
    credit_cards: bool = True
    bank_accounts: bool = True
    id_numbers: bool = True
    birth_dates: bool = True
    ip_addresses: bool = True
    sensitive: bool = True
    sensitive_mode: str = "flag"  # flag, redact or log
    placeholder: str = "[TYPE]"
    aggressive: bool = False
    name_case_sensitive: bool = True

    def mark(self, kind: str) -> str:
        return f"[{kind}]" if self.placeholder == "[TYPE]" else self.placeholder


def _swap(text: Column, pattern: str, mark: str) -> Column:
    return F.regexp_replace(text, pattern, mark.replace("\\", "\\\\").replace("$", "\\$"))


def redact_emails(text: Column, cfg: RedactionConfig = RedactionConfig()) -> Column:
    return _swap(text, patterns.EMAIL, cfg.mark("EMAIL"))


def redact_phones(text: Column, cfg: RedactionConfig = RedactionConfig()) -> Column:
    for pattern in patterns.PHONES:
        text = _swap(text, pattern, cfg.mark("PHONE"))
    return text


def redact_credit_cards(text: Column, cfg: RedactionConfig = RedactionConfig()) -> Column:
    return _swap(text, patterns.CREDIT_CARD, cfg.mark("CREDIT_CARD"))


def redact_bank_accounts(text: Column, cfg: RedactionConfig = RedactionConfig()) -> Column:
    return _swap(text, patterns.IBAN, cfg.mark("IBAN"))


def redact_id_numbers(text: Column, cfg: RedactionConfig = RedactionConfig()) -> Column:
    return _swap(text, patterns.ID_NUMBER, cfg.mark("ID_NUMBER"))


def redact_birth_dates(text: Column, cfg: RedactionConfig = RedactionConfig()) -> Column:
    for pattern in patterns.BIRTH_DATES:
        text = _swap(text, pattern, cfg.mark("DATE_OF_BIRTH"))
    return text


def redact_ip_addresses(text: Column, cfg: RedactionConfig = RedactionConfig()) -> Column:
    return _swap(text, patterns.IP_ADDRESS, cfg.mark("IP_ADDRESS"))


def redact_addresses(text: Column, cfg: RedactionConfig = RedactionConfig()) -> Column:
    text = _swap(text, patterns.POSTAL, f"{cfg.mark('POSTAL_CODE')} {cfg.mark('CITY')}")
    for pattern in patterns.STREETS:
        text = _swap(text, pattern, cfg.mark("ADDRESS"))
    return text


def redact_names(text: Column, cfg: RedactionConfig = RedactionConfig()) -> Column:
    flags = "(?U)" if cfg.name_case_sensitive else "(?iU)"
    text = _swap(text, flags + patterns.NAME_AFTER_TITLE, cfg.mark("PERSON"))
    return _swap(text, patterns.CAPITALISED_RUN, cfg.mark("PERSON")) if cfg.aggressive else text


def beginnings(pattern: str) -> set[str]:
    """The plain letters that the ways of ``pattern``, written as ``\\b(?:way|way...``, begin with."""
    ways, depth, body = [""], 0, pattern.removeprefix(r"\b(?:")
    for letter in body:
        depth += (letter == "(") - (letter == ")")
        if depth < 0:
            break
        if letter == "|" and depth == 0:
            ways.append("")
        else:
            ways[-1] += letter
    found = set()
    for way in ways:
        letters = []
        while plain := re.match(r"(?:\[(\w+)\]|([^\W\d_]))(?![?*])", way):
            letters.append((plain[1] or plain[2]).lower())
            if way[plain.end():].startswith("+"):
                break
            way = way[plain.end():]
        found |= {"".join(each) for each in product(*letters)}
    if any(len(each) < 3 for each in found):
        raise ValueError(f"no plain beginning in {pattern}")
    return found


_RULES = [(category, regex) for category, regexes in patterns.SENSITIVE.items() for regex in regexes]
_RULES_OF: dict[str, list[int]] = {}
for _number, (_, _regex) in enumerate(_RULES):
    for _begin in beginnings(_regex):
        _RULES_OF.setdefault(_begin, []).append(_number)
# The longest beginning at a place tells of the shorter ones there.
_RULES_OF = {b: sorted({n for o, ns in _RULES_OF.items() if b.startswith(o) for n in ns}) for b in _RULES_OF}
_BEGINNINGS = rf"(?iU)\b(?=[{''.join(sorted({b[0] for b in _RULES_OF}))}])(?=({trie_pattern(sorted(_RULES_OF))}))"
_WORDS = 4  # no pattern spans more words, so a match reaches over the tails of as many places at most
HIT_TYPE = "array<struct<rule:int,start:int,end:int,match:string>>"


def sensitive_findings(text: Column) -> Column:
    """Every match of every protected category whose surroundings are not harmless, in pattern order.

    One scan marks the places where some pattern can begin; only the patterns of that beginning are tried there.
    """
    known = F.map_from_arrays(F.lit(list(_RULES_OF)), F.array(*[F.lit(n) for n in _RULES_OF.values()]))

    def tried(rule: Column, ahead: Column) -> Column:
        found = F.when(rule == 0, F.regexp_extract(ahead, r"(?iU)\A" + _RULES[0][1], 0))
        for number, (_, regex) in enumerate(_RULES[1:], 1):
            found = found.when(rule == number, F.regexp_extract(ahead, r"(?iU)\A" + regex, 0))
        return found

    def hits(places: Column) -> Column:
        def at(place: Column, i: Column) -> Column:
            ahead = F.concat(place["tail"], *[F.coalesce(F.get(places, i + n)["tail"], F.lit("")) for n in range(1, _WORDS)])
            # Letters whose case folds in other ways than by lower() are not in the list: every pattern is tried.
            rules = F.coalesce(known[F.lower(place["match"])], F.lit(list(range(len(_RULES)))))
            return F.filter(F.transform(rules, lambda r: let(tried(r, ahead), lambda m: F.struct(
                r.alias("rule"), place["start"].alias("start"), (place["start"] + F.length(m)).alias("end"), m.alias("match")))),
                lambda h: h["match"] != "")

        return F.array_sort(F.flatten(F.transform(places, at)).cast(HIT_TYPE))

    def apart(found: Column) -> Column:
        """Matches of one pattern don't overlap: the earlier one goes first."""

        def meets(a: Column, b: Column) -> Column:
            return (a["rule"] == b["rule"]) & (a["end"] > b["start"])

        clash = F.exists(F.sequence(F.lit(1), F.size(found)), lambda i: F.coalesce(
            meets(F.get(found, i - 1), F.get(found, i)), F.lit(False)))
        return F.when(clash, keep_apart(found, meets)).otherwise(found)

    def kept(found: Column) -> Column:
        names = F.lit([category for category, _ in _RULES])

        def harmful(parts: Column) -> Column:
            serious = F.filter(found, lambda h: ~cut(parts, F.greatest(h["start"] - 40, F.lit(0)), h["end"] + 40).rlike(
                patterns.HARMLESS_CONTEXT))
            return F.transform(serious, lambda h: F.struct(
                F.get(names, h["rule"]).alias("category"), h["match"].alias("match"), h["start"].alias("start"), h["end"].alias("end")))

        return let(blocks(text), harmful).cast(FINDING_TYPE)

    none = F.array().cast(FINDING_TYPE)
    return let(marked_tails(text, _BEGINNINGS), lambda p: F.when(
        F.size(p) > 0, let(hits(p), lambda h: F.when(F.size(h) > 0, let(apart(h), kept)).otherwise(none))).otherwise(none))


def resolve_findings(findings: Column) -> Column:
    """Non-overlapping findings: later starts first, pattern order among equals; returned by ascending start."""
    indexed = F.transform(
        findings,
        lambda s, i: F.struct(
            (-s["start"]).alias("key"), i.alias("i"), s["category"].alias("category"), s["start"].alias("start"),
            s["end"].alias("end"),
        ),
    )
    # Starts come in falling order, so a finding can only touch the one kept last.
    return F.reverse(keep_apart(F.array_sort(indexed), lambda last, s: last["start"] < s["end"]))


def redact_sensitive(text: Column, cfg: RedactionConfig = RedactionConfig()) -> Column:
    """Replace protected mentions by a flag or a placeholder; mode ``log`` leaves the text as it is."""
    if cfg.sensitive_mode == "log":
        return text

    def label(category: Column) -> Column:
        if cfg.sensitive_mode == "flag":
            return F.concat(F.lit("[SENSITIVE:"), category, F.lit("]"))
        if cfg.placeholder == "[TYPE]":
            return F.concat(F.lit("[SENSITIVE_"), category, F.lit("]"))
        return F.lit(cfg.placeholder)

    def rewrite(findings: Column) -> Column:
        marks = F.transform(
            resolve_findings(findings),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s["category"]).alias("label")),
        )
        return replace_spans(text, marks)

    return let(sensitive_findings(text), rewrite)


def redact_personal(text: Column, cfg: RedactionConfig = RedactionConfig()) -> Column:
    """The regex redactors in their fixed order, without the protected categories."""
    steps = (
        (cfg.emails, redact_emails), (cfg.phones, redact_phones), (cfg.credit_cards, redact_credit_cards),
        (cfg.bank_accounts, redact_bank_accounts), (cfg.id_numbers, redact_id_numbers),
        (cfg.birth_dates, redact_birth_dates), (cfg.ip_addresses, redact_ip_addresses),
        (cfg.addresses, redact_addresses), (cfg.names, redact_names),
    )
    for wanted, step in steps:
        text = step(text, cfg) if wanted else text
    return text


def redact_pii(text: Column, cfg: RedactionConfig = RedactionConfig()) -> Column:
    """Full redaction of one text column, white space collapsed at the end."""

    def finish(personal: Column) -> Column:
        body = redact_sensitive(personal, cfg) if cfg.sensitive else personal
        return F.trim(F.regexp_replace(body, r"(?U)\s+", " "))

    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, text).otherwise(
        let(redact_personal(text, cfg), finish)
    )


def detect_sensitive(texts: DataFrame, text: str = "text", key: str = "note_id") -> DataFrame:
    rows = explode_items(texts, sensitive_findings(F.col(text)), "s", key)
    return rows.select(
        key, "s.category", F.col("s.match").alias("matched"), F.col("s.start").alias("span_start"),
        F.col("s.end").alias("span_end"),
    )


def _violations(spans: Column, kind: str, risk: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            F.lit(kind).alias("type"), s["match"].alias("match"), s["start"].alias("start"), s["end"].alias("end"),
            F.lit(risk).alias("risk"),
        ),
    )


def _once(text: Column, pattern: str, kind: str) -> Column:
    hidden = F.array(
        F.struct(F.lit(kind).alias("type"), F.lit("[REDACTED]").alias("match"), F.lit(0).alias("start"),
                 F.lit(0).alias("end"), F.lit("critical").alias("risk"))
    )
    return F.when(text.rlike(pattern), hidden).otherwise(_violations(no_spans(), kind, "critical"))


def text_violations(text: Column) -> Column:
    """Array of (type, match, start, end, risk); protected categories count once each."""

    def first_of_category(found: Column) -> Column:
        # Findings come in pattern order, so those of a category stand together.
        firsts = F.filter(found, lambda s, i: F.coalesce(F.get(found, i - 1)["category"] != s["category"], F.lit(True)))
        return F.transform(
            firsts,
            lambda s: F.struct(
                s["category"].alias("type"), s["match"].alias("match"), s["start"].alias("start"),
                s["end"].alias("end"), F.lit("critical").alias("risk"),
            ),
        )

    def holding(letter: str, pattern: str) -> Column:
        """Spans of a pattern that can't do without ``letter``, which is sought first."""
        return F.when(F.contains(text, F.lit(letter)), find_spans(text, pattern)).otherwise(no_spans())

    return F.concat(
        _violations(holding("@", patterns.EMAIL), "EMAIL", "high"),
        *[_violations(holding(letter, p), "PHONE", "high") for letter, p in zip("0+(", patterns.PHONES, strict=True)],
        _violations(find_spans(text, patterns.POSTAL), "ADDRESS", "medium"),
        _once(text, patterns.CREDIT_CARD, "CREDIT_CARD"),
        _once(text, patterns.IBAN, "IBAN"),
        let(sensitive_findings(text), first_of_category),
    ).cast(VIOLATION_TYPE)


def audit_text(texts: DataFrame, text: str = "text") -> DataFrame:
    """Add ``violations``, ``violation_count``, ``has_violations`` and ``risk_level``."""
    checked = texts.withColumn("violations", text_violations(F.coalesce(F.col(text), F.lit(""))))
    worst = F.array_max(
        F.transform("violations", lambda v: F.array_position(F.lit(list(RISK_ORDER)), v["risk"]).cast("int"))
    )
    level = F.coalesce(F.element_at(F.lit(list(RISK_ORDER)), worst), F.lit("compliant"))
    return checked.select(
        "*",
        F.size("violations").alias("violation_count"),
        (F.size("violations") > 0).alias("has_violations"),
        F.when(F.size("violations") > 0, level).otherwise("compliant").alias("risk_level"),
    )


def audit_summary(audited: DataFrame) -> DataFrame:
    """One row: totals, compliance rate and the number of records on each risk level."""
    return audited.agg(
        F.count("*").alias("total_records"),
        F.count_if("has_violations").alias("records_with_violations"),
        F.coalesce(F.sum("violation_count"), F.lit(0)).alias("total_violations"),
        *[F.count_if(F.col("risk_level") == r).alias(r) for r in (*RISK_ORDER, "compliant")],
    ).withColumn(
        "compliance_rate",
        F.round(rate(F.col("total_records") - F.col("records_with_violations"), F.col("total_records"), 4), 4),
    )


def violation_types(audited: DataFrame) -> DataFrame:
    kinds = explode_items(audited, F.transform("violations", lambda v: v["type"]), "type")
    return kinds.groupBy("type").agg(F.count("*").alias("violations"))


def audit_samples(audited: DataFrame, key: str = "note_id", k: int = 10) -> DataFrame:
    return audited.where("has_violations").select(key, "risk_level", "violation_count").orderBy(key).limit(k)


def ngrams_with_spans(texts: DataFrame, text: str = "text", key: str = "note_id", max_n: int = 3) -> DataFrame:
    """Word n-grams with the span from the first to the last word; lone skip words are left out."""
    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(gram_batches(max_n), f"`{key}` {kind}, phrase string, span_start int, span_end int")


def sensitive_by_similarity(
    phrases: DataFrame,
    references: list[tuple[str, list[float]]],
    texts: DataFrame | None = None,
    classes: DataFrame | None = None,
    key: str = "note_id",
    similarity: float = 0.82,
    margin: float = 0.05,
    confidence: float = 0.60,
) -> DataFrame:
    """Phrases ``(key, phrase, span_start, span_end, embedding)`` close to a protected reference vector.

    ``references`` is a short list of (category, unit vector) written or trained beforehand, category ``SAFE``
    included; it is a literal, so each phrase is scored where it lies. ``classes`` may bring a classifier's
    opinion per phrase ``(phrase, predicted, probability)``. Overlapping hits of a note keep the best score.
    """
    table = F.array(
        *[F.struct(F.lit(c).alias("category"), F.lit([float(x) for x in v]).alias("vector")) for c, v in references]
    )
    scored = F.transform(
        table, lambda r: F.struct(dot(F.col("embedding"), r["vector"]).alias("score"), r["category"].alias("category"))
    )
    safe = F.array_max(
        F.transform(F.filter("scored", lambda r: r["category"] == "SAFE"), lambda r: r["score"])
    )
    hits = (
        phrases.withColumn("scored", scored)
        .withColumn("best", F.array_max("scored"))
        .withColumn("safe", safe)
        .where((F.col("best.category") != "SAFE") & (F.col("best.score") >= similarity))
        .where(F.col("safe").isNull() | (F.col("best.score") > F.col("safe") + margin))
        .select(key, "phrase", "span_start", "span_end", F.col("best.category").alias("label"),
                F.col("best.score").alias("score"))
    )
    if classes is not None:
        hits = (
            hits.join(classes, "phrase")
            .where((F.col("predicted") != "SAFE") & (F.col("probability") >= confidence))
            .select(key, "phrase", "span_start", "span_end", F.col("predicted").alias("label"),
                    F.greatest("score", "probability").alias("score"))
        )
    if texts is not None:
        hits = hits.join(texts.select(key, "text"), key).where(
            ~context(F.col("text"), F.col("span_start"), F.col("span_end"), 40).rlike(patterns.HARMLESS_CONTEXT)
        ).drop("text")
    ranked = F.array_sort(
        F.collect_list(
            F.struct((-F.round("score", 4)).alias("key"), F.col("span_start").alias("start"),
                     F.col("span_end").alias("end"), "phrase", "label")
        )
    )
    kept = keep_disjoint(
        F.col("spans"), "array<struct<key:double,start:int,end:int,phrase:string,label:string>>"
    )
    # One list per note: it cannot grow beyond the phrases of that single text.
    per_note = hits.groupBy(key).agg(ranked.alias("spans")).select(key, F.explode(kept).alias("s"))
    return per_note.select(
        key, F.col("s.phrase").alias("token"), "s.label", (-F.col("s.key")).alias("score"),
        F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"),
    )


def sensitive_novel_only(hits: DataFrame, regex_hits: DataFrame, key: str = "note_id") -> DataFrame:
    """Hits that touch no regex finding of the same text."""
    other = regex_hits.select(
        F.col(key).alias("_k"), F.col("span_start").alias("_s"), F.col("span_end").alias("_e")
    )
    touch = (F.col(key) == F.col("_k")) & (F.col("span_start") < F.col("_e")) & (F.col("span_end") > F.col("_s"))
    return hits.join(other, touch, "left_anti")


def apply_hits(texts: DataFrame, hits: DataFrame, cfg: RedactionConfig = RedactionConfig(),
               key: str = "note_id") -> DataFrame:
    """Rewrite ``text`` at the given disjoint hits."""
    if cfg.sensitive_mode == "log":
        return texts
    prefix = "[SENSITIVE:" if cfg.sensitive_mode == "flag" else "[SENSITIVE_"
    mark = F.concat(F.lit(prefix), F.col("label"), F.lit("]"))
    if cfg.sensitive_mode == "redact" and cfg.placeholder != "[TYPE]":
        mark = F.lit(cfg.placeholder)
    marks = hits.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col("span_start").alias("start"), F.col("span_end").alias("end"),
                                             mark.alias("label")))).alias("_marks")
    )
    marked = F.coalesce("_marks", F.array().cast(TAGGED_TYPE))
    return texts.join(marks, key, "left").withColumn("text", replace_spans(F.col("text"), marked)).drop("_marks")


def sanitize_training_data(texts: DataFrame, enabled: bool = True, strict: bool = True,
                           cfg: RedactionConfig = RedactionConfig()) -> DataFrame:
    """Redact only the rows that have violations. Strict mode refuses to pass data on unchecked."""
    if not enabled:
        if strict:
            raise ValueError("strict mode does not allow training on unchecked text")
        return texts
    return audit_text(texts).withColumn(
        "text", F.when(F.col("has_violations"), redact_pii(F.col("text"), cfg)).otherwise(F.col("text"))
    )


def sanitize_report(sanitized: DataFrame) -> DataFrame:
    """Counts of filtered rows and of violation types as one JSON document. Rows and types are counted in one scan."""
    kinds = sanitized.select("has_violations", F.posexplode_outer(F.transform("violations", lambda v: v["type"])).alias("pos", "type"))
    first = F.coalesce("pos", F.lit(0)) == 0  # one line of a row, and the only one of a row without violations
    counts = kinds.groupBy("type").agg(
        F.count("type").alias("violations"), F.count_if(first).alias("total"), F.count_if(first & F.col("has_violations")).alias("filtered"))
    found = F.when(F.col("type").isNotNull(), F.struct("type", "violations"))
    none = F.lit(0).cast("long")
    return counts.agg(
        F.coalesce(F.sum("total"), none).alias("total"), F.coalesce(F.sum("filtered"), none).alias("filtered"),
        F.map_from_entries(F.array_sort(F.collect_list(found))).alias("pii_types"),
    ).select(F.to_json(F.struct("total", "filtered", "pii_types")).alias("report"))


def filter_sensitive_keywords(vocabulary: DataFrame, term: str = "term") -> DataFrame:
    return audit_text(vocabulary, term).where(~F.col("has_violations")).select(*vocabulary.columns)


def audit_report(files: DataFrame) -> DataFrame:
    """One row over whole files ``(path, text)``: how many were audited, how many violations, whether all comply."""
    found = audit_artifacts(files).agg(F.sum("violations").alias("found"), F.count("*").alias("files_with_violations"))
    report = one_row(files.agg(F.count("*").alias("files_audited")), found)
    violations = F.coalesce("found", F.lit(0))
    return report.select("files_audited", violations.alias("violations_found"), "files_with_violations", (violations == 0).alias("compliant"))


def audit_artifacts(files: DataFrame) -> DataFrame:
    """Personal data in whole files ``(path, text)``, with numbers that only look like it left out."""
    text = F.col("text")

    def keep(spans: Column, width: int, excluded: tuple[str, ...]) -> Column:
        return F.filter(
            spans,
            lambda s: ~F.exists(
                F.lit(list(excluded)), lambda x: F.contains(context(text, s["start"], s["end"], width), x)
            ),
        )

    numeric = (".", '"loss"', '"accuracy"', '"epoch"', "e-", "E-")
    found = F.concat(
        _violations(find_spans(text, patterns.EMAIL), "EMAIL", "high"),
        *[_violations(keep(find_spans(text, p), 5, numeric), "PHONE", "high") for p in patterns.PHONES],
        _violations(keep(find_spans(text, patterns.CREDIT_CARD), 10, ("0.", '": ')), "CREDIT_CARD", "critical"),
        _violations(keep(find_spans(text, patterns.IBAN), 10, (": 0.", ", 0.", "[0.", ": ")), "IBAN", "critical"),
    ).cast(VIOLATION_TYPE)
    rows = explode_items(files, found, "v", "path")
    return rows.groupBy("path").agg(
        F.count("*").alias("violations"),
        F.when(F.count_if(F.col("v.risk") == "critical") > 0, "critical").otherwise("high").alias("risk_level"),
    )
