"""Scalar text functions: cleaning, normalising, slugs, identifiers, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteworks import config


def clean_text(text: Column) -> Column:
    """Null becomes empty; runs of white space become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def normalize_language(lang: Column) -> Column:
    code = F.upper(F.trim(lang))
    names = F.create_map(*[F.lit(x) for pair in config.LANGUAGE_NAMES.items() for x in pair])
    return F.coalesce(names[code], F.left(code, F.lit(2)))


def parse_date(text: Column) -> Column:
    """First format that fits wins; anything unparseable is null."""
    formats = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MM-yyyy")
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats])


def normalize_text(text: Column) -> Column:
    return F.lower(clean_text(text))


def slugify(text: Column, size: int = 50) -> Column:
    lowered = F.lower(F.trim(text))
    plain = F.regexp_replace(lowered, r"(?U)[^\w\s-]", "")
    return F.left(F.regexp_replace(plain, r"(?U)[\s-]+", "_"), F.lit(size))


def concept_slug(term: Column, size: int = 30) -> Column:
    joined = F.translate(F.lower(term), " -", "__")
    return F.left(F.regexp_replace(joined, r"(?U)[^\p{Alnum}_]", ""), F.lit(size))


def concept_id(label: Column, index: Column) -> Column:
    return F.format_string("CONCEPT_%04d_%s", index, F.left(F.md5(label), F.lit(6)))


def clean_candidate(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(text)), r"(?U)^\W+|\W+$", "")
    return F.regexp_replace(bare, r"(?U)\s+", " ")


def is_latin_only(text: Column) -> Column:
    return text.rlike(config.LATIN_ONLY_PATTERN)


def words(text: Column) -> Column:
    """Blank-separated words; empty text has none."""
    return F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != "")


def standardize_terms(text: Column, terms: dict[str, str] | None = None) -> Column:
    """Whole-phrase translation first, word by word otherwise."""
    table = config.STANDARD_TERMS if terms is None else terms
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    phrase = F.lower(F.trim(text))
    # The keys are a hash set; a map is searched from the start, so only what it holds is looked up.
    by_word = F.array_join(F.transform(words(phrase), lambda w: F.when(w.isin(list(table)), lookup[w]).otherwise(w)), " ")
    return F.when(phrase.isin(list(table)), lookup[phrase]).otherwise(by_word)


def is_valid_candidate(
    text: Column,
    stopwords: list[str] | None = None,
    known_words: list[str] | None = None,
) -> Column:
    """True when none of the rejection rules for mined phrases applies."""
    stop = list(config.STOPWORDS if stopwords is None else stopwords)  # hash sets, not lists that each word is compared with
    known = list(config.KNOWN_WORDS if known_words is None else known_words)
    parts = words(text)
    return (
        (F.length(text) >= config.MIN_TOKEN_LENGTH)
        & is_latin_only(text)
        & ~F.regexp_replace(text, r"[ .,]", "").rlike(r"(?U)^\d+$")
        & ~text.isin(stop)
        & ~F.forall(parts, lambda w: w.isin(stop))
        & ~text.isin(list(config.CONTEXT_REQUIRED_WORDS))
        & ~text.rlike(config.BARE_AGE_PATTERN)
        & ~text.rlike(r"^\d+[kK]$")
        & (F.length(F.replace(text, F.lit(" "), F.lit(""))) >= 2)
        & ~((F.size(parts) == 1) & ~F.lower(text).isin(known))
    )


def assign_bucket(terms: Column, rules: dict[str, list[str]] | None = None) -> Column:
    """First bucket, in rule order, with a keyword contained in the joined lower-case terms."""
    joined = F.lower(F.array_join(terms, " "))
    table = config.BUCKET_KEYWORDS if rules is None else rules
    picks = [
        F.when(F.exists(F.lit(list(dict.fromkeys(keywords))), lambda k: F.contains(joined, k)), F.lit(bucket))
        for bucket, keywords in table.items()
    ]
    return F.coalesce(*picks, F.lit("other"))


def bucket_from_rule(rule: Column) -> Column:
    found = F.regexp_extract(rule, r"bucket=(\S+)", 1)
    return F.when(found != "", found)


def _grams(text: Column, n: int) -> Column:
    cuts = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.transform(cuts, lambda i: F.substring(text, i, n))).otherwise(
        F.array().cast("array<string>")
    )


def share_stem(a: Column, b: Column, size: int = 4) -> Column:
    """A common substring of ``size`` or more characters, or one word inside the other."""
    x, y = F.lower(a), F.lower(b)
    return F.contains(x, y) | F.contains(y, x) | F.arrays_overlap(_grams(x, size), _grams(y, size))


def known_synonym(a: Column, b: Column) -> Column:
    pairs = [(w.lower(), i) for i, group in enumerate(config.SYNONYM_SETS) for w in group]
    lookup = F.create_map(*[F.lit(x) for pair in dict(pairs).items() for x in pair])
    return F.coalesce(lookup[F.lower(a)] == lookup[F.lower(b)], F.lit(False))


def format_profile_type(labels: Column) -> Column:
    titled = F.transform(F.slice(labels, 1, 3), lambda c: F.initcap(F.replace(c, F.lit("_"), F.lit(" "))))
    return F.when(F.coalesce(F.size(labels), F.lit(0)) <= 0, F.lit("General")).otherwise(
        F.array_join(titled, " | ")
    )


def snippet(text: Column, keyword: Column, before: int = 40, after: int = 60) -> Column:
    """Words around the first hit of ``keyword``; an ellipsis marks each cut side."""
    at = F.instr(F.lower(text), F.lower(keyword)) - 1
    left = F.greatest(at - before, F.lit(0))
    right = F.least(F.length(text), at + F.length(keyword) + after)
    body = F.trim(F.substring(text, left + 1, right - left))
    framed = F.concat(
        F.when(left > 0, F.lit("…")).otherwise(F.lit("")),
        body,
        F.when(right < F.length(text), F.lit("…")).otherwise(F.lit("")),
    )
    return F.when(at >= 0, framed).otherwise(F.lit(""))


def split_terms(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[|]"), lambda t: F.trim(t))
    return F.filter(parts, lambda t: t != "")


def join_terms(terms: Column) -> Column:
    return F.array_join(terms, "|")


def display_concept(label: Column, alias: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), alias)


def safe_float(value: Column, default: float = 0.0) -> Column:
    number = value.try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return F.when(usable, number).otherwise(F.lit(default))


def word_size_class(text: Column) -> Column:
    n = F.size(words(F.trim(text)))
    return F.when(n < 50, "Short").when(n < 150, "Medium").otherwise("Long")
