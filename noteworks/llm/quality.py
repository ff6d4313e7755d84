"""Quality rules: a table of thresholds becomes one Spark projection over each whole text."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteworks.llm import common
from noteworks.llm.common import let

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# The commonest function words of the languages that the rules know; a text in any of them passes.
STOP_WORDS = (
    "the of and to in a is that it for on was with as be at by this "
    "de la le les et des un une est en que qui dans pour pas "
    "der die das und ist ein eine den mit zu von auf nicht für "
    "el los las y una por con no se del es su lo"
).split()


class Rule(NamedTuple):
    """``least <= measure <= most`` for texts of at least ``from_words`` words; a null bound is open."""

    name: str
    measure: str
    least: float | None
    most: float | None
    from_words: int = 0


# Names of measures are those of ``measures``.
RULES = (
    Rule("mean_word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", "symbol_ratio", None, 0.10),
    Rule("capital_letters", "capital_ratio", None, 0.40),
    Rule("stop_words", "stop_ratio", 0.02, None, 50),
    Rule("repeated_lines", "dup_line_ratio", None, 0.30),
)


def repeat_words(w: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in this text, the first occurrence included.

    Windows are compared by the 64-bit hash of their word hashes; only texts in which two are equal sort them.
    """

    def keyed(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - window)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(window)]))

    def covered(keys: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twin = F.filter(s, lambda x, i: (F.get(s, i - 1)["k"] == x["k"]) | (F.get(s, i + 1)["k"] == x["k"]))
            starts = F.array_sort(F.transform(twin, lambda x: x["i"]))
            state = F.aggregate(
                starts,
                F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
                lambda a, i: F.struct((i + window).alias("end"), (a["n"] + i + window - F.greatest(i, a["end"])).alias("n")),
            )
            return state["n"]

        return let(F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))), of_sorted)

    def over(h: Column) -> Column:
        return let(keyed(h), lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(k)))

    return F.when(F.size(w) < window, F.lit(0)).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), over)).cast("long")


def measures(text: str = "text", min_lines: int = 1) -> Column:
    """One struct of all counts and ratios of a text. Null counts as empty; an empty text has ratios of zero, and so
    have repeated lines of a text with fewer than ``min_lines`` lines."""
    t = common.text_or_empty(text)
    bare = F.translate(t, common.SPACE_CHARS, "")
    letters = F.regexp_count(t, F.lit(r"\p{L}"))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).alias("n_stop_words"),
        )

    def lines(rows: Column) -> Column:
        return F.struct(F.size(rows).alias("n_lines"), (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"))

    with_word = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, common.SPACE_CHARS, "")) > 0)

    def ratios(c: Column, r: Column, n_chars: Column, n_letters: Column) -> Column:
        n, symbols = c["n_words"], F.length(t) - F.length(F.translate(t, SYMBOLS, ""))

        def per(value: Column, by: Column) -> Column:
            return F.when(by > 0, value / by).otherwise(F.lit(0.0))

        return F.struct(
            n.alias("n_words"), n_chars.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
            r["n_dup_lines"].alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"),
            per(n_chars, n).alias("mean_word_chars"), per(symbols, n).alias("symbol_ratio"),
            per(F.regexp_count(t, F.lit(r"\p{Lu}")), n_letters).alias("capital_ratio"),
            per(c["n_stop_words"], n).alias("stop_ratio"),
            F.when(r["n_lines"] >= min_lines, r["n_dup_lines"] / r["n_lines"]).otherwise(F.lit(0.0)).alias("dup_line_ratio"),
        )

    return let(
        let(common.words(t), counts),
        lambda c: let(let(with_word, lines), lambda r: let(F.length(bare), lambda n: let(letters, lambda k: ratios(c, r, n, k)))),
    )


def broken_rule(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Name of the first rule of the table that a text breaks, else null: the table as one CASE expression."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        value, bad = m[rule.measure], F.lit(False)
        if rule.least is not None:
            bad = bad | (value < rule.least)
        if rule.most is not None:
            bad = bad | (value > rule.most)
        out = F.when((m["n_words"] >= rule.from_words) & bad, F.lit(rule.name)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES,
                min_lines: int = 1) -> DataFrame:
    """``docs`` with one struct column ``quality``: the counts, ``base_failed``, ``broken`` and ``kept``.

    No shuffle and no user function. Null and empty texts have no words, so they fail the base rule; repeated
    rows are judged alike, each for itself; other columns are carried along untouched (a column that is itself
    called ``quality`` is replaced).
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "quality"]

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
        broken = broken_rule(m, rules)
        kept = ~failed & broken.isNull()
        return m.withField("base_failed", failed).withField("broken", broken).withField("kept", kept)

    # One expression that names the measures once: a filter on a field of it must not compute them for each rule.
    return docs.select(*rest, let(measures(text, min_lines), verdict).alias("quality"))
