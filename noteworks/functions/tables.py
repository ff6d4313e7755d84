"""Table functions for SQL: dictionary matching as ``LATERAL match_aliases(lower(text))``."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

MATCH = "matched_alias string, span_start int, span_end int"


def matcher(pattern: str, cap: int) -> type:
    """Class of a table function: leftmost-longest matches of ``pattern`` between word boundaries, ``cap`` of each."""

    class MatchAliases:
        def __init__(self):
            self.find = re.compile(rf"\b(?:{pattern})\b").finditer

        def eval(self, text: str) -> Iterator[tuple[str, int, int]]:
            seen: Counter = Counter()
            for m in self.find(text or ""):
                seen[m[0]] += 1
                if seen[m[0]] <= cap:
                    yield m[0], m.start(), m.end()

    return MatchAliases


def register_match_aliases(spark: SparkSession, pattern: str, cap: int, name: str = "match_aliases") -> None:
    """Register the table function ``name(text)``; ``pattern`` comes from ``concepts.trie_pattern``."""
    spark.udtf.register(name, udtf(matcher(pattern, cap), returnType=MATCH, useArrow=True))
