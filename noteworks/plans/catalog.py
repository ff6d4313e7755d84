"""Import every module that registers queries."""

from noteworks.plans import (  # noqa: F401
    crm_queries,
    feature_queries,
    graph_queries,
    keyphrase_queries,
    marked_queries,
    privacy_queries,
    source_queries,
    text_queries,
    vector_queries,
)
from noteworks.plans.registry import CHECKS, QUERIES  # noqa: F401
