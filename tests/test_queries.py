"""Every named query against its SQL on the smallest data set, and the driver contract."""

from __future__ import annotations

import compare
import pytest

from noteworks.plans.catalog import CHECKS, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, folder, name):
    assert compare.differences(spark, duck, name, folder) == []


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["concept_id", "language", "matches", "notes"]
    assert rows.count() > 0
