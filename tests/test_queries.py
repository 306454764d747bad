"""Every query with SQL gives what DuckDB gives on the same tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402
from catalog.registry import SQL  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    note, good = check.compare(name, spark, duck, FOLDER)
    assert good, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
