"""Every corpus query with SQL gives what DuckDB gives on the same tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import check  # noqa: E402
from meterflow.llm.queries import SQL  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    note, good = check.compare(name, spark, check.connect(FOLDER), FOLDER)
    assert good, note
