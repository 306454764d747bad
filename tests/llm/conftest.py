import pytest

TEXT = "id long, text string"


@pytest.fixture(scope="session")
def texts(spark):
    """A table of texts (numbered from 0, or given pairs) dealt over a few partitions."""
    def build(rows, extra=""):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, TEXT + extra).repartition(3)

    return build
