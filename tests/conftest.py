import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from strata.session import local_session  # noqa: E402
from strata.sources.tables import Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="8g")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def no_views_left(request):
    """Temporary views of a test do not show in the listings of the next."""
    yield
    if "spark" in request.fixturenames:
        catalog = request.getfixturevalue("spark").catalog
        for table in catalog.listTables():
            if table.isTemporary:
                catalog.dropTempView(table.name)


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, str(tmp_path / "root"))


@pytest.fixture
def frame(spark):
    """Build a frame from a DDL schema and tuples; dates may be ISO texts."""
    from pyspark.sql import functions as F

    def build(schema, *rows):
        parts = [c.strip().split() for c in schema.split(",")]
        text = ", ".join(f"{n} {'string' if t == 'date' else t}" for n, t in parts)
        df = spark.createDataFrame(list(rows), text)
        return df.select(*[F.col(n).cast(t).alias(n) for n, t in parts])

    return build
