import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from strata.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build("strata-tests", "8")
    yield session
    session.stop()


@pytest.fixture
def sources(spark):
    """Sources from (path, text) pairs."""
    from strata.sources.corpus import as_sources
    return lambda *files: as_sources(spark.createDataFrame(list(files), "path string, text string"))


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)
