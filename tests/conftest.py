import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from matchframe.session import local_session  # noqa: E402

SF_DIR = os.environ.get("MATCHFRAME_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def small_chunks(spark):
    """Pretend that a task holds 40 rows, so that ordered work is cut into chunks."""
    spark.conf.set("spark.matchframe.windowBytes", "0")
    spark.conf.set("spark.matchframe.rowsPerTask", "40")
    yield
    spark.conf.unset("spark.matchframe.windowBytes")
    spark.conf.unset("spark.matchframe.rowsPerTask")


def rows(df):
    """Rows as sorted tuples, doubles rounded."""
    def plain(x):
        return round(x, 9) if isinstance(x, float) else x

    return sorted((tuple(plain(x) for x in r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
