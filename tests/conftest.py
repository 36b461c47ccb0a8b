import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from overhaul import build_session, ensure_checkpoint_dir  # noqa: E402
from overhaul.schema import SCHEMAS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", 8)
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


def D(x):
    return None if x is None else Decimal(str(x))


def T(s):
    return dt.datetime.fromisoformat(s)


@pytest.fixture
def make_tables(spark):
    """Build the nine tables from small row lists (missing tables are empty)."""
    def build(**rows):
        return {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()}
    return build
