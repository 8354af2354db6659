"""One local session for all tests."""

import datetime
import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidesift.session import get_spark

    session = get_spark("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                        spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}", spark__sql__warehouse__dir=f"file://{tmp_path_factory.mktemp('warehouse')}")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def plain(v):
    """A value as both engines would print it."""
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(df, *columns):
    """Rows as sorted tuples of the columns in order of name."""
    columns = columns or sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
