from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from mealops.session import local_session
    return local_session(8, shuffle_partitions=4, memory="6g", app="mealops-tests")


@pytest.fixture(scope="session")
def data_dir():
    if not Path(DATA).exists():
        pytest.skip("test tables not present")
    return DATA


@pytest.fixture
def make(spark):
    """``make("a int, b string", [(1, "x"), ...])``; dates and stamps given as text."""
    def build(schema: str, rows):
        fields = [f.strip().split(" ") for f in schema.split(",")]
        raw = ", ".join(f"{n} {'string' if t in ('timestamp_ntz', 'date') else t}" for n, t in fields)
        df = spark.createDataFrame(rows, raw)
        return df.select([df[n].cast(t).alias(n) for n, t in fields])
    return build
