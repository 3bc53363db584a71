from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from seqledger.schemas import SCHEMAS  # noqa: E402
from seqledger.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    return session


@pytest.fixture(scope="session")
def make(spark):
    """make(table=[{...}, ...]) -> all tables, rows filled up with nulls and false flags."""

    def build(**rows):
        out = {}
        for name, schema in SCHEMAS.items():
            full = []
            for r in rows.get(name, []):
                r = {"deprecated": False, "deleted": False, **r} if "id" in schema.fieldNames() else r
                full.append(tuple(r.get(c) for c in schema.fieldNames()))
            out[name] = spark.createDataFrame(full, schema)
        return out

    return build


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
