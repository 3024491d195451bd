"""Every query runs, isn't empty, and equals its SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from veritome.plans import catalog

DATA = Path("/root/testdata/sf0.001")
#: Queries whose true result over the standard tables may be empty.
MAYBE_EMPTY = {"page_number_lines", "thin_documents"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings", "events", "orders"):
        c.execute(f"create view {t} as select * from '{DATA / t}.parquet'")
    return c


def plain(rows):
    cell = lambda v: round(v, 9) if isinstance(v, float) else str(list(v)) if isinstance(v, list | tuple) else v
    return sorted((tuple(map(cell, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    mine = catalog.QUERIES[name](spark, str(DATA))
    rows = [tuple(r) for r in mine.collect()]
    assert rows or name in MAYBE_EMPTY
    if name in catalog.ORACLES:
        want = db.execute(catalog.ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(mine.columns)
        order = [mine.columns.index(c) for c in columns]
        assert plain(tuple(r[i] for i in order) for r in rows) == plain(want.fetchall())
