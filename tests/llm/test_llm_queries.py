"""Every query of the subpackage over its whole tables, against its SQL where it has one."""

import os
from collections import Counter
from pathlib import Path

import pytest

from wakeline.llm import queries

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = Counter(tuple(r[c] for c in cols) for r in df.select(cols).collect())
    assert got
    if name.endswith("_found"):
        assert max(got.values()) == 1
    if name in queries.SQL:
        duckdb = pytest.importorskip("duckdb")
        c = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
        found = c.execute(queries.SQL[name])
        names = [x[0] for x in found.description]
        assert got == Counter(tuple(r[names.index(k)] for k in cols) for r in found.fetchall())
