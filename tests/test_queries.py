"""Every query outside the llm subpackage against its SQL in DuckDB, over the smallest test tables."""

import os
from pathlib import Path

import pytest

from quillspark.plans import catalog

SF = os.environ.get("QUILLSPARK_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(x) for x in r]) for r in df.select(*cols).collect())
    assert len(set(cols)) == len(cols)
    if name in catalog.SQL:
        rel = duck.execute(catalog.SQL[name])
        have = [c[0] for c in rel.description]
        assert sorted(have) == cols
        assert got == sorted(repr([plain(r[have.index(c)]) for c in cols]) for r in rel.fetchall())
