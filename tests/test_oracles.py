"""Every query of the library against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

from passagemill import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def normal(rows):
    return sorted(tuple("NULL" if v is None or v != v else repr(round(float(v), 9)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert normal(df.select(*columns).collect()) == normal(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {c: KINDS[t] for c, t in df.dtypes} == {c: kinds[c] for c in columns}
