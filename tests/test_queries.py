"""Every registered query that has SQL gives the rows of that SQL; the others run."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestone import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    try:
        return round(float(v), 5) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in registry.ORACLE_SQL:
        assert got
        return
    rel = con.sql(registry.ORACLE_SQL[name])
    names = list(rel.columns)
    assert sorted(names) == sorted(df.columns)
    want = [tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in rel.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_flagship_is_registered():
    assert registry.FLAGSHIP in registry.QUERIES
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
