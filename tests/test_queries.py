"""Every query with SQL gives the same rows as DuckDB over whole tables."""

from collections import Counter
from glob import glob
from pathlib import Path

import duckdb
import pytest

from quirefold import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob(f"{SF}/*.parquet"):
        c.execute(f"create view {Path(f).stem} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v if v is None or isinstance(v, (str, bool, int, list)) else float(v)


@pytest.mark.parametrize("name", sorted(plans.sql()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    got = Counter(tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect())
    d = duck.execute(plans.sql()[name])
    names = [x[0] for x in d.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in d.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.sql())))
def test_runs(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0
