"""Every catalogue query against its SQL twin on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tessella import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_twin(spark, duck, name):
    made = catalog.QUERIES[name](spark, SF)
    columns = sorted(made.columns)
    found = duck.execute(catalog.ORACLES[name])
    named = [d[0] for d in found.description]
    assert sorted(named) == columns
    want = found.df()[columns].astype(object)
    got = made.select(*columns).toPandas().astype(object)
    key = lambda d: sorted(map(repr, (tuple(None if v != v else v for v in r) for r in d.itertuples(index=False, name=None))))
    assert key(got) == key(want)
