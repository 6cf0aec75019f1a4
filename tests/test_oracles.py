"""Every query of the document engine against its SQL twin, and all of them for running at all."""

import duckdb
import pytest
from ledgerspark.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, db, name):
    df = QUERIES[name](spark, SF)
    cur = db.execute(ORACLES[name])
    columns = [x[0] for x in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want, got = rows(columns, cur.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(want) > 0
    assert len(got) == len(want)
    assert [x for x in zip(got, want, strict=True) if x[0] != x[1]][:3] == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
