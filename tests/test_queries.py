import os

import duckdb
import pytest

import __spark_entry__ as entry
from kinfold.plans import queries as plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def same_rows(spark, name, query, sql, sf=SF):
    con = duckdb.connect()
    for t in plans.TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = query(spark, sf).toPandas(), con.sql(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    text = lambda d: sorted(map(str, d[cols].itertuples(index=False, name=None)))
    clean = lambda d: [x.replace("np.int32(", "(").replace("np.int64(", "(") for x in text(d)]
    assert clean(got) == clean(want), name


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_sql(spark, name):
    same_rows(spark, name, plans.QUERIES[name], plans.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["p_brand", "stack"] and got.count() == plans.table(spark, SF, "part").select("p_brand").distinct().count()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_registries_have_a_person_for_each_customer(spark):
    assert plans.QUERIES["generated_names"](spark, SF).count() == plans.table(spark, SF, "customer").count()
