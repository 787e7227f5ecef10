"""Every registered query against its SQL, on the smallest tables."""

import glob
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corelode import plans
from corelode.plans import base as B

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(row):
    return tuple("~" if v is None else repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_agrees_with_sql(spark, tables, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    sql = tables.sql(plans.SQL[name])
    assert sorted(sql.columns) == columns
    want = sorted(plain(r) for r in sql.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert sorted(plain(r) for r in df.select(*columns).collect()) == want


@pytest.mark.parametrize("name", ["path_positions_all", "md_from_tvd_all", "curve_export_all"])
def test_query_covers_every_sample(spark, name):
    assert plans.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_a_session():
    at = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=at, check=True, timeout=120)


def test_zone_means_are_sums_in_the_order_of_depth(spark, tmp_path):
    """Over several partitions, in any order of the rows and where an aggregation goes on by sorting: to the last bit as summed down the well."""
    for name in ("supplier", "lineitem"):
        spark.read.parquet(f"{SF}/{name}.parquet").orderBy(F.rand(3)).repartition(5).write.parquet(f"{tmp_path}/{name}.parquet")
    kept, limit = B.rounded, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    spark.conf.set(limit, 2)
    try:
        B.rounded = lambda df, *a, **k: df
        got = {(r.well_id, r.zone): r for r in plans.QUERIES["zone_table"](spark, str(tmp_path)).collect()}
    finally:
        B.rounded = kept
        spark.conf.unset(limit)
    rows = {}
    for r in B.zoned(spark, SF).select("well_id", "zone", "md", "rt", "nphi").collect():
        rows.setdefault((r.well_id, r.zone), []).append(r)
    assert set(got) == set(rows)
    for key, each in rows.items():
        for c in ("rt", "nphi"):
            total = 0.0
            for r in sorted(each, key=lambda r: r.md):
                total += r[c]
            assert getattr(got[key], f"{c}_mean") == total / len(each)


@pytest.mark.parametrize("name", ["las_round_trip", "las_problems", "merge_runs"])
def test_what_is_read_several_times_is_made_once(spark, name):
    """Nothing of the result is derived from the samples again: it reads tables that were written."""
    assert "l_suppkey" not in plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_cones_number_their_samples_once(spark, monkeypatch):
    from corelode.operators import surface

    plans_ = []
    monkeypatch.setattr(surface, "written", lambda df, what: plans_.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    plans.QUERIES["cone_contours"](spark, SF)
    assert [p.count("row_number() windowspecdefinition(l_suppkey") for p in plans_] == [1]
