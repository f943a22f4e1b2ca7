import glob
import os
from collections import Counter

import __spark_entry__
import duckdb
import pytest

from voxelake import catalogue, catalogue_nodes

ORACLE = catalogue.oracle_sql() | catalogue_nodes.oracle_sql()
QUERIES = catalogue.queries() | catalogue_nodes.queries()


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_equal_sql(spark, sf, tables, name):
    df = QUERIES[name](spark, sf)
    found = tables.execute(ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(row[names.index(c)] for c in sorted(names)) for row in found.fetchall())
    got = Counter(tuple(r[c] for c in sorted(names)) for r in df.collect())
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_give_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = catalogue.queries()["aabb_and_interval"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "l_partkey" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_stored_clouds_are_built_again_when_gone(spark, sf):
    import shutil

    first = catalogue._octree(spark, sf).num_points()
    folder = catalogue._STORED[(spark.sparkContext.applicationId, sf, "octree")]
    shutil.rmtree(folder.removeprefix("file://"))
    assert catalogue._octree(spark, sf).num_points() == first > 0
    assert catalogue._STORED[(spark.sparkContext.applicationId, sf, "octree")] != folder


@pytest.mark.parametrize("name", ["octree_build", "visible_nodes"])
def test_octrees_deeper_than_the_sql(spark, sf, tmp_path, monkeypatch, name):
    """User ids far apart make octrees of more levels than the SQL counts; with more levels it gives the same rows."""
    con = duckdb.connect()
    con.execute(f"copy (select event_id + k * 1000000 as event_id, ts, user_id + k * 1000000 as user_id, value from '{sf}/events.parquet', range(8) t(k)) to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    monkeypatch.setattr(catalogue_nodes, "SQL_LEVELS", 16)
    found = con.execute(catalogue_nodes.oracle_sql()[name])
    names = [c[0] for c in found.description]
    df = QUERIES[name](spark, str(tmp_path)).select(*names)
    assert Counter(map(tuple, df.collect())) == Counter(found.fetchall())
    assert df.where("length(node_id) > 10").count() > 0
