"""Queries of this subpackage against the SQL that must give the same rows."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from voxelake.llm import registry


@pytest.mark.parametrize("name", ["op8_sharding", "op11_quality_rules", "op12_conversations", "op13_merkle"])
def test_rows_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = registry.queries()[name](spark, sf)
    found = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(row[names.index(c)] for c in sorted(names)) for row in found.fetchall())
    assert Counter(tuple(r[c] for c in sorted(names)) for r in df.collect()) == want and want
