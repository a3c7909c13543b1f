"""Every registered query with an oracle gives the oracle's rows."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return "nan" if math.isnan(value) else f"{float(value):.9g}"
    return str(value)


@pytest.mark.parametrize("name", list(ORACLE))
def test_equals_oracle(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    order = sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall())
    got = sorted(tuple(plain(r[c]) for c in order) for r in frame.collect())
    assert got == want


def test_every_query_has_a_name_in_both_maps():
    assert set(ORACLE) <= set(entry.queries())
