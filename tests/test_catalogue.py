"""Catalogue queries against their SQL twins."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from siftline import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return datetime.datetime(v.year, v.month, v.day) if isinstance(v, datetime.date) else v


def same(spark, name, frame, sql, views):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for v, table in (views or {}).items():
        con.register(v, table)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    out = con.sql(sql)
    assert columns == sorted(out.columns)
    want = sorted((tuple(plain(r[out.columns.index(c)]) for c in columns) for r in out.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b) if all(isinstance(x, (int, float)) for x in a) else a == b


@pytest.mark.parametrize("name", list(catalogue.CASES))
def test_equals_sql(spark, name):
    same(spark, name, catalogue.QUERIES[name](spark, SF), catalogue.ORACLE_SQL[name], None)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 2


def test_rank_is_a_permutation(spark):
    frame = catalogue.QUERIES["win_over_groups"](spark, SF)
    places = sorted(r["place"] for r in frame.collect())
    assert places == list(range(1, len(places) + 1))
