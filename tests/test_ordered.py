"""Running values and neighbours over many blocks of rows."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from siftline import catalogue
from siftline.api import Table, run
from siftline.operators import ordered
from tests.test_catalogue import SF, same


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 7)


def test_blocks_follow_one_another(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 12)
    words = [None, "", "a", "ab", "b" * 200, "b" * 200 + "c"]
    moments = [None, datetime.datetime(2024, 1, 1, 3, 4, 5, 6), datetime.datetime(1960, 5, 5)]
    dice = random.Random(5)
    data = [(dice.choice(words), dice.choice(moments), dice.choice([None, float("nan"), -1.5, 2.0]), i) for i in range(120)]
    rows = spark.createDataFrame(data, "w string, t timestamp, x double, i int")
    for downs in ((False, True, False, True), (True, False, True, False)):
        keys = [F.struct("w", "t") if downs[0] else F.col("w"), F.col("t"), F.col("x"), F.col("i")]
        found, blocks = ordered.blocked(rows, list(zip(keys, downs, strict=True)))
        assert blocks > 7
        order = [k.desc_nulls_last() if down else k.asc_nulls_first() for k, down in zip(keys, downs, strict=True)]
        places = [r["_block"] for r in found.orderBy(*order).collect()]
        assert places == sorted(places) and set(places) <= set(range(blocks))
        assert max(places.count(p) for p in set(places)) < 30


def test_running_equals_sql(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 70)
    name = "dyn_var_running"
    same(spark, name, catalogue.QUERIES[name](spark, SF), catalogue.ORACLE_SQL[name], None)


def undivided(frame):
    """Exchanges that bring all rows of the table to one task; rows of block sums, which are few, come from an aggregate."""
    plan = frame._jdf.queryExecution().executedPlan().toString().splitlines()
    return [x for x, below in zip(plan, plan[1:], strict=False) if "Exchange SinglePartition" in x and "HashAggregate" not in below]


def window_parts(frame):
    """What each window over rows is dealt by."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [re.search(r"Exchange (\w+)(\(\S+)?", after)[0] for after in plan.split(" Window [")[1:]]


def test_running_windows_are_within_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 70)
    frame = catalogue.QUERIES["dyn_var_running"](spark, SF)
    assert not undivided(frame)
    assert window_parts(frame)[0].startswith("Exchange hashpartitioning(_block")


VARIABLES = "sum:1:@sum+@1;less:0.5:@less-@1;high:3:greatest(@high,@1);low:9:least(@low,@1);kept:none:when(@2='a',@1,@kept);joined:>:@joined+@2;twice:0:@twice+@sum"


@pytest.mark.parametrize("everywhere", ["", ":g"])
def test_recurrences_over_files_and_blocks(spark, monkeypatch, tmp_path, everywhere):
    dice = random.Random(3)
    for f in range(3):
        (tmp_path / f"{f}.txt").write_text("".join(f"{dice.randrange(50)} {dice.choice('abc')}\n" for _ in range(40)))
    spec = ";".join(v + everywhere for v in VARIABLES.split(";"))
    query = "p d/ / | t @1 long | s @file as file, @raw as raw, @sum as s, @less as l, @high as h, @low as w, @kept as k, @joined as j, @twice as t"
    # files apart, so that each has its number; the query as it is over one block
    sources = [str(tmp_path / f"{f}.txt") for f in range(3)]
    want = [tuple(r) for r in run(spark, query, *sources, variables=spec).frame.collect()]
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 7)
    got = [tuple(r) for r in run(spark, query, *sources, variables=spec).frame.collect()]
    assert len(want) == 120 and got == want
    # and in plain Python
    values = {}
    for r in want:
        key = r[0] if not everywhere else ""
        at = values.setdefault(key, {"s": 1, "l": 0.5, "h": 3, "w": 9, "k": "none", "j": ">", "t": 0})
        n, c = r[1].split(" ")
        at["s"] += int(n)
        at["l"] -= int(n)
        at["h"], at["w"] = max(at["h"], int(n)), min(at["w"], int(n))
        at["k"] = n if c == "a" else at["k"]
        at["j"] += c
        at["t"] += at["s"]
        assert (r[2], r[3], r[4], r[5], r[6], r[7], r[8]) == (at["s"], at["l"], at["h"], at["w"], at["k"], at["j"], at["t"])


def test_value_before_a_block(spark, small_blocks):
    rows = spark.createDataFrame([(i, i % 5) for i in range(60)], "k long, v long")
    # a row is kept if its value was the one before some row up to it
    out = run(spark, "s k, rcount(1,1,v) as n", Table(rows, "k"), variables="r:@sum;before:-1:v;sum:0:@sum+1").frame
    assert out.count() == 60
    out = run(spark, "s k as k, rmember(1,1,-1) as last", Table(rows, "k"), variables="r:@before;before:-7:v").frame
    assert [r["last"] for r in out.orderBy("k").collect()] == ["-7", *[str((i - 1) % 5) for i in range(1, 60)]]
    out = run(spark, "s k as k, rmember(1,1,-1) as last", Table(rows, "k"), variables="r:@sum;sum:10:@sum+1").frame
    assert [r["last"] for r in out.orderBy("k").collect()] == [str(10 + i) for i in range(60)]


def test_nearby_windows_are_within_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 70)
    frame = catalogue.QUERIES["win_nearby"](spark, SF)
    assert not undivided(frame)
    same(spark, "win_nearby", frame, catalogue.ORACLE_SQL["win_nearby"], None)


def test_nearby_over_blocks(spark, small_blocks):
    dice = random.Random(8)
    data = [(i, dice.choice([None, 1, 2, 3]), dice.choice(["a", "b", None])) for i in range(60)]
    dice.shuffle(data)
    query = "s k as k, nearby(v;k;-1) as a, nearby(v;k;20;-5) as b, nearby(w;v desc,k;-3;'none') as c, nearby(v;k;1;k) as d, nearby(v;k;0;9) as e, nearby(w;k;100;'x') as f"
    frame = run(spark, query, Table(spark.createDataFrame(data, "k long, v long, w string"), "k")).frame
    got = {r["k"]: tuple(r)[1:] for r in frame.collect()}
    by_key = sorted(data)
    by_value = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))

    def at(rows, i, place, other):
        return rows[i][place] if 0 <= i < len(rows) else other

    assert len(got) == 60
    for i, (k, v, _) in enumerate(by_key):
        j = [r[0] for r in by_value].index(k)
        want = (at(by_key, i - 1, 1, None), at(by_key, i + 20, 1, -5), at(by_value, j - 3, 2, "none"), at(by_key, i + 1, 1, k), v, "x")
        assert got[k] == want
