"""Query texts over small samples of our own, with the lines that they print."""

import pytest

from siftline import catalogue
from siftline.api import QueryError, run, sinks

SALES = """\
shop;fruit;kilos;price
north;pear;12;2.5
south;plum;7;3.25
north;fig;3;9
east;pear;20;2
south;pear;5;2.75"""
SENSORS = """\
[2023-03-01 06:00:00] hall 18.5 ok
[2023-03-01 06:30:00] attic 11.0 cold
[2023-03-01 07:10:00] hall 19.5 ok
[2023-03-01 08:05:00] cellar 9.0 cold"""
STAFF = """\
code boss name
10 0 Ines
11 10 Omar
12 10 Yuki
13 11 Pia
14 12 Sven
15 14 Ada"""
TAGS = "red\nblue\nred\ngreen\nblue\nred"

CASES = {
    "raw line": ("s upper(@raw), lower(@raw)", "Mixed Case", ["MIXED CASE\tmixed case"], {}),
    "regex with names": (r"p /(?P<key>\w+)=(?P<val>\d+)/ | s val, key | f val >= 10", "a=5\nbb=10\nskip\nc=77", ["10\tbb", "77\tc"], {}),
    "regex without a group": (r"p /\d{3}/ | s @1", "x123y\nnone\n4567", ["123", "456"], {}),
    "wildcard": ("p w/*-*:*/ | s @3, @1", "ab-cd:ef\n1-2:3", ["ef\tab", "3\t1"], {}),
    "delimiter with quoters": ("p d/;/\"\"/ | s @2, @3", "1;\"two;three\";4", ['"two;three"\t4'], {}),
    "repeated delimiter": ("p d/ /r | s @2", "one    two  three", ["two"], {}),
    "line mode": ("p l | s @1", "a b\nc d", ["a b", "c d"], {}),
    "quick words": ("p q/plum/", SALES, ["south;plum;7;3.25"], {}),
    "quick wildcard": ("p q/n*h;p*/w", SALES, ["north;pear;12;2.5"], {}),
    "quick regex": (r"p q/;\d;/r", SALES, ["south;plum;7;3.25", "north;fig;3;9", "south;pear;5;2.75"], {}),
    "name line": ("p d/;/ | s fruit, kilos*price | f shop='north' | o kilos", SALES, ["fig\t27", "pear\t30"], {"nameline": True}),
    "skip": ("p d/;/ | s @2 | l 1", SALES, ["plum"], {"skip": 2}),
    "group": ("p d/;/ | s shop, count(1), sum(kilos), max(price) | g shop | o 1", SALES, ["east\t1\t20\t2", "north\t2\t15\t9", "south\t2\t12\t3.25"], {"nameline": True}),
    "having": ("p d/;/ | s fruit, average(kilos) | g fruit | f count(1) > 2", SALES, ["pear\t12.333333333333334"], {"nameline": True}),
    "first of a group": ("p d/;/ | s fruit, shop | g fruit | o 1", SALES, ["fig\tnorth", "pear\tnorth", "plum\tsouth"], {"nameline": True}),
    "unique count and list": ("p d/;/ | s uniquecount(fruit), grouplist(distinct shop,'/',asc)", SALES, ["3\teast/north/south"], {"nameline": True}),
    "list in order": ("p d/;/ | s shop, grouplist(fruit,'+') | g shop | o shop desc", SALES, ["south\tplum+pear", "north\tpear+fig", "east\tpear"], {"nameline": True}),
    "empty aggregate": ("s count(1), sum(@1) | f @1 > 100", "1\n2", [], {}),
    "report": ("p d/;/ | s fruit, kilos, price, price, price | r 2:average,3:max,4:min,5:count | l 2", SALES, ["pear\t12\t2.5\t2.5\t2.5", "plum\t7\t3.25\t3.25\t3.25", "\t9.50\t3.25\t2.50\t2.00"], {"nameline": True}),
    "analytic": ("p d/;/ | s fruit, kilos, rank(fruit;kilos desc), suma(fruit;kilos) | o fruit, kilos", SALES, ["fig\t3\t1\t3", "pear\t5\t3\t37", "pear\t12\t2\t37", "pear\t20\t1\t37", "plum\t7\t1\t7"], {"nameline": True}),
    "neighbours": ("p d/;/ | s kilos, nearby(kilos;kilos;1;'end'), nearby(kilos;kilos;-1) | o kilos", SALES, ["3\t5\t", "5\t7\t3", "7\t12\t5", "12\t20\t7", "20\tend\t12"], {"nameline": True}),
    "unique values": ("p d/;/ | s fruit, uniquecounta(fruit;shop) | u | o 1", SALES, ["fig\t1", "pear\t3", "plum\t1"], {"nameline": True}),
    "top of each": ("p d/;/ | s shop, fruit | f rank(shop;kilos desc) = 1 | o 1", SALES, ["east\tpear", "north\tpear", "south\tplum"], {"nameline": True}),
    "dates": ("p d/ /[]/ | s truncdate(@1,3600), count(1) | g truncdate(@1,3600) | t @1 date '[%Y-%m-%d %H:%M:%S]' | o 1", SENSORS, ["[2023-03-01 06:00:00]\t2", "[2023-03-01 07:00:00]\t1", "[2023-03-01 08:00:00]\t1"], {}),
    "date arithmetic": ("s dateformat(addtime('2024-01-31',1,'N'),'%d.%m.%Y'), timediff('2024-03-01','2024-02-28'), isleap('2024-05-05'), truncdateu('2024-05-05 13:45:10','h')", "x", ["29.02.2024\t172800\t1\t2024-05-05 00:00:00"], {}),
    "like and reglike": ("p d/ /[]/ | s @2 | f @2 like '*a*' and @4 reglike '^o' ", SENSORS, ["hall", "hall"], {}),
    "in and noin": ("p d/ /[]/ | s @2 | f @2 in ('attic','cellar') and @4 noin ('ok')", SENSORS, ["attic", "cellar"], {}),
    "and before or": ("s @1 | f @1=1 or @1=2 and @2='y'", "1 x\n2 x\n2 y", ["1", "2"], {}),
    "spread": ("p d/;/ | s foreach(1,%,$) | l 1", "a;b;c\nd;e;f", ["a\tb\tc"], {}),
    "spread from the end": ("p d/;/ | s foreach(%-1,%,$)", "a;b;c\nd;e", ["b\tc", "d\te"], {}),
    "any and all columns": ("p d/;/ | s @raw | f anycol(1,%,$) > 8 and allcol(1,%,$) > 1", "2;9;3\n1;9;9\n2;3;4", ["2;9;3"], {}),
    "columns to one": ("s concatcol(1,%,$,1,'~'), calcol(2,3,$,1,'max'), calcol(2,3,$,1,'average')", "k 4 6", ["k~4~6\t6\t5"], {}),
    "columns to rows": ("s @1, coltorow(@2,@3)", "k v w\nl x y", ["k\tv", "\tw", "l\tx", "\ty"], {}),
    "duplicates": ("s @1, @dupid | d @2 where @2 != 2", "a 3\nb 2", ["a\t1", "a\t2", "a\t3", "b\t1"], {}),
    "extra filter": ("s @1 as k, @2*2 as v | e v >= 8 trim k, v+1 as w", "a 3\nb 4\nc 9", ["b\t9", "c\t19"], {}),
    "unique rows in order": ("s @1 | u", TAGS, ["red", "blue", "green"], {}),
    "unique rows sorted": ("s @1 | u | o 1 desc | l 2", TAGS, ["red", "green"], {}),
    "range of rows": ("s @line, @1 | l 2,3", TAGS, ["2\tblue", "3\tred"], {}),
    "hierarchy": ("s path(name,'>'), @level, @isleaf, parent(name), root(name) | h k:code;p:boss", STAFF,
        ["Ines\t0\t0\t\tInes", "Ines>Omar\t1\t0\tInes\tInes", "Ines>Omar>Pia\t2\t1\tOmar\tInes", "Ines>Yuki\t1\t0\tInes\tInes", "Ines>Yuki>Sven\t2\t0\tYuki\tInes", "Ines>Yuki>Sven>Ada\t3\t1\tSven\tInes"], {"nameline": True}),
    "cycle": ("s @3, @nodeid, @level | h k:@1;p:@2", "5 6 five\n6 5 six\n7 6 seven", ["five\t1\t0", "six\t2\t1", "seven\t3\t2"], {}),
    "running variables": ("s @1, @sum, @high, @nth", "4\n9\n2", ["4\t4\t4\t1", "9\t13\t9\t2", "2\t15\t9\t3"], {"variables": "sum:0:@sum+@1;high:0:greatest(@high,@1);nth:0:@nth+1"}),
    "last value": ("s @1, @seen", "a 1\nb 0\nc 1", ["a\ta", "b\ta", "c\tc"], {"variables": "seen:none:when(@2=1,@1,@seen)"}),
    "seen before": ("s @1 | f @1 in @r[1][1]", TAGS, ["red", "blue", "red"], {"variables": "r:@before;before:0:@1"}),
    "not seen before": ("s @1 | f @1 noin @r[1][1]", TAGS, ["red", "blue", "green"], {"variables": "r:@before;before:0:@1"}),
    "counts of members": ("s @1, rcount(1,1,@1), rmemberid(1,1,'blue'), rmember(1,1,-1)", "red\nblue\nred", ["red\t1\t-1\tred", "blue\t1\t2\tblue", "red\t2\t2\tred"], {"variables": "r:@1"}),
    "members": ("s rmembers(1,1,-2,-1,'+')", "a\nb\nc", ["a", "a+b", "b+c"], {"variables": "r:@1"}),
    "macro": ("s twice(@1), twice(@2,3,'?')", "p q", ["pp!\tqqq?"], {"macros": "twice:pad(~x~,~n=2~)+~end='!'~"}),
    "static variable": ("s @1 | f @2 > @least", "a 1\nb 5", ["b"], {"variables": "least:3"}),
    "join": ("m @1 as id, @2 as city where @fileid=1 | s @2, @r[1][city] | f @fileid=2 and @1=@r[1][id]", ("1 Oslo\n2 Lima", "2 ann\n1 bo\n3 cy"), ["ann\tLima", "bo\tOslo"], {}),
    "anti join": ("m @1 as id where @fileid=1 | s @2 | f @fileid=2 and @1 noin @r[1][id]", ("1 Oslo\n2 Lima", "2 ann\n1 bo\n3 cy"), ["cy"], {}),
    "precedence": ("s 7-2*3^2/6, (7-2)*3, -3^2, 'n'+2", "x", ["4\t15\t9\tn2"], {}),
    "choices": ("s switch(@1,'a','first','b','second','other'), when(@2>5,'big',@2>2,'mid','small')", "a 9\nb 3\nz 1", ["first\tbig", "second\tmid", "other\tsmall"], {}),
    "failed evaluation": ("s @1*2, tolong(@1), islong(@1)", "6\nsix", ["12\t6\t1", "\t\t0"], {"detect_rows": 2}),
    "replace several": ("s replace(@raw,'cat','dog','dog','cat')", "cat dog cow", ["dog cat cow"], {}),
    "regex template": (r"s regmatch(@raw,'(\w+)@(\w+)','{2} at {1}')", "me@home", ["home at me"], {}),
    "parts": ("s getpart('a.b.c.d','.',-2), getparts('a.b.c.d','.',3,1), countpart('a.b','.'), calparts('4|8|3','|','min',1)", "x", ["c\tc.b.a\t2\t3"], {}),
}


@pytest.mark.parametrize("name", CASES)
def test_prints(spark, name):
    query, source, want, options = CASES[name]
    sources = source if isinstance(source, tuple) else (source,)
    if name.startswith("hierarchy"):
        query = "p d/ / | " + query
    assert sinks.lines(run(spark, query, *sources, **options)) == want


@pytest.mark.parametrize(
    "query",
    ["zz @1", "s nosuch(@1)", "s exec('ls')", "s @1 | f count(1)>1 or @1='a' | g @1", "s @1 | f @1 ==", "s 'open", "s upper(@1,2,3,4)"],
)
def test_refuses(spark, query):
    with pytest.raises(QueryError):
        sinks.lines(run(spark, query, "a b"))


ORDERED = [
    "join_inner", "join_multikey", "join_threeway", "join_theta", "join_semi", "join_anti", "join_visible_self", "first_per_key",
    "unique_rows", "unique_fields", "agg_first_row", "agg_grouplist_order", "tree_region_nation",
]


@pytest.mark.parametrize("name", ORDERED)
def test_no_window_over_all_rows(spark, name):
    """Order of rows is kept without numbering them in one task."""
    frame = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    assert not any("SinglePartition" in x and any("Window" in y for y in lines[max(0, i - 3) : i]) for i, x in enumerate(lines))


def test_erf_and_floats(spark):
    got = sinks.lines(run(spark, "s round(erf(@1),6), fpclassify(@2), isinf(@2), isnormal(@1)", "0.5 1e400\n-1 5e-324", textonly=True))
    assert got == ["0.5205\tINFINITE\t1\t1", "-0.842701\tSUBNORMAL\t0\t1"]


def test_lines_of_many_partitions(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("".join(f"{i} x\n" for i in range(1, 5001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = run(spark, "s @1 as v, @line as line, @fileline as own", str(path)).frame.collect()
        assert len(rows) == 5000 and all(int(r["v"]) == r["line"] == r["own"] for r in rows)
        kept = run(spark, "s @1, @line | f @1 > 4990", str(path), skip=10).frame.collect()
        assert [int(r[0]) - r[1] for r in kept] == [10] * 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
