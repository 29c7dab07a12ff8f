"""The engine's queries over the test tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.api import Result, run
from siftline.sources.text import Lines, Table

#: Unique keys, which stand for the line order of a table.
ORDER = {
    "orders": "o_orderkey", "events": "event_id", "customer": "c_custkey", "nation": "n_nationkey", "part": "p_partkey",
    "region": "r_regionkey", "supplier": "s_suppkey", "documents": "doc_id", "pages": "page_id",
}


@dataclass(frozen=True)
class Case:
    """A query, its sources and its SQL twin.

    tables: names, names with a function of the frame, source objects, or a function of all frames that
    gives one frame a source. after: what is shown of the result (its frame, unless given).
    """

    query: str
    tables: tuple | Callable
    sql: str
    options: dict = field(default_factory=dict)
    after: Callable[[Result], DataFrame] = lambda out: out.frame


def lines_of(*columns: str, mark: str = ",") -> Callable[[DataFrame], DataFrame]:
    return lambda frame: frame.select(F.concat_ws(mark, *columns).alias("line"))


def only(*columns: str) -> Callable[[DataFrame], DataFrame]:
    return lambda frame: frame.select(*columns)


def source(spark: SparkSession, sf_dir: str, table) -> Table | Lines:
    if isinstance(table, Lines):
        return table
    name, change = (table, None) if isinstance(table, str) else table
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    frame = change(frame) if change else frame
    key = ORDER.get(name)
    return Table(frame, key if key in frame.columns else None, name)


def _edges(frame: DataFrame) -> DataFrame:
    """Regions above nations: id, up, label."""
    regions = frame.sparkSession.read.parquet(frame.inputFiles()[0].replace("nation.parquet", "region.parquet"))
    tops = regions.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("").alias("up"), F.col("r_name").alias("label"), (F.col("r_regionkey") + 1).cast("long").alias("pos"))
    below = frame.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("up"), F.col("n_name").alias("label"), (F.col("n_nationkey") + 100).cast("long").alias("pos"))
    return tops.unionByName(below)


CASES: dict[str, Case] = {
    "parse_delim_group": Case(
        "p d/,/ | s @1 as flag, count(1) as n, round(sum(@2),2) as qty, round(average(@2),4) as mean_qty | g @1",
        (("lineitem", lines_of("l_returnflag", "l_quantity")),),
        "SELECT l_returnflag AS flag, count(*) AS n, round(sum(l_quantity),2) AS qty, round(avg(l_quantity),4) AS mean_qty FROM lineitem GROUP BY 1",
    ),
    "parse_topk": Case(
        "p d/,/ | s @1 as flag, count(1) as n | g @1 | o 2 desc, 1 | l 2",
        (("lineitem", lines_of("l_returnflag", "l_quantity")),),
        "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2",
    ),
    "parse_regex_events": Case(
        r"p /(?P<kind>\w+) (?P<amount>[0-9.]+)/ | t amount double | s kind as kind, count(1) as n, round(max(amount),4) as top | g kind",
        (("events", lines_of("event_type", "value", mark=" ")),),
        "SELECT event_type AS kind, count(*) AS n, round(max(value),4) AS top FROM events GROUP BY 1",
    ),
    "parse_wildcard_part": Case(
        "p w/*#*/ | s @1 as maker, @2 as code, count(1) as n | g @1,@2",
        (("part", lines_of("p_brand")),),
        "SELECT split_part(p_brand,'#',1) AS maker, split_part(p_brand,'#',2) AS code, count(*) AS n FROM part GROUP BY 1,2",
        {"textonly": True},
    ),
    "parse_quoted": Case(
        "p d/,/\"\"/ | s @1 as id, @2 as name, @3 as size",
        (("part", lambda f: f.select(F.concat(F.col("p_partkey").cast("string"), F.lit(',"'), "p_type", F.lit(', x",'), F.col("p_size").cast("string")).alias("line"))),),
        "SELECT p_partkey::VARCHAR AS id, '\"' || p_type || ', x\"' AS name, p_size::VARCHAR AS size FROM part",
        {"textonly": True},
    ),
    "parse_line": Case(
        "p l | s @1 as line, strlen(@1) as n",
        (("nation", lines_of("n_name", "n_nationkey")),),
        "SELECT n_name || ',' || n_nationkey AS line, octet_length(encode(n_name || ',' || n_nationkey))::BIGINT AS n FROM nation",
        {"textonly": True},
    ),
    "quick_grep_docs": Case(
        "p q/the/",
        (("documents", lambda f: f.select(F.explode(F.split("text", "\n")).alias("line"))),),
        "SELECT x AS \"@RAW\" FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents) WHERE contains(x, 'the')",
    ),
    "filter_compare": Case(
        "s o_orderkey as k, o_totalprice as p | f o_totalprice > 100000 and (o_orderstatus = 'F' or o_orderstatus = 'P')",
        ("orders",),
        "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('F','P')",
    ),
    "filter_like": Case(
        "s p_partkey as k, p_type as t | f p_type like '*STEEL*' or p_type nolike '*A*'",
        ("part",),
        "SELECT p_partkey AS k, p_type AS t FROM part WHERE p_type LIKE '%STEEL%' OR p_type NOT LIKE '%A%'",
    ),
    "filter_reglike": Case(
        "s p_partkey as k | f p_brand reglike '[13]$' and p_type noreglike 'COPPER|BRASS'",
        ("part",),
        "SELECT p_partkey AS k FROM part WHERE regexp_matches(p_brand,'[13]$') AND NOT regexp_matches(p_type,'COPPER|BRASS')",
    ),
    "filter_in": Case(
        "s o_orderkey as k | f o_orderpriority in ('1-URGENT','2-HIGH') and o_orderstatus noin ('F')",
        ("orders",),
        "SELECT o_orderkey AS k FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH') AND o_orderstatus NOT IN ('F')",
    ),
    "filter_anycol": Case(
        "s @1 as a, @2 as b, @3 as c | f anycol(1,%,$) > 4700",
        (("part", lambda f: f.select(F.col("p_partkey"), F.col("p_size").cast("long").alias("p_size"), F.col("p_retailprice") * 5)),),
        "SELECT p_partkey AS a, p_size::BIGINT AS b, p_retailprice*5 AS c FROM part WHERE p_partkey > 4700 OR p_size > 4700 OR p_retailprice*5 > 4700",
    ),
    "filter_allcol": Case(
        "s @1 as a, @2 as b | f allcol(1,%,$) > 20",
        (("part", lambda f: f.select(F.col("p_partkey"), F.col("p_size").cast("long").alias("p_size"))),),
        "SELECT p_partkey AS a, p_size::BIGINT AS b FROM part WHERE p_partkey > 20 AND p_size > 20",
    ),
    "agg_having": Case(
        "s o_custkey as cust, count(1) as n, round(sum(o_totalprice),2) as total | g o_custkey | f count(1) > 10 and o_orderstatus != 'P'",
        ("orders",),
        "SELECT o_custkey AS cust, count(*) AS n, round(sum(o_totalprice),2) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING count(*) > 10",
    ),
    "agg_uniquecount": Case(
        "s l_returnflag as flag, uniquecount(l_suppkey) as n | g l_returnflag",
        ("lineitem",),
        "SELECT l_returnflag AS flag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1",
    ),
    "agg_grouplist": Case(
        "s n_regionkey as r, grouplist(distinct n_name,',',asc) as names | g n_regionkey",
        ("nation",),
        "SELECT n_regionkey AS r, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1",
    ),
    "agg_grouplist_order": Case(
        "s n_regionkey as r, grouplist(n_name,'-') as names | g n_regionkey",
        ("nation",),
        "SELECT n_regionkey AS r, string_agg(n_name, '-' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1",
    ),
    "agg_global": Case(
        "s count(1) as n, min(o_totalprice) as low, max(o_totalprice) as high, round(count(1)/7,3) as part",
        ("orders",),
        "SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, round(count(*)/7.0,3)::DOUBLE AS part FROM orders",
    ),
    "agg_first_value": Case(
        "s o_custkey as cust, o_orderstatus as first_status, @line*0 as zero, count(1) as n | g o_custkey",
        ("orders",),
        "SELECT o_custkey AS cust, arg_min(o_orderstatus, o_orderkey) AS first_status, 0::BIGINT AS zero, count(*) AS n FROM orders GROUP BY 1",
    ),
    "agg_first_row": Case(
        "s o_custkey as cust, o_orderstatus as first_status, count(1) as n | g o_custkey",
        ("orders",),
        "SELECT o_custkey AS cust, arg_min(o_orderstatus, o_orderkey) AS first_status, count(*) AS n FROM orders GROUP BY 1",
    ),
    "report_footer": Case(
        "s c_mktsegment as seg, count(1) as n, max(c_acctbal) as top | g c_mktsegment | r 2:sum,3:max",
        ("customer",),
        "SELECT '' AS seg, printf('%.2f', sum(n)::DOUBLE) AS n, printf('%.2f', max(top)) AS top FROM (SELECT c_mktsegment, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY 1)",
        after=lambda out: out.report,
    ),
    "report_kinds": Case(
        "s c_mktsegment as seg, c_custkey as k, c_acctbal as a, c_nationkey as n, c_acctbal as z | r 2:count,3:average,4:min,5:sum",
        ("customer",),
        "SELECT '' AS seg, printf('%.2f', count(*)::DOUBLE) AS k, printf('%.2f', avg(c_acctbal)) AS a, printf('%.2f', min(c_nationkey)::DOUBLE) AS n, printf('%.2f', sum(c_acctbal)) AS z FROM customer",
        after=lambda out: out.report,
    ),
    "win_rank": Case(
        "s o_orderkey as k, rank(o_custkey;o_totalprice desc,o_orderkey) as place",
        ("orders",),
        "SELECT o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders",
    ),
    "win_denserank": Case(
        "s o_orderkey as k, denserank(o_custkey;o_orderstatus) as place",
        ("orders",),
        "SELECT o_orderkey AS k, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS place FROM orders",
    ),
    "win_nearby": Case(
        "s event_id as k, nearby(value;event_id;-1;0) as before, nearby(event_type;event_id;2;'none') as later",
        ("events",),
        "SELECT event_id AS k, lag(value,1,0) OVER (ORDER BY event_id) AS before, lead(event_type,2,'none') OVER (ORDER BY event_id) AS later FROM events",
    ),
    "win_suma": Case(
        "s event_id as k, round(suma(user_id;value),4) as total, counta(user_id;value) as n, round(averagea(user_id;value),4) as mean",
        ("events",),
        "SELECT event_id AS k, round(sum(value) OVER w,4) AS total, count(*) OVER w AS n, round(avg(value) OVER w,4) AS mean FROM events WINDOW w AS (PARTITION BY user_id)",
    ),
    "win_uniquecounta": Case(
        "s event_id as k, uniquecounta(user_id;event_type) as kinds",
        ("events",),
        "SELECT event_id AS k, kinds FROM events JOIN (SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1) USING (user_id)",
    ),
    "win_maxa": Case(
        "s c_custkey as k, maxa(c_nationkey;c_acctbal) as high, mina(c_nationkey;c_acctbal) as low",
        ("customer",),
        "SELECT c_custkey AS k, max(c_acctbal) OVER w AS high, min(c_acctbal) OVER w AS low FROM customer WINDOW w AS (PARTITION BY c_nationkey)",
    ),
    "win_qualify": Case(
        "s o_orderkey as k, o_custkey as cust | f rank(o_custkey;o_totalprice desc,o_orderkey) <= 2",
        ("orders",),
        "SELECT o_orderkey AS k, o_custkey AS cust FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    ),
    "win_over_groups": Case(
        "s o_custkey as cust, count(1) as n, rank(;count(1) desc,o_custkey) as place | g o_custkey",
        ("orders",),
        "SELECT o_custkey AS cust, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS place FROM orders GROUP BY 1",
    ),
    "topk_limit": Case(
        "s o_orderkey as k, o_totalprice as p | o o_totalprice desc, o_orderkey | l 10",
        ("orders",),
        "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 10",
    ),
    "limit_range": Case(
        "s c_custkey as k | o 1 | l 11,20",
        ("customer",),
        "SELECT c_custkey AS k FROM customer ORDER BY 1 LIMIT 10 OFFSET 10",
    ),
    "unique_rows": Case(
        "s o_orderstatus as st, o_orderpriority as pr | u",
        ("orders",),
        "SELECT DISTINCT o_orderstatus AS st, o_orderpriority AS pr FROM orders",
    ),
    "unique_fields": Case(
        "s n_nationkey, n_regionkey, n_name | u f | o n_nationkey",
        ("nation",),
        "SELECT array_to_string(c, '|') AS cells, len(list_filter(c, lambda x: regexp_matches(x, '^[0-9]+$')))::BIGINT AS numbers FROM "
        "(SELECT list_sort(list_distinct([n_nationkey::VARCHAR, n_regionkey::VARCHAR, n_name])) AS c FROM nation)",
        after=lambda out: _keyed(out.frame, F.col(out.frame.columns[0])),
    ),
    # joins put the side table first: both tables as one stream of rows, told apart by @fileid
    "join_inner": Case(
        "m a as k, b as name where @fileid=1 | s a as k, @r[1][name] as name | f @fileid=2 and c = @r[1][k]",
        lambda d: (d["customer"].selectExpr("c_custkey a", "c_name b", "null::long c"), d["orders"].selectExpr("o_orderkey a", "'' b", "o_custkey c")),
        "SELECT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey",
    ),
    "join_multikey": Case(
        "m a as k, b as st, c as n where @fileid=1 | s c as k, @r[1][n] as n | f @fileid=2 and a = @r[1][k] and b = @r[1][st]",
        lambda d: (d["orders"].groupBy("o_custkey", "o_orderstatus").count().toDF("a", "b", "c"), d["orders"].selectExpr("o_custkey a", "o_orderstatus b", "o_orderkey c")),
        "SELECT o_orderkey AS k, n AS n FROM orders JOIN (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) USING (o_custkey, o_orderstatus)",
    ),
    "join_threeway": Case(
        "m a as k, c as name where @fileid=1;a as k, b as up, c as name where @fileid=2 | s a as k, @r[2][name] as nation, @r[1][name] as region | f @fileid=3 and b = @r[2][k] and @r[2][up] = @r[1][k]",
        lambda d: (d["region"].selectExpr("r_regionkey::long a", "0::long b", "r_name c"), d["nation"].selectExpr("n_nationkey::long a", "n_regionkey::long b", "n_name c"), d["supplier"].selectExpr("s_suppkey a", "s_nationkey::long b", "'' c")),
        "SELECT s_suppkey AS k, n_name AS nation, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "join_theta": Case(
        "m a as k, b as name where @fileid=1 | s b as a, @r[1][name] as b | f @fileid=2 and a < @r[1][k]",
        lambda d: (d["region"].selectExpr("r_regionkey a", "r_name b"), d["nation"].selectExpr("n_regionkey a", "n_name b")),
        "SELECT a.n_name AS a, r_name AS b FROM nation a JOIN region ON a.n_regionkey < r_regionkey",
    ),
    "join_semi": Case(
        "m a as k where @fileid=1 and b > 300000 | s a as k | f @fileid=2 and a in @r[1][k]",
        lambda d: (d["orders"].selectExpr("o_custkey a", "o_totalprice b"), d["customer"].selectExpr("c_custkey a", "0.0d b")),
        "SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    ),
    "join_anti": Case(
        "m a as k where @fileid=1 and b > 300000 | s a as k | f @fileid=2 and a noin @r[1][k]",
        lambda d: (d["orders"].selectExpr("o_custkey a", "o_totalprice b"), d["customer"].selectExpr("c_custkey a", "0.0d b")),
        "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    ),
    "join_or": Case(
        "m a as k, b as name where @fileid=1 | s b as a, @r[1][name] as b | f @fileid=2 and (a = @r[1][k] or c = @r[1][k])",
        lambda d: (d["region"].selectExpr("r_regionkey a", "r_name b", "0 c"), d["nation"].selectExpr("n_regionkey a", "n_name b", "n_nationkey c")),
        "SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey OR n_nationkey = r_regionkey",
    ),
    "join_side_of_side": Case(
        "m a as k where @fileid=1 and c like 'A*';a as k where @fileid=2 and b in @r[1][k] | s a as k | f @fileid=3 and b in @r[2][k]",
        lambda d: (d["region"].selectExpr("r_regionkey::long a", "0::long b", "r_name c"), d["nation"].selectExpr("n_nationkey::long a", "n_regionkey::long b", "n_name c"), d["customer"].selectExpr("c_custkey a", "c_nationkey::long b", "'' c")),
        "SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%'))",
    ),
    "join_visible_self": Case(
        "m n_regionkey as r, n_name as name where n_nationkey >= 0 | s n_name as later, @r[1][name] as earlier | f n_regionkey = @r[1][r]",
        ("nation",),
        "SELECT b.n_name AS later, a.n_name AS earlier FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    ),
    "first_per_key": Case(
        "m o_custkey as c | s o_custkey as cust, o_orderkey as k | f o_custkey noin @r[1][c]",
        ("orders",),
        "SELECT o_custkey AS cust, min(o_orderkey) AS k FROM orders GROUP BY 1",
    ),
    "duplicate_rows": Case(
        "s n_nationkey as k, @dupid as copy | d n_regionkey where n_regionkey > 1",
        ("nation",),
        "SELECT n_nationkey AS k, unnest(generate_series(1, CASE WHEN n_regionkey > 1 THEN n_regionkey ELSE 1 END)) AS copy FROM nation",
    ),
    "coltorow_unpivot": Case(
        "s tostr(c_custkey) as k, coltorow(c_name,c_mktsegment) as v",
        ("customer",),
        "SELECT c_custkey::VARCHAR AS k, c_name AS v FROM customer UNION ALL SELECT '' AS k, c_mktsegment AS v FROM customer",
    ),
    "foreach_calcol": Case(
        "s @1 as k, calcol(2,3,$,1,'sum') as total, concatcol(1,2,$,1,'-') as joined, greatest(foreach(1,2,$)) as top, foreach(1,2,$+1) as f",
        (("part", lambda f: f.select(F.col("p_partkey"), F.col("p_size").cast("long").alias("p_size"), F.col("p_retailprice"))),),
        "SELECT p_partkey AS k, p_size + p_retailprice AS total, p_partkey || '-' || p_size AS joined, greatest(p_partkey, p_size::BIGINT) AS top, p_partkey + 1 AS f1, p_size::BIGINT + 1 AS f2 FROM part",
    ),
    "extrafilter_trim": Case(
        "s o_custkey as cust, count(1) as n, max(o_totalprice) as top | g o_custkey | e n > 12 and @3 > 1000 trim cust, n*2 as twice",
        ("orders",),
        "SELECT o_custkey AS cust, count(*)*2 AS twice FROM orders GROUP BY 1 HAVING count(*) > 12 AND max(o_totalprice) > 1000",
    ),
    "tree_region_nation": Case(
        "s id as id, @level as depth, path(label,'/') as path, parent(label) as up, root(label) as top, @isleaf as leaf | h k:id;p:up",
        (("nation", _edges),),
        "SELECT 'r' || r_regionkey AS id, 0::BIGINT AS depth, r_name AS path, '' AS up, r_name AS top, CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey) THEN 0 ELSE 1 END::BIGINT AS leaf FROM region UNION ALL SELECT 'n' || n_nationkey, 1, r_name || '/' || n_name, r_name, r_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "dyn_var_running": Case(
        "s event_id as k, round(@total,4) as total, @seen as seen",
        ("events",),
        "SELECT event_id AS k, round(sum(value) OVER (ORDER BY event_id),4) AS total, 10 + count(*) OVER (ORDER BY event_id) AS seen FROM events",
        {"variables": "total:0.0:@total+value;seen:10:@seen+1"},
    ),
    "static_variable": Case(
        "s c_custkey as k | f c_mktsegment = @seg",
        ("customer",),
        "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'",
        {"variables": "seg:BUILDING"},
    ),
    "rcount_running": Case(
        "s o_orderkey as k, rcount(1,1,o_custkey) as n",
        ("orders",),
        "SELECT o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders",
        {"variables": "r:o_custkey"},
    ),
    "macro_function": Case(
        "s p_partkey as k, short(p_type) as a, short(p_type,3) as b",
        ("part",),
        "SELECT p_partkey AS k, upper(substr(p_type,1,2)) AS a, upper(substr(p_type,1,3)) AS b FROM part",
        {"macros": "short:upper(substr(~s~,0,~n=2~))"},
    ),
    "hourly_buckets": Case(
        "s truncdate(ts,3600) as hour, count(1) as n | g truncdate(ts,3600)",
        ("events",),
        "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1",
    ),
    "union_all_files": Case(
        "s @fileid as f, count(1) as n | g @fileid",
        (("region", only("r_name")), ("nation", lambda f: f.select(F.col("n_name").alias("r_name")))),
        "SELECT 1::BIGINT AS f, count(*) AS n FROM region UNION ALL SELECT 2, count(*) FROM nation",
    ),
    "str_basic": Case(
        "s n_nationkey as k, upper(n_name) as u, lower(n_name) as l, strlen(n_name) as n, instr(n_name,'A') as at, substr(n_name,1,2) as sub, replace(n_name,'A','__') as rep, revertstr(n_name) as rev, concat(n_name,'-',n_regionkey) as joined, countstr(n_name,'A') as hits, isnull(n_name) as empty",
        ("nation",),
        "SELECT n_nationkey AS k, upper(n_name) AS u, lower(n_name) AS l, strlen(n_name) AS n, (instr(n_name,'A')-1)::BIGINT AS at, substr(n_name,2,2) AS sub, replace(n_name,'A','__') AS rep, reverse(n_name) AS rev, n_name || '-' || n_regionkey AS joined, (len(n_name)-len(replace(n_name,'A','')))::BIGINT AS hits, 0::BIGINT AS empty FROM nation",
    ),
    "str_parts": Case(
        "s p_partkey as k, getpart(p_type,' ',2) as second, getpart(p_type,' ',-1) as last, countpart(p_type,' ') as n, getparts(p_type,' ',1,2) as two, countword(p_type) as words, getword(p_type,1) as word",
        ("part",),
        "SELECT p_partkey AS k, string_split(p_type,' ')[2] AS second, string_split(p_type,' ')[-1] AS last, len(string_split(p_type,' '))::BIGINT AS n, array_to_string(string_split(p_type,' ')[1:2],' ') AS two, len(string_split(p_type,' '))::BIGINT AS words, string_split(p_type,' ')[1] AS word FROM part",
    ),
    "str_regex": Case(
        r"s p_partkey as k, regreplace(p_type,'[AEIOU]','.') as dots, regcount(p_type,'[AEIOU]') as n, regget(p_type,'(\w)(\w)',1,2) as second, regmatch(p_brand,'(\w+)#(\d+)','{2}-{1}') as swapped",
        ("part",),
        r"SELECT p_partkey AS k, regexp_replace(p_type,'[AEIOU]','.','g') AS dots, len(regexp_extract_all(p_type,'[AEIOU]'))::BIGINT AS n, regexp_extract(p_type,'(\w)(\w)',2) AS second, CASE WHEN regexp_full_match(p_brand,'(\w+)#(\d+)') THEN regexp_extract(p_brand,'(\w+)#(\d+)',2) || '-' || regexp_extract(p_brand,'(\w+)#(\d+)',1) ELSE '' END AS swapped FROM part",
    ),
    "str_codec": Case(
        "s n_nationkey as k, md5(n_name) as h, base64encode(n_name) as b, base64decode(base64encode(n_name)) as back, urldecode(urlencode(n_name)) as u, pad('ab',n_regionkey) as p, duplicate(n_regionkey,3) as d, snakestr(n_name) as s, ascii(n_name) as a, char(65+n_regionkey) as c",
        ("nation",),
        "SELECT n_nationkey AS k, md5(n_name) AS h, base64(encode(n_name)) AS b, n_name AS back, n_name AS u, repeat('ab',n_regionkey) AS p, concat_ws(',',n_regionkey,n_regionkey,n_regionkey) AS d, upper(n_name[1]) || lower(n_name[2:]) AS s, ascii(n_name)::BIGINT AS a, chr(65+n_regionkey) AS c FROM nation",
    ),
    "math_basic": Case(
        "s c_custkey as k, abs(c_acctbal) as a, ceil(c_acctbal) as c, floor(c_acctbal) as f, round(c_acctbal,1) as r, mod(c_custkey,7) as m, round(sqrt(abs(c_acctbal)),6) as q, round(pow(2,c_nationkey),0) as p, round(log10(c_custkey+1),8) as l, round(c_acctbal/3,6) as d, c_custkey*2-1 as i",
        ("customer",),
        "SELECT c_custkey AS k, abs(c_acctbal) AS a, ceil(c_acctbal)::BIGINT AS c, floor(c_acctbal)::BIGINT AS f, round(c_acctbal,1) AS r, c_custkey%7 AS m, round(sqrt(abs(c_acctbal)),6) AS q, round(pow(2,c_nationkey),0) AS p, round(log10(c_custkey+1),8) AS l, round(c_acctbal/3,6) AS d, c_custkey*2-1 AS i FROM customer",
    ),
    "math_trig": Case(
        "s n_nationkey as k, round(sin(n_nationkey),9) as s, round(cos(n_nationkey),9) as c, round(tan(n_nationkey),7) as t, round(atan2(n_nationkey,2),9) as a, round(asinh(n_nationkey),9) as ash, round(hypot(n_nationkey,4),9) as h, round(cbrt(n_nationkey),9) as cb, round(exp(n_nationkey/10),7) as e, round(remainder(n_nationkey,7),6) as rem, fmod(n_nationkey,4) as fm",
        ("nation",),
        "SELECT n_nationkey AS k, round(sin(n_nationkey),9) AS s, round(cos(n_nationkey),9) AS c, round(tan(n_nationkey),7) AS t, round(atan2(n_nationkey,2),9) AS a, round(asinh(n_nationkey),9) AS ash, round(sqrt(n_nationkey*n_nationkey+16),9) AS h, round(cbrt(n_nationkey),9) AS cb, round(exp(n_nationkey/10),7) AS e, round(n_nationkey-7*round_even(n_nationkey/7.0,0),6)::DOUBLE AS rem, (n_nationkey%4)::DOUBLE AS fm FROM nation",
    ),
    "math_bases": Case(
        "s p_partkey as k, dectohex(p_partkey) as h, dectobin(p_partkey) as b, hextodec(dectohex(p_partkey)) as x, bintodec(dectobin(p_partkey)) as y, comparenum(p_partkey,100) as c, sumall(p_partkey,p_size,1) as s, least(p_partkey,50) as lo",
        ("part",),
        "SELECT p_partkey AS k, upper(to_hex(p_partkey)) AS h, to_binary(p_partkey) AS b, p_partkey AS x, p_partkey AS y, sign(p_partkey-100)::BIGINT AS c, (p_partkey+p_size+1)::DOUBLE AS s, least(p_partkey,50) AS lo FROM part",
    ),
    "date_parts": Case(
        "s o_orderkey as k, weekday(o_orderdate) as wd, yearday(o_orderdate) as yd, isleap(o_orderdate) as leap, datetolong(o_orderdate) as epoch, dateformat(o_orderdate,'%d/%m/%Y') as f, monthfirstday(o_orderdate) as m1, truncdateu(o_orderdate,'b') as y1, addtime(o_orderdate,1,'N') as nextm, timediff(o_orderdate,'1992-01-01') as secs",
        ("orders",),
        "SELECT o_orderkey AS k, isodow(o_orderdate) AS wd, dayofyear(o_orderdate)-1 AS yd, CASE WHEN (year(o_orderdate)%4=0 AND year(o_orderdate)%100<>0) OR year(o_orderdate)%400=0 THEN 1 ELSE 0 END::BIGINT AS leap, epoch(o_orderdate)::BIGINT AS epoch, strftime(o_orderdate,'%d/%m/%Y') AS f, date_trunc('month',o_orderdate)::TIMESTAMP AS m1, date_trunc('year',o_orderdate)::TIMESTAMP AS y1, o_orderdate + INTERVAL 1 MONTH AS nextm, (epoch(o_orderdate)-epoch(TIMESTAMP '1992-01-01'))::DOUBLE AS secs FROM orders",
    ),
    "type_switch": Case(
        "s o_orderkey as k, switch(o_orderstatus,'F','done','O','open','other') as st, when(o_totalprice>200000 and o_orderstatus='O','big open',o_totalprice>200000,'big','small') as size, datatype(o_totalprice) as dt, islong(o_orderkey) as il, isdouble(o_orderstatus) as id, tostr(o_custkey) as t, tolong(o_orderpriority) as x",
        ("orders",),
        "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS st, CASE WHEN o_totalprice>200000 AND o_orderstatus='O' THEN 'big open' WHEN o_totalprice>200000 THEN 'big' ELSE 'small' END AS size, 'DOUBLE' AS dt, 1::BIGINT AS il, 0::BIGINT AS id, o_custkey::VARCHAR AS t, NULL::BIGINT AS x FROM orders",
    ),
    "text_lines": Case(
        "s @line as n, @1 as word, @2+1 as next, strlen(@raw) as size",
        (Lines("alpha 1\nbeta 2\ngamma delta 3"),),
        "SELECT * FROM (VALUES (1::BIGINT, 'alpha', 2::DOUBLE, 7::BIGINT), (2, 'beta', 3, 6), (3, 'gamma', NULL, 13)) t(n, word, next, size)",
    ),
    "text_name_line": Case(
        "p d/,/ | s city as city, round(people/2,1) as half, @fileline as line | f people > 10",
        (Lines("a comment\ncity,people\nLuxor,30\nAswan,7\nGiza,90"),),
        "SELECT * FROM (VALUES ('Luxor', 15::DOUBLE, 1::BIGINT), ('Giza', 45, 3)) t(city, half, line)",
        {"nameline": True, "skip": 1},
    ),
    "text_wide_row": Case(
        "p d/,/ | s concatcol(1,%,$,1,'+') as all, @% as width, when(isnull(@N)=0,@N,'-') as last | f anycol(1,%,$) = 'z'",
        (Lines("\n".join(["a,b,z"] * 60 + ["c,d,e,f,z"])),),
        "SELECT unnest(list_concat(list_transform(range(60), lambda x: 'a+b+z'), ['c+d+e+f+z'])) AS all, unnest(list_concat(list_transform(range(60), lambda x: 3::BIGINT), [5::BIGINT])) AS width, unnest(list_transform(range(61), lambda x: 'z')) AS last",
        {"textonly": True},
    ),
    "string_plus": Case(
        "s n_nationkey as k, n_name+'-'+n_regionkey as joined, (n_nationkey+1)*2 as twice",
        ("nation",),
        "SELECT n_nationkey AS k, n_name || '-' || n_regionkey AS joined, ((n_nationkey+1)*2)::BIGINT AS twice FROM nation",
    ),
    "sort_foreach": Case(
        "s c_mktsegment as seg, c_custkey as k | o foreach(1,2,$) | l 7",
        (("customer", only("c_mktsegment", "c_custkey")),),
        "SELECT c_mktsegment AS seg, c_custkey AS k FROM customer ORDER BY 1, 2 LIMIT 7",
    ),
    "union_distinct": Case(
        "s @1 as name | u",
        (("nation", only("n_name")), ("nation", only("n_name")), ("region", lambda f: f.select(F.col("r_name").alias("n_name")))),
        "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region",
    ),
    "variable_per_file": Case(
        "s @fileid as f, @1 as name, @num as n, @all as total",
        (("region", only("r_name")), ("nation", lambda f: f.select(F.col("n_name").alias("r_name")))),
        "SELECT 1::BIGINT AS f, r_name AS name, row_number() OVER (ORDER BY r_regionkey) AS n, row_number() OVER (ORDER BY r_regionkey) AS total FROM region "
        "UNION ALL SELECT 2, n_name, row_number() OVER (ORDER BY n_nationkey), (SELECT count(*) FROM region) + row_number() OVER (ORDER BY n_nationkey) FROM nation",
        {"variables": "num:0:@num+1;all:0:@all+1:g"},
    ),
    "side_members": Case(
        "s n_nationkey as k, rmember(1,1,1) as first, rmember(1,1,-1) as latest, rmember(1,1,3) as third, rmembers(1,1,1,2,'+') as two, rmemberid(1,1,n_name) as place, rcount(1) as seen",
        ("nation",),
        "SELECT n_nationkey AS k, first_value(n_name) OVER w AS first, n_name AS latest, nth_value(n_name, 3) OVER w AS third, "
        "first_value(n_name) OVER w || coalesce('+' || nth_value(n_name, 2) OVER w, '') AS two, row_number() OVER w AS place, count(*) OVER w AS seen "
        "FROM nation WINDOW w AS (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
        {"variables": "r:n_name"},
    ),
    "row_numbers": Case(
        "s o_orderkey as k, @line as line, @row as row | f o_orderstatus = 'F'",
        ("orders",),
        "SELECT o_orderkey AS k, line, row_number() OVER (ORDER BY o_orderkey) AS row FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS line FROM orders) WHERE o_orderstatus = 'F'",
    ),
    "eval_fieldname": Case(
        "s p_partkey as k, eval('p_size*2+1') as e, fieldname(1) as head",
        (("part", lambda f: f.select("p_partkey", F.col("p_size").cast("long").alias("p_size"))),),
        "SELECT p_partkey AS k, (p_size*2+1)::BIGINT AS e, 'p_partkey' AS head FROM part",
    ),
    "str_more": Case(
        "s p_partkey as k, findnth(p_type,'A',1) as f1, findnth(p_type,'A',2) as f2, trimleft(concat('xx',p_type),'x') as tl, trimright(concat(p_type,'  ')) as tr, trim(concat('--',p_type,'-'),'-') as t, comparestr(p_type,'M') as c, nocasecomparestr(lower(p_type),p_type) as nc, camelstr(p_type) as cs, when(hash(p_type)=hash(concat(p_type,'')),1,0) as h, strlen(randstr(12,'uld')) as rs",
        ("part",),
        "SELECT p_partkey AS k, (instr(p_type,'A')-1)::BIGINT AS f1, CASE WHEN len(string_split(p_type,'A')) > 2 THEN len(string_split(p_type,'A')[1]) + 1 + len(string_split(p_type,'A')[2]) ELSE -1 END::BIGINT AS f2, p_type AS tl, p_type AS tr, p_type AS t, CASE WHEN p_type < 'M' THEN -1 WHEN p_type > 'M' THEN 1 ELSE 0 END::BIGINT AS c, 0::BIGINT AS nc, array_to_string(list_transform(string_split(p_type,' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS cs, 1::BIGINT AS h, 12::BIGINT AS rs FROM part",
    ),
    "str_addresses": Case(
        "s p_partkey as k, isip(concat('10.0.',p_size,'.',p_partkey)) as ip, isip(concat(p_size,'.1.1')) as short, isipv6(concat('2001:db8::',p_size)) as six, isipv6(p_type) as no, ismac(concat('00:1A:2b:3c:4D:',pad('0',1),mod(p_size,10))) as mac, ismac(p_brand) as notmac",
        ("part",),
        "SELECT p_partkey AS k, CASE WHEN p_partkey <= 255 THEN 1 ELSE 0 END::BIGINT AS ip, 0::BIGINT AS short, 1::BIGINT AS six, 0::BIGINT AS no, 1::BIGINT AS mac, 0::BIGINT AS notmac FROM part",
    ),
    "str_part_ranges": Case(
        "s p_partkey as k, regcountpart(p_type,'[A-Z]+') as n, reggetpart(p_type,'[A-Z]+',2) as second, reggetparts(p_type,'[A-Z]+',-1,1,1,'|') as back, regcalparts(concat(p_size,'-',p_partkey),'[0-9]+','sum',1,2) as total, calparts(concat(p_size,',',p_partkey),',','max',1,2) as top, calparts(concat(p_size,',',p_size,',7'),',','uniquecount',1) as kinds",
        ("part",),
        "SELECT p_partkey AS k, len(regexp_extract_all(p_type,'[A-Z]+'))::BIGINT AS n, regexp_extract_all(p_type,'[A-Z]+')[2] AS second, array_to_string(list_reverse(regexp_extract_all(p_type,'[A-Z]+')),'|') AS back, (p_size+p_partkey)::DOUBLE AS total, greatest(p_size,p_partkey)::DOUBLE AS top, CASE WHEN p_size = 7 THEN 1 ELSE 2 END::BIGINT AS kinds FROM part",
    ),
    "codec_constants": Case(
        "s r_regionkey as k, hextodec(concat('1F',r_regionkey)) as h, hextodec('-ff') as neg, bintodec(concat('101',mod(r_regionkey,2))) as b, base64decode('c2lmdA==') as d, urldecode(concat('a%20b%2F',r_regionkey)) as u, urlencode(concat('x y/',r_regionkey)) as e, dectohex(-10-r_regionkey) as dh",
        ("region",),
        "SELECT r_regionkey AS k, (496+r_regionkey)::BIGINT AS h, -255::BIGINT AS neg, (10+r_regionkey%2)::BIGINT AS b, 'sift' AS d, 'a b/' || r_regionkey AS u, 'x+y%2f' || r_regionkey AS e, '-' || upper(to_hex(10+r_regionkey)) AS dh FROM region",
    ),
    "math_more": Case(
        "s n_nationkey as k, round(exp2(n_nationkey),6) as e2, round(log(n_nationkey+1),9) as ln1, round(log2(n_nationkey+1),9) as l2, round(asin(n_nationkey/25),9) as asn, round(acos(n_nationkey/25),9) as acs, round(atan(n_nationkey),9) as atn, round(sinh(n_nationkey/10),9) as sh, round(cosh(n_nationkey/10),9) as ch, round(tanh(n_nationkey/10),9) as th, round(acosh(n_nationkey+1),9) as ach, round(atanh(n_nationkey/25),9) as ath, round(pi(),9) as p",
        ("nation",),
        "SELECT n_nationkey AS k, round(pow(2,n_nationkey),6) AS e2, round(ln(n_nationkey+1),9) AS ln1, round(log2(n_nationkey+1),9) AS l2, round(asin(n_nationkey/25),9) AS asn, round(acos(n_nationkey/25),9) AS acs, round(atan(n_nationkey),9) AS atn, round(sinh(n_nationkey/10),9) AS sh, round(cosh(n_nationkey/10),9) AS ch, round(tanh(n_nationkey/10),9) AS th, round(acosh(n_nationkey+1),9) AS ach, round(atanh(n_nationkey/25),9) AS ath, round(pi(),9) AS p FROM nation",
    ),
    "math_floats": Case(
        "s n_nationkey as k, round(lgamma(n_nationkey+1),8) as lg, round(tgamma(n_regionkey+2),6) as g, round(erf(0),6) as e0, fma(n_nationkey,2.5,1) as f, copysign(n_nationkey+1,0-n_regionkey-1) as cs, ilogb(n_nationkey+1) as il, scalbn(n_nationkey,3) as sb, scalbln(n_nationkey,-1) as sl, isfinite(n_nationkey) as fin, isinf(n_nationkey) as inf, isnormal(n_nationkey) as nor, fpclassify(n_nationkey) as cls, when(random(5,9)>=5,1,0) as r",
        ("nation",),
        "SELECT n_nationkey AS k, round(lgamma(n_nationkey+1),8) AS lg, round(gamma(n_regionkey+2),6) AS g, 0::DOUBLE AS e0, n_nationkey*2.5::DOUBLE+1 AS f, -(n_nationkey+1)::DOUBLE AS cs, floor(log2(n_nationkey+1))::BIGINT AS il, (n_nationkey*8)::DOUBLE AS sb, n_nationkey/2 AS sl, 1::BIGINT AS fin, 0::BIGINT AS inf, CASE WHEN n_nationkey = 0 THEN 0 ELSE 1 END::BIGINT AS nor, CASE WHEN n_nationkey = 0 THEN 'ZERO' ELSE 'NORMAL' END AS cls, 1::BIGINT AS r FROM nation",
    ),
    "date_more": Case(
        "s o_orderkey as k, comparedate(o_orderdate,'1995-01-01') as c, monthfirstmonday(o_orderdate) as mm, yearweek(o_orderdate) as yw, longtodate(datetolong(o_orderdate)) as ld, todate(dateformat(o_orderdate,'%Y-%m-%d'),'%Y-%m-%d') as td, datetolong(localtime(o_orderdate)) as lt, datetolong(gmtime(o_orderdate,2))-datetolong(gmtime(o_orderdate,0)) as gm, o_orderdate+3600 as hour, when(datetolong(now())>1000000000,1,0) as n",
        ("orders",),
        "SELECT o_orderkey AS k, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN -1 WHEN o_orderdate > TIMESTAMP '1995-01-01' THEN 1 ELSE 0 END::BIGINT AS c, date_trunc('month',o_orderdate)::TIMESTAMP + ((8-isodow(date_trunc('month',o_orderdate)))%7) * INTERVAL 1 DAY + (o_orderdate - date_trunc('day',o_orderdate)::TIMESTAMP) AS mm, ((dayofyear(o_orderdate)-1)//7 + CASE WHEN (dayofyear(o_orderdate)-1)%7 >= dayofweek(o_orderdate) THEN 1 ELSE 0 END)::BIGINT AS yw, strftime(o_orderdate,'%Y-%m-%d %H:%M:%S') || ' +0000' AS ld, strftime(o_orderdate,'%Y-%m-%d') AS td, epoch(o_orderdate)::BIGINT AS lt, 7200::BIGINT AS gm, o_orderdate + INTERVAL 1 HOUR AS hour, 1::BIGINT AS n FROM orders",
    ),
    "type_more": Case(
        "s o_orderkey as k, detectdt(o_orderkey) as a, detectdt(o_orderpriority) as b, detectdt('2020-01-31') as c, detectdt('1.5') as d, isdate('2020-01-31') as e, isdate(o_orderpriority) as f, isstring(o_orderkey) as g, toint(o_custkey) as h, tofloat(o_custkey) as i",
        ("orders",),
        "SELECT o_orderkey AS k, 'LONG' AS a, 'STRING' AS b, 'DATE' AS c, 'DOUBLE' AS d, 1::BIGINT AS e, 0::BIGINT AS f, 1::BIGINT AS g, o_custkey::INTEGER AS h, o_custkey::DOUBLE AS i FROM orders",
    ),
    "machine": Case(
        "s r_regionkey as k, isfile('/') as a, isfolder('/') as b, fileexist('/') as c, fileexist('/no/such') as d, filesize('/no/such') as e, issymblink('/') as f, getsymblink('/') as g, isexecutable('/') as h, fileattrs('/no/such') as i, when(strlen(hostname())>0,1,0) as j, when(strlen(myips())>=0,1,0) as l",
        ("region",),
        "SELECT r_regionkey AS k, 0::BIGINT AS a, 1::BIGINT AS b, 1::BIGINT AS c, 0::BIGINT AS d, -1::BIGINT AS e, 0::BIGINT AS f, '' AS g, 1::BIGINT AS h, '' AS i, 1::BIGINT AS j, 1::BIGINT AS l FROM region",
    ),
    "anti_visible": Case(
        "m n_regionkey as r where n_nationkey >= 0 | s n_nationkey as k, n_regionkey as r | f n_regionkey noin @r[1][r]",
        ("nation",),
        "SELECT min(n_nationkey) AS k, n_regionkey AS r FROM nation GROUP BY 2",
    ),
}

class _Frames(dict):
    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    case = CASES[name]

    def ask(spark: SparkSession, sf_dir: str) -> DataFrame:
        if callable(case.tables):
            sources = [Table(f) for f in case.tables(_Frames(spark, sf_dir))]
        else:
            sources = [source(spark, sf_dir, t) for t in case.tables]
        return case.after(run(spark, case.query, *sources, **case.options))

    return ask


def _keyed(out: DataFrame, cells) -> DataFrame:
    """Rows of distinct cells, with the nation's key found again among them."""
    numbers = F.filter(cells, lambda x: x.rlike("^[0-9]+$"))
    return out.select(F.array_join(cells, "|").alias("cells"), F.size(numbers).cast("long").alias("numbers"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query(name) for name in CASES}
ORACLE_SQL: dict[str, str] = {name: case.sql for name, case in CASES.items()}
