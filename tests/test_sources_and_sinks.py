import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.api import Query, Table, run, sinks
from siftline.operators import parsing
from siftline.plans.clauses import clauses
from siftline.streaming import stream


def _files(tmp_path):
    (tmp_path / "a.log").write_text("k v\na 1\nb 2\n")
    (tmp_path / "b.log").write_text("k v\nc 3\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.log").write_text("d 4\n")
    return str(tmp_path)


def test_folder_pattern_and_recursion(spark, tmp_path):
    top = _files(tmp_path)
    assert sorted(sinks.lines(run(spark, "s @1", top))) == ["a", "b", "c", "k", "k"]
    assert sorted(sinks.lines(run(spark, "s @1", top, recursive=True))) == ["a", "b", "c", "d", "k", "k"]
    assert sorted(sinks.lines(run(spark, "s @1", top + "/a*.log"))) == ["a", "b", "k"]


def test_file_numbers_names_and_lines(spark, tmp_path):
    top = _files(tmp_path)
    got = sinks.lines(run(spark, "s @file,@fileid,@line,@fileline,@1", top + "/a.log", top + "/b.log"))
    assert got == ["a.log\t1\t1\t1\tk", "a.log\t1\t2\t2\ta", "a.log\t1\t3\t3\tb", "b.log\t2\t4\t1\tk", "b.log\t2\t5\t2\tc"]


def test_name_line_and_skip(spark, tmp_path):
    top = _files(tmp_path)
    assert sinks.lines(run(spark, "s k,v | f v>1", top + "/a.log", nameline=True)) == ["b\t2"]
    assert sinks.lines(run(spark, "s @1", top + "/a.log", skip=2)) == ["b"]


def test_pattern_across_lines(spark, tmp_path):
    (tmp_path / "x.txt").write_text("begin\n1\nend\nbegin\n2\nend\n")
    got = sinks.lines(run(spark, r"p /begin\n(\d)\nend/ | s @1", str(tmp_path / "x.txt"), wholetext=True))
    assert sorted(got) == ["1", "2"]


def test_inventory(spark, tmp_path):
    got = sinks.lines(run(spark, "s @file", _files(tmp_path), file_header=True))
    assert sorted(got) == ["a.log", "b.log"]


def test_header_json_and_counts(spark):
    out = run(spark, "s @1 as name, @2 as n | f @2>1", "a 1\nb 2\nc 3")
    assert sinks.lines(out, ",", header=True) == ["name,n", "----,-", "b,2", "c,3"]
    found = json.loads(sinks.to_json(out))
    assert found["SelectedRows"] == 2 and found["records"][0] == {"name": "b", "n": "2"}
    assert sinks.counts(out)["SelectedRows"] == 2


def test_rows_are_routed_to_files(spark, tmp_path):
    out = run(spark, "s @2 | > '../x/'+@1", "a 1\nb 2\na 3")
    sinks.write(out, str(tmp_path / "out"))
    targets = sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir())
    assert len(targets) == 2 and all(".." not in t for t in targets)
    assert spark.read.text(str(tmp_path / "out" / targets[0])).count() == 2


def test_session_object(spark):
    q = Query(spark).load("a 1\nb 2").select("@1").filter("@2=2")
    assert sinks.lines(q.run()) == ["b"]
    assert q.clear()._clauses == {}


def test_native_columns_reach_the_scan(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    out = run(spark, "s o_orderkey as k | f o_totalprice > 1000", Table(frame, "o_orderkey")).frame
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice" in plan and "o_orderpriority" not in plan.split("ReadSchema")[-1]


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    query = "s event_type as kind, count(1) as n | g event_type"
    q = stream.streamed(spark, query, rows).writeStream.format("memory").queryName("kinds").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["kind"], r["n"]) for r in spark.table("kinds").collect()}
    assert got == {(r["kind"], r["n"]) for r in run(spark, query, Table(source)).frame.collect()}
    plain = stream.streamed(spark, "s event_id as k | f value > 50", rows)
    q = plain.writeStream.format("memory").queryName("plain").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("plain").count() == source.where("value > 50").count()


def test_stream_with_blocking_clauses(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    got = []
    stream.foreach_batch(
        spark, "s event_id as k | o event_id desc | l 3", rows, lambda f, n: got.extend(r["k"] for r in f.collect()), str(tmp_path / "cp"), order="event_id"
    ).awaitTermination()
    assert got == [r["event_id"] for r in source.orderBy(source.event_id.desc()).limit(3).collect()]


def test_blocking_clauses_over_several_batches(spark, tmp_path):
    for n, part in enumerate(["a 3\nb 9\n", "c 7\nd 1\n", "e 8\n"]):
        (tmp_path / f"in{n}").mkdir()
        (tmp_path / f"in{n}" / "x.txt").write_text(part)
    (tmp_path / "in").mkdir()
    got = []
    for n in range(3):
        (tmp_path / "in" / f"{n}.txt").write_text((tmp_path / f"in{n}" / "x.txt").read_text())
        rows = stream.lines(spark, str(tmp_path / "in"))
        stream.foreach_batch(
            spark, "p d/ / | s @1, @2 | o tolong(@2) desc | l 2", rows, lambda f, b: got.append([tuple(r) for r in f.collect()]), str(tmp_path / "cp")
        ).awaitTermination()
    assert got == [[("b", "9"), ("a", "3")], [("b", "9"), ("c", "7")], [("b", "9"), ("e", "8")]]


def collected(spark, frame, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def test_text_streams_are_parsed(spark, tmp_path):
    (tmp_path / "a.txt").write_text("k=1 x\nnone\nk=22 y\n")
    rows = stream.lines(spark, str(tmp_path))
    named = stream.streamed(spark, r"p /k=(?P<n>\d+) (?P<w>\w)/ | t n long | s w as w, n+1 as m | f n > 1", rows)
    assert collected(spark, named, "named") == [("y", 23)]
    split = stream.streamed(spark, "p d/ / | s @2 as b, @1 as a | f @2 like '?'", rows)
    assert sorted(collected(spark, split, "split")) == [("x", "k=1"), ("y", "k=22")]


def test_running_totals_over_batches(spark, tmp_path):
    schema = "k string, i long, v double"
    (tmp_path / "in").mkdir()
    rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    totals = stream.running(rows, "k", "v", "i")
    got = []
    for part in ([("a", 1, 2.0), ("b", 2, 5.0), ("a", 3, 4.0)], [("a", 4, 1.0), ("b", 5, None)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = totals.writeStream.foreachBatch(lambda f, n: got.extend(tuple(r) for r in f.collect()))
        q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r[1], r[3], r[4]) for r in got) == [(1, 1, 2.0), (2, 1, 5.0), (3, 2, 6.0), (4, 3, 7.0), (5, 2, 5.0)]


def test_tumbling_buckets_with_late_rows(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    got = collected(spark, stream.bucketed(rows, "ts", 3600, ["event_type"], {"n": "count(1)", "top": "max(value)"}, "1 hour"), "buckets", "complete")
    want = source.groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp"))).agg(F.count("*"), F.max("value")).collect()
    assert {(r[3], r[0], r[1], r[2]) for r in got} == {(r[1], r[0], r[2], r[3]) for r in want}


def test_standard_input(spark, monkeypatch):
    import io
    import sys

    monkeypatch.setattr(sys, "stdin", io.StringIO("x 1\ny 2\n"))
    assert sinks.lines(run(spark, "s @1 | f @2 = 2", "-")) == ["y"]


def test_named_zones(spark):
    got = sinks.lines(run(spark, "s datetolong('2024-01-31 10:00:00 EST'), detectdt(@1), timediff('2024-01-31 10:00:00 UTC','2024-01-31 10:00:00 +0100')", "x"))
    assert got == ["1706713200\tSTRING\t3600"]
    assert sinks.lines(run(spark, "p d/,/ | s truncdate(@1,3600)", "2024-01-31 10:20:00 UTC,1")) == ["2024-01-31 10:00:00 UTC"]


def test_clause_splitting():
    assert clauses("p d/ /\"\"[]/r | s upper('a|b') | f (@1='x' or @2='|') | > 'f'") == {
        "parse": "d/ /\"\"[]/r", "select": "upper('a|b')", "filter": "(@1='x' or @2='|')", ">": "'f'",
    }
    assert clauses(r"p d/\|/ | s @1")["parse"] == r"d/\|/"
    assert clauses("p /(a|b)/ | s 1")["parse"] == "/(a|b)/"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cells=st.lists(st.text("abc 1", max_size=4), min_size=1, max_size=5))
def test_split_and_join_round_trip(spark, cells):
    line = ",".join(cells)
    frame = spark.createDataFrame([(line,)], "raw string")
    got = frame.select(parsing.delimited(frame.raw, parsing.mode("d/,/"))).first()[0]
    assert ",".join(got) == line and len(got) == len(cells)
