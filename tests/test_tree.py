"""Hierarchies that are deeper than any fixed number of joins."""

from siftline.operators import tree

SCHEMA = "_line long, _key string, _parent string, name string"


def expanded(spark, rows):
    found = tree.expanded(spark.createDataFrame(rows, SCHEMA), ["name"]).collect()
    return {r["_key"]: r for r in found}


def test_long_chain(spark):
    n = 260
    got = expanded(spark, [(n - i, f"k{i}", f"k{i - 1}" if i else "", f"n{i}") for i in range(n)])
    assert len(got) == n
    for i in range(n):
        r = got[f"k{i}"]
        assert (r["_level"], r["_nodeid"], r["_isleaf"]) == (i, i + 1, int(i == n - 1))
        assert r["_path_name"] == [f"n{j}" for j in range(i + 1)] and r["_order"] == [n - j for j in range(i + 1)]
        assert (r["_root_name"], r["_up_name"]) == ("n0", f"n{i - 1}" if i else "")


def test_long_cycle_with_a_tail_beside_a_tree(spark):
    n = 230
    rows = [((i + 100) % n + 10, f"c{i}", f"c{(i - 1) % n}", f"c{i}") for i in range(n)]
    rows += [(1, "t", "c5", "t"), (2, "self", "self", "self"), (3, "below", "self", "below")]
    got = expanded(spark, rows)
    assert len(got) == n + 3
    head = n - 100  # of the least line
    for i in range(n):
        r = got[f"c{i}"]
        assert r["_level"] == (i - head) % n and r["_root_name"] == f"c{head}"
    assert got["t"]["_level"] == (5 - head) % n + 1 and got["t"]["_up_name"] == "c5" and got["t"]["_isleaf"] == 1
    assert got["self"]["_level"] == 0 and got["below"]["_path_name"] == ["self", "below"]
