"""Hierarchies: rows linked by key and parent key, in preorder.

Each row gets its path of (position, key) pairs from the root by pointer doubling: joins that double
the stretch of the path known so far, so that a hierarchy of any depth takes as many joins as the
logarithm of its depth, with no recursion and no driver-side tree. Rows on a cycle: the first row of
the cycle in input order becomes a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators.shared import dropped, written


def expanded(rows: DataFrame, carried: list[str], number_nodes: bool = True) -> DataFrame:
    """rows: _line (unique long), _key, _parent and the columns `carried`.

    Adds _level, _nodeid (if asked for), _isleaf, _order (array that sorts in preorder) and, for each carried column
    c, _root_c, _up_c (the parent's) and _path_c (array from the root). Of rows with equal keys the
    first in line order stays.
    """
    first = Window.partitionBy("_key").orderBy("_line")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    parents = rows.select(F.col("_key").alias("_pk"), F.col("_line").alias("_least"))
    linked = rows.join(parents, rows["_parent"] == parents["_pk"], "left")
    own = F.col("_parent").eqNullSafe(F.col("_key"))
    top = F.col("_pk").isNull() | own
    linked = linked.withColumn("_next", F.when(~top, F.col("_parent"))).withColumn("_least", F.when(~top, F.col("_least")))
    linked = written(linked.drop("_pk"))
    heads = _cycle_heads(linked.select("_line", "_key", "_next", "_least")).select(F.col("_line").alias("_head"))
    rooted = linked.join(heads, linked["_line"] == heads["_head"], "left")
    rooted = rooted.withColumn("_next", F.when(F.col("_head").isNull(), F.col("_next"))).drop("_head", "_least")
    found = _with_paths(rooted, carried)
    held = found.where("_level > 0").select(F.col("_parent").alias("_pp"))
    out = found
    if number_nodes:
        out = found.withColumn("_nodeid", F.row_number().over(Window.orderBy("_order")).cast("long"))
    leaf = out.join(held.select("_pp").distinct(), out["_key"] == F.col("_pp"), "left")
    return leaf.withColumn("_isleaf", F.when(F.col("_pp").isNull(), 1).otherwise(0).cast("long")).drop("_pp")


def _with_paths(rows: DataFrame, carried: list[str]) -> DataFrame:
    """rows: _next is the parent's key, null for roots. A row's stretch grows upward until it begins at a root."""
    paths = {"_order": "_line", **{f"_path_{c}": c for c in carried}}
    known = written(rows.select("_line", "_key", "_next", *[F.array(c).alias(p) for p, c in paths.items()]))
    while not known.where(F.col("_next").isNotNull()).isEmpty():
        above = known.select(F.col("_key").alias("_ak"), F.col("_next").alias("_an"), *[F.col(p).alias(f"_a{p}") for p in paths])
        longer = known.join(above, known["_next"] == above["_ak"], "left")
        before, known = known, written(
            longer.select(
                "_line", "_key", F.col("_an").alias("_next"),
                *[F.when(F.col("_ak").isNull(), F.col(p)).otherwise(F.concat(f"_a{p}", p)).alias(p) for p in paths],
            )
        )
        dropped(before)
    level = F.size("_order").cast("long") - 1
    return rows.drop("_next").join(known.drop("_key", "_next"), "_line").select(
        *[c for c in rows.columns if c != "_next"],
        level.alias("_level"),
        "_order",
        *[x for c in carried for x in (
            F.element_at(f"_path_{c}", 1).alias(f"_root_{c}"),
            F.when(level > 0, F.try_element_at(f"_path_{c}", F.lit(-2))).otherwise(F.lit("")).alias(f"_up_{c}"),
            f"_path_{c}",
        )],
    )


def _cycle_heads(walk: DataFrame) -> DataFrame:
    """Of each cycle the least line. walk: _line, _key, _next (parent's key or null) and _least (the parent's line).

    _least is the least line of a stretch of rows above; stretches double until none gets less. It is
    one's own line only on a cycle, at its least row.
    """
    while True:
        above = walk.select(F.col("_key").alias("_ak"), F.col("_next").alias("_an"), F.col("_least").alias("_al"))
        walk = written(
            walk.join(above, walk["_next"] == above["_ak"], "left").select(
                "_line", "_key", F.col("_an").alias("_next"), F.least("_least", "_al").alias("_least"), (F.col("_al") < F.col("_least")).alias("_moved")
            )
        )
        if walk.where("_moved").isEmpty():
            return walk.where("_least = _line").select("_line")
        walk = walk.drop("_moved")
