"""Connected components of a link table, by alternating large-star and small-star steps.

Only per-node minima are aggregated, so that a node with very many links needs no large group; its
links are joined to its one minimum, a join that AQE splits when a node's links outgrow a
task. Each step's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import dropped, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: a > b. Large: each node hands its larger neighbours its least one; small: its smaller neighbours."""
    if large:
        sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = sides.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") > F.col("b")).distinct()


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def labelled(links: DataFrame) -> DataFrame:
    """node, label (least node of its component) for all nodes that have a link. links: columns a, b of one ordered type."""
    now = written(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = _mark(now)
    while mark[0]:
        wide = written(_star(now, True))
        dropped(now)
        now = written(_star(wide, False))
        dropped(wide)
        after = _mark(now)
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        roots.select("node", F.col("node").alias("label"))
    )
