"""Row numbers without gathering all rows in one task.

Rows lie in blocks that follow one another: splits of files, partitions of a table. Rows are numbered
within their block, and each block starts where those before it end; only one row a block is
summed up in order. Tables with a key order are dealt by ranges of the key first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators.shared import written

#: Low bits of a row's place in its partition, as monotonically_increasing_id makes it.
PLACE_BITS = 33


def numbered(rows: DataFrame, total: str, in_file: str | None = None) -> DataFrame:
    """rows (_fileid, _pos) with their number in order, and their number within their file."""
    if rows.isStreaming:
        raise ValueError("rows of a stream have no numbers")
    names = [f.name for f in rows.schema["_pos"].dataType.fields]
    if names == ["block", "at"]:
        marked, within = rows.withColumn("_block", F.col("_pos.block")), F.col("_pos.at")
    elif names == ["at"]:
        marked, within = rows.withColumn("_block", F.shiftright("_pos.at", PLACE_BITS)), F.col("_pos.at")
    else:
        dealt = rows.repartitionByRange("_fileid", "_pos").sortWithinPartitions("_fileid", "_pos")
        marked = written(dealt.withColumn("_place", F.monotonically_increasing_id()))
        marked, within = marked.withColumn("_block", F.shiftright("_place", PLACE_BITS)), F.col("_place")
    counts = marked.groupBy("_fileid", "_block").agg(F.count(F.lit(1)).alias("_held"))
    before = lambda *keys: F.coalesce(
        F.sum("_held").over(Window.partitionBy(*keys).orderBy("_fileid", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    starts = counts.select(F.col("_fileid").alias("_sf"), F.col("_block").alias("_sb"), before().alias("_total"), before("_fileid").alias("_own"))
    own = F.row_number().over(Window.partitionBy("_fileid", "_block").orderBy(within))
    placed = marked.withColumn("_own_place", own).join(
        starts, (F.col("_fileid") == F.col("_sf")) & F.col("_block").eqNullSafe(F.col("_sb"))
    )
    columns = [F.col(f"`{c}`") for c in rows.columns] + [(F.col("_total") + F.col("_own_place")).cast("long").alias(total)]
    if in_file:
        columns.append((F.col("_own") + F.col("_own_place")).cast("long").alias(in_file))
    return placed.select(*columns)


def heads(rows: DataFrame, lines: int) -> DataFrame:
    """rows of files or texts with `_head`: their number in their file if it is `lines` or less, else null. Nothing is moved."""
    place = F.col("_pos.at")
    blocks = rows.groupBy("_fileid", F.col("_pos.block").alias("_block")).agg(F.min(place).alias("_from"), F.count(F.lit(1)).alias("_held"))
    before = F.sum("_held").over(Window.partitionBy("_fileid").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    # of a file, the blocks that its first lines lie in: one as a rule
    first = blocks.withColumn("_own", F.coalesce(before, F.lit(0))).where(F.col("_own") < lines)
    first = first.select(F.col("_fileid").alias("_sf"), F.col("_block").alias("_sb"), "_from", "_own")
    number = F.col("_own") + place - F.col("_from") + 1
    hit = (F.col("_fileid") == F.col("_sf")) & F.col("_pos.block").eqNullSafe(F.col("_sb"))
    return rows.join(F.broadcast(first), hit, "left").select(*[F.col(f"`{c}`") for c in rows.columns], F.when(number <= lines, number).alias("_head"))
