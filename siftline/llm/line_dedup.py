"""Line dedup by site-relative frequency.

Pages are grouped by host. For each line of a host, the pages that contain it are divided by the
host's pages; a line whose ratio exceeds the limit is boilerplate there and is dropped from all
pages of that host.

Lines are compared without white space at their ends; blank lines are kept. Hosts below min_pages
and lines on fewer than min_line_pages pages are left alone, as their ratios say nothing.

Copies can be counted as one page (pages_of), so that a text that many rows of a host hold is no
boilerplate for that.

Defined results: a null text stays null; rows without a host are unchanged; a line that a page
repeats counts once for it; repeated rows count as pages each; a very long text is cleaned whole; a ratio
that equals the limit keeps the line; an empty table gives an empty table; the input's columns are
returned, with the text replaced, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import SPACES, written

#: A host's boilerplate list is joined by broadcast below so many lines in all (16 bytes each).
BROADCAST_LINES = 500_000


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(SPACES)))


def boilerplate(
    docs: DataFrame, text: str = "text", host: str = "source",
    ratio: float = 0.05, min_pages: int = 20, min_line_pages: int = 5, pages_of: DataFrame | None = None,
) -> DataFrame:
    """host, line key, pages with the line, pages of the host: the lines to drop.

    pages_of: a column of docs that tells rows apart, and `page`; rows of one page count once. Without it each row is a page.
    """
    pages = docs.where(F.col(host).isNotNull())
    keys = F.array_distinct(
        F.transform(
            F.filter(F.split(F.col(text), "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0),
            lambda x: _line_key(x),
        )
    )
    if pages_of is None:
        owners = pages.select(F.col(host).alias("host"))
        held = pages.select(F.col(host).alias("host"), F.explode(keys).alias("line"))
    else:
        row = next(c for c in pages_of.columns if c != "page")
        known = pages.select(F.col(f"`{row}`"), F.col(host).alias("host"), keys.alias("keys")).join(pages_of, row)
        owners = known.select("host", "page").distinct()
        held = known.select("host", "page", F.explode("keys").alias("line")).distinct()
    totals = owners.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    lines = (
        held.groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_line_pages)
    )
    return lines.join(totals, "host").where(F.col("n") > F.col("pages") * ratio)


def without_boilerplate(
    docs: DataFrame, text: str = "text", host: str = "source",
    ratio: float = 0.05, min_pages: int = 20, min_line_pages: int = 5, pages_of: DataFrame | None = None,
) -> DataFrame:
    """docs with the host's boilerplate lines dropped from the text."""
    drop = written(boilerplate(docs, text, host, ratio, min_pages, min_line_pages, pages_of))
    # a host has at most (lines a page) / ratio such lines, so that a list per host is short
    lists = drop.groupBy(F.col("host").alias("h")).agg(F.collect_set("line").alias("drop"))
    if drop.count() <= BROADCAST_LINES:
        lists = F.broadcast(lists)
    # the input's columns travel in a struct, so that no name of theirs can clash
    rows = docs.select(F.struct("*").alias("row"))
    joined = rows.join(lists, F.col("row")[host] == F.col("h"), "left")
    left = F.array_join(F.filter(F.split(F.col("row")[text], "\n"), lambda x: ~F.array_contains("drop", _line_key(x))), "\n")
    cleaned = F.when(F.col("drop").isNull(), F.col("row")[text]).otherwise(left)
    return joined.select(*[(cleaned if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
