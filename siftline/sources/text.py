"""Sources: text files, folders and patterns of paths, literal lines, file inventories, and tables.

Each source becomes rows with its text in `_raw`, the file's name and number, and a position that
orders rows within the file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POSITION = "struct<block:bigint,at:bigint>"


@dataclass(frozen=True)
class Text:
    """Files to be read line by line, or whole where a pattern crosses lines."""

    path: str
    recursive: bool = False
    glob: str | None = None
    whole: bool = False

    def rows(self, spark: SparkSession) -> DataFrame:
        reader = spark.read
        if self.recursive:
            reader = reader.option("recursiveFileLookup", True)
        if self.glob:
            reader = reader.option("pathGlobFilter", self.glob)
        return reader.text(self.path, wholetext=self.whole).select(
            F.col("value").alias("_raw"),
            F.col("_metadata.file_path").alias("_file"),
            F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
            .cast(POSITION)
            .alias("_pos"),
        )


@dataclass(frozen=True)
class Lines:
    """A text given as such."""

    text: str
    name: str = ""

    def rows(self, spark: SparkSession) -> DataFrame:
        lines = self.text.split("\n")
        if lines and lines[-1] == "" and len(lines) > 1:
            lines.pop()
        frame = spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "_raw string, at long")
        place = F.struct(F.lit(0).cast("long").alias("block"), F.col("at")).cast(POSITION)
        return frame.select("_raw", F.lit(self.name).alias("_file"), place.alias("_pos"))


@dataclass(frozen=True)
class Inventory:
    """One row per file below a path, without its content."""

    path: str
    recursive: bool = False

    def rows(self, spark: SparkSession) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", self.recursive).load(self.path)
        place = F.struct(F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("at")).cast(POSITION)
        return files.select(F.lit("").alias("_raw"), F.col("path").alias("_file"), place.alias("_pos"))


@dataclass(frozen=True)
class Table:
    """A DataFrame whose columns are the fields; order: a column, or columns, that order its rows."""

    frame: DataFrame
    order: str | list[str] | None = None
    name: str = ""


def raw_of(frame: DataFrame) -> Column:
    """A table row as a line: its columns joined by tabs."""
    return F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in frame.columns])


def numbered_files(rows: DataFrame) -> DataFrame:
    """_fileid within this source: files by path, from 1. The files are listed, not read."""
    files = sorted(rows.inputFiles())
    if not files:
        return rows.withColumn("_fileid", F.lit(1))
    # a path's slashes after the scheme are written in several ways
    plain = lambda c: F.regexp_replace(c, "^([a-zA-Z0-9]+):/+", "$1:/")
    ids = rows.sparkSession.createDataFrame([(f, i) for i, f in enumerate(files, 1)], "_path string, _fileid int")
    return rows.join(ids, plain(F.col("_file")) == plain(F.col("_path"))).drop("_path")
