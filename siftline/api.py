"""The user's entry: run a query text, or build a query clause by clause."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

from siftline.operators import sinks
from siftline.plans.build import build
from siftline.plans.clauses import NAMES, QueryError, clauses
from siftline.plans.planner import Options, Result
from siftline.sources.text import Inventory, Lines, Table, Text


def source_of(x, recursive: bool = False, whole: bool = False, file_header: bool = False):
    """A DataFrame is a table; "-" is standard input, as far as it goes; a path that exists or names a store or pattern is files; other texts are data."""
    if isinstance(x, DataFrame):
        return Table(x)
    if x == "-":
        return Lines(sys.stdin.read())
    if not isinstance(x, str):
        return x
    is_path = "://" in x or os.path.exists(x) or (("*" in x or "?" in x) and "/" in x and "\n" not in x)
    if not is_path:
        return Lines(x)
    return Inventory(x, recursive) if file_header else Text(x, recursive, whole=whole)


def run(
    spark: SparkSession,
    query: str | dict[str, str],
    *sources,
    variables: str = "",
    macros: str = "",
    nameline: bool = False,
    textonly: bool = False,
    detect_rows: int = 1,
    skip: int = 0,
    recursive: bool = False,
    wholetext: bool = False,
    file_header: bool = False,
) -> Result:
    """The result of a query over texts, files, folders, patterns, DataFrames or source objects."""
    found = [source_of(s, recursive, wholetext, file_header) for s in sources] or [Lines("")]
    options = Options(nameline, textonly, detect_rows, skip, variables, macros)
    return build(spark, query, found, options)


class Query:
    """A session: set clauses, load sources, run; then clear."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.clear()

    def clear(self) -> "Query":
        self._clauses: dict[str, str] = {}
        self._sources: list = []
        self._options: dict = {}
        return self

    def load(self, *sources) -> "Query":
        self._sources += sources
        return self

    def set(self, clause: str, text: str) -> "Query":
        name = NAMES.get(clause.lower(), clause.lower())
        if name not in {*NAMES.values(), ">", ">>"}:
            raise QueryError(f"unknown clause: {clause}")
        self._clauses[name] = text
        return self

    def option(self, **options) -> "Query":
        self._options.update(options)
        return self

    def run(self, query: str | None = None) -> Result:
        found = clauses(query) if query is not None else self._clauses
        return run(self.spark, found, *self._sources, **self._options)

    def __getattr__(self, name: str):
        if name in NAMES.values():
            return lambda text="": self.set(name, text)
        raise AttributeError(name)


__all__ = ["Inventory", "Lines", "Query", "QueryError", "Result", "Table", "Text", "run", "sinks"]
