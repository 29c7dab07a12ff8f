"""Output: text and JSON on the driver, and files routed per row."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.values import Val, kind_of, text
from siftline.plans.planner import Result


def as_text(frame: DataFrame) -> DataFrame:
    """All columns as the language prints them; null prints as nothing."""
    cells = [
        F.coalesce(text(Val(F.col(f"`{f.name}`"), kind_of(f.dataType))) if "Array" not in type(f.dataType).__name__ else F.array_join(F.col(f"`{f.name}`"), "\t"), F.lit("")).alias(f.name)
        for f in frame.schema.fields
    ]
    return frame.select(*cells)


def lines(result: Result, delimiter: str = "\t", header: bool = False) -> list[str]:
    """The printed form. It collects the result: limit it first if it may be large."""
    frame = as_text(result.frame.drop("_target"))
    out = []
    if header:
        out += [delimiter.join(result.names), delimiter.join("-" * len(n) for n in result.names)]
    out += [delimiter.join(row) for row in frame.collect()]
    if result.report is not None:
        out += [delimiter.join(row) for row in result.report.collect()]
    return out


def to_json(result: Result, matched: int | None = None) -> str:
    rows = result.frame.drop("_target").collect()
    records = [{n: row[i] for i, n in enumerate(result.names)} for row in rows]
    found = result.matched.count() if matched is None and result.matched is not None else matched
    return json.dumps({"records": records, "MatchedLines": found, "SelectedRows": len(records)}, default=str, ensure_ascii=False)


def counts(result: Result) -> dict[str, int]:
    """The statistics-only output."""
    return {"MatchedLines": result.matched.count() if result.matched is not None else 0, "SelectedRows": result.frame.count()}


def write(result: Result, folder: str, delimiter: str = "\t") -> None:
    """Rows as text below folder, one subfolder `target=<path>` per value of the output expression.

    Paths are values, not places: what could leave the folder is replaced.
    """
    if result.sink is None:
        as_text(result.frame).select(F.concat_ws(delimiter, "*").alias("value")).write.mode("overwrite").text(folder)
        return
    mode, column = result.sink
    shown = as_text(result.frame)
    line = F.concat_ws(delimiter, *[F.col(f"`{n}`") for n in result.names])
    target = F.regexp_replace(F.regexp_replace(F.col(column), r"\.\.+", "_"), r"[^\w./-]", "_")
    target = F.regexp_replace(F.ltrim(target, F.lit("/")), "/", "_")
    out = shown.select(line.alias("value"), target.alias("target"))
    writer = out.write.mode(mode).partitionBy("target")
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.text(folder)


def save(frame: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite") -> None:
    names = [re.sub(r"[ ,;{}()\n\t=]", "_", c) for c in frame.columns]
    frame.toDF(*names).write.mode(mode).format(form).save(path)
