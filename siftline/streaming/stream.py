"""The same queries over streams: the compiled plan of a batch query applied to streaming rows.

Row-wise clauses (parse, set, filter, select, duplicate) stream in append mode; fields of a parsed text
stream are texts unless `set` gives them a type, as no row can be looked at before. Group with its
having streams in complete or update mode; truncdate groups are windows with a watermark; running
totals keep a state per key. Clauses that need all rows in order (sort, unique, tree, analytic
functions, line numbers, running variables) are answered by foreach_batch over all rows so far, which
it keeps in a table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from siftline.plans.build import build
from siftline.plans.clauses import QueryError, clauses
from siftline.plans.planner import ANALYTIC, Options
from siftline.sources.text import Table

ORDERED = ("sort", "unique", "tree", "limit", "report", "meanwhile")


def needs_all_rows(query: str) -> bool:
    found = clauses(query)
    text = " ".join(found.values()).lower()
    return any(c in found for c in ORDERED) or any(f"{n}(" in text for n in ANALYTIC) or "@line" in text or "@row" in text


def streamed(spark: SparkSession, query: str, rows: DataFrame, options: Options | None = None) -> DataFrame:
    """A streaming DataFrame with the query's result. rows: a streaming DataFrame with typed columns, or with one column to be parsed."""
    if needs_all_rows(query):
        raise QueryError("this query needs all rows: use foreach_batch")
    return build(spark, query, [Table(rows)], options).frame


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files that appear in a folder."""
    return spark.readStream.text(path)


def foreach_batch(
    spark: SparkSession, query: str, rows: DataFrame, sink, checkpoint: str, options: Options | None = None, order: str | None = None,
    **trigger,
) -> StreamingQuery:
    """After each micro-batch, hands the query's result over all rows so far to sink(frame, batch id).

    The rows are kept below `checkpoint`, a folder a batch, so that a batch that is tried again does not count twice.
    """
    kept = f"{checkpoint.rstrip('/')}-rows"

    def one(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        placed = batch.withColumn("_arrival", F.struct(F.lit(number).cast("long").alias("batch"), F.monotonically_increasing_id().alias("at")))
        placed.write.mode("overwrite").parquet(f"{kept}/{number:012d}")
        held = session.read.schema(placed.schema).parquet(*[f"{kept}/{n:012d}" for n in range(number + 1)])
        table = Table(held.drop("_arrival"), order) if order else Table(held.orderBy("_arrival").drop("_arrival"))
        sink(build(session, query, [table], options).frame, number)

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Each row's key, order and value with the number and the sum of its key's values so far, over all micro-batches.

    Within a micro-batch rows are taken in order; between micro-batches, as they arrive.
    """
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def step(of: tuple, frames, state):
        n, total = state.get if state.exists else (0, 0.0)
        part = pd.concat(list(frames)).sort_values(order, kind="stable")
        values = part[value].astype("float64").fillna(0.0)
        out = part[[key, order, value]].copy()
        out["n"] = range(n + 1, n + 1 + len(part))
        out["total"] = total + values.cumsum()
        state.update((n + len(part), float(total + values.sum())))
        yield out

    schema = f"`{key}` {fields[key]}, `{order}` {fields[order]}, `{value}` {fields[value]}, n long, total double"
    return rows.select(key, order, value).groupBy(key).applyInPandasWithState(
        step, schema, "n long, total double", "append", GroupStateTimeout.NoTimeout
    )


def bucketed(rows: DataFrame, stamp: str, seconds: int, keys: list[str], aggregates: dict[str, str], delay: str = "0 seconds") -> DataFrame:
    """Tumbling buckets of a stream with late rows accepted within delay."""
    out = rows.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, delay).groupBy(F.window(stamp, f"{seconds} seconds"), *keys)
    return out.agg(*[F.expr(e).alias(n) for n, e in aggregates.items()]).withColumn("bucket", F.col("window.start")).drop("window")
