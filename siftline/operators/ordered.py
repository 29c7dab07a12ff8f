"""Blocks of rows that follow one another in an order, for what runs over all rows.

A row's block is a function of its keys alone, so that every pass over the rows finds the same blocks. Windows run
within blocks; what the blocks before add is summed up over one row a block. Rows are sampled for the blocks' bounds,
which set their sizes only. Few rows are one block.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.operators.shared import written

#: Rows of a block, until there are MOST_BLOCKS.
BLOCK_ROWS = 500_000
MOST_BLOCKS = 256
#: Sampled rows a block.
SAMPLED = 64
#: Steps that give the same rows, in the same partitions, each time they run.
ROW_WISE = frozenset("Project Filter Generate Union LogicalRelation LocalRelation".split())


def blocked(rows: DataFrame, keys: list[tuple[Column, bool]]) -> tuple[DataFrame, int]:
    """rows with `_block`, from 0 in the order of keys (column, whether descending), and the number of blocks.

    Nulls come first, in descending order last.
    """
    if rows.isStreaming:
        raise ValueError("rows of a stream have no order")
    if not _repeatable(rows):
        rows = written(rows)
    count = rows.count()
    wanted = min(MOST_BLOCKS, math.ceil(count / BLOCK_ROWS))
    keys = [key for k in keys for key in _flat(rows, *k)]
    bounds = _bounds(rows, keys, count, wanted) if wanted > 1 else []
    return rows.withColumn("_block", _block(keys, bounds) if bounds else F.lit(0)), len(bounds) + 1


def _repeatable(rows: DataFrame) -> bool:
    plans = [rows._jdf.queryExecution().optimizedPlan()]
    while plans:
        plan = plans.pop()
        if plan.nodeName() not in ROW_WISE:
            return False
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return True


def _flat(rows: DataFrame, key: Column, down: bool) -> list[tuple[Column, bool, T.DataType]]:
    """A key as values whose bounds survive the way to the driver and back; a struct as its fields, null structs first."""
    kind = rows.select(key.alias("k")).schema[0].dataType
    if isinstance(kind, T.StructType):
        parts = [(key.isNotNull(), down, T.BooleanType())]
        return parts + [x for f in kind.fields for x in _flat(rows, key.getField(f.name), down)]
    if isinstance(kind, T.TimestampType):
        return [(F.unix_micros(key), down, T.LongType())]
    if isinstance(kind, T.DateType):
        return [(F.unix_date(key), down, T.IntegerType())]
    return [(key, down, kind)]


def _bounds(rows: DataFrame, keys: list, count: int, wanted: int) -> list[tuple]:
    """The first keys of all blocks but the first. Whole texts are kept, as many may begin alike, of these rows only."""
    sample = rows.select(*[k.alias(f"k{i}") for i, (k, *_) in enumerate(keys)]).sample(min(1.0, SAMPLED * wanted / count), 1)
    order = [F.col(f"k{i}").desc_nulls_last() if down else F.col(f"k{i}").asc_nulls_first() for i, (_, down, _) in enumerate(keys)]
    window = Window.orderBy(*order)
    tiles = sample.withColumn("_tile", F.ntile(wanted).over(window)).withColumn("_last", F.lag("_tile").over(window))
    held = [tuple(r) for r in tiles.where("_tile > _last").orderBy("_tile").drop("_tile", "_last").collect()]
    return [b for i, b in enumerate(held) if i == 0 or b != held[i - 1]]


def _block(keys: list, bounds: list[tuple]) -> Column:
    """The number of bounds that a row does not precede, by halves. (Nested CASEs take Catalyst time exponential in their depth.)"""
    runs = [list(run) for _, run in itertools.groupby(enumerate(keys), lambda k: k[1][1])]
    edges = F.array(*[F.struct(*[_joined(run, lambda j: F.lit(b[j]).cast(keys[j][2])).alias(f"r{i}") for i, run in enumerate(runs)]) for b in bounds])  # noqa: B023
    own = F.struct(*[_joined(run, lambda j: keys[j][0]).alias(f"r{i}") for i, run in enumerate(runs)])

    def before(row: Column, edge: Column) -> Column:
        out = None
        for i, run in reversed(list(enumerate(runs))):
            key, bound = row.getField(f"r{i}"), edge.getField(f"r{i}")
            less = key > bound if run[0][1][1] else key < bound
            out = less if out is None else less | ((key == bound) & out)
        return out

    halves = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    beyond = lambda row, place: ~before(row, F.get(edges, place - 1))  # noqa: E731  (no bound there: null)
    search = lambda row: F.aggregate(halves, F.lit(0), lambda at, half: F.when(beyond(row, at + half), at + half).otherwise(at))
    # a list of one, so that the row's keys are put together once
    return F.get(F.transform(F.array(own), search), F.lit(0))


def _joined(run: list, of: Callable[[int], Column]) -> Column:
    """Keys of one direction as a struct, which compares by them with nulls first."""
    return F.struct(*[of(j).alias(f"k{j}") for j, _ in run])
