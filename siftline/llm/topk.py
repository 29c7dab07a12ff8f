"""Exact top-k inner-product search with dual cover trees.

Queries and data are indexed together. The top level is a set of centres (farthest first over a bounded
sample of vectors); every vector belongs to its nearest one, and every cell's covering radius is
taken over all its vectors. Below, a cover tree is built over either side of a part of a cell and
a block of queries, and both are walked together: a pair of nodes is pruned when no candidate
below can reach the worst k-th score among the query node's queries. With centres q, c and
covering radii u, r the bound is q.c + u|c| + r|q| + u r.

A first pass searches, for each query, one part of the cell that promises most, which gives it a k-th
score. The second pass sends a query only to cells whose bound q.c + r|q| reaches that score, which
the trees then start from. Cells are cut into parts, and the queries of a cell into blocks, of
bounded size; a part's vectors travel once per block of queries that need the cell. Ties go to the
smaller id, so only bounds strictly below a score are pruned.

Defined results: vectors that are null, or hold a null, NaN or infinite component, take no part;
candidates of another length than the query take no part in it; of rows that share an id the least
vector is the query, and every row with the query's id counts as its own; equal vectors are
candidates each; fewer candidates than k give fewer rows; an empty table gives an empty table; very
long vectors are compared whole; only id and vector are used, so that clashing names do no harm.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import written

#: Vectors of the sample that centres are chosen from, and most centres of one vector length.
SAMPLE, CENTRES = 20_000, 256


class CoverTree:
    """Nodes over rows of x, children mostly within half of their parent's radius; rows lie in leaf order.

    order[lo[n]:hi[n]] are the rows below node n, centre[n] its centre row, radius[n] its covering radius.
    """

    LEAF = 48
    FAN = 128

    def __init__(self, x: np.ndarray):
        self.x = x.astype(np.float64)
        self.square = np.einsum("ij,ij->i", self.x, self.x)
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.lo: list[int] = []
        self.hi: list[int] = []
        self.order = np.empty(len(x), np.int64)
        self.filled = 0
        rows = np.arange(len(x))
        self.root = self._add(0, rows, self._distance(rows, 0))

    def _distance(self, rows: np.ndarray, centre: int) -> np.ndarray:
        d = self.square[rows] + self.square[centre] - 2 * (self.x[rows] @ self.x[centre])
        return np.sqrt(np.maximum(d, 0))

    def _add(self, centre: int, rows: np.ndarray, distance: np.ndarray) -> int:
        node = len(self.centre)
        radius = float(distance.max())
        self.centre.append(centre)
        # a rounding allowance, as distances come from sums of squares
        self.radius.append(radius + 1e-6 * (1 + float(np.sqrt(self.square[rows].max()))))
        self.children.append([])
        self.lo.append(self.filled)
        self.hi.append(0)
        if len(rows) <= self.LEAF or radius <= 1e-9:
            self.order[self.filled : self.filled + len(rows)] = rows
            self.filled += len(rows)
        else:
            # farthest-first centres until each row is within half of the radius of one, or they are many
            nearest, owner, centres = distance.copy(), np.zeros(len(rows), np.int64), [centre]
            while nearest.max() > radius / 2 and len(centres) < self.FAN:
                far = int(nearest.argmax())
                d = self._distance(rows, int(rows[far]))
                d[far] = 0.0
                closer = d < nearest
                nearest[closer] = d[closer]
                owner[closer] = len(centres)
                centres.append(int(rows[far]))
            small = []
            for k, c in enumerate(centres):
                mine = owner == k
                few, tight = mine.sum() * 4 < self.LEAF, mine.sum() > 2 and nearest[mine].max() * 4 < radius
                if few and not tight and len(centres) > 1:
                    small.append(mine)
                elif mine.any():
                    self.children[node].append(self._add(c, rows[mine], nearest[mine]))
            # children of few rows share leaves, each with a covering radius of its own
            if small:
                rest = np.flatnonzero(np.logical_or.reduce(small))
                for k in range(0, len(rest), self.LEAF):
                    part = rows[rest[k : k + self.LEAF]]
                    mid = self.x[part].mean(axis=0)
                    c = int(part[np.argmin(((self.x[part] - mid) ** 2).sum(axis=1))])
                    self.children[node].append(self._add(c, part, self._distance(part, c)))
        self.hi[node] = self.filled
        return node


def best(
    queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int,
    floor: np.ndarray | None = None, tally: list[int] | None = None,
) -> list[list[tuple[int, int]]]:
    """Per query the k best (score, id), scores descending, ties to smaller ids; none below its floor.

    tally: gets the number of pairs that were scored.
    """
    exact = max(np.abs(queries).max(), 1) * max(np.abs(data).max(), 1) * queries.shape[1] < 2**52
    kind = np.float64 if exact else np.int64
    q, d = CoverTree(queries), CoverTree(data)
    qx, dx = queries[q.order].astype(kind), data[d.order].astype(kind)
    qid, did = query_ids[q.order], data_ids[d.order]
    q_norm, d_norm = np.sqrt(q.square), np.sqrt(d.square)
    worst = np.full(len(qx), -np.inf) if floor is None else floor[q.order].astype(np.float64)
    found: list[list[tuple[int, int]]] = [[] for _ in range(len(qx))]
    scored = 0

    def bound(a: int, b: int) -> float:
        qc, dc = q.centre[a], d.centre[b]
        u, r = q.radius[a], d.radius[b]
        return float(q.x[qc] @ d.x[dc]) + u * d_norm[dc] + r * q_norm[qc] + u * r

    agenda = [(-bound(q.root, d.root), q.root, d.root)]
    while agenda:
        top, a, b = heapq.heappop(agenda)
        if -top + abs(top) * 1e-12 < worst[q.lo[a] : q.hi[a]].min():
            continue
        if q.children[a] or d.children[b]:
            split_query = not d.children[b] or (q.children[a] and q.radius[a] > d.radius[b])
            for x, y in ((c, b) for c in q.children[a]) if split_query else ((a, c) for c in d.children[b]):
                heapq.heappush(agenda, (-bound(x, y), x, y))
            continue
        lo, hi = d.lo[b], d.hi[b]
        scores = qx[q.lo[a] : q.hi[a]] @ dx[lo:hi].T
        scored += scores.size
        for i, row in enumerate(scores, q.lo[a]):
            at = np.flatnonzero((row >= worst[i]) & (did[lo:hi] != qid[i]))
            if len(at):
                if len(at) > 4 * k:  # of many, those that can be among the k best
                    least = np.partition(row[at], len(at) - k)[len(at) - k]
                    at = at[row[at] >= least]
                merged = found[i] + [(-int(row[j]), int(did[lo + j])) for j in at]
                merged.sort()
                found[i] = merged[:k]
                if len(found[i]) == k:
                    worst[i] = max(worst[i], -found[i][-1][0])
    if tally is not None:
        tally.append(scored)
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(qx))]
    for i, rows in enumerate(found):
        out[q.order[i]] = [(-s, v) for s, v in rows]
    return out


def centres_of(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows of the sample, each farthest from those before it."""
    x = sample.astype(np.float64)
    picked = [0]
    nearest = ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < most and nearest.max() > 0:
        picked.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return x[picked]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.array(column.flatten()).reshape(len(column), width)


def _placed(centres: dict[int, np.ndarray]):
    """Each vector's cell (-1: a length without centres) and its distance from the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            widths = np.array(batch.column("width"))
            cell, distance = np.full(len(widths), -1, np.int32), np.zeros(len(widths))
            for width in np.unique(widths).tolist():
                if (c := centres.get(width)) is not None:
                    at = np.flatnonzero(widths == width)
                    x = _matrix(v.take(pa.array(at)), width).astype(np.float64)
                    square = (x**2).sum(axis=1)
                    gap = np.maximum(square[:, None] + (c**2).sum(axis=1) - 2 * (x @ c.T), 0)
                    cell[at] = gap.argmin(axis=1)
                    # a rounding allowance, as distances come from sums of squares
                    distance[at] = np.sqrt(gap.min(axis=1)) + 1e-6 * (1 + np.sqrt(square))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("id", "v", "q", "width", "spread")), pa.array(cell), pa.array(distance)],
                names=["id", "v", "q", "width", "spread", "cell", "distance"],
            )

    return run


def reached(x: np.ndarray, centres: np.ndarray, radius: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Which cells can hold a vector whose score with a query reaches the query's floor. radius: -1 for empty cells."""
    bound = x @ centres.T + np.sqrt((x**2).sum(axis=1))[:, None] * radius
    return (bound + np.abs(bound) * 1e-9 >= floor[:, None]) & (radius >= 0)


def _first_cells(centres: dict[int, np.ndarray], radius: dict[int, np.ndarray], parts: dict[tuple[int, int], int]):
    """Of each query the cell that promises most, and one of its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, chosen = [], []
            for i, width, spread in zip(range(batch.num_rows), batch.column("width").to_pylist(), batch.column("id").to_pylist(), strict=True):
                cell = -1
                if width in centres:
                    x = _matrix(batch.column("v").slice(i, 1), width).astype(np.float64)[0]
                    cell = int(np.where(radius[width] >= 0, centres[width] @ x, -np.inf).argmax())
                cells.append(cell)
                chosen.append(spread % parts.get((width, cell), 1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("id", "v", "width")), pa.array(cells, pa.int32()), pa.array(chosen, pa.int64()), pa.nulls(batch.num_rows, pa.float64())],
                names=["id", "v", "width", "cell", "part", "floor"],
            )

    return run


def _other_cells(centres: dict[int, np.ndarray], radius: dict[int, np.ndarray], parts: dict[tuple[int, int], int]):
    """The parts of cells that a query's bound reaches, but for the one that it was searched in first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, cells, places = [], [], []
            floor = np.array([-np.inf if f is None else f for f in batch.column("floor").to_pylist()])
            done = list(zip(batch.column("cell").to_pylist(), batch.column("part").to_pylist(), strict=True))
            for i, width in enumerate(batch.column("width").to_pylist()):
                if width in centres:
                    x = _matrix(batch.column("v").slice(i, 1), width).astype(np.float64)
                    hit = np.flatnonzero(reached(x, centres[width], radius[width], floor[i : i + 1])[0]).tolist()
                else:
                    hit = [-1]
                for cell in hit:
                    for part in range(parts.get((width, cell), 1)):
                        if (cell, part) != done[i]:
                            source.append(i)
                            cells.append(cell)
                            places.append(part)
            at = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n).take(at) for n in ("id", "v", "width")), pa.array(cells, pa.int32()), pa.array(places, pa.int64()), batch.column("floor").take(at)],
                names=["id", "v", "width", "cell", "part", "floor"],
            )

    return run


def _searcher(k: int):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        rows = []
        if asked.num_rows and held.num_rows:
            width = asked.column("width")[0].as_py()
            x, y = (_matrix(t.column("v").combine_chunks(), width) for t in (asked, held))
            ids = asked.column("id").to_numpy()
            floor = np.array([-np.inf if f is None else f for f in asked.column("floor").to_pylist()])
            got = best(x, ids, y, held.column("id").to_numpy(), k, floor)
            rows = [(int(a), v, s) for a, found in zip(ids, got, strict=True) for s, v in found]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def usable(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, or null if the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def nearest(
    table: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding",
    k: int = 5, scale: int = 256, shard_rows: int = 4096, block_rows: int = 1024,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best among all rows but its own."""
    rows = table.select(F.col(key).cast("long").alias("id"), usable(F.col(vector), scale).alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("v").isNotNull() & F.col("id").isNotNull() & (F.size("v") > 0))
    rows = rows.select("*", F.size("v").alias("width"), F.xxhash64(F.monotonically_increasing_id()).alias("spread"))
    total = rows.count()
    # centres of the lengths that the sample holds; vectors of others lie in one cell per length, whose bound always reaches
    found: dict[int, list] = {}
    for r in rows.select("v").sample(min(1.0, SAMPLE / max(total, 1)), 7).limit(2 * SAMPLE).toLocalIterator():
        found.setdefault(len(r["v"]), []).append(r["v"])
    most = min(CENTRES, -(-total // (shard_rows // 8 or 1)) or 1)
    centres = {width: centres_of(np.array(v), most) for width, v in found.items()}
    data = written(rows.mapInArrow(_placed(centres), "id long, v array<long>, q boolean, width int, spread long, cell int, distance double"))
    radius = {width: np.full(len(c), -1.0) for width, c in centres.items()}
    parts: dict[tuple[int, int], int] = {}
    for r in data.where("cell >= 0").groupBy("width", "cell").agg(F.max("distance").alias("r"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["width"]][r["cell"]] = r["r"]
        parts[r["width"], r["cell"]] = -(-r["n"] // shard_rows)
    sizes = table.sparkSession.createDataFrame([(w, c, n) for (w, c), n in parts.items()], "width int, cell int, parts long")
    dealt = data.join(F.broadcast(sizes), ["width", "cell"], "left").select(
        "id", "v", "width", "cell", F.pmod("spread", F.coalesce("parts", F.lit(1).cast("long"))).alias("part")
    )
    asked = data.where("q").groupBy("id").agg(F.min("v").alias("v")).withColumn("width", F.size("v"))
    placed = "id long, v array<long>, width int, cell int, part long, floor double"

    def searched(queries: DataFrame) -> DataFrame:
        queries = written(queries)
        blocks = queries.groupBy("width", "cell", "part").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
        place = ["width", "cell", "part"]
        mine = queries.join(blocks, place).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        theirs = dealt.join(blocks, place).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        group = [*place, "block"]
        return written(
            mine.drop("blocks").groupBy(*group).cogroup(theirs.drop("blocks").groupBy(*group)).applyInArrow(
                _searcher(k), "query_id long, vec_id long, score long"
            )
        )

    first = written(asked.mapInArrow(_first_cells(centres, radius, parts), placed))
    early = searched(first)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = early.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    kth = ranked.select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("kth"))
    known = first.join(kth, "id", "left").select("id", "v", "width", "cell", "part", F.col("kth").alias("floor"))
    late = searched(known.mapInArrow(_other_cells(centres, radius, parts), placed))
    partial = early.unionByName(late)
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
