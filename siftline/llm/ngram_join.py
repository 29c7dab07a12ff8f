"""N-gram Jaccard join: T-occurrence search with DivideSkip over inverted lists.

A document's set holds its distinct shingles (`size` consecutive words). Documents with equal sets
are one vertex, so that copies are never paired.

List lengths. The inverted list of a shingle is as long as the documents that hold it are many; all
lists are counted exactly, in blocks (blocks.py). A set of n shingles shares at least T = ceil(t * n) of
them with a similar one. A document with fewer than T shingles that some other document holds has no
similar one and takes no further part.

Short lists. Of the others' sets, the T - 1 longest lists are set aside (DivideSkip), so that a similar
pair meets in at least one of the n - T + 1 short ones. Only those are laid out, by shingle.

Merging. A pair that meets, has sizes that fit and likely parity sketches (each shingle flips one bit, so
that sketches differ in no more bits than sets in shingles) is verified: one set's shingles are
probed by binary search in the other until the overlap is reached or out of reach. As links only
have to connect, most of them are found before the lists are merged, among sets that share the least
of their salted shingles, in groups of bounded size. Lists within one component of these links are
done. Of each list that spans several, the members outside of its largest component meet all its
members of other components. So every similar pair ends up in one component, a list of very many near
copies costs little more than its length, and no text is copied.

Shingles are compared by 64-bit hashes, sets by 128-bit ones; list lengths may come from shorter
hashes, as a chance match only lengthens a list.

Defined results: null and wordless texts have an empty set and are linked with nothing; a text with
fewer words than a shingle has one shingle, the whole; rows with equal ids keep their own sets; rows
with a null id take part in links, with a null component if no row with an id is in reach; a very
long text is compared whole; ties do not arise, as components have no order; an empty table gives an
empty table; only id and text are used, so that clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm import memory
from siftline.llm.blocks import blocks, elsewhere, packed, places, unpacked, words_of
from siftline.llm.common import dropped, free_name, identified, written
from siftline.llm.components import labelled
from siftline.llm.hashing import mix

UPPER = bytes(range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
#: Words of a block, and of a slot of list lengths while slots are at most SLOTS; LARGE_SLOT_WORDS beyond.
BLOCK_WORDS, SLOT_WORDS, SLOTS, LARGE_SLOT_WORDS = 800_000, 1 << 18, 512, 1 << 20
#: Buckets of a set, and members of a bucket that are compared with one another.
BUCKETS, BUCKET = 8, 32
#: Pairs of one vertex that a task verifies; more are dealt over several.
SALTED = 4096


def shingles(words: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (shingle hash, row) pairs, ascending."""
    inside = places(lengths)
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    found, rows = [], []
    for span in range(1, size + 1):
        # a shorter text is one shingle, which ends with it
        at = np.flatnonzero(inside >= size - 1) if span == size else (np.cumsum(lengths) - 1)[lengths == span]
        h = np.full(len(at), span, np.uint64)
        for k in range(span):
            h = mix(h ^ words[at - span + 1 + k], k)
        found.append(h)
        rows.append(row[at])
    h, row = np.concatenate(found), np.concatenate(rows)
    order = np.lexsort((row, h)) if len(found[:-1]) and any(map(len, found[:-1])) else np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][: len(h)]
    return h[new], row[new]


def _features(size: int, bits: int):
    def of(block: dict) -> Iterator[np.ndarray]:
        yield shingles(*words_of(block), size)[0] >> np.uint64(64 - bits)

    return of


def slots_of(total: int) -> int:
    """Slots for so many words. From SLOTS on they grow in size first, as a block sends a row to each."""
    return max(min(total // SLOT_WORDS + 1, SLOTS), total // LARGE_SLOT_WORDS + 1)


def least_overlap(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return -(-n * num // den)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """512 parity bits as 8 numbers."""
    ones = (np.bincount((hashes & np.uint64(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8)
    return np.packbits(ones, bitorder="little").view(np.int64)


def _sets(size: int, num: int, den: int, slots: int, bits: int):
    """Per row: key, n and, where it may have a similar one, v (hash of the set), and once a block and v the set's shared part."""

    def run(table: pa.Table, counted: pa.Table) -> pa.Table:
        (block,) = table.select(["lengths", "vocabulary", "words"]).to_pylist()
        keys = table.column("keys").chunk(0).flatten()
        words, lengths = words_of(block)
        del block
        h, row = shingles(words, lengths, size)
        del words
        short = h >> np.uint64(64 - bits)
        first = np.flatnonzero(np.r_[True, short[1:] != short[:-1]][: len(h)])
        here = np.diff(np.r_[first, len(h)])
        del short
        by_slot = sorted(zip(counted.column("slot").to_pylist(), counted.column("counts").to_pylist(), strict=True))
        held = np.repeat(np.concatenate([np.zeros(0, np.int64), *(unpacked(c).view(np.int64) for _, c in by_slot)]) + here, here)
        n = np.bincount(row, minlength=len(lengths))
        need = least_overlap(n, num, den)
        alive = (n > 0) & (np.bincount(row[held > 1], minlength=len(lengths)) >= need)
        mine = np.flatnonzero(alive[row])
        h, row, held = h[mine], row[mine], held[mine]
        by_row = np.argsort(row, kind="stable")  # shingles still ascend within a row
        h, row, held = h[by_row], row[by_row], held[by_row]
        cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
        sums = [np.add.reduceat(mix(h, salt), cut) if len(cut) else h for salt in (11, 13)]
        least = np.empty((len(cut), BUCKETS), np.int64)
        for k in range(BUCKETS if len(cut) else 0):
            least[:, k] = np.minimum.reduceat(mix(h, 100 + k), cut).view(np.int64)
        vertex: list[bytes | None] = [None] * len(lengths)
        body: list[bytes | None] = [None] * len(lengths)
        prefix: list[np.ndarray | None] = [None] * len(lengths)
        marks: list[np.ndarray | None] = [None] * len(lengths)
        mins: list[np.ndarray | None] = [None] * len(lengths)
        seen = set()
        for a, b, one, two, low in zip(cut.tolist(), np.r_[cut[1:], len(row)][: len(cut)].tolist(), *(s.tolist() for s in sums), least, strict=True):
            r = int(row[a])
            vertex[r] = v = one.to_bytes(8, "little") + two.to_bytes(8, "little")
            if v in seen:
                continue
            seen.add(v)
            own, lists = h[a:b], held[a:b]
            shared = own[lists > 1]
            rarest = np.lexsort((shared, lists[lists > 1]))
            body[r] = packed(np.r_[shared[:1], np.diff(shared)])
            prefix[r] = shared[rarest[: len(shared) - int(need[r]) + 1]].view(np.int64)
            marks[r] = sketch(own)
            mins[r] = low
        return pa.table(
            [
                keys, pa.array(n, pa.int64()), pa.array(vertex, pa.binary()), pa.array(body, pa.binary()),
                *(pa.array(x, pa.list_(pa.int64())) for x in (prefix, marks, mins)),
            ],
            names=["id", "n", "v", "body", "prefix", "marks", "mins"],
        )

    return run


def overlaps(a: np.ndarray, b: np.ndarray, need: int) -> bool:
    """Whether ascending a and b share `need` numbers or more: the smaller is probed in the larger by binary search."""
    if len(a) > len(b):
        a, b = b, a
    if not need:
        return True
    if len(a) < need:
        return False
    hits, step = 0, max(64, len(a) - need + 1)
    for lo in range(0, len(a), step):
        part = a[lo : lo + step]
        at = np.searchsorted(b, part)
        at[at == len(b)] = 0
        hits += int((b[at] == part).sum())
        if hits >= need or hits + len(a) - lo - len(part) < need:
            break
    return hits >= need


def _verified(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[bytes, np.ndarray] = {}

        def body(packed_set: bytes) -> np.ndarray:
            x = read.get(packed_set)
            if x is None:
                if len(read) > 512:
                    read.clear()
                x = read[packed_set] = np.cumsum(unpacked(packed_set), dtype=np.uint64)
            return x

        for batch in batches:
            na, nb = (np.array(batch.column(c), np.int64) for c in ("na", "nb"))
            need = -(-num * (na + nb) // (num + den))
            found = [
                overlaps(body(x), body(y), t)
                for x, y, t in zip(batch.column("body_a").to_pylist(), batch.column("body_b").to_pylist(), need.tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(found, pa.bool_()))

    return run


def _fits(na: Column, nb: Column, marks_a: Column, marks_b: Column, num: int, den: int) -> Column:
    """Size and sketch of two sets allow them to be similar."""
    size = (F.least(na, nb) * den >= F.greatest(na, nb) * num)
    differing = sum((F.bit_count(marks_a[i].bitwiseXOR(marks_b[i])) for i in range(1, 8)), F.bit_count(marks_a[0].bitwiseXOR(marks_b[0])))
    return size & (differing * (num + den) <= (na + nb) * (den - num))


def _links(pairs: DataFrame, vertices: DataFrame, num: int, den: int) -> DataFrame:
    """The similar ones of distinct pairs a, b. A vertex in very many pairs (as b) is dealt over several tasks."""
    much = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > SALTED)
    much = F.broadcast(much.select("b", F.ceil(F.col("c") / SALTED).cast("int").alias("salts")))
    # all joins on v ask for the same columns of the vertices, so that these are dealt once
    one, other = (vertices.select(F.col("v").alias(x), F.col("n").alias(f"n{x}"), F.col("body").alias(f"body_{x}")) for x in "ab")
    few = pairs.join(much, "b", "left_anti").join(one, "a").join(other, "b")
    many = (
        pairs.join(much, "b")
        .withColumn("salt", F.pmod(F.xxhash64("a"), "salts").cast("int"))
        .drop("salts")
        .join(one, "a")
        .join(other.join(much, "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"), ["b", "salt"])
    )
    columns = ["a", "b", "na", "nb", "body_a", "body_b"]
    joined = few.select(columns).unionByName(many.select(columns))
    return written(joined.mapInArrow(memory.streamed(_verified(num, den)), "a binary, b binary"))


def _labels(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """v, label for every vertex."""
    found = labelled(links).select(F.col("node").alias("v"), "label")
    return written(vertices.select("v").join(found, "v", "left").select("v", F.coalesce("label", "v").alias("label")))


def _lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The short lists that span several components, with each member's present label."""
    now = lists.drop("label").join(labels, "v")
    open_keys = now.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    return written(now.join(open_keys, "key"))


def similar_links(vertices: DataFrame, num: int, den: int, every: bool = False) -> DataFrame:
    """a, b: similar vertices, every pair or enough of them to connect each component.

    vertices: v, n (shingles), body (packed shared shingles), prefix (short lists), marks (sketch).
    """
    lists = vertices.select(F.explode("prefix").alias("key"), "v", "n", F.col("v").alias("label"))
    shared = lists.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    lists = written(lists.join(shared, "key"))
    # most links: sets that share the least of their salted shingles meet in small groups
    buckets = vertices.select(F.posexplode("mins").alias("salt", "key"), "v", "n", "marks")
    sizes = buckets.groupBy("salt", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    buckets = buckets.join(sizes, ["salt", "key"]).withColumn("part", F.pmod(F.xxhash64("v", "salt"), F.ceil(F.col("c") / BUCKET)))
    others = buckets.select("salt", "key", "part", *[F.col(c).alias(f"_{c}") for c in ("v", "n", "marks")])
    near = buckets.join(others, ["salt", "key", "part"]).where(
        (F.col("v") > F.col("_v")) & _fits(F.col("n"), F.col("_n"), F.col("marks"), F.col("_marks"), num, den)
    )
    if not every:
        pairs = written(near.select(F.col("v").alias("a"), F.col("_v").alias("b")).distinct())
        links = _links(pairs, vertices, num, den)
        labels = _labels(vertices, links)
        before, lists = lists, _lists(lists, labels)
        for table in (pairs, labels, before):
            dropped(table)
        if lists.isEmpty():
            dropped(lists)
            return links
    # sketches join only the lists that are still open
    kept = lists
    lists = lists.join(vertices.select("v", "marks"), "v")
    # the members outside of a list's largest component meet all members of other components
    held = lists.drop("marks")
    members = held.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    main = members.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    left = lists if every else lists.join(main, "key").where(F.col("label") != F.col("main")).drop("main")
    right = lists.select("key", *[F.col(c).alias(f"_{c}") for c in ("v", "n", "marks", "label")])
    if not every:
        right = right.join(main, "key")
    met = left.join(right, "key").where(F.col("label") != F.col("_label")).where(
        _fits(F.col("n"), F.col("_n"), F.col("marks"), F.col("_marks"), num, den)
    )
    # two members that are both outside of the largest meet once
    met = met.where(F.col("v") < F.col("_v")) if every else met.where((F.col("_label") == F.col("main")) | (F.col("v") < F.col("_v")))
    pairs = written(met.select(F.greatest("v", "_v").alias("a"), F.least("v", "_v").alias("b")).distinct())
    found = _links(pairs, vertices, num, den)
    for table in (pairs, kept):
        dropped(table)
    if every:
        return found
    both = written(links.unionByName(found))
    for table in (links, found):
        dropped(table)
    return both


def grouped(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100, count_links: bool = False,
) -> DataFrame:
    """Per row: id, n (shingles), component (least id reachable by links). Similar: den * common >= num * union.

    count_links: links as well, the number of other distinct sets that are similar to the row's.
    """
    kind = docs.schema[key].dataType.simpleString()
    table = blocks(docs, key, text, UPPER, BLOCK_WORDS, stay=True)
    total = table.agg(F.sum("n")).first()[0] or 0
    slots = slots_of(total)
    bits = min(64, total.bit_length() + 6)
    counted = elsewhere(table, _features(size, bits), slots, bits)
    sets = written(
        table.select("block", "keys", "lengths", "vocabulary", "words")
        .groupBy("block")
        .cogroup(counted.groupBy("block"))
        .applyInArrow(
            memory.cogrouped(_sets(size, num, den, slots, bits)), f"id {kind}, n long, v binary, body binary, prefix array<bigint>, marks array<bigint>, mins array<bigint>"
        )
    )
    dropped(table)
    vertices = written(
        sets.where(F.col("body").isNotNull())
        .groupBy("v")
        .agg(*[F.first(c).alias(c) for c in ("n", "body", "prefix", "marks", "mins")])
    )
    links = similar_links(vertices, num, den, count_links)
    labels = _labels(vertices, links)
    dropped(vertices)
    per_vertex = written(sets.where(F.col("v").isNotNull()).groupBy("v").agg(F.min("id").alias("least")).join(labels, "v"))
    component = per_vertex.groupBy("label").agg(F.min("least").alias("component"))
    found = per_vertex.join(component, "label").select("v", "component")
    columns = ["id", "n", F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component")).alias("component")]
    if count_links:
        sides = links.select(F.col("a").alias("v")).unionByName(links.select(F.col("b").alias("v")))
        found = found.join(sides.groupBy("v").agg(F.count(F.lit(1)).alias("links")), "v", "left")
        columns.append(F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    out = written(sets.select("id", "n", "v").join(found, "v", "left").select(*columns))
    for table in (sets, links, labels, per_vertex):
        dropped(table)
    return out


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The row with the least id of each group, rows without an id last; of rows that share it, one.

    Rows without words are linked with nothing, so that each of them stays.
    """
    own = free_name(docs, "_group_row")
    rows = identified(docs, own)
    groups = grouped(rows, own, text, **options).select(F.col("id").alias("row"), "component")
    ids = rows.select(F.col(own).alias("row"), F.col(f"`{key}`").alias("id"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    first = ids.join(groups, "row").groupBy("component").agg(F.min(place).alias("first")).select(F.col("first.row").alias(own))
    return rows.join(first, own, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
