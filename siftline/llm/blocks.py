"""Blocks of texts as word numbers, and counts of hashed features over all blocks.

A block holds the words of many texts in little space. Features of words (n-grams, shingles) are made
per block, dealt by hash into slots, one packed row per block and slot, and counted there; each
block gets back how often its features stand elsewhere. Slots grow in number with the corpus.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import memory
from siftline.llm.common import bucketed, written
from siftline.llm.hashing import FlatHashes, flat, spaced

#: Words and rows of a block, and n-grams of each order for which there is a slot, at least about.
BLOCK_WORDS = 2_200_000
BLOCK_ROWS = 16_384
SLOT_WORDS = 1 << 20
#: A block's most frequent words, which have its smallest numbers; the others are numbered by hash.
FREQUENT = 1 << 12


def packed(x: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes: planes of zeros cost nothing."""
    x = np.ascontiguousarray(x, "<u8")
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<BQ", width, len(x)) + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if width else b"")


def unpacked(b: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", b)
    out = np.zeros((n, 8), np.uint8)
    if width and n:
        raw = pa.decompress(b[9:], decompressed_size=width * n, codec="zstd", asbytes=True)
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def rising(x: np.ndarray) -> bytes:
    """Ascending unsigned numbers as Rice codes of their differences: evenly spread ones take their entropy, also if they are few."""
    gaps = np.diff(np.ascontiguousarray(x, "<u8"), prepend=np.uint64(0))
    low = max(0, (int(x[-1]) // len(x)).bit_length() - 1) if len(x) else 0
    whole, rest = divmod(low, 8)
    planes = gaps.view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(planes[:, whole : whole + 1], axis=1, count=rest, bitorder="little") if rest else planes[:, :0]
    stops = np.cumsum((gaps >> np.uint64(low)).astype(np.int64) + 1) - 1  # at most 3 n bits, by the choice of low
    high = np.zeros(int(stops[-1]) + 1 if len(x) else 0, np.uint8)
    high[stops] = 1
    return struct.pack("<BI", low, len(x)) + planes[:, :whole].tobytes() + np.packbits(bits.ravel()).tobytes() + np.packbits(high).tobytes()


def risen(b: bytes) -> np.ndarray:
    low, n = struct.unpack_from("<BI", b)
    whole, rest = divmod(low, 8)
    raw = np.frombuffer(b, np.uint8, offset=5)
    to = n * whole
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :whole] = raw[:to].reshape(n, whole)
    if rest:
        bits = np.unpackbits(raw[to:], count=n * rest).reshape(n, rest)
        planes[:, whole] = np.packbits(bits, axis=1, bitorder="little").ravel()
        to += -(-n * rest // 8)
    high = np.diff(np.flatnonzero(np.unpackbits(raw[to:])), prepend=-1) - 1
    return np.cumsum(planes.view("<u8").ravel() | (high.astype(np.uint64) << np.uint64(low)), dtype=np.uint64)


def places(lengths: np.ndarray) -> np.ndarray:
    """Each word's place in its text."""
    return (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys, bytes and offsets of rows that together have at most so many bytes, or of one row."""
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
            hi = min(max(hi, lo + 1), lo + BLOCK_ROWS, batch.num_rows)
            yield batch.column("key").slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


def _blocks(batches: Iterator[pa.RecordBatch], fold: bytes | None, most: int) -> Iterator[pa.RecordBatch]:
    hashes = FlatHashes()
    table = np.frombuffer(fold, np.uint8) if fold else None
    first = TaskContext.get().partitionId() << 32
    count, held, keys, words, lengths = 0, 0, [], [], []

    def block() -> pa.RecordBatch:
        rows, n = pa.concat_arrays(keys), np.concatenate(lengths)
        x = np.concatenate(words)
        for part in (keys, words, lengths):
            part.clear()
        vocabulary, number, times = np.unique(x, return_inverse=True, return_counts=True)
        total = len(x)
        del x
        by_count = np.argsort(-times, kind="stable")  # small numbers pack well, and so do ascending hashes
        by_count[FREQUENT:].sort()
        rank = np.empty(len(times), np.uint32)
        rank[by_count] = np.arange(len(times), dtype=np.uint32)
        number = rank[number]
        ordered = vocabulary[by_count]
        ordered[FREQUENT + 1 :] -= ordered[FREQUENT:-1].copy()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([first + count], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                pa.array([total], pa.int64()),
                *(pa.array([packed(p)], pa.binary()) for p in (n, ordered, number)),
            ],
            names=["block", "keys", "n", "lengths", "vocabulary", "words"],
        )

    for some, data, offsets in _slices(batches, 1 << 20):
        if table is not None:
            data = table[data]
        starts, ends = spaced(data, offsets)
        if keys and (held + len(starts) > most or sum(map(len, keys)) + len(some) > BLOCK_ROWS):
            yield block()
            count, held = count + 1, 0
        keys.append(some)
        words.append(hashes.of(data, starts, ends))
        lengths.append(np.diff(np.searchsorted(starts, offsets)))
        held += len(starts)
    if keys:
        yield block()


def words_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and words per row."""
    vocabulary = unpacked(row["vocabulary"])
    np.cumsum(vocabulary[FREQUENT:], out=vocabulary[FREQUENT:])
    return vocabulary[unpacked(row["words"]).view(np.int64)], unpacked(row["lengths"]).view(np.int64)


def blocks(docs: DataFrame, key: str, text: str, fold: bytes | None = None, most: int = BLOCK_WORDS, stay: bool = False) -> DataFrame:
    """Blocks of rows: keys, n (words), words per row, hashes of the distinct words, and each word's number there.

    fold: a translation of the text's bytes; most: words of a block of several texts. The table is written, as
    blocks are told apart by where they were made; stay: in buckets, so that they need not move to meet their counts
    (less disk, more files).
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = f"block long, keys array<{kind}>, n long, lengths binary, vocabulary binary, words binary"
    made = rows.mapInArrow(memory.streamed(lambda batches: _blocks(batches, fold, most)), schema)
    return bucketed(made, "block") if stay else written(made)


def least_hash(slot: int, slots: int, bits: int) -> int:
    return -(-(slot << bits) // slots)


def dealt(features: Callable[[dict], Iterator[np.ndarray]], slots: int, bits: int):
    """block, slot, its features there (ascending hashes, from the slot's least on) and their counts in the block, less 1.

    features: from a block, per order an ascending array of hashes of so many bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([least_hash(k, slots, bits) for k in range(1, slots)], np.uint64)  # least hash of each slot but the first
        for batch in batches:
            for row in batch.to_pylist():
                for n, found in enumerate(features(row)):
                    new = np.flatnonzero(np.r_[len(found) > 0, found[1:] != found[:-1]])
                    count = np.diff(np.r_[new, len(found)])
                    found = found[new]
                    cut = np.r_[0, np.searchsorted(found, bounds), len(found)]
                    parts = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
                    for lo in range(0, len(parts), 512):
                        some = parts[lo : lo + 512]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([row["block"]] * len(some), pa.int64()),
                                pa.array([n * slots + k for k, _ in some], pa.int64()),
                                pa.array([rising(found[s] - np.uint64(least_hash(k, slots, bits))) for k, s in some], pa.binary()),
                                pa.array([packed(count[s] - 1) for _, s in some], pa.binary()),
                            ],
                            names=["block", "slot", "hashes", "counts"],
                        )

    return run


def _elsewhere(table: pa.Table) -> pa.Table:
    """How often each block's features of the slot stand in other blocks."""
    hashes = [risen(g.as_py()) for g in table.column("hashes")]
    own = np.concatenate([unpacked(c.as_py()).view(np.int64) for c in table.column("counts")]) + 1
    distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(place, own, len(distinct)).astype(np.int64)
    other = np.split(total[place] - own, np.cumsum([len(g) for g in hashes])[:-1])
    return pa.table(
        [table.column("block"), table.column("slot"), pa.array([packed(x) for x in other], pa.binary())],
        names=["block", "slot", "counts"],
    )


def elsewhere(table: DataFrame, features: Callable[[dict], Iterator[np.ndarray]], slots: int, bits: int) -> DataFrame:
    """block, slot (order * slots + slot), counts: how often each of the block's features there, by hash, stands in other blocks."""
    rows = table.select("block", "lengths", "vocabulary", "words").mapInArrow(
        memory.streamed(dealt(features, slots, bits)), "block long, slot long, hashes binary, counts binary"
    )
    return rows.groupBy("slot").applyInArrow(memory.grouped(_elsewhere), "block long, slot long, counts binary")
