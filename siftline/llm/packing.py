"""Best-fit packing by minimum bin slack.

Documents become token ids once, in Arrow batches, and pieces of at most `room` tokens. Only the
number of pieces of each length (at most `room` counts, whatever the input's size) reaches the
driver. There, per bin, a bitset subset-sum dynamic program over the lengths still available finds
the fullest combination with the longest remaining piece; it is removed as often as the counts
allow, so that the plan's size is bounded by the lengths, not by the documents. Pieces are then
numbered within their length without gathering a length in one task, and the plan, an array of
rank intervals per length, gives each its sequence and offset.

Defined results: a null text counts as an empty one (just the end id); rows that repeat, or share an
id, are packed each; a very long text is encoded whole and cut into pieces; pieces of equal length are
interchangeable, and which of them goes where is not defined; an empty table gives an empty table; clashing column names do no harm, as the result has the
key column and the result columns only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm import memory
from siftline.llm.common import written
from siftline.llm.hashing import FlatHashes, flat

#: Pieces for each of which there is a rank group: pieces of a length are numbered within a group, then groups are laid end to end.
GROUP_PIECES = 100_000


#: Bytes by class: 0 white space, 1 ASCII letter, 2 stop, 3 all else.
CLASSES = np.full(256, 3, np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32]] = 0
CLASSES[[*range(65, 91), *range(97, 123)]] = 1
CLASSES[[ord(c) for c in ".,;:!?"]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in texts laid end to end.

    Words end at white space, and where a stop follows a letter: the vocabulary has letters and stops in
    separate words and drops white space, so that such words can be encoded apart.
    """
    kind = CLASSES[data]
    new = np.zeros(len(data) + 1, bool)  # a text begins here, or all end
    new[offsets] = True
    after = np.r_[np.uint8(0), kind[:-1]]
    cut = new[:-1] | ((after == 1) & (kind == 2))
    starts = np.flatnonzero((kind > 0) & (cut | (after == 0)))
    cut = np.r_[cut[1:], True]
    before = np.r_[kind[1:], np.uint8(0)]
    return starts, np.flatnonzero((kind > 0) & (cut | (before == 0))) + 1


class WordIds:
    """Words -> ids, in arrays: word hashes ascend, with the place and number of their ids in a pool.

    A full table is dropped, so that its size is bounded.
    """

    LIMIT = 600_000
    #: Stands between words that are encoded together; a special token, which no other text gives.
    MARK = "<|endoftext|>"

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.mark_id = self.tokenizer.token_to_id(self.MARK)
        pieces = self.tokenizer.get_vocab()
        #: ids that end a word
        self.ends = np.zeros(max(pieces.values()) + 1, bool)
        self.ends[[i for p, i in pieces.items() if p.endswith("</w>")]] = True
        self.word_hashes = FlatHashes()
        self.clear()

    def clear(self) -> None:
        self.hashes = np.empty(0, np.uint64)
        self.place = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)
        self.pool = np.empty(0, "<u4")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, and where each text's ids begin (and the last's end)."""
        if b"<|" not in data.tobytes():  # special tokens are told by their case
            data = LOWER[data]
        starts, ends = cut_words(data, offsets)
        distinct, example, word = np.unique(self.word_hashes.of(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > self.LIMIT:
            self.clear()
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[at] != distinct) if len(self.hashes) else np.arange(len(distinct))
        if len(new):
            self._add(distinct[new], data, starts[example[new]], ends[example[new]])
            at = np.searchsorted(self.hashes, distinct)
        count, place = self.count[at][word], self.place[at][word]
        upto = np.r_[0, np.cumsum(count)]
        ids = self.pool[np.repeat(place - upto[:-1], count) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, offsets)]

    def _add(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        kind = CLASSES[data]
        others = np.r_[0, np.cumsum(kind != 1)]
        plain = np.flatnonzero(others[ends] == others[starts])  # letters only: one word each
        text = data.tobytes()
        word = lambda i: text[starts[i] : ends[i]].decode()
        found: list[np.ndarray] = []
        order: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        rest = [np.flatnonzero(others[ends] != others[starts])]
        for k in range(0, len(plain), 500):
            part = plain[k : k + 500]
            ids = self._ids(" ".join([text[a:b].decode() for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]))
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(part):  # a word ended elsewhere than expected
                rest.append(part)
                continue
            found.append(ids)
            order.append(part)
            counts.append(np.diff(np.r_[0, last]))
        odd = np.concatenate(rest)
        for k in range(0, len(odd), 2000):
            part = odd[k : k + 2000]
            words = [word(i) for i in part.tolist()]
            if self.mark_id is None or any(self.MARK in w for w in words):
                each = [self._ids(w) for w in words]
            else:
                ids = self._ids(self.MARK.join(words))
                each = [x[:-1] if n < len(part) - 1 else x for n, x in enumerate(np.split(ids, np.flatnonzero(ids == self.mark_id) + 1))]
            found += each
            order.append(part)
            counts.append(np.array([len(x) for x in each]))
        count = np.concatenate(counts)
        place = len(self.pool) + np.cumsum(count) - count
        self.pool = np.concatenate([self.pool, *found])
        hashes = np.concatenate([self.hashes, hashes[np.concatenate(order)]])
        by_hash = np.argsort(hashes, kind="stable")
        self.hashes = hashes[by_hash]
        self.place = np.concatenate([self.place, place])[by_hash]
        self.count = np.concatenate([self.count, count])[by_hash]


def cutter(tokenizer_file: str, key: str, text: str, room: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = WordIds(tokenizer_file)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * room
        for big in batches:
            for lo in range(0, big.num_rows, 512):
                batch = big.slice(lo, 512)
                ids, begin = known.encoded(*flat(batch.column(text)))
                ids_of, begin = ids.tobytes(), (4 * begin).tolist()
                source, piece, start, length, crc = [], [], [], [], []
                for i in range(batch.num_rows):
                    ids = ids_of[begin[i] : begin[i + 1]] + end
                    for n, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        source.append(i)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key).take(pa.array(source, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=[key, "piece", "start", "length", "ids_crc32"],
                )

    return run


def pieces(docs: DataFrame, tokenizer_file: str, room: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(
        memory.streamed(cutter(tokenizer_file, key, text, room, end_id)),
        f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long",
    )


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The combination of available lengths that holds the longest piece and leaves least slack.

    lengths: available ones, longest first. Bit s of the set: some choice sums to s. The sets before
    each length are kept, and the choice is read back from the fullest sum.
    """
    first = lengths[0]
    free = room - first
    mask = (1 << (free + 1)) - 1
    full = 1 << free
    sums, trail = 1, []
    for size in lengths:
        many = counts[size] - (size == first)
        if size > free or many <= 0:
            continue
        before, left, step = sums, min(many, free // size), 1
        while left > 0:
            take = min(step, left)
            sums |= (sums << (size * take)) & mask
            left -= take
            step *= 2
        trail.append((size, before, min(many, free // size)))
        if sums & full:
            break
    at = sums.bit_length() - 1
    chosen = {first: 1}
    for size, before, most in reversed(trail):
        used = 0
        while not before >> at & 1:
            used += 1
            at -= size
            assert used <= most
        if used:
            chosen[size] = chosen.get(size, 0) + used
    return sorted(chosen.items(), reverse=True)


def plan(histogram: dict[int, int], room: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rank intervals (length, first rank, past the last, per bin, first sequence, offset in the bin), and the bins."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    lengths = sorted(counts, reverse=True)
    ranks = dict.fromkeys(lengths, 0)
    entries, bins = [], 0
    while lengths:
        chosen = fullest(lengths, counts, room)
        times = min(counts[size] // used for size, used in chosen)
        offset = 0
        for size, used in chosen:
            entries.append((size, ranks[size], ranks[size] + used * times, used, bins, offset))
            ranks[size] += used * times
            counts[size] -= used * times
            offset += size * used
        bins += times
        lengths = [x for x in lengths if counts[x]] if any(not counts[s] for s, _ in chosen) else lengths
    return entries, bins


def placer(entries: list[tuple], names: list[str]):
    table = np.array(sorted(entries), dtype=np.int64).reshape(-1, 6)
    span = int(table[:, 2].max()) + 1 if len(table) else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one sorted key for (length, rank): lengths are few, so that the key stays within 64 bits
        starts = table[:, 0] * span + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(starts, length * span + rank, side="right") - 1]
            inside = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n) for n in names],
                    pa.array(row[:, 4] + inside // row[:, 3]),
                    pa.array(row[:, 5] + inside % row[:, 3] * length),
                ],
                names=[*names, "sequence_id", "offset"],
            )

    return run


def packed(docs: DataFrame, tokenizer_file: str, room: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece with its sequence_id and its offset there; offsets of a sequence leave no gap."""
    names = [key, "piece", "start", "length", "ids_crc32"]
    cut = pieces(docs, tokenizer_file, room, end_id, key, text)
    cut = written(cut)
    groups = max(16, cut.count() // GROUP_PIECES)
    cut = cut.withColumn("grp", F.pmod(F.xxhash64(*names), F.lit(groups)).cast("int"))
    counted = cut.groupBy("length", "grp").agg(F.count(F.lit(1)).alias("n"))
    counted = written(counted)  # at most room * groups rows
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    entries, _ = plan(histogram, room)
    before = Window.partitionBy("length").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("length", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "grp").orderBy(*names)
    ranked = (
        cut.withColumn("own", F.row_number().over(own))
        .join(base, ["length", "grp"])
        .select(*names, (F.col("base") + F.col("own") - 1).alias("rank"))
    )
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.select(*names).schema)
    return ranked.mapInArrow(memory.streamed(placer(entries, names)), f"{kinds}, sequence_id long, offset long")
