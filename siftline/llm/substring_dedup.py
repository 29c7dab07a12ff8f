"""Substring dedup by seed and extend over winnowed anchors.

A window is `length` consecutive words. Its anchor is its least-hash k-gram (winnowing, leftmost on
ties), which depends on the window's words only, so equal windows have equal anchors. Successive
windows of a document that share an anchor form one occurrence of it.

Seed: occurrences are joined on the anchor's hash; anchors of one document drop out. Anchors that very
many documents hold are dealt over several tasks.
Extend: an occurrence carries a hash of the whole stretch that its windows cover, from as far left to as
far right of the anchor as windows with this anchor reach. Occurrences with equal stretches extend
alike: they are one class, whose smallest document covers the rest at once, without pairs. Where
an anchor has several classes, a match may end within the stretch: their first documents are extended
window by window to the left and right of the anchor, as far as a smaller document has the same window.
Stretches and windows that overlap make up the maximal repeats of at least `length` words.

Equality is decided on two independent 64-bit hashes (anchor and stretch or window).

Defined results: a null text has no words; texts shorter than a window lose nothing; rows with a
null id neither lose words nor make others lose any; rows with equal ids do not affect one another;
repeated rows each get the same result; a very long text is searched whole; of several smaller documents
with a window the smallest stands for all; an empty table gives an empty table; only the id, the text
and the result columns are used, so that clashing names do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import dropped, salted_join, written
from siftline.llm.hashing import Rolling, WordHashes, mix

#: Bases of the anchor, stretch and window hashes.
BASES = (0x8A5CD789635D2DFF, 0x121FD2155C472F97, 0xD6E8FEB86659FD93)


class Hashes:
    """The hashes of one document at a time."""

    def __init__(self, length: int):
        self.length, self.k = length, length // 2
        self.words = WordHashes()
        self.anchor, self.stretch, self.window = map(Rolling, BASES)

    def anchors(self, words: list[bytes]) -> tuple[np.ndarray, ...] | None:
        """Per occurrence: anchor hash, stretch hash, first window, number of windows."""
        n, k, w = len(words), self.k, self.length - self.k + 1
        if n < self.length:
            return None
        x = self.words.of(words)
        at = np.arange(n - k + 1)
        grams = mix(self.anchor.between(self.anchor.prefix(x), at, at + k))
        picks = np.empty(n - self.length + 1, np.int64)
        for lo in range(0, len(picks), 1 << 16):
            part = grams[lo : lo + (1 << 16) + w - 1]
            part = sliding_window_view(part, w)[: 1 << 16]
            picks[lo : lo + len(part)] = part.argmin(axis=1) + np.arange(lo, lo + len(part))
        first = np.flatnonzero(np.r_[True, picks[1:] != picks[:-1]])
        count = np.diff(np.r_[first, len(picks)])
        place = picks[first]
        whole = self.stretch.between(self.stretch.prefix(x), first, first + count + self.length - 1)
        shape = (count.astype(np.uint64) << np.uint64(32)) | (place - first).astype(np.uint64)
        return grams[place], mix(whole ^ mix(shape, 5), 1), first, count

    def windows(self, words: list[bytes], first: int, count: int) -> np.ndarray:
        """Window hashes of windows first .. first + count - 1."""
        x = self.words.of(words[first : first + count + self.length - 1])
        at = np.arange(count)
        return mix(self.window.between(self.window.prefix(x), at, at + self.length), 2)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def _find_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(length)
        for big in batches:
            for lo in range(0, big.num_rows, 512):
                batch = big.slice(lo, 512)
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                found, owner = [], []
                for i, t in enumerate(texts):
                    got = hashes.anchors((t or b"").split())
                    if got is not None:
                        found.append(got)
                        owner.append(np.full(len(got[0]), i))
                if not found:
                    continue
                h, sig, first, count = (np.concatenate(c) for c in zip(*found, strict=True))
                owner = pa.array(np.concatenate(owner))
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(h), _signed(sig), batch.column("id").take(owner), batch.column("doc").take(owner),
                        pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)),
                    ],
                    names=["h", "sig", "id", "doc", "first", "count"],
                )

    return run


def _find_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(length)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            ids, docs, runs = (batch.column(c) for c in ("id", "doc", "runs"))
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or b"").split()
                h, hit, at = [], [], []
                for r in runs[i].as_py():
                    w = hashes.windows(words, r["first"], r["count"])
                    hit.append(w)
                    h.append(np.full(len(w), r["h"], np.int64))
                    at.append(np.arange(r["first"], r["first"] + r["count"], dtype=np.int32))
                n = sum(map(len, hit))
                same = pa.array([0] * n, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(h)), _signed(np.concatenate(hit)), ids.slice(i, 1).take(same), docs.slice(i, 1).take(same), pa.array(np.concatenate(at))],
                    names=["h", "w", "id", "doc", "first"],
                )

    return run


def _apply(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                batch = big.slice(lo, 256)
                total, removed, kept = [], [], []
                for t, spans in zip(
                    batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True
                ):
                    words = (t or b"").split()
                    total.append(len(words))
                    left, at = [], 0
                    for first, stop in sorted((s["first"], s["stop"]) for s in spans or ()):
                        left += words[at:first] if first > at else []
                        at = max(at, stop)
                    left += words[at:]
                    removed.append(len(words) - len(left))
                    joined = b" ".join(left)
                    kept.append(joined.decode() if with_text else hashlib.sha256(joined).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    names=["id", "n_words", "n_removed", "kept"],
                )

    return run


def covered(rows: DataFrame, length: int) -> DataFrame:
    """doc, first, stop: stretches of words whose windows also start in a document with a smaller id.

    rows: id, doc (a hash of id and text), text.
    """
    kind = rows.schema["id"].dataType.simpleString()
    anchors = written(
        rows.where(F.col("id").isNotNull())
        .select("id", "doc", "text")
        .mapInArrow(_find_anchors(length), f"h long, sig long, id {kind}, doc long, first int, count int")
    )
    ends = anchors.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n"))
    shared = written(ends.where(F.col("least") < F.col("most")).select("h", "n"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    seeds = written(salted_join(anchors, shared.select("h"), ["h"], shared, total, "doc"))
    dropped(anchors)
    classes = written(seeds.groupBy("h", "sig").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    several = classes.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select("h")
    judged = written(
        salted_join(seeds, classes.drop("n"), ["h", "sig"], classes.select("h", "sig", "n"), total, "doc")
        .select("h", "sig", "id", "doc", "first", "count", "least")
    )
    for table in (shared, seeds):
        dropped(table)
    whole = judged.where(F.col("id") > F.col("least")).select(
        "id", "doc", "first", (F.col("first") + F.col("count") + length - 1).alias("stop")
    )
    heads = judged.where(F.col("id") == F.col("least"))
    several = several.join(heads.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "h")
    runs = (
        salted_join(heads, several.select("h"), ["h"], several, total, "doc")
        .groupBy("id", "doc")
        .agg(F.collect_set(F.struct("h", "first", "count")).alias("runs"))
    )
    windows = written(
        rows.join(runs, ["id", "doc"]).select("id", "doc", "text", "runs").mapInArrow(
            _find_windows(length), f"h long, w long, id {kind}, doc long, first int"
        )
    )
    least = written(windows.groupBy("h", "w").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    single = (
        salted_join(windows, least.drop("n"), ["h", "w"], least.select("h", "w", "n"), total, "doc")
        .where(F.col("id") > F.col("least"))
        .select("id", "doc", "first", (F.col("first") + length).alias("stop"))
    )
    return whole.unionByName(single)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """key, first, stop: the maximal stretches of words (stop exclusive) whose windows also start in smaller documents."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(key), F.col(text)).alias("doc"), F.col(text).alias("text"))
    spans = covered(rows, length).groupBy("id", "doc").agg(F.sort_array(F.collect_set(F.struct("first", "stop"))).alias("spans"))

    def extend(found, s):
        last = F.element_at(found, -1)
        longer = F.concat(
            F.slice(found, 1, F.size(found) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["stop"], s["stop"]).alias("stop")))
        )
        return F.when(F.size(found) == 0, F.array(s)).when(s["first"] < last["stop"], longer).otherwise(F.concat(found, F.array(s)))

    merged = F.aggregate("spans", F.array().cast("array<struct<first:int,stop:int>>"), extend)
    return spans.select(F.col("id").alias(key), F.inline(merged))


def deduped(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, with_text: bool = True
) -> DataFrame:
    """Per row: key, n_words, n_removed and kept, the words left joined by one space (or their SHA-256)."""
    rows = docs.select(
        F.col(key).alias("id"), F.xxhash64(F.col(key), F.col(text)).alias("doc"), F.col(text).alias("text")
    )
    spans = covered(rows, length).groupBy("id", "doc").agg(F.collect_set(F.struct("first", "stop")).alias("spans"))
    kind = docs.schema[key].dataType.simpleString()
    out = rows.join(spans, ["id", "doc"], "left").select("id", "text", "spans").mapInArrow(
        _apply(with_text), f"id {kind}, n_words long, n_removed long, kept string"
    )
    return out.withColumnRenamed("id", key)
