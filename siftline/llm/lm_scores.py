"""Stupid-backoff scores computed relationally, each document against all the others.

Texts become blocks of word numbers. Each block's distinct n-grams, with their counts there, are
dealt by hash into slots (the n-gram count tables, partitioned by hash); a slot adds up the counts of
all blocks and hands each block back how often its n-grams stand elsewhere. Joined to the block's
words, that gives the counts of every n-gram of every document, and a sum per document. So the
n-grams cross the network once, pre-aggregated, and a frequent one costs a slot one entry per
block, not one per document. Slots grow in number with the corpus, so that none outgrows a task.

Definition. c(g) is the number of times that g stands in the other documents (all documents less the
scored one) and N the number of words there. With h the words before w in its document, order - 1
at most, S(w | h) = c(h w) / c(h) if c(h w) > 0, else alpha * S(w | h without its first word); for an
empty h it is max(c(w), 1/2) / max(N, 1). The score of a document is the sum of ln S over its words.

Words are compared by 64-bit hashes, n-grams by hashes of so many bits (64 at most) that one meets
another by chance with a probability below 2 ** -30 while the corpus has less than 2 ** 34 n-grams.

Defined results: a null or wordless text has no tokens, score 0 and a null mean; the first words have
shorter histories; rows that repeat, or share an id, are scored each and count as documents each; of
a very long text the whole is scored, as a block of its own; no result depends on the order of rows,
so ties do not arise; an empty table gives an empty table; only key and text are used, so that
clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import memory
from siftline.llm.blocks import SLOT_WORDS, blocks, elsewhere, least_hash, places, unpacked, words_of
from siftline.llm.hashing import mix


def ngrams(words: np.ndarray, at: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Hash of the n-gram of that order that ends at each of the places."""
    out = np.empty(len(at), np.uint64)
    for lo in range(0, len(at), 1 << 18):  # in pieces, to save memory
        some = at[lo : lo + (1 << 18)]
        gram = np.full(len(some), order, np.uint64)
        for k in range(order - 1, -1, -1):
            gram = mix(gram ^ words[some - k], 41 + k)
        out[lo : lo + len(some)] = gram >> np.uint64(64 - bits)
    return out


def _features(order: int, bits: int):
    def of(row: dict) -> Iterator[np.ndarray]:
        words, lengths = words_of(row)
        inside = places(lengths)
        for n in range(1, order + 1):
            gram = ngrams(words, np.flatnonzero(inside >= n - 1), n, bits)
            gram.sort()
            yield gram

    return of


def _others(gram: np.ndarray, doc: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
    """How often each n-gram stands in other documents of the block or elsewhere. doc ascends."""
    order = np.argsort(gram, kind="stable")
    gram, doc = gram[order], doc[order]
    first = np.r_[len(gram) > 0, gram[1:] != gram[:-1]]
    here = np.diff(np.r_[np.flatnonzero(first), len(gram)])
    runs = np.flatnonzero(first | np.r_[False, doc[1:] != doc[:-1]])  # one n-gram in one document
    own = np.diff(np.r_[runs, len(gram)])
    found = np.empty(len(gram), np.int64)
    found[order] = np.repeat((elsewhere + here)[np.cumsum(first)[runs] - 1] - own, own)
    return found


def _scores(order: int, slots: int, bits: int, total: int, alpha: float):
    def run(blocks: pa.Table, counted: pa.Table) -> pa.Table:
        (row,) = blocks.select(["lengths", "vocabulary", "words"]).to_pylist()
        keys = blocks.column("keys").chunk(0).flatten()
        words, lengths = words_of(row)
        by_slot = dict(zip(counted.column("slot").to_pylist(), counted.column("counts").to_pylist(), strict=True))
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        inside = places(lengths)
        score = np.zeros(len(words))
        used = np.zeros(len(words), np.int8 if order < 128 else np.int32)
        before = np.maximum(total - lengths, 1)[doc]  # how often each word's history stands in other documents
        # ranges of slots, worked on one after the other to save memory
        ranges = [range(lo, min(lo + -(-slots // 16), slots)) for lo in range(0, slots, -(-slots // 16))]
        for n in range(1, order + 1):
            at = np.flatnonzero(inside >= n - 1)
            gram = ngrams(words, at, n, bits)
            count = np.zeros(len(words), np.int64)
            for some in ranges:
                counts = [unpacked(by_slot[k]).view(np.int64) for k in range((n - 1) * slots + some.start, (n - 1) * slots + some.stop) if k in by_slot]
                if counts:
                    mine = np.flatnonzero((gram >= np.uint64(least_hash(some.start, slots, bits))) & (gram <= np.uint64(least_hash(some.stop, slots, bits) - 1)))
                    count[at[mine]] = _others(gram[mine], doc[at[mine]], np.concatenate(counts))
            del gram
            better = at if n == 1 else at[count[at] > 0]
            score[better] = np.log((np.maximum(count, 0.5) if n == 1 else count)[better] / before[better])
            used[better] = n
            before = np.roll(count, 1)  # the n-gram that ends one word earlier
        del at, before, count
        off = np.minimum(inside + 1, order) - used
        score += off * np.log(alpha)
        summed = lambda x: np.bincount(doc, x, len(lengths))
        s = summed(score)
        return pa.table(
            [keys, pa.array(lengths), pa.array(summed(off > 0).astype(np.int64)), pa.array(s), pa.array(s / np.maximum(lengths, 1), mask=lengths == 0)],
            names=["key", "n_tokens", "n_backed_off", "log_score", "mean_log_score"],
        )

    return run


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = 0.4, order: int = 3) -> DataFrame:
    """key, n_tokens, n_backed_off (words whose longest history was not used), log_score (natural logs) and mean_log_score."""
    kind = docs.schema[key].dataType.simpleString()
    table = blocks(docs, key, text, stay=True)
    total = table.agg(F.sum("n")).first()[0] or 0
    slots = total // SLOT_WORDS + 1
    bits = min(64, (total * order).bit_length() + 30)
    counted = elsewhere(table, _features(order, bits), slots, bits)
    out = (
        table.select("block", "keys", "lengths", "vocabulary", "words")
        .groupBy("block")
        .cogroup(counted.groupBy("block"))
        .applyInArrow(
            memory.cogrouped(_scores(order, slots, bits, total, alpha)),
            f"key {kind}, n_tokens long, n_backed_off long, log_score double, mean_log_score double",
        )
    )
    return out.withColumnRenamed("key", key)
