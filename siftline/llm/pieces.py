"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by piece score (ties: leftmost), merges
the best pair and adds the pairs that the merge makes, until no pair is a piece. Characters without
a piece become byte pieces. No merge crosses a place between two characters that stand beside each
other in no piece: texts are cut before word marks and chunks at such places, and each distinct
chunk is encoded once per worker. The agendas of a batch's new chunks run side by side, as rows of one
array; long chunks have a heap each. Every new chunk is checked against the sentencepiece library, in
batches; where the library should differ, its ids count. Ids are decoded by a table of piece bytes.

Defined results: a null text counts as an empty one, whose ids are begin and end; rows that repeat or
share an id are encoded each; a very long text is encoded whole, and one without a place to cut, in time
n log n of its length; equal scores go to the leftmost pair; an empty table gives an empty table; clashing
column names do no harm, as the result has the key column and the result columns only.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"


class Pieces:
    """The vocabulary, the agenda encoder and the table decoder of one model file."""

    #: Chunks of more symbols have an agenda of their own.
    LONG = 32

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes: list[bytes] = [b""] * sp.get_piece_size()
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                piece = sp.id_to_piece(i)
                self.ids[piece], self.score[piece] = i, sp.get_score(i)
                self.bytes[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self._tables()

    def _tables(self) -> None:
        """Symbols as numbers: pieces have their ids, other characters of pieces the numbers after them."""
        size = len(self.bytes)
        self.symbols = [""] * size
        for p, i in self.ids.items():
            self.symbols[i] = p
        number = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p}.difference(number)):
            number[c] = len(self.symbols)
            self.symbols.append(c)
        self.alien = len(self.symbols)  # a character of no piece
        codes = np.full(0x110000, self.alien, np.int32)
        for c, n in number.items():
            if len(c) == 1:
                codes[ord(c)] = n
        self.codes = codes
        # equal scores have equal ranks, so that the leftmost of them is merged first
        ranks = {s: n for n, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.none = len(ranks)
        halves = [(number[p[:k]], number[p[k:]], ranks[self.score[p]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        table = np.array(halves, np.int64).reshape(-1, 4)
        key = table[:, 0] << 32 | table[:, 1]
        by_key = np.argsort(key)
        # a guard of no pair at the end, so that every search stays inside
        self.pair_keys = np.r_[key[by_key], np.iinfo(np.int64).max]
        self.pair_rank = np.r_[table[by_key, 2], self.none].astype(np.int32)
        self.pair_made = np.r_[table[by_key, 3], 0].astype(np.int32)

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (`none` if it is no piece) and the piece that it makes."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], self.none), self.pair_made[at]

    def parts(self, chunk: str) -> list[str]:
        """chunk cut between characters that stand beside each other in no piece."""
        out, at = [], 0
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in self.beside:
                out.append(chunk[at:i])
                at = i
        out.append(chunk[at:])
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a normalised text (word marks for spaces, the leading mark added), by the agenda."""
        return np.frombuffer(self.encode_all([text])[0], "<u4").tolist()

    def encode_all(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, as bytes."""
        out: list[bytes] = [b""] * len(chunks)
        short: dict[int, list[int]] = {}  # by length, rounded up
        for n, c in enumerate(chunks):
            if len(c) > self.LONG:
                out[n] = self._bytes_of(self.merged(list(c)))
            elif c:
                short.setdefault(-(-len(c) // 4) * 4, []).append(n)
        for width, places in short.items():
            some = [chunks[n] for n in places]
            grid, alien = self._merged_together(some, width)
            for n, c, ids, odd in zip(places, some, grid, alien, strict=True):
                out[n] = self._bytes_of(self.merged(list(c))) if odd else ids
        return out

    def _bytes_of(self, symbols: list[str]) -> bytes:
        ids: list[int] = []
        for symbol in symbols:
            i = self.ids.get(symbol)
            ids += [i] if i is not None else [self.byte_ids[b] for b in symbol.encode()]
        return np.array(ids, "<u4").tobytes()

    def _merged_together(self, chunks: list[str], width: int) -> tuple[list[bytes], list[bool]]:
        """The agendas of many short chunks as rows of one array: each step merges every row's best pair.

        Returns ids, and whether a symbol has none (its ids are then no result).
        """
        text = np.array(chunks, f"<U{width}").view("<u4").reshape(len(chunks), width)
        length = np.array([len(c) for c in chunks])
        symbol = np.where(np.arange(width) < length[:, None], self.codes[text], -1)  # -1: no symbol here
        rank, made = self._looked_up(symbol[:, :-1], symbol[:, 1:]) if width > 1 else (symbol[:, :0], symbol[:, :0])
        rows = np.arange(len(chunks))
        column = np.arange(width)
        while len(rows) and rank.shape[1]:
            best = rank[rows].argmin(axis=1)
            going = rank[rows, best] < self.none
            rows, best = rows[going], best[going]
            if not len(rows):
                break
            new = made[rows, best]
            # what lies right of the merge moves one place to the left
            step = np.minimum(column[None, :] + (column[None, :] > best[:, None]), width - 1)
            moved = np.take_along_axis(symbol[rows], step, 1)
            moved[:, -1] = -1
            here = np.arange(len(rows))
            moved[here, best] = new
            symbol[rows] = moved
            gap = np.minimum(column[None, : width - 1] + (column[None, : width - 1] >= best[:, None]), width - 2)
            ranks, pieces = np.take_along_axis(rank[rows], gap, 1), np.take_along_axis(made[rows], gap, 1)
            ranks[:, -1] = self.none
            right = best < width - 1  # the pairs beside the merge
            r, m = self._looked_up(moved[here[right], best[right]], moved[here[right], best[right] + 1])
            ranks[here[right], best[right]], pieces[here[right], best[right]] = r, m
            left = best > 0
            r, m = self._looked_up(moved[here[left], best[left] - 1], moved[here[left], best[left]])
            ranks[here[left], best[left] - 1], pieces[here[left], best[left] - 1] = r, m
            rank[rows], made[rows] = ranks, pieces
        count = (symbol >= 0).sum(axis=1)
        flat = symbol[symbol >= 0].astype("<u4").tobytes()
        ends = (4 * np.cumsum(count)).tolist()
        ids = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return ids, (symbol >= len(self.bytes)).any(axis=1).tolist()

    def decoded(self, ids: bytes) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def merged(self, symbols: list[str]) -> list[str]:
        """The agenda as a heap over linked symbols, for long chunks."""
        n = len(symbols)
        score = self.score
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            s = score.get(pair)
            if s is not None:
                agenda.append((-s, i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or right[i] != j or len(symbols[i]) + len(symbols[j]) != len(pair):
                continue
            symbols[i], symbols[j] = pair, ""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                after = pair + symbols[k]
                if (s := score.get(after)) is not None:
                    heapq.heappush(agenda, (-s, i, k, after))
            if (h := left[i]) >= 0:
                before = symbols[h] + pair
                if (s := score.get(before)) is not None:
                    heapq.heappush(agenda, (-s, h, i, before))
        return [x for x in symbols if x]


class Chunks(dict):
    """chunk -> ids as bytes, checked against the library when filled.

    odd: chunks that do not decode to themselves, and the bytes that they decode to. parts: the ids of
    the parts that chunks are cut into. Bounded: a full table becomes the old one, from which chunks
    that come again are taken over.
    """

    LIMIT = 400_000

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self.differing = 0
        self.old: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def make_room(self) -> None:
        if len(self) > self.LIMIT:
            self.old = dict(self)
            self.clear()
            self.odd = {c: t for c, t in self.odd.items() if c in self.old}
        if len(self.parts) > self.LIMIT:
            self.parts.clear()

    def fill(self, chunks: set[str]) -> None:
        if self.old:
            known = chunks & self.old.keys()
            self.update((c, self.old[c]) for c in known)
            chunks = chunks - known
        new = list(chunks)
        for k in range(0, len(new), 8192):
            self._encode(new[k : k + 8192])

    def _encode(self, chunks: list[str]) -> None:
        cut = [self.pieces.parts(c) for c in chunks]
        new = list(set().union(*cut).difference(self.parts))
        self.parts.update(zip(new, self.pieces.encode_all(new), strict=True))
        part = self.parts
        own = [part[p[0]] if len(p) == 1 else b"".join([part[x] for x in p]) for p in cut]
        # the library adds the first mark itself; a mark alone is no text to it, and it then adds none
        theirs = self.pieces.library.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1)
        flat = np.fromiter(itertools.chain.from_iterable(theirs), "<u4").tobytes()
        if flat != b"".join(x for c, x in zip(chunks, own, strict=True) if c != MARK):
            for n, (c, ids) in enumerate(zip(chunks, theirs, strict=True)):
                ids = np.array(ids, "<u4").tobytes()
                if c != MARK and own[n] != ids:
                    own[n] = ids
                    self.differing += 1
        self.update(zip(chunks, own, strict=True))
        decoded = self.pieces.decoded(b"".join(own))
        if decoded != "".join(chunks).replace(MARK, " ").encode():
            for c, ids in zip(chunks, own, strict=True):
                if (text := self.pieces.decoded(ids)) != c.replace(MARK, " ").encode():
                    self.odd[c] = text


@functools.lru_cache(maxsize=1)
def known_chunks(model_file: str) -> Chunks:
    """The table of this worker process, which its next tasks go on with."""
    return Chunks(Pieces(model_file))


def encoder(model_file: str, key: str, text: str):
    cut = re.compile(f"{MARK}+[^{MARK}]*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_chunks(model_file)
        pieces = known.pieces
        begin, end = (np.array([i], "<u4").tobytes() for i in (pieces.bos, pieces.eos))
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                batch = big.slice(lo, 256)
                known.make_room()
                marked = [(MARK + t.replace(" ", MARK)) if t else "" for t in batch.column(text).to_pylist()]
                rows = [cut.findall(t) if pieces.cuts else [t] if t else [] for t in marked]
                new = set().union(*rows).difference(known)
                if new:
                    known.fill(new)
                counts, id_hashes, text_hashes = [], [], []
                for whole, row in zip(marked, rows, strict=True):
                    ids = begin + b"".join(map(known.__getitem__, row)) + end
                    if known.odd and not known.odd.keys().isdisjoint(row):
                        decoded = b"".join(known.odd.get(c) or c.replace(MARK, " ").encode() for c in row)
                    else:
                        decoded = whole.replace(MARK, " ").encode()
                    counts.append(len(ids) // 4)
                    id_hashes.append(hashlib.sha256(ids).hexdigest())
                    # the first mark stands for no character
                    text_hashes.append(hashlib.sha256(decoded[1:]).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key),
                        pa.array(counts, pa.int64()),
                        pa.array(id_hashes, pa.string()),
                        pa.array(text_hashes, pa.string()),
                        pa.array([known.differing] * len(rows), pa.int64()),
                    ],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "differing"],
                )

    return run


def digests(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: number of ids (with begin and end), digests of ids and of the decoded text.

    differing: chunks so far in this worker that the library encodes otherwise, and whose ids are then
    the library's; 0 unless a model needs rules that the agenda does not know.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(
        encoder(model_file, key, text),
        f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, differing long",
    )


def encoded(texts: Iterator[str | None], model_file: str) -> Iterator[tuple[list[int], str]]:
    """ids and decoded text of each text, on the driver or inside a UDF."""
    pieces = Pieces(model_file)
    cut = re.compile(f"{MARK}+[^{MARK}]*")
    for value in texts:
        value = (MARK + value.replace(" ", MARK)) if value else ""
        ids = [pieces.bos]
        for chunk in cut.findall(value) if pieces.cuts else [value] if value else []:
            ids += pieces.encode(chunk)
        ids.append(pieces.eos)
        yield ids, pieces.library.decode(ids)
