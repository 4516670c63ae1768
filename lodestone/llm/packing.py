"""Sum-of-squares online packing into windows of a fixed number of tokens.

A document's ids are cut into whole windows; what is left over is placed, one
document after the other, by the sum-of-squares rule: of all fill levels at
which the piece fits, and a fresh window, take the one that makes the sum of
squared counts of partially filled windows least (ties: the fullest window).
The counts stand in an array by level. A level is GRAIN tokens wide, so as few
windows stay open as there are levels; a window with less than that left is
closed.

When a packer's rows end, its open windows stay as they are, the fullest first,
while what they leave empty is at most PADDING of the packer's tokens. Only the
others, the emptiest, are emptied into each other in order, cutting pieces where
a window fills up. So padding is at most that share, less than GRAIN tokens for
each window closed before, and one window for each packer; and the longer a
packer runs, the smaller is the share of pieces that the rule did not place.

A packer is a partition of the input, read once, in its order: no shuffle, and
memory for the open windows and one Arrow batch only. A partition that is run
again packs the same way, and its number is part of the sequence number, so
sequences of different packers never meet. A table in very many tiny partitions
should be coalesced first.

Ids are those of byte_bpe_50k.json without special tokens added: an added token
that stands in a text is its one id. Null and empty texts consist of the end id
alone. Texts of any length are cut, never shortened. Null ids are kept. Repeated
rows are packed each on its own. An empty table gives no rows. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import prepare

WINDOW = 1024
#: Tokens of a fill level, and the share of a packer's tokens that its open windows may leave empty.
GRAIN = 16
PADDING = 0.005
#: Of byte_bpe_50k.json: matched in texts before anything else, blanks around it stay.
ADDED = {"<|endoftext|>": 50256}
END = 0
SEQUENCES_PER_PARTITION = 1 << 40
#: The vocabulary's pattern; SIMPLE differs from it only on runs of two or more blanks, and needs no look-ahead.
SIMPLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(ranks_path: str):
    """text -> list of ids of the byte-level BPE whose ranks are given; the ids of byte_bpe_50k.json."""
    import public_tokenizers
    import regex
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    simple = tiktoken.Encoding("simple", pat_str=SIMPLE, mergeable_ranks=ranks, special_tokens={})
    exact = tiktoken.Encoding("exact", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    blanks = regex.compile(r"\s\s")
    added = regex.compile("(" + "|".join(map(regex.escape, ADDED)) + ")")
    plain = lambda text: (exact if blanks.search(text) else simple).encode_ordinary(text)

    def encode(text: str) -> list[int]:
        if not any(a in text for a in ADDED):
            return plain(text)
        return [i for part in added.split(text) for i in ([ADDED[part]] if part in ADDED else plain(part))]

    return encode


class Packer:
    """Places pieces of at most a window; windows are numbered from 0 in the order of their opening."""

    def __init__(self, window: int = WINDOW, grain: int = GRAIN):
        self.window, self.grain = window, grain
        levels = -(-window // grain)
        self.count = np.zeros(levels + 1, np.int64)  # partially filled windows by level; the last stays 0
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(levels)]  # (fill, number), the fullest last
        self.fullest = np.zeros(levels, np.int64)
        self.pieces: dict[int, list[tuple]] = {}  # of open windows: (length, what)
        self.next = self.tokens = self.drained = 0

    def fresh(self) -> int:
        self.next += 1
        self.tokens += self.window
        return self.next - 1

    def level(self, fill):
        """The level of windows so full; the last one where less than a grain is left."""
        return np.where(self.window - fill < self.grain, len(self.open), fill // self.grain)

    def place(self, length: int, what) -> list[tuple[int, int, int, object]]:
        """Closed placements (window, offset, length, what): those of a window that this piece closes."""
        n, room = self.count, self.window - length
        fills, at_room = self.fullest, min(room // self.grain, len(self.open) - 1)
        fits = np.flatnonzero(n[: at_room + 1])
        fills = fills[fits]
        if len(fits) and fits[-1] == at_room:  # of that level, some windows may be too full
            fills[-1] = max((f for f, _ in self.open[at_room] if f <= room), default=-1)
            fits, fills = (fits, fills) if fills[-1] >= 0 else (fits[:-1], fills[:-1])
        # moving a window from level h to g changes the squares by 2 (N[g] - N[h]) + 2, within a level by nothing;
        # a fresh window adds 2 N[g] + 1; a closed one leaves the array
        fills = np.append(0, fills)
        to = self.level(fills + length)
        change = np.where(to == len(self.open), 0, 2 * n[to] + 1)
        change[1:] += np.where(to[1:] == fits, -change[1:], 1 - 2 * n[fits])
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        if best:
            h, fill = int(fits[best - 1]), int(fills[best])
            i = next(i for i in range(len(self.open[h]) - 1, -1, -1) if self.open[h][i][0] == fill)
            _, at = self.open[h].pop(i)
            self.counted(h)
        else:
            at, fill = self.fresh(), 0
            self.tokens -= self.window
            self.pieces[at] = []
        self.tokens += length
        self.pieces[at].append((length, what))
        g = int(to[best])
        if g == len(self.open):
            return self.laid(at)
        self.open[g].append((fill + length, at))
        self.open[g].sort()
        self.counted(g)
        return []

    def counted(self, level: int) -> None:
        self.count[level] = len(self.open[level])
        self.fullest[level] = self.open[level][-1][0] if self.open[level] else 0

    def laid(self, at: int) -> list[tuple[int, int, int, object]]:
        out, offset = [], 0
        for length, what in self.pieces.pop(at):
            out.append((at, offset, length, what))
            offset += length
        return out

    def finish(self, cut, padding: float = PADDING) -> Iterator[tuple[int, int, int, object]]:
        """Placements of the open windows; cut(what, a, b) is the part of a piece. ``drained`` counts the pieces laid anew."""
        empty, most, rest = 0, padding * self.tokens, []
        for fill, number in sorted((w for level in self.open for w in level), key=lambda w: (-w[0], w[1])):
            empty += self.window - fill
            if empty <= most:
                yield from self.laid(number)
            else:
                rest.append(number)
        pieces = [p for number in sorted(rest) for p in self.pieces.pop(number)]
        if len(rest) == 1:
            for length, what in pieces:
                self.pieces.setdefault(rest[0], []).append((length, what))
            yield from self.laid(rest[0])
            return
        self.drained = len(pieces)
        at, offset = None, self.window
        for length, what in pieces:
            a = 0
            while a < length:
                if offset == self.window:
                    at, offset = self.fresh(), 0
                b = min(length, a + self.window - offset)
                yield at, offset, b - a, cut(what, a, b)
                offset += b - a
                a = b


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, window: int = WINDOW, ranks_path: str | None = None, padding: float = PADDING) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    prepare(docs.sparkSession)
    path = ranks_path or default_ranks()
    id_field = docs.schema["doc_id"]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, out = encoder(path), Packer(window), []
        first = TaskContext.get().partitionId() * SEQUENCES_PER_PARTITION

        def row(at: int, offset: int, length: int, what) -> None:
            doc, start, ids, total = what
            out.append((doc, start, length, zlib.crc32(ids), total, first + at, offset))

        def cut(what, a: int, b: int):
            doc, start, ids, total = what
            return doc, start + a, ids[4 * a : 4 * b], total

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * len(names)
            out.clear()
            return pa.record_batch([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                ids = np.array([*(encode(text) if text else ()), END], "<u4").tobytes()
                total = len(ids) // 4
                whole = total - total % window
                for a in range(0, whole, window):
                    row(packer.fresh(), 0, window, (doc, a, ids[4 * a : 4 * (a + window)], total))
                if whole < total:
                    for x in packer.place(total - whole, (doc, whole, ids[4 * whole :], total)):
                        row(*x)
            if out:
                yield rows()
        if packer.pieces:
            for x in packer.finish(cut, padding):
                row(*x)
            yield rows()

    return docs.select("doc_id", "text").mapInArrow(pack, f"doc_id {id_field.dataType.simpleString()}, {PIECES}")
