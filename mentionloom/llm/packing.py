"""Packing documents into training windows, online and in bounded space.

Each partition keeps a fixed number of open windows.  A document first fills
whole windows of its own; the rest goes to the open window that it fits best.
When it fits none, the fullest window is topped up with the head of the rest and
emitted.  At the end the partition's open windows are merged by filling one from
the next, and the last one, short of a window, is emitted as sequences whose
lengths are powers of two, which need no padding.  So nothing is padded, nothing
is shuffled, and a partition needs memory for its open windows alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import giving_back, slices
from .tokens import encoder, vocabulary

WINDOW = 2048
OPEN = 64
END = 1
WIDTH = 4
#: Token pieces that a worker remembers.
MEMO = 1_000_000

Piece = tuple[int, int, int, bytes]  # doc_id, start, tokens of the document, ids


class WindowPacker:
    """Packs pieces of one partition; ``done`` gathers (sequence number, offset, piece)."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN):
        self.window, self.limit = window, open_windows
        self.open: list[tuple[list[Piece], int]] = []  # pieces, tokens
        self.done: list[tuple[int, int, Piece]] = []
        self.sequences = 0

    def _emit(self, pieces: list[Piece]) -> None:
        offset = 0
        for piece in pieces:
            self.done.append((self.sequences, offset, piece))
            offset += len(piece[3]) // WIDTH
        self.sequences += 1

    @staticmethod
    def _cut(piece: Piece, tokens: int) -> tuple[Piece, Piece]:
        doc, start, total, ids = piece
        return (doc, start, total, ids[: tokens * WIDTH]), (doc, start + tokens, total, ids[tokens * WIDTH :])

    def add(self, doc, ids: bytes) -> None:
        total = len(ids) // WIDTH
        whole = total // self.window * self.window
        for start in range(0, whole, self.window):
            self._emit([(doc, start, total, ids[start * WIDTH : (start + self.window) * WIDTH])])
        if whole < total:
            self._place((doc, whole, total, ids[whole * WIDTH :]))

    def _place(self, piece: Piece) -> None:
        size = len(piece[3]) // WIDTH
        best, room = -1, self.window + 1
        for i, (_, used) in enumerate(self.open):
            if size <= self.window - used < room:
                best, room = i, self.window - used
        if best < 0 and len(self.open) >= self.limit:
            fullest = max(range(len(self.open)), key=lambda i: self.open[i][1])
            pieces, used = self.open.pop(fullest)
            head, piece = self._cut(piece, self.window - used)
            self._emit([*pieces, head])
            size = len(piece[3]) // WIDTH
        if best < 0:
            self.open.append(([piece], size))
            return
        pieces, used = self.open[best]
        pieces.append(piece)
        if used + size == self.window:
            self.open.pop(best)
            self._emit(pieces)
        else:
            self.open[best] = (pieces, used + size)

    def finish(self) -> None:
        """Merge what is still open."""
        rest = [x for pieces, _ in sorted(self.open, key=lambda x: -x[1]) for x in pieces]
        self.open = []
        left = sum(len(x[3]) // WIDTH for x in rest)
        rest.reverse()
        while left:
            want = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            left -= want
            pieces = []
            while want:
                piece = rest.pop()
                if len(piece[3]) // WIDTH > want:
                    piece, tail = self._cut(piece, want)
                    rest.append(tail)
                pieces.append(piece)
                want -= len(piece[3]) // WIDTH
            self._emit(pieces)


def pack(docs: DataFrame, path: str | None = None, end: int = END, window: int = WINDOW, open_windows: int = OPEN) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ids holds the piece's token ids as little-endian 32-bit integers; start is
    the piece's place in its document, offset its place in the sequence.  Every
    document, a null or empty text too, ends with the id ``end``, so none is
    lost.  Rows that share a doc_id are packed one by one.  Other columns are
    ignored; an empty table gives no rows.  A task that runs again packs alike.
    """
    path = path or vocabulary("byte_bpe_50k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    close = end.to_bytes(WIDTH, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, packer = encoder(path, spaced=True, width=WIDTH, memo=MEMO), WindowPacker(window, open_windows)
        first = TaskContext.get().partitionId() << 33

        def drain() -> pa.RecordBatch:
            done, packer.done = packer.done, []
            rows = ([p[0] for _, _, p in done], [p[1] for _, _, p in done], [len(p[3]) // WIDTH for _, _, p in done], [p[2] for _, _, p in done], [first + s for s, _, _ in done], [o for _, o, _ in done])
            return pa.RecordBatch.from_arrays([pa.array(rows[0], doc_type), *(pa.array(x, pa.int64()) for x in rows[1:]), pa.array([p[3] for _, _, p in done], pa.binary())], names)

        doc_type = pa.int64()
        for batch in batches:
            doc_type = batch.schema.field(0).type
            for rows in slices(batch):
                for doc, ids in zip(rows.column(0).to_pylist(), texts.encode(rows.column("text")), strict=True):
                    packer.add(doc, ids.tobytes() + close)
                yield drain()
        packer.finish()
        yield drain()

    return docs.select("doc_id", "text").mapInArrow(giving_back(run, encoders=True), f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
