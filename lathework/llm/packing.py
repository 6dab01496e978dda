"""Packing of token sequences as vector bin packing with the dot-product heuristic.

Each sequence has three simultaneous limits: tokens, segments and loss-bearing tokens. A task
tokenizes its own part of the table and packs as it goes: full-length cuts leave at once, the rest of
each example waits in a pool of bounded size, from which the open sequence takes, again and again,
the example whose demand vector has the largest dot product with what the sequence has left. When
no whole example fits, one is cut to fit. The last sequences of a task are cut to powers of two, which
need no padding. There is no shuffle and nothing global, so the work grows with the input alone.

Defined results: a null or empty text is the closing id alone; a null id is carried; repeated rows
and ties are packed one by one; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS = 2048
MAX_SEGMENTS = 128
#: Examples that wait in a task's pool.
POOL = 512
#: Texts that are encoded at once.
ROWS = 200
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class _Packer:
    """The pool and the open sequence of one task."""

    def __init__(self, first_id: int, max_tokens: int, max_segments: int, max_loss: int):
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.next_id = first_id
        self.out: list[tuple] = []
        self.items: list[tuple] = []  # (doc_id, ids as bytes, from, to, first loss-bearing id, length of the document)
        self.need = np.zeros((POOL + 1, 3))
        self.close()

    def close(self) -> None:
        self.left = self.limits.copy()
        self.open: list[tuple] = []

    @staticmethod
    def loss(a: int, b: int, bearing: int) -> int:
        return max(0, b - max(a, bearing))

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, ids, a, b, bearing, n in pieces:
            self.out.append((doc, a, b - a, ids[4 * a : 4 * b], n, self.next_id, at, self.loss(a, b, bearing)))
            at += b - a
        self.next_id += 1

    def add(self, doc, ids: bytes, bearing: int) -> None:
        n, a, most = len(ids) // 4, 0, int(self.limits[0])
        while n - a >= most and self.loss(a, a + most, bearing) <= self.limits[2]:
            self.emit([(doc, ids, a, a + most, bearing, n)])
            a += most
        while a < n:  # a limit on loss-bearing tokens below that on tokens cuts shorter
            b = self.fit(a, n, bearing, self.limits)
            self.put((doc, ids, a, b, bearing, n))
            a = b

    def fit(self, a: int, b: int, bearing: int, left: np.ndarray) -> int:
        """How far a piece from ``a`` can go."""
        b = min(b, a + int(left[0]))
        return min(b, max(a, bearing) + int(left[2]))

    def put(self, item: tuple) -> None:
        _, _, a, b, bearing, _ = item
        self.need[len(self.items)] = (b - a, 1, self.loss(a, b, bearing))
        self.items.append(item)
        while len(self.items) > POOL:
            self.place()

    def take(self, i: int) -> tuple:
        item, last = self.items[i], self.items.pop()
        if i < len(self.items):
            self.items[i] = last
            self.need[i] = self.need[len(self.items)]
        return item

    def place(self) -> None:
        """Move one example, or a cut of it, into the open sequence."""
        need, left = self.need[: len(self.items)], self.left
        score = (need / self.limits) @ (left / self.limits)
        fits = (need <= left).all(1)
        last_seat = left[1] == 1  # the last segment should fill what is left
        if fits.any() and not (last_seat and (need[:, 0] > left[0]).any()):
            piece = self.take(int(np.where(fits, score, -1.0).argmax()))
        else:
            i = int(need[:, 0].argmax()) if not fits.any() or last_seat else int(score.argmax())
            doc, ids, a, b, bearing, n = self.items[i]
            cut = self.fit(a, b, bearing, left)
            if cut <= a:  # nothing of it goes in: the limit on loss-bearing tokens is reached
                self.emit(self.open)
                self.close()
                return
            piece = (doc, ids, a, cut, bearing, n)
            if cut < b:
                self.items[i] = (doc, ids, cut, b, bearing, n)
                self.need[i] = (b - cut, 1, self.loss(cut, b, bearing))
            else:
                self.take(i)
        _, _, a, b, bearing, _ = piece
        self.open.append(piece)
        self.left = left - (b - a, 1, self.loss(a, b, bearing))
        if self.left[0] < 1 or self.left[1] < 1:
            self.emit(self.open)
            self.close()

    def finish(self) -> None:
        while self.items:
            self.place()
        total = sum(p[3] - p[2] for p in self.open)
        rest, pieces = total, list(self.open)
        while rest:
            size = 1 << (rest.bit_length() - 1)
            own, room = [], size
            while room:
                doc, ids, a, b, bearing, n = pieces.pop(0)
                cut = min(b, a + room)
                own.append((doc, ids, a, cut, bearing, n))
                room -= cut - a
                if cut < b:
                    pieces.insert(0, (doc, ids, cut, b, bearing, n))
            self.emit(own)
            rest -= size
        self.close()


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    close_with: int = 1,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss_tokens: int | None = None,
) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence, and its ids (little-endian uint32).

    ``prompt_col`` names the number of first ids of an example that bear no loss (null: none);
    ``max_loss_tokens`` defaults to ``max_tokens``.
    """
    most_loss = max_loss_tokens or max_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._bpe import byte_bpe

        bpe, end = byte_bpe(vocabulary), np.asarray([close_with], "<u4").tobytes()
        packer = _Packer(TaskContext.get().partitionId() << 40, max_tokens, max_segments, most_loss)

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*packer.out)) or [()] * len(types)
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                docs_, texts, prompts = (c.to_pylist() for c in batch.slice(at, ROWS).columns)
                for doc, ids, prompt in zip(docs_, bpe.encode(texts), prompts):
                    packer.add(doc, ids + end, prompt)
                    if len(packer.out) > 4000:
                        yield flush()
        packer.finish()
        yield flush()

    prompt = F.coalesce(F.col(prompt_col).cast("long"), F.lit(0)) if prompt_col else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), prompt.alias("prompt"))
    return rows.mapInArrow(run, SCHEMA)
