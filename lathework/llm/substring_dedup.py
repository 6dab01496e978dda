"""Substring dedup over words by suffix automata.

Two forms of one operator. Against a reference of bounded size, automata of its shards are broadcast
and every document is streamed through them. Within a corpus the reference is the corpus itself and has
no bound, so its shards are routed (see ``_windows``): each part of the table streams its candidate
stretches through the automaton of the earlier ones, and what is left of all parts is dealt out so that
equal windows meet, and streamed again. Matching statistics, the longest match that ends at each word,
of at least ``length`` mark the spans that go.

Defined results: a null text has no words; a null id comes last in the order; rows of one id with
different texts are different documents in the order of the texts' hashes, equal rows are one document
and get the same result; texts shorter than a window stay whole; an empty table gives an empty table;
other columns are left out, unless they are to be carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _windows
from ._parts import write_parts

LENGTH = 20
GRAM = 5
#: Bytes of the texts of one automaton in a task.
SHARD = 1 << 19
#: Bytes of a reference that may be broadcast, in all, and in one automaton of it. An automaton takes up to 80 times its text.
MAX_REFERENCE, REFERENCE_SHARD = 2 << 20, 1 << 20


class Automaton:
    """Suffix automaton of several sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _new(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c) -> int:
        """A copy of q for the suffixes that end as c after p."""
        new = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def add(self, sequence: list) -> list[int]:
        """Adds a sequence; returns the length of the longest match with what came before that ends at each element."""
        last, edges, link, length, out = 0, self.next, self.link, self.length, []
        for i, c in enumerate(sequence):
            q = edges[last].get(c)
            if q is not None:  # the sequence so far is there already
                last = q if length[q] == length[last] + 1 else self._split(last, q, c)
                out.append(i + 1)
                continue
            new, p = self._new(length[last] + 1, {}, 0), last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
            out.append(length[link[new]])
            last = new
        return out

    def matches(self, sequence: list) -> list[int]:
        """The length of the longest match that ends at each element."""
        at, n, out, edges, link, length = 0, 0, [], self.next, self.link, self.length
        for c in sequence:
            while at and c not in edges[at]:
                at = link[at]
                n = length[at]
            q = edges[at].get(c)
            if q is not None:
                at = q
                n += 1
            out.append(n)
        return out


def _units(text: bytes) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.split()
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _pieces(text: bytes):
    words = text.split()
    return lambda a, b: b" ".join(words[a:b])


def repeats(segs: list[bytes], length: int) -> list[np.ndarray]:
    """For each of the segments, in document order, the windows of ``length`` words that an earlier place has too.

    Each is streamed through the automaton of the earlier ones and, unless all of it is there, added.
    """
    automaton, out = Automaton(), []
    for k, seg in enumerate(segs):
        words = seg.split(b" ")
        found = automaton.matches(words) if k else [0] * len(words)
        if k == 0 or min(found[length - 1 :], default=length) < length:
            found = automaton.add(words)
        out.append(np.flatnonzero(np.array(found) >= length) - (length - 1))
    return out


def _cut(data: bytes, gone: np.ndarray) -> tuple:
    words = data.split()
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2)
    kept = b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()]) if len(edges) else b" ".join(words)
    return len(words), int(gone.sum()), len(edges), edges.tolist(), kept.decode()


SCHEMA = "doc_id long, n_words long, n_removed long, n_spans long, spans array<array<long>>, kept string"
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string()]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, carry: tuple[str, ...] = (), untouched: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, spans, kept): words of windows that start earlier in the corpus are removed.

    ``spans`` are the removed runs of words [from, to); ``kept`` joins the other words by one space; with
    ``untouched`` texts that lose nothing stay as they are, white space included.
    The columns named in ``carry`` come along; they may not be called like the results.
    """
    if set(carry) & {x.split()[0] for x in SCHEMA.split(", ")}:
        raise ValueError("a carried column has the name of a result")
    shard = SHARD
    parts = write_parts(docs, id_col, text_col, carry)
    ranges = _windows.repeated(parts, _units, _pieces, repeats, length, min(GRAM, length), shard)
    cut = (lambda t, gone: _cut(t, gone) if gone.any() else (*_cut(t, gone)[:4], t.decode())) if untouched else _cut
    return _windows.finish(parts, ranges, cut, lambda t: len(t.split()), length, SCHEMA, TYPES, docs.select(*carry).schema if carry else None)


def remove_known(docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text", ref_text: str = "text", length: int = LENGTH) -> DataFrame:
    """The same columns; words in windows of a bounded reference are removed.

    The reference's bytes are counted first; above ``MAX_REFERENCE`` this raises, as nothing unbounded
    is broadcast. With an empty reference nothing goes.
    """
    texts = reference.select(F.coalesce(F.col(ref_text).cast("string"), F.lit("")).alias("t")).filter("t <> ''").distinct()
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if size > MAX_REFERENCE:
        raise ValueError(f"the reference has {size} bytes; at most {MAX_REFERENCE} are broadcast")
    shards, held = [Automaton()], 0
    for t in sorted(r["t"].encode() for r in texts.collect()):
        if held and held + len(t) > REFERENCE_SHARD:
            shards.append(Automaton())
            held = 0
        shards[-1].add(t.split())
        held += len(t)
    sent = docs.sparkSession.sparkContext.broadcast(shards)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                data = text.as_py()
                words = data.split()
                best = np.max([a.matches(words) for a in sent.value], axis=0) if words else np.empty(0)
                starts = np.flatnonzero(best >= length) - (length - 1)
                out.append(_cut(data, _windows.covered(len(words), starts, np.ones(len(starts), np.int64), length)))
            columns = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(TYPES), TYPES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, SCHEMA)
