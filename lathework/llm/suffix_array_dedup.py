"""Substring dedup over bytes by suffix arrays, sorted by external induction.

Candidates for repeats of 100 bytes come from ``_windows``: stretches of texts, first those of one part
of the table, then those that are left of all parts, dealt out so that equal windows meet. A task lays
them out as shards and sorts each shard's suffixes by recursive induction over disk-backed queues that
carry suffix tuples and the lengths of common prefixes (``_induced``). Neighbours with a common prefix of
a window's length are equal windows; all but the first in document order go.

Defined results: a null text is empty; a null id comes last in the order; rows of one id with
different texts are different documents in the order of the texts' hashes, equal rows are one document
and get the same result; matches never cross documents; an empty table gives an empty table; other
columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _windows
from ._induced import BucketQueue, sorted_suffixes  # noqa: F401
from ._io import shared_path
from ._parts import write_parts

LENGTH = 100
GRAM = 24
#: Bytes of a shard. Its text of names then stays below ``_induced.SMALL``; larger stretches and groups go through the recursion.
SHARD = 1 << 20


def suffix_array(text: np.ndarray, folder: str | None = None) -> np.ndarray:
    """Order of the suffixes of a text that ends in its only 0."""
    return np.concatenate([x for x, _ in sorted_suffixes(text, len(text), folder)])[::-1]


def _inner(text: np.ndarray, length: int) -> np.ndarray:
    """The places of runs of one character but for ``length`` at either end.

    A window that starts at one of them is all of that character, as is the earlier one at the run's start, so it
    repeats; without them every other window keeps its characters. What is left of a run is sorted in 2 ``length`` steps.
    """
    edges = np.r_[0, np.flatnonzero(text[1:] != text[:-1]) + 1, len(text)]
    size = np.diff(edges)
    long = np.flatnonzero(size > 2 * length)
    more = size[long] - 2 * length
    return np.repeat(edges[long] + length - np.r_[0, np.cumsum(more)[:-1]], more) + np.arange(int(more.sum())) if len(long) else long


def repeats(segs: list[bytes], length: int, folder: str | None = None) -> list[np.ndarray]:
    """For each of the segments, in document order, the windows of ``length`` bytes that an earlier place has too."""
    if not segs:
        return []
    sizes = np.array([len(s) for s in segs])
    # 1 parts the segments and 0 stands alone at the end, so bytes move up by two.
    text = np.frombuffer(b"\0".join(segs) + b"\0\0", np.uint8).astype(np.uint16) + np.uint16(2)
    ends = whole = np.cumsum(sizes + 1) - 1
    text[ends] = 1
    text[-1] = 0
    inner = _inner(text, length)
    if len(inner):
        old = np.delete(np.arange(len(text)), inner)
        text, ends = text[old], np.searchsorted(old, whole)
    used = np.bincount(text, minlength=258) > 0  # few byte values occur: numbered without gaps, a character takes one byte
    text = (np.cumsum(used) - 1)[text]
    left = np.zeros(len(text), np.int32)  # bytes from a place to the end of its segment
    left[: ends[-1] + 1] = np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(ends[-1] + 1)
    gone, base = [], 0
    first, of = np.empty(0, np.int64), np.empty(0, np.int64)  # the earliest place of the last group, which may go on
    for suffixes, prefix in sorted_suffixes(text, length, folder):
        group = base + np.cumsum(prefix < length)
        base = int(group[-1]) if len(group) else base
        inside = np.flatnonzero(left[suffixes] >= length)  # windows that lie within a segment
        at, group = np.r_[first, suffixes[inside]], np.r_[of, group[inside]]
        if not len(at):
            continue
        by = np.lexsort((at, group))
        again = np.zeros(len(by), bool)
        again[1:] = group[by][1:] == group[by][:-1]
        gone.append(at[by[again]])
        first, of = at[by[~again][-1:]], group[-1:]
    gone = np.unique(np.concatenate(gone)) if gone else np.empty(0, np.int64)
    if len(inner):
        gone = np.union1d(old[gone], inner)
    place = np.searchsorted(whole, gone)
    cuts = np.searchsorted(place, np.arange(len(segs) + 1))
    start = whole - sizes
    return [gone[cuts[i] : cuts[i + 1]] - start[i] for i in range(len(segs))]


def _units(text: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(text, np.uint8)]


def _pieces(text: bytes):
    return lambda a, b: text[a:b]


#: A 64-bit value for each byte, from the mixing function.
_BYTES = _windows.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _cut(data: bytes, gone: np.ndarray) -> tuple:
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2)
    kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if len(edges) else data
    return len(data), int(gone.sum()), len(edges), edges.tolist(), kept


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept): bytes of windows that start earlier in the corpus are removed.

    ``spans`` are the removed runs of bytes [from, to); ``kept`` holds the other bytes, which need not
    be valid text.
    """
    folder, shard = shared_path(docs.sparkSession, "queues"), SHARD
    parts = write_parts(docs, id_col, text_col)
    ranges = _windows.repeated(parts, _units, _pieces, lambda segs, n: repeats(segs, n, folder), length, min(GRAM, length), shard)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]
    return _windows.finish(
        parts, ranges, _cut, len, length, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary", types
    )
