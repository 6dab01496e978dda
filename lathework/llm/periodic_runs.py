"""Periodic runs of words in linear time from Lyndon arrays, without suffix structures or hashes.

For an ordered alphabet, the suffixes between a place and the next one whose suffix is smaller begin the longest
Lyndon word at that place. Every run repeats such a word, under the order of the words or the reversed one,
at a distance of its period (Ellert and Fischer, 2021). A scan from the left keeps the places whose next
smaller suffix is not yet known; how far two suffixes agree follows in most cases from what their neighbours on the
way agree by. What is left is read off the text, and the match that reaches furthest is reused: inside
it all is a copy of what was found before, so each word is matched once.

Texts of a task are taken many at once, each closed by a letter of its own that is smaller than all before, so
nothing crosses texts and no small array is made for each. No shuffle.

Defined results: a null text has no words; null ids, repeated rows and ties are carried through row by
row; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has this many words and this many periods at least.
MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Words of the texts that a task takes at once; a longer text is taken alone.
WORDS = 1 << 16


def lyndon(t: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next one whose suffix is smaller (the end if none is), and how many letters the two share.

    The last letter must be smaller than all others and occur once.
    """
    n = len(t)
    nss, ahead = [n] * n, [0] * n  # next smaller suffix, letters shared with it
    pss, behind = [-1] * n, [0] * n  # the same for the smaller suffix before
    reach = base = shift = 0  # t[base:reach] is also at base - shift
    for r in range(1, n):
        c, at = t[r], r - 1
        shared = 0  # letters that ``at`` and r are known to share
        while at >= 0:
            if shared or t[at] == c:
                if r + shared < reach and at >= base:
                    a, b = at - shift, r - shift
                    known = behind[b] if pss[b] == a else ahead[a] if nss[a] == b else -1
                    inside = r + known < reach
                    shared = max(shared, known if inside else reach - r)
                    inside = inside and known >= 0
                else:
                    inside = False
                if not inside:
                    if shared == 0:
                        shared = 1
                    while t[at + shared] == t[r + shared]:
                        shared += 1
                    if r + shared > reach:
                        reach, base, shift = r + shared, r, r - at
                smaller = t[at + shared] < t[r + shared]
            else:
                smaller = t[at] < c
            if smaller:
                pss[r], behind[r] = at, shared
                break
            nss[at], ahead[at] = r, shared
            agree, at = behind[at], pss[at]
            while at >= 0 and agree > shared:  # as the suffix just passed
                nss[at], ahead[at] = r, shared
                agree, at = behind[at], pss[at]
            if at >= 0 and agree < shared:
                pss[r], behind[r] = at, agree
                break
    return nss, ahead


def _of_order(t: list[int], min_length: int, min_exponent: int) -> Iterator[tuple[int, int, int]]:
    """Runs (start, length, period) that repeat a Lyndon word of this order."""
    nss, ahead = (np.array(x, np.int64) for x in lyndon(t))
    at = np.arange(len(t))
    period = nss - at
    # Of a run's occurrences of its word take the first, which has less than a period of the run before it.
    need = np.maximum(min_length, min_exponent * period) - 2 * period + 1
    found = np.flatnonzero((nss < len(t)) & (ahead >= np.maximum(need, 1)))
    p = period[found]
    before = np.maximum(found - p, 0)
    again = (found >= p) & (nss[before] == found) & (ahead[before] >= p)
    for i, q, more in zip(found[~again].tolist(), p[~again].tolist(), ahead[found[~again]].tolist()):
        s = i
        while s and t[s - 1] == t[s - 1 + q]:
            s -= 1
        length = i - s + q + more
        if length >= max(min_length, min_exponent * q):
            yield s, length, q


def runs(texts: list[list], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """The maximal runs (start, length, period) of each text by start and period; any elements that can be told apart."""
    if min_exponent < 2:
        raise ValueError("a run repeats its period twice at least")
    letter = defaultdict(count().__next__)
    t: list[int] = []
    ends = []
    for k, text in enumerate(texts):
        t.extend(map(letter.__getitem__, text))
        t.append(-1 - k)
        ends.append(len(t))
    codes = np.array(t, np.int64)
    found = {*_of_order(t, min_length, min_exponent), *_of_order(np.where(codes >= 0, len(letter) - codes, codes).tolist(), min_length, min_exponent)}
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, length, q in sorted((s, q, length) for s, length, q in found):
        k = int(np.searchsorted(ends, s, "right"))
        out[k].append((s - (ends[k - 1] if k else 0), q, length))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words of a text without those that a run holds after its first period, joined by one space."""
    if not found:
        return b" ".join(words)
    gone = np.zeros(len(words), bool)
    for s, length, q in found:
        gone[s + q : s + length] = True
    return b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, strongest struct<start:long,length:long,period:long>, collapsed string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, strongest, collapsed): maximal stretches of words that repeat with a smallest period.

    ``runs`` are those of at least ``min_length`` words and ``min_exponent`` periods; ``strongest`` has the most
    periods, of equals the first start and then the shortest period, and is null without a run; ``collapsed`` keeps
    one period of each run.
    """
    names = ["doc_id", "n_words", "runs", "strongest", "collapsed"]
    as_dict = lambda r: dict(zip(("start", "length", "period"), r))

    def done(held: list[tuple]) -> pa.RecordBatch:
        found = runs([words for _, words in held], min_length, min_exponent)
        best = [as_dict(max(x, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))) if x else None for x in found]
        columns = [
            pa.array([i for i, _ in held], pa.int64()),
            pa.array([len(words) for _, words in held], pa.int64()),
            pa.array([list(map(as_dict, x)) for x in found], pa.list_(RUN)),
            pa.array(best, RUN),
            pa.array([collapsed(words, x).decode() for (_, words), x in zip(held, found)], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text.as_py().split()  # bytes part at just the six white-space characters of ASCII
                if held and size + len(words) > WORDS:
                    yield done(held)
                    held, size = [], 0
                held.append((i, words))
                size += len(words) + 1
        if held:
            yield done(held)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, SCHEMA)
