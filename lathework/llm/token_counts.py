"""Token counts of a BPE vocabulary with word ends by heap-and-linked-list merging; no identifiers are made.

Inside each task every new pre-token becomes a linked list of its symbols. The adjacent pair of lowest
rank, the leftmost of equals, is popped off a heap and joined until no pair has a rank; the count is the
symbols at the start minus the merges. Counts of chunks and of pre-tokens seen before come from caches of
bounded size. No shuffle.

Defined results: a null text is empty and has no tokens; null ids, repeated rows and ties are carried
through row by row; a special token's string in a text counts as one token, as is the library's
default; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import CACHE, word_bpe

#: Tokens that a training sequence takes.
LIMIT = 2048
#: Rows that a task counts at once.
ROWS = 500


def merges(symbols: list[str], rank: dict[tuple[str, str], int]) -> int:
    """How many merges a list of symbols goes through, in order of rank and then place."""
    n = len(symbols)
    text = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    # An entry holds the texts that it joins: it is stale once either symbol has changed.
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(text, text[1:])) if (r := rank.get((a, b))) is not None]
    heapify(heap)
    done = 0
    while heap:
        _, i, a, b = heappop(heap)
        j = after[i]
        if text[i] != a or j >= n or text[j] != b:
            continue
        text[i], text[j] = a + b, ""
        done += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := rank.get((a + b, text[k]))) is not None:
                heappush(heap, (r, i, a + b, text[k]))
        h = before[i]
        if h >= 0 and (r := rank.get((text[h], a + b))) is not None:
            heappush(heap, (r, h, text[h], a + b))
    return done


class Counter:
    """Counts of texts, by chunks between spaces; chunks are remembered in two generations."""

    def __init__(self, path: str):
        self.bpe = word_bpe(path)
        self.young: dict[str, int] = {"": 0}
        self.old: dict[str, int] = {}
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of a pre-token in byte-level characters."""
        n = self.known.get(word)
        if n is None:
            symbols = [*word[:-1], word[-1] + self.bpe.end]
            n = self.known[word] = len(symbols) - merges(symbols, self.bpe.rank)
        return n

    def chunk(self, chunk: str) -> int:
        """Tokens of a stretch of text; a space never lies inside a pre-token, so chunks count apart."""
        bpe = self.bpe
        if bpe.split_special and any(s in chunk for s in bpe.special):
            return sum(1 if s in bpe.special else sum(map(self.word, bpe.pre_tokens(s))) for s in bpe.split_special.split(chunk) if s)
        return sum(map(self.word, bpe.pre_tokens(chunk)))

    def count(self, texts: list[str]) -> list[int]:
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.young) > CACHE:
            self.young, self.old = {"": 0}, self.young
        if len(self.known) > CACHE:
            self.known = {}
        young, old = self.young, self.old
        for c in set().union(*cut) - young.keys():
            n = old.get(c)
            young[c] = self.chunk(c) if n is None else n
        get = young.__getitem__
        return [sum(map(get, c)) for c in cut]


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): bytes in UTF-8, tokens, and whether they are more than ``limit``.

    ``vocabulary`` is the path of a tokenizer file on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n = pa.array(count(part.column(2).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    found = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
