"""What filters of a chain do to each other: counts for every order of the filters, part by part.

Texts are routed by fingerprint through an RDD. Each task keeps collision chains of the texts that it has
seen, with the full text and the smallest id, and sends on only the first row of each; whatever has an id
above its chain's smallest is a repeat and is emitted at once, without its text. The routed partitions chain
what is left of all tasks in the same way, so a group of copies, however large, comes to a partition once
for each task. Chains are compared by their texts, so fingerprints that collide do no harm.

Each document then has a mask of the filters that it fails. ``combineByKey`` merges vectors of counts by mask
for each part, and a part's vector answers all orders of the filters.

Defined results: a null text is empty; a null part is the empty string; ids are ordered with null last, and rows
that share the smallest id of a text are none of them repeats; repeated rows count each; an id with several
labels has a label if any of them has; unlabelled and null ids have none; an empty table gives an empty
table; other columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")
#: Bytes of the texts of a routed partition, and of the chains of a task before it sends them on.
PART_BYTES, HELD_BYTES = 32 << 20, 32 << 20
#: Orders null ids after all others.
LAST = 1 << 63
UPPER, SIGNS = bytes(range(ord("A"), ord("Z") + 1)), b"#$%&*|"


def failures(text: str) -> int:
    """The mask of the filters A to D that a text fails."""
    data = text.encode()
    words = data.split()  # bytes part at just the six white-space characters of ASCII
    n = len(words)
    short = n < 50
    poor = 100 * len(set(words)) < 65 * n
    loud = 100 * (len(data) - len(data.translate(None, UPPER))) > 5 * len(text)
    signs = len(data.translate(None, SIGNS)) < len(data)
    return short | poor << 1 | loud << 2 | signs << 3


class Chains:
    """Texts by fingerprint, each with its smallest id and the rows that have it, counted by (part, mask)."""

    def __init__(self) -> None:
        self.of: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, f: int, text: str, d: int, rows: Iterable[tuple[tuple[str, int], int]]) -> Iterator[tuple]:
        """Takes the rows of an id; yields those that are found to be repeats as (id, part, mask, number)."""
        chain = self.of.setdefault(f, [])
        link = next((x for x in chain if x[0] == text), None)
        if link is None:
            chain.append([text, d, Counter(dict(rows))])
            self.bytes += len(text) + 200
        elif d == link[1]:
            for key, n in rows:
                link[2][key] += n
        else:
            if d < link[1]:
                d, link[1] = link[1], d
                rows, link[2] = list(link[2].items()), Counter(dict(rows))
            for (part, mask), n in rows:
                yield d, part, mask | REPEAT, n

    def take(self) -> Iterator[tuple]:
        """(fingerprint, (text, smallest id, its rows)) of every chain, which are let go."""
        of, self.of, self.bytes = self.of, {}, 0
        for f, chain in of.items():
            for text, d, rows in chain:
                yield f, (text, d, list(rows.items()))


def _send(rows: Iterator, held_bytes: int) -> Iterator[tuple]:
    """First rows of texts by fingerprint, and repeats, dealt evenly, with no text."""
    chains = Chains()
    for place, (f, d, part, text) in enumerate(rows):
        for repeat in chains.add(f, text, LAST if d is None else d, [((part, failures(text)), 1)]):
            yield place, repeat
        if chains.bytes > held_bytes:
            yield from chains.take()
    yield from chains.take()


def _receive(routed: Iterator) -> Iterator[tuple]:
    chains = Chains()
    for f, row in routed:
        if len(row) == 4:
            yield row
        else:
            yield from chains.add(f, *row)
    for _, (_, d, rows) in chains.take():
        for (part, mask), n in rows:
            yield d, part, mask, n


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, part, mask, n): rows of each document by the filters that it fails, as bits from A up."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.xxhash64(text).alias("f"), F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text")
    )
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    sent: RDD = rows.rdd.mapPartitions(lambda it: _send(it, HELD_BYTES))
    found = sent.partitionBy(n, lambda f: f % n).mapPartitions(_receive)
    return spark.createDataFrame(found.map(lambda x: (None if x[0] == LAST else x[0], *x[1:])), "doc_id long, part string, mask int, n long")


def _vector(value: tuple) -> np.ndarray:
    """Documents, good and toxic ones, by mask."""
    return _add(np.zeros((3, 1 << len(FILTERS)), np.int64), value)


def _add(vector: np.ndarray, value: tuple) -> np.ndarray:
    mask, n, good, toxic = value
    vector[0, mask] += n
    vector[1, mask] += n * good
    vector[2, mask] += n * toxic
    return vector


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a += b
    return a


def report(part: str, vector: np.ndarray) -> Iterator[tuple]:
    """The rows of a part: every order of the filters, step by step."""
    mask = np.arange(vector.shape[1])
    rows, shapley = [], Counter()
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails, left = (mask & bit) > 0, (mask & before) == 0
            removed, good, toxic = (int(x) for x in vector[:, fails & left].sum(axis=1))
            kept = int(vector[0, left & ~fails].sum())
            redundant = int(vector[0, fails & ~left].sum())
            rows.append((part, "".join(order), step, kept, removed, redundant, int(vector[0, bit]), good, toxic, name))
            shapley[name] += removed
            before |= bit
    for row in rows:
        yield (*row[:-1], shapley[row[-1]])


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", part_bytes: int = PART_BYTES) -> DataFrame:
    """One row for each part, order of the filters and step; see ``report``.

    ``labels`` has (doc_id, quality, toxic).
    """
    spark = docs.sparkSession
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    # Rows of one id are few after this, whatever their number was, null ids among them.
    rows = masks(docs, id_col, text_col, part_col, part_bytes).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    labelled = rows.join(known, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    vectors = labelled.rdd.map(lambda x: (x[0], tuple(x[1:]))).combineByKey(_vector, _add, _merge)
    return spark.createDataFrame(vectors.flatMap(lambda x: report(*x)), SCHEMA)
