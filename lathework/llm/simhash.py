"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Fingerprints come from all shingles of the whole text. Equal fingerprints are folded into one first.
Two 64-bit fingerprints that differ in at most r bits agree on at least b - r of b blocks of bits, so the
distinct fingerprints are dealt into tables by agreeing blocks, each table row by row into buckets; b
grows with their number, which keeps buckets small. The rows of buckets of any size, sorted by bucket and
population count, are cut into tiles, and pairs of tiles compared by exclusive-or and bit counts in numpy;
pairs are skipped that share no bucket or whose population counts lie further apart than the radius. A bucket that is too large for one task is dealt again by
population count and salt, one group for each pair of tiles within the radius. Tiles give a spanning
forest of their links and not all pairs; the components of these links are those of all links.

Defined results: a null text is empty; texts without words have fingerprint zero and link like any
other; a null id has the fingerprint of its text and never gives a component its name, unless all are
null; rows of equal id share a component only by their fingerprints; an empty table gives an empty
table; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._graph import components
from ._io import spread, stash
from ._parts import Parts, Reader, write_parts
from ._windows import mix

RADIUS = 4
#: Fingerprints in a tile, pairs of tiles compared at once, and fingerprints in the largest bucket that one task compares whole.
TILE = 64
PAIRS = 128
BUCKET = 16384


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.empty(0, "<u8")
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    cut = map(slice, starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.fromiter(map(partial(xxh64_intdigest, seed=seed), map(joined.__getitem__, cut)), "<u8", len(words) - k + 1)


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        bits = np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def simhash(text: str, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text: bits that over half of its shingles' XXH64 values have."""
    return majority(shingle_hashes(text.encode(), shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, f): the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.fromiter((simhash(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64))], ["doc_id", "f"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, f long")


def _pairs(f: np.ndarray, pop: np.ndarray, bucket: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, rows) whose fingerprints lie within the radius in one bucket, some tile pairs at a time.

    The rows come sorted by bucket, then population count; tiles are runs of them, across the borders of small buckets.
    A later tile shares one bucket with an earlier one at most, that of the one's last and the other's first
    row, which are also the nearest in population count: if these are too far apart, the pair of tiles is skipped.
    """
    first = np.arange(0, len(f), TILE)
    last = np.minimum(first + TILE, len(f)) - 1
    span = np.arange(TILE)
    left, d = np.arange(len(first)), 0
    while len(left):
        for at in range(0, len(left), PAIRS):
            i = first[left[at : at + PAIRS], None] + span
            j = i + d * TILE
            i_, j_ = np.minimum(i, len(f) - 1), np.minimum(j, len(f) - 1)
            near = np.bitwise_count(f[i_][:, :, None] ^ f[j_][:, None, :]) <= radius
            near &= bucket[i_][:, :, None] == bucket[j_][:, None, :]
            k, x, y = np.nonzero(near)
            x, y = i[k, x], j[k, y]
            keep = (x < y) & (y < len(f))
            yield x[keep], y[keep]
        d += 1
        left = left[left + d < len(first)]
        end, start = last[left], first[left + d]
        left = left[(bucket[end] == bucket[start]) & (pop[start] - pop[end] <= radius)]


def _forest(f: np.ndarray, radius: int, bucket: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints of each bucket, or of one bucket of all."""
    bucket = np.zeros(len(f), np.int64) if bucket is None else bucket
    pop = np.bitwise_count(f).astype(np.int64)
    order = np.lexsort((pop, bucket))
    f, pop, bucket = f[order], pop[order], bucket[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[starts[1:], len(f)]
    label, out = np.arange(len(f)), []
    for x, y in _pairs(f, pop, bucket, radius):
        while len(x):
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            # One link of each row at a time; what these join needs no further link.
            _, at = np.unique(x, return_index=True)
            for i, j in zip(x[at].tolist(), y[at].tolist()):
                if label[i] != label[j]:
                    out.append((i, j))
                    k = np.searchsorted(starts, i, "right") - 1
                    own = label[starts[k] : ends[k]]
                    own[own == label[j]] = label[i]
    return [(int(f[x].view(np.int64)), int(f[y].view(np.int64))) for x, y in out]


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links inside each bucket; the rows come sorted by bucket."""

    def solve(bucket: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        links = _forest(f, radius, bucket)
        a, b = zip(*links) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held_b, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        held_b = np.r_[held_b, batch.column(0).to_numpy(zero_copy_only=False)]
        held_f = np.r_[held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
        cut = int(np.searchsorted(held_b, held_b[-1])) if len(held_b) else 0  # the last bucket may go on
        if cut:
            yield solve(held_b[:cut], held_f[:cut])
            held_b, held_f = held_b[cut:], held_f[cut:]
    if len(held_b):
        yield solve(held_b, held_f)


def _blocks(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """The tables for n fingerprints: for each, the blocks (shift, width) that agree. Exact for every n."""
    b = radius + 1
    while b < radius + 5 and n >> (64 * (b - radius) // b) > 64:
        b += 1
    edges = [64 * i // b for i in range(b + 1)]
    return [[(edges[i], edges[i + 1] - edges[i]) for i in chosen] for chosen in combinations(range(b), b - radius)]


def links(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints ``f`` that connect all within the radius of each other."""
    tables = _blocks(found.count(), radius)

    def key(t: int, blocks: list[tuple[int, int]]) -> Column:
        parts = [F.shiftrightunsigned("f", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in blocks]
        return F.xxhash64(F.lit(t), *parts)

    dealt = found.select("f", F.explode(F.array(*(key(t, blocks) for t, blocks in enumerate(tables)))).alias("bucket"))
    large = dealt.groupBy("bucket").count().filter(F.col("count") > BUCKET)
    large = stash(large.withColumn("salts", F.ceil(F.col("count") / BUCKET).cast("int")), "large-buckets")

    def compared(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket").sortWithinPartitions("bucket", "f").mapInArrow(partial(_compare, radius=radius), "a long, b long")

    if large.isEmpty():
        return compared(dealt.select("bucket", "f"))
    # Tiles of a large bucket: population count and salt. A fingerprint goes to each pair of tiles that it is part of.
    rest = dealt.join(large, "bucket", "left_anti").select("bucket", "f")
    pop = F.bit_count("f")
    tiles = dealt.join(large, "bucket").select("bucket", "f", pop.alias("p"), F.pmod(F.xxhash64("f"), F.col("salts")).alias("s"), "salts")
    pairs = tiles.select("*", F.explode(F.sequence(F.col("p") - radius, F.col("p") + radius)).alias("q"))
    pairs = pairs.select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("z"))
    mine, other = F.struct(F.col("p").alias("p"), F.col("s").cast("int").alias("s")), F.struct(F.col("q").alias("p"), F.col("z").alias("s"))
    tiled = pairs.select(F.xxhash64("bucket", F.least(mine, other), F.greatest(mine, other)).alias("bucket"), "f")
    return compared(rest).union(compared(tiled))


def _roots(distinct: DataFrame, radius: int) -> DataFrame:
    """(f, root): for each fingerprint with links the smallest that it reaches."""
    linked = components(links(distinct.select("f"), radius))
    return linked.withColumnRenamed("node", "f").union(linked.select("root").distinct().select(F.col("root").alias("f"), F.col("root").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = 4) -> DataFrame:
    """(doc_id, f, component_id): the smallest doc_id that a document reaches by links, itself included."""
    rows = stash(fingerprints(docs, id_col, text_col, shingle), "simhash")
    found = stash(rows.groupBy("f").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    named = _roots(found, radius).join(found, "f")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    member = named.join(least, "root").select("f", "component_id")
    final = found.join(member, "f", "left").select("f", F.coalesce("component_id", "first").alias("component_id"))
    return spread(rows, final, "f").select("doc_id", "f", "component_id")


def _only(names: list[str], others: list[str], text_col: str):
    """Gives the rows of a part at the places that are asked for, with the columns ``names``."""

    def kept(reader: Reader, about: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in reader.batches(["r", "text", "void", "carry"]):
            some = batch.filter(pc.is_in(batch.column(0), about["r"].combine_chunks()))
            if some.num_rows:
                text = pc.if_else(some.column(2), pa.scalar(None, pa.string()), some.column(1).cast(pa.string()))
                columns = dict(zip(others, some.column(3).flatten())) | {text_col: text}
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return kept


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = 4) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that with the smallest id (null last), then hash of the text, then place.

    Texts are written once in parts and stay where they are; only places, hashes and fingerprints are dealt out.
    """
    names = list(docs.columns)
    others = [c for c in names if c != text_col]
    parts = write_parts(docs, id_col, text_col, tuple(others))

    def marked(reader: Reader, _: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in reader.batches(["r", "d", "h", "text"]):
            f = np.fromiter((simhash(t.as_py().decode(), shingle) for t in batch.column(3)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(f.view(np.int64))], ["r", "d", "h", "f"])

    rows = stash(parts.beside(marked, "r long, d long, h long, f long"), "simhash")
    found = stash(rows.groupBy("f").agg(F.min(F.struct("d", "h", "r")).alias("first")), "simhash-distinct")
    roots = found.join(_roots(found, radius), "f", "left").select(F.coalesce("root", "f").alias("root"), "first")
    chosen = roots.groupBy("root").agg(F.min("first").alias("first")).select("first.r")

    return parts.beside(_only(names, others, text_col), docs.schema, chosen)


#: Share of the shingles of two documents that must be common, of those that either has.
SIMILARITY, WORDS = 0.8, 5
#: Differing bits within which pairs are looked at, nearest first. At a similarity of 0.8 fingerprints differ in 10 bits, give or take 3.
NEAR = (4, 10, 22)
#: Samples of a document, and how many of them make a bucket's key: at a similarity of 0.8 a pair shares none of the keys once in 500 times.
SAMPLES, SAMPLE = 12, 4
_ODD = np.random.default_rng(42).integers(0, 2**63, SAMPLES * SAMPLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _keys(s: np.ndarray) -> np.ndarray:
    """Bucket keys of a set of hashes: least values under several orders, some together."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max)
    for at in range(0, len(s), 4096):
        least = np.minimum(least, (s[at : at + 4096, None] * _ODD).min(axis=0))
    out = np.zeros(SAMPLES, np.uint64)
    for part in least.reshape(SAMPLES, SAMPLE).T:
        out = mix(out ^ part)
    return out + np.arange(SAMPLES, dtype=np.uint64)


def _nearest(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b): in each bucket a forest of pairs of near fingerprints and sizes, nearest pairs first. Rows (bucket, f, s, n) come sorted by bucket."""

    def solve(bucket: np.ndarray, f: np.ndarray, s: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        f = f.view(np.uint64)
        pop = np.bitwise_count(f).astype(np.int64)
        order = np.lexsort((pop, bucket))
        bucket, f, s, n, pop = bucket[order], f[order], s[order], n[order], pop[order]
        up = np.arange(len(f))

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return int(i)

        out = []
        for radius in NEAR:
            for x, y in _pairs(f, pop, bucket, radius):
                sized = np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y])
                x, y = x[sized], y[sized]
                by = np.argsort(np.bitwise_count(f[x] ^ f[y]), kind="stable")
                for i, j in zip(x[by].tolist(), y[by].tolist()):
                    a, b = top(i), top(j)
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        out.append((i, j))
        i, j = np.array(out, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(s[i]), pa.array(s[j])], ["a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = new if held is None else [np.r_[a, b] for a, b in zip(held, new)]
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last bucket may go on
        if cut:
            yield solve(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield solve(*held)


def similar_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of nodes (s, f, n, keys) that are near by fingerprint and size in a common bucket, a forest of each bucket."""
    dealt = nodes.select("s", "f", "n", F.explode("keys").alias("bucket"))
    count = dealt.groupBy("bucket").count().filter("count > 1")
    # Rows of one bucket are dealt further by fingerprint only where they are too many for a task: each part then meets each other part.
    salts = count.select("bucket", F.ceil(F.col("count") / BUCKET).cast("int").alias("salts"))
    rows = dealt.join(salts, "bucket").withColumn("z", F.pmod(F.xxhash64("s"), F.col("salts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    cell = F.when(F.col("salts") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("z", "y"), F.greatest("z", "y")))
    cells = rows.select("*", other.alias("y")).select(cell.alias("bucket"), "f", "s", "n")
    return cells.repartition("bucket").sortWithinPartitions("bucket", "s").mapInArrow(lambda it: _nearest(it, similarity), "a long, b long")


#: First shingles that a task counts at once.
HELD = 1 << 22
#: Bits of a set that tell how far two sets are apart at least; documents of a shingle from which on it is put last in the order of shingles; of so many at most.
BITS, COMMON, MOST_COMMON = 2048, 64, 65_536


def _first_shingles(own: np.ndarray, similarity: float, common: np.ndarray | None = None) -> np.ndarray:
    """The first shingles of a sorted set in the order of all: two sets at the similarity share one of these. ``common`` come last, in its order."""
    most = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1
    if common is not None:
        order = np.argsort(common)
        at = order[np.minimum(np.searchsorted(common, own, sorter=order), len(common) - 1)]
        late = common[at] == own
        own = np.r_[own[~late], common[np.sort(at[late])]]
    return own[:most]


def _parity(own: np.ndarray, bits: int | None = None) -> bytes:
    """Of each class of hashes whether a set has an odd number: two sets differ in at least as many hashes as in classes."""
    bits = bits or BITS
    return np.packbits(np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1 == 1).tobytes()


def _wide(own: np.ndarray) -> bytes | None:
    """The parities of a set that is large for ``BITS``, in at least two classes for each hash."""
    return _parity(own, 1 << (2 * len(own) - 1).bit_length()) if 2 * len(own) > BITS else None


def _may(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, r, to) whose parities ``x`` and ``y`` (powers of two of classes) and sizes ``m`` and ``n`` allow the similarity."""
    for batch in batches:
        good = []
        for x, y, m, n in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "m", "n"))):
            u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            if len(u) < len(v):
                u, v = v, u
            while len(u) > len(v):  # half as many classes
                u = u[: len(u) // 2] ^ u[len(u) // 2 :]
            good.append(int(np.bitwise_count(u ^ v).sum(dtype=np.int64)) <= (m + n) * (1 - similarity) / (1 + similarity) + 1e-6)
        yield batch.select(["a", "b", "r", "to"]).filter(pa.array(good, pa.bool_()))


def _crossing(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b): in each bucket all pairs of different roots that sizes and parities allow. Rows (bucket, n, s, root, bits) come sorted by bucket and n."""

    def solve(bucket: np.ndarray, n: np.ndarray, s: np.ndarray, root: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.arange(0, len(n), TILE)
        last = np.minimum(first + TILE, len(n)) - 1
        span = np.arange(TILE)
        left, d = np.arange(len(first)), 0
        while len(left):
            for at in range(0, len(left), PAIRS):
                i = first[left[at : at + PAIRS], None] + span
                j = i + d * TILE
                i_, j_ = np.minimum(i, len(n) - 1)[:, :, None], np.minimum(j, len(n) - 1)[:, None, :]
                k, x, y = np.nonzero((bucket[i_] == bucket[j_]) & (root[i_] != root[j_]) & (n[i_] >= similarity * n[j_] - 1e-6))
                x, y = i[k, x], j[k, y]
                keep = (x < y) & (y < len(n))
                x, y = x[keep], y[keep]
                apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
                keep = apart <= (n[x] + n[y]) * (1 - similarity) / (1 + similarity) + 1e-6
                a, b = s[x[keep]], s[y[keep]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            d += 1
            left = left[left + d < len(first)]
            end, start = last[left], first[left + d]
            left = left[(bucket[end] == bucket[start]) & (n[end] >= similarity * n[start] - 1e-6)]

    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:4]]
        new.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), "<u8").reshape(-1, BITS // 64))
        held = new if held is None else [np.concatenate(pair) for pair in zip(held, new)]
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last bucket may go on
        if cut:
            yield from solve(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield from solve(*held)


def crossing_links(parts: Parts, nodes: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(a, b) of nodes (s, r, root, n, bits): every pair of different roots that may reach the similarity, by a common shingle among the first of both.

    Shingles are ordered by hash, those of many documents last. No pair at the similarity of two roots is left out. What is dealt out for each
    first shingle is short: the shingle and two places; sizes and bits join only the few shingles that different roots share.
    """

    def firsts(common: np.ndarray | None):
        def run(reader: Reader, about: pa.Table) -> Iterator[tuple[np.ndarray, pa.Table]]:
            for places, texts, rows in _with_texts(reader, about):
                own = {p: _first_shingles(np.unique(shingle_hashes(t, shingle)), similarity, common).view(np.int64) for p, t in zip(places, texts)}
                sets = [own[p] for p in rows["r"].to_pylist()]
                yield np.concatenate(sets), rows.take(pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets])))

        return run

    def repeats(reader: Reader, about: pa.Table) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token[count > 1]), pa.array(count[count > 1])], ["token", "count"])

        held: list[np.ndarray] = []
        for tokens, _ in firsts(None)(reader, about):
            held.append(tokens)
            if sum(map(len, held)) > HELD:
                yield counted()
                held = []
        if held:
            yield counted()

    def dealt(order: np.ndarray | None):
        def run(reader: Reader, about: pa.Table) -> Iterator[pa.RecordBatch]:
            for tokens, rows in firsts(order)(reader, about):
                yield pa.RecordBatch.from_arrays([pa.array(tokens), rows["r"].combine_chunks(), rows["root"].combine_chunks()], ["token", "r", "root"])

        return run

    # Counts need not be whole, as any order will do: documents of a shingle that is alone in its stretch of a part do not count.
    place = nodes.select(F.col("s").alias("root"), F.col("r").alias("at"))
    placed = stash(nodes.select("r", "root").join(place, "root").select("r", F.col("at").alias("root")), "places")
    counts = parts.beside(repeats, "token long, count long", placed).groupBy("token").agg(F.sum("count").alias("count")).filter(F.col("count") > COMMON)
    common = counts.orderBy(F.desc("count"), "token").limit(MOST_COMMON).collect()
    order = np.array([r["token"] for r in sorted(common, key=lambda r: (r["count"], r["token"]))], np.int64).view(np.uint64)
    rows = parts.beside(dealt(order if len(order) else None), "token long, r long, root long", placed)
    of = Window.partitionBy("token")
    rows = rows.select("token", "r", F.min("root").over(of).alias("low"), F.max("root").over(of).alias("high"), F.count("*").over(of).alias("count"))
    shared = rows.filter("low <> high").select("token", "r", F.ceil(F.col("count") / BUCKET).cast("int").alias("salts"))
    full = shared.join(nodes, "r").withColumn("z", F.pmod(F.xxhash64("s"), F.col("salts")).cast("int"))
    cell = F.when(F.col("salts") == 1, F.col("token")).otherwise(F.xxhash64("token", F.least("z", "y"), F.greatest("z", "y")))
    cells = full.select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("y")).select(cell.alias("bucket"), "n", "s", "root", "bits")
    return cells.repartition("bucket").sortWithinPartitions("bucket", "n").mapInArrow(lambda it: _crossing(it, similarity), "a long, b long").distinct()


def deduplicate_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = WORDS) -> DataFrame:
    """One row of each group of documents that share at least ``similarity`` of their shingles, with the columns of ``docs``.

    The row with the smallest id (null last) of a group stays, then that with the smallest hash of the text, then place.
    At such a similarity fingerprints differ in more bits than buckets of agreeing bits can find, so buckets come from least hashes; in
    them fingerprints are compared in tiles, nearest pairs first, and each pair that would join two groups
    is confirmed by the documents' whole sets of shingles. A pair that fails may have stood for others, and buckets miss some; so between
    the groups that are confirmed all pairs that can reach the similarity are then looked up by their first shingles and confirmed alike.
    Texts stay in their parts; one set is sent for each pair that the parities of both allow.
    """
    names = list(docs.columns)
    others = [c for c in names if c != text_col]
    parts = write_parts(docs, id_col, text_col, tuple(others))

    def marked(reader: Reader, _: pa.Table) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in reader.batches(["r", "d", "h", "text"]):
            f, s, n, bits, wide, keys = [], [], [], [], [], []
            for text in batch.column(3):
                h = shingle_hashes(text.as_py(), shingle)
                own = np.unique(h)
                f.append(majority(h))
                n.append(len(own))
                s.append(xxh64_intdigest(own.tobytes()))
                bits.append(_parity(own))
                wide.append(_wide(own))
                keys.append(_keys(own).view(np.int64))
            columns = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (f, s, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, pa.array(bits, pa.binary()), pa.array(wide, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["r", "d", "h", "f", "s", "n", "bits", "wide", "keys"])

    rows = parts.beside(marked, "r long, d long, h long, f long, s long, n long, bits binary, wide binary, keys array<long>")
    same = rows.groupBy("s").agg(F.min(F.struct("d", "h", "r")).alias("first"), F.min("f").alias("f"), F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("wide").alias("wide"), F.min("keys").alias("keys"))
    nodes = stash(same, "similar-nodes")  # a row for each set of shingles
    pairs = similar_links(nodes, similarity).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stash(pairs, "similar-pairs")
    place = nodes.select("s", F.col("first.r").alias("r"), "n", F.coalesce("wide", "bits").alias("bits"))

    def sets(reader: Reader, about: pa.Table) -> Iterator[pa.RecordBatch]:
        for places, texts, rows in _with_texts(reader, about):
            own = {p: np.unique(shingle_hashes(t, shingle)).tobytes() for p, t in zip(places, texts)}
            at = rows["r"].to_pylist()
            for k in range(0, len(at), 256):
                some = rows.slice(k, 256)
                yield pa.RecordBatch.from_arrays([*(some[c].combine_chunks() for c in ("to", "a", "b")), pa.array([own[p] for p in at[k : k + 256]], pa.binary())], ["r", "a", "b", "set"])

    def confirmed(reader: Reader, about: pa.Table) -> Iterator[pa.RecordBatch]:
        for places, texts, rows in _with_texts(reader, about):
            own = {p: np.unique(shingle_hashes(t, shingle)) for p, t in zip(places, texts)}
            good = []
            for p, data in zip(rows["r"].to_pylist(), rows["set"]):
                x, y = own[p], np.frombuffer(data.as_py(), "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= similarity * (len(x) + len(y) - common))
            kept = rows.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept["a"].combine_chunks(), kept["b"].combine_chunks()], ["a", "b"])

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        one = place.select(F.col("s").alias("a"), "r", F.col("n").alias("m"), F.col("bits").alias("x"))
        other = place.select(F.col("s").alias("b"), F.col("r").alias("to"), "n", F.col("bits").alias("y"))
        asked = pairs.join(one, "a").join(other, "b").mapInArrow(lambda it: _may(it, similarity), "a long, b long, r long, to long")
        sent = parts.beside(sets, "r long, a long, b long, set binary", asked)
        return stash(parts.beside(confirmed, "a long, b long", sent), name)

    near = checked(pairs, "confirmed")
    grouped = nodes.join(components(near).withColumnRenamed("node", "s"), "s", "left").select("s", F.col("first.r").alias("r"), F.coalesce("root", "s").alias("root"), "n", "bits")
    rest = stash(crossing_links(parts, stash(grouped, "confirmed-groups"), similarity, shingle).join(pairs, ["a", "b"], "left_anti"), "crossing-pairs")
    linked = components(near.union(checked(rest, "confirmed-crossing")))
    roots = nodes.join(linked.withColumnRenamed("node", "s"), "s", "left").select(F.coalesce("root", "s").alias("root"), "first")
    chosen = roots.groupBy("root").agg(F.min("first").alias("first")).select("first.r")
    return parts.beside(_only(names, others, text_col), docs.schema, chosen)


def _with_texts(reader: Reader, about: pa.Table) -> Iterator[tuple[list, list, pa.Table]]:
    """(places, texts, rows of ``about``) of the places that are asked for, some at a time."""
    if not about.num_rows:
        return
    about = about.sort_by("r")
    r = about["r"].to_numpy()
    for batch in reader.batches(["r", "text"]):
        places = batch.column(0).to_numpy()
        lo, hi = np.searchsorted(r, places[0]), np.searchsorted(r, places[-1], "right")
        if hi > lo:
            some = batch.filter(pc.is_in(batch.column(0), pa.array(np.unique(r[lo:hi]))))
            yield some.column(0).to_pylist(), some.column(1).to_pylist(), about.slice(lo, hi - lo)
