"""Finding all repeats of fixed-length windows, words or bytes, in whole texts.

A window is ``length`` consecutive units of one document. Consecutive windows with the same smallest gram hash
form a segment, so a run of one unit is few segments; equal windows always have the same smallest gram, so every
repeat lies among the segments of grams that occur more than once, if only at several places of one
segment. Which these are is counted over short rows;
their contents then go through an exact solver (a suffix automaton or a suffix array) twice:

* each part of the table solves its own segments, joined to the stretches of text that they cover, and
  finds the windows that start earlier in the part;
* what is left is dealt out so that equal windows meet, and solved again.

A passage shared by any number of documents so reaches a task at most once for each part. Segments are
dealt out by the place where their gram occurs first, in blocks of a text, so stretches stay joined.
Grams with many segments are dealt further by the smallest of other hashes in each window, as many as
their number asks for. Texts that are equal as a whole (by SHA-256; its odds of error, 2^-256 a pair, are
neglected) are one text: all but the first are removed whole. Order is (d, h, start): id, hash of the
text, unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._io import stash
from ._parts import Parts, Reader

#: Units that a task hashes at once, and segments that it folds by gram.
BLOCK, FOLD = 1 << 19, 1 << 20
#: Places of one gram from which on its segments are dealt by further hashes.
HOT = 2000
#: Windows of a segment at most.
WIDEST = 1 << 15
#: Units, as a power of two, of a block of the text where a gram occurs first.
NEAR = 10
_A = 0x9E3779B97F4A7C15 | 1
RANGE = "r long, s long, n long"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _grams(u: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive units, by doubling."""
    n, done, out, part, width = len(u), 0, None, u, 1
    while True:
        if k & width:  # ``part`` hashes ``width`` units: append it behind what is done
            tail = part[done : done + n - done - width + 1]
            out = tail if out is None else out[: len(tail)] * np.uint64(pow(_A, width, 1 << 64)) + tail
            done += width
        if done == k:
            return mix(out[: n - k + 1])
        part = part[: len(part) - width] * np.uint64(pow(_A, width, 1 << 64)) + part[width:]
        width *= 2


def _smallest(g: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    out, width = g, 1
    while 2 * width <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(g) - w + 1], out[w - width : w - width + len(g) - w + 1])


def segments(u: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(gram hash, first window, windows, places of the gram) of all segments of the texts that end at ``ends``."""
    empty = tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    if len(u) < length:
        return empty
    g = _grams(u, gram)
    least = _smallest(g, length - gram + 1)
    n = len(least)
    starts = np.r_[0, ends[:-1]]
    valid = np.arange(n) + length <= np.repeat(ends, ends - starts)[:n]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    if not len(first):
        return empty
    stop = np.flatnonzero(new | ~valid)  # every end of a run is the start of another or not valid
    at = np.searchsorted(stop, first, "right")
    last = np.r_[stop, n][at]
    pieces = -(-(last - first) // WIDEST)
    if pieces.max() > 1:
        of = np.repeat(np.arange(len(first)), pieces)
        first = first[of] + WIDEST * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        last = np.minimum(first + WIDEST, last[of])
    place = new
    place[1:] |= g[: n - 1] == least[:-1]  # the window before began with its smallest gram
    place[first] = True
    count = np.r_[0, np.cumsum(place)]
    return least[first], first, last - first, count[last] - count[first]


def _firsts(reader: Reader) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, d, place in these arrays of the first row with the same text by (d, r)) of a part."""
    r, d, sha = [], [], []
    for batch in reader.batches(["r", "d", "sha"], 4096):
        r.append(batch.column(0).to_numpy(zero_copy_only=False))
        d.append(batch.column(1).to_numpy(zero_copy_only=False))
        sha += batch.column(2).to_pylist()
    if not sha:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    r, d = np.concatenate(r), np.concatenate(d)
    seen: dict[bytes, int] = {}
    text = np.array([seen.setdefault(x, len(seen)) for x in sha])
    order = np.lexsort((r, d, text))
    new = np.r_[True, text[order][1:] != text[order][:-1]]
    first = np.empty(len(r), np.int64)
    first[order] = order[new][np.cumsum(new) - 1]
    return r, d, first


def fold(parts: Parts) -> DataFrame:
    """(r, rep, same): first rows of a text in their part that are not first in the corpus, the first one, and whether it has the same id."""

    def run(reader: Reader, _: pa.Table) -> Iterator[pa.RecordBatch]:
        r, _, first = _firsts(reader)
        own = set(r[first == np.arange(len(r))].tolist())
        for batch in reader.batches(["r", "d", "sha"], 4096):
            keep = pa.array([x in own for x in batch.column(0).to_pylist()], pa.bool_())
            yield batch.filter(keep)

    firsts = parts.beside(run, "r long, d long, sha binary")
    lead = F.min(F.struct("d", "r")).over(Window.partitionBy("sha"))  # a text comes once for each part
    return stash(firsts.select("r", "d", lead.alias("lead")).filter("r <> lead.r").select("r", F.col("lead.r").alias("rep"), (F.col("lead.d") == F.col("d")).alias("same")), "copies")


def _scan(reader: Reader, about: pa.Table, units: Callable, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (m, r, x, more): for each gram in a stretch of the part its first segment, and the others in ``more``.

    ``x`` packs the segment's first window (31 bits), its windows and the gram's places in the row (16 bits each).
    """
    r, _, first = _firsts(reader)
    skip = set(about["r"].to_pylist()) | set(r[first != np.arange(len(r))].tolist())
    found: list[tuple[np.ndarray, ...]] = []
    held: list[np.ndarray] = []
    rows: list[tuple[int, int]] = []  # (place, first unit of it here)
    total = 0

    def flush() -> None:
        nonlocal held, rows, total
        if held:
            ends = np.cumsum([len(x) for x in held])
            m, s, n, c = segments(np.concatenate(held), ends, length, gram)
            of = np.searchsorted(ends, s, "right")
            row, base = np.array(rows, np.int64).T
            found.append((m, row[of], s - np.r_[0, ends[:-1]][of] + base[of], n, c))
        held, rows, total = [], [], 0

    def folded() -> pa.RecordBatch:
        nonlocal found
        m, r, s, n, c = (np.concatenate(x) for x in zip(*found))
        found = []
        order = np.argsort(m, kind="stable")
        m, r, s, n, c = m[order], r[order], s[order], n[order], c[order]
        new = np.flatnonzero(np.r_[True, m[1:] != m[:-1]]) if len(m) else np.empty(0, np.int64)
        count = np.diff(np.r_[new, len(m)])
        places = np.add.reduceat(c, new) if len(m) else c
        x = (s << 32) | (n << 16)
        more = np.ones(len(m), bool)
        more[new] = False
        offsets = np.r_[0, np.cumsum(2 * (count - 1))].astype(np.int32)
        pairs = np.stack([r[more], x[more]], axis=1).ravel()
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(m[new].view(np.int64)), pa.array(r[new]), pa.array(x[new] | np.minimum(places, 0xFFFF)), lists], ["m", "r", "x", "more"])

    for batch in reader.batches(["r", "text"]):
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if i in skip:
                continue
            u = units(text.as_py())
            for at in range(0, max(len(u) - length + 1, 0), BLOCK):  # a long text goes in blocks that share length - 1 units
                held.append(u[at : at + BLOCK + length - 1])
                rows.append((i, at))
                total += len(held[-1])
                if total >= BLOCK:
                    flush()
                    if sum(len(f[0]) for f in found) >= FOLD:
                        yield folded()
    flush()
    if found:
        yield folded()


def _unpack(about: pa.Table) -> tuple[np.ndarray, ...]:
    """(r, first window, windows, key, level) of all wanted segments of a part, in order."""
    columns = [about[c].to_numpy() for c in ("r", "x", "key", "level")]
    lists = about["more"].combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64) // 2
    pairs = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
    r, x = np.r_[columns[0], pairs[:, 0]], np.r_[columns[1], pairs[:, 1]]
    key, level = (np.r_[c, np.repeat(c, sizes)] for c in columns[2:])
    s, n = x >> 32, (x >> 16) & 0xFFFF
    order = np.lexsort((s, r))
    return r[order], s[order], n[order], key[order].view(np.uint64), level[order]


def _extract(reader: Reader, about: pa.Table, units: Callable, pieces: Callable, solve: Callable, length: int, gram: int, shard: int) -> Iterator[pa.RecordBatch]:
    """Rows (g, d, h, s, r, n, seg): stretches that no earlier place of the part has, with their content; with seg null, ranges that repeat."""
    if not len(about):
        return
    r, s, n, key, level = _unpack(about)
    held: list[tuple] = []  # (d, h, first unit, place, content, segments)
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        held.sort(key=lambda x: x[:3])
        own = [(x[5], x[6]) for x in held]
        found = solve([x[4] for x in held], length)
        windows = np.array([(s[b - 1] + n[b - 1] - s[a]) for a, b in own])
        base = np.r_[0, np.cumsum(windows)]
        alive, keys = np.zeros(base[-1], bool), np.zeros(base[-1], np.uint64)
        which = np.concatenate([np.arange(a, b) for a, b in own])
        start = np.repeat(base[:-1] - np.array([s[a] for a, _ in own]), [b - a for a, b in own]) + s[which]
        at = np.repeat(start - np.r_[0, np.cumsum(n[which])[:-1]], n[which]) + np.arange(n[which].sum())
        alive[at] = True
        keys[at] = np.repeat(key[which], n[which])
        gone = np.concatenate([b + f for b, f in zip(base.tolist(), found)]) if found else np.empty(0, np.int64)
        alive[gone] = False
        deep = np.repeat(level[which], n[which])
        for j in np.unique([i for i, (a, b) in enumerate(own) if level[a:b].any()]).astype(int).tolist():
            g = _grams(units(held[j][4]), gram)
            lo, hi = np.searchsorted(at, base[j]), np.searchsorted(at, base[j + 1])
            for k in range(1, int(deep[lo:hi].max()) + 1):
                least = _smallest(mix(g ^ np.uint64(k * 0xD1342543DE82EF95 & (1 << 64) - 1)), length - gram + 1)
                mine = at[lo:hi][deep[lo:hi] >= k]
                keys[mine] = mix(keys[mine] ^ least[mine - base[j]])
        left = np.flatnonzero(alive)
        of = np.searchsorted(base, left, "right") - 1
        new = np.r_[True, (left[1:] != left[:-1] + 1) | (of[1:] != of[:-1]) | (keys[left[1:]] != keys[left[:-1]])] if len(left) else np.empty(0, bool)
        heads = np.flatnonzero(new)
        count = np.diff(np.r_[heads, len(left)])
        run, first = of[heads], left[heads] - base[of[heads]]
        d, h, unit, place = (np.array([x[i] for x in held], np.int64) for i in range(4))
        cuts = [pieces(x[4]) for x in held]
        seg = [cuts[j](a, a + c - 1 + length) for j, a, c in zip(run.tolist(), first.tolist(), count.tolist())]
        for a in range(0, len(seg), 20_000):
            j = run[a : a + 20_000]
            columns = [keys[left[heads[a : a + 20_000]]].view(np.int64), d[j], h[j], unit[j] + first[a : a + 20_000], place[j], count[a : a + 20_000]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(seg[a : a + 20_000], pa.binary())], ["g", "d", "h", "s", "r", "n", "seg"])
        of = np.searchsorted(base, gone, "right") - 1
        ranges = runs(place[of], unit[of] + gone - base[of])
        if len(ranges[0]):
            zero = np.zeros(len(ranges[0]), np.int64)
            columns = [mix(ranges[0].view(np.uint64) ^ ranges[1].view(np.uint64)).view(np.int64), zero, zero, ranges[1], ranges[0], ranges[2]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(zero), pa.binary())], ["g", "d", "h", "s", "r", "n", "seg"])
        held, size = [], 0

    for batch in reader.batches(["r", "d", "h", "text"]):
        places = batch.column(0).to_numpy()
        lo, hi = np.searchsorted(r, places), np.searchsorted(r, places, "right")
        for i in np.flatnonzero(hi > lo).tolist():
            a, b = int(lo[i]), int(hi[i])
            cut = pieces(batch.column(3)[i].as_py())
            # Segments that overlap are one stretch of the text.
            edges = np.flatnonzero(s[a + 1 : b] >= s[a : b - 1] + n[a : b - 1] - 1 + length) + a + 1
            for x, y in zip([a, *edges.tolist()], [*edges.tolist(), b]):
                seg = cut(int(s[x]), int(s[y - 1] + n[y - 1]) - 1 + length)
                held.append((batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), int(s[x]), int(places[i]), seg, x, y))
                size += len(seg)
                if size >= shard:
                    yield from flush()
    if held:
        yield from flush()


def runs(r: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """Consecutive windows of a place as one range."""
    order = np.lexsort((s, r))
    r, s = r[order], s[order]
    new = np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)] if len(s) else np.empty(0, bool)
    first = np.flatnonzero(new)
    return r[first], s[first], np.diff(np.r_[first, len(s)])


def _solve(batches: Iterator[pa.RecordBatch], pieces: Callable, solve: Callable, length: int, shard: int) -> Iterator[pa.RecordBatch]:
    """Ranges that repeat, from rows sorted by (g, d, h, s): whole groups are solved together, as many as a shard takes.

    Of a group larger than a shard, the stretches that were first so far go on to its next shard.
    """
    held: list[tuple] = []
    size, group, begun = 0, None, 0

    def flush(goes_on: bool) -> pa.RecordBatch:
        nonlocal held, size, begun
        # Windows of different groups never agree, so document order inside the shard is enough.
        last = held[begun:] if goes_on else []
        order = sorted(range(len(held)), key=lambda i: held[i][:3])
        found = solve([held[i][4] for i in order], length)
        r = np.repeat(np.array([held[i][3] for i in order], np.int64), [len(f) for f in found])
        s = np.concatenate([held[i][2] + f for i, f in zip(order, found)]) if found else np.empty(0, np.int64)
        gone = {held[i][:4]: f for i, f in zip(order, found)}
        held, size, begun = [], 0, 0
        for d, h, at, place, seg, n in last:
            left = np.ones(n, bool)
            left[gone[d, h, at, place]] = False
            edges = np.flatnonzero(np.diff(np.r_[False, left, False].astype(np.int8))).reshape(-1, 2).tolist()
            cut = pieces(seg) if edges else None
            for a, b in edges:
                held.append((d, h, at + a, place, cut(a, b - 1 + length), b - a))
                size += len(held[-1][4])
        ranges = runs(r, s)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ranges], ["r", "s", "n"])

    limit = shard
    for batch in batches:
        plain = pc.is_null(batch.column(6))
        known = batch.filter(plain)
        if len(known):
            yield pa.RecordBatch.from_arrays([known.column(4), known.column(3), known.column(5)], ["r", "s", "n"])
        for g, d, h, s, r, n, seg in zip(*(c.to_pylist() for c in batch.filter(pc.invert(plain)).columns)):
            if g != group:
                if size >= shard:
                    yield flush(False)
                group, begun, limit = g, len(held), shard
            elif size >= 2 * limit:
                yield flush(True)
                limit = max(shard, size)
            held.append((d, h, s, r, seg, n))
            size += len(seg)
    if held:
        yield flush(False)


def repeated(parts: Parts, units: Callable, pieces: Callable, solve: Callable, length: int, gram: int, shard: int) -> DataFrame:
    """(r, s, n): what is known about each place, for ``finish``; written to the shared folder.

    Ranges of n windows from s on that also start earlier; with s = -1 the whole text is that of an
    earlier id (n = 1) or the row is a repeated one (n = 0), which has the ranges of the first.
    ``units`` hashes the units of a text, ``pieces`` cuts unit ranges out of it, ``solve`` finds in
    contents in document order the windows that an earlier place has too.
    """
    copies = fold(parts)
    rows = parts.beside(lambda reader, about: _scan(reader, about, units, length, gram), "m long, r long, x long, more array<long>", copies.select("r"))
    all_of = Window.partitionBy("m")
    lead = F.min(F.struct("r", F.shiftright("x", 32).alias("s"))).over(all_of)
    rows = rows.select("r", "x", "more", F.sum(F.col("x").bitwiseAND(0xFFFF)).over(all_of).alias("k"), lead.alias("lead")).filter("k > 1")
    hot = F.col("k") > HOT
    wanted = rows.select(
        "r",
        "x",
        "more",
        F.when(hot, F.xxhash64("lead.r", "lead.s")).otherwise(F.xxhash64("lead.r", F.shiftright("lead.s", NEAR))).alias("key"),
        F.when(hot, F.floor(F.log(8.0, F.col("k") / HOT)) + 1).otherwise(0).cast("int").alias("level"),
    )
    cut = parts.beside(
        lambda reader, about: _extract(reader, about, units, pieces, solve, length, gram, shard),
        "g long, d long, h long, s long, r long, n long, seg binary",
        wanted,
    )
    dealt = cut.repartition("g").sortWithinPartitions("g", "d", "h", "s")
    ranges = stash(dealt.mapInArrow(lambda it: _solve(it, pieces, solve, length, shard), RANGE), "ranges")
    same = copies.filter("same").select("r", "rep")
    shared = same.join(ranges.withColumnRenamed("r", "rep"), "rep").select("r", "s", "n")
    whole = copies.select("r", F.lit(-1).cast("long").alias("s"), F.when(F.col("same"), 0).otherwise(1).cast("long").alias("n"))
    return ranges.union(shared).union(whole)


def finish(parts: Parts, ranges: DataFrame, cut: Callable, count: Callable, length: int, schema: str, types: list, carry: StructType | None = None) -> DataFrame:
    """Every row of the parts as (doc_id, *cut(text, which units go)), with its carried columns where ``carry`` shows their schema."""
    carried = carry.names if carry is not None else []
    names = [x.split()[0] for x in schema.split(", ")] + carried

    def run(reader: Reader, about: pa.Table) -> Iterator[pa.RecordBatch]:
        r, d, first = _firsts(reader)
        order = np.lexsort((about["s"].to_numpy(), about["r"].to_numpy()))
        place, s, n = (about[c].to_numpy()[order] for c in ("r", "s", "n"))
        at = 0
        for batch in reader.batches(["r", "doc_id", "text"] + ["carry"] * bool(carried)):
            out = []
            for text in batch.column(2):
                lead, data = first[at], text.as_py()
                a, b = np.searchsorted(place, r[lead]), np.searchsorted(place, r[lead], "right")
                state = int(n[a]) if b > a and s[a] == -1 else -1
                a += state >= 0
                total = count(data)
                gone = np.zeros(total, bool)
                if (state == 1 or d[lead] != d[at]) and total >= length:
                    gone[:] = True
                elif b > a and d[lead] == d[at]:
                    gone = covered(total, s[a:b], n[a:b], length)
                out.append(cut(data, gone))
                at += 1
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            beside = batch.column(3).flatten() if carried else []
            yield pa.RecordBatch.from_arrays([batch.column(1), *columns, *beside], names)

    schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in carry or ())
    return parts.beside(run, schema, ranges)


def covered(n: int, starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Which of n units lie in a window of the ranges."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(n, starts + counts - 1 + length), -1)
    return np.cumsum(edge[:-1]) > 0
