"""Suffix and common-prefix arrays by external induced sorting.

Suffixes are left- or right-smaller than the next one; right-smaller ones behind a left-smaller one
(LMS) are the seeds. The pieces between seeds are sorted as tuples and named; where names repeat, the
shorter text of names is sorted by the same procedure, which hands back the order of the seeds and how
many names neighbours share. All other suffixes are then induced in two sweeps over the characters. A
sweep draws suffix tuples from a priority queue, whose priority is (character, arrival), and pushes the
suffix before each. A tuple holds its place, the characters before it, so that most steps need no look
into the text, and the length of the common prefix with the tuple pushed before it under its
character: one more than the least length met since then. Tuples are drawn many at once: as many
characters as induce nothing among themselves. Queues move tuples to files past a bound on memory; the
text itself, 1, 2 or 4 bytes a character, stays in memory. Sorted suffixes come out part by part.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np

from ._io import LOCAL_DEFAULT, store

#: Bytes of tuples that a queue keeps in memory.
QUEUE_BYTES = 64 << 20
#: Texts of names up to this length are sorted by ranks of doubled length.
SMALL = 400_000
#: Units of characters in a block of a queue.
BLOCK = 24
Tuples = tuple[np.ndarray, ...]  # places, characters before them, common prefixes, own characters


class BucketQueue:
    """A priority queue of suffix tuples with priorities (character, order of arrival), moved to files past ``limit`` bytes.

    ``width`` characters are a unit and drawn together. Tuples wait by blocks of units; the block that
    the sweep is in is split by unit.
    """

    def __init__(self, limit: int = QUEUE_BYTES, *, folder: str | None = None, width: int = 1):
        self.limit, self.width, self.held, self.written, self.open = limit, width, 0, 0, -1
        self.folder = f"{folder or LOCAL_DEFAULT}/queue-{uuid.uuid4().hex}"
        self.blocks: dict[int, list] = {}
        self.units: dict[int, list] = {}
        self.disk = None

    def _put(self, waiting: list, arrays: Tuples) -> None:
        size = 0
        for x in arrays:
            size += x.nbytes
        if self.held + size <= self.limit:
            self.held += size
            waiting.append(arrays)
            return
        if self.disk is None:
            self.disk, self.root = store(self.folder)
            self.disk.create_dir(self.root, recursive=True)
        name = f"{self.root}/{self.written}"
        with self.disk.open_output_stream(name, compression=None) as f:
            block = io.BytesIO()
            for x in arrays:
                np.save(block, x)
            f.write(block.getbuffer())
        self.written += 1
        waiting.append((name, len(arrays)))

    def _take(self, waiting: list) -> list[Tuples]:
        out = []
        for x in waiting:
            if isinstance(x[0], str):
                with self.disk.open_input_file(x[0]) as f:
                    block = io.BytesIO(f.read())
                self.disk.delete_file(x[0])
                x = tuple(np.load(block) for _ in range(x[1]))
            else:
                for y in x:
                    self.held -= y.nbytes
            out.append(x)
        return out

    def push(self, tuples: Tuples) -> None:
        """Tuples sorted by character, in either direction."""
        if len(tuples[3]):
            self._deal(tuples, tuples[3] // (self.width * BLOCK), True)

    def _deal(self, tuples: Tuples, by: np.ndarray, blocks: bool) -> None:
        cuts = (np.flatnonzero(by[1:] != by[:-1]) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(by)]):
            part, k = tuple(x[a:b] for x in tuples), int(by[a])
            if not blocks:
                self._put(self.units.setdefault(k, []), part)
            elif k == self.open:
                self._deal(part, part[3] // self.width, False)
            else:
                self._put(self.blocks.setdefault(k, []), part)

    def pop(self, unit: int) -> Tuples | None:
        """All that waits under a unit, in order of arrival."""
        if unit // BLOCK != self.open:
            self.open = unit // BLOCK
            found = _join(self._take(self.blocks.pop(self.open, [])))
            if found is not None:
                by = found[3] // self.width
                order = np.argsort(by, kind="stable")
                self._deal(tuple(x[order] for x in found), by[order], False)
        return _join(self._take(self.units.pop(unit, [])))

    def close(self) -> None:
        if self.disk is not None:
            self.disk.delete_dir(self.root)


def _join(parts: list[Tuples]) -> Tuples | None:
    if len(parts) < 2:
        return parts[0] if parts else None
    return tuple(map(np.concatenate, zip(*parts)))


def _at(tuples: Tuples, which) -> Tuples:
    return tuple(x[which] for x in tuples)


class _Text:
    """A text that ends in its only 0, with views of as many characters at once as 64 bits hold."""

    def __init__(self, text: np.ndarray):
        self.n, self.top = len(text), int(text.max())
        self.bits = 8 if self.top < 0xFE else 16 if self.top < 0xFFFE else 32
        self.per = 64 // self.bits
        self.unknown = (1 << self.bits) - 1  # marks in the characters before a place: not known, and before the text
        self.none = self.unknown - 1
        self.kind = np.dtype(f"<u{self.bits // 8}")
        self.chars = text.astype(self.kind)
        pad = np.full(self.per, self.none, self.kind)
        step, size = (self.kind.itemsize,), (self.n + 1,)
        self._on, self._back = np.r_[self.chars, pad], np.r_[self.chars[::-1], pad]
        self._big = self._on.astype(self.kind.newbyteorder(">"))
        self.word = np.ndarray(size, "<u8", self._on, 0, step)
        self.word_back = np.ndarray(size, "<u8", self._back, 0, step)
        self.word_big = np.ndarray(size, ">u8", self._big, 0, step)

    def before(self, places: np.ndarray) -> np.ndarray:
        """The characters before each place, the nearest lowest."""
        return self.word_back[self.n - places]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray | int) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at a and b, up to ``most``."""
        most = np.broadcast_to(np.asarray(most, np.int64), a.shape)
        out, live, k, shift = np.zeros(len(a), np.int64), np.flatnonzero(most > 0), 0, self.bits.bit_length() - 1
        a, b, left = a[live], b[live], most[live]
        while len(live):
            unlike = self.word[a] ^ self.word[b]
            low = unlike & (~unlike + np.uint64(1))
            same = np.where(unlike == 0, self.per, np.bitwise_count(low - np.uint64(1)) >> shift)
            out[live] = same + np.int64(k)
            k += self.per
            on = np.flatnonzero((unlike == 0) & (left > k))
            live, left = live[on], left[on]
            a, b = np.minimum(a[on] + self.per, self.n), np.minimum(b[on] + self.per, self.n)
        return np.minimum(out, most)


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of each stretch [first, last], from minima of stretches of doubled length."""
    size = last - first + 1
    level = (np.frexp(size.astype(np.float64))[1] - 1).astype(np.int64)
    table = np.empty((int(level.max()) + 1, len(values)), values.dtype)
    table[0] = values
    for j in range(1, len(table)):
        half = 1 << (j - 1)
        np.minimum(table[j - 1, :-half], table[j - 1, half:], out=table[j, :-half])
    return np.minimum(table[level, first], table[level, last + 1 - (1 << level)])


class _Sweep:
    """One sweep: finds the suffix before each visited one, with the common prefix carried along."""

    def __init__(self, text: _Text, most: int):
        self.text, self.most = text, most
        # While one character is visited again and again: the least common prefix behind the last push under a
        # character in the visit that pushed it, which visit that was, and the least of each visit. Else all are 0.
        self.tail, self.when = np.zeros(text.top + 1, np.uint16), np.full(text.top + 1, -1)
        self.visits, self.start, self.mins = 0, 0, []

    def targets(self, tuples: Tuples) -> tuple[Tuples, np.ndarray]:
        """The tuples with the characters before them known, and the nearest of these."""
        text, (places, before, prefix, own) = self.text, tuples
        near = before.astype(text.kind)
        stale = np.flatnonzero(near == text.unknown)
        if len(stale):
            before = before.copy()
            before[stale] = text.before(places[stale])
            near[stale] = before[stale].astype(text.kind)
        return (places, before, prefix, own), near

    def visit(self, tuples: Tuples, near: np.ndarray, at: np.ndarray, goes_on: bool = False) -> Tuples:
        """The suffixes before those visited at ``at``, stably sorted by character; ``goes_on``: the same character is visited again."""
        places, before, prefix, _ = tuples
        if not len(at):
            self._end(prefix, goes_on)
            return places[:0], before[:0], prefix[:0], near[:0]
        again = goes_on or self.mins
        at = at[np.argsort(near[at], kind="stable")]
        chars = near[at]
        first = np.empty(len(at), bool)
        first[0] = True
        np.not_equal(chars[1:], chars[:-1], out=first[1:])
        heads, rest = np.flatnonzero(first), np.flatnonzero(~first)
        kinds = chars[heads]
        least = np.empty(len(at), np.uint16)
        if again:
            later = np.minimum.accumulate(np.array([*self.mins, self.most], np.uint16)[::-1])[::-1]
            since = np.maximum(self.when[kinds] - self.start + 1, 0)
            since = np.where(since > 0, np.minimum(self.tail[kinds], later[since]), 0)
            least[heads] = np.minimum(np.minimum.accumulate(prefix)[at[heads]], since)
        else:
            least[heads] = 0
        if len(rest):
            least[rest] = _least(prefix, at[rest - 1] + 1, at[rest])
        if goes_on:
            behind = np.append(np.minimum.accumulate(prefix[::-1])[::-1], np.uint16(self.most))
            self.tail[kinds] = behind[at[np.append(heads[1:], len(at)) - 1] + 1]
            self.when[kinds] = self.visits
        self._end(prefix, goes_on)
        carried = np.minimum(least + np.uint16(1), np.uint16(self.most))
        text = self.text
        return places[at] - 1, (before[at] >> np.uint64(text.bits)) | np.uint64(text.unknown << (64 - text.bits)), carried, chars

    def _end(self, prefix: np.ndarray, goes_on: bool) -> None:
        self.visits += 1
        if goes_on:
            self.mins.append(int(prefix.min()) if len(prefix) else self.most)
        else:
            self.start, self.mins = self.visits, []


def _induce(text: _Text, seeds: np.ndarray, shared: np.ndarray, most: int, folder: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(suffixes from the largest down, the common prefix of each with the one visited before), part by part."""
    width = max(1, text.top // max(1, int(text.n**0.5)))
    ready, queue, kept = (BucketQueue(folder=folder, width=width) for _ in range(3))
    ready.push((seeds, text.before(seeds), shared, text.chars[seeds]))
    none, nothing = text.none, (seeds[:0], text.before(seeds[:0]), shared[:0], text.chars[:0])

    def merged(waiting: Tuples, new: Tuples, down: bool) -> Tuples:
        """Later tuples behind earlier ones of the same character."""
        if not len(new[3]):
            return waiting
        both = _join([waiting, new]) if len(waiting[3]) else new
        order = np.argsort(text.top - both[3] if down else both[3], kind="stable")
        return _at(both, order)

    def opened(tuples: Tuples, down: bool, other: Tuples) -> Tuples:
        """Two kinds of suffixes of whole characters, those of ``other`` behind within each character, with common prefixes at the borders."""
        both = _join([tuples, other]) if len(other[3]) and len(tuples[3]) else tuples if len(tuples[3]) else other
        late = np.r_[np.zeros(len(tuples[3]), np.int64), np.ones(len(other[3]), np.int64)]
        chars = both[3].astype(np.int64)
        order = np.argsort((text.top - chars if down else chars) * 2 + late, kind="stable")
        places, before, prefix, own = _at(both, order)
        late, new = late[order], np.r_[True, own[1:] != own[:-1]] if len(own) else np.empty(0, bool)
        prefix = prefix.copy()
        prefix[new] = 0
        meet = np.flatnonzero(~new & np.r_[False, late[1:] != late[:-1]]) if len(own) else np.empty(0, np.int64)
        if len(meet):
            prefix[meet] = text.common(places[meet - 1].astype(np.int64), places[meet].astype(np.int64), most)
        return places, before, prefix, own, late

    sweep = _Sweep(text, most)
    for unit in range(text.top // width + 1):  # left-smaller suffixes, from the smallest up
        end = (unit + 1) * width
        wait, own = queue.pop(unit), ready.pop(unit)
        wait = merged(nothing, wait, False) if wait is not None else nothing
        own = own if own is not None else nothing
        while len(wait[3]) or len(own[3]):
            wait, near = sweep.targets(wait)
            own, near_own = sweep.targets(own)
            inside = near[(near >= wait[3]) & (near < end)], near_own[(near_own > own[3]) & (near_own < end)]
            stop = min((int(x.min()) for x in inside if len(x)), default=end)
            now = min(int(x[3][0]) for x in (wait, own) if len(x[3]))
            if stop == now:  # suffixes of this character induce others of it
                cut = int(np.searchsorted(wait[3], now, "right"))
                some, wait, new = _at(wait, slice(0, cut)), _at(wait, slice(cut, None)), [nothing]
                some[2][0] = 0
                last = None
                while len(some[3]):
                    some, near = sweep.targets(some)
                    kept.push(some)
                    last = some[0][-1:]
                    found = sweep.visit(some, near, np.flatnonzero((near >= now) & (near != none)), True)
                    again = int(np.searchsorted(found[3], now, "right"))
                    some = _at(found, slice(0, again))
                    new.append(_at(found, slice(again, None)))
                cut = int(np.searchsorted(own[3], now, "right"))
                some, own = _at(own, slice(0, cut)), _at(own, slice(cut, None))
                if cut:
                    some[2][0] = text.common(last.astype(np.int64), some[0][:1].astype(np.int64), most)[0]
                    some, near = sweep.targets(some)
                    new.append(sweep.visit(some, near, np.flatnonzero((near > now) & (near != none)), True))
                sweep._end(some[2], False)
            else:
                cut, cut_own = int(np.searchsorted(wait[3], stop)), int(np.searchsorted(own[3], stop))
                *some, late = opened(_at(wait, slice(0, cut)), False, _at(own, slice(0, cut_own)))
                wait, own = _at(wait, slice(cut, None)), _at(own, slice(cut_own, None))
                kept.push(_at(some, late == 0))
                some, near = sweep.targets(tuple(some))
                new = [sweep.visit(some, near, np.flatnonzero((near >= some[3] + late.astype(text.kind)) & (near != none)))]
            for found in new:
                here = int(np.searchsorted(found[3], end))
                wait = merged(wait, _at(found, slice(0, here)), False)
                queue.push(_at(found, slice(here, None)))
    sweep = _Sweep(text, most)
    for unit in range(text.top // width, -1, -1):  # right-smaller ones, from the largest down
        start = unit * width
        wait, small = queue.pop(unit), kept.pop(unit)
        wait = merged(nothing, wait, True) if wait is not None else nothing
        if small is not None:  # turned round, each with the common prefix of the larger one
            small = (small[0][::-1], small[1][::-1], np.r_[np.uint16(0), small[2][::-1][:-1]].astype(np.uint16), small[3][::-1])
        else:
            small = nothing
        while len(wait[3]) or len(small[3]):
            wait, near = sweep.targets(wait)
            small, near_small = sweep.targets(small)
            inside = near[(near <= wait[3]) & (near >= start)], near_small[(near_small < small[3]) & (near_small >= start)]
            stop = max((int(x.max()) for x in inside if len(x)), default=start - 1)
            now = max(int(x[3][0]) for x in (wait, small) if len(x[3]))
            if stop == now:
                cut = int(np.count_nonzero(wait[3] == now))
                some, wait, new = _at(wait, slice(0, cut)), _at(wait, slice(cut, None)), [nothing]
                some[2][0] = 0
                last = None
                while len(some[3]):
                    some, near = sweep.targets(some)
                    yield some[0], some[2]
                    last = some[0][-1:]
                    found = sweep.visit(some, near, np.flatnonzero(near <= now), True)
                    again = int(np.searchsorted(found[3], now))
                    some = _at(found, slice(again, None))
                    new.append(_at(found, slice(0, again)))
                cut = int(np.count_nonzero(small[3] == now))
                some, small = _at(small, slice(0, cut)), _at(small, slice(cut, None))
                if cut:
                    some[2][0] = text.common(last.astype(np.int64), some[0][:1].astype(np.int64), most)[0]
                    some, near = sweep.targets(some)
                    yield some[0], some[2]
                    new.append(sweep.visit(some, near, np.flatnonzero(near < now), True))
                sweep._end(some[2], False)
            else:
                cut, cut_small = int(np.count_nonzero(wait[3] > stop)), int(np.count_nonzero(small[3] > stop))
                *some, late = opened(_at(wait, slice(0, cut)), True, _at(small, slice(0, cut_small)))
                wait, small = _at(wait, slice(cut, None)), _at(small, slice(cut_small, None))
                some, near = sweep.targets(tuple(some))
                yield some[0], some[2]
                new = [sweep.visit(some, near, np.flatnonzero(near + late.astype(text.kind) <= some[3]))]
            for found in new:
                here = int(np.searchsorted(found[3], start))
                wait = merged(wait, _at(found, slice(here, None)), True)
                queue.push(_at(found, slice(0, here)))
    yield np.array([text.n - 1], seeds.dtype), np.zeros(1, np.uint16)  # the end mark, which nothing induces
    for q in (ready, queue, kept):
        q.close()


def _seeds(text: np.ndarray) -> np.ndarray:
    """The LMS places: right-smaller behind left-smaller. The end mark is one."""
    n = len(text)
    step = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1])
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ decides
    small = np.r_[np.r_[step, np.int8(1)][at] > 0, True]
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _names(text: _Text, seeds: np.ndarray) -> np.ndarray:
    """The rank of the piece from each seed to the next one, among all different pieces.

    Pieces are sorted as tuples, as many characters as 64 bits hold at a time; a piece that another begins with comes
    after it, as the other goes on with a left-smaller suffix there.
    """
    size = np.diff(np.r_[seeds, seeds[-1]]) + 1
    rank, live, k, per = np.zeros(len(seeds), np.int64), np.arange(len(seeds)), 0, text.per
    full = np.uint64(2**64 - 1)
    while len(live):
        rest = np.clip(size[live] - k, 0, per)
        key = text.word_big[np.minimum(seeds[live] + k, text.n)].astype(np.uint64)
        ended = np.flatnonzero(rest < per)
        key[ended] |= np.where(rest[ended] == 0, full, full >> (rest[ended] * text.bits).astype(np.uint64))
        order = np.lexsort((key, rank[live])) if k else np.argsort(key)
        r, key = rank[live[order]], key[order]
        old = np.r_[True, r[1:] != r[:-1]]
        new = old | np.r_[True, key[1:] != key[:-1]]
        index = np.arange(len(order))
        rank[live[order]] = r + np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(old, index, 0))
        group = np.cumsum(new) - 1
        goes_on = (np.bincount(group) > 1) & (np.maximum.reduceat(size[live[order]], np.flatnonzero(new)) > k + per)
        live, k = live[order[goes_on[group]]], k + per
    order = np.argsort(rank)
    rank[order] = np.cumsum(np.r_[0, rank[order][1:] != rank[order][:-1]])
    return rank


def _by_ranks(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a short text of names, by pairs of ranks of doubled length; suffixes that have a place of their own are left alone."""
    n, width = len(names), 1
    order = np.argsort(names)
    new = np.r_[True, names[order][1:] != names[order][:-1]]
    index = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, index, 0))  # the first place of all that are alike so far
    live = order[~(new & np.r_[new[1:], True])]
    while len(live):
        behind = live + width
        key = rank[live] * (n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        by = np.argsort(key)
        live, key = live[by], key[by]
        r, index = rank[live], np.arange(len(live))
        old = np.maximum.accumulate(np.where(np.r_[True, r[1:] != r[:-1]], index, 0))
        new = np.r_[True, key[1:] != key[:-1]]
        rank[live] = r + np.maximum.accumulate(np.where(new, index, 0)) - old
        live = live[~(new & np.r_[new[1:], True])]
        width *= 2
    order[rank] = np.arange(n)
    return order


def _sorted_seeds(text: _Text, seeds: np.ndarray, most: int, folder: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The seeds in the order of their suffixes, and the common prefixes of neighbours."""
    names = _names(text, seeds)
    n = len(names)
    alike = np.zeros(n, np.int64)  # names that a seed's suffix shares with the one before it
    if int(names.max()) + 1 == n:
        order = np.argsort(names)
    elif n <= SMALL:
        order = _by_ranks(names)
    else:  # the end mark is the only seed of the smallest name
        places, prefix = (np.concatenate(x)[::-1] for x in zip(*_descending(names, most // 2 + 1, folder)))
        order, alike[1:] = places.astype(np.int64), prefix[:-1]
    at = seeds[order]
    # Names that neighbours share stand for whole pieces; the first pieces that differ are compared.
    skip = np.minimum(seeds[np.minimum(order + alike, n - 1)] - at, most)[1:]
    shared = np.zeros(n, np.int64)
    shared[1:] = skip + text.common(at[:-1] + skip, at[1:] + skip, most - skip)
    return at, shared.astype(np.uint16)


def _descending(chars: np.ndarray, most: int, folder: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    most = min(most, 60_000)
    if len(chars) == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.uint16)
        return
    text = _Text(chars)
    at, shared = _sorted_seeds(text, _seeds(text.chars), most, folder)
    yield from _induce(text, at.astype(np.int32 if len(chars) < 2**31 else np.int64), shared, most, folder)


def sorted_suffixes(chars: np.ndarray, most: int, folder: str | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(suffixes from the largest down, length of the common prefix of each with the one before, up to ``most``), part by part.

    The text ends in its only 0.
    """
    yield from _descending(chars, most, folder)
