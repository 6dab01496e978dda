"""Public tokenizers inside tasks: chunk caches for byte-level BPE and an own BPE encoder by speculation.

Vocabulary files are read from a path that the caller passes; nothing is trained or copied here.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import regex

#: Entries of a generation of chunks that a worker remembers.
CACHE = 450_000
#: A space that does not open a pre-token: one before other white space, or at the end.
RUN = re.compile(r" (?:\s|$)")
NO_SPACE = re.compile(r"\S+").fullmatch
#: The pre-tokens of lower-cased text in ASCII and Latin-1, as the word vocabulary's file splits them.
LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


# Fixed value: how a byte-level vocabulary without a pattern of its own splits a text.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next one from 256 up."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """Ids of a byte-level BPE vocabulary by the tokenizers library, remembered by chunk.

    A single space before a character that is not white space always opens a new pre-token, so the
    chunks between such spaces are encoded apart. New chunks are encoded many at once, parted by line
    feeds, which are a pre-token of their own there. Chunks are remembered in two generations: when
    the young one is full it becomes the old one, from which what is met again comes back.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.fast = self._ranks(path)
        self.feed = int(np.frombuffer(self._ids("\n"), "<u4")[0])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _ranks(self, path: str):
        """The same vocabulary as ranks for tiktoken, which gives the same ids faster where ids are in order of merging."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if made != sorted(made):
            raise ValueError("the ids of this vocabulary are not in order of merging")
        byte = {c: b for b, c in enumerate(byte_characters())}
        special = set(self.special)
        ranks = {bytes(byte[c] for c in s): i for s, i in vocab.items() if s not in special}
        return tiktoken.Encoding("own", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def parts(self, text: str) -> list[str]:
        """The chunks of a text, without the space that opens each but the first."""
        parts = text.split(" ")
        if RUN.search(text):
            joined = [parts[0]]
            for p in parts[1:]:
                if p and not p[0].isspace():
                    joined.append(p)
                else:
                    joined[-1] += " " + p
            return joined
        return parts

    def learn(self, chunks: set[str]) -> None:
        """Put the ids of chunks with a space before them into the young generation."""
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = chunks - young.keys()
        again = new & old.keys()
        young.update(zip(again, map(old.__getitem__, again)))
        new -= again
        plain, odd = [], []
        for c in new:
            (plain if NO_SPACE(c) else odd).append(c)
        for at in range(0, len(plain), 4000):
            some = plain[at : at + 4000]
            ids = np.asarray(self.fast.encode_to_numpy(" " + "\n ".join(some) + "\n", disallowed_special=()), "<u4")
            ends = np.flatnonzero(ids == self.feed).tolist()
            data = ids.tobytes()
            young.update(zip(some, (data[4 * a + 4 : 4 * b] for a, b in zip([-1, *ends], ends))))
        for c in odd:
            young[c] = array("I", self.fast.encode_ordinary(" " + c)).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        whole = [any(s in t for s in self.special) for t in texts]
        cut = [[""] if w else self.parts(t) for w, t in zip(whole, texts)]
        self.learn(set().union(*(c[1:] for c in cut)))
        get = self.young.__getitem__
        first = self.fast.encode_ordinary
        return [
            self._ids(t) if w else array("I", first(c[0])).tobytes() + b"".join(map(get, c[1:])) for w, t, c in zip(whole, texts, cut)
        ]


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


class WordBpe:
    """BPE with word ends by speculation: propose by longest match, verify by pairs, merge the rest.

    A split of a word into tokens is what merging gives exactly if each token is what its own bytes
    merge into and each adjacent pair, merged alone, stays that pair. So a greedy longest match is
    proposed, all its adjacent pairs are tested at once over arrays, and only words with a failing
    pair go through merging in order of rank. Ids from ``first_merge`` on are in order of rank.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        self.normalize, self.pre = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        self.special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.text = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.rank: dict[tuple[str, str], int] = {}
        n = max(self.vocab.values()) + 1
        self.left, self.right = np.arange(n), np.arange(n)
        self.made = np.full(n, -1)  # rank of the merge that makes a token; -1: none does
        keys, out = [], []
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, (list, tuple)) else m.split(" ")
            self.rank[a, b] = r
            i, j, k = self.vocab[a], self.vocab[b], self.vocab[a + b]
            keys.append((i << 32) | j)
            out.append(r)
            if self.made[k] < 0:
                self.left[k], self.right[k], self.made[k] = i, j, r
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.asarray(keys)[order], np.asarray(out)[order]
        whole = self.made >= 0
        ok = np.ones(n, bool)
        ok[whole] = self.stay(self.left[whole], self.right[whole], self.made[whole])
        for k in np.argsort(self.made, kind="stable"):  # a part's rank comes before the whole's
            if self.made[k] >= 0:
                ok[k] &= ok[self.left[k]] and ok[self.right[k]]
        self.proposed = {s: i for s, i in self.vocab.items() if ok[i]}
        self.longest = max(map(len, self.proposed))
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}
        self.bytes = {b: c for b, c in enumerate(byte_characters()) if chr(b) != c}
        # A special token stands for itself; no pre-token can look like one, as none spans letters and signs.
        self.known = {s: (1, str(i), s) for s, i in self.special.items()}

    def stay(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the bytes of the tokens a and b leaves them apart, for many pairs at once.

        Going back in time, the last merge inside either token is undone, and each pair that then meets
        at the border must not have been merged before that point. ``limit``: only merges of lower rank
        count.
        """
        never = np.iinfo(np.int64).max
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        limit = np.full(len(a), never) if limit is None else limit.astype(np.int64).copy()
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = (x << 32) | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            clash = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit[live])
            good[live[clash]] = False
            # The younger of the two tokens is undone: on the left its right part meets the border, on the right its left part.
            ra, rb = self.made[x], self.made[y]
            undo = np.maximum(ra, rb)
            go = ~clash & (undo >= 0)
            live, x, y, ra, rb, undo = live[go], x[go], y[go], ra[go], rb[go], undo[go]
            on_a = ra > rb  # of the same token twice, the left one was merged first: the right one is undone first
            a[live] = np.where(on_a, self.right[x], x)
            b[live] = np.where(on_a, y, self.left[y])
            # Merges of one rank run from the left: one that crosses the border comes after a merge of that
            # rank inside the left token and before one inside the right token.
            limit[live] = np.minimum(limit[live], np.where(on_a, undo, undo + 1))
        return good

    def merge(self, word: str) -> list[int]:
        """The ids of a pre-token by merging in order of rank, the leftmost of equal pairs first."""
        get, never = self.rank.get, 1 << 60
        parts = [*word[:-1], word[-1] + self.end]
        if len(parts) > 48:
            return self._merge_long(parts)
        ranks = [get(p, never) for p in zip(parts, parts[1:])]
        while ranks and (r := min(ranks)) < never:
            i = ranks.index(r)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), never)
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), never)
        return [self.vocab[p] for p in parts]

    def _merge_long(self, parts: list[str]) -> list[int]:
        """The same by a heap over linked parts: n log n steps for n characters."""
        get, n = self.rank.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := get((a, b))) is not None]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i] if parts[i] == a else n  # parts that were merged away are empty
            if j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, "", after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := get((parts[x], parts[y]))) is not None:
                    heappush(heap, (r, x, parts[x], parts[y]))
        return [self.vocab[p] for p in parts if p]

    def propose(self, word: str) -> list[int]:
        """Longest match from the left over byte-level characters; the word's end belongs to its last one."""
        out, i, n, get = [], 0, len(word), self.proposed.get
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                t = get(word[i:j] + self.end if j == n else word[i:j])
                if t is not None:
                    out.append(t)
                    i = j
                    break
            else:
                return []
        return out

    def words(self, found: list[str]) -> None:
        """Put the ids of distinct pre-tokens into ``known``, with their decimal and decoded forms."""
        guess = [self.propose(w) for w in found]
        sizes = np.fromiter(map(len, guess), np.int64, len(guess))
        ids = np.fromiter((t for g in guess for t in g), np.int64, int(sizes.sum()))
        fails = sizes == 0
        if len(ids) > 1:
            of = np.repeat(np.arange(len(guess)), sizes)
            inner = np.flatnonzero(of[1:] == of[:-1])
            pairs, back = np.unique((ids[inner] << 32) | ids[inner + 1], return_inverse=True)
            kept = self.stay(pairs >> 32, pairs & 0xFFFFFFFF)[back]
            fails[of[inner[~kept]]] = True
        text = self.text
        for w, g, bad in zip(found, guess, fails.tolist()):
            own = self.merge(w) if bad else g
            self.known[w] = (len(own), " ".join(map(str, own)), " ".join([text[t] for t in own]))

    def pre_tokens(self, chunk: str) -> list[str]:
        """Lower-cased pre-tokens in byte-level characters."""
        if not chunk.isprintable():
            return [w for w, _ in self.pre(self.normalize(chunk))]
        if chunk.isascii():
            return LATIN.findall(chunk.lower())
        if max(chunk) < "\u0100":  # composed already, and each letter has one lower-case letter
            return [w if w.isascii() else w.encode().decode("latin-1").translate(self.bytes) for w in LATIN.findall(chunk.lower())]
        return [w for w, _ in self.pre(self.normalize(chunk))]

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, decimal ids joined by one space, decoded text) of each text."""
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.cache) > CACHE:
            self.cache, self.old = {}, self.cache
        if len(self.known) > CACHE:
            self.known = {s: (1, str(i), s) for s, i in self.special.items()}
        cache, known = self.cache, self.known
        new = set().union(*cut) - cache.keys()
        again = new & self.old.keys()
        cache.update(zip(again, map(self.old.__getitem__, again)))
        new = list(new - again)
        parts: list[list[str]] = []
        for c in new:
            if self.split_special and "<|" in c:
                parts.append([w for s in self.split_special.split(c) for w in ([s] if s in self.special else self.pre_tokens(s) if s else [])])
            else:
                parts.append(self.pre_tokens(c) if c else [])
        self.words(list({w for p in parts for w in p if w not in known}))
        for c, p in zip(new, parts):
            if len(p) == 1:
                cache[c] = known[p[0]]
            else:
                n, i, d = zip(*map(known.__getitem__, p)) if p else ((), (), ())
                cache[c] = (sum(n), " ".join(i), " ".join(d))
        get, out = cache.__getitem__, []
        for chunks in cut:
            found = [x for x in map(get, chunks) if x[0]]
            n, i, d = zip(*found) if found else ((), (), ())
            out.append((sum(n), " ".join(i), " ".join(d)))
        return out


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
