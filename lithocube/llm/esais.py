"""Suffix and common-prefix arrays by external induced sorting.

Suffixes are L (greater than the next one) or S. Those of kind S after an L, the starred ones, are sorted first: the pieces of
text between them get names in order, and the text of names, a third as long, is sorted by recursion until all names differ.
From the starred suffixes all L suffixes are induced in ascending order, from these all S suffixes in descending order: a
monotone priority queue gives suffix tuples in order, and each popped suffix pushes the one before it, if that is of the kind
wanted. A tuple carries its common prefix with the tuple pushed before it for the same symbol: one more than the least common
prefix of the suffixes popped in between.

The queue holds tuples in bins of symbols, each of a bounded number of tuples or of one symbol. A bin of several symbols is
popped at once: suffixes that it pushes to itself are chains which end at tuples that are there already, so their order and
common prefixes follow from pointers that double. A bin of one symbol is popped in order of arrival, piece by piece.

Memory: tuples beyond the queue's share go to disk as runs dealt out by bin; pieces are sorted in runs that are merged; every
array longer than its share is a file mapped into memory, read and written in blocks, whose pages are given back to the
system between blocks. Files are scratch of one task, unlinked when they are made, in Spark's local folders.
"""

from __future__ import annotations

import mmap
import os
import tempfile
import weakref
from collections.abc import Iterator

import numpy as np

#: Bytes that one sort may hold in memory; a third is the queue's, an eighth may be one array's.
MEMORY = 128 << 20


def scratch_folder() -> str | None:
    """One of the folders Spark's own spills go to, where the worker knows them."""
    folders = [f for f in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(f)]
    return folders[os.getpid() % len(folders)] if folders else None


class Scratch:
    """Arrays and runs on disk for one sort."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.share = memory, memory // 8
        #: Entries of a block, and of a bin of several symbols: a block's arrays take some 200 bytes an entry.
        self.block = max(16, min(1 << 17, memory // 512))
        self.files, self.spilled, self.depth, self.touched = 0, 0, 0, 0
        self._maps: list[weakref.ref] = []
        self._out = None

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        if self._out is not None:
            self._out.close()

    def array(self, n: int, dtype) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.share:
            return np.zeros(n, dtype)
        with tempfile.TemporaryFile(dir=scratch_folder()) as f:
            return self.track(np.memmap(f, dtype, "w+", shape=(n,)))

    def track(self, made: np.memmap) -> np.memmap:
        self.files += 1
        self._maps.append(weakref.ref(made._mmap))
        return made

    def ease(self, entries: int) -> None:
        """After work on so many entries: gives mapped pages back now and then. They stay in their files."""
        self.touched += entries
        if self._maps and self.touched > 4 * self.block:
            self.touched = 0
            self._maps = [r for r in self._maps if r() is not None]
            for r in self._maps:
                if (m := r()) is not None:
                    m.madvise(mmap.MADV_DONTNEED)

    def write(self, *columns: np.ndarray) -> int:
        """Appends columns to the file of spilled runs; their place."""
        if self._out is None:
            self._out = tempfile.TemporaryFile(dir=scratch_folder())  # noqa: SIM115
        place = self._out.seek(0, 2)
        for c in columns:
            self._out.write(np.ascontiguousarray(c).data)
            self.spilled += c.nbytes
        return place

    def read(self, place: int, count: int, dtype) -> np.ndarray:
        self._out.seek(place)
        return np.frombuffer(self._out.read(count * np.dtype(dtype).itemsize), dtype)


class Pile:
    """Numbers that come in blocks, how many isn't known; in memory up to an array's share, then in a file."""

    def __init__(self, scratch: Scratch, dtype):
        self.scratch, self.dtype, self.held, self.size, self._file = scratch, np.dtype(dtype), [], 0, None

    def add(self, values: np.ndarray) -> None:
        values = np.ascontiguousarray(values, self.dtype)
        self.size += len(values)
        if self._file is None and self.size * self.dtype.itemsize > self.scratch.share:
            self._file = tempfile.TemporaryFile(dir=scratch_folder())  # noqa: SIM115
            for v in self.held:
                self._file.write(v.data)
            self.held = []
        if self._file is None:
            self.held.append(values)
        else:
            self._file.write(values.data)

    def all(self) -> np.ndarray:
        """All of them; nothing can be added any more."""
        if self._file is None:
            return np.concatenate([np.zeros(0, self.dtype), *self.held])
        with self._file as f:
            f.flush()
            return self.scratch.track(np.memmap(f, self.dtype, "r+", shape=(self.size,)))


class Tape:
    """Numbers appended in blocks, at most `most` of them."""

    def __init__(self, scratch: Scratch, most: int, dtype):
        self.whole, self.size, self.scratch = scratch.array(most, dtype), 0, scratch

    def add(self, values: np.ndarray) -> None:
        self.whole[self.size : self.size + len(values)] = values
        self.size += len(values)

    def all(self) -> np.ndarray:
        return self.whole[: self.size]

    def blocks(self) -> Iterator[np.ndarray]:
        for k in range(0, self.size, self.scratch.block):
            yield self.whole[k : min(self.size, k + self.scratch.block)]


class Sorter:
    """Pairs (key, item) in order of key; runs of sorted pairs go to disk and are merged block by block."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.most = scratch, max(64, scratch.memory // 64)
        self.held, self.many, self.runs = [], 0, []

    def push(self, key: np.ndarray, item: np.ndarray) -> None:
        self.held.append((key, item))
        self.many += len(key)
        if self.many >= self.most:
            key, item = self._sorted()
            self.runs.append([self.scratch.write(key, item), 0, len(key), item.dtype])

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        key, item = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.many = [], 0
        order = np.argsort(key)
        return key[order], item[order]

    def merged(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not self.runs:
            if self.held:
                yield self._sorted()
            return
        if self.held:
            key, item = self._sorted()
            self.runs.append([self.scratch.write(key, item), 0, len(key), item.dtype])
        piece = max(16, self.most // len(self.runs))
        front: list = [None] * len(self.runs)
        while True:
            limit = None
            for k, (place, at, size, kind) in enumerate(self.runs):
                if front[k] is None and at < size:
                    n = min(piece, size - at)
                    front[k] = (self.scratch.read(place + 8 * at, n, np.uint64), self.scratch.read(place + 8 * size + np.dtype(kind).itemsize * at, n, kind))
                    self.runs[k][1] += n
                if front[k] is not None and self.runs[k][1] < size:
                    limit = front[k][0][-1] if limit is None else min(limit, front[k][0][-1])
            now = []
            for k, f in enumerate(front):
                if f is not None:
                    cut = len(f[0]) if limit is None else int(np.searchsorted(f[0], limit, side="right"))
                    now.append((f[0][:cut], f[1][:cut]))
                    front[k] = (f[0][cut:], f[1][cut:]) if cut < len(f[0]) else None
            if not now:
                return
            key, item = (np.concatenate(x) for x in zip(*now, strict=True))
            order = np.argsort(key)
            yield key[order], item[order]

    def by_keys(self, keys: list) -> Iterator[np.ndarray]:
        """Items in order of their key and then of further keys, functions from items to 64-bit numbers."""
        for key, group in self.grouped():
            if isinstance(group, Tape) and keys:
                inner = Sorter(self.scratch)
                for block in group.blocks():
                    inner.push(keys[0](block), block)
                yield from inner.by_keys(keys[1:])
            elif isinstance(group, Tape):
                yield from group.blocks()
            else:
                yield group[np.lexsort([f(group) for f in reversed(keys)] + [key])]

    def grouped(self) -> Iterator[tuple[np.ndarray, np.ndarray | Tape]]:
        """Blocks that hold whole groups of equal keys; a group too large for that comes alone, its items as a tape."""
        key, item, large = np.zeros(0, np.uint64), None, None
        for k, i in self.merged():
            if large is not None:
                same = int(np.searchsorted(k, key[0], side="right"))
                large.add(i[:same])
                if same == len(k):
                    continue
                yield key, large
                k, i, large, item = k[same:], i[same:], None, None
            if item is not None:
                k, i = np.concatenate([key, k]), np.concatenate([item, i])
            last = int(np.searchsorted(k, k[-1], side="left"))
            if last:
                yield k[:last], i[:last]
            key, item = k[last:], i[last:]
            if len(item) > self.most:
                large = Tape(self.scratch, sum(r[2] for r in self.runs), item.dtype)
                large.add(item)
                key = key[:1]
        if large is not None:
            yield key, large
        elif item is not None:
            yield key, item


class SymbolQueue:
    """A monotone priority queue of tuples (symbol, place, common prefix): smallest symbol first, first in first out."""

    def __init__(self, borders: np.ndarray, kinds: tuple, scratch: Scratch):
        self.borders, self.bins, self.kinds, self.scratch = borders, len(borders) - 1, kinds, scratch
        self.plain = bool(borders[-1] == self.bins)
        self.parts: dict[int, list] = {}
        self.runs: list[tuple[int, int]] = []
        self.held = 0

    def push(self, symbol: np.ndarray, place: np.ndarray, common: np.ndarray) -> None:
        """Tuples in order of symbol and time."""
        if not len(symbol):
            return
        where = symbol if self.plain else np.searchsorted(self.borders, symbol, side="right") - 1
        edge = np.flatnonzero(where[1:] != where[:-1]) + 1
        edges = [0, *edge.tolist(), len(where)]
        for b, s, e in zip(where[edges[:-1]].tolist(), edges, edges[1:], strict=False):
            self.parts.setdefault(b, []).append((symbol[s:e], place[s:e], common[s:e]))
        self.held += symbol.nbytes + place.nbytes + common.nbytes
        if self.held > self.scratch.memory // 3:
            self._spill()

    def _spill(self) -> None:
        """Writes all tuples to disk as one run, dealt out by bin: the bins' bounds and the three columns."""
        bins = sorted(self.parts)
        count = np.zeros(self.bins + 1, np.int64)
        count[[b + 1 for b in bins]] = [sum(len(p[0]) for p in self.parts[b]) for b in bins]
        columns = [np.concatenate([p[c] for b in bins for p in self.parts[b]]).astype(k, copy=False) for c, k in enumerate(self.kinds)]
        self.runs.append((self.scratch.write(np.cumsum(count), *columns), len(columns[0])))
        self.parts, self.held = {}, 0

    def take(self, b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The tuples of bin b in blocks, in order of time."""
        most = self.scratch.block
        for place, size in self.runs:
            low, high = self.scratch.read(place + 8 * b, 2, np.int64).tolist()
            for k in range(low, high, most):
                at, block = place + 8 * (self.bins + 1), []
                for kind in self.kinds:
                    block.append(self.scratch.read(at + k * np.dtype(kind).itemsize, min(most, high - k), kind))
                    at += size * np.dtype(kind).itemsize
                yield tuple(block)
        parts = self.parts.pop(b, [])
        self.held -= sum(a.nbytes for p in parts for a in p)
        for first in range(0, len(parts), 4096):
            columns = [np.concatenate(x) for x in zip(*parts[first : first + 4096], strict=True)]
            for k in range(0, len(columns[0]), most):
                yield tuple(c[k : k + most] for c in columns)


def range_minima(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """min(values[left..right]) of each range, by tables of doubling width that end with the widest range."""
    out = np.empty(len(left), values.dtype)
    rest, table, width = np.arange(len(left)), values, 1
    while len(rest):
        now = right - left + 1 < 2 * width
        out[rest[now]] = np.minimum(table[left[now]], table[right[now] - width + 1])
        rest, left, right = rest[~now], left[~now], right[~now]
        if len(rest):
            table = np.minimum(table[:-width], table[width:])
            width *= 2
    return out


class Lows:
    """Common prefixes of popped suffixes, and their minima between two pushes of one symbol."""

    def __init__(self, symbols: int, scratch: Scratch):
        self.block = scratch.array(symbols, np.int64)  # one more than the number of the block of the last push
        self.tail = scratch.array(symbols, np.int32)
        self.count, self.ids, self.least = 0, [], []

    def between(self, common: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """For pushes from places `at` of the popped block, in order of symbol and place: the least common prefix since the
        push before for the same symbol, -1 for a symbol's first one."""
        first = np.ones(len(at), bool)
        np.not_equal(symbol[1:], symbol[:-1], out=first[1:])
        out = np.empty(len(at), np.int32)
        rest = np.flatnonzero(~first)
        out[rest] = range_minima(common, at[rest - 1] + 1, at[rest])
        k = np.flatnonzero(first)
        s = symbol[k]
        before = self.block[s] - 1
        value = np.minimum(self.tail[s], np.minimum.accumulate(common)[at[k]])
        if self.ids:  # blocks popped in between: a stack of rising minima
            place = np.searchsorted(np.array(self.ids), before, side="right")
            value = np.minimum(value, np.array([*self.least, np.iinfo(np.int32).max])[place])
        out[k] = np.where(before < 0, -1, value)
        return out

    def close(self, common: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> None:
        """The block is popped; notes each symbol's last push."""
        if len(at):
            final = np.ones(len(symbol), bool)
            np.not_equal(symbol[1:], symbol[:-1], out=final[:-1])
            last = np.flatnonzero(final)
            tails = np.full(len(common) + 1, np.iinfo(np.int32).max, np.int32)
            tails[:-1] = np.minimum.accumulate(common[::-1])[::-1]
            self.tail[symbol[last]] = tails[at[last] + 1]
            self.block[symbol[last]] = self.count + 1
        low = int(common.min())
        while self.least and self.least[-1] >= low:
            self.least.pop()
            self.ids.pop()
        self.ids.append(self.count)
        self.least.append(low)
        self.count += 1


class Level:
    """A text of symbols 1 .. symbols - 1 that ends in a virtual symbol 0. The text is filled in, then closed."""

    def __init__(self, n: int, kind, scratch: Scratch):
        self.n, self.kind, self.scratch = n, kind, scratch
        self.per = 8 // np.dtype(kind).itemsize
        self.text = scratch.array(n + 2 * self.per, kind)
        self.words = np.ndarray((n + self.per,), np.uint64, self.text, 0, (self.text.itemsize,))
        self.spread = sum(1 << (64 // self.per * k) for k in range(self.per))
        self.place = np.int32 if n < 2**31 - 1 else np.int64

    def close(self, symbols: int) -> Level:
        """Deals the symbols out to bins: one symbol each for small alphabets, about a block of text each for large ones."""
        self.symbols = symbols
        self.bits = symbols.bit_length()
        self.fit = 8 if self.kind == np.uint8 else min(8, 63 // self.bits)
        self.borders = np.arange(symbols + 1)
        if symbols > 256:
            count = self.scratch.array(symbols, np.int64)
            for k in range(0, self.n, self.scratch.block):
                found, often = np.unique(self.text[k : min(self.n, k + self.scratch.block)], return_counts=True)
                count[found] += often
                self.scratch.ease(len(found))
            edges, before = [np.zeros(1, np.int64)], 0
            for k in range(0, symbols, self.scratch.block):
                c = count[k : k + self.scratch.block]
                upto = before + np.cumsum(c)
                slot = (upto - c) // self.scratch.block
                fresh = np.ones(len(c), bool)
                fresh[1:] = slot[1:] != slot[:-1]
                large = np.flatnonzero(c > self.scratch.block)
                edges.append(k + np.unique(np.concatenate([np.flatnonzero(fresh), large, large + 1])))
                before = int(upto[-1])
            self.borders = np.unique(np.concatenate([*edges, [symbols]]))
        return self

    def runs(self, at: np.ndarray) -> np.ndarray:
        """How often the symbol at each place repeats from there on."""
        out, on = np.zeros(len(at), np.int64), np.arange(len(at))
        at = at.astype(np.int64)
        pattern = self.text[at].astype(np.uint64) * np.uint64(self.spread)
        while len(on):
            x = self.words[at] ^ pattern
            same = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // (64 // self.per)
            same = np.where(x == 0, self.per, same).astype(np.int64)
            out[on] += same
            more = (same == self.per) & (at + self.per < self.n)
            on, at, pattern = on[more], at[more] + self.per, pattern[more]
        return out

    def repeats(self, at: np.ndarray) -> np.ndarray:
        """How often the symbol at each place stands right before it."""
        out = np.zeros(len(at), np.int64)
        on = np.flatnonzero((at > 0) & (self.text[np.maximum(at - 1, 0)] == self.text[at]))
        at = at[on].astype(np.int64)
        symbol = self.text[at]
        pattern = symbol.astype(np.uint64) * np.uint64(self.spread)
        while len(on):
            x = self.words[np.maximum(at - self.per, 0)] ^ pattern
            for shift in (1, 2, 4, 8, 16, 32):
                x = x | x >> np.uint64(shift)
            same = ((64 - np.bitwise_count(x)) // (64 // self.per)).astype(np.int64)
            # near the begin one symbol at a time
            same = np.where(at >= self.per, same, (at > 0) & (self.text[np.maximum(at - 1, 0)] == symbol))
            out[on] += same
            more = np.where(at >= self.per, same == self.per, same == 1)
            on, at, pattern, symbol = on[more], (at - same)[more], pattern[more], symbol[more]
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at a and b share, by comparing."""
        out = np.zeros(len(a), np.int64)
        on = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(on):
            inside = np.maximum(a, b) < self.n
            on, a, b = on[inside], a[inside], b[inside]
            x = self.words[a] ^ self.words[b]
            same = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // (64 // self.per)
            same = np.where(x == 0, self.per, same).astype(np.int64)
            same = np.minimum(same, self.n - np.maximum(a, b))
            out[on] += same
            more = same == self.per
            on, a, b = on[more], a[more] + self.per, b[more] + self.per
        return out

    def key(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The next `fit` symbols as a number that sorts like them; all ones after the end of a piece, as a piece that ends in
        a star is greater than one that goes on there."""
        if self.kind == np.uint8:
            x = self.words[at].byteswap()
            past = (np.clip(length, 0, 8) * 8).astype(np.uint64)
            return np.where(past >= 64, x, x | (np.uint64(2**64 - 1) >> np.minimum(past, np.uint64(63))))
        out, ones = np.zeros(len(at), np.uint64), np.uint64((1 << self.bits) - 1)
        for k in range(self.fit):
            out = out << np.uint64(self.bits) | np.where(length > k, self.text[np.minimum(at + k, self.n)], ones).astype(np.uint64)
        return out

    def find_stars(self) -> Tape:
        """Places of the starred suffixes, and the end of the text."""
        found, last, fell = Tape(self.scratch, self.n // 2 + 2, self.place), -1, False
        for low in range(0, self.n, self.scratch.block):
            x = self.text[low : min(self.n, low + self.scratch.block) + 1]
            turns = np.flatnonzero(x[1:] != x[:-1])  # a run of one symbol ends here, as S if a greater one follows
            if len(turns):
                rises = x[turns + 1] > x[turns]
                starts = np.concatenate([[last + 1], turns[:-1] + low + 1])
                found.add(starts[rises & np.concatenate([[fell], ~rises[:-1]])])
                last, fell = int(turns[-1]) + low, not rises[-1]
            self.scratch.ease(len(x) // 64)
        found.add(np.array([self.n]))
        return found

    def ordered(self, stars: np.ndarray, items: Iterator[np.ndarray], done: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of stars in order of their pieces of text from symbol `done` on, and whether each differs from the one before."""
        sorter = Sorter(self.scratch)
        for item in items:
            at = stars[item].astype(np.int64)
            sorter.push(self.key(at + done, stars[item + 1] - at + 1 - done), item)
            self.scratch.ease(len(item))
        done += self.fit
        for key, group in sorter.grouped():
            if isinstance(group, Tape):
                first = group.whole[:1]
                if stars[first + 1][0] - stars[first][0] + 1 >= done:
                    yield from self.ordered(stars, group.blocks(), done)
                else:
                    for k, block in enumerate(group.blocks()):
                        fresh = np.zeros(len(block), bool)
                        fresh[0] = not k
                        yield block, fresh
            else:
                yield self._ties(stars, key, group, done)
                self.scratch.ease(len(group))

    def _ties(self, stars: np.ndarray, key: np.ndarray, order: np.ndarray, done: int) -> tuple[np.ndarray, np.ndarray]:
        """As `ordered`, for a block of stars in order of their pieces' first symbols."""
        fresh = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        order = order.copy()
        # places in the order where neighbours are still equal; a piece that ends here still differs from one that goes on
        active, group = np.arange(len(order)), np.cumsum(fresh)
        while True:
            tied = np.zeros(len(active), bool)
            np.equal(group[1:], group[:-1], out=tied[1:])
            tied[:-1] |= tied[1:]
            active, group = active[tied], group[tied]
            length = (stars[order[active] + 1] - stars[order[active]]).astype(np.int64) + 1
            on = length >= done
            active, group, length = active[on], group[on], length[on]
            if not len(active):
                return order, fresh
            sub = order[active]
            key = self.key(stars[sub].astype(np.int64) + done, length - done)
            again = np.lexsort((key, group))
            order[active], key = sub[again], key[again]
            split = np.ones(len(active), bool)
            np.not_equal(key[1:], key[:-1], out=split[1:])
            inside = np.zeros(len(active), bool)
            np.equal(group[1:], group[:-1], out=inside[1:])
            fresh[active[split & inside]] = True
            group = np.cumsum(split | ~inside)
            done += self.fit

    def sorted_stars(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starred suffixes in order, common prefix of each with the one before, how many there are in each bin)."""
        tape = self.find_stars()
        stars, many, block = tape.all(), tape.size - 1, self.scratch.block
        names, order = 0, Tape(self.scratch, many, self.place)
        below = Level(many, np.uint32, self.scratch)
        for item, fresh in self.ordered(stars, (np.arange(k, min(many, k + block), dtype=self.place) for k in range(0, many, block))):
            below.text[item] = names + np.cumsum(fresh)
            names += int(fresh.sum())
            order.add(item)
            self.scratch.ease(len(item))
        if names == many:
            del below
            reduced, shared = order.all(), None
        else:
            del order
            reduced, shared = sort_level(below.close(names + 1), depth + 1)
        seeds, common = Tape(self.scratch, many, self.place), Tape(self.scratch, many, np.int32)
        per_bin = np.zeros(len(self.borders) - 1, np.int64)
        for k in range(0, many, block):
            b = reduced[k : k + block].astype(np.int64)
            before = reduced[k - 1 : k] if k else [many]  # the first one is compared with the end
            a = np.concatenate([before, b[:-1]]).astype(np.int64)
            jump = shared[k : k + block].astype(np.int64) if shared is not None else 0
            value = stars[b + jump] - stars[b] + self.common(stars[np.minimum(a + jump, many)], stars[b + jump])
            at = stars[b]
            seeds.add(at)
            common.add(value)
            per_bin += np.bincount(np.searchsorted(self.borders, self.text[at], side="right") - 1, minlength=len(per_bin))
            self.scratch.ease(4 * len(b))
        return seeds.all(), common.all(), per_bin

    def induce(self, seeds: np.ndarray, common: np.ndarray, per_bin: np.ndarray, small: bool) -> Induction:
        """Suffixes of one kind in the order they are popped, each with its common prefix with the one popped before of the same
        symbol. Ascending L suffixes from starred ones, or descending S suffixes from L ones (`small`)."""
        return Induction(self, seeds, common, per_bin, small).run()


class Induction:
    """One pass of induced sorting. Symbols are turned round for the descending one, so that both ascend."""

    def __init__(self, level: Level, seeds: np.ndarray, common: np.ndarray, per_bin: np.ndarray, small: bool):
        self.level, self.seeds, self.common, self.small, self.scratch = level, seeds, common, small, level.scratch
        self.kind = np.uint8 if level.kind == np.uint8 else np.int64
        self.borders = level.symbols - level.borders[::-1] if small else level.borders
        self.per_bin = per_bin[::-1] if small else per_bin
        self.queue = SymbolQueue(self.borders, (self.kind, level.place, np.int32), self.scratch)
        self.lows = Lows(level.symbols, self.scratch)
        self.out, self.prefix = Tape(self.scratch, level.n, level.place), Tape(self.scratch, level.n + 1, np.int32)
        self.count, self.out_bin = self.scratch.array(level.symbols, np.int64), np.zeros(len(per_bin), np.int64)
        self.last = (-1, -1)  # symbol and place of the suffix popped last

    def symbol(self, at: np.ndarray) -> np.ndarray:
        found = self.level.text[at]
        return self.kind(self.level.symbols - 1) - found.astype(self.kind, copy=False) if self.small else found.astype(self.kind, copy=False)

    def run(self) -> Induction:
        level = self.level
        if not self.small:  # the virtual end comes first
            end, zero = self.symbol(np.array([level.n - 1])), np.zeros(1, np.int32)
            self.queue.push(end, np.array([level.n - 1], level.place), zero)
            self.lows.close(zero, np.zeros(1, np.int64), end)
        at = 0
        for b, many in enumerate(self.per_bin.tolist()):
            first, stop, before = int(self.borders[b]), int(self.borders[b + 1]), self.out.size
            if stop - first == 1:
                self.pop_symbol(b, first, at, at + many)
            else:
                self.pop_bin(b, stop, at, at + many)
            at += many
            self.out_bin[b] = self.out.size - before
        self.prefix.add(np.zeros(1, np.int32))
        if self.small:
            self.out_bin = self.out_bin[::-1]
        return self

    def emit(self, place: np.ndarray, prefix: np.ndarray, stop: int) -> np.ndarray:
        """Suffixes popped together push those before them that belong to later bins. The symbols before them."""
        before = np.maximum(place - 1, 0)
        pushed = self.symbol(before)
        at = np.flatnonzero((pushed >= stop) & (place > 0))
        key = pushed[at]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        if len(at):
            self.queue.push(key, before[at].astype(self.level.place, copy=False), self.lows.between(prefix, at, key) + np.int32(1))
        self.lows.close(prefix, at, key)
        self.scratch.ease(2 * len(place))
        return pushed

    def pop_symbol(self, b: int, symbol: int, low: int, high: int) -> None:
        """A bin of one symbol: tuples in order of arrival, their repeats step by step, then the seeds."""
        block, stop, again = self.scratch.block, symbol + 1, None
        gap, since = np.iinfo(np.int32).max, self.out.size
        for _, place, prefix in self.queue.take(b):
            pushed = self.emit(place, prefix, stop)
            self.out.add(place)
            self.prefix.add(prefix)
            repeated = np.flatnonzero((pushed == symbol) & (place > 0))
            if len(repeated):
                if again is None:
                    again = Repeats(self.scratch, self.level.n // 2 + 1, self.level.place)
                lowest = range_minima(prefix, np.concatenate([[0], repeated[:-1] + 1]), repeated)
                lowest[0] = min(int(lowest[0]), gap)
                again.add(place[repeated], self.level.repeats(place[repeated]), lowest)
                gap = np.iinfo(np.int32).max
                rest = prefix[repeated[-1] + 1 :]
            else:
                rest = prefix
            gap = min(gap, int(rest.min(initial=gap)))
            self.last = (symbol, int(place[-1]))
        if again is not None:
            for place, prefix in again.steps():
                self.emit(place, prefix, stop)
                self.out.add(place)
                self.prefix.add(prefix)
                self.last = (symbol, int(place[-1]))
        self.count[self.turned(symbol)] += self.out.size - since
        for k in range(low, high, block):
            place, prefix = self.seeds[k : min(high, k + block)], self.common[k : min(high, k + block)].copy()
            if k == low:
                prefix[0] = min(self.level.runs(np.array([self.last[1], place[0]])).tolist()) if self.last[0] == symbol else 0
            self.emit(place, prefix, stop)
            self.last = (symbol, int(place[-1]))

    def turned(self, symbol):
        return self.level.symbols - 1 - symbol if self.small else symbol

    def pop_bin(self, b: int, stop: int, low: int, high: int) -> None:
        """A bin of several symbols at once. What it pushes to itself are chains of suffixes, each before its parent; a chain ends
        at a tuple from the queue or a seed. Of one symbol, tuples from the queue come first, then chained ones in order of
        their parents, then seeds."""
        level = self.level
        taken = list(self.queue.take(b))
        if taken:
            arrived = [np.concatenate(x) for x in zip(*taken, strict=True)]
            order = np.argsort(arrived[0], kind="stable")
            symbol, place, carried = (x[order] for x in arrived)
        else:
            symbol, place, carried = np.zeros(0, np.int64), np.zeros(0, level.place), np.zeros(0, np.int32)
        seeds, given = self.seeds[low:high], self.common[low:high]
        n_arrived, n_fixed = len(place), len(place) + len(seeds)
        if not n_fixed:
            return
        symbols, places, parents = [symbol, self.symbol(seeds)], [place, seeds], [np.full(n_fixed, -1, np.int64)]
        head, at, of = np.arange(n_fixed), np.concatenate(places).astype(np.int64), np.concatenate(symbols)
        total, own = n_fixed, head < n_arrived
        while len(head):
            back = np.where(own, level.repeats(at), 0)
            more = int(back.sum())
            tip = head.copy()
            if more:
                which = np.repeat(np.arange(len(head)), back)
                ends = np.cumsum(back)
                step = np.arange(more) - np.repeat(ends - back, back) + 1
                symbols.append(of[which])
                places.append(at[which] - step)
                parents.append(np.where(step == 1, head[which], total + np.arange(more) - 1))
                tip[back > 0] = total + ends[back > 0] - 1
                total += more
            before = at - back - 1
            found = self.symbol(np.maximum(before, 0))
            on = np.flatnonzero((before >= 0) & (found > of) & (found < stop))
            symbols.append(found[on])
            places.append(before[on])
            parents.append(tip[on])
            head, at, of, own = total + np.arange(len(on)), before[on], found[on], np.ones(len(on), bool)
            total += len(on)
        symbol, place, parent = np.concatenate(symbols), np.concatenate(places).astype(np.int64), np.concatenate(parents)
        group = np.ones(total, np.int64)
        group[:n_arrived], group[n_arrived:n_fixed] = 0, 2
        key = symbol * 3 + group
        order = np.argsort(key, kind="stable")
        fresh = np.ones(total, bool)
        fresh[1:] = (key[order[1:]] != key[order[:-1]]) | (group[order[1:]] != 1)
        spot = np.arange(total)
        rank = np.empty(total, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, spot, 0))
        up = np.where(parent < 0, spot, parent)
        ranks, ups, active = [rank.copy()], [], spot
        while True:
            held = rank[order[active]]
            tied = np.zeros(len(active), bool)
            np.equal(held[1:], held[:-1], out=tied[1:])
            tied[:-1] |= tied[1:]
            active, held = active[tied], held[tied]
            ups.append(up)
            if not len(active):
                break
            some = order[active]
            above = rank[up[some]]
            again = np.argsort(held * total + above)
            order[active], held, above = some[again], held[again], above[again]
            split = np.ones(len(active), bool)
            split[1:] = (held[1:] != held[:-1]) | (above[1:] != above[:-1])
            rank[order[active]] = np.maximum.accumulate(np.where(split, active, 0))
            ranks.append(rank.copy())
            up = up[up]
        # common prefixes of neighbours: up both chains while they agree
        symbol, place = symbol[order], place[order]
        pair = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
        a, b_ = order[pair - 1], order[pair]
        shared = np.zeros(len(pair), np.int64)
        chained = np.flatnonzero((group[a] == 1) & (group[b_] == 1))
        u, v = a[chained], b_[chained]
        for k in range(len(ranks) - 1, -1, -1):
            same = ranks[k][u] == ranks[k][v]
            shared[chained] += np.where(same, 1 << k, 0)
            u, v = np.where(same, ups[k][u], u), np.where(same, ups[k][v], v)
        a[chained], b_[chained] = u, v
        whole = key[a] // 3 == key[b_] // 3
        kinds = group[a] * 3 + group[b_]
        for k, values, shift in ((0, carried, 0), (8, given, n_arrived)):
            on = np.flatnonzero(whole & (kinds == k))
            shared[on] += range_minima(values, a[on] - shift + 1, b_[on] - shift)
        shared[whole & (kinds == 1)] += 1  # their next symbols are in different bins
        on = np.flatnonzero(whole & ((kinds == 2) | (kinds == 5)))
        if len(on):
            every = np.concatenate(places)
            shared[on] += np.minimum(level.runs(every[a[on]]), level.runs(every[b_[on]]))
        prefix = np.zeros(total, np.int32)
        prefix[pair] = shared
        self.emit(place, prefix, stop)
        mine = np.flatnonzero(group[order] != 2)
        self.out.add(place[mine])
        self.prefix.add(prefix[mine])
        found, often = np.unique(symbol[mine], return_counts=True)
        self.count[self.turned(found)] += often
        self.last = (int(symbol[-1]), int(place[-1]))


class Repeats:
    """Suffixes of one symbol that stand after repeats of it; these are pushed for the same symbol one step after the other."""

    def __init__(self, scratch: Scratch, most: int, kind):
        self.scratch = scratch
        self.tapes = [Tape(scratch, most, kind), Tape(scratch, most, np.int64), Tape(scratch, most, np.int32)]

    def add(self, place: np.ndarray, back: np.ndarray, gap: np.ndarray) -> None:
        """gap: the least common prefix of those popped since the suffix added before."""
        for t, x in zip(self.tapes, (place, back, gap), strict=True):
            t.add(x)

    def steps(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, common prefix with the one before) of all repeats, one step back for each that has one, and so on. After t steps
        two of them share t symbols more than at first, and the first of a step shares t with the one before it."""
        now, step = self, 1
        while now.tapes[0].size > self.scratch.block:
            after, least, first = Repeats(self.scratch, now.tapes[0].size, now.tapes[0].whole.dtype), np.iinfo(np.int32).max, True
            for place, back, gap in zip(*(t.blocks() for t in now.tapes), strict=True):
                prefix = gap + np.int32(step)
                if first:
                    prefix[0], first = step, False
                yield place - step, prefix
                on = np.flatnonzero(back > step)
                rest = gap
                if len(on):
                    lowest = range_minima(np.ascontiguousarray(gap), np.concatenate([[0], on[:-1] + 1]), on)
                    lowest[0], least = min(int(lowest[0]), least), np.iinfo(np.int32).max
                    after.add(place[on], back[on], lowest)
                    rest = gap[on[-1] + 1 :]
                least = min(least, int(rest.min(initial=least)))
            now, step = after, step + 1
        place, back, gap = (t.all().copy() for t in now.tapes)
        while len(place):
            # as many steps as make about a block
            left = np.sort(back)
            size, ahead = 0, step
            while size < self.scratch.block and ahead <= left[-1]:
                alive = len(left) - int(np.searchsorted(left, ahead))
                # up to the next end of a run nothing changes
                until = int(left[len(left) - alive])
                ahead_by = max(1, min(until - ahead + 1, (self.scratch.block - size) // alive))
                size, ahead = size + alive * ahead_by, ahead + ahead_by
            count = np.minimum(back, ahead - 1) - step + 1
            index = np.repeat(np.arange(len(place)), count)
            at = np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count) + step
            order = np.lexsort((index, at))
            index, at = index[order], at[order]
            prefix = at.astype(np.int32)
            k = np.flatnonzero(at[1:] == at[:-1]) + 1
            prefix[k] += range_minima(gap, index[k - 1] + 1, index[k])
            yield place[index] - at.astype(place.dtype), prefix
            on = np.flatnonzero(back >= ahead)
            if len(on):
                gap = range_minima(gap, np.concatenate([[0], on[:-1] + 1]), on)
            place, back, step = place[on], back[on], ahead


def sort_level(level: Level, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(all suffixes of a level in order, common prefix of each with the one before)."""
    scratch = level.scratch
    scratch.depth = max(scratch.depth, depth)
    large = level.induce(*level.sorted_stars(depth), small=False)
    # the other way round, and each with the next greater one
    small = level.induce(large.out.all()[::-1], large.prefix.all()[1:][::-1], large.out_bin, small=True)
    out, lcp = scratch.array(level.n, level.place), scratch.array(level.n, np.int32)
    # of one symbol all L suffixes come before all S suffixes
    counts = [(low, large.count[low : low + scratch.block], small.count[low : low + scratch.block]) for low in range(0, level.symbols, scratch.block)]
    shift, sums = [scratch.array(level.symbols, np.int64) for _ in range(2)], [0, 0]
    for low, cl, cs in counts:
        upto = sums[0] + np.cumsum(cl), sums[1] + np.cumsum(cs)
        shift[0][low : low + len(cl)], shift[1][low : low + len(cl)] = upto[1] - cs, upto[0]
        sums = [int(upto[0][-1]), int(upto[1][-1])]
    parts = ((large.out.all(), large.prefix.all()), (small.out.all()[::-1], small.prefix.all()[1:][::-1]))
    for (places, values), by in zip(parts, shift, strict=True):
        for k in range(0, len(places), scratch.block):
            part = places[k : k + scratch.block]
            at = np.arange(k, k + len(part)) + by[level.text[part]]
            out[at], lcp[at] = part, values[k : k + len(part)]
            scratch.ease(2 * len(part))
    for low, cl, cs in counts:
        border = shift[1][low : low + len(cl)] + shift[0][low : low + len(cl)]  # where the symbol's S suffixes begin
        lcp[(border - cl)[cl + cs > 0]] = 0
        both = border[(cl > 0) & (cs > 0)]
        lcp[both] = np.minimum(level.runs(out[both - 1]), level.runs(out[both]))
        scratch.ease(len(cl))
    return out, lcp


def suffix_lcp(data: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common-prefix array) of bytes. Peak memory besides mapped files is a few times `scratch.memory`."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    blocks = range(0, len(data), scratch.block)
    present = sum(np.bincount(data[k : k + scratch.block], minlength=256) for k in blocks) > 0
    code = np.cumsum(present)
    symbols = int(code[-1]) + 1
    level = Level(len(data), np.uint8 if symbols < 255 else np.uint32, scratch)
    for k in blocks:
        level.text[k : k + len(data[k : k + scratch.block])] = code[data[k : k + scratch.block]]
        scratch.ease(scratch.block // 64)
    return sort_level(level.close(symbols))
