"""Jaccard join of word n-gram sets by prefix trees.

1. Every text becomes the set of its n-grams, as 56-bit tokens; equal sets share a 128-bit signature.
2. Tokens are dealt out by value and counted. What occurs in one set only can't be shared, so a set keeps a chance only if
   enough of its tokens occur in others.
3. The global order is from rare to frequent. Two sets that link share at least `extra` tokens of their first ones (as many as
   a set may lack, and `extra` more), its keys.
4. The sets left are dealt to blocks, alike ones together, and each block is joined by itself. Of the sets that are then known to hang
   together in a block, one represents them.
5. Which representatives share keys with which blocks of them is counted by key: a set meets a block only if it shares enough keys with
   the block's sets. For two blocks the sets that meet the other one come to one task, the components of all representatives are made.
6. What is left are pairs of sets of which one at least represents nobody. Blocks are met in the same way, but keys only count
   between sets not yet in one component. So a large group of near copies costs what its blocks cost, not what its pairs would.
7. Two blocks are joined by a trie, frequent tokens first; it is traversed once with a vector of overlaps with the other sets, which all sets
   below a node share, and a subtree is left out when no set can reach the overlap it still needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from .arrow import give_back, slices
from .blocks import bucket_count, cells, joined, pack, packed_batch, unpack
from .components import connected_components
from .shingles import TOKEN_BITS, mixed, set_signatures, shingle_tokens, text_bytes

#: Sets in a block; a task holds two blocks at most.
BLOCK = 2048
#: Tokens a map task gathers before it sends blocks, and bytes and texts in a slice.
GATHER, SLICE, TEXTS = 2_000_000, 2 << 20, 30_000
#: Documents at most that are looked at for tokens of more than one in HOT documents, whose entries need not be counted.
SAMPLE, HOT = 4_000, 100
#: Pairs (set, block) that are counted together.
COUNTED = 2_000_000
LOW = np.uint64((1 << TOKEN_BITS) - 1)


def needed(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least overlap of a set of this size with any set it links with."""
    return -(-num * size // den)


def extra(size: np.ndarray) -> np.ndarray:
    """Tokens by which a set's keys are more than it may lack."""
    return np.maximum(size // 20, 1)


def _text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            for k in range(0, part.num_rows, TEXTS):
                yield part.slice(k, TEXTS)


def _signature_column(sig: np.ndarray) -> pa.Array:
    return cells(sig.tobytes(), np.arange(len(sig) + 1) * 16)


def sign_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, sig) of docs (doc_id, text without nulls)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text_slices(batches):
            tokens, owner = shingle_tokens(*text_bytes(part.column("text")), width)
            size, sig = set_signatures(tokens, owner, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), _signature_column(sig)], ["doc_id", "n_shingles", "sig"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, sig binary")


def frequent_tokens(docs: DataFrame, width: int, many: int) -> np.ndarray:
    """Tokens that a sample of documents shows to be in more than one in HOT. At most HOT times a text's tokens come to the driver.
    It decides where a token's entries go and where it stands in the global order, and has no effect on the result."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, many))) < SAMPLE)

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text_slices(batches):
            tokens, _ = shingle_tokens(*text_bytes(part.column("text")), width)
            found, often = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(often)], ["token", "n"])

    least = max(10, min(many, SAMPLE) // HOT)
    counted = some.select("text").mapInArrow(tokens_of, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") > least).select("token").toPandas()["token"]
    return np.sort(found.to_numpy(np.int64).astype(np.uint64))


ENTRIES = "bucket int, kind int, flush long, digest long, which binary, tokens binary, sigs binary, sizes binary"


def token_blocks(docs: DataFrame, width: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Packed entries (set, token), the set being a number within a flush of some million tokens. kind 0: dealt out by the
    token, to be counted; 1: frequent tokens, which aren't; 2: the sets of a flush. A flush is named by its partition and its number there;
    its digest, of all its sets in order, shows whether rows that name it mean the same sets."""
    names = [x.split()[0] for x in ENTRIES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, many = [], set(), 0
        name = (TaskContext.get().partitionId() + 1) << 32
        for part in _text_slices(batches):
            tokens, owner = shingle_tokens(*text_bytes(part.column("text")), width)
            size, sig = set_signatures(tokens, owner, part.num_rows)
            fresh = np.zeros(part.num_rows, bool)
            raw = sig.tobytes()
            for k in np.flatnonzero(size).tolist():
                s = raw[16 * k : 16 * k + 16]
                if s not in seen:
                    seen.add(s)
                    fresh[k] = True
            number = np.cumsum(fresh) - 1
            on = fresh[owner]
            held.append((tokens[on], number[owner[on]], sig[fresh], size[fresh]))
            many += int(on.sum())
            if many >= GATHER or len(seen) > TEXTS:
                yield from flush(held, name)
                held, seen, many, name = [], set(), 0, name + 1
        yield from flush(held, name)
        del held
        give_back()

    def flush(held: list, name: int) -> Iterator[pa.RecordBatch]:
        base = np.cumsum([0, *(len(h[2]) for h in held)])
        if not base[-1]:
            return
        tokens = np.concatenate([h[0] for h in held])
        which = np.concatenate([h[1] + b for h, b in zip(held, base, strict=False)])
        sigs, sizes = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
        place = np.arange(1, len(sigs) + 1, dtype=np.uint64)
        digest = int(np.add.reduce(mixed(sigs[:, 0] ^ mixed(sigs[:, 1] ^ mixed(place)))).view(np.int64))
        common = np.zeros(len(tokens), bool)
        if len(hot):
            common = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens
        home = int(mixed(np.array([name], np.uint64))[0] % np.uint64(buckets))
        rare = packed_batch((tokens[~common] % np.uint64(buckets)).astype(np.int64), {"which": (which[~common], 2), "tokens": (tokens[~common], 7)})
        rows = rare.num_rows
        none = pa.nulls(rows, pa.binary())
        yield pa.RecordBatch.from_arrays([rare.column(0), pa.array(np.zeros(rows, np.int32)), pa.array(np.full(rows, name)), pa.array(np.full(rows, digest)), *rare.columns[1:], none, none], names)
        yield pa.RecordBatch.from_arrays(
            [pa.array([home, home], pa.int32()), pa.array([1, 2], pa.int32()), pa.array([name, name]), pa.array([digest, digest]), *(pa.array(x, pa.binary()) for x in ([pack(which[common], 2), None], [pack(tokens[common], 7), None], [None, sigs.tobytes()], [None, pack(sizes, 5)]))],
            names,
        )

    return docs.mapInArrow(run, ENTRIES)


REPLIES = "flush long, digest long, which binary, values binary, sigs binary, sizes binary"


def shared_tokens(blocks: DataFrame) -> DataFrame:
    """Counts the tokens of each bucket; those of two entries or more go back to their flush, with a class of frequency before them."""
    names = [x.split()[0] for x in REPLIES.split(", ")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for k, kind in enumerate(batch.column("kind").to_pylist()):
                row = batch.slice(k, 1)
                if kind == 0:
                    held.append(((row.column("flush")[0].as_py(), row.column("digest")[0].as_py()), unpack(joined(row.column("which")), 2).astype(np.uint16), unpack(joined(row.column("tokens")), 7)))
                elif kind == 1:
                    values = unpack(joined(row.column("tokens")), 7) | np.uint64(255 << TOKEN_BITS)
                    yield pa.RecordBatch.from_arrays([row.column("flush"), row.column("digest"), row.column("which"), pa.array([values.tobytes()], pa.binary()), *[pa.nulls(1, pa.binary())] * 2], names)
                else:
                    yield pa.RecordBatch.from_arrays([row.column("flush"), row.column("digest"), *[pa.nulls(1, pa.binary())] * 2, row.column("sigs"), row.column("sizes")], names)
        if not held:
            return
        tokens = np.concatenate([h[2] for h in held])
        flush = np.repeat(np.arange(len(held), dtype=np.int32), [len(h[2]) for h in held])
        which = np.concatenate([h[1] for h in held])
        order = np.argsort(tokens)
        tokens = tokens[order]
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)
        often = np.diff(np.r_[starts, len(tokens)])
        level = np.minimum(np.floor(4 * np.log2(np.maximum(often, 1))), 254).astype(np.uint64)
        keep = np.repeat(often > 1, often)
        value = (np.repeat(level, often) << np.uint64(TOKEN_BITS) | tokens)[keep]
        order = order[keep]
        if len(order):
            back = packed_batch(flush[order], {"which": (which[order], 2), "values": (value, 8)})
            of, digest = np.array([h[0] for h in held], np.int64)[back.column(0).to_numpy()].T
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(digest), *back.columns[1:], *[pa.nulls(back.num_rows, pa.binary())] * 2], names)
        del held
        give_back()

    return blocks.groupBy("bucket").applyInArrow(count, REPLIES)


def candidate_sets(shared: DataFrame, num: int, den: int) -> DataFrame:
    """(sig, size, tokens, n_keys, alike): sets with enough shared tokens, these in global order from rare to frequent. alike: the
    smallest hash of these tokens, by which sets that have much in common often agree."""

    def gather(group: pa.Table) -> pa.Table:
        if len(pc.unique(group.column("digest"))) > 1:
            raise ValueError("a partition came with its rows in another order: checkpoint the input")
        parts = group.filter(group.column("sigs").is_valid())
        sig = np.frombuffer(joined(parts.column("sigs")), np.uint64).reshape(-1, 2)
        size = unpack(joined(parts.column("sizes")), 5).astype(np.int64)
        entries = group.filter(group.column("which").is_valid())
        doc = unpack(joined(entries.column("which")), 2).astype(np.int64)
        value = np.frombuffer(joined(entries.column("values")), np.uint64)
        have = np.bincount(doc, minlength=len(size))
        keep = (have >= needed(size, num, den)) & (have > 0)
        on = keep[doc]
        doc, value = doc[on], value[on]
        order = np.argsort(value)
        doc, value = doc[order], value[order]
        order = np.argsort(doc.astype(np.uint16), kind="stable")
        doc, value = doc[order], value[order]
        kept = np.flatnonzero(keep)
        bounds = np.searchsorted(doc, np.r_[kept, len(size)])
        alike = np.minimum.reduceat(mixed(value & LOW), bounds[:-1]) if len(kept) else np.zeros(0, np.uint64)
        # the prefix less the tokens nobody else has, which come first in it
        keys = np.minimum(have - needed(size, num, den) + extra(size), have)[kept]
        return pa.table({"sig": _signature_column(sig[kept]), "size": size[kept], "tokens": cells(value.tobytes(), bounds * 8), "n_keys": keys, "alike": alike.view(np.int64)})

    return shared.groupBy("flush").applyInArrow(gather, "sig binary, size long, tokens binary, n_keys long, alike long")


def few(rows: DataFrame) -> DataFrame:
    """Small rows marked for broadcast if they are a million at most."""
    return F.broadcast(rows) if rows.count() <= 1_000_000 else rows


def place_in_blocks(sets: DataFrame) -> DataFrame:
    """Adds block: the sets of one slot together, unless they fill more than a block and are dealt on; and dealt: whether they are. If sets have
    that column already, slots dealt on before get blocks of other numbers (bit 23)."""
    full = sets.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    placed = sets.join(few(full), "slot", "left")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.coalesce("n", F.lit(1)) / (BLOCK // 2)))
    again = F.when(F.col("dealt"), F.lit(1 << 23)).otherwise(F.lit(0)) if "dealt" in sets.columns else F.lit(0)
    dealt = F.col("dealt") if "dealt" in sets.columns else F.col("n").isNotNull()
    return placed.withColumns({"block": F.col("slot") * (1 << 24) + again + part, "dealt": dealt}).drop("n")


def meetings(sets: DataFrame, buckets: int, num: int, den: int, skip: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(bucket, ids, homes, others, least, n): packed counts of keys that a set of block `home` shares with sets of fitting size of block
    `other`, dealt out by set, and how many keys a set that links with it shares at least. Keys of sets of one component don't count, nor those of two
    sets that stand for their components (column `first`). skip: which blocks have been joined with themselves."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.column("n_keys").to_numpy()
            token = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(t, np.uint64, n) for t, n in zip(batch.column("tokens").to_pylist(), count.tolist(), strict=True))])
            if len(token):
                cols = {c: np.repeat(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64), count) for c in ("id", "block", "size", "comp", "first")}
                size = cols["size"] * 2 + cols["first"]
                yield packed_batch((mixed(token) % np.uint64(buckets)).astype(np.int64), {"token": (token, 8), "id": (cols["id"], 7), "block": (cols["block"], 7), "size": (size, 5), "comp": (cols["comp"], 7)})

    def meet(group: pa.Table) -> pa.Table:
        token, of, block, size, comp = (unpack(joined(group.column(c)), w) for c, w in (("token", 8), ("id", 7), ("block", 7), ("size", 5), ("comp", 7)))
        of, block, size, comp = (x.astype(np.int64) for x in (of, block, size, comp))
        order = np.lexsort((block, token))
        token, of, block, comp = token[order], of[order], block[order], comp[order]
        size, alone = size[order] >> 1, size[order] & 1
        n = len(token)
        # of each key its blocks, with the sizes and components of their sets
        first = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (block[1:] != block[:-1])])
        smallest, largest, sets_in = np.minimum.reduceat(size, first), np.maximum.reduceat(size, first), np.diff(np.r_[first, n])
        least_comp, most_comp, only_first = np.minimum.reduceat(comp, first), np.maximum.reduceat(comp, first), np.minimum.reduceat(alone, first)
        key_first = np.flatnonzero(np.r_[True, token[first[1:]] != token[first[:-1]]])
        cell_of = np.repeat(np.arange(len(first)), sets_in)
        key_of_cell = np.repeat(np.arange(len(key_first)), np.diff(np.r_[key_first, len(first)]))
        width = np.diff(np.r_[key_first, len(first)])[key_of_cell[cell_of]]
        joined_blocks = skip(block[first])
        found = []
        ends = np.cumsum(width)
        edges = np.unique(np.r_[0, np.searchsorted(ends, np.arange(COUNTED, ends[-1] + COUNTED, COUNTED)), n])
        for a, b in zip(edges, edges[1:], strict=False):
            w = width[a:b]
            entry = np.repeat(np.arange(a, b), w)
            cell = np.arange(len(entry)) - np.repeat(np.cumsum(w) - w, w) + key_first[key_of_cell[cell_of[entry]]]
            fits = (smallest[cell] * num <= size[entry] * den) & (size[entry] * num <= largest[cell] * den)
            fits &= (cell != cell_of[entry]) | ((sets_in[cell] > 1) & ~joined_blocks[cell])
            fits &= (least_comp[cell] != comp[entry]) | (most_comp[cell] != comp[entry])
            fits &= (only_first[cell] == 0) | (alone[entry] == 0)
            entry, cell = entry[fits], cell[fits]
            other = block[first[cell]]
            order = np.lexsort((other, of[entry]))
            i, o = of[entry][order], other[order]
            if len(i):
                k = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (o[1:] != o[:-1])])
                e = entry[order][k]
                # a set that links with this one has as many keys more as one of the least fitting size has
                found.append((i[k], block[e], o[k], extra(needed(size[e], num, den)), np.diff(np.r_[k, len(i)])))
        cols = [np.concatenate(x) for x in zip([np.zeros(0, np.int64)] * 5, *found, strict=True)]
        return pa.Table.from_batches([packed_batch(cols[0] % buckets, dict(zip(("ids", "homes", "others", "least", "n"), zip(cols, (7, 7, 7, 4, 4), strict=True), strict=True)))])

    sent = sets.select("id", "block", "size", "tokens", "n_keys", "comp", "first").mapInArrow(send, "bucket int, token binary, id binary, block binary, size binary, comp binary")
    return sent.groupBy("bucket").applyInArrow(meet, "bucket int, ids binary, homes binary, others binary, least binary, n binary")


def met_sets(sets: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    """(low, high, home, id, size, tokens): each set once for each block that it shares enough keys with, with the two blocks."""
    rows = sets.select(F.pmod("id", F.lit(buckets)).cast("int").alias("bucket"), "id", "size", "tokens")

    def pick(table_: pa.Table, packed: pa.Table) -> pa.Table:
        of, home, other, least, n = (unpack(joined(packed.column(c)), w).astype(np.int64) for c, w in (("ids", 7), ("homes", 7), ("others", 7), ("least", 4), ("n", 4)))
        order = np.lexsort((other, of))
        of, home, other, least, n = of[order], home[order], other[order], least[order], n[order]
        k = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (other[1:] != other[:-1])]) if len(of) else np.zeros(0, np.int64)
        enough = k[np.add.reduceat(n, k) >= least[k]] if len(k) else k
        known = table_.column("id").to_numpy()
        by_id = np.argsort(known)
        at = by_id[np.searchsorted(known[by_id], of[enough])] if len(enough) else enough
        low, high = np.minimum(home, other)[enough], np.maximum(home, other)[enough]
        found = table_.select(["id", "size", "tokens"]).take(pa.array(at, pa.int64()))
        return pa.table({"low": low, "high": high, "home": home[enough], **{c: found.column(c) for c in found.column_names}})

    return rows.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(pick, "low long, high long, home long, id long, size long, tokens binary")


class Overlaps:
    """Adds up, for a run of tokens, how many of them each of a row of sets holds."""

    def __init__(self, owner: np.ndarray, token: np.ndarray, sets: int, tokens: int):
        order = np.argsort(token, kind="stable")
        self.owner, self.sets = owner[order], sets
        self.bounds = np.searchsorted(token[order], np.arange(tokens + 1))
        often = np.diff(self.bounds)
        frequent = np.flatnonzero(often * 16 >= sets)
        self.row = np.full(tokens, -1)
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), sets), np.uint8)
        sorted_token = token[order]
        on = self.row[sorted_token] >= 0
        self.dense[self.row[sorted_token[on]], self.owner[on]] = 1

    def of(self, run: np.ndarray) -> np.ndarray:
        rows = self.row[run]
        out = np.add.reduce(self.dense[rows[rows >= 0]], axis=0, dtype=np.int32)
        rare = run[rows < 0]
        if len(rare):
            count = self.bounds[rare + 1] - self.bounds[rare]
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.bounds[rare], count)
            out += np.bincount(self.owner[place], minlength=self.sets).astype(np.int32)
        return out


def trie_links(left: list[np.ndarray], left_size: np.ndarray, right: list[np.ndarray], right_size: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, the right sets that left set i links with) for every left set with a link, itself included if it's there.

    Sets are arrays of shared tokens in global order; the sizes count all tokens. Links: den * overlap >= num * union.
    """
    count_l, count_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    known, back = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    token = len(known) - 1 - back  # frequent tokens first
    cut_at = count_l.sum()
    overlaps = Overlaps(np.repeat(np.arange(len(right)), count_r), token[cut_at:], len(right), len(known))
    ends = np.cumsum(count_l)
    paths = [token[e - c : e][::-1] for e, c in zip(ends.tolist(), count_l.tolist(), strict=True)]
    order = sorted(range(len(left)), key=lambda i: paths[i].astype(">u4").tobytes())
    common = np.zeros(len(left) + 1, np.int64)
    for k in range(1, len(order)):
        a, b = paths[order[k - 1]], paths[order[k]]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        common[k] = differ[0] if len(differ) else n
    sizes, lengths = left_size[order], count_l[order]
    stack = [(0, len(order), 0, np.zeros(len(right), np.int32))]
    while stack:
        low, high, depth, partial = stack.pop()
        rest = int(lengths[low:high].max()) - depth
        smallest = int(sizes[low:high].min())
        reach = partial + np.minimum(rest, count_r - partial)
        if not (reach * (num + den) >= num * (smallest + right_size)).any():
            continue  # no set below this node can link with any of the right ones
        down = int(common[low + 1 : high].min()) if high - low > 1 else int(lengths[low])
        if down > depth:
            partial = partial + overlaps.of(paths[order[low]][depth:down])
            depth = down
        start = low
        while start < high and lengths[start] == depth:
            hit = partial.astype(np.int64) * (num + den) >= num * (sizes[start] + right_size)
            if hit.any():
                yield order[start], np.flatnonzero(hit)
            start += 1
        if start < high:
            borders = [start, *(np.flatnonzero(common[start + 1 : high] == depth) + start + 1).tolist(), high]
            stack += [(a, b, depth, partial) for a, b in zip(borders, borders[1:], strict=False)]


def linked(own: list[np.ndarray], size: np.ndarray, left: slice, right: slice, num: int, den: int) -> np.ndarray:
    """For each set the first one of those that links of left and right sets join it with."""
    root = np.arange(len(own))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if own[left] and own[right]:
        for i, found in trie_links(own[left], size[left], own[right], size[right], num, den):
            mine = top(left.start + i)
            for t in {top(int(r)) for r in np.unique(root[found + right.start]).tolist()}:
                low, high = min(mine, t), max(mine, t)
                root[high] = low
                mine = low
    return np.array([top(k) for k in range(len(own))], np.int64)


def block_components(placed: DataFrame, num: int, den: int) -> DataFrame:
    """(id, comp) of every set that links of its own block join with one of smaller id, comp being the smallest."""

    def join(group: pa.Table) -> pa.Table:
        of = group.column("id").to_numpy()
        order = np.argsort(of)
        tokens = group.column("tokens").to_pylist()
        every = slice(0, len(of))
        tops = linked([np.frombuffer(tokens[k], np.uint64) for k in order.tolist()], group.column("size").to_numpy()[order], every, every, num, den)
        moved = tops != np.arange(len(of))
        return pa.table({"id": of[order][moved], "comp": of[order][tops[moved]]})

    return placed.select("id", "size", "tokens", "block").groupBy("block").applyInArrow(join, "id long, comp long")


def trie_join(met: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): for each two linked sets of two blocks a chain of edges that joins them."""

    def join(group: pa.Table) -> pa.Table:
        cols = {c: group.column(c).to_numpy() for c in ("id", "low", "high", "home", "size")}
        same = cols["low"][0] == cols["high"][0]
        order = np.lexsort((cols["id"], cols["home"]))
        cols = {c: v[order] for c, v in cols.items()}
        tokens = group.column("tokens").to_pylist()
        own = [np.frombuffer(tokens[k], np.uint64) for k in order.tolist()]
        many = len(own)
        split = many if same else int((cols["home"] == cols["low"]).sum())
        left, right = (slice(0, many), slice(0, many)) if same else (slice(0, split), slice(split, many))
        tops = linked(own, cols["size"], left, right, num, den)
        moved = tops != np.arange(many)
        return pa.table({"a": cols["id"][moved], "b": cols["id"][tops[moved]]})

    return met.groupBy("low", "high").applyInArrow(join, "a long, b long")


def set_components(sets: DataFrame, buckets: int, num: int, den: int) -> DataFrame:
    """(id, comp) of the sets (id, slot, size, tokens, n_keys): comp is one id for all sets that links join."""
    placed = place_in_blocks(sets)
    inside = cut(block_components(placed, num, den))
    # first: sets that stand for their component
    known = placed.join(few(inside), "id", "left").withColumns({"first": F.col("comp").isNull(), "comp": F.coalesce("comp", "id")})
    # here each stands for itself, so that the pairs of all of them are asked for
    stand = place_in_blocks(known.where("first").drop("block")).withColumn("first", F.lit(False))
    joined_already = lambda block: (block >> 23) & 1 == 0
    between = cut(trie_join(met_sets(stand, meetings(stand, buckets, num, den, joined_already), buckets), num, den))
    wider = known
    if not between.isEmpty():
        tops = connected_components(between).select(F.col("node").alias("comp"), "root")
        wider = known.join(few(cut(tops)), "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")
    labels = cut(wider.select("id", "comp"))
    if inside.isEmpty():
        return labels
    rest = cut(trie_join(met_sets(wider, meetings(wider, buckets, num, den, lambda block: np.ones(len(block), bool)), buckets), num, den))
    if rest.isEmpty():
        return labels
    of = lambda c: labels.select(F.col("id").alias(c), F.col("comp").alias(f"{c}_comp"))
    edges = rest.join(of("a"), "a").join(of("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
    last = cut(connected_components(edges).select(F.col("node").alias("comp"), "root"))
    return labels.join(few(last), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))


def steady(df: DataFrame) -> DataFrame:
    """df, checkpointed if its rows have come through a shuffle: a task that is run again would get them in another order."""
    return cut(df) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def ngram_jaccard_join(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    Sets: distinct shingles of `width` words, A-Z as a-z; the whole text's words as one if there are fewer. Two documents link
    if den * |intersection| >= num * |union|. component_id: the smallest id that links lead to. Null, empty and blank texts have no shingle
    and link with nothing; rows of equal texts link with each other, also if their ids are equal. Null ids count as one id
    below all others. An empty table gives no rows. Texts may be as long as a value of Spark; their sets are held one batch at
    a time. Further columns are ignored.
    """
    plain = steady(docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    signed = cut(sign_sets(plain, width))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("there"), "doc_id")).alias("first")
    copies = signed.where("n_shingles > 0").groupBy("sig").agg(first)
    total = signed.agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("tokens")).first()
    buckets = bucket_count(docs.sparkSession, total["tokens"] or 0, GATHER // 2)
    hot = frequent_tokens(plain, width, total["docs"])
    shared = shared_tokens(token_blocks(plain, width, buckets, hot))
    slots = max(1, copies.count() // (2 * BLOCK))  # about half of the sets are candidates at most
    found = candidate_sets(shared, num, den).dropDuplicates(["sig"])
    # rows of a checkpoint keep their places, so their numbers are the same whenever they are made
    sets = cut(found.withColumn("slot", F.pmod(F.xxhash64("alike"), F.lit(slots))).drop("alike")).withColumn("id", F.monotonically_increasing_id())
    named = sets.select("id", "sig").join(set_components(sets.drop("sig"), buckets, num, den), "id").select("sig", "comp")
    known = copies.join(named, "sig", "left")
    firsts = known.where("comp is not null").groupBy("comp").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = known.join(few(cut(firsts)), "comp", "left").select("sig", F.coalesce("least", "first")["doc_id"].alias("least"))
    out = signed.join(groups, "sig", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), width=4, num=85, den=100)
