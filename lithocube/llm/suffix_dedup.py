"""Exact removal of long byte strings that repeat, by suffix arrays.

1. Every window of `length` bytes is put under its minimizer, the smallest hash of its short substrings: equal windows share it.
   Neighbouring windows with the same minimizer are one run. Minimizers that occur once in the corpus rule their windows out.
2. The runs left go, as strings with their places, to shards by minimizer, so that equal windows meet in one shard.
3. Each shard streams its strings to scratch files, puts them in order of document and place, and sorts their suffixes with
   `esais`. In that order windows with a common prefix of `length` bytes or more are equal; the first place stays, all
   others are removed.
4. Each document cuts the bytes of its removed windows.

Equal texts are one text up to the last step: every window of a later copy starts earlier in the first one. Copies need their
text's digest only, so they are found by aggregation and take no part in the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .arrow import give_back, slices
from .blocks import bucket_count, cells, joined, pack, packed_batch, unpack
from .esais import MEMORY, Pile, Scratch, Sorter, suffix_lcp
from .shingles import _BASE, _BYTE, mixed, text_bytes

SEED = 32  # bytes of the substrings that minimizers are taken from, less for shorter windows
#: Runs a map task gathers before it sends blocks, bytes of a slice, and bytes of text that a bucket stands for.
GATHER, SLICE, BUCKET_BYTES = 1_500_000, 2 << 20, 4 << 20
DIGEST = 16
#: Digests a map task remembers; when they are more it starts anew, and sends texts again.
SEEN = 1_000_000
#: A text with more than one in HOT of all documents as copies is frequent: there are fewer than HOT of these, which can be broadcast.
HOT = 10_000
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_HIGH = np.uint64(0xFFFFFFFF00000000)
_SIGN = np.uint64(1 << 63)


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, text number, first window's start in its text, windows) of the runs of windows of texts laid end to end."""
    n, width = len(data), length - seed + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return np.zeros(0, np.uint64), none, none, none
    powers = np.cumprod(np.full(n, _BASE, np.uint64))
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * powers, out=sums[1:])
    hashes = mixed((sums[seed:] - sums[:-seed]) * np.cumprod(np.full(n - seed + 1, _BACK, np.uint64)))
    del sums, powers
    # the smallest hash, the leftmost of equals: two places of one substring are two minimizers
    least, have = (hashes & _HIGH) | np.arange(len(hashes), dtype=np.uint64), 1
    while have < width:
        more = min(have, width - have)
        least = np.minimum(least[:-more], least[more:])
        have += more
    # least[i]: for the window that starts at byte i; those that cross a border of texts don't count
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.any():
        return np.zeros(0, np.uint64), none, none, none
    text = np.repeat(np.arange(len(sizes)), windows)
    start = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = (least[np.repeat(offsets[:-1], windows) + start] & ~_HIGH).astype(np.int64)
    fresh = np.ones(len(text), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    return hashes[place[first]], text[first], start[first], np.diff(np.concatenate([first, [len(text)]]))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, "text", SLICE)


def _digests(column: pa.Array) -> list[bytes]:
    return [hashlib.sha256(x.as_buffer() if x.as_buffer() is not None else b"").digest()[:DIGEST] for x in column]


def _halves(data: bytes) -> np.ndarray:
    """Digests as rows of two numbers."""
    return np.frombuffer(data, "<u8").reshape(-1, 2)


RUNS = "digests binary, hashes binary, starts binary, counts binary"


def run_blocks(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """(bucket, known, runs): packed runs, dealt out by minimizer. Minimizers that a task has met in two places are known to repeat:
    their runs (known = 1) are dealt out by text, so that a frequent one isn't one task's work, and only one entry without
    windows goes to the minimizer's bucket and tells the others."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        base = np.cumsum([0, *(len(h[0]) for h in held)])
        digests = _halves(b"".join(d for h in held for d in h[0]))
        which = np.concatenate([h[2] + b for h, b in zip(held, base, strict=False)])
        hashes, starts, counts = (np.concatenate([h[k] for h in held]) for k in (1, 3, 4))
        if not len(hashes):
            return
        order = np.argsort(hashes)
        again = np.zeros(len(order), bool)
        again[1:] = hashes[order[1:]] == hashes[order[:-1]]
        told = hashes[order[again]]
        again[:-1] |= again[1:]
        known = np.zeros(len(order), bool)
        known[order] = again
        told = np.unique(told)
        one, zero = ~known, np.zeros(len(told), np.int64)
        parts = [
            (0, np.concatenate([hashes[one], told]) % np.uint64(buckets), np.concatenate([digests[which[one]], np.zeros((len(told), 2), np.uint64)]), np.concatenate([hashes[one], told]), np.concatenate([starts[one], zero]), np.concatenate([counts[one], zero])),
            (1, digests[which[known], 0] % np.uint64(buckets), digests[which[known]], hashes[known], starts[known], counts[known]),
        ]
        for flag, bucket, d, h, s, c in parts:
            if len(h):
                batch = packed_batch(bucket.astype(np.int64), {"digests": (d, 16), "hashes": (h, 8), "starts": (s, 5), "counts": (c, 5)})
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, flag, np.int32)), *batch.columns[1:]], ["bucket", "known", *batch.schema.names[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, many = [], set(), 0
        for part in _parts(batches):
            digests = _digests(part.column("text"))
            keep = []
            for k, d in enumerate(digests):
                if d not in seen:
                    seen.add(d)
                    keep.append(k)
            column = part.column("text").take(pa.array(keep, pa.int64()))
            hashes, text, start, count = window_runs(*text_bytes(column), length, min(SEED, length))
            held.append(([digests[k] for k in keep], hashes, text, start, count))
            many += len(hashes)
            if many >= GATHER or len(seen) > SEEN:
                yield from flush(held)
                held, seen, many = [], set(), 0
        yield from flush(held)
        del held
        give_back()

    return texts.select("text").mapInArrow(run, f"bucket int, known int, {RUNS}")


def _columns(table_: pa.Table, hashes: bool = True) -> tuple[np.ndarray, ...]:
    """(digests as two numbers each, hashes if asked for, starts, counts) of packed runs."""
    wide = [unpack(joined(table_.column(c)), w) for c, w in ((("hashes", 8),) if hashes else ()) + (("starts", 5), ("counts", 5))]
    return _halves(joined(table_.column("digests"))), *wide[:-2], wide[-2].astype(np.int64), wide[-1].astype(np.int64)


def repeated_runs(blocks: DataFrame, buckets: int) -> DataFrame:
    """Runs whose minimizer occurs in more than one place, dealt out by their text's digest: (bucket, runs)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            known = batch.column("known").to_numpy() == 1
            plain = batch.select(["bucket", "digests", "hashes", "starts", "counts"])
            if known.any():
                yield plain.filter(pa.array(known))
            if not known.all():
                held.append(plain.filter(pa.array(~known)))
        if not held:
            return
        digests, hashes, starts, counts = _columns(pa.Table.from_batches(held))
        order = np.argsort(hashes)
        again = np.zeros(len(order), bool)
        again[1:] = hashes[order[1:]] == hashes[order[:-1]]
        again[:-1] |= again[1:]
        order = order[again]
        # a text that came from several tasks has its runs several times
        order = order[np.lexsort((starts[order], digests[order, 1], digests[order, 0], hashes[order]))]
        h, d, s = hashes[order], digests[order], starts[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1]).any(axis=1) | (s[1:] != s[:-1])
        order, h = order[fresh], h[fresh]
        twin = np.zeros(len(order), bool)
        twin[1:] = h[1:] == h[:-1]
        twin[:-1] |= twin[1:]
        order = order[twin]
        order = order[counts[order] > 0]
        if len(order):
            yield packed_batch((digests[order, 0] % np.uint64(buckets)).astype(np.int64), {"digests": (digests[order], 16), "hashes": (hashes[order], 8), "starts": (starts[order], 5), "counts": (counts[order], 5)})

    return blocks.groupBy("bucket").applyInArrow(count, f"bucket int, {RUNS}")


def text_rows(texts: DataFrame, buckets: int) -> DataFrame:
    """texts (doc_id, text, payload) with bucket and digest: a row with the text for each different text of a task, and where
    it has copies one without the text for the first of these by id and payload."""
    payload = [f for f in texts.schema if f.name not in ("doc_id", "text")]
    fields = ["doc_id", *(f.name for f in payload)]
    names = ["bucket", "digest", "doc_id", "text", *fields[1:]]
    schema = "bucket int, digest binary, doc_id long, text binary" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in payload)

    def made(digests: list[bytes], columns: list[pa.Array]) -> pa.RecordBatch:
        low = _halves(b"".join(digests))[:, 0]
        return pa.RecordBatch.from_arrays([pa.array((low % np.uint64(buckets)).astype(np.int32)), pa.array(digests, pa.binary()), *columns], names)

    def firsts(echoes: dict, types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        if echoes:
            values = [pa.array([row[k] for _, row in echoes.values()], t) for k, t in enumerate(types)]
            yield made(list(echoes), [values[0], pa.nulls(len(echoes), pa.binary()), *values[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        echoes: dict[bytes, tuple] = {}
        types: list[pa.DataType] = []
        for part in _parts(batches):
            types = [part.schema.field(n).type for n in fields]
            digests = _digests(part.column("text"))
            fresh, again = [], []
            for k, d in enumerate(digests):
                (again if d in seen else fresh).append(k)
                seen.add(d)
            if again:
                copies = part.take(pa.array(again, pa.int64()))
                rows = zip(*(copies.column(n).to_pylist() for n in fields), strict=True)
                for k, row in zip(again, rows, strict=True):
                    mine = (row_order(row), row)
                    if digests[k] not in echoes or mine[0] < echoes[digests[k]][0]:
                        echoes[digests[k]] = mine
            some = part.take(pa.array(fresh, pa.int64()))
            if fresh:
                yield made([digests[k] for k in fresh], [some.column("doc_id"), some.column("text").cast(pa.binary()), *(some.column(n) for n in fields[1:])])
            if len(seen) > SEEN:
                yield from firsts(echoes, types)
                seen, echoes = set(), {}
        yield from firsts(echoes, types)

    return texts.mapInArrow(run, schema)


def row_order(row: tuple) -> tuple:
    """Rows (id, payload) in Spark's order of structs: nulls first."""
    return tuple((x is not None, x) if x is not None else (False,) for x in row)


def _whole_texts(rows: pa.Table) -> tuple[dict[bytes, bytes], dict[bytes, int]]:
    """(text of each digest, row of the first document of each digest)."""
    texts, first = {}, {}
    others = [c for c in rows.column_names if c not in ("bucket", "digest", "text")]
    keys = [row_order(r) for r in zip(*(rows.column(c).to_pylist() for c in others), strict=True)]
    for k, (d, text) in enumerate(zip(rows.column("digest").to_pylist(), rows.column("text"), strict=True)):
        if text.is_valid and d not in texts:
            texts[d] = text.as_py()
        if d not in first or keys[k] < keys[first[d]]:
            first[d] = k
    return texts, first


def shard_strings(rows: DataFrame, runs: DataFrame, length: int, shards: int) -> DataFrame:
    """The bytes of repeated runs, by shard: (shard, gone, ids, digests, starts, counts, data).

    Runs of equal strings within a bucket of texts are sent once, the earliest; of the others only the places go on (gone = 1), and
    not to the shard of their string, as that might get them from everywhere. Null ids come before all others.
    """
    names = ["shard", "gone", "ids", "digests", "starts", "counts", "data"]
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]

    def cut_out(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not found.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names)
        here = int(found.column("bucket")[0].as_py()) % shards
        whole, first = _whole_texts(texts)
        ids = texts.column("doc_id").to_pylist()
        digests, hashes, starts, counts = _columns(found)
        order = np.lexsort((starts, digests[:, 1], digests[:, 0]))
        digests, hashes, starts, counts = digests[order], hashes[order], starts[order], counts[order]
        other = np.ones(len(digests), bool)
        other[1:] = (digests[1:] != digests[:-1]).any(axis=1)
        fresh = other.copy()
        fresh[1:] |= starts[1:] != starts[:-1]
        digests, hashes, starts, counts, other = digests[fresh], hashes[fresh], starts[fresh], counts[fresh], other[fresh]
        edges = [*np.flatnonzero(other).tolist(), len(digests)]
        docs = []
        for a, b in zip(edges, edges[1:], strict=False):
            d = digests[a].tobytes()
            i = ids[first[d]]
            docs.append((-(2**63) if i is None else i, d, a, b))
        shard = (mixed(hashes) % np.uint64(shards)).astype(np.int64).tolist()
        starts_l, counts_l = starts.tolist(), counts.tolist()
        seen: set[bytes] = set()
        out: dict[tuple[int, int], list[list]] = {}
        for doc_id, d, a, b in sorted(docs):
            text = whole[d]
            for k in range(a, b):
                s = starts_l[k]
                string = text[s : s + counts_l[k] + length - 1]
                gone = string in seen
                if not gone:
                    seen.add(string)
                at = (here, 1) if gone else (shard[k], 0)
                held = out.get(at)
                if held is None:
                    held = out[at] = [[], [], [], [], []]
                held[0].append(doc_id)
                held[1].append(d)
                held[2].append(s)
                held[3].append(counts_l[k])
                if not gone:
                    held[4].append(string)
        made = [(*at, np.array(h[0], np.int64).tobytes(), b"".join(h[1]), pack(np.array(h[2]), 5), pack(np.array(h[3]), 5), b"".join(h[4])) for at, h in out.items()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names)

    schema = "shard int, gone int, ids binary, digests binary, starts binary, counts binary, data binary"
    return rows.groupBy("bucket").cogroup(runs.groupBy("bucket")).applyInArrow(cut_out, schema)


PLACES = "bucket int, digests binary, starts binary, counts binary"


def removed_windows(strings: DataFrame, length: int, buckets: int, memory: int = MEMORY) -> DataFrame:
    """Sorts each shard's suffixes; (bucket, digests, starts, counts): runs of windows that also start earlier. A shard comes in
    batches and lies in scratch files beyond `memory`."""

    def packed(digests: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        return packed_batch((digests[:, 0] % np.uint64(buckets)).astype(np.int64), {"digests": (digests, 16), "starts": (start, 5), "counts": (count, 5)})

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Scratch(memory) as scratch:
            raw = Pile(scratch, np.uint8)
            piles = [Pile(scratch, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64)]
            for batch in batches:
                for k, gone in enumerate(batch.column("gone").to_pylist()):
                    row = batch.slice(k, 1)
                    digests, starts, counts = _columns(row, hashes=False)
                    if gone:
                        yield packed(digests, starts, counts)
                        continue
                    raw.add(np.frombuffer(row.column("data")[0].as_buffer(), np.uint8))
                    for pile, x in zip(piles, (np.frombuffer(joined(row.column("ids")), np.int64), digests[:, 0], digests[:, 1], starts, counts), strict=True):
                        pile.add(x)
            if raw.size:
                for d0, d1, start, count in found_repeats(raw.all(), *(p.all() for p in piles), length, scratch):
                    yield packed(np.column_stack([d0, d1]), start, count)

    return strings.groupBy("shard").applyInArrow(sort, PLACES)


def found_repeats(raw: np.ndarray, ids: np.ndarray, d0: np.ndarray, d1: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int, scratch: Scratch) -> Iterator[tuple[np.ndarray, ...]]:
    """(digest's halves, first window, windows) of the windows that also start earlier, of runs whose strings lie end to end."""
    many, block = len(ids), scratch.block
    few = max(1, block // 64)  # runs together: each has some hundred bytes
    at, end = scratch.array(many, np.int64), 0
    for k in range(0, many, block):
        size = counts[k : k + block] + length - 1
        at[k : k + block] = end + np.cumsum(size) - size
        end += int(size.sum())
    # in order of document and place, so that an earlier string has a smaller place in the text that is sorted
    sorter = Sorter(scratch)
    for k in range(0, many, block):
        sorter.push(ids[k : k + block].view(np.uint64) ^ _SIGN, np.arange(k, min(many, k + block)))
    run_of, text, owner = scratch.array(many, np.int64), scratch.array(end, np.uint8), scratch.array(end, np.int32 if many < 2**31 else np.int64)
    offset, done, filled = scratch.array(many, np.int64), 0, 0
    for order in sorter.by_keys([lambda i: d0[i], lambda i: d1[i], lambda i: starts[i].astype(np.uint64)]):
        for k in range(0, len(order), few):
            mine = order[k : k + few]
            size = counts[mine] + length - 1
            total = int(size.sum())
            inside = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
            text[filled : filled + total] = raw[np.repeat(at[mine], size) + inside]
            opens = inside < np.repeat(counts[mine], size)  # a window of the run starts here
            owner[filled : filled + total] = np.where(opens, np.repeat(np.arange(done, done + len(mine)), size), -1)
            run_of[done : done + len(mine)], offset[done : done + len(mine)] = mine, filled + np.cumsum(size) - size
            done, filled = done + len(mine), filled + total
            scratch.ease(total // 64)
    del raw, at
    suffixes, common = suffix_lcp(text, scratch)
    removed = scratch.array(end, np.uint8)
    least, low = None, np.iinfo(np.int32).max  # first place of the group of equal windows, and least common prefix since its last one
    for k in range(0, end, block):
        places, shared = suffixes[k : k + block], common[k : k + block]
        on = np.flatnonzero(owner[places] >= 0)
        scratch.ease(2 * len(places))
        if not len(on):
            low = min(low, int(shared.min()))
            continue
        upto = np.minimum.reduceat(shared[: on[-1] + 1], np.concatenate([[0], on[:-1] + 1]))
        upto[0] = min(int(upto[0]), low)
        low = int(shared[on[-1] + 1 :].min(initial=np.iinfo(np.int32).max))
        place = places[on].astype(np.int64)
        head = upto < length
        if least is None or head[0]:
            head[0] = True
        else:  # the group goes on from the block before
            place, head = np.concatenate([[least], place]), np.concatenate([[True], head])
        group = np.flatnonzero(head)
        smallest = np.minimum.reduceat(place, group)
        kept = np.repeat(smallest, np.diff(np.concatenate([group, [len(place)]])))
        removed[place[place != kept]] = 1
        least = int(smallest[-1])
    del suffixes, common
    for k in range(0, end, block):
        place = np.flatnonzero(removed[k : k + block]) + k
        if len(place):
            run = owner[place]
            fresh = np.ones(len(place), bool)
            fresh[1:] = (place[1:] != place[:-1] + 1) | (run[1:] != run[:-1])
            first = np.flatnonzero(fresh)
            of = run_of[run[first]]
            yield d0[of], d1[of], starts[of] + place[first] - offset[run[first]], np.diff(np.concatenate([first, [len(place)]]))
        scratch.ease(block // 16)


def _whole_characters(text: bytes, start: int, stop: int) -> tuple[int, int]:
    """The span without the parts of characters at its ends."""
    while start < stop and text[start] & 0xC0 == 0x80:
        start += 1
    while start < stop < len(text) and text[stop] & 0xC0 == 0x80:
        stop -= 1
    return start, stop


def cut_texts(rows: DataFrame, removed: DataFrame, length: int, as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, payload) of the first document of each text."""
    others = [f for f in rows.schema if f.name not in ("bucket", "digest", "doc_id", "text")]
    names = ["doc_id", "n_bytes", "spans", "kept", *(f.name for f in others)]
    schema = f"doc_id long, n_bytes long, {SPANS}, kept " + ("string" if as_text else "binary") + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in others)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def cut_all(texts: pa.Table, found: pa.Table) -> pa.Table:
        whole, first = _whole_texts(texts)
        windows: dict[bytes, list[tuple[int, int]]] = {}
        if found.num_rows:
            digests, starts, counts = _columns(found, hashes=False)
            raw = digests.tobytes()
            for k, (s, c) in enumerate(zip(starts.tolist(), counts.tolist(), strict=True)):
                windows.setdefault(raw[k * DIGEST : (k + 1) * DIGEST], []).append((s, s + c + length - 1))
        sizes, spans, kept = [], [], []
        for d in first:
            text = whole[d]
            merged: list[list[int]] = []
            for a, b in sorted(windows.get(d, [])):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            if as_text:
                merged = [[a, b] for a, b in (_whole_characters(text, a, b) for a, b in merged) if a < b]
            edges = [0, *(x for span in merged for x in span), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            sizes.append(len(text))
            spans.append([{"start": a, "stop": b} for a, b in merged])
        left = cells(b"".join(kept), np.cumsum([0, *map(len, kept)]))
        ones = texts.take(pa.array(list(first.values()), pa.int64()))
        columns = [ones.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, span_type), left.cast(pa.string()) if as_text else left]
        return pa.Table.from_arrays([*columns, *(ones.column(f.name) for f in others)], names)

    return rows.groupBy("bucket").cogroup(removed.groupBy("bucket")).applyInArrow(cut_all, schema)


SPANS = "spans array<struct<start:bigint,stop:bigint>>"


def later_copies(plain: DataFrame, total: int, length: int, payload: tuple[str, ...], as_text: bool) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, payload) of all documents but the first of each text, by built-in aggregations on digests: a
    copy loses all its bytes, if they are `length` at least. Copies of frequent texts stay where they are."""
    keys = ["doc_id", *payload]
    size = F.octet_length("text").cast("long")
    short = F.when(size < length, F.col("text"))
    rows = plain.select(*keys, F.substring(F.sha2("text", 256), 1, 2 * DIGEST).alias("digest"), size.alias("n_bytes"), short.alias("short"))
    content = rows.groupBy("digest", "n_bytes", "short", *keys).agg(F.count(F.lit(1)).alias("times"))
    firsts = content.groupBy("digest").agg(F.min(F.struct(*keys)).alias("first"), F.sum("times").alias("all")).where(F.col("all") > 1)
    often = F.col("all") > max(1, total // HOT)
    hot = firsts.where(often)  # fewer than HOT rows
    rest = content.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(firsts.where(~often), "digest")
    copies = content.join(F.broadcast(hot), "digest").unionByName(rest).withColumn("times", F.col("times") - F.struct(*keys).eqNullSafe(F.col("first")).cast("long")).where("times > 0")
    each = copies.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    gone = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    kept = F.coalesce("short", F.lit(""))
    return each.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("n_bytes") >= length, gone).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"),
        (kept if as_text else kept.cast("binary")).alias("kept"),
        *payload,
    )


def remove_repeats(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", payload: tuple[str, ...] = (), as_text: bool = False, memory: int = MEMORY) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, payload columns) for every row.

    spans: the bytes covered by strings of `length` bytes, 1 at least, that also start earlier, in a document of smaller id or further
    left; kept: the other bytes. Ids are whole numbers; null ids come first; rows of equal ids stand in order of their texts'
    digests, rows of equal ids and texts in order of payload, whose columns have types that can be compared. With as_text, kept is
    a string and spans are drawn in to whole characters. Null texts are empty. No text shorter than `length` loses a byte. Texts may
    be as long as a value of Spark. An empty table gives no rows. Columns that aren't asked for are ignored, whatever their names;
    payload columns with a name of the result's own are refused. memory: bytes a shard takes before it goes to disk. An id of -2^63 counts as null.
    """
    if length < 1 or {"doc_id", "n_bytes", "spans", "kept"} & set(payload):
        raise ValueError("length: 1 at least; payload: no doc_id, n_bytes, spans or kept")
    inner = tuple(f"payload_{k}" for k in range(len(payload)))
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(F.col(f"`{p}`").alias(i) for p, i in zip(payload, inner, strict=True)))
    size = plain.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("docs")).first()
    buckets = bucket_count(docs.sparkSession, size["bytes"] or 0, BUCKET_BYTES)
    runs = repeated_runs(run_blocks(plain, length, buckets), buckets)
    rows = text_rows(plain, buckets)
    removed = removed_windows(shard_strings(rows, runs, length, buckets), length, buckets, memory)
    out = cut_texts(rows, removed, length, as_text).unionByName(later_copies(plain, size["docs"], length, inner, as_text))
    return out.withColumnsRenamed(dict(zip(inner, payload, strict=True)))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), 100)
    lengths = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", lengths.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
