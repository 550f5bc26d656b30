"""SentencePiece BPE encoding by suffix-array matching, and decoding.

A batch's text is cut into units (a word with the marks before it); these are put end to end, a repeated one once, and their
suffixes sorted: each batch has an index of its own. Every piece of the vocabulary is binary-searched in that array; its range of
suffixes are its occurrences, the edges of a lattice over the text. Edges are sorted by position and relaxed from left to right.

The model is of BPE kind, so an edge isn't relaxed by a sum of scores. A row of pieces is what BPE makes of a text
exactly if BPE makes each two neighbours of the two together: until a merge crosses a border, what happens on either
side of it doesn't depend on the rest. So each position keeps the one edge whose piece stands firm against the piece kept where
the edge starts. Whether two pieces do is found once for each pair.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .arrow import give_back, slices

MARK = "▁"
#: Fixed values of the model format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Pairs of pieces that a worker keeps what it knows of, at most.
KEPT_PAIRS = 2_000_000
#: Code points of units whose suffixes are sorted together, bytes of texts in a batch, ids decoded together.
SORTED, SLICE, DECODED = 200_000, 4 << 20, 500_000


def _fields(data: bytes):
    """(number, value) of a protocol buffer's fields: whole numbers, or bytes."""

    def varint(k: int) -> tuple[int, int]:
        shift = value = 0
        while True:
            value |= (data[k] & 127) << shift
            shift += 7
            k += 1
            if data[k - 1] < 128:
                return value, k

    k = 0
    while k < len(data):
        tag, k = varint(k)
        kind = tag & 7
        if kind == 0:
            value, k = varint(k)
        elif kind == 2:
            n, k = varint(k)
            value, k = data[k : k + n], k + n
        else:
            n = 8 if kind == 1 else 4
            value, k = data[k : k + n], k + n
        yield tag >> 3, value


def suffix_array(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(starts of the suffixes in order of their first `depth` symbols at least, by prefix doubling; the symbols that occur;
    sorted keys of the suffixes' first `have` symbols; have; bits of a symbol in a key)."""
    # the first sort looks at as many symbols as a number holds
    present, small = np.unique(codes, return_inverse=True)
    small = small.astype(np.int64) + 1
    bits = int(small.max(initial=1)).bit_length()
    first = have = max(1, min(depth, 62 // bits))
    key = small
    for k in range(1, have):
        key = key << bits
        key[:-k] |= small[k:]
    order = np.argsort(key, kind="stable")
    rank = np.empty(len(codes), np.int64)
    step = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
    rank[order] = step
    begin = key
    while have < depth and len(codes) and step[-1] < len(codes) - 1:
        later = np.zeros(len(codes), np.int64)
        later[: len(codes) - have] = rank[have:] + 1
        key = rank * (len(codes) + 1) + later
        order = np.argsort(key, kind="stable")
        step = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
        rank = np.empty(len(codes), np.int64)
        rank[order] = step
        have *= 2
    return order, present, begin[order], first, bits


class Vocabulary:
    """A model file's pieces, checked to be of the kind that this module encodes, and the bytes each stands for."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        pieces = [dict(_fields(v)) for k, v in fields if k == 1]
        trainer = next((dict(_fields(v)) for k, v in fields if k == 2), {})
        norm = next((dict(_fields(v)) for k, v in fields if k == 3), {})
        self.text = [p.get(1, b"").decode() for p in pieces]
        self.score = np.array([struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces])
        self.kind = np.array([p.get(3, NORMAL) for p in pieces])
        plain = norm.get(2, b"") == b"" and not norm.get(4, 1) and norm.get(5, 1) and not trainer.get(24, 0)
        if trainer.get(3, 1) != 2 or not plain or (self.kind == USER_DEFINED).any() or (self.kind == BYTE).sum() != 256:
            raise ValueError("a BPE model with identity normalization, byte fallback and no pieces of the user's own is asked for")
        self.prefix = bool(norm.get(3, 1))
        self.byte_ids = np.zeros(256, np.int64)
        for k in np.flatnonzero(self.kind == BYTE):
            self.byte_ids[int(self.text[k][3:5], 16)] = k
        self.raw = [t.replace(MARK, " ").encode() for t in self.text]
        for k in np.flatnonzero(self.kind != NORMAL):
            self.raw[k] = bytes([int(self.text[k][3:5], 16)]) if self.kind[k] == BYTE else " ⁇ ".encode() if self.kind[k] == UNKNOWN else b""

        sizes = np.array([len(r) for r in self.raw], np.int64)
        self.raw_bytes, self.raw_sizes, self.raw_starts = np.frombuffer(b"".join(self.raw), np.uint8), sizes, np.cumsum(sizes) - sizes

    def decode_rows(self, ids: np.ndarray, count: np.ndarray) -> pa.Array:
        """Texts of rows of ids laid end to end. All bytes are gathered at once; only if they aren't UTF-8 throughout, as
        pieces of single bytes may make them, each row is decoded by itself."""
        size = self.raw_sizes[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.raw_bytes[np.arange(ends[-1]) - np.repeat(ends[:-1] - self.raw_starts[ids], size)]
        bounds = ends[np.concatenate([[0], np.cumsum(count)])]
        starts = bounds[:-1][bounds[:-1] < bounds[1:]]
        try:
            data.tobytes().decode()
            whole = not ((data[starts] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if not whole:
            return pa.array([self.decode(r.tolist()) for r in np.split(ids, np.cumsum(count)[:-1])], pa.string())
        keep = np.ones(len(data), bool)
        if self.prefix:
            keep[starts[data[starts] == 32]] = False
        offsets = np.concatenate([[0], np.cumsum(keep)])[bounds].astype(np.int32)
        return pa.StringArray.from_buffers(len(count), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[keep].tobytes()))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


class Model(Vocabulary):
    """Its merges as sorted arrays, and what has been found out about pairs of pieces."""

    def __init__(self, path: str):
        super().__init__(path)
        pieces = self.text
        self.size = len(pieces) + 2  # two more symbols: any character without a piece, and the start of a unit
        self.stranger, self.start = len(pieces), len(pieces) + 1
        self.id_of = {self.text[k]: int(k) for k in np.flatnonzero(self.kind == NORMAL) if self.text[k]}
        if any(a != MARK and b == MARK for t in self.id_of for a, b in zip(t, t[1:], strict=False)):
            raise ValueError("a piece has a mark after another character: words can't be cut apart")
        _, rank = np.unique(-self.score, return_inverse=True)
        pairs = [(self.id_of[t[:k]], self.id_of[t[k:]], i) for t, i in self.id_of.items() for k in range(1, len(t)) if t[:k] in self.id_of and t[k:] in self.id_of]
        key = np.array([a * self.size + b for a, b, _ in pairs], np.int64)
        made = np.array([i for _, _, i in pairs], np.int64)
        order = np.argsort(key)
        self.keys, self.made = key[order], made[order]
        self.ranks = rank[self.made]
        self.chars = {t: i for t, i in self.id_of.items() if len(t) == 1}
        self.spelled = {i: [self.chars.get(c, self.stranger) for c in t] for t, i in self.id_of.items()}
        ids = np.array(sorted(self.spelled), np.int64)
        whole = self._merge([self.spelled[i] for i in ids.tolist()])
        self.live = ids[np.array([w == [i] for w, i in zip(whole, ids.tolist(), strict=True)], bool)]  # pieces that BPE makes of their own text
        lengths = np.array([len(self.text[i]) for i in self.live])
        self.longest = int(lengths.max())
        table = np.zeros((len(self.live), self.longest), np.int64)
        for row, i in enumerate(self.live.tolist()):
            table[row, : lengths[row]] = [ord(c) for c in self.text[i]]
        self.spelling, self.lengths = table, lengths
        self.pair_keys, self.pair_firm = np.array([-1], np.int64), np.array([False])
        # texts may be cut before marks, around line feeds, and between letters and signs, where no piece reaches across
        line = "" if "\n" in self.chars else "\n"
        pairs = {(x, y) for t in self.id_of for x, y in zip(t, t[1:], strict=False)}
        letters = {c for c in self.chars if c.isalpha()}
        signs = {c for c in "!\"#$%&()*+,./:;<=>?@[]^_`{|}~" if not any((x, c) in pairs for x in letters)}
        word = f"{MARK}*+\\p{{L}}++(?=[{''.join(map(regex.escape, sorted(signs)))}])|" if signs else ""
        self.units = regex.compile(f"{line + '|' if line else ''}{word}{MARK}+[^{MARK}{line}]*|[^{MARK}{line}]+").findall

    def _merge(self, rows: list[list[int]]) -> list[list[int]]:
        """BPE of rows of symbols: in each round every row makes its best merge, the leftmost of equals."""
        out: list[list[int]] = [[]] * len(rows)
        sizes = np.array([len(r) for r in rows], np.int64)
        sym = np.array([s for r in rows for s in r], np.int64)
        seq = np.repeat(np.arange(len(rows)), sizes)
        none = np.int64(2**40)
        while len(sym):
            same = np.r_[seq[:-1] == seq[1:], False]
            key = np.where(same, sym * self.size + np.r_[sym[1:], 0], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            where = np.arange(len(sym))
            order = np.where(self.keys[at] == key, self.ranks[at] * len(sym) + where, none * len(sym))
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(order, starts)
            lengths = np.diff(np.r_[starts, len(sym)])
            done = best == none * len(sym)
            for k in np.flatnonzero(done).tolist():
                out[seq[starts[k]]] = sym[starts[k] : starts[k] + lengths[k]].tolist()
            take = best[~done] % len(sym)
            sym[take] = self.made[at[take]]
            keep = np.repeat(~done, lengths)
            keep[take + 1] = False
            sym, seq = sym[keep], seq[keep]
        return out

    def firm(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE makes left and right of the text of the two together."""
        key = left * self.size + right
        free = (left >= self.stranger) | (right == self.stranger)
        asked, back = np.unique(key[~free], return_inverse=True)
        at = np.minimum(np.searchsorted(self.pair_keys, asked), len(self.pair_keys) - 1)
        new = asked[self.pair_keys[at] != asked]
        if len(new):
            in_table = np.minimum(np.searchsorted(self.keys, new), len(self.keys) - 1)
            answer = self.keys[in_table] != new  # two that merge outright aren't firm
            todo = np.flatnonzero(answer)
            pairs = [(int(k) // self.size, int(k) % self.size) for k in new[todo]]
            for start in range(0, len(pairs), 50_000):
                part = pairs[start : start + 50_000]
                made = self._merge([self.spelled[a] + self.spelled[b] for a, b in part])
                answer[todo[start : start + len(part)]] = [m == [a, b] for m, (a, b) in zip(made, part, strict=True)]
            if len(self.pair_keys) > KEPT_PAIRS:  # start again with what is asked for now
                held = np.isin(self.pair_keys, asked)
                held[0] = True
                self.pair_keys, self.pair_firm = self.pair_keys[held], self.pair_firm[held]
            keys = np.r_[self.pair_keys, new]
            order = np.argsort(keys, kind="stable")
            self.pair_keys, self.pair_firm = keys[order], np.r_[self.pair_firm, answer][order]
            at = np.searchsorted(self.pair_keys, asked)
        out = np.ones(len(key), bool)
        out[~free] = self.pair_firm[at][back]
        return out

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, stop, piece) of every occurrence of every piece in the text."""
        order, present, keys, have, bits = suffix_array(codes, self.longest)
        padded = np.concatenate([codes, np.full(self.longest, -1)])
        # pieces as keys: one binary search gives the range of suffixes that begin with the first symbols
        number = np.minimum(np.searchsorted(present, self.spelling), len(present) - 1)
        used = np.arange(self.longest) < self.lengths[:, None]
        known = ((present[number] == self.spelling) | ~used).all(axis=1)
        row = np.flatnonzero(known)
        number = np.where(used, number + 1, 0)[row, :have]
        low = number @ (1 << (bits * np.arange(have - 1, -1, -1)[: number.shape[1]]))
        high = low + (1 << (bits * (have - np.minimum(self.lengths[row], have))))
        low, high = np.searchsorted(keys, low), np.searchsorted(keys, high)
        found = []
        for depth in range(have - 1, self.longest):
            if depth >= have:  # the others are narrowed symbol by symbol
                symbol = self.spelling[row, depth]
                bounds = []
                for right in (False, True):
                    a, b = low.copy(), high.copy()
                    while (a < b).any():
                        mid = (a + b) >> 1
                        value = padded[order[np.minimum(mid, len(order) - 1)] + depth]
                        up = (a < b) & ((value < symbol) | (right & (value == symbol)))
                        a, b = np.where(up, mid + 1, a), np.where((a < b) & ~up, mid, b)
                    bounds.append(a)
                low, high = bounds
            full = (self.lengths[row] <= depth + 1) & (high > low)
            found.append((row[full], low[full], high[full]))
            on = (self.lengths[row] > depth + 1) & (high > low)
            row, low, high = row[on], low[on], high[on]
        rows, lows, highs = (np.concatenate(x) for x in zip(*found, strict=True))
        count = highs - lows
        piece = np.repeat(rows, count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lows, count)
        start = order[place]
        return start, start + self.lengths[piece], self.live[piece]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after the other, and how many each has."""
        sizes = np.array([len(u) for u in units], np.int64)
        codes = np.frombuffer(("\n".join(units) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        last = first + sizes
        codes[last] = -2  # no piece crosses it
        start, stop, piece = self.edges(codes)
        covered = np.zeros(len(codes), bool)
        covered[start[stop - start == 1]] = True
        covered[last] = True
        alone = np.flatnonzero(~covered)
        start, stop, piece = np.r_[start, alone], np.r_[stop, alone + 1], np.r_[piece, np.full(len(alone), self.stranger)]
        offset = stop - np.repeat(first, sizes + 1)[start]
        order = np.argsort(offset.astype(np.uint16) if offset.max() < 2**16 else offset, kind="stable")
        start, stop, piece, offset = start[order], stop[order], piece[order], offset[order]
        kept, came = np.full(len(codes) + 1, -1, np.int64), np.zeros(len(codes) + 1, np.int64)
        kept[first] = self.start
        border = np.flatnonzero(np.r_[True, offset[1:] != offset[:-1], True])
        for a, b in zip(border, border[1:], strict=False):
            ok = self.firm(kept[start[a:b]], piece[a:b])
            at = stop[a:b][ok]
            kept[at], came[at] = piece[a:b][ok], start[a:b][ok]
        # walk back from the ends, all units at once
        steps, now, unit = [], last.copy(), np.arange(len(units))
        while len(now):
            on = now > first[unit]
            now, unit = now[on], unit[on]
            steps.append((unit, now, kept[now]))
            now = came[now]
        unit, place, ids = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.argsort(place)  # units stand in order
        unit, place, ids = unit[order], place[order], ids[order]
        if (ids == self.stranger).any():  # a character without a piece is written byte by byte
            lists = [[i] if i != self.stranger else self.byte_ids[list(chr(codes[p - 1]).encode())].tolist() for i, p in zip(ids.tolist(), place.tolist(), strict=True)]
            unit = np.repeat(unit, [len(x) for x in lists])
            ids = np.array([i for x in lists for i in x], np.int64)
        return ids.astype(np.int32), np.bincount(unit, minlength=len(units))


class Codec:
    """Encodes texts batch by batch. What it keeps between batches is the model and what is known of pairs of pieces."""

    def __init__(self, path: str):
        self.model = Model(path)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a batch one after the other, and how many each has."""
        m = self.model
        parts = [m.units(((MARK if m.prefix else "") + t).replace(" ", MARK)) if t else [] for t in texts]
        number: dict[str, int] = dict.fromkeys(chain.from_iterable(parts), 0)
        units = list(number)
        number = dict(zip(units, range(len(units)), strict=True))
        sizes = np.array([len(p) for p in parts], np.int64)
        if not units:
            return np.zeros(0, np.int32), sizes
        ends = np.cumsum([len(u) for u in units])
        cuts = np.unique([0, *np.searchsorted(ends, np.arange(SORTED, ends[-1], SORTED)).tolist(), len(units)]).tolist()
        flat, count = (np.concatenate(x) for x in zip(*(m.encode_units(units[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
        first = np.cumsum(count) - count
        unit = np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int64, sizes.sum())
        count = count[unit]
        ends = np.cumsum(count)
        place = np.arange(ends[-1]) - np.repeat(ends - count, count) + np.repeat(first[unit], count)
        return flat[place], np.diff(np.r_[0, np.r_[0, ends][np.cumsum(sizes)]])


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, text_sha256, ids) for every row; `path` names the model file on every machine.

    Null and empty texts have no ids. Blanks become marks, as the model's file asks; a text that has marks of its own gets
    blanks back in their place. Repeated rows and null keys are rows like others; further columns don't matter.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key_type = rows.schema["doc_id"].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        ids, count = codec(path).encode(texts)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(ids))
        raw = [t.encode() for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw]), lists],
            ["doc_id", "n_bytes", "text_sha256", "ids"],
        )

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield kernel(part)
        give_back()

    return rows.mapInArrow(run, f"doc_id {key_type}, n_bytes long, text_sha256 string, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """The rows and `decoded`: the text of column ids. Null ids give null, no ids an empty text."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "decoded"), "decoded string"])

    def kernel(batches):
        for whole in batches:
            sizes = pc.fill_null(pc.list_value_length(whole.column(whole.schema.get_field_index("ids"))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = (np.cumsum(sizes) - 1) // DECODED  # slices of so many ids, a longer row alone
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(sizes)]
            for a, b in zip(edges, edges[1:], strict=False):
                batch, count = whole.slice(a, b - a), sizes[a:b]
                rows = batch.column(batch.schema.get_field_index("ids"))
                texts = vocabulary(path).decode_rows(rows.flatten().to_numpy(zero_copy_only=False), count) if len(count) else pa.array([], pa.string())
                texts = pc.if_else(rows.is_valid(), texts, pa.scalar(None, pa.string())) if rows.null_count else texts
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])
        give_back()

    return encoded.drop("decoded").mapInArrow(kernel, schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document, decodes it again, and returns digests of both."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    both = decode_ids(encode_texts(table(spark, sf_dir, "documents"), path), path)
    return both.select(
        "doc_id",
        "n_bytes",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"),
    )
