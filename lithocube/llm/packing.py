"""Packing documents into sequences: dynamic programming over cuts at document and sentence ends, by a monotone queue.

A batch of a partition's documents stands end to end as one row of ids, in the table's order. A sequence is a window of this row.
cost[j], of the best packing that ends at place j, is the least over the places i in reach of

    cost[i] + padding(j - i) + penalty(j) + 1

padding is `limit` less the length, which is linear in i, so the least of cost[i] + i over a sliding window answers it: a queue whose values rise,
from which places fall at the front when they are out of reach and at the back when a later one is as good. Lengths that need no padding,
the powers of two, are asked for one by one. A cut costs nothing after a document, little after a sentence, more anywhere else.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .arrow import give_back, slices
from .token_counts import byte_alphabet

#: Costs of a cut after a sentence and anywhere else inside a document, in tokens of padding.
SENTENCE, INSIDE = 2, 8
#: Ids packed at once, sequences at a batch's end that are packed again with the next one, bytes of text encoded at once,
#: parts of texts whose ids a worker keeps, and ids it keeps (parts of texts without blanks may be long).
BATCH, AGAIN, SLICE, KEPT, KEPT_IDS = 1 << 18, 8, 1 << 22, 1_000_000, 8_000_000
#: New parts that are encoded as one text, and which may be: a word after a blank, a word.
JOINED = 1000
AFTER_BLANK, WORD = re.compile(r" \S+").fullmatch, re.compile(r"\S+").fullmatch


def among(*found: int | range) -> np.ndarray:
    """For each byte, whether it is one of these."""
    out = np.zeros(256, bool)
    for f in found:
        out[f if isinstance(f, int) else list(f)] = True
    return out


#: Fixed values, the kinds of bytes: ASCII letters, first bytes of Latin letters from U+00C0 to U+024F (and of two signs among them), ASCII white space
#: other than the blank, ASCII that is neither letter nor white space for anyone (nor the apostrophe), and first bytes of what is no white space.
LETTER, LATIN, WHITE = among(range(65, 91), range(97, 123)), among(range(0xC3, 0xCA)), among(range(9, 14))
OTHER = ~(LETTER | WHITE | among(range(28, 33), 39, range(128, 256)))
SOLID = LETTER | OTHER | LATIN | among(39, range(0xCA, 0xE0), 0xE0, range(0xE4, 0xF5))


def later(x: np.ndarray, k: int = 1) -> np.ndarray:
    """Each place's value from k places before, false at first."""
    return np.r_[np.zeros(min(k, len(x)), bool), x[: len(x) - k]] if k < len(x) else np.zeros(len(x), bool)


def partings(b: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places at which texts' bytes part so that no pre-token of a byte-level file spans two parts, and each part alone has the pre-tokens
    it has in its text; with the texts' starts (`bounds` has their end, too). These are some of the pre-tokens' ends, those that bytes show:
    before a blank that something other than white space follows; between a letter and ASCII other than letters; before a letter after a
    sign or digit (not an apostrophe, which may begin 's or 't), or after one white space after these or a letter."""
    begins, white, other = LETTER[b], WHITE[b], OTHER[b]
    ends = begins.copy()
    first = np.flatnonzero(LATIN[b])
    first = first[(b[first] != 0xC3) | (b[first + 1] & 0xDF != 0x97)]  # but for the signs of multiplication and division
    begins[first] = True
    ends[first + 1] = True
    cut = begins & (later(other) | later(white) & later(other | ends, 2))
    cut |= later(ends) & ~begins & (b < 128)
    blank = np.flatnonzero(b == 32)
    inside = blank[blank + 1 < len(b)]
    follows = SOLID[b[inside + 1]]
    starts = np.zeros(len(b) + 1, bool)
    starts[bounds] = True
    cut[inside[follows & ~starts[inside + 1]]] = True
    cut |= starts[:-1]
    return np.flatnonzero(cut)


class Kept(dict):
    """Strings' numbers in the order they are first asked for, and the ids of each, as `make` gives them for a list of new ones."""

    def __init__(self, make: Callable[[list], tuple[np.ndarray, np.ndarray]]):
        self.make, self.new = make, []
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def __missing__(self, key: object) -> int:
        self.new.append(key)
        self[key] = out = len(self)
        return out

    def ids(self, keys: list, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the keys at places `which` end to end, how many each has)."""
        which = np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))[which]
        if self.new:
            flat, sizes = self.make(self.new)
            self.new = []
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, flat])
        sizes = (self.starts[1:] - self.starts[:-1])[which]
        return gathered(self.flat, self.starts[which], sizes), sizes


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of so many values from these places on, end to end."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


def everywhere(part: bytes, whole: bytes) -> Iterator[int]:
    """Where `part` begins in `whole`, places where it overlaps itself included."""
    at = whole.find(part)
    while at >= 0:
        yield at
        at = whole.find(part, at + 1)


class Encoder:
    """Ids of texts as the file's own library gives them, without begin and end tokens, and which ids end and follow sentences.

    Texts are parted where a byte-level file's pre-tokens surely end (`partings`), and each different part is kept by number with its ids.
    New ones are joined to long texts for the library. Other files' texts are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.encode_batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        plain = not any(t.get(x) for t in added for x in ("lstrip", "rstrip", "single_word")) and all(WORD(t["content"]) for t in added)
        self.in_parts = plain and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.forget()
        alphabet, whole = byte_alphabet(), {t["content"] for t in added}
        many = self.tokenizer.get_vocab_size()
        self.ends, self.opens, self.blank, self.line = np.zeros((4, many), bool)
        for token, k in self.tokenizer.get_vocab().items():
            raw = token.encode() if token in whole or not all(c in alphabet for c in token) else bytes(alphabet[c] for c in token)
            self.ends[k] = raw.endswith((b".", b"!", b"?", b"\n", "。".encode(), "！".encode(), "？".encode()))
            self.opens[k], self.blank[k], self.line[k] = raw[:1].isspace(), raw[:1] == b" ", raw[:1] == b"\n"
        self.specials = [w.encode() for w in whole]

    def forget(self) -> None:
        self.parts = Kept(self.encoded)

    def encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the parts end to end, how many each has). Words after blanks are joined as they are, other words by a line break before each; a
        blank or a line break opens an id there and nowhere else. What has other white space is encoded alone."""
        kind = np.fromiter((1 if AFTER_BLANK(p) else 2 if WORD(p) else 0 for p in parts), np.int8, len(parts))
        found, starts, many = [np.zeros(0, np.uint32)], np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        for which, before, opens in ((0, "", None), (1, "", self.blank), (2, "\n", self.line)):
            at, some = np.flatnonzero(kind == which), list(compress(parts, kind == which))
            if opens is None:
                texts = some
            else:
                texts = [before + before.join(some[k : k + JOINED]) for k in range(0, len(some), JOINED)]
            made = [np.array(e.ids, np.uint32) for e in self.encode_batch(texts, add_special_tokens=False)]
            ids = np.concatenate([np.zeros(0, np.uint32), *made])
            first = np.cumsum([0, *map(len, made)])[:-1] if opens is None else np.flatnonzero(opens[ids])
            if len(first) != len(some):
                raise ValueError("the library's ids don't part before blanks and after line breaks")
            starts[at], many[at] = first + sum(map(len, found)) + len(before), np.diff(np.r_[first, len(ids)]) - len(before)
            found.append(ids)
        return gathered(np.concatenate(found), starts, many), many

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, how many each has). Texts aren't null."""
        if not self.in_parts:
            made = [np.array(e.ids, np.uint32) for e in self.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *made]), np.array([len(m) for m in made], np.int64)
        if len(self.parts) > KEPT or len(self.parts.flat) > KEPT_IDS:
            self.forget()
        texts = texts.cast(pa.string())
        _, offsets, values = texts.buffers()
        bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        if bounds[0] == bounds[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        values = values.slice(int(bounds[0]), int(bounds[-1] - bounds[0]))
        bounds = bounds - bounds[0]
        cuts = partings(np.frombuffer(values, np.uint8), bounds)
        raw = values.to_pybytes()
        if spans := [(at, at + len(w)) for w in self.specials for at in everywhere(w, raw)]:
            # neither inside a special string nor before a blank before it, which ends a stretch of white space there
            inside = np.zeros(len(raw), bool)
            for a, z in spans:
                inside[max(0, a - 1) : z] = True
            inside[bounds[bounds < len(raw)]] = False
            cuts = cuts[~inside[cuts]]
        parts = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(np.r_[cuts, len(values)].astype(np.int32)), values).dictionary_encode()
        ids, sizes = self.parts.ids(parts.dictionary.to_pylist(), parts.indices.to_numpy())
        return ids, np.diff(np.r_[0, np.cumsum(sizes)][np.searchsorted(cuts, bounds)])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def candidates(n: int, base: np.ndarray, limit: int, last: bool) -> np.ndarray:
    """Places from 0 to n where a sequence may end: those of `base`, a full sequence after each of these, full sequences through what has no
    place for longer, and all places of the last `limit` ids if no more come."""
    mark = np.zeros(n + 1, bool)
    mark[[0, n]] = True
    mark[base] = True
    base = np.flatnonzero(mark)
    wide = np.flatnonzero(np.diff(base) > limit)
    for k in wide.tolist():
        mark[base[k] + limit : base[k + 1] : limit] = True
    full = base + limit
    mark[full[full <= n]] = True
    if last:
        mark[max(0, n - limit) :] = True
    return np.flatnonzero(mark)


def best_cuts(places: np.ndarray, penalty: np.ndarray, limit: int) -> np.ndarray:
    """The places (ascending, from 0) at which the cheapest packing cuts, the first and the last included. No place is more than
    `limit` after the one before."""
    many = len(places)
    number = np.full(int(places[-1]) + 1, -1, np.int32)
    number[places] = np.arange(many)
    # the places a power of two before each, one after the other
    powers = [1 << k for k in range(limit.bit_length()) if 1 << k <= limit]
    earlier = np.stack([np.where(places >= p, number[np.maximum(places - p, 0)], -1) for p in powers], axis=1)
    bounds = np.r_[0, np.cumsum((earlier >= 0).sum(axis=1))].tolist()
    exact = earlier[earlier >= 0].tolist()
    at, pay = places.tolist(), (penalty + 1).tolist()
    cost, before = [0] * many, [0] * many
    # the queue, from `head` on: values cost + place rise along it
    keys, queue, head, low = at[:], [0], 0, 0
    for j in range(1, many):
        here = at[j]
        while at[queue[head]] < here - limit:
            head += 1
        i = queue[head]
        least = keys[i] + limit - here
        high = bounds[j + 1]
        for e in exact[low:high]:
            if cost[e] < least:
                least, i = cost[e], e
        low = high
        least += pay[j]
        cost[j], before[j] = least, i
        keys[j] = key = least + here
        while len(queue) > head and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    path, j = [many - 1], many - 1
    while j:
        j = before[j]
        path.append(j)
    return places[path[::-1]]


class Packer:
    """Takes documents in order and gives pieces: (document, start, length, crc, document's ids, sequence, offset)."""

    def __init__(self, code: Encoder, limit: int):
        self.code, self.limit, self.sequence = code, limit, 0
        self.held: list[tuple[object, int, np.ndarray, int]] = []  # (document, start, ids, ids of the whole document)
        self.many = 0

    def add(self, doc: object, ids: np.ndarray) -> Iterator[list[tuple]]:
        for start in range(0, len(ids), BATCH):
            part = ids[start : start + BATCH]
            self.held.append((doc, start, part, len(ids)))
            self.many += len(part)
            if self.many >= BATCH:
                yield self.pack(last=False)

    def pack(self, last: bool) -> list[tuple]:
        if not self.many:
            return []
        ids = np.concatenate([h[2] for h in self.held])
        sizes = np.array([len(h[2]) for h in self.held])
        ends = np.cumsum(sizes)
        whole = np.array([h[1] + len(h[2]) == h[3] for h in self.held])
        docs = ends[whole]
        sentence = np.flatnonzero(self.code.ends[ids[:-1]] & self.code.opens[ids[1:]]) + 1
        places = candidates(len(ids), np.r_[docs, sentence], self.limit, last)
        penalty = np.full(len(ids) + 1, INSIDE)
        penalty[sentence] = SENTENCE
        penalty[docs] = 0
        cuts = best_cuts(places, penalty[places], self.limit)
        if not last:
            cuts = cuts[: max(2, len(cuts) - AGAIN)]
        out, begins = [], ends - sizes
        edges = np.union1d(cuts, ends[ends < cuts[-1]])
        segment = np.searchsorted(ends, edges[:-1], side="right")
        window = np.searchsorted(cuts, edges[:-1], side="right") - 1
        raw = ids.astype("<u4")
        for a, b, s, w in zip(edges[:-1].tolist(), edges[1:].tolist(), segment.tolist(), window.tolist(), strict=True):
            doc, start, _, total = self.held[s]
            out.append((doc, start + a - int(begins[s]), b - a, zlib.crc32(raw[a:b].tobytes()), total, self.sequence + w, a - int(cuts[w])))
        self.sequence += len(cuts) - 1
        rest = int(cuts[-1])
        keep = int(np.searchsorted(ends, rest, side="right"))
        left = self.held[keep:]
        if left and begins[keep] < rest:
            doc, start, part, total = left[0]
            gone = rest - int(begins[keep])
            left[0] = (doc, start + gone, part[gone:], total)
        self.held, self.many = left, len(ids) - rest
        return out


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_documents(docs: DataFrame, path: str, limit: int = 1024, separator: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every row's ids and the separator after them, in pieces.

    Sequences hold `limit` ids at most and are padded to it unless their length is a power of two. Each partition packs its rows in their order,
    batch after batch; nothing is shuffled, and a sequence holds ids of one partition only. sequence_id: the partition's number and, below
    it (33 bits), the sequence's. start and offset count ids from 0; ids_crc32 is that of the piece's ids as little-endian
    32-bit numbers. Cuts come after documents where they can, else after sentences (an id that ends with . ! ? or a line's end, before one that begins
    with white space), else anywhere. Null and empty texts have the separator only; null keys and repeated rows are documents
    like others; an empty table gives no rows; further columns are ignored. A very long text is packed in several batches.
    Special strings inside texts are ids as in the library's default.
    """
    if limit < 1:
        raise ValueError("limit: 1 or more")
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        packer, first = Packer(code, limit), TaskContext.get().partitionId() << 33
        kind = None

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*pieces, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:5]), pa.array([first + s for s in cols[5]], pa.int64()), pa.array(cols[6], pa.int64())], COLUMNS)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for part in slices(batch, "text", SLICE):
                ids, sizes = code(part.column("text"))
                ends = np.cumsum(sizes)
                ids, ends = np.insert(ids, ends, separator), (ends + np.arange(1, len(ends) + 1)).tolist()
                for doc, a, z in zip(part.column("doc_id").to_pylist(), [0, *ends], ends, strict=False):
                    for pieces in packer.add(doc, ids[a:z]):
                        yield batch_of(pieces)
        if pieces := packer.pack(last=True):
            yield batch_of(pieces)
        give_back()

    kinds = ["start long", "length long", "ids_crc32 long", "doc_tokens long", "sequence_id long", "offset long"]
    return rows.mapInArrow(run, ", ".join([f"doc_id {rows.schema['doc_id'].dataType.simpleString()}", *kinds]))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
