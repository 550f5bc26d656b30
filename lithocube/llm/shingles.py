"""Words and word shingles of many texts as hashes, by numpy over the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bits of a shingle's hash. Of n shingles of a text two fall together with odds of about n * n / 2**57: in 2 * 10**10 texts of 350
#: words that is expected 0.02 times.
TOKEN_BITS = 56
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column's values end to end, and len + 1 offsets into them. There are no nulls in it."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word [^\\x20\\x09-\\x0D]+, A-Z as a-z."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    before = np.r_[False, inside[:-1]]
    starts = np.flatnonzero(inside & (~before | begins[:n]))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mark = np.zeros(n, np.int32)
    mark[starts] = np.diff(np.r_[0, starts])
    place = np.arange(n, dtype=np.int32) - np.cumsum(mark, dtype=np.int32)
    place[~inside] = 0
    powers = np.cumprod(np.full(int(place[starts[0] :].max()) + 1, _BASE, np.uint64))
    value = _BYTE[_LOWER[data]] * powers[np.maximum(place, 0)]
    value[~inside] = 0
    return mixed(np.add.reduceat(value, starts)), np.searchsorted(offsets, starts, side="right") - 1


def shingle_tokens(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, text number) of the distinct shingles of `width` words of every text, sorted by text and token.

    A text of fewer words has its whole row of words as its one shingle; a text without words has none.
    At most 65,536 texts at once.
    """
    words, text = word_hashes(data, offsets)
    many = len(offsets) - 1
    count = np.bincount(text, minlength=many)
    tokens, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for size in range(1, width + 1):
        if size == width:
            at = np.arange(max(0, len(words) - width + 1))
            at = at[text[at] == text[at + width - 1]]
        else:
            at = (np.cumsum(count) - count)[count == size]
        if len(at):
            h = np.full(len(at), size, np.uint64)
            for k in range(size):
                h = mixed(h * _BASE + words[at + k])
            tokens, owner = np.r_[tokens, h], np.r_[owner, text[at]]
    tokens >>= np.uint64(64 - TOKEN_BITS)
    order = np.argsort(tokens)
    tokens, owner = tokens[order], owner[order]
    order = np.argsort(owner.astype(np.uint16), kind="stable")
    tokens, owner = tokens[order], owner[order]
    if len(tokens):
        fresh = np.r_[True, (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])]
        tokens, owner = tokens[fresh], owner[fresh]
    return tokens, owner


def set_signatures(tokens: np.ndarray, owner: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, signature) of each text's set: equal sets have equal signatures, rows of two 64-bit numbers."""
    size = np.bincount(owner, minlength=many)
    ends = np.cumsum(size)
    out = np.empty((many, 2), np.uint64)
    for half, salt in enumerate((_BASE, _BYTE[0] | np.uint64(1))):
        sums = np.r_[np.uint64(0), np.cumsum(mixed(tokens * salt + np.uint64(half + 1)), dtype=np.uint64)]
        out[:, half] = mixed(sums[ends] - sums[ends - size] + size.astype(np.uint64) * salt)
    return size, out
