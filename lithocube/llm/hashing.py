"""CRC-32 of very many short byte strings at once."""

from __future__ import annotations

import functools
import zlib

import numpy as np

#: Longer strings go through zlib one by one.
LONG = 96


@functools.cache
def byte_table() -> np.ndarray:
    """What each byte turns a state of 0 into: eight steps of the reflected polynomial of zlib."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ np.where(step & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return step


def crc32_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """zlib's CRC-32 (unsigned) of data[start : start + length] for each string; `before`: the CRC of what stands before it."""
    out = np.zeros(len(starts), np.uint32) if before is None else before.astype(np.uint32)
    table = byte_table()
    order = np.argsort(-lengths, kind="stable")
    start, length = starts[order], lengths[order]
    state = ~out[order]
    first = int(np.searchsorted(-length, -LONG))  # those before it are longer than LONG - 1
    for k in range(first):
        raw = data[start[k] : start[k] + length[k]].tobytes()
        state[k] = ~np.uint32(zlib.crc32(raw, int(~state[k])))
    active = len(order)
    for k in range(int(length[first]) if first < active else 0):
        active = int(np.searchsorted(-length, -k))
        now = state[first:active]
        state[first:active] = table[(now ^ data[start[first:active] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out[order] = ~state
    return out
