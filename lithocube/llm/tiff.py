"""TIFF files of 8-bit grey samples: a writer, and a reader that walks image directories and decodes strips and tiles."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

#: Fixed values of the TIFF 6.0 specification: tags, compression schemes, bytes of each field type.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS, STRIP_BYTES, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_AT, TILE_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317, 322, 323, 324, 325
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {PLAIN: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CLEAR, END, FIRST, LAST = 256, 257, 258, 4094
#: Samples that a byte of a file may stand for: more is taken for damage, before memory is asked for. Deflate reaches 1,032.
MOST_RATIO = 2048


def packbits_encode(rows: np.ndarray) -> bytes:
    """Each row by itself, as the specification asks. Rows without a run of three are literal packets, made all at once."""
    height, width = rows.shape
    if width >= 3:
        has_run = ((rows[:, 2:] == rows[:, 1:-1]) & (rows[:, 1:-1] == rows[:, :-2])).any(axis=1)
    else:
        has_run = np.zeros(height, bool)
    if width <= 128 and not has_run.any():
        out = np.empty((height, width + 1), np.uint8)
        out[:, 0], out[:, 1:] = width - 1, rows
        return out.tobytes()
    parts = []
    for row in rows:
        data, k = row.tobytes(), 0
        edges = [0, *(np.flatnonzero(row[1:] != row[:-1]) + 1).tolist(), width]
        literal = 0
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a >= 3:
                for k in range(literal, a, 128):
                    chunk = data[k : min(a, k + 128)]
                    parts += [bytes([len(chunk) - 1]), chunk]
                while b - a >= 2:
                    n = min(128, b - a)
                    parts.append(bytes([257 - n, data[a]]))
                    a += n
                literal = a
        for k in range(literal, width, 128):
            chunk = data[k : k + 128]
            parts += [bytes([len(chunk) - 1]), chunk]
    return b"".join(parts)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, k, have = [], 0, 0
    while have < size and k < len(data):
        n = data[k]
        if n < 128:
            out.append(data[k + 1 : k + n + 2])
            k, have = k + n + 2, have + n + 1
        elif n > 128:
            out.append(data[k + 1 : k + 2] * (257 - n))
            k, have = k + 2, have + 257 - n
        else:
            k += 1
    return b"".join(out)[:size]


def _widths(n: int) -> np.ndarray:
    """Bits of the n codes after a clear code: one more from the code on at which the table has 511, 1023 or 2047 entries."""
    entries = FIRST - 1 + np.arange(n)
    return 9 + (entries >= 511).astype(np.int64) + (entries >= 1023) + (entries >= 2047)


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first, a clear code before the table is full."""
    codes, widths = [CLEAR], [np.array([9])]
    known: dict[int, int] = {}
    free, last, since = FIRST, -1, 0
    get, put = known.get, codes.append
    for byte in data:
        if last < 0:
            last = byte
            continue
        key = last << 8 | byte
        code = get(key)
        if code is not None:
            last = code
            continue
        put(last)
        known[key] = free
        free += 1
        last = byte
        if free == LAST:
            put(last)
            put(CLEAR)
            widths.append(_widths(len(codes) - 1 - since))
            since = len(codes) - 1
            known.clear()
            free, last = FIRST, -1
    if last >= 0:
        put(last)
    put(END)
    widths.append(_widths(len(codes) - 1 - since))
    bits = np.concatenate(widths)
    value = np.array(codes, np.int64)
    table = (value[:, None] >> np.arange(11, -1, -1)) & 1
    used = np.arange(12)[None, :] >= 12 - bits[:, None]
    return np.packbits(table[used].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    """An entry of the table is a token's string and one byte more, which the output already holds from that token's place on;
    so a code copies from there. Codes are cut out of the bits for a whole table at once."""
    padded = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64)
    span = _widths(LAST)
    ends = np.cumsum(span)
    out, bit, limit = bytearray(), 0, len(data) * 8
    while len(out) < size and bit + 9 <= limit:
        stop = bit + ends
        count = int(np.searchsorted(stop, limit, side="right"))
        first = stop[:count] - span[:count]
        byte = first >> 3
        word = padded[byte] << 16 | padded[byte + 1] << 8 | padded[byte + 2]
        codes = word >> (24 - (first & 7) - span[:count]) & ((1 << span[:count]) - 1)
        special = np.flatnonzero((codes == CLEAR) | (codes == END))
        n = int(special[0]) if len(special) else count
        starts: list[int] = []
        put = starts.append
        for code in codes[:n].tolist():
            at = len(out)
            if code < 256:
                out.append(code)
            else:
                k = code - FIRST
                if k >= len(starts):
                    raise ValueError("an LZW code ahead of the table")
                a, b = starts[k], (starts[k + 1] if k + 1 < len(starts) else at) + 1
                out += out[a:b] if b <= at else out[a:at] + out[a : a + 1]
            put(at)
        if n == count or codes[n] == END:
            break
        bit += int(ends[n])
    if len(out) < size:
        raise ValueError("LZW data end too early")
    return bytes(out[:size])


def encode_block(rows: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        rows = np.concatenate([rows[:, :1], np.diff(rows, axis=1)], axis=1)
    if compression == PACKBITS:
        return packbits_encode(rows)
    data = rows.tobytes()
    return lzw_encode(data) if compression == LZW else zlib.compress(data, 6) if compression == DEFLATE else data


def decode_block(data: bytes, shape: tuple[int, int], compression: int, predictor: int) -> np.ndarray:
    size = shape[0] * shape[1]
    if compression == PACKBITS:
        data = packbits_decode(data, size)
    elif compression == LZW:
        data = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompressobj().decompress(data, size)  # no more than the block holds, whatever the data say
    elif compression != PLAIN:
        raise ValueError(f"compression {compression} isn't supported")
    if len(data) < size:
        raise ValueError("a strip or tile is too short")
    rows = np.frombuffer(data, np.uint8, size).reshape(shape)
    return np.cumsum(rows, axis=1, dtype=np.uint8) if predictor == 2 else rows


@dataclass(frozen=True)
class Page:
    """One image: rows x columns of samples, and how it was stored."""

    samples: np.ndarray
    compression: int = PLAIN
    predictor: int = 1
    tile: tuple[int, int] | None = None
    rows_per_strip: int = 128


def write_tiff(pages: list[Page], order: str = "<") -> bytes:
    """A file with a directory for each page, blocks before it; order: `<` little-endian, `>` big-endian."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for page in pages:
        height, width = page.samples.shape
        blocks = []
        if page.tile:
            th, tw = page.tile
            for y in range(0, height, th):
                for x in range(0, width, tw):
                    part = page.samples[y : y + th, x : x + tw]
                    blocks.append(np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]))))
        else:
            blocks = [page.samples[y : y + page.rows_per_strip] for y in range(0, height, page.rows_per_strip)]
        at, sizes = [], []
        for block in blocks:
            data = encode_block(block, page.compression, page.predictor)
            at.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)

        def offsets(values: list[int]) -> tuple[int, int, bytes]:
            return 4, len(values), struct.pack(f"{order}{len(values)}I", *values)

        short = lambda v: (3, 1, struct.pack(order + "HH", v, 0))
        long = lambda v: (4, 1, struct.pack(order + "I", v))
        fields = {WIDTH: long(width), LENGTH: long(height), BITS: short(8), COMPRESSION: short(page.compression), PHOTOMETRIC: short(1), SAMPLES: short(1), PREDICTOR: short(page.predictor)}
        if page.tile:
            fields |= {TILE_WIDTH: long(page.tile[1]), TILE_LENGTH: long(page.tile[0]), TILE_AT: offsets(at), TILE_BYTES: offsets(sizes)}
        else:
            fields |= {ROWS: long(page.rows_per_strip), STRIP_AT: offsets(at), STRIP_BYTES: offsets(sizes)}
        entries = []
        for tag in sorted(fields):
            kind, count, value = fields[tag]
            if len(value) > 4:
                place = len(out)
                out += value
                value = struct.pack(order + "I", place)
            entries.append(struct.pack(order + "HHI", tag, kind, count) + value)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_tiff(data: bytes) -> list[Page]:
    """The pages of a file of either byte order, one 8-bit sample for each pixel. Raises ValueError for anything else."""
    pages = read_each(data)
    for page in pages:
        if isinstance(page, ValueError):
            raise page
    return pages


def read_each(data: bytes) -> list[Page | ValueError]:
    """Each page, or why it can't be read. Raises ValueError if the file's directories can't be followed."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF file")
    at, found, seen = struct.unpack_from(order + "I", data, 4)[0], [], set()
    try:
        while at:
            if at in seen:
                raise ValueError("directories in a circle")
            seen.add(at)
            fields: dict[int, list[int]] = {}
            (count,) = struct.unpack_from(order + "H", data, at)
            for k in range(count):
                tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
                code = {1: "B", 3: "H", 4: "I"}.get(kind)
                if code is None:
                    continue
                place = at + 10 + 12 * k
                if TYPE_BYTES[kind] * n > 4:
                    (place,) = struct.unpack_from(order + "I", data, place)
                fields[tag] = list(struct.unpack_from(f"{order}{n}{code}", data, place))
            (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)
            found.append(fields)
    except (struct.error, KeyError, IndexError, OverflowError, MemoryError) as error:
        raise ValueError(f"a damaged TIFF file: {error!r}") from error
    pages: list[Page | ValueError] = []
    for fields in found:
        try:
            pages.append(_page(data, fields))
        except ValueError as error:
            pages.append(error)
        except (struct.error, KeyError, IndexError, OverflowError, zlib.error) as error:
            pages.append(ValueError(f"a damaged TIFF page: {error!r}"))
    return pages


def _page(data: bytes, fields: dict[int, list[int]]) -> Page:
    one = lambda tag, default: fields.get(tag, [default])[0]
    width, height = fields[WIDTH][0], fields[LENGTH][0]
    compression, predictor = one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
    if one(BITS, 1) != 8 or one(SAMPLES, 1) != 1 or predictor not in (1, 2):
        raise ValueError("only one 8-bit sample a pixel, without or with horizontal differences")
    if not width or not height or width * height > min(2**31 - 1, MOST_RATIO * len(data)):
        raise ValueError(f"{width} x {height} samples in a file of {len(data)} bytes")
    tiled = TILE_AT in fields
    th, tw = (fields[TILE_LENGTH][0], fields[TILE_WIDTH][0]) if tiled else (min(one(ROWS, height), height), width)
    if not th or not tw or th * tw > min(2**31 - 1, MOST_RATIO * len(data)):
        raise ValueError(f"strips or tiles of {tw} x {th} samples")
    at, sizes = (fields[TILE_AT], fields[TILE_BYTES]) if tiled else (fields[STRIP_AT], fields[STRIP_BYTES])
    across, down = -(-width // tw), -(-height // th)
    if len(at) != across * down or len(sizes) != len(at):
        raise ValueError(f"{len(at)} strips or tiles, {across * down} are needed")
    out = np.zeros((height, width), np.uint8)
    for k, (place, n) in enumerate(zip(at, sizes, strict=True)):
        y, x = k // across * th, k % across * tw
        if place + n > len(data):
            raise ValueError("a strip or tile beyond the end of the file")
        block = decode_block(data[place : place + n], (th if tiled else min(th, height - y), tw), compression, predictor)
        out[y : y + th, x : x + tw] = block[: height - y, : width - x]
    return Page(out, compression, predictor, (th, tw) if tiled else None, th)
