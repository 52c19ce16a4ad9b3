"""TIFF files: a writer, and a reader that walks image directories and gives one row per page.

The reader takes little- and big-endian classic files, strips and tiles, 8-bit chunky samples, compression by PackBits, LZW or
deflate or none, and the horizontal predictor. Sizes are checked against the file and PAGE_BYTES before anything is decoded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmix.llm.batches import bounded, chunks, map_text, tidied

# Fixed values of the format: tag numbers, field types and compression codes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
FIELD = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

#: Bytes of samples that the reader decodes for one page; a page that claims more is an error.
PAGE_BYTES = 1 << 28
#: Samples that features are summed of at a time, and bytes of samples from which on pages leave a task.
FEATURE_BLOCK, OUT_BYTES = 1 << 20, 8 << 20
#: Pixels and samples of a row of the payload's pages, and rows of a page, strip and tile.
PIXELS, CHANNELS, PAGE_ROWS, BLOCK_ROWS = 64, 3, 1 << 14, 256
ROW = PIXELS * CHANNELS


class Page(NamedTuple):
    """A decoded image directory."""

    width: int
    length: int
    channels: int
    compression: int
    predictor: int
    blocks: int
    samples: np.ndarray


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of equal bytes, and the bytes between them."""
    out, k, n = bytearray(), 0, len(data)
    codes = np.frombuffer(data, dtype=np.uint8)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [n]]) if n else np.array([0])
    long = [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) if b - a >= 3]
    for a, b in [*long, (n, n)]:
        for j in range(k, a, 128):
            out += bytes([min(128, a - j) - 1]) + data[j : min(a, j + 128)]
        for j in range(a, b, 128):
            size = min(128, b - j)
            out += bytes([257 - size, data[j]]) if size > 1 else bytes([0, data[j]])
        k = b
    return bytes(out)


def unpack_bits(data: bytes, limit: int | None = None) -> bytes:
    """The inverse of pack_bits; stops where the data stop. One byte of data makes 64 at most, so ``limit`` only cuts the result."""
    parts, k, n = [], 0, len(data)
    while k < n:
        head = data[k]
        if head < 128:
            parts.append(data[k + 1 : k + 2 + head])
            k += 2 + head
        else:
            if head > 128:
                parts.append(data[k + 1 : k + 2] * (257 - head))
            k += 2 if head > 128 else 1
    return b"".join(parts)[:limit]


#: Entries of a fresh LZW table, and those at which a writer clears it. Fixed values of the format, as are codes 256 (clear) and 257 (end).
FRESH, FULL = 258, 4094
#: Bits of the k-th code after a clear one: as many as the table's size needs then, 12 at most.
_BITS = np.array([min(12, (FRESH + k).bit_length()) for k in range(1 << 13)], dtype=np.int64)


def lzw_pack(data: bytes) -> bytes:
    """LZW as the format has it: codes from the high bit, 9 to 12 bits wide, one code early."""
    codes, widths, run = [], [], []

    def close(code: int):
        nonlocal run
        codes.append(np.array([*run, code], dtype=np.uint16))
        widths.append(_BITS[: len(run) + 1])
        run = []

    close(256)
    if data:
        # Entries by the code of what stands before the last byte, and that byte.
        table: dict[int, int] = {}
        get, size, code = table.get, FRESH, data[0]
        for byte in data[1:]:
            key = code << 8 | byte
            longer = get(key)
            if longer is not None:
                code = longer
                continue
            run.append(code)
            table[key] = size
            size += 1
            if size == FULL:
                close(256)
                table.clear()
                size = FRESH
            code = byte
        run.append(code)
    close(257)
    bits = np.unpackbits(np.concatenate(codes).astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)
    return np.packbits(bits[np.arange(16) >= 16 - np.concatenate(widths)[:, None]]).tobytes()


_SINGLE = [bytes([k]) for k in range(256)] + [b"", b""]


def lzw_unpack(data: bytes, limit: int | None = None) -> bytes:
    """The inverse of lzw_pack; stops where the data or its code say so, or once ``limit`` bytes are there. ValueError for a code of no entry."""
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    total, at, k, parts, left = 8 * len(data), 0, 0, [], float("inf") if limit is None else limit
    table, last = list(_SINGLE), b""
    while left > 0:
        # Widths depend on the number of codes since a clear one, so many codes are cut out at once, up to the next such code.
        widths = _BITS[np.minimum(np.arange(k, k + FULL), len(_BITS) - 1)]
        ends = at + np.cumsum(widths)
        n = int(np.searchsorted(ends, total, side="right"))
        widths, ends = widths[:n], ends[:n]
        where = ends - widths
        byte = where >> 3
        codes = (raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - (where & 7) - widths) & (1 << widths) - 1
        stops = np.flatnonzero((codes == 256) | (codes == 257))
        stop = int(stops[0]) if len(stops) else n
        for code in codes[:stop].tolist():
            if code < len(table):
                word = table[code]
            elif code == len(table) and last:
                word = last + last[:1]
            else:
                raise ValueError("a code that stands for nothing yet")
            if last:
                table.append(last + word[:1])
            parts.append(word)
            last = word
            left -= len(word)
            if left <= 0:
                break
        if not n or stop < n and codes[stop] == 257:
            break
        if stop < n:
            at, k, table, last = int(ends[stop]), 0, list(_SINGLE), b""
        else:
            at, k = int(ends[-1]), k + n
    return b"".join(parts)[:limit]


PACK = {NONE: bytes, LZW: lzw_pack, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: pack_bits}


def _inflate(data: bytes, limit: int) -> bytes:
    """At most ``limit`` bytes of deflated data."""
    return zlib.decompressobj().decompress(data, limit)


#: Each gives at least as many bytes as a block needs, and not without bound.
UNPACK = {NONE: lambda x, n: x[:n], LZW: lzw_unpack, DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: unpack_bits}


def _fields(entries: dict[int, tuple[int, list[int]]], at: int) -> bytes:
    """A directory that stands at ``at``, its long values behind it, without the pointer to the next one."""
    body, extra, behind = struct.pack("<H", len(entries)), b"", at + 2 + 12 * len(entries) + 4
    for tag in sorted(entries):
        kind, values = entries[tag]
        raw = struct.pack(f"<{len(values)}{FIELD[kind][0]}", *values)
        if len(raw) > 4:
            body += struct.pack("<HHII", tag, kind, len(values), behind + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            body += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return body + b"\0\0\0\0" + extra


def write_tiff(pages: list[tuple[np.ndarray, int, bool, int]]) -> bytes:
    """A file of (samples by rows, columns and channels; compression; predictor; width of tiles, 0 for strips) pages."""
    out, pointer = bytearray(b"II*\0\0\0\0\0"), 4
    for samples, compression, predictor, across in pages:
        length, width, channels = samples.shape
        down = min(BLOCK_ROWS, -(-length // 16) * 16) if across else BLOCK_ROWS
        blocks = []
        for top in range(0, length, down):
            for left in range(0, width, across or width):
                block = samples[top : top + down, left : left + (across or width)]
                if across and block.shape[:2] != (down, across):
                    block = np.pad(block, ((0, down - block.shape[0]), (0, across - block.shape[1]), (0, 0)))
                if predictor:
                    block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
                blocks.append(PACK[compression](block.tobytes()))
        offsets = []
        for block in blocks:
            offsets.append(len(out))
            out += block + b"\0" * (len(block) % 2)
        entries = {WIDTH: (4, [width]), LENGTH: (4, [length]), BITS: (3, [8] * channels), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if channels == 3 else 1]), SAMPLES: (3, [channels]), PREDICTOR: (3, [2 if predictor else 1])}
        counts = [len(x) for x in blocks]
        entries |= {TILE_WIDTH: (4, [across]), TILE_LENGTH: (4, [down]), TILE_OFFSETS: (4, offsets), TILE_COUNTS: (4, counts)} if across else {ROWS_PER_STRIP: (4, [down]), STRIP_OFFSETS: (4, offsets), STRIP_COUNTS: (4, counts)}
        at = len(out)
        out[pointer : pointer + 4] = struct.pack("<I", at)
        out += _fields(entries, at)
        pointer = at + 2 + 12 * len(entries)
    return bytes(out)


def read_tiff(data: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories; ValueError where it isn't one that can be read."""
    try:
        yield from _pages(data)
    except (struct.error, zlib.error, LookupError, OverflowError) as e:
        raise ValueError(f"a damaged file: {type(e).__name__}: {e}") from e


def _pages(data: bytes) -> Iterator[Page]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,), seen = struct.unpack_from(f"{order}I", data, 4), set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("a directory points outside the file or back to an earlier one")
        seen.add(at)
        (n,), tags = struct.unpack_from(f"{order}H", data, at), {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
            if kind in FIELD:
                code, size = FIELD[kind]
                where = at + 10 + 12 * k
                if count * size > len(data):
                    raise ValueError("a field that is longer than the file")
                if count * size > 4:
                    (where,) = struct.unpack_from(f"{order}I", data, where)
                tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, where)
        (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)
        yield _page(data, tags)


def _page(data: bytes, tags: dict[int, tuple[int, ...]]) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, length, channels = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1)
    compression, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if set(tags.get(BITS, (1,))) != {8} or compression not in UNPACK or predictor not in (1, 2):
        raise ValueError("bits, compression or predictor that isn't read here")
    tiled = TILE_OFFSETS in tags
    across, down = (one(TILE_WIDTH, width), one(TILE_LENGTH, length)) if tiled else (width, min(one(ROWS_PER_STRIP, length), length))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_COUNTS, ()))
    if min(width, length, channels, across, down) < 1:
        raise ValueError("a width, length, number of samples or block size of zero")
    if width * length * channels > PAGE_BYTES or across * down * channels > PAGE_BYTES:
        raise ValueError(f"a page of {width} x {length} x {channels} samples")
    columns = -(-width // across)
    if len(offsets) != len(counts) or len(offsets) < columns * -(-length // down):
        raise ValueError("fewer blocks than the page needs")
    samples = np.zeros((length, width, channels), dtype=np.uint8)
    for k, (a, size) in enumerate(zip(offsets, counts)):
        top, left = k // columns * down, k % columns * across
        if top >= length:
            break
        rows = down if tiled else min(down, length - top)
        raw = UNPACK[compression](data[a : a + size], rows * across * channels)
        if len(raw) < rows * across * channels:
            raise ValueError("a block that ends early")
        block = np.frombuffer(raw, dtype=np.uint8).reshape(rows, across, channels)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        part = samples[top : top + rows, left : left + across]
        part[:] = block[: part.shape[0], : part.shape[1]]
    return Page(width, length, channels, compression, predictor, len(offsets), samples)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the text in UTF-8 with blanks up to a positive multiple of a row."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b" ")


#: What a page may be written with: compression, predictor, tiles and their width in pixels.
FORMS = [(c, predictor, tile) for c in (LZW, DEFLATE, PACKBITS) for predictor in (False, True) for tile in (0, 16, 48)]


def store(payload: bytes) -> bytes:
    """A payload as a file. Each page's codec, predictor and layout come from a hash of the payload and the page's number.

    So all decoders meet payloads of all sizes, and equal payloads give equal files. A page has PAGE_ROWS rows at most.
    """
    samples = np.frombuffer(payload, dtype=np.uint8).reshape(-1, PIXELS, CHANNELS)
    first = zlib.crc32(payload)
    return write_tiff([(samples[a : a + PAGE_ROWS], *FORMS[(first + k) % len(FORMS)]) for k, a in enumerate(range(0, len(samples), PAGE_ROWS))])


def features(samples: np.ndarray) -> str:
    """Mean and deviation of each channel, and the mean step between neighbours in a row, each in thousandths.

    Summed block by block, as wide integers of a whole page would take many times its size.
    """
    length, width, channels = samples.shape
    across = max(1, min(width, FEATURE_BLOCK // channels))
    down = max(1, FEATURE_BLOCK // (across * channels))
    sums, squares, steps = np.zeros(channels, dtype=np.int64), np.zeros(channels, dtype=np.int64), 0
    for top in range(0, length, down):
        for left in range(0, width, across):
            # One more column, for the step to it.
            part = samples[top : top + down, left : left + across + 1]
            steps += int(np.abs(np.diff(part.astype(np.int16), axis=1)).sum(dtype=np.int64))
            flat = part[:, :across].reshape(-1, channels).astype(np.int64)
            sums += flat.sum(axis=0)
            squares += (flat * flat).sum(axis=0)
    n = max(1, length * width)
    mean = sums / n
    spread = np.sqrt(np.maximum(squares / n - mean * mean, 0))
    step = steps / max(1, length * (width - 1) * channels)
    return ":".join(str(int(round(1000 * float(x)))) for x in [*mean, *spread, step])


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its text stored as a file, read back, and digests of both. Rows with equal texts get equal values.

    A null or empty text gives one row of blanks. Long texts get several pages; the whole text is stored. Nothing is shuffled.
    """

    def rows(ids, texts):
        out = {x: [] for x in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pages")}
        for text in texts:
            n, payload = payload_of(text)
            media = store(payload)
            pages = list(read_tiff(media))
            back = b"".join(x.samples.tobytes() for x in pages)
            samples = pages[0].samples if len(pages) == 1 else np.concatenate([x.samples for x in pages])
            for name, value in (("n_bytes", n), ("payload_bytes", len(back)), ("payload_sha256", hashlib.sha256(back).hexdigest()), ("tail_crc32", zlib.crc32(back[-16:])), ("media_bytes", len(media)), ("media_sha256", hashlib.sha256(media).hexdigest()), ("feature", features(samples)), ("pages", len(pages))):
                out[name].append(value)
        return out

    return map_text(docs, id_col, text_col, rows, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages long")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each text as a file, a null text as one of blanks."""
    return map_text(docs, id_col, text_col, lambda ids, texts: {"media": [store(payload_of(x)[1]) for x in texts]}, "media binary")


def read_pages(files: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """One row per page of each file in a binary column: shape, compression, feature and samples. What can't be read gives one row with ``error``.

    A null or empty file can't be read. Pages leave a task every OUT_BYTES, so a small file that unpacks to many large pages takes the
    memory of a few; a page has PAGE_BYTES at most.
    """
    import pyarrow as pa

    schema = f"{id_col} long, page int, width int, length int, channels int, compression int, predictor int, blocks int, feature string, samples binary, error string"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), *[pa.int32()] * 7, pa.string(), pa.binary(), pa.string()]

    def rows(batches):
        for part in chunks(batches, 1, OUT_BYTES):
            for key, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                k = -1
                try:
                    for k, x in enumerate(read_tiff(data or b"")):
                        yield key, k, *x[:6], features(x.samples), x.samples.tobytes(), None
                except ValueError as e:
                    yield key, k + 1, *[None] * 8, f"{type(e).__name__}: {e}"

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out), types)], names=names)

    def run(batches):
        out, size = [], 0
        for row in rows(batches):
            out.append(row)
            size += 1000 + len(row[9] or b"")
            if size >= OUT_BYTES:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    return bounded(files).select(F.col(id_col).cast("long").alias("id"), F.col(data_col).cast("binary").alias("data")).mapInArrow(tidied(run), schema)


ORACLE = f"SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, CAST(greatest({ROW}, ceil(strlen(coalesce(text, '')) / {ROW}.0) * {ROW}) AS BIGINT) AS payload_bytes FROM documents"
