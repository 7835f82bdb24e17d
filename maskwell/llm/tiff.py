"""TIFF as a media column: write pages, walk image directories, decode strips and tiles, one row per page.

Written from the public TIFF 6.0 description and its Deflate supplement. The reader takes both byte orders, strips and
tiles, chunky and planar samples of 1 to 16 bits, no compression, PackBits, LZW and Deflate, and the horizontal predictor
for 8- and 16-bit samples. What it unpacks is bounded by the sizes that a directory states, and these by ``MAX_PAGE``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table, text_of

# Fixed values of the TIFF format: tags, compressions, field types with their sizes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_AT, TILE_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

#: The pages that documents are stored in: samples in a row, rows in a page, a strip and a tile.
ROW, PAGE_ROWS, CHUNK_ROWS = 64, 1024, 256
#: Bytes of a page's samples at most; a directory that states more is a fault.
MAX_PAGE = 1 << 28


def packbits(data: bytes) -> bytes:
    """Runs of three or more become two bytes, the rest goes as literals of at most 128."""
    out, literal, i, n = bytearray(), bytearray(), 0, len(data)

    def flush() -> None:
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run >= 3:
            flush()
            out += bytes((257 - run, data[i]))
        else:
            literal += data[i : i + run]
        i += run
    flush()
    return bytes(out)


def unpackbits(data: bytes, most: int = MAX_PAGE) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < most:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """MSB-first codes of 9 to 12 bits; 256 clears the table, 257 ends; widths change one code early."""
    bits, held, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal bits, held
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    codes, width, now = {bytes((b,)): b for b in range(256)}, 9, b""
    put(256, width)
    following = 258
    for k in range(len(data)):
        longer = now + data[k : k + 1]
        if longer in codes:
            now = longer
            continue
        put(codes[now], width)
        codes[longer] = following
        following += 1
        if following >= 4095:
            put(256, width)
            codes, width, following = {bytes((b,)): b for b in range(256)}, 9, 258
        elif following >= (1 << width):
            width += 1
        now = data[k : k + 1]
    if now:
        put(codes[now], width)
        following += 1
        if following >= (1 << width) and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def unlzw(data: bytes, most: int = MAX_PAGE) -> bytes:
    table, width, before, out, size = [], 9, None, [], 0
    bits = held = 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            table, width, before = [bytes((b,)) for b in range(256)] + [b"", b""], 9, None
        elif code == 257:
            break
        else:
            if not table:
                raise ValueError("LZW data does not begin with a clear code")
            if before is None:
                entry = table[code]
            else:
                if code > len(table):
                    raise ValueError("LZW code beyond the table")
                entry = table[code] if code < len(table) else before + before[:1]
                table.append(before + entry[:1])
            out.append(entry)
            size += len(entry)
            if size >= most:
                break
            before = entry
            if len(table) + 1 >= (1 << width) and width < 12:
                width += 1
    return b"".join(out)


def compressed(data: bytes, how: int) -> bytes:
    return {NONE: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, 6)}[how](data)


def decompressed(data: bytes, how: int, most: int = MAX_PAGE) -> bytes:
    """At least ``most`` bytes of what was compressed, if there are so many; not much more."""
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    if how not in (NONE, PACKBITS, LZW):
        raise ValueError(f"compression {how} is not supported")
    return data[:most] if how == NONE else {PACKBITS: unpackbits, LZW: unlzw}[how](data, most)


def differences(data: bytes, row: int) -> bytes:
    """The horizontal predictor for 8-bit samples, one a pixel."""
    import numpy as np

    a = np.frombuffer(data, np.uint8).reshape(-1, row)
    out = a.copy()
    out[:, 1:] -= a[:, :-1]
    return out.tobytes()


@dataclass
class Page:
    """A page to be written: grey 8-bit rows of ``width`` samples."""

    data: bytes
    width: int
    compression: int = NONE
    predictor: int = 1
    tile: tuple[int, int] | None = None  # width, length
    strip_rows: int = CHUNK_ROWS


def write_tiff(pages: list[Page], order: str = "<") -> bytes:
    """A TIFF file; chunks first, then the directory, page by page."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0")
    link = 4  # where the offset of the next directory goes
    for page in pages:
        rows = len(page.data) // page.width
        parts, fields = [], {WIDTH: page.width, LENGTH: rows, BITS: 8, COMPRESSION: page.compression, PHOTOMETRIC: 1, SAMPLES: 1, PREDICTOR: page.predictor}
        if page.tile:
            wide, high = page.tile
            for top in range(0, rows, high):
                for left in range(0, page.width, wide):
                    tile = b"".join(page.data[r * page.width + left : r * page.width + min(left + wide, page.width)].ljust(wide, b"\0") for r in range(top, min(top + high, rows)))
                    parts.append((tile.ljust(wide * high, b"\0"), wide))
            fields |= {TILE_WIDTH: wide, TILE_LENGTH: high}
        else:
            step = page.strip_rows * page.width
            parts = [(page.data[k : k + step], page.width) for k in range(0, len(page.data), step)]
            fields |= {STRIP_ROWS: page.strip_rows}
        at, sizes = [], []
        for part, row in parts:
            part = compressed(differences(part, row) if page.predictor == 2 else part, page.compression)
            at.append(len(out))
            sizes.append(len(part))
            out += part + b"\0" * (len(part) % 2)
        fields |= {TILE_AT: at, TILE_BYTES: sizes} if page.tile else {STRIP_AT: at, STRIP_BYTES: sizes}
        entries = b""
        for tag, value in sorted(fields.items()):
            many = value if isinstance(value, list) else [value]
            packed = struct.pack(f"{order}{len(many)}I", *many)
            if len(packed) > 4:
                where = len(out)
                out += packed
                packed = struct.pack(f"{order}I", where)
            entries += struct.pack(f"{order}HHI", tag, 4, len(many)) + packed
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_tiff(media: bytes):
    """Yield for each page a dict of ``page, width, height, bits, samples, compression, predictor, pixels``.

    ``pixels`` are the samples row by row, 16-bit ones in little-endian order. Directories that come round again end
    the walk.
    """
    order = {b"II": "<", b"MM": ">"}.get(bytes(media[:2]))
    if order is None or struct.unpack_from(f"{order}H", media, 2)[0] != 42:
        raise ValueError("no TIFF header")
    at, seen, number = struct.unpack_from(f"{order}I", media, 4)[0], set(), 0
    while at and at not in seen:
        seen.add(at)
        fields, n = {}, struct.unpack_from(f"{order}H", media, at)[0]
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", media, at + 2 + 12 * k)
            where = at + 10 + 12 * k
            if FIELD_SIZE.get(kind, 0) * count > 4:
                where = struct.unpack_from(f"{order}I", media, where)[0]
            if letter := {1: "B", 3: "H", 4: "I"}.get(kind):
                fields[tag] = struct.unpack_from(f"{order}{count}{letter}", media, where)
        yield {"page": number, **decoded(media, fields, order)}
        number += 1
        at = struct.unpack_from(f"{order}I", media, at + 2 + 12 * n)[0]


def decoded(media: bytes, fields: dict, order: str) -> dict:
    """The samples of one directory, chunky; samples of fewer than 8 bits get a byte each."""
    import numpy as np

    one = lambda tag, least: fields.get(tag, (least,))[0]
    width, height, bits, samples, how, predictor, planar = one(WIDTH, 0), one(LENGTH, 0), one(BITS, 1), one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    if bits not in (1, 2, 4, 8, 16) or predictor not in (1, 2) or predictor == 2 and bits < 8 or planar not in (1, 2) or len(set(fields.get(BITS, (bits,)))) > 1:
        raise ValueError("samples must have 1, 2, 4, 8 or 16 bits, all the same, with the horizontal predictor from 8 on")
    tiled = TILE_AT in fields
    wide, high = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    if min(width, height, samples, wide, high) < 1 or max(width * height, wide * high) * samples * 2 > MAX_PAGE:
        raise ValueError(f"a page of {width} x {height} x {samples} samples in parts of {wide} x {high}")
    kind = np.dtype(np.uint16).newbyteorder(order) if bits == 16 else np.dtype(np.uint8)
    across, down = -(-width // wide), -(-height // high)
    planes, depth = (samples, 1) if planar == 2 else (1, samples)  # parts a place, samples of a pixel in a part
    where = fields[TILE_AT if tiled else STRIP_AT]
    if len(where) != across * down * planes:
        raise ValueError(f"{len(where)} parts instead of {across * down * planes}")
    image = np.zeros((height, width, samples), kind.newbyteorder("<"))
    for k, (at, size) in enumerate(zip(where, fields[TILE_BYTES if tiled else STRIP_BYTES], strict=True)):
        plane, place = divmod(k, across * down)
        top, left = place // across * high, place % across * wide
        rows = high if tiled else min(high, height - top)
        row_bytes = -(-wide * depth * bits // 8)
        data = decompressed(media[at : at + size], how, rows * row_bytes)
        if bits < 8:
            each = np.unpackbits(np.frombuffer(data, np.uint8, rows * row_bytes).reshape(rows, row_bytes), axis=1).reshape(rows, -1, bits)
            part = (each << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)[:, : wide * depth]
        else:
            part = np.frombuffer(data, kind, rows * wide * depth)
        part = part.reshape(rows, wide, depth)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype.newbyteorder("="))
        image[top : top + rows, left : left + wide, plane : plane + depth] = part[: height - top, : width - left]
    return {"width": width, "height": height, "bits": bits, "samples": samples, "compression": how, "predictor": predictor, "pixels": image.tobytes()}


PAGE_SCHEMA = "page int, width int, height int, bits int, samples int, compression int, predictor int, pixels binary, error string"


def media_pages(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per page of each file in the binary column ``media``: the ``key`` column and ``PAGE_SCHEMA``.

    A null file has no rows, an empty table none. A file that can't be read has one row more with null fields and the
    reason in ``error``; pages before the fault stay. Repeated rows are read once each; other columns are not read. A key
    column that is named like one of ``PAGE_SCHEMA`` comes out as ``key``.
    """
    kind = df.schema[key].dataType.simpleString()

    def read(rows: dict) -> dict:
        out: dict = {k: [] for k in ("key", *[x.split()[0] for x in PAGE_SCHEMA.split(", ")])}

        def put(k, page: dict) -> None:
            for name in out:
                out[name].append(k if name == "key" else page.get(name))

        for k, data in zip(rows["key"], rows["media"], strict=True):
            if data is None:
                continue
            try:
                for page in read_tiff(data):
                    put(k, page)
            except (ValueError, KeyError, IndexError, struct.error, zlib.error) as error:
                put(k, {"error": str(error) or type(error).__name__})
        return out

    return map_slices(df.select(F.col(key).alias("key"), F.col(media).alias("media")), read, f"key {kind}, {PAGE_SCHEMA}", rows=16).withColumnRenamed("key", "key" if f" {key} " in f" {PAGE_SCHEMA} " else key)


def stored(payload: bytes) -> bytes:
    """The payload as a TIFF file of one or more pages.

    Pages hold up to 1,024 rows of 64 samples. How a page is stored goes by the crc32 of its samples, so that equal texts
    have equal files and every codec gets pages of all sizes: of 16 pages on average 2 are LZW, 3 PackBits and 11 Deflate,
    in strips and in tiles, plain and with the horizontal predictor.
    """
    pages, step, tile = [], ROW * PAGE_ROWS, (ROW, CHUNK_ROWS)
    for k in range(0, len(payload), step):
        data = payload[k : k + step]
        kind = zlib.crc32(data) % 16
        how = LZW if kind < 2 else PACKBITS if kind < 5 else DEFLATE
        pages.append(Page(data, ROW, how, 2 if how == DEFLATE and kind % 3 == 0 or kind == 1 else 1, tile if kind % 2 else None))
    return write_tiff(pages)


def feature(pages: list[dict], payload: bytes) -> str:
    """Page count and rows, the sum of all samples, and how many fall in each eighth of the range."""
    import numpy as np

    a = np.frombuffer(payload, np.uint8)
    return f"pages={len(pages)};rows={sum(p['height'] for p in pages)};sum={int(a.sum(dtype=np.int64))};hist={','.join(map(str, np.bincount(a >> 5, minlength=8).tolist()))}"


MEDIA_SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_pages int"


def documents_as_media(docs: DataFrame) -> DataFrame:
    """Store every text as a TIFF file, read the file back and describe what was read: ``MEDIA_SCHEMA``.

    The UTF-8 bytes of the text, with zero bytes up to a positive multiple of 64, are the samples. Null and empty texts
    are 64 zero bytes. Repeated rows give equal rows, an empty table none; other columns are not read.
    """

    def run(rows: dict) -> dict:
        out: dict = {x.split()[0]: [] for x in MEDIA_SCHEMA.split(", ")}
        for doc_id, raw in zip(rows["doc_id"], rows["raw"], strict=True):
            media = stored(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"))
            pages = list(read_tiff(media))
            back = b"".join(p["pixels"] for p in pages)
            row = (doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(pages, back), len(pages))
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        return out

    return map_slices(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().cast("binary").alias("raw")), run, MEDIA_SCHEMA)


def op7_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_media(table(spark, sf_dir, "documents"))
