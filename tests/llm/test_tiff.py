import hashlib
import random
import struct
import zlib

import pytest

from maskwell.llm import tiff


def samples():
    rng = random.Random(7)
    yield b"a" * 5000
    yield bytes(rng.randrange(256) for _ in range(9000))
    yield b"abcabcabd" * 3000
    yield bytes(64)
    yield bytes(rng.choice(b"ab") for _ in range(70000))


@pytest.mark.parametrize("data", samples(), ids=range(5))
def test_codecs_round_trip(data):
    assert tiff.unpackbits(tiff.packbits(data)) == data
    assert tiff.unlzw(tiff.lzw(data)) == data


def test_lzw_known_bytes():
    # 7 7 7 8 8 7 7 6 6 as codes 256 7 258 8 8 258 6 6 257, nine bits each
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    assert tiff.lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))


def test_packbits_known_bytes():
    # the example of Apple's technical note 1023
    coded = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA")
    assert tiff.unpackbits(coded) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("how", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (32, 16), (64, 48)])
def test_pages_round_trip(order, how, predictor, tile):
    rng = random.Random(3)
    datas = [bytes(rng.randrange(256) for _ in range(64 * h)) for h in (1, 50, 300)]
    media = tiff.write_tiff([tiff.Page(d, 64, how, predictor, tile, 100) for d in datas], order)
    pages = list(tiff.read_tiff(media))
    assert [p["pixels"] for p in pages] == datas
    assert [p["height"] for p in pages] == [1, 50, 300]


def test_faults_are_rows(spark):
    good = tiff.stored(b"x" * 128)
    loop = bytearray(good)
    loop[-4:] = loop[4:8]  # the last directory points at the first
    rows = [(1, good), (2, b"no"), (3, None), (4, bytes(loop)), (1, good), (5, good[:20])]
    got = tiff.media_pages(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect()
    assert sorted((r.id, r.page) for r in got if r.error is None) == [(1, 0), (1, 0), (4, 0)]
    assert sorted(r.id for r in got if r.error) == [2, 5]


def raw_page(width, height, bits, samples, parts, strip_rows=None, planar=1, how=tiff.NONE):
    """A file of one page whose strips are given as stored; every field is a long."""
    out, at = bytearray(b"II*\0\0\0\0\0"), []
    for p in parts:
        at.append(len(out))
        out += p
    fields = {256: [width], 257: [height], 258: [bits], 259: [how], 273: at, 277: [samples], 278: [strip_rows or height], 279: [len(p) for p in parts], 284: [planar]}
    entries = b""
    for tag, values in sorted(fields.items()):
        data = struct.pack(f"<{len(values)}I", *values)
        if len(data) > 4:
            where, data = len(out), data
            out += data
            data = struct.pack("<I", where)
        entries += struct.pack("<HHI", tag, 4, len(values)) + data
    struct.pack_into("<I", out, 4, len(out))
    return bytes(out + struct.pack("<H", len(fields)) + entries + b"\0\0\0\0")


def test_bilevel_and_planar_pages():
    [page] = tiff.read_tiff(raw_page(10, 2, 1, 1, [tiff.packbits(bytes([0b10110000, 0b01000000, 0b11111111, 0b11000000]))], how=tiff.PACKBITS))
    assert list(page["pixels"]) == [1, 0, 1, 1, 0, 0, 0, 0, 0, 1] + [1] * 10
    [page] = tiff.read_tiff(raw_page(3, 1, 4, 1, [bytes([0x1F, 0x70])]))
    assert list(page["pixels"]) == [1, 15, 7]
    [page] = tiff.read_tiff(raw_page(2, 2, 8, 3, [bytes([1, 2]), bytes([3, 4]), bytes([5, 6]), bytes([7, 8]), bytes([9, 10]), bytes([11, 12])], strip_rows=1, planar=2))
    assert list(page["pixels"]) == [1, 5, 9, 2, 6, 10, 3, 7, 11, 4, 8, 12]


def test_malformed_files_are_error_rows(spark):
    files = [
        raw_page(0, 4, 8, 1, [b"abcd"]), raw_page(4, 0, 8, 1, [b"abcd"]), raw_page(1 << 31, 1 << 31, 8, 1, [b"abcd"]), raw_page(4, 1, 8, 1, [b"ab"]), raw_page(4, 1, 8, 1, [b"abcd", b"e"]),
        raw_page(4, 1, 32, 1, [b"abcd" * 4]), raw_page(4, 1, 8, 0, [b"abcd"]), raw_page(4, 1, 8, 1, [b"abcd"], how=77), raw_page(4, 1, 8, 1, [b"abcd"], how=tiff.LZW), raw_page(4, 1, 8, 1, [b"abcd"], how=tiff.DEFLATE),
    ]
    got = tiff.media_pages(spark.createDataFrame(list(enumerate(files)), "page long, media binary"), "page", "media").collect()
    assert sorted(r.key for r in got) == list(range(len(files))) and all(r.error and r.pixels is None for r in got)
    assert len(tiff.decompressed(zlib.compress(bytes(10**7)), tiff.DEFLATE, 1000)) == 1000
    empty = spark.createDataFrame([], "id long, media binary")
    assert tiff.media_pages(empty, "id", "media").collect() == []


def walk(media):
    """(compression, predictor, tiled, samples) of each page of little-endian grey 8-bit files, by a reader of its own."""
    def u32(k):
        return int.from_bytes(media[k : k + 4], "little")

    def codes(data):
        number, n, width, size = int.from_bytes(data, "big"), len(data) * 8, 9, 258
        while n >= width:
            n -= width
            code = number >> n & (1 << width) - 1
            yield code
            size = 258 if code == 256 else size + 1
            width = 9 if code == 256 else 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
            if code == 257:
                return

    def plain(data, how):
        out, k = b"", 0
        if how == 8:
            return zlib.decompress(data)
        if how == 32773:
            while k < len(data):
                out, k = (out + data[k + 1 : k + 2 + data[k]], k + 2 + data[k]) if data[k] < 128 else (out + data[k + 1 : k + 2] * (257 - data[k]), k + 2)
            return out
        known, last = {}, b""
        for code in codes(data):
            if code == 256:
                known, last = {b: bytes([b]) for b in range(256)}, b""
            elif code != 257:
                now = known.get(code, last + last[:1])
                if last:
                    known[258 + len(known) - 256] = last + now[:1]
                last, out = now, out + now
        return out

    at = u32(4)
    while at:
        n = int.from_bytes(media[at : at + 2], "little")
        f = {}
        for k in range(n):
            e = at + 2 + 12 * k
            count = u32(e + 4)
            f[int.from_bytes(media[e : e + 2], "little")] = [u32((e + 8 if count == 1 else u32(e + 8)) + 4 * j) for j in range(count)]
        where, sizes, (width,), (height,) = f.get(324) or f[273], f.get(325) or f[279], f[256], f[257]
        data = b"".join(plain(media[a : a + s], f[259][0]) for a, s in zip(where, sizes))[: width * height]
        if f[317] == [2]:
            data = b"".join(bytes(sum(data[r + c0] for c0 in range(c + 1)) % 256 for c in range(width)) for r in range(0, len(data), width))
        yield f[259][0], f[317][0], 324 in f, data
        at = u32(at + 2 + 12 * n)


def test_stored_files_by_another_reader(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["lorem ", "ipsum ", "é", "\n", "aaaaaaaa", str(rng.random())]) for _ in range(rng.choice([1, 20, 300, 1500]))) for _ in range(120)]
    rows = {r.doc_id: r for r in tiff.documents_as_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    kinds = set()
    for k, t in enumerate(texts):
        raw = t.encode()
        payload = raw + bytes(-len(raw) % 64)
        media = tiff.stored(payload)
        pages = list(walk(media))
        assert b"".join(p[3] for p in pages) == payload
        kinds |= {(p[0], p[2]) for p in pages if len(p[3]) > 1024}
        counts = [sum(32 * e <= b < 32 * e + 32 for b in payload) for e in range(8)]
        feature = f"pages={len(pages)};rows={len(payload) // 64};sum={sum(payload)};hist={','.join(map(str, counts))}"
        assert (rows[k].media_bytes, rows[k].media_sha256, rows[k].feature) == (len(media), hashlib.sha256(media).hexdigest(), feature)
    assert kinds == {(how, tiled) for how in (tiff.LZW, tiff.PACKBITS, tiff.DEFLATE) for tiled in (False, True)}


def test_documents(spark):
    texts = [None, "", "short", "é" * 700, "long text " * 20000, "short", "x" * 64]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, feature string")
    got = {r.doc_id: r for r in tiff.documents_as_media(docs).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        assert (got[k].n_bytes, got[k].payload_bytes) == (len(raw), len(payload))
        assert got[k].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert got[k].tail_crc32 == zlib.crc32(payload[-64:])
    assert got[2][1:] == got[5][1:]
    assert got[4].n_pages == 4
    assert tiff.documents_as_media(docs.limit(0)).collect() == []
