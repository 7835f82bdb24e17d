r"""Secret scans over every layer of a text.

A worklist begins with the text itself. Each layer is scanned, and every encoded region in it becomes a new layer, bytes
that aren't UTF-8 replaced: URL escapes, Unicode or hex escapes (by runs and in the whole layer at once), base64 tokens, and base64 tokens that
hold gzip, zlib, bzip2, xz or zstd data. Layers already seen in this text are not taken up again, so cycles end and the
worklist reaches its fixpoint. A span found in a layer is mapped back, layer by layer, to the region of the original text
that it was decoded from: URL and Unicode layers map position by position, base64 layers by groups of characters, and
compressed layers to the whole token.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table, text_of

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")

URL_RUN = re.compile(r"(?:[A-Za-z0-9._~+/=&?:@!$'()*,;-]*%[0-9A-Fa-f]{2})+[A-Za-z0-9._~+/=&?:@!$'()*,;-]*")
URL_ONE = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_RUN = re.compile(r"(?:[!-\[\]-~]*(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}))+[!-\[\]-~]*")
UNICODE_ONE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})")
#: 16 characters decode to 12 bytes, the least that can hold an assignment worth finding.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: The standard and the URL-safe alphabet alone, for tokens that touch a separator which the other alphabet has.
ALPHABETS = (re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"))
#: How much of an unpacked layer is held at once. A longer one is scanned in overlapping windows and counted in ``n_cut``.
MAX_LAYER_BYTES = 64 << 20
OVERLAP, RUN = 1 << 16, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns; leftmost and non-overlapping for each kind."""
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def inflated(data: bytes, step: int):
    """The content of the first zlib or gzip member in chunks of at most ``step`` bytes; returns what follows the member."""
    d, at, left = zlib.decompressobj(47), 0, b""
    while not d.eof:
        fed = left or data[at : at + step]
        at += 0 if left else len(fed)
        out = d.decompress(fed, step)
        left = d.unconsumed_tail
        if out:
            yield out
        elif not fed:
            return b""
    return d.unused_data + data[at:]


def decompressed(d, data: bytes, step: int):
    """Likewise for a decompressor of bz2 or lzma."""
    at = 0
    while not d.eof:
        fed = data[at : at + step] if d.needs_input else b""
        at += len(fed)
        if d.needs_input and not fed:
            return b""
        if out := d.decompress(fed, step):
            yield out
    return d.unused_data + data[at:]


def zstd_frame(data: bytes, step: int):
    """Likewise for a zstd frame. 512 bytes of input give 22 MB at most, as a block has 3 bytes or more and gives up to 128 KB."""
    import zstandard

    d, at = zstandard.ZstdDecompressor().decompressobj(), 0
    while not d.eof:
        if at >= len(data):
            return b""
        out = d.decompress(data[at : at + 512])
        at += 512
        for k in range(0, len(out), step):
            yield out[k : k + step]
    return d.unused_data + data[at:]


def skipped(data: bytes, step: int):
    """A skippable zstd frame has nothing to show."""
    yield b""
    return data[8 + int.from_bytes(data[4:8], "little") :] if len(data) >= 8 else b""


def codec(data: bytes):
    """The function that unpacks what ``data`` begins with, or None."""
    if data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] == 0x78 and (data[0] * 256 + data[1]) % 31 == 0):
        return inflated
    if data[:3] == b"BZh":
        return lambda data, step: decompressed(bz2.BZ2Decompressor(), data, step)
    if data[:6] == b"\xfd7zXZ\0":
        return lambda data, step: decompressed(lzma.LZMADecompressor(), data, step)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return zstd_frame
    return skipped if data[1:4] == b"\x2a\x4d\x18" and data[0] >> 4 == 5 else None


def unpacked(data: bytes, step: int, broken: list):
    """Chunks of all that compressed ``data`` holds, member after member; what follows the last one comes as it is.

    ``broken`` gets an entry if a member can't be read to its end.
    """
    while data:
        unpack, some = codec(data), False
        if unpack is None:
            yield data
            return
        try:
            members = unpack(data, step)
            while True:
                try:
                    out = next(members)
                except StopIteration as end:
                    data = end.value.lstrip(b"\0")  # padding
                    break
                some = True
                yield out
        except Exception as error:
            # zstandard's own error class goes by its name, without importing it for every text
            if not isinstance(error, (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError)) and type(error).__name__ != "ZstdError":
                raise
            broken.append(error)
            if not some:
                yield data
            return


def windows(chunks, limit: int):
    """Texts of little more than ``limit`` characters that together hold all of ``chunks``.

    Each begins before the end of the one before it, ``OVERLAP`` characters or a quarter of ``limit``, and further at the
    beginning of the base64 run there; a run of more than half a window is continued at a whole group of 4 instead.
    """
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    parts, size = [], 0
    for chunk in chunks:
        if size >= limit:
            text = "".join(parts)
            yield text
            at = len(text) - min(OVERLAP, limit // 4)
            start = len(text[:at].rstrip(RUN))
            if start < len(text) // 2:
                start += (at - start) // 4 * 4
            parts, size = [text[start:]], len(text) - start
            del text
        parts.append(decoder.decode(chunk))
        size += len(parts[-1])
    text = "".join([*parts, decoder.decode(b"", True)])
    if text:
        yield text


def readable(text: str) -> bool:
    """Text without replaced bytes and without control characters other than white space."""
    return not re.search(r"[\x00-\x08\x0E-\x1F\x7F\udc80-\udcff]", text)


def utf8_starts(text: str) -> list[int]:
    """For each code point, and the end, the byte it begins at; a byte that isn't UTF-8 is a surrogate."""
    at, out = 0, [0]
    for c in text:
        at += 1 if c < "\x80" or "\udc80" <= c <= "\udcff" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
        out.append(at)
    return out


def replaced(text: str) -> str:
    return re.sub(r"[\udc80-\udcff]", "\ufffd", text)


def place_map(outs: list[int], ins: list[int]):
    """The place before decoding of a place after it; ``outs`` and ``ins`` have both where a literal or an escape begins."""

    def place(a: int) -> int:
        k = bisect_right(outs, a) - 1
        return ins[k] + a - outs[k]

    return place


def url_layer(text: str):
    """``text`` with all URL escapes decoded and the function that gives a character's place in it."""
    out, outs, ins, k, n = [], [0], [0], 0, 0
    for m in URL_ONE.finditer(text):
        chars = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape")
        starts = utf8_starts(chars)
        n += m.start() - k
        out += [text[k : m.start()], replaced(chars)]
        outs.extend(range(n, n + len(chars) + 1))
        ins.extend(m.start() + 3 * b for b in starts)
        n, k = n + len(chars), m.end()
    if not k:
        return None
    out.append(text[k:])
    return "".join(out), place_map(outs, ins), 0, True


def unicode_layer(text: str):
    """Likewise for Unicode and hex escapes; a pair of surrogates is one character."""
    out, outs, ins, k, n, high = [], [0], [0], 0, 0, 0
    for m in UNICODE_ONE.finditer(text):
        code = int(m[1] or m[2] or m[3], 16)
        if code > 0x10FFFF:
            continue
        if high and m.start() == k and 0xDC00 <= code <= 0xDFFF:
            out[-1], high = chr(0x10000 + ((high - 0xD800) << 10) + code - 0xDC00), 0
            k = ins[-1] = m.end()
            continue
        n += m.start() - k
        out += [text[k : m.start()], "\ufffd" if 0xD800 <= code <= 0xDFFF else chr(code)]
        outs += [n, n + 1]
        ins += [m.start(), m.end()]
        n, k, high = n + 1, m.end(), code if 0xD800 <= code <= 0xDBFF else 0
    if not k:
        return None
    out.append(text[k:])
    return "".join(out), place_map(outs, ins), 0, True


def base64_layers(token: str, limit: int):
    """The layers of a base64 token: windows of what it holds compressed, or its bytes as text."""
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[:-1] if len(body) % 4 == 1 else body
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4))
    except binascii.Error:
        return
    if codec(data):
        part, broken = -1, []
        for part, text in enumerate(windows(unpacked(data, min(limit, 1 << 20), broken), limit)):
            yield "compressed", text, None, part, True
        if part >= 0 and not broken:
            return
    text = data.decode("utf-8", "surrogateescape")
    starts = cache(lambda: utf8_starts(text))
    # a byte b lies in the characters from 4b div 3 on
    yield "base64", replaced(text), lambda a: starts()[a] * 4 // 3 if a < len(text) else len(token), 0, readable(text)


def tokens(text: str):
    """(start, end) of each base64 run, and of the runs of a single alphabet inside it."""
    for m in BASE64.finditer(text):
        found = {m.span()}
        yield m.span()
        if not m[0].rstrip("=").isalnum():
            for alphabet in ALPHABETS:
                for t in alphabet.finditer(text, *m.span()):
                    if t.span() not in found:
                        found.add(t.span())
                        yield t.span()


def layers_in(text: str, limit: int, known):
    """(start, end, kind, decoded text, place function, number of the window, whether it is readable) for each encoded region.

    For URL and Unicode escapes these are the runs, and the whole text: what is decoded may belong to what stands beside
    the run. Base64 tokens for which ``known`` is true are left out.
    """
    for kind, has, run, layer in (("url", "%" in text, URL_RUN, url_layer), ("unicode", "\\u" in text or "\\x" in text, UNICODE_RUN, unicode_layer)):
        if has:
            for m in run.finditer(text):
                if m.end() - m.start() < len(text) and (found := layer(m[0])):
                    yield m.start(), m.end(), kind, *found
            if found := layer(text):
                yield 0, len(text), kind, *found
    for start, end in tokens(text):
        if not known(start, end, text[start:end]):
            for found in base64_layers(text[start:end], limit):
                yield start, end, *found


def scan(text: str, limit: int = MAX_LAYER_BYTES):
    """Base spans, all spans, the number of decoded layers, the depth of the deepest, and the number of layers in several windows.

    Added spans have the kind of the pattern found and the place in the original text; a span that a base match of the
    same kind already covers is not added again. What base64 decodes to is scanned even if it isn't readable text, but then
    counts as a layer only if a base pattern is in it.
    """
    base = base_spans(text)
    spans, seen, n_layers, deepest, n_cut = set(base), {hash(text)}, 0, 0, 0
    taken = set()

    def of(layer: str, back):
        """The layers of ``layer``, made as they are asked for: a window is dropped before the next one is unpacked."""

        def known(start: int, end: int, token: str) -> bool:
            key = (hash(token), (start, end) if back is None else back(start, end))
            return key in taken or taken.add(key) is not None

        return layers_in(layer, limit, known)

    work = [(of(text, None), None, 0)]
    while work:
        layers, back, depth = work[-1]
        for start, end, _, inner, places, part, clear in layers:
            n_cut += part == 1
            key = hash(inner)
            where = (start, end) if back is None else back(start, end)
            # A cycle can only come back to a layer over the same region; the same text elsewhere has spans of its own.
            if (key, where) in seen or key == hash(text):
                continue
            seen.add((key, where))
            found = base_spans(inner)
            if part == 0 and (clear or found):
                n_layers, deepest = n_layers + 1, max(deepest, depth + 1)

            def outer(a: int, b: int, start=start, end=end, places=places, back=back):
                if places is None:
                    a, b = start, end
                else:
                    a, b = start + places(a), start + max(places(b), places(a) + 1)
                return (a, b) if back is None else back(a, b)

            for a, kind_found, b in found:
                x, y = outer(a, b)
                if not any(k == kind_found and s <= x and y <= e for s, k, e in spans):
                    spans.add((x, kind_found, y))
            work.append((of(inner, outer), outer, depth + 1))
            break
        else:
            work.pop()
    return base, sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]), x[2])), n_layers, deepest, n_cut


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_spans int, n_layers int, depth int, n_cut int"


def find_secrets(docs: DataFrame, limit: int = MAX_LAYER_BYTES) -> DataFrame:
    """Scan every whole text: ``SCHEMA``, one row per row of ``docs``.

    ``n_assign``, ``n_access`` and ``n_hex`` count base matches in the text itself, ``spans`` lists these and the ones
    found in decoded layers, in code points of the original text with the end exclusive. Null and empty texts have none.
    Repeated rows give equal rows, an empty table none; other columns are not read.
    """

    def run(rows: dict) -> dict:
        out: dict = {x.split()[0]: [] for x in SCHEMA.split(", ")}
        for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
            base, spans, n_layers, depth, n_cut = scan(text, limit)
            count = [sum(k == kind for _, k, _ in base) for kind in KINDS]
            row = (doc_id, *count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans), n_layers, depth, n_cut)
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        return out

    return map_slices(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")), run, SCHEMA)


def without_secrets(docs: DataFrame, limit: int = MAX_LAYER_BYTES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span, those of decoded layers included, replaced by ``mask``; all columns stay.

    ``n_chars`` follows the text where the table has it. Overlapping spans become one mask. Rows without a span, null
    texts among them, stay as they are.
    """
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(rows: dict) -> dict:
        for row in rows["row"]:
            if row["text"] is None:
                continue
            out, at = [], 0
            for start, _, end in scan(row["text"], limit)[1]:
                if end > at:
                    out += [row["text"][at:start], mask] if start >= at else []
                    at = max(at, end)
            if at:
                row["text"] = "".join(out) + row["text"][at:]
                if row.get("n_chars") is not None:
                    row["n_chars"] = len(row["text"])
        return rows

    return map_slices(plain, run, plain.schema).select("row.*")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
