"""TIFF media columns: writing and reading pages of 8-bit samples, and rows per page.

The reader walks the chain of image directories in either byte order, classic or big, decodes strips and tiles
that are plain, PackBits, LZW or deflate, undoes horizontal prediction, and puts planes together. numpy and zlib do
the work per sample, Python only that per code of LZW and per run of PackBits.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", 32946: "deflate", PACKBITS: "packbits"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 13: 4, 16: 8, 17: 8, 18: 8}
READS = {1: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}


class TiffError(ValueError):
    """The bytes aren't a TIFF file, or not a page, that this reader can decode. whole: it isn't about one page."""

    whole = False


# -- PackBits

_run = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits(data: bytes, row: int) -> bytes:
    """Each row on its own, as the format wants it."""
    out = bytearray()
    for k in range(0, len(data), row):
        line, at = data[k : k + row], 0
        for m in _run.finditer(line):
            for j in range(at, m.start(), 128):
                part = line[j : min(j + 128, m.start())]
                out.append(len(part) - 1)
                out += part
            out.append(257 - (m.end() - m.start()))
            out += m.group(1)
            at = m.end()
        for j in range(at, len(line), 128):
            part = line[j : j + 128]
            out.append(len(part) - 1)
            out += part
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, k, n = [], 0, len(data)
    have = 0
    while k < n and have < size:
        c = data[k]
        if c < 128:
            out.append(data[k + 1 : k + 2 + c])
            have += c + 1
            k += c + 2
        elif c > 128:
            out.append(data[k + 1 : k + 2] * (257 - c))
            have += 257 - c
            k += 2
        else:
            k += 1
    return b"".join(out)[:size]


# -- LZW: codes of 9 to 12 bits, highest bit first, widened one code early


def lzw(data: bytes) -> bytes:
    bits, filled, out = 0, 0, bytearray()
    table: dict[tuple[int, int], int] = {}
    width, free, prefix = 9, 258, -1

    def flush() -> None:
        nonlocal bits, filled
        whole = filled // 8
        if whole:
            filled -= whole * 8
            out.extend((bits >> filled).to_bytes(whole, "big"))
            bits &= (1 << filled) - 1

    bits, filled = 256, 9
    for c in data:
        if prefix < 0:
            prefix = c
            continue
        code = table.get((prefix, c))
        if code is not None:
            prefix = code
            continue
        bits = bits << width | prefix
        filled += width
        table[prefix, c] = free
        free += 1
        if free == (1 << width):  # one early: the decoder is one entry behind
            if width == 12:
                bits = bits << 12 | 256
                filled += 12
                table.clear()
                width, free = 9, 258
            else:
                width += 1
        elif free == 4094 and width == 12:
            bits = bits << 12 | 256
            filled += 12
            table.clear()
            width, free = 9, 258
        prefix = c
        if filled > 512:
            flush()
    if prefix >= 0:
        bits = bits << width | prefix
        filled += width
        free += 1
        if free == (1 << width) and width < 12:
            width += 1
    bits = bits << width | 257
    filled += width
    pad = -filled % 8
    bits <<= pad
    filled += pad
    flush()
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    start = [bytes([k]) for k in range(256)] + [b"", b""]
    words, width, out, have = list(start), 9, [], 0
    last = b""
    at, total = 0, len(data) * 8
    window, first = 0, 0  # bits of data from byte `first`
    while have < size:
        if at + width > total:
            break
        need = (at + width + 7) // 8
        if need > first:
            start_byte = at // 8
            first = min(len(data), start_byte + 64)
            window = int.from_bytes(data[start_byte:first], "big")
        code = window >> (first * 8 - at - width) & ((1 << width) - 1)
        at += width
        if code == 256:
            words, width, last = list(start), 9, b""
            continue
        if code == 257:
            break
        if not last:
            if code > 255:
                raise TiffError("LZW data start with a code that has no meaning yet")
            word = words[code]
        else:
            if code < len(words):
                word = words[code]
            elif code == len(words):
                word = last + last[:1]
            else:
                raise TiffError("an LZW code is out of range")
            if len(words) < 4096:
                words.append(last + word[:1])
                if len(words) == (1 << width) - 1 and width < 12:
                    width += 1
        out.append(word)
        have += len(word)
        last = word
    return b"".join(out)[:size]


# -- writing


def _packed(block: np.ndarray, compression: int, predictor: int, level: int) -> bytes:
    if predictor == 2:
        moved = block.copy()
        moved[:, 1:] -= block[:, :-1]
        block = moved
    data = np.ascontiguousarray(block).tobytes()
    if compression == DEFLATE:
        return zlib.compress(data, level)
    if compression == LZW:
        return lzw(data)
    if compression == PACKBITS:
        return packbits(data, block.shape[1] * block.shape[2])
    return data


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, rows: int = 128, order: str = "<", level: int = 6, big: bool = False) -> bytes:
    """A TIFF file, classic or big, of pages, each an array (height, width) or (height, width, samples) of uint8."""
    head = struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)
    out = bytearray((b"II" if order == "<" else b"MM") + head)
    word, room, link = ("Q", 8, 8) if big else ("I", 4, 4)
    for page in pages:
        a = page[:, :, None] if page.ndim == 2 else page
        h, w, s = a.shape
        blocks = []
        if tile:
            for y in range(0, h, tile):
                for x in range(0, w, tile):
                    full = np.zeros((tile, tile, s), np.uint8)
                    part = a[y : y + tile, x : x + tile]
                    full[: part.shape[0], : part.shape[1]] = part
                    blocks.append(_packed(full, compression, predictor, level))
        else:
            blocks = [_packed(a[y : y + rows], compression, predictor, level) for y in range(0, h, rows)]
        offsets = []
        for b in blocks:
            out += b"\0" * (len(out) % 2)
            offsets.append(len(out))
            out += b
        entries = {256: (4, [w]), 257: (4, [h]), 258: (3, [8] * s), 259: (3, [compression]), 262: (3, [2 if s == 3 else 1]), 277: (3, [s]), 284: (3, [1]), 317: (3, [predictor])}
        sizes = [len(b) for b in blocks]
        entries |= {322: (4, [tile]), 323: (4, [tile]), 324: (4, offsets), 325: (4, sizes)} if tile else {273: (4, offsets), 278: (4, [rows]), 279: (4, sizes)}
        packed = {}
        for tag, (kind, values) in sorted(entries.items()):
            raw = struct.pack(order + READS[kind] * len(values), *values)
            if len(raw) > room:
                out += b"\0" * (len(out) % 2)
                packed[tag] = struct.pack(order + "HH" + 2 * word, tag, kind, len(values), len(out))
                out += raw
            else:
                packed[tag] = struct.pack(order + "HH" + word, tag, kind, len(values)) + raw.ljust(room, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + word, out, link, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(packed)) + b"".join(packed.values())
        link = len(out)
        out += bytes(room)
    return bytes(out)


# -- reading


def _directories(data: bytes):
    """The tags of each image directory in the chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8:
        raise TiffError("no byte order mark")
    (magic,) = struct.unpack_from(order + "H", data, 2)
    if magic not in (42, 43):
        raise TiffError("not a TIFF file")
    big = magic == 43
    (at,) = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)
    seen = set()
    while at:
        if at in seen:
            raise TiffError("the chain of directories is a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + ("Q" if big else "H"), data, at)
        at += 8 if big else 2
        tags = {}
        for _ in range(n):
            tag, kind = struct.unpack_from(order + "HH", data, at)
            (count,) = struct.unpack_from(order + ("Q" if big else "I"), data, at + 4)
            value, room = at + (12 if big else 8), 8 if big else 4
            if kind in READS:
                if SIZES[kind] * count > len(data):
                    raise TiffError("a tag has more values than the file has bytes")
                if SIZES[kind] * count > room:
                    (value,) = struct.unpack_from(order + ("Q" if big else "I"), data, value)
                tags[tag] = struct.unpack_from(order + READS[kind] * count, data, value)
            at += 20 if big else 12
        yield order, tags
        (at,) = struct.unpack_from(order + ("Q" if big else "I"), data, at)


def _block(data: bytes, size: int, compression: int) -> bytes:
    if compression in (DEFLATE, 32946):
        return zlib.decompressobj().decompress(data, size)
    if compression == LZW:
        return unlzw(data, size)
    if compression == PACKBITS:
        return unpackbits(data, size)
    if compression == NONE:
        return data[:size]
    raise TiffError(f"compression {compression} isn't supported")


def _page(data: bytes, order: str, tags: dict) -> dict:
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    w, h, s = one(256), one(257), one(277, 1)
    bits, compression, predictor, planar = one(258, 1), one(259, 1), one(317, 1), one(284, 1)
    if not w or not h or w < 0 or h < 0 or s < 1 or bits not in (8, 16) or predictor not in (1, 2) or len(set(tags.get(258, (8,)))) > 1:
        raise TiffError("only whole pages of equal 8- or 16-bit samples are supported")
    kind = np.dtype("u1" if bits == 8 else order + "u2")
    tiled = 322 in tags
    bw, bh = (one(322), one(323)) if tiled else (w, min(one(278, h), h))
    if bw < 1 or bh < 1:
        raise TiffError("strips or tiles have no size")
    if max(w, bw) * max(h, bh) * s * kind.itemsize > MOST_SWELLING * len(data):
        raise TiffError("a page is larger than what its file can hold")
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down = -(-w // bw), -(-h // bh)
    planes, deep = (s, 1) if planar == 2 else (1, s)
    if min(len(offsets), len(sizes)) < across * down * planes or min(*offsets, *sizes) < 0:
        raise TiffError("strips or tiles are missing")
    out = np.zeros((h, w, s), kind.newbyteorder("=") if bits == 16 else kind)
    k = 0
    for p in range(planes):
        for y in range(0, down * bh, bh):
            for x in range(0, across * bw, bw):
                tall = bh if tiled else min(bh, h - y)
                raw = _block(data[offsets[k] : offsets[k] + sizes[k]], tall * bw * deep * kind.itemsize, compression)
                if len(raw) < tall * bw * deep * kind.itemsize:
                    raise TiffError("a strip or tile is too short")
                block = np.frombuffer(raw, kind).reshape(tall, bw, deep)
                if predictor == 2:
                    block = np.cumsum(block.astype(out.dtype), axis=1, dtype=out.dtype)
                part = block[: h - y, : w - x]
                out[y : y + part.shape[0], x : x + part.shape[1], p : p + deep] = part
                k += 1
    return {"width": w, "height": h, "samples": s, "bits": bits, "compression": NAMES.get(compression, "?"), "predictor": predictor, "layout": "tiles" if tiled else "strips", "pixels": out}


#: No codec makes so many bytes of one.
MOST_SWELLING = 4096


def each_page(data: bytes):
    """A page, or the TiffError that keeps it from being read, for each directory; after a broken directory, which
    hides those behind it, one more error."""
    found = _directories(data)
    while True:
        try:
            order, tags = next(found)
        except StopIteration:
            return
        except (TiffError, struct.error) as e:
            broken = e if isinstance(e, TiffError) else TiffError(f"broken directory: {e}")
            broken.whole = True
            yield broken
            return
        try:
            yield _page(data, order, tags)
        except TiffError as e:
            yield e
        except (zlib.error, KeyError, IndexError, ValueError, OverflowError, MemoryError) as e:
            yield TiffError(f"broken page: {type(e).__name__} {e}")


def read_tiff(data: bytes) -> list[dict]:
    """The pages of a file in the order of its directories; pixels are arrays (height, width, samples). Raises
    TiffError if any can't be read; each_page gives the others."""
    pages = list(each_page(data))
    for p in pages:
        if isinstance(p, TiffError):
            raise p
    return pages


PAGE = "array<struct<page int, error string, width int, height int, samples int, bits int, compression string, predictor int, layout string, pixels binary>>"


def tiff_pages(df: DataFrame, content: str = "content") -> DataFrame:
    """One row per page of the TIFF file in each row: page (from 0), width, height, samples, bits, compression,
    predictor, layout, pixels (rows of samples, native byte order) and error.

    A page that can't be read has its number and an error, and nulls besides; the others of its file are read. Null
    content, an empty file, one without pages and the rest of a file behind a broken directory give one row whose page
    is null and whose error says why; rows are never dropped, repeated ones give their pages each. Other columns pass through; those named as the
    new ones are replaced.
    """

    def run(col: pa.Array) -> pa.Array:
        rows = []
        for x in col:
            data = x.as_py()
            pages = []
            for k, p in enumerate(() if data is None else each_page(data)):
                if not isinstance(p, TiffError):
                    pages.append(p | {"page": k, "pixels": p["pixels"].tobytes()})
                else:
                    pages.append({"page": None if p.whole else k, "error": str(p)})
            rows.append(pages or [{"error": "null" if data is None else "no page"}])
        fields = [("page", pa.int32()), ("error", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.string()), ("predictor", pa.int32()), ("layout", pa.string()), ("pixels", pa.binary())]
        return pa.array(rows, pa.list_(pa.struct(fields)))

    at, names = "__lode_tiff", ["page", "width", "height", "samples", "bits", "compression", "predictor", "layout", "pixels", "error"]
    kept = [c for c in df.columns if c not in names]
    rows = df.withColumn(at, F.arrow_udf(run, PAGE)(F.col(content))).select(*kept, F.explode(at).alias(at))
    return rows.select(*kept, *(F.col(f"{at}.{n}").alias(n) for n in names))


# -- texts as media

WIDTH = 64
#: Rows of samples in a page; longer payloads have several pages.
PAGE_ROWS = 16_384
#: How a payload is stored follows from its own hash, so that equal texts are stored alike: each codec as often as the
#: others, in strips and tiles, with and without prediction, in either byte order, classic and big.
FORMS = [
    {"compression": compression, "tile": 64 * (k % 2), "predictor": 1 + k // 2 % 2, "order": "<>"[(k + j) % 2], "big": k == 3}
    for j, compression in enumerate((NONE, PACKBITS, LZW, DEFLATE))
    for k in range(4)
]


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\0" * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def store(payload: bytes) -> bytes:
    """Bytes, a positive multiple of 64, as a TIFF file of pages 64 samples wide."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    form = FORMS[zlib.crc32(payload) & 15]
    return write_tiff([a[k : k + PAGE_ROWS] for k in range(0, len(a), PAGE_ROWS)], **form)


def digest(text: str | None) -> tuple:
    payload = payload_of(text)
    media = store(payload)
    pages = read_tiff(media)
    back = b"".join(p["pixels"].tobytes() for p in pages)
    counts = np.bincount(np.frombuffer(back, np.uint8), minlength=256)
    share = counts[counts > 0] / len(back)
    mean = float((counts * np.arange(256)).sum() / len(back))
    feature = f"{pages[0]['compression']}/{pages[0]['layout']}/p{pages[0]['predictor']} pages={len(pages)} mean={mean:.3f} entropy={-(share * np.log2(share)).sum():.4f} levels={len(share)}"
    return (len((text or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(df: DataFrame, text: str = "text") -> DataFrame:
    """Stores each whole text as a TIFF file, reads it back, and adds digests and features of what was read.

    Null and empty texts are 64 bytes 0. Equal texts give equal values. Every row is kept; columns named as the new
    ones are replaced, others pass through; an empty table gives an empty table.
    """

    def run(col: pa.Array) -> pa.Array:
        cols = list(zip(*(digest(x.as_py()) for x in col))) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in DIGEST.split(", ")])

    from .common import modest_batches

    modest_batches(df)
    at = "__lode_media"
    made = df.withColumn(at, F.arrow_udf(run, DIGEST)(F.col(text).cast("string")))
    return made.withColumns({n: F.col(at)[n] for n in (x.split()[0] for x in DIGEST.split(", "))}).drop(at)


def op3(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return media_digest(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
