"""Media columns: Aho-Corasick finds magic bytes, format validators confirm structure and length, types are corrected and media carved."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, by_bytes, text_bytes

# Magic bytes, the format they open, and their distance from its start.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", "png", 0),
    (b"GIF87a", "gif", 0),
    (b"GIF89a", "gif", 0),
    (b"\xff\xd8\xff", "jpeg", 0),
    (b"BM", "bmp", 0),
    (b"RIFF", "riff", 0),
    (b".snd", "au", 0),
    (b"fLaC", "flac", 0),
    (b"OggS", "ogg", 0),
    (b"%PDF-", "pdf", 0),
    (b"PK\x03\x04", "zip", 0),
    (b"\x1f\x8b\x08", "gzip", 0),
    (b"ftyp", "mp4", 4),
]
# Media types by format.
TYPES = {
    "png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg", "bmp": "image/bmp", "wav": "audio/wav", "webp": "image/webp", "au": "audio/basic",
    "flac": "audio/flac", "ogg": "audio/ogg", "pdf": "application/pdf", "zip": "application/zip", "gzip": "application/gzip", "mp4": "video/mp4",
}


class Marks:
    """What the validators search a blob for, found once and only when asked for, so that many magic bytes stay cheap."""

    def __init__(self, blob: bytes):
        self.blob = blob
        self._found: dict[str, list[int]] = {}

    def _places(self, name: str, pattern: bytes) -> list[int]:
        if name not in self._found:
            self._found[name] = [m.start() for m in re.finditer(pattern, self.blob, re.DOTALL)]
        return self._found[name]

    def after(self, name: str, at: int) -> int:
        """The first marker at or behind `at` that ends a JPEG scan's data; the blob's end if there is none."""
        found = self._places(name, rb"\xff[^\x00\xd0-\xd7\xff]")
        i = bisect_left(found, at)
        return found[i] if i < len(found) else len(self.blob)

    @cached_property
    def archives(self) -> dict[int, int]:
        """End by start of the zip archives: an end record's directory size and offset tell where its archive starts."""
        out: dict[int, int] = {}
        for at in self._places("zip", rb"PK\x05\x06"):
            if at + 22 <= len(self.blob):
                size, offset, note = struct.unpack_from("<IIH", self.blob, at + 12)
                start, end = at - size - offset, at + 22 + note
                if start >= 0 and end <= len(self.blob) and size and self.blob[at - size : at - size + 4] == b"PK\x01\x02":
                    out.setdefault(start, end)
        return out

    @cached_property
    def _pdf_ends(self) -> list[tuple[int, int]]:
        return [(m.end(), int(m[1])) for m in re.finditer(rb"startxref\s+(\d{1,10})\s+%%EOF", self.blob)]

    def pdf_end(self, start: int) -> int:
        """0 if there is none."""
        heads = self._places("pdf", rb"%PDF-\d")
        i = bisect_right(heads, start)
        stop, end = heads[i] if i < len(heads) else len(self.blob), 0
        for k in range(bisect_left(self._pdf_ends, (start, 0)), len(self._pdf_ends)):
            e, offset = self._pdf_ends[k]
            if e > stop:
                break
            if start + offset < e and re.compile(rb"\s*(xref|\d+\s+\d+\s+obj)").match(self.blob, start + offset):
                end = e
        return end


def _png(b: memoryview) -> tuple[str, int] | None:
    at, first = 8, True
    while at + 12 <= len(b):
        (n,), kind = struct.unpack_from(">I", b, at), bytes(b[at + 4 : at + 8])
        if at + 12 + n > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[at + 4 : at + 8 + n]) != struct.unpack_from(">I", b, at + 8 + n)[0]:
            return None
        at, first = at + 12 + n, False
        if kind == b"IEND":
            return "png", at
    return None


def _blocks(b: memoryview, at: int) -> int:
    while at < len(b) and b[at]:
        at += b[at] + 1
    return at + 1


def _gif(b: memoryview) -> tuple[str, int] | None:
    if len(b) < 13:
        return None
    at = 13 + (3 << ((b[10] & 7) + 1) if b[10] & 0x80 else 0)
    while at < len(b):
        if b[at] == 0x3B:
            return "gif", at + 1
        if b[at] == 0x21:
            at = _blocks(b, at + 2)
        elif b[at] == 0x2C and at + 10 < len(b):
            at = _blocks(b, at + 11 + (3 << ((b[at + 9] & 7) + 1) if b[at + 9] & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(b: memoryview, marks: Marks, start: int) -> tuple[str, int] | None:
    at, scans = 2, 0
    while at + 4 <= len(b) and b[at] == 0xFF:
        kind, n = b[at + 1], 0
        if kind == 0xD9:
            return ("jpeg", at + 2) if scans else None
        if kind not in (0x01, *range(0xD0, 0xD8)):
            (n,) = struct.unpack_from(">H", b, at + 2)
            if n < 2:
                return None
        at += 2 + n
        if kind == 0xDA:
            scans += 1
            at = marks.after("scan", start + at) - start
    return ("jpeg", at + 2) if scans and bytes(b[at : at + 2]) == b"\xff\xd9" else None


def _bmp(b: memoryview) -> tuple[str, int] | None:
    if len(b) < 54:
        return None
    n, zero, data, head, w, h, planes, bits = struct.unpack_from("<IIIIiiHH", b, 2)
    row = (w * bits + 31) // 32 * 4 if w > 0 else 0
    if zero or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or head < 40 or not row or data < 14 + head or n > len(b) or data + row * abs(h) > n:
        return None
    return "bmp", n


def _riff(b: memoryview) -> tuple[str, int] | None:
    if len(b) < 20:
        return None
    (n,), form = struct.unpack_from("<I", b, 4), bytes(b[8:12])
    if n + 8 > len(b) or form not in (b"WAVE", b"WEBP"):
        return None
    at, seen = 12, set()
    while at + 8 <= n + 8:
        seen.add(bytes(b[at : at + 4]))
        at += 8 + (size := struct.unpack_from("<I", b, at + 4)[0]) + size % 2
    if at != n + 8 or form == b"WAVE" and not {b"fmt ", b"data"} <= seen:
        return None
    return ("wav" if form == b"WAVE" else "webp"), n + 8


def _au(b: memoryview) -> tuple[str, int] | None:
    if len(b) < 24:
        return None
    head, n, code, rate, channels = struct.unpack_from(">IIIII", b, 4)
    return ("au", head + n) if head >= 24 and 1 <= code <= 27 and 0 < rate <= 768_000 and 1 <= channels <= 64 and head + n <= len(b) else None


@lru_cache(maxsize=2)
def _crc_table(bits: int, poly: int) -> list[int]:
    """A byte's remainders by the polynomial, highest bit first."""
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        r = byte << (bits - 8)
        for _ in range(8):
            r = (r << 1 ^ (poly if r & top else 0)) & mask
        out.append(r)
    return out


def _flac_frame(b: memoryview, at: int) -> int:
    """The samples of the frame whose header stands at `at`, 0 if none does: reserved values, coded number and checksum must
    be right."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8 or b[at + 3] & 1:
        return 0
    size, rate = b[at + 2] >> 4, b[at + 2] & 15
    if not size or rate == 15 or b[at + 3] >> 4 > 10:
        return 0
    lead = b[at + 4]
    more = 0 if lead < 0x80 else next((k for k in range(1, 7) if not lead << (k + 1) & 0x80), 0) if lead >= 0xC0 else -1
    if more < 0 or lead == 0xFF:
        return 0
    end = at + 5 + more
    own = {6: 1, 7: 2}.get(size, 0)
    stop = end + own + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if stop >= len(b) or any(b[k] & 0xC0 != 0x80 for k in range(at + 5, end)):
        return 0
    table, r = _crc_table(8, 0x07), 0
    for k in range(at, stop):
        r = table[r ^ b[k]]
    if r != b[stop]:
        return 0
    if own:
        return int.from_bytes(b[end : end + own], "big") + 1
    return 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)


def _flac(b: memoryview) -> tuple[str, int] | None:
    """Frames have no length: one ends where its checksum comes out even and a further header stands. The last one, by the
    samples that STREAMINFO counts or as no header follows, ends where the checksum does so at the blob's end, else where
    it first does (without decoding, chance ends it early once in 65,536 bytes)."""
    at, least, most, total = 4, 0, 0, 0
    while at + 4 <= len(b):
        last, n = b[at] & 0x80, int.from_bytes(b[at + 1 : at + 4], "big")
        if at == 4 and (b[at] & 0x7F or n != 34) or at + 4 + n > len(b):
            return None
        if at == 4:
            least, most, total = (int.from_bytes(b[k:e], "big") for k, e in ((12, 15), (15, 18), (21, 26)))
            total &= (1 << 36) - 1
        at += 4 + n
        if last:
            break
    else:
        return None
    table, seen, follows = _crc_table(16, 0x8005), 0, True
    while follows and (samples := _flac_frame(b, at)):
        seen += samples
        final = bool(total) and seen >= total
        r, ends, follows = 0, [], False
        for k in range(at, min(len(b), at + most) if most else len(b)):
            r = table[r >> 8 ^ b[k]] ^ (r << 8 & 0xFF00)
            if not r and k + 1 - at >= max(least, 8):
                ends.append(k + 1)
                if not final and (follows := _flac_frame(b, k + 1) > 0):
                    break
        if not ends:
            return None
        at = ends[-1] if follows or ends[-1] == len(b) else ends[0]
    return ("flac", at) if seen and seen >= total else None


def _ogg(b: memoryview) -> tuple[str, int] | None:
    """Pages up to the one that ends the last open stream."""
    at, open_ = 0, set()
    while at + 27 <= len(b) and bytes(b[at : at + 4]) == b"OggS" and b[at + 4] == 0:
        table, serial = bytes(b[at + 27 : at + 27 + b[at + 26]]), bytes(b[at + 14 : at + 18])
        flags = b[at + 5]
        if not at and not flags & 2:
            return None
        at += 27 + len(table) + sum(table)
        if at > len(b):
            return None
        open_.add(serial)
        if flags & 4:
            open_.discard(serial)
            if not open_:
                return "ogg", at
    return None


def _pdf(b: memoryview, marks: Marks, start: int) -> tuple[str, int] | None:
    """Up to the last end mark before the next header whose startxref points at a cross-reference table or stream; so a
    document that holds another one uncompressed is taken for the inner one alone."""
    if not bytes(b[5:6]).isdigit():
        return None
    return ("pdf", end - start) if (end := marks.pdf_end(start)) else None


def _zip(b: memoryview, marks: Marks, start: int) -> tuple[str, int] | None:
    return ("zip", end - start) if (end := marks.archives.get(start)) else None


def _gzip(b: memoryview) -> tuple[str, int] | None:
    d, n = zlib.decompressobj(31), 0
    try:
        while not d.eof:
            n += len(d.decompress(d.unconsumed_tail or (b if not n else b""), 1 << 20))
            if not d.unconsumed_tail and not d.eof:
                return None
    except zlib.error:
        return None
    return "gzip", len(b) - len(d.unused_data)


def _mp4(b: memoryview) -> tuple[str, int] | None:
    at, seen = 0, []
    while at + 8 <= len(b):
        (n,), kind = struct.unpack_from(">I", b, at), bytes(b[at + 4 : at + 8])
        if n == 1 and at + 16 <= len(b):
            (n,) = struct.unpack_from(">Q", b, at + 8)
            n = n if n >= 16 else 0
        elif n == 0 and at and kind == b"mdat":
            n = len(b) - at  # the last box may reach to the end
        if n < 8 or at + n > len(b) or not kind.isalnum():
            break
        seen.append(kind)
        at += n
    return ("mp4", at) if seen[:1] == [b"ftyp"] and b"moov" in seen else None


_VALIDATE = {"png": _png, "gif": _gif, "bmp": _bmp, "riff": _riff, "au": _au, "flac": _flac, "ogg": _ogg, "gzip": _gzip, "mp4": _mp4}
_SEARCHED = {"jpeg": _jpeg, "pdf": _pdf, "zip": _zip}


@lru_cache(maxsize=1)
def _automaton():
    a = ahocorasick.Automaton()
    for magic, kind, back in MAGIC:
        a.add_word(magic.decode("latin-1"), (kind, back + len(magic) - 1))
    a.make_automaton()
    return a


def carve(blob: bytes) -> list[tuple[str, int, int]]:
    """(format, offset, bytes) of the valid media in blob from left to right; media inside other media are not listed."""
    out, end, view, marks = [], 0, memoryview(blob), Marks(blob)
    for at, (kind, back) in _automaton().iter(blob.decode("latin-1")):
        start = at - back
        if start < end:
            continue
        if ok := _SEARCHED[kind](view[start:], marks, start) if kind in _SEARCHED else _VALIDATE[kind](view[start:]):
            out.append((ok[0], start, ok[1]))
            end = start + ok[1]
    return out


def sniff(df: DataFrame, blob: str, declared: str) -> DataFrame:
    """df with media_type (by content where a valid format opens the blob, else as declared), corrected, and embedded:
    the media carved from the blob as array of (type, offset, length, sha256).

    A null or empty blob has no media and keeps its declared type; a null declared type is corrected by any valid one.
    Columns of df named as an output are replaced; others pass through. Rows are judged one by one.
    """
    fields = [("media_type", pa.string()), ("corrected", pa.bool_()), ("embedded", pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())])))]
    keep = [c for c in df.columns if c.lower() not in {n for n, _ in fields}]
    schema = df.select([F.col(f"`{c}`") for c in keep])

    def run(batches):
        for batch in batches:
            kinds, changed, found = [], [], []
            for b, d in zip(batch.column("__qm_blob").to_pylist(), batch.column("__qm_declared").to_pylist()):
                got = carve(b)
                opens = TYPES[got[0][0]] if got and got[0][1] == 0 else None
                kinds.append(opens or d)
                changed.append(bool(opens) and opens != d)
                found.append([{"type": TYPES[k], "start": s, "length": n, "sha256": hashlib.sha256(b[s : s + n]).hexdigest()} for k, s, n in got])
            new = [pa.array(c, t) for c, (_, t) in zip((kinds, changed, found), fields)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + new, names=keep + [n for n, _ in fields])

    src = schema.select("*", F.coalesce(df[blob].cast("binary"), F.lit(b"")).alias("__qm_blob"), df[declared].cast("string").alias("__qm_declared"))
    return src.mapInArrow(run, appended(schema, [("media_type", "string"), ("corrected", "boolean"), ("embedded", "array<struct<type:string,start:bigint,length:bigint,sha256:string>>")]))


def store_wav(payload: bytes) -> bytes:
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(payload), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload


def store_au(payload: bytes) -> bytes:
    return struct.pack(">4sIIIII", b".snd", 24, len(payload), 2, 8000, 1) + payload


def store_bmp(payload: bytes) -> bytes:
    """Grey pixels, 64 a row (rows stored top down by a negative height)."""
    grey = b"".join(struct.pack("<BBBB", i, i, i, 0) for i in range(256))
    at = 54 + len(grey)
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", at + len(payload), 0, at, 40, 64, -(len(payload) // 64), 1, 8, 0, len(payload), 2835, 2835, 256, 0) + grey + payload


def read_back(media: bytes, kind: str) -> bytes:
    """The samples of a stored form."""
    if kind == "wav":
        at = 12
        while media[at : at + 4] != b"data":
            n = struct.unpack_from("<I", media, at + 4)[0]
            at += 8 + n + n % 2
        return media[at + 8 : at + 8 + struct.unpack_from("<I", media, at + 4)[0]]
    if kind == "au":
        head, n = struct.unpack_from(">II", media, 4)
        return media[head : head + n]
    at, w, h = struct.unpack_from("<I", media, 10)[0], *struct.unpack_from("<ii", media, 18)
    return media[at : at + w * abs(h)]


_STORES = (("wav", store_wav), ("au", store_au), ("bmp", store_bmp))

TEXT_FIELDS = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, media_type string, corrected boolean"


def text_media(docs: DataFrame) -> DataFrame:
    """Each text as 8-bit samples in a stored medium, found again by its signature within a wrapping blob, and read back.

    The payload is the text's UTF-8 bytes and bytes 0 up to a positive multiple of 64; its checksum picks the form (wav, au
    or bmp), so equal texts give equal values. The blob declares no more than octets: the sniffed type corrects it.
    Null text: empty, 64 bytes 0. Repeated rows give a row each; an empty table none; extra columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text"):
                data, off = text_bytes(part.column("text"))
                rows = []
                for d, lo, hi in zip(part.column("doc_id").to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                    text = data[lo:hi].tobytes()
                    payload = text + bytes(max(1, -(-len(text) // 64)) * 64 - len(text))
                    _, store = _STORES[zlib.crc32(payload) % len(_STORES)]
                    media = store(payload)
                    blob = b"--part\r\n\r\n" + media + b"\r\n--part--"
                    kind, at, n = carve(blob)[0]
                    form = blob[at : at + n]
                    back = read_back(form, kind)
                    seen = np.bincount(np.frombuffer(back, np.uint8), minlength=256)
                    p = seen[seen > 0] / len(back)
                    feature = f"{kind};samples={len(back)};levels={len(p)};mean={float(seen @ np.arange(256)) / len(back):.4f};entropy={abs(float(-(p * np.log2(p)).sum())):.4f}"
                    rows.append((d, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), n, hashlib.sha256(form).hexdigest(), feature, TYPES[kind], True))
                kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in TEXT_FIELDS.split(", ")])

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(run, TEXT_FIELDS)
