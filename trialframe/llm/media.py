"""Media columns by signature sniffing.

An Aho-Corasick automaton finds every magic byte string in one pass; a validator per
format then walks the structure from there and says how long the object is.  What a
validator confirms at offset 0 corrects the declared type, what it confirms elsewhere
is carved out as embedded media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_of

#: Fixed values of the public formats: magic bytes, type, offset of the magic from the object's start.
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", "image/png", 0),
    (b"GIF87a", "image/gif", 0),
    (b"GIF89a", "image/gif", 0),
    (b"\xff\xd8\xff", "image/jpeg", 0),
    (b"BM", "image/bmp", 0),
    (b"RIFF", "riff", 0),
    (b"fLaC", "audio/flac", 0),
    (b"OggS", "audio/ogg", 0),
    (b"%PDF-", "application/pdf", 0),
    (b"PK\x03\x04", "application/zip", 0),
    (b"\x1f\x8b\x08", "application/gzip", 0),
    (b"ftyp", "video/mp4", 4),
]
SCHEMA = "detected string, corrected boolean, n_bytes long, carved array<struct<kind:string,start:long,end:long,data_start:long,data_end:long>>"
CARVED = ["kind", "start", "end", "data_start", "data_end"]


class Finder:
    """Forward searches in one content; what is asked in ascending order costs one pass in all."""

    def __init__(self, content: bytes) -> None:
        self.content = content
        self.known: dict[bytes, tuple[int, int]] = {}
        self.boxes: dict[int, tuple] = {}
        self.members: dict[int, int | None] = {}

    def __call__(self, what: bytes, at: int) -> int:
        start, found = self.known.get(what, (len(self.content) + 1, -1))
        if not (start <= at and (found < 0 or at <= found)):
            found = self.content.find(what, at)
            self.known[what] = (at, found)
        return found


def _crc_table(poly: int, bits: int) -> list[int]:
    """The table of a checksum that takes the highest bit first."""
    out = []
    for k in range(256):
        c = k << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ (poly if c >> (bits - 1) & 1 else 0)) & (1 << bits) - 1
        out.append(c)
    return out


#: Fixed values of the public formats: polynomials of Ogg pages, FLAC frame headers and FLAC frames.
_OGG_CRC, _FLAC_CRC8, _FLAC_CRC16 = _crc_table(0x04C11DB7, 32), _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _png(b: bytes, at: int, find: Finder):
    p = at + 8
    if b[p + 4 : p + 8] != b"IHDR":
        return None
    while p + 12 <= len(b):
        n = int.from_bytes(b[p : p + 4], "big")
        if p + 12 + n > len(b) or zlib.crc32(b[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return None
        if b[p + 4 : p + 8] == b"IEND":
            return "image/png", p + 12, at + 8, p
        p += 12 + n
    return None


def _gif(b: bytes, at: int, find: Finder):
    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    if at + 13 > len(b):
        return None
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    start = p
    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return "image/gif", p + 1, start, p
        if kind == 0x21:
            p = blocks(p + 2)
        elif kind == 0x2C and p + 10 <= len(b):
            p = blocks(p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int, find: Finder):
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        p += 2 + int.from_bytes(b[p + 2 : p + 4], "big")
        if kind == 0xDA:
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b):
                if b[p + 1] == 0xD9:
                    return "image/jpeg", p + 2, at + 2, p
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
            else:
                return None
    return None


def _bmp(b: bytes, at: int, find: Finder):
    if at + 30 > len(b):
        return None
    size, reserved, offset, header = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    if reserved or header not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or not 14 + header <= offset <= size or at + size > len(b):
        return None
    return "image/bmp", at + size, at + offset, at + size


def _riff(b: bytes, at: int, find: Finder):
    if at + 12 > len(b):
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    end, p, data, fmt = at + 8 + size, at + 12, None, False
    if form not in (b"WAVE", b"WEBP", b"AVI ") or end > len(b):
        return None
    while p + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, p)
        if p + 8 + n > end:
            return None
        fmt |= kind == b"fmt " and n >= 16
        if kind in (b"data", b"VP8 ", b"VP8L", b"movi"):
            data = (p + 8, p + 8 + n)
        p += 8 + n + (n & 1)
    if data is None or form == b"WAVE" and not fmt:
        return None
    return {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}[form], end, *data


def _flac_frame(b: bytes, p: int) -> tuple[int, int] | None:
    """(samples, end of the header) of the frame header at ``p``, its checksum confirmed."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8:
        return None
    size, rate, q = b[p + 2] >> 4, b[p + 2] & 15, p + 4
    lead = b[q]
    q += 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()  # a number in the style of UTF-8
    more = {6: 1, 7: 2}.get(size, 0)
    samples = 192 if size == 1 else 576 << (size - 2) if 2 <= size <= 5 else 256 << (size - 8) if size >= 8 else int.from_bytes(b[q : q + more], "big") + 1 if more else 0
    q += more + (1 if rate == 12 else 2 if rate in (13, 14) else 0)
    if q >= len(b) or not samples or rate == 15:
        return None
    crc = 0
    for x in b[p:q]:
        crc = _FLAC_CRC8[crc ^ x]
    return (samples, q + 1) if crc == b[q] else None


def _flac(b: bytes, at: int, find: Finder):
    """Metadata blocks, then frames; a frame ends where its checksum holds and the next one starts or all samples are there."""
    p, first, total = at + 4, True, 0
    while True:
        if p + 4 > len(b):
            return None
        kind, n = b[p] & 0x7F, int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (kind, n) != (0, 34) or p + 4 + n > len(b):
            return None
        if first:
            total = int.from_bytes(b[p + 17 : p + 22], "big") & (1 << 36) - 1
        first, last, p = False, b[p] & 0x80, p + 4 + n
        if last:
            break
    start, done, end = p, 0, None
    while (head := _flac_frame(b, p)) and not (total and done >= total):
        crc, q, ends = 0, p, None
        while q < len(b):
            crc = (crc << 8 & 0xFFFF) ^ _FLAC_CRC16[crc >> 8 ^ b[q]]
            q += 1
            if not crc and q >= head[1] + 2 and (total and done + head[0] >= total or q == len(b) or _flac_frame(b, q)):
                ends = q
                break
        if ends is None:
            break
        done, p, end = done + head[0], ends, ends
    if end is None or total and done < total:
        return None
    return "audio/flac", end, start, end


def _ogg(b: bytes, at: int, find: Finder):
    """Pages from the one that begins a stream up to the one that ends it, each one's checksum confirmed; the data start after the first page's segment table."""
    p = at
    if not b[at + 5 : at + 6] or not b[at + 5] & 2:
        return None
    while b[p : p + 5] == b"OggS\0" and p + 27 <= len(b):
        n = b[p + 26]
        end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if end > len(b):
            return None
        crc = 0
        for x in b[p : p + 22] + bytes(4) + b[p + 26 : end]:
            crc = (crc << 8 & 0xFFFFFFFF) ^ _OGG_CRC[crc >> 24 ^ x]
        if crc != int.from_bytes(b[p + 22 : p + 26], "little"):
            return None
        if b[p + 5] & 4:
            return "audio/ogg", end, at + 27 + b[at + 26], end
        p = end
    return None


def _pdf(b: bytes, at: int, find: Finder):
    end, table = find(b"%%EOF", at), find(b"startxref", at)
    if not b[at + 5 : at + 6].isdigit() or end < 0 or not 0 <= table < end:
        return None
    return "application/pdf", end + 5, at + 8, end


def _zip(b: bytes, at: int, find: Finder):
    p = find(b"PK\x05\x06", at)
    if p < 0 or p + 22 > len(b):
        return None
    size, offset, comment = struct.unpack_from("<IIH", b, p + 12)
    if at + offset + size != p or b[at + offset : at + offset + 4] not in (b"PK\x01\x02", b"PK\x05\x06") or p + 22 + comment > len(b):
        return None
    return "application/zip", p + 22 + comment, at, at + offset


def _inflated(b: bytes, p: int) -> int | None:
    """The end of a gzip member whose compressed data begin at ``p``, if checksum and length agree; read in pieces, so that a bomb costs no memory."""
    inflate, crc, size, piece = zlib.decompressobj(-15), 0, 0, 1 << 10
    try:
        while not inflate.eof and p < len(b):
            data = b[p : p + piece]
            p += len(data)
            piece = min(2 * piece, 1 << 16)
            while data and not inflate.eof:
                out = inflate.decompress(data, 1 << 20)
                crc, size, data = zlib.crc32(out, crc), size + len(out), inflate.unconsumed_tail
    except zlib.error:
        return None
    end = p - len(inflate.unused_data)
    if not inflate.eof or b[end : end + 8] != struct.pack("<II", crc, size & 0xFFFFFFFF):
        return None
    return end + 8


def _gzip(b: bytes, at: int, find: Finder):
    p = at + 10
    if p > len(b) or (flags := b[at + 3]) & 0xE0:
        return None
    if flags & 4:
        p += 2 + int.from_bytes(b[p : p + 2], "little")
    for bit in (8, 16):  # a name and a comment, each up to a zero byte
        if flags & bit:
            if (p := find(b"\0", p) + 1) == 0:
                return None
    p += flags & 2
    if p not in find.members:
        find.members[p] = _inflated(b, p)
    end = find.members[p]
    return end and ("application/gzip", end, at + 10, end - 8)


def _boxes(b: bytes, at: int, seen: dict[int, tuple]) -> tuple:
    """Where the chain of boxes from ``at`` ends, and the extent of its last ``mdat``; every place is walked once for all chains."""
    path, p = [], at
    while p not in seen:
        n, kind = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        if p + 8 > len(b) or n < 8 or p + n > len(b) or not kind.isalnum():
            seen[p] = p, None
        else:
            path.append((p, n, kind))
            p += n
    end, data = seen[p]
    for q, n, kind in reversed(path):
        data = (q + 8, q + n) if data is None and kind == b"mdat" else data
        seen[q] = end, data
    return seen[at]


def _mp4(b: bytes, at: int, find: Finder):
    end, data = _boxes(b, at, find.boxes)
    if b[at + 4 : at + 8] != b"ftyp" or end == at or data is None:
        return None
    return "video/mp4", end, *data


_VALIDATE = {"image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "riff": _riff, "audio/flac": _flac, "audio/ogg": _ogg, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "video/mp4": _mp4}


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(SIGNATURES):
        found.add_word(magic.decode("latin-1"), (k, len(magic)))
    found.make_automaton()
    return found


def carve(content: bytes) -> list[tuple]:
    """All confirmed objects as (kind, start, end, data_start, data_end), by start.

    Each magic is tried once; an object inside another one is listed too, after it.
    """
    found, find = [], Finder(content)
    for last, (k, n) in _automaton().iter(content.decode("latin-1")):
        _, kind, offset = SIGNATURES[k]
        at = last - n + 1 - offset
        if at >= 0 and (hit := _VALIDATE[kind](content, at, find)):
            found.append((hit[0], at, *hit[1:]))
    return sorted(found, key=lambda x: (x[1], -x[2], x[0]))


def sniff_bytes(content: bytes | None, declared: str | None) -> tuple:
    """(detected, corrected, n_bytes, carved): the type by structure, else the declared one for what no validator knows."""
    content = bytes(content or b"")
    carved = carve(content)
    own = next((x[0] for x in carved if x[1] == 0), None)
    return own or declared, own is not None and own != declared, len(content), carved


def sniff(df: DataFrame, content: str = "content", declared: str = "declared", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ``keep``, then detected, corrected, n_bytes and the carved objects (start, end, extent of the data).

    A null or empty content has no objects and keeps its declared type.  Search and validation are
    linear in a content of any length; rows are independent, so nothing is shuffled, and repeated rows and null
    ids are rows like others.  An empty table gives none.  ``keep`` must not name a column that is
    added (ValueError); other columns are not looked at, whatever their names.
    """
    clear_of(keep, "detected", "corrected", "n_bytes", "carved")

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = [sniff_bytes(c, None if pd.isna(d) else d) for c, d in zip(b[content], b[declared], strict=True)]
            out = pd.DataFrame(rows, columns=["detected", "corrected", "n_bytes", "carved"])
            out["carved"] = [[dict(zip(CARVED, x, strict=True)) for x in r] for r in out["carved"]]
            yield pd.concat([b[list(keep)].reset_index(drop=True), out], axis=1)

    kept = df.select(*keep, content, declared)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema), SCHEMA])
    return kept.mapInPandas(batches, schema)


def stored_as_wav(payload: bytes) -> bytes:
    """A mono 8-bit PCM file whose samples are the payload's bytes."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", n) + payload


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as 8-bit samples, sniffs the stored bytes and reads the payload back from where the sniffer found it.

    The text's UTF-8 bytes are followed by zeros up to a positive multiple of 64.  The column is
    declared ``application/octet-stream``; only the sniffer knows that it is audio and where its
    samples lie.  A null text is an empty one, null ids are kept, repeated rows give repeated rows, texts of any
    length are stored whole.  An empty table gives none; other columns are not looked at, whatever their names.
    """
    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for key, text in zip(b["k"], b["t"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                media = stored_as_wav(raw + bytes(-len(raw) % 64 or (0 if raw else 64)))
                kind, _, size, carved = sniff_bytes(media, "application/octet-stream")
                own = next(x for x in carved if x[1] == 0)
                payload = media[own[3] : own[4]]
                inner = "|".join(f"{x[0]}@{x[1]}+{x[2] - x[1]}" for x in carved if x[1])
                rows.append((key, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), size, hashlib.sha256(media).hexdigest(), f"{kind};data={own[3]}+{own[4] - own[3]};embedded={inner}", len(carved) - 1))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_embedded"]).astype({"doc_id": "Int64"})

    kept = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    return kept.mapInPandas(batches, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_embedded long")
