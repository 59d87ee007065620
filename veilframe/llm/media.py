"""Media columns: signature sniffing by Aho-Corasick, with validators that confirm structure and lengths.

One pass of an automaton over a value finds the magic bytes of all known formats. Each format's validator then walks the
structure from there and says where the medium ends, or that it is none. What starts at the first byte and reaches the
last gives the value's type, which corrects the declared one; what lies within is carved out. Texts can be stored
losslessly as media: UTF-8 bytes as the 8-bit samples of a mono WAV file.

Definitions. A null value has no type and nothing within; an unknown one has type "" and keeps its declared type. Media
within a medium that was carved out are not carved again. Rows are independent, repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import own_columns

UNIT, RATE = 192, 8000

# Magic bytes at the beginning of each format.
MAGIC = (
    (b"RIFF", "wav"), (b"\x89PNG\r\n\x1a\n", "png"), (b"GIF87a", "gif"), (b"GIF89a", "gif"), (b"\xff\xd8\xff", "jpeg"), (b"BM", "bmp"),
    (b"PK\x03\x04", "zip"), (b"%PDF-", "pdf"), (b"OggS\x00", "ogg"), (b"fLaC", "flac"), (b"\x1f\x8b\x08", "gzip"),
)


@functools.cache
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind in MAGIC:
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def wav_end(b: bytes, at: int) -> int | None:
    """RIFF chunks up to the declared size, with a format chunk before the data."""
    if b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 12:
        return None
    end, k, seen = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, []
    if end > len(b):
        return None
    while k + 8 <= end:
        seen.append(b[k : k + 4])
        size = struct.unpack_from("<I", b, k + 4)[0]
        k += 8 + size + size % 2
    return end if k == end and b"fmt " in seen and b"data" in seen[seen.index(b"fmt ") :] else None


def png_end(b: bytes, at: int) -> int | None:
    """Chunks with right checksums, from IHDR to IEND."""
    k, first = at + 8, True
    while k + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, k)
        if first != (kind == b"IHDR") or k + 12 + size > len(b) or zlib.crc32(b[k + 4 : k + 8 + size]) != struct.unpack_from(">I", b, k + 8 + size)[0]:
            return None
        k, first = k + 12 + size, False
        if kind == b"IEND":
            return k
    return None


def _sub_blocks(b: bytes, k: int) -> int | None:
    while k < len(b):
        if not b[k]:
            return k + 1
        k += 1 + b[k]
    return None


def gif_end(b: bytes, at: int) -> int | None:
    """Colour table, extensions and images up to the trailer."""
    if len(b) < at + 13:
        return None
    k: int | None = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while k is not None and k < len(b):
        if b[k] == 0x3B:
            return k + 1
        if b[k] == 0x21:
            k = _sub_blocks(b, k + 2)
        elif b[k] == 0x2C and k + 10 < len(b):
            k = _sub_blocks(b, k + 11 + (3 << (b[k + 9] & 7) + 1 if b[k + 9] & 0x80 else 0))
        else:
            return None
    return None


def jpeg_end(b: bytes, at: int) -> int | None:
    """Segments up to the end marker; within a scan, markers are told from data by the byte after 0xFF."""
    k, frame = at + 2, False
    while k + 4 <= len(b) and b[k] == 0xFF:
        kind = b[k + 1]
        size = struct.unpack_from(">H", b, k + 2)[0]
        if kind < 0xC0 or size < 2:
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        k += 2 + size
        if kind == 0xDA:
            while (k := b.find(b"\xff", k)) >= 0 and k + 1 < len(b) and (b[k + 1] == 0 or 0xD0 <= b[k + 1] <= 0xD7):
                k += 2
            if k < 0 or k + 1 >= len(b):
                return None
        if b[k : k + 2] == b"\xff\xd9":
            return k + 2 if frame else None
    return None


def bmp_end(b: bytes, at: int) -> int | None:
    """A file header whose sizes fit the image header's."""
    if len(b) < at + 30:
        return None
    size, _, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    good = planes == 1 and bits in (1, 4, 8, 16, 24, 32) and header in (40, 108, 124) and 14 + header <= offset <= size <= len(b) - at and width > 0
    return at + size if good and size >= offset + (width * bits + 31) // 32 * 4 * abs(height) else None


@functools.lru_cache(1)
def zip_ends(b: bytes) -> dict[int, int]:
    """From where an archive begins to where it ends: what each end record that a directory stands before says of itself.

    Records are looked at once for a value, however many entries it has; of those of one beginning the first counts.
    """
    out: dict[int, int] = {}
    k = -1
    while (k := b.find(b"PK\x05\x06", k + 1)) >= 0 and k + 22 <= len(b):
        size, offset, note = struct.unpack_from("<IIH", b, k + 12)
        at = k - size - offset
        if at >= 0 and k + 22 + note <= len(b) and (size == 0 or b[k - size : k - size + 4] == b"PK\x01\x02"):
            out.setdefault(at, k + 22 + note)
    return out


def zip_end(b: bytes, at: int) -> int | None:
    """The end record that points back to a directory which begins after this first entry."""
    return zip_ends(b).get(at)


def pdf_end(b: bytes, at: int) -> int | None:
    """The last end mark before the next file, with a cross-reference before it."""
    stop = b.find(b"%PDF-", at + 5)
    k = b.rfind(b"%%EOF", at, stop if stop >= 0 else len(b))
    return None if k < 0 or b.find(b"startxref", at, k) < 0 else k + 5 + len(b[k + 5 : k + 7]) - len(b[k + 5 : k + 7].lstrip(b"\r\n"))


def ogg_end(b: bytes, at: int) -> int | None:
    """Pages of one stream up to its last."""
    k = at
    while b[k : k + 5] == b"OggS\x00" and k + 27 <= len(b):
        table = b[k + 27 : k + 27 + b[k + 26]]
        flags, k = b[k + 5], k + 27 + b[k + 26] + sum(table)
        if k > len(b):
            return None
        if flags & 4:
            return k
    return None


def flac_end(b: bytes, at: int) -> int | None:
    """Metadata blocks, the stream's facts first; frames carry no length, so it reaches the value's end."""
    k, kind = at + 4, 0
    while k + 4 <= len(b):
        size = int.from_bytes(b[k + 1 : k + 4])
        kind = b[k] & 0x7F
        if k == at + 4 and (kind != 0 or size != 34) or k + 4 + size > len(b):
            return None
        last, k = b[k] & 0x80, k + 4 + size
        if last:
            return len(b) if b[k : k + 1] in (b"", b"\xff") else None
    return None


def gzip_end(b: bytes, at: int) -> int | None:
    """A whole stream; what it unpacks to is thrown away piece by piece."""
    d, k = zlib.decompressobj(31), at
    try:
        while not d.eof:
            if k >= len(b):
                return None
            d.decompress(b[k : k + 4096], 1 << 20)
            k += 4096
            while d.unconsumed_tail and not d.eof:
                d.decompress(d.unconsumed_tail, 1 << 20)
    except zlib.error:
        return None
    return min(k, len(b)) - len(d.unused_data)


VALIDATORS = {"wav": wav_end, "png": png_end, "gif": gif_end, "jpeg": jpeg_end, "bmp": bmp_end, "zip": zip_end, "pdf": pdf_end, "ogg": ogg_end, "flac": flac_end, "gzip": gzip_end}


def media_in(b: bytes) -> list[tuple[str, int, int]]:
    """(type, start, end) of the media in b that are not within another one, by start."""
    out: list[tuple[str, int, int]] = []
    for last, (size, kind) in automaton().iter(b.decode("latin-1")):
        at = last - size + 1
        if (not out or at >= out[-1][2]) and (end := VALIDATORS[kind](b, at)) is not None:
            out.append((kind, at, end))
    return out


def sniffed(b: bytes | None, declared: str | None) -> tuple[str | None, str | None, list[tuple[str, int, int]]]:
    """(type, corrected declaration, media within)."""
    if b is None:
        return None, declared, []
    found = media_in(b)
    if found and found[0][1:] == (0, len(b)):
        kind = found[0][0]
        inner = [(k, s + 1, e + 1) for k, s, e in media_in(b[1:])]
        return kind, kind, inner
    return "", declared, found


def sniff(df: DataFrame, value: str = "content", declared: str = "declared", key: str = "id") -> DataFrame:
    """(key, type, corrected, carved array<struct<type, start, end>>), a row for each row of df."""
    rows = own_columns(df, key, value, declared)
    kinds = f"`{key}` {rows.schema[0].dataType.simpleString()}, type string, corrected string, carved array<struct<type: string, start: long, end: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [sniffed(b.as_py(), d.as_py()) for b, d in zip(batch.column(1), batch.column(2), strict=True)]
            carved = [[dict(zip(("type", "start", "end"), m, strict=True)) for m in f[2]] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array(carved, span)], [key, "type", "corrected", "carved"])

    return rows.mapInArrow(run, kinds)


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, those with blanks up to a positive multiple of UNIT)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_wav(payload: bytes) -> bytes:
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", len(head) + len(payload)) + head + payload


def wav_samples(b: bytes) -> bytes:
    """The data chunk of a WAV file."""
    k = 12
    while b[k : k + 4] != b"data":
        size = struct.unpack_from("<I", b, k + 4)[0]
        k += 8 + size + size % 2
    return b[k + 8 : k + 8 + struct.unpack_from("<I", b, k + 4)[0]]


def features(kind: str, carved: int, samples: bytes) -> str:
    """Type, media within, and of the samples: mean, root mean square about the middle, zero crossings, entropy."""
    x = np.frombuffer(samples, np.uint8)
    count = np.bincount(x, minlength=256)
    level = np.arange(256) - 128
    share = count[count > 0] / len(x)
    over = x >= 128
    return f"{kind}:{carved}:{count @ level / len(x):.3f}:{np.sqrt(count @ level**2 / len(x)):.3f}:{int((over[1:] != over[:-1]).sum())}:{-(share * np.log2(share)).sum():.4f}"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            n, payload = padded(text.as_py())
            media = to_wav(payload)
            kind, _, inner = sniffed(media, "text")
            back = wav_samples(media)
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(kind, len(inner), back)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def digest(docs: DataFrame) -> DataFrame:
    """Each text stored as a medium, sniffed and read back. One pass, no shuffle, a text at a time."""
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return own_columns(docs, "doc_id", "text").mapInArrow(_stored, kinds)
