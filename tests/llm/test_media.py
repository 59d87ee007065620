import gzip
import hashlib
import io
import struct
import zipfile
import zlib

import pytest
from veilframe.llm import media as M


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello" * 20)
    return out.getvalue()


SAMPLES = {
    "wav": M.to_wav(b"abc" * 64),
    "png": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b""),
    "gif": b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"!\xf9\x04\x01\0\0\0\0" + b",\0\0\0\0\1\0\1\0\0" + b"\x02\x02D\x01\0;",
    "jpeg": b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0\1\1\0\0\1\0\1\0\0" + b"\xff\xc0" + struct.pack(">H", 11) + b"\x08\0\1\0\1\1\1\x11\0" + b"\xff\xda" + struct.pack(">H", 8) + b"\1\1\0\0?\0" + b"\x12\xff\0\x34\xff\xd0\x56" + b"\xff\xd9",
    "bmp": b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0",
    "zip": zipped(),
    "gzip": gzip.compress(b"hello" * 50),
    "pdf": b"%PDF-1.4\n1 0 obj\nendobj\nxref\ntrailer\nstartxref\n9\n%%EOF\n",
    "ogg": b"OggS\0\x02" + bytes(20) + b"\x01\x05hello" + b"OggS\0\x04" + bytes(20) + b"\x01\x03end",
    "flac": b"fLaC" + b"\x80\0\0\x22" + bytes(34) + b"\xff\xf8rest",
}


@pytest.mark.parametrize("kind", SAMPLES)
def test_type_is_corrected_and_carved(kind):
    b = SAMPLES[kind]
    assert M.sniffed(b, "text/plain")[:2] == (kind, kind)
    junk = b"some BM text RIFF " + b + (b"" if kind == "flac" else b" tail PK\x03\x04 GIF89a")
    kind_, declared, found = M.sniffed(junk, "bin")
    assert (kind_, declared) == ("", "bin") and found == [(kind, 18, 18 + len(b))]


@pytest.mark.parametrize("kind", [k for k in SAMPLES if k != "flac"])
def test_cut_or_broken_is_none(kind):
    b = SAMPLES[kind]
    assert M.VALIDATORS[kind](b[: len(b) * 2 // 3], 0) is None
    assert M.media_in(b"") == [] and M.media_in(M.MAGIC[0][0]) == []


def test_media_within_a_medium():
    kind, _, inner = M.sniffed(M.to_wav(b"x" * 10 + SAMPLES["png"] + b"y" * 9), "wav")
    assert kind == "wav" and [(k, e - s) for k, s, e in inner] == [("png", len(SAMPLES["png"]))]


TEXTS = [None, "", "a", "é" * 96, "é" * 97, "x" * 192, "x" * 193, "word " * 50_000, "RIFF BM PK\x03\x04 %PDF- \x00\x00", "same", "same"]


def test_texts_round_trip(spark):
    df = spark.createDataFrame([(i, t, b"z") for i, t in enumerate(TEXTS)] + [(None, "q", None)], "doc_id long, text string, feature binary")
    got = M.digest(df).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        data = ("q" if r.doc_id is None else TEXTS[r.doc_id] or "").encode()
        size = max(1, -(-len(data) // 192)) * 192
        payload = data.ljust(size)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), size, hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.feature.startswith("wav:0:")
        assert (r.media_bytes, r.media_sha256) == (size + 44, hashlib.sha256(M.to_wav(payload)).hexdigest())
    same = [tuple(r)[1:] for r in got if r.doc_id in (9, 10)]
    assert same[0] == same[1]


def test_sniff_operator(spark):
    df = spark.createDataFrame([(1, bytearray(SAMPLES["png"]), "jpeg"), (2, None, "gif"), (3, bytearray(b"--" + SAMPLES["gif"]), None)], "id long, content binary, declared string")
    got = {r.id: (r.type, r.corrected, [(c.type, c.start, c.end) for c in r.carved]) for r in M.sniff(df).collect()}
    assert got == {1: ("png", "png", []), 2: (None, "gif", []), 3: ("", None, [("gif", 2, 2 + len(SAMPLES["gif"]))])}
    assert M.sniff(df.limit(0)).count() == 0


def test_many_zip_signatures_in_time():
    import time

    data = b"PK\x03\x04" * 30_000 + b"PK\x05\x06" + b"\xff" * 18
    began = time.perf_counter()
    assert M.media_in(data * 4) == [] and time.perf_counter() - began < 5


def test_features_against_plain_python():
    import math
    import random

    data = bytes(random.Random(3).choices(range(32, 200), k=576))
    mean = sum(x - 128 for x in data) / len(data)
    rms = math.sqrt(sum((x - 128) ** 2 for x in data) / len(data))
    crossings = sum((a >= 128) != (b >= 128) for a, b in zip(data, data[1:]))
    entropy = -sum(data.count(x) / len(data) * math.log2(data.count(x) / len(data)) for x in set(data))
    assert M.features("wav", 2, data) == f"wav:2:{mean:.3f}:{rms:.3f}:{crossings}:{entropy:.4f}"
