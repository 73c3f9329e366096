from __future__ import annotations

import gzip
import hashlib
import io
import zipfile
import zlib

import pytest

from quillmill.llm import media


@pytest.mark.parametrize("kind", sorted(media.CODECS))
@pytest.mark.parametrize("payload", [b"\xff" * 576, bytes(i % 251 for i in range(576 * 5)), b"RIFFBMP5 PK\x03\x04".ljust(576, b"\0")])
def test_round_trip_and_sniffing(kind, payload):
    write, read = media.CODECS[kind]
    data = write(payload)
    assert read(data) == payload
    assert (0, len(data), kind) in media.find(data)


def test_carving_finds_embedded_files_and_rejects_broken_ones(spark):
    png, wav, bmp = media.write_png(b"\1" * 576), media.write_wav(b"\2" * 600), media.write_bmp(b"\3" * 576)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.txt", "hello")
    zipped, squeezed = gzip.compress(b"text" * 9), packed.getvalue()
    broken = bytearray(png)
    broken[40] ^= 1
    data = b"junk" + png + b"PK\x03\x04" + wav + b"BM" + bytes(broken) + bmp + b"--" + zipped + b"RIFF" + squeezed
    want = [(data.index(png), png, "image/png"), (data.index(wav), wav, "audio/wav"), (data.index(bmp), bmp, "image/bmp"), (data.index(zipped), zipped, "application/gzip"), (data.index(squeezed), squeezed, "application/zip")]
    frame = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray())], "id int, data binary")
    got = [(r["offset"], bytes(r["bytes"]), r["type"]) for r in media.carve(frame, "data", "id").collect()]
    assert got == want


def test_declared_types_are_corrected(spark):
    png = media.write_png(b"\0" * 576)
    rows = [(1, bytearray(png), "image/jpeg"), (2, bytearray(png), "image/png"), (3, bytearray(b"text"), "text/plain"), (4, None, None), (5, bytearray(png + b"x"), "image/png")]
    got = {r["id"]: (r["sniffed"], r["corrected"], len(r["embedded"])) for r in media.sniff(spark.createDataFrame(rows, "id int, data binary, declared string"), "data", "declared").collect()}
    assert got == {1: ("image/png", True, 0), 2: ("image/png", False, 0), 3: ("text/plain", False, 0), 4: (None, False, 0), 5: ("image/png", False, 1)}
    with pytest.raises(ValueError):
        media.sniff(spark.createDataFrame([], "data binary, sniffed int"), "data")


def test_digest_of_whole_texts(spark):
    texts = [None, "", "a", "é" * 288, "x" * 576, "x" * 577, "long " * 40_000, "a"]
    got = {r["doc_id"]: r for r in media.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        _, stored = media.store(text)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert got[2][1:] == got[7][1:] and got[0][1:] == got[1][1:]


def test_trailing_bytes_leave_the_type_corrected(spark):
    frame = spark.createDataFrame([(1, bytearray(media.write_png(b"\0" * 576) + b"x"), "image/jpeg")], "id int, data binary, declared string")
    got = media.sniff(frame, "data", "declared").collect()[0]
    assert (got["sniffed"], got["corrected"]) == ("image/png", True)
    assert [(e["offset"], e["type"]) for e in got["embedded"]] == [(0, "image/png")]


def jpeg() -> bytes:
    part = lambda mark, body: bytes((0xFF, mark)) + (len(body) + 2).to_bytes(2, "big") + body
    frame = part(0xC0, b"\x08\0\x10\0\x10\x01\x01\x11\0")
    return b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + frame + part(0xDA, b"\x01\x01\0\0\x3f\0") + b"ab\xff\0cd\xff\xd0ef" + b"\xff\xd9"


def pdf() -> bytes:
    body = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\n"
    first = body + b"xref\n0 1\ntrailer\n<<>>\nstartxref\n%d\n%%%%EOF\n" % len(body)
    return first + b"xref\n0 1\ntrailer\n<<>>\nstartxref\n%d\n%%%%EOF\n" % len(first)  # with an update


def webp() -> bytes:
    body = b"WEBPVP8L" + (6).to_bytes(4, "little") + b"\x2f12345"
    return b"RIFF" + len(body).to_bytes(4, "little") + body


@pytest.mark.parametrize("make, kind", [(jpeg, "image/jpeg"), (pdf, "application/pdf"), (webp, "image/webp")])
def test_formats_that_are_only_recognised(make, kind):
    data = make()
    assert media.find(data) == [(0, len(data), kind)]
    assert media.find(b"--" + data + b"--" + data) == [(2, len(data), kind), (4 + len(data), len(data), kind)]
    assert media.find(data[:-3]) != [(0, len(data) - 3, kind)] or kind == "application/pdf"
    assert not media.find(data[: len(data) // 2])


def test_a_png_whose_samples_are_missing_is_none():
    data = media.write_png(b"\1" * 1152)
    short = bytearray(data)
    short[20:24] = (3).to_bytes(4, "big")  # a row more than there is, with a right checksum
    short[29:33] = zlib.crc32(bytes(short[12:29])).to_bytes(4, "big")
    assert media.find(data) and not media.find(bytes(short))


def test_a_stored_archive_in_an_archive_is_found_beside_it():
    def packed(name, content):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, content)
        return out.getvalue()

    inner = packed("a.txt", "hello")
    outer = packed("b.zip", inner)
    assert media.find(b"##" + outer) == [(2, len(outer), "application/zip"), (2 + outer.index(inner), len(inner), "application/zip")]


@pytest.mark.parametrize("magic", list(media.MAGIC) + [b"PK\x03\x04", b"%PDF-startxref 0 %%EOF", jpeg()[:-2]])
def test_repeated_magic_takes_linear_time(magic):
    import time

    def seconds(n):
        begin = time.process_time()
        media.find(magic * n)
        return time.process_time() - begin

    seconds(10)
    assert seconds(80_000) < 30 * max(seconds(8_000), 0.01)
