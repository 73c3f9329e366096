"""Media columns: signature sniffing (operator 3).

An Aho-Corasick automaton finds every magic number in the bytes; a validator of each format then follows the structure from
there (chunk lengths, checksums, offsets) and says how long the file is, or that it isn't one. ZIP and PDF files, whose
structure is told at their end, are confirmed from there. Sniffing a column corrects declared types by what is confirmed at
the beginning; carving returns every confirmed file inside in the order of offsets, of equal ones the longest first; files
within files are listed too.

Formats: PNG, WAV, BMP, PGM (binary), GIF, JPEG, WebP, GZIP, ZIP and PDF. Of the first four, 8-bit samples can also be written
and read here, without loss. Null or empty bytes have no type and nothing to carve.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmill.runtime import prepare

WIDTH = 576
MAGIC = {
    b"\x89PNG\r\n\x1a\n": ("image/png",),
    b"RIFF": ("audio/wav", "image/webp"),
    b"BM": ("image/bmp",),
    b"P5": ("image/x-portable-graymap",),
    b"GIF87a": ("image/gif",),
    b"GIF89a": ("image/gif",),
    b"\xff\xd8\xff": ("image/jpeg",),
    b"\x1f\x8b\x08": ("application/gzip",),
    b"%PDF-": (),  # no kinds: confirmed from the end
    b"%%EOF": (),
    b"PK\x05\x06": (),
}


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kinds in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (magic, kinds))
    found.make_automaton()
    return found


# Writers and readers.


def write_png(samples: bytes) -> bytes:
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> bytes:
    at, packed, width, height = 8, [], 0, 0
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", data, at + 8)
        elif kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def write_wav(samples: bytes) -> bytes:
    odd = len(samples) % 2
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + odd) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * odd


def read_wav(data: bytes) -> bytes:
    at = 12
    while at + 8 <= len(data):
        kind, n = struct.unpack_from("<4sI", data, at)
        if kind == b"data":
            return data[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def write_bmp(samples: bytes) -> bytes:
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)[::-1].tobytes()
    grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
    start = 54 + len(grey)
    return b"BM" + struct.pack("<IHHI", start + len(rows), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, WIDTH, len(rows) // WIDTH, 1, 8, 0, len(rows), 2835, 2835, 256, 0) + grey + rows


def read_bmp(data: bytes) -> bytes:
    start, (width, height) = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<ii", data, 18)
    return np.frombuffer(data, np.uint8, width * height, start).reshape(height, width)[::-1].tobytes()


def write_pgm(samples: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(samples) // WIDTH) + samples


def read_pgm(data: bytes) -> bytes:
    return data[_pgm_head(data, 0)[0] :]


CODECS = {"image/png": (write_png, read_png), "audio/wav": (write_wav, read_wav), "image/bmp": (write_bmp, read_bmp), "image/x-portable-graymap": (write_pgm, read_pgm)}


# Validators: the length of the file that begins at ``at``, or 0.


def _pgm_head(data: bytes, at: int) -> tuple[int, int]:
    """Where the samples begin, and how many there are."""
    import re

    head = re.compile(rb"P5[ \t\r\n]+(\d{1,9})[ \t\r\n]+(\d{1,9})[ \t\r\n]+255[ \t\r\n]").match(data, at)
    return (head.end(), int(head[1]) * int(head[2])) if head else (0, 0)


def _png(data: bytes, at: int) -> int:
    begin, at, kinds, packed = at, at + 8, [], []
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if not kinds and (kind, n) != (b"IHDR", 13):
            return 0
        if at + 12 + n > len(data) or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(data[at + 4 : at + 8 + n]):
            return 0
        kinds.append(kind)
        if kind == b"IDAT":
            packed.append((at + 8, n))
        at += 12 + n
        if kind == b"IEND":
            return at - begin if packed and _inflates(data, packed, struct.unpack_from(">IIBBBBB", data, begin + 16)) else 0
    return 0


def _inflates(data: bytes, packed: list[tuple[int, int]], head: tuple[int, ...]) -> bool:
    """Whether the parts of a PNG's stream give as many bytes as its head asks for; of interlaced images, whether it ends."""
    width, height, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if not channels or depth not in (1, 2, 4, 8, 16) or not width or not height:
        return False
    wanted, n, stream = ((width * channels * depth + 7) // 8 + 1) * height, 0, zlib.decompressobj()
    try:
        for at, size in packed:
            left = data[at : at + size]
            while left and not stream.eof and (n <= wanted or interlaced):
                n += len(stream.decompress(left, 1 << 20))
                left = stream.unconsumed_tail
        while not stream.eof and (more := stream.decompress(b"", 1 << 20)) and (n <= wanted or interlaced):
            n += len(more)
    except zlib.error:
        return False
    return stream.eof and (n == wanted or bool(interlaced))


def _riff(data: bytes, at: int, form: bytes) -> tuple[int, list[bytes]]:
    """The length of a RIFF file of this form and the kinds of its chunks; 0 if they don't fill it."""
    if len(data) < at + 12 or data[at + 8 : at + 12] != form:
        return 0, []
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    begin, at, kinds = at, at + 12, []
    while at + 8 <= end <= len(data):
        kind, n = struct.unpack_from("<4sI", data, at)
        kinds.append(kind)
        at += 8 + n + n % 2
    return (end - begin if at == end else 0), kinds


def _wav(data: bytes, at: int) -> int:
    size, kinds = _riff(data, at, b"WAVE")
    return size if b"fmt " in kinds and b"data" in kinds else 0


def _webp(data: bytes, at: int) -> int:
    size, kinds = _riff(data, at, b"WEBP")
    return size if kinds and kinds[0] in (b"VP8 ", b"VP8L", b"VP8X") else 0


def _jpeg(data: bytes, at: int) -> int:
    import re

    begin, at, frames = at, at + 2, 0
    while at + 4 <= len(data) or data[at : at + 2] == b"\xff\xd9":
        mark = data[at + 1]
        if data[at] != 0xFF or mark == 0xD8:
            return 0
        if mark == 0xD9:
            return at + 2 - begin if frames else 0
        if mark == 0xFF:  # fill
            at += 1
            continue
        n = struct.unpack_from(">H", data, at + 2)[0]
        if n < 2:
            return 0
        frames += 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        at += 2 + n
        if mark == 0xDA:  # a scan ends at the next mark that is neither a stuffed byte nor a restart
            stop = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S).search(data, at) if frames else None
            if not stop:
                return 0
            at = stop.start()
    return 0


def _bmp(data: bytes, at: int) -> int:
    if len(data) < at + 54:
        return 0
    size, zero, start, head = struct.unpack_from("<IIII", data, at + 2)
    width, height, planes, bits = struct.unpack_from("<iiHH", data, at + 18)
    fits = zero == 0 and head in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height != 0
    return size if fits and start + (width * bits + 31) // 32 * 4 * abs(height) <= size <= len(data) - at else 0


def _pgm(data: bytes, at: int) -> int:
    start, n = _pgm_head(data, at)
    return start + n - at if n and start + n <= len(data) else 0


def _gif(data: bytes, at: int) -> int:
    begin, at = at, at + 13
    if len(data) <= at:
        return 0
    at += 3 * (2 << (data[begin + 10] & 7)) if data[begin + 10] & 128 else 0
    images = 0
    while at < len(data):
        mark = data[at]
        if mark == 0x3B:
            return at + 1 - begin if images else 0
        if mark == 0x2C and at + 10 < len(data):
            images += 1
            flags = data[at + 9]
            at += 11 + (3 * (2 << (flags & 7)) if flags & 128 else 0)
        elif mark == 0x21:
            at += 2
        else:
            return 0
        while at < len(data) and data[at]:
            at += 1 + data[at]
        at += 1
    return 0


def _zip(data: bytes, end: int) -> tuple[int, int]:
    """Where the ZIP file begins and ends whose end record is at ``end``: its directory leads from one to the other."""
    if end + 22 > len(data):
        return 0, 0
    entries, size, start, note = struct.unpack_from("<HIIH", data, end + 10)
    begin, last = end - size - start, end + 22 + note
    if begin < 0 or last > len(data) or not entries:
        return 0, 0
    at = end - size
    for _ in range(entries):
        if at + 46 > end or data[at : at + 4] != b"PK\x01\x02":
            return 0, 0
        name, extra, comment = struct.unpack_from("<HHH", data, at + 28)
        local = begin + struct.unpack_from("<I", data, at + 42)[0]
        if data[local : local + 4] != b"PK\x03\x04":
            return 0, 0
        at += 46 + name + extra + comment
    return (begin, last) if at == end and data[begin : begin + 4] == b"PK\x03\x04" else (0, 0)


def _pdf(data: bytes, begin: int, mark: int) -> int:
    """The length of the PDF file that begins and has an end mark there, if the mark leads to a table of references."""
    import re

    at = re.compile(rb"startxref[ \t\r\n]+(\d{1,12})[ \t\r\n]+$").search(data[max(begin, mark - 64) : mark])
    if not at or not re.compile(rb"xref|\d{1,10} \d{1,5} obj").match(data, begin + int(at[1]), mark):
        return 0
    return re.compile(rb"\r?\n?").match(data, mark + 5).end() - begin


def _gzip(data: bytes, at: int) -> int:
    stream = zlib.decompressobj(31)
    view, i = memoryview(data), at
    try:
        while not stream.eof and i < len(data):
            stream.decompress(view[i : i + 65536])
            i += 65536
    except zlib.error:
        return 0
    return min(i, len(data)) - len(stream.unused_data) - at if stream.eof else 0


VALIDATORS = {"image/png": _png, "audio/wav": _wav, "image/webp": _webp, "image/bmp": _bmp, "image/x-portable-graymap": _pgm, "image/gif": _gif, "image/jpeg": _jpeg, "application/gzip": _gzip}


def find(data: bytes | None) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every confirmed file, in order of offset; files within others are listed too.

    A PDF file reaches to the last end mark that leads back into it, as updates are appended; it begins at the nearest head
    before the mark.
    """
    data, longest, pdf = data or b"", {}, None
    nul = data.rfind(b"\0")
    for last, (magic, kinds) in _automaton().iter(data.decode("latin-1")):
        at = last - len(magic) + 1
        if magic == b"\x1f\x8b\x08" and at + 10 > nul and data[at + 3 : at + 4] > b"\x07":
            continue  # a name or remark without its end: seen here, as zlib would read all that follows
        sizes = [(at, VALIDATORS[kind](data, at), kind) for kind in kinds]
        if magic == b"%PDF-":
            pdf = at
        elif magic == b"%%EOF" and pdf is not None:
            sizes = [(pdf, _pdf(data, pdf, at), "application/pdf")]
        elif magic == b"PK\x05\x06":
            begin, end = _zip(data, at)
            sizes = [(begin, end - begin, "application/zip")]
        for begin, size, kind in sizes:
            if size:
                longest[begin, kind] = max(size, longest.get((begin, kind), 0))
    return sorted(((at, size, kind) for (at, kind), size in longest.items()), key=lambda x: (x[0], -x[1]))


def sniff(df: DataFrame, data: str, declared: str | None = None) -> DataFrame:
    """df with sniffed (the type of the longest file confirmed at the first byte, else ``declared``, else null), corrected
    (boolean: it differs from the declared type) and embedded (array of offset, length and type of all files found but one
    that fills the value) added; these must not be names of its columns. Bytes after a file don't change its type; the file is
    then in embedded, so that it can be cut out. No shuffle."""
    from pyspark.sql.types import StructType

    prepare(df.sparkSession)
    names, new = df.columns, ["sniffed", "corrected", "embedded"]
    if clash := set(new) & set(names):
        raise ValueError(f"columns in use: {sorted(clash)}")
    at, said = names.index(data), names.index(declared) if declared else None
    inner = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types, fixed, within = [], [], []
            for i, value in enumerate(batch.column(at)):
                value, before = value.as_py(), batch.column(said)[i].as_py() if said is not None else None
                found = find(value)
                own = next((kind for begin, _, kind in found if begin == 0), None)
                types.append(own or before)
                fixed.append(own is not None and own != before)
                within.append([{"offset": b, "length": n, "type": k} for b, n, k in found if not (b == 0 and k == own and n == len(value))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(types, pa.string()), pa.array(fixed, pa.bool_()), pa.array(within, inner)], [*names, *new])

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL("sniffed string, corrected boolean, embedded array<struct<offset: bigint, length: bigint, type: string>>").fields]))


def carve(df: DataFrame, data: str, key: str) -> DataFrame:
    """(key, offset, type, bytes) of every file found inside the column, those that fill it whole too."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(1)):
                value = value.as_py()
                for at, n, kind in find(value):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([at]), pa.array([kind]), pa.array([value[at : at + n]], pa.binary())], ["key", "offset", "type", "bytes"])

    return df.select(df[key].alias("key"), df[data].alias("data")).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, offset long, type string, bytes binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(text: str | None) -> tuple[int, bytes]:
    """The text's bytes padded with 255 to a positive multiple of WIDTH and stored in a format that its content decides."""
    data = (text or "").encode()
    payload = data + b"\xff" * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))
    return len(data), list(CODECS.values())[zlib.crc32(payload) % len(CODECS)][0](payload)


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every text as media, sniffs the stored bytes, reads them back by the type found and digests what was read.

    feature: type, mean and standard deviation of the samples, share of pad-like samples (255), files found further in. Null
    texts count as empty. One row for each row of df; no shuffle.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, media = store(text.as_py())
                found = find(media)
                kind = next((k for at, size, k in found if at == 0 and size == len(media)), None)
                if kind is None:
                    raise ValueError(f"stored form of {doc} isn't recognised")
                payload = CODECS[kind][1](media)
                samples = np.frombuffer(payload, np.uint8)
                feature = f"{kind};mean={samples.mean():.4f};std={samples.std():.4f};pad={np.count_nonzero(samples == 255) / len(samples):.4f};embedded={len(found) - 1}"
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (3, 6, 7) else pa.int64()) for i, c in enumerate(columns)], [x.split()[0] for x in DIGEST.split(", ")])

    return df.selectExpr(f"cast(`{key}` as bigint) as doc_id", f"`{text}` as text").mapInArrow(run, DIGEST)
