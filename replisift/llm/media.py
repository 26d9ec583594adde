"""Media columns: signature sniffing, carving and a lossless 8-bit store.

An Aho-Corasick automaton locates all magic byte strings in one pass.  At each
hit a validator of that format reads the structure and either gives the exact
length or refuses, so a chance occurrence of two magic bytes is no medium.
What stands at offset 0 corrects a declared type; what stands elsewhere, outside
media already found, is carved.

``store_samples`` keeps any bytes as an 8-bit greyscale PNG, 64 samples a row,
``store_wave`` as 8-bit mono sound.  ``text_media`` stores a text in one of these
forms, in a record whose header has a length of its own and declares a type that
may be wrong; a checksum of the payload chooses all three.  What it reads back is
what sniffing carves from the record: only that tells where the medium begins and
ends, and of which form it is, and it corrects the declared type where that is wrong.

FLAC data has no length in its header, so a FLAC file is taken to reach to the end.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

from pyspark.sql import DataFrame

from ._common import held, map_texts

#: Magic bytes, format and the place of the magic within the format.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", "png", 0),
    (b"\xff\xd8\xff", "jpeg", 0),
    (b"GIF87a", "gif", 0),
    (b"GIF89a", "gif", 0),
    (b"BM", "bmp", 0),
    (b"RIFF", "riff", 0),
    (b"%PDF-", "pdf", 0),
    (b"fLaC", "flac", 0),
    (b"OggS", "ogg", 0),
    (b"ftyp", "mp4", 4),
]
PNG_MAGIC = MAGIC[0][0]
ROW = 64


def _png(data, at: int) -> tuple[str, int] | None:
    pos, first = at + 8, True
    while pos + 12 <= len(data):
        (n,) = struct.unpack_from(">I", data, pos)
        kind, end = bytes(data[pos + 4 : pos + 8]), pos + 12 + n
        if end > len(data) or first != (kind == b"IHDR") or zlib.crc32(data[pos + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return None
        if kind == b"IEND":
            return "png", end - at
        pos, first = end, False
    return None


def _jpeg(data, at: int) -> tuple[str, int] | None:
    pos, frame = at + 2, False
    while pos + 4 <= len(data) and data[pos] == 0xFF:
        marker = data[pos + 1]
        if marker == 0xD9:
            return ("jpeg", pos + 2 - at) if frame else None
        (n,) = struct.unpack_from(">H", data, pos + 2)
        if n < 2 or pos + 2 + n > len(data):
            return None
        frame |= 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        pos += 2 + n
        if marker == 0xDA:  # entropy-coded data: up to the next marker that isn't stuffing or a restart
            while True:
                pos = data.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(data):
                    return None
                if data[pos + 1] == 0 or 0xD0 <= data[pos + 1] <= 0xD7:
                    pos += 2
                else:
                    break
            if data[pos + 1] == 0xD9:
                return ("jpeg", pos + 2 - at) if frame else None
    return None


def _gif(data, at: int) -> tuple[str, int] | None:
    if at + 13 > len(data):
        return None
    pos = at + 13 + (3 << (data[at + 10] & 7) + 1 if data[at + 10] & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(data) and data[p]:
            p += 1 + data[p]
        return p + 1

    seen = False
    while pos < len(data):
        if data[pos] == 0x3B:
            return ("gif", pos + 1 - at) if seen else None
        if data[pos] == 0x21:
            pos = blocks(pos + 2)
        elif data[pos] == 0x2C and pos + 10 < len(data):
            seen, packed = True, data[pos + 9]
            pos = blocks(pos + 11 + (3 << (packed & 7) + 1 if packed & 0x80 else 0))
        else:
            return None
    return None


def _bmp(data, at: int) -> tuple[str, int] | None:
    if at + 54 > len(data):
        return None
    size, zero, offset, header = struct.unpack_from("<IIII", data, at + 2)
    planes, depth = struct.unpack_from("<HH", data, at + 26)
    ok = zero == 0 and header in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 54 <= offset <= size
    return ("bmp", size) if ok and at + size <= len(data) else None


def _riff(data, at: int) -> tuple[str, int] | None:
    if at + 20 > len(data):
        return None
    (n,) = struct.unpack_from("<I", data, at + 4)
    kind = {b"WAVE": ("wav", b"fmt "), b"WEBP": ("webp", b"VP8"), b"AVI ": ("avi", b"LIST")}.get(bytes(data[at + 8 : at + 12]))
    ok = kind and bytes(data[at + 12 : at + 16]).startswith(kind[1]) and n >= 12 and at + 8 + n <= len(data)
    return (kind[0], 8 + n) if ok else None


def _pdf(data, at: int) -> tuple[str, int] | None:
    if at + 8 > len(data) or not (48 <= data[at + 5] <= 57 and data[at + 6] == 46 and 48 <= data[at + 7] <= 57):
        return None
    # Updates append end marks, so the last one counts, before the next header: each byte is searched for one header only.
    until = data.find(b"%PDF-", at + 5)
    until = len(data) if until < 0 else until
    end = data.rfind(b"%%EOF", at, until)
    return ("pdf", end + 5 - at) if end > 0 and data.find(b"startxref", at, end) > 0 else None


def _flac(data, at: int) -> tuple[str, int] | None:
    ok = at + 42 <= len(data) and data[at + 4] & 0x7F == 0 and bytes(data[at + 5 : at + 8]) == b"\x00\x00\x22"
    return ("flac", len(data) - at) if ok else None


def _ogg(data, at: int) -> tuple[str, int] | None:
    pos = at
    while data[pos : pos + 4] == b"OggS" and pos + 27 <= len(data) and data[pos + 4] == 0:
        n = data[pos + 26]
        end = pos + 27 + n + sum(data[pos + 27 : pos + 27 + n])
        if pos + 27 + n > len(data) or end > len(data):
            break
        pos = end
    return ("ogg", pos - at) if pos > at else None


def _mp4(data, at: int) -> tuple[str, int] | None:
    pos, kinds = at, []
    while pos + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, pos)
        least = 8
        if n == 1 and pos + 16 <= len(data):  # a 64-bit size follows
            (n,), least = struct.unpack_from(">Q", data, pos + 8), 16
        elif n == 0 and kind == b"mdat":  # the last box may go to the end
            n = len(data) - pos
        if n < least or pos + n > len(data) or not kind.isalnum():
            break
        kinds.append(kind)
        pos += n
    return ("mp4", pos - at) if kinds[:1] == [b"ftyp"] and b"moov" in kinds else None


VALIDATE = {"png": _png, "jpeg": _jpeg, "gif": _gif, "bmp": _bmp, "riff": _riff, "pdf": _pdf, "flac": _flac, "ogg": _ogg, "mp4": _mp4}


class Sniffer:
    """Finds confirmed media in byte strings."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for magic, kind, back in MAGIC:
            self.automaton.add_word(magic.decode("latin-1"), (kind, len(magic) - 1 + back))
        self.automaton.make_automaton()

    def find(self, data: bytes) -> list[tuple[str, int, int]]:
        """(type, offset, length) of media, by offset; media inside found media aren't listed."""
        found, until = [], 0
        hits = sorted((end - back, kind) for end, (kind, back) in self.automaton.iter(data.decode("latin-1")))
        for at, kind in hits:
            if at >= until and (got := VALIDATE[kind](data, at)):
                found.append((got[0], at, got[1]))
                until = at + got[1]
        return found


def store_samples(payload: bytes) -> bytes:
    """``payload``, whose size is a positive multiple of 64, as an 8-bit greyscale PNG of 64 columns."""
    import numpy as np

    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)
    raw[:, 1:] = rows
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    header = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def store_wave(payload: bytes) -> bytes:
    """``payload`` as the samples of a sound of 8 bits a sample, one channel."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload))
    return head + payload


def read_samples(media: bytes) -> bytes:
    """The samples of a medium that :func:`store_samples` or :func:`store_wave` made."""
    import numpy as np

    if media[:4] == b"RIFF":
        pos = 12
        while pos + 8 <= len(media):
            kind, n = struct.unpack_from("<4sI", media, pos)
            if kind == b"data":
                return media[pos + 8 : pos + 8 + n]
            pos += 8 + n + n % 2
        raise ValueError("a sound without samples")
    pos, body, height = 8, [], 0
    while pos < len(media):
        (n,) = struct.unpack_from(">I", media, pos)
        kind = media[pos + 4 : pos + 8]
        if kind == b"IHDR":
            _, height = struct.unpack_from(">II", media, pos + 8)
        elif kind == b"IDAT":
            body.append(media[pos + 8 : pos + 8 + n])
        pos += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, ROW + 1)
    if raw[:, 0].any():
        raise ValueError("rows are filtered")
    return raw[:, 1:].tobytes()


#: The header of a record, before and after the type that it declares, what comes before a name in it, and what ends it.
RECORD = (b"Content-Type: ", b"\r\n", b"X-Name: ", b"\r\n\r\n", b"\r\n--\r\n")
#: Types that records of texts declare, and the forms that they hold.
DECLARED = ("png", "text", "wav", "gif")
FORMS = (store_samples, store_wave)


def record(media: bytes, declared: str, name: str = "") -> bytes:
    """``media`` in a record that declares a type and has a name."""
    return RECORD[0] + declared.encode() + RECORD[1] + RECORD[2] + name.encode() + RECORD[3] + media + RECORD[4]


def read_record(sniff: Sniffer, data: bytes) -> tuple[str, str, bytes]:
    """(declared type, confirmed type, carved media) of a record; the media is where sniffing finds it."""
    declared = data[len(RECORD[0]) : data.index(RECORD[1])].decode()
    found = sniff.find(data)
    if not found:
        raise ValueError("the record holds no medium")
    kind, at, size = found[0]
    return declared, kind, data[at : at + size]


def text_record(payload: bytes) -> bytes:
    """The record of a payload; equal payloads have equal ones.  The name's hexadecimal digits hold no signature."""
    h = zlib.crc32(payload)
    form = FORMS[h % len(FORMS)]
    return record(form(payload), DECLARED[h // 2 % len(DECLARED)], f"{h:08x}" * (h // 8 % 5))


def _padded(data: bytes) -> bytes:
    return data + bytes(ROW * max(1, -(-len(data) // ROW)) - len(data))


def sniffer() -> Sniffer:
    """The worker's sniffer."""
    loaded = held("media")
    if "sniffer" not in loaded:
        loaded["sniffer"] = Sniffer()
    return loaded["sniffer"]


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """Stores every text as a medium in a record, carves it from there and reads it back.

    Per row: id, ``n_bytes``, ``payload_bytes``, ``payload_sha256`` and
    ``tail_crc32`` (of what was read back from the carved form), ``media_bytes``,
    ``media_sha256`` (of the carved form), ``feature``, ``declared_type``,
    ``media_type`` (confirmed), ``corrected`` and [``media``].  ``feature`` holds
    the confirmed type, the rows, mean sample and the carved media of the
    payload as ``type@offset+length``.

    Null or empty text: 64 zero bytes.  Repeated rows and null ids: a row each,
    equal texts with equal values.  Empty table: no row.  Other columns aren't
    read.  One text and its stored form are held at a time.
    """

    def make():
        sniff = sniffer()

        def one(data: bytes) -> list[tuple]:
            declared, kind, media = read_record(sniff, text_record(_padded(data)))
            back = read_samples(media)
            carved = ",".join(f"{k}@{a}+{n}" for k, a, n in sniff.find(back))
            feature = f"type={kind};rows={len(back) // ROW};mean={sum(back) // len(back)};carved={carved}"
            row = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature, declared, kind, declared != kind)
            return [(*row, media) if with_media else row]

        return one

    out = [("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]
    out += [("declared_type", "string"), ("media_type", "string"), ("corrected", "boolean")]
    return map_texts(df, make, out + [("media", "binary")] * with_media, id_col, text_col)


def sniff_media(df: DataFrame, bytes_col: str, declared_col: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Types and embedded media of a binary column.

    Per row: id, ``declared``, ``media_type`` (confirmed at offset 0, else null),
    ``corrected`` (true where a type was declared and another was confirmed) and
    ``carved``, an array of (type, offset, length, data) of the media elsewhere.

    Null or empty bytes: null type, nothing carved.  Repeated rows and null ids:
    a row each.  Empty table: no row.
    """
    from pyspark.sql import functions as F

    from ._common import ship

    ship(df.sparkSession)

    @F.pandas_udf("struct<media_type:string,carved:array<struct<type:string,offset:bigint,length:bigint,data:binary>>>")
    def sniffed(column):
        import pandas as pd

        sniff, rows = sniffer(), []
        for data in column:
            found = sniff.find(bytes(data)) if data is not None else []
            first = found[0][0] if found and found[0][1] == 0 else None
            rows.append((first, [{"type": k, "offset": a, "length": n, "data": data[a : a + n]} for k, a, n in found if a]))
        return pd.DataFrame(rows, columns=["media_type", "carved"])

    declared = F.lower(F.col(declared_col)) if declared_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col), declared.alias("declared"), sniffed(F.col(bytes_col).cast("binary")).alias("s"))
    return rows.select(
        id_col, "declared", "s.media_type", F.coalesce(F.col("declared") != F.col("s.media_type"), F.lit(False)).alias("corrected"), "s.carved"
    )
