"""The protocol-buffer wire format: enough of it to read and write records."""

from __future__ import annotations

from collections.abc import Iterator

VARINT, I64, LEN, I32 = 0, 1, 2, 5
_MASK = (1 << 64) - 1


class Malformed(ValueError):
    """Bytes that aren't a message."""


def varint(n: int) -> bytes:
    """A number as a varint; negative ones as unsigned 64-bit numbers."""
    n &= _MASK
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def number(field: int, value: int) -> bytes:
    """A numeric field."""
    return varint(field << 3 | VARINT) + varint(value)


def data(field: int, value: bytes | str) -> bytes:
    """A field of bytes, text or an embedded message."""
    raw = value.encode() if isinstance(value, str) else bytes(value)
    return varint(field << 3 | LEN) + varint(len(raw)) + raw


def signed(n: int, bits: int = 64) -> int:
    """An unsigned number's value as a signed one of some width."""
    n &= (1 << bits) - 1
    return n - (1 << bits) if n >> bits - 1 else n


def read_varint(buf: bytes, at: int) -> tuple[int, int]:
    """(number, where it ends)."""
    out = 0
    for k in range(10):
        if at + k >= len(buf):
            raise Malformed("cut off")
        b = buf[at + k]
        out |= (b & 0x7F) << 7 * k
        if b < 0x80:
            return out & _MASK, at + k + 1
    raise Malformed("a number of more than ten bytes")


def fields(buf: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field, wire type, value) of a message, in order; unknown fields come too, to be skipped."""
    at = 0
    while at < len(buf):
        tag, at = read_varint(buf, at)
        field, kind = tag >> 3, tag & 7
        if not field:
            raise Malformed("field 0")
        if kind == VARINT:
            value, at = read_varint(buf, at)
            yield field, kind, value
            continue
        if kind == LEN:
            n, at = read_varint(buf, at)
        elif kind in (I64, I32):
            n = 8 if kind == I64 else 4
        else:
            raise Malformed(f"wire type {kind}")
        if at + n > len(buf):
            raise Malformed("cut off")
        yield field, kind, buf[at : at + n]
        at += n
