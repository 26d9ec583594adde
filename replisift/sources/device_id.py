"""Device ids: the base-32 text of a 32-byte hash with four check characters."""

from __future__ import annotations

import base64
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def check_character(chunk: str) -> str:
    """The Luhn check character of base-32 text, modulus 32."""
    total = 0
    for k, c in enumerate(chunk):
        x = ALPHABET.index(c) * (1 + k % 2)
        total += x // 32 + x % 32
    return ALPHABET[-total % 32]


def from_raw(raw: bytes) -> str | None:
    """The id of a 32-byte hash; None for other lengths."""
    if raw is None or len(raw) != 32:
        return None
    text = base64.b32encode(raw).decode().rstrip("=")
    chunks = [text[k : k + 13] for k in range(0, 52, 13)]
    whole = "".join(c + check_character(c) for c in chunks)
    return "-".join(whole[k : k + 7] for k in range(0, 56, 7))


def normalize(text: str | None) -> str | None:
    """An id in its normal form; None if its characters, length or check characters are wrong."""
    if text is None:
        return None
    plain = text.replace("-", "").replace(" ", "").upper()
    if len(plain) != 56 or any(c not in ALPHABET for c in plain):
        return None
    chunks = [plain[k : k + 14] for k in range(0, 56, 14)]
    if any(check_character(c[:13]) != c[13] for c in chunks):
        return None
    return "-".join(plain[k : k + 7] for k in range(0, 56, 7))


def to_raw(text: str | None) -> bytes | None:
    """The 32 bytes of an id; None if it isn't one."""
    own = normalize(text)
    if own is None:
        return None
    plain = own.replace("-", "")
    body = "".join(plain[k : k + 13] for k in range(0, 56, 14))
    return base64.b32decode(body + "====")


def same(a: str | None, b: str | None) -> bool:
    """Whether two texts are the same id."""
    return normalize(a) is not None and normalize(a) == normalize(b)


# --- on columns, by built-in functions


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digit(char: Column) -> Column:
    """A base-32 character's value."""
    return F.call_function("instr", F.lit(ALPHABET), char) - 1


def _letter(value: Column) -> Column:
    return F.substring(F.lit(ALPHABET), value + 1, F.lit(1))


def _shifted(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value, by)


def _check(chunk: Column) -> Column:
    """:func:`check_character` of a column of 13 characters."""

    def one(total: Column, k: Column) -> Column:
        x = _digit(F.substring(chunk, k + 1, F.lit(1))) * (1 + k % 2)
        return total + _shifted(x, F.lit(5)) + x.bitwiseAND(F.lit(31))

    total = F.aggregate(F.sequence(F.lit(0), F.lit(12)), F.lit(0), one)
    return _letter(F.pmod(-total, F.lit(32)))


def _grouped(plain: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.substring(plain, k * 7 + 1, F.lit(7))), "-")


def device_id(raw: Column) -> Column:
    """:func:`from_raw` of a binary column: five bits of the hash a character."""

    def of(digits: Column) -> Column:
        def letter(k: Column) -> Column:
            at, rest = _shifted(k * 5, F.lit(2)), (k * 5).bitwiseAND(F.lit(3))
            byte = F.conv(F.substring(digits, at + 1, F.lit(2)), 16, 10).cast("int")
            return _letter(_shifted(byte, 3 - rest).bitwiseAND(F.lit(31)))

        chunk = lambda j: F.array_join(F.transform(F.sequence(j * 13, j * 13 + 12), letter), "")
        whole = F.transform(F.transform(F.sequence(F.lit(0), F.lit(3)), chunk), lambda c: F.concat(c, _check(c)))
        return _let(F.array_join(whole, ""), _grouped)

    return F.when(F.octet_length(raw) == 32, _let(F.concat(F.hex(raw), F.lit("00")), of))


def normalized(text: Column) -> Column:
    """:func:`normalize` of a text column."""

    def of(plain: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.substring(plain, j * 14 + 1, F.lit(14)))
        checked = F.forall(chunks, lambda c: _check(F.substring(c, F.lit(1), F.lit(13))) == F.substring(c, F.lit(14), F.lit(1)))
        return F.when(plain.rlike("^[A-Z2-7]{56}$"), F.when(checked, _grouped(plain)))

    return _let(F.upper(F.translate(text, "- ", "")), of)


def raw_of(text: Column) -> Column:
    """:func:`to_raw` of a text column: four bits of the id's characters a hexadecimal digit."""

    def of(body: Column) -> Column:
        def nibble(k: Column) -> Column:
            at, rest = F.floor(k * 4 / 5).cast("int"), k * 4 % 5
            pair = _digit(F.substring(body, at + 1, F.lit(1))) * 32 + F.when(at < 51, _digit(F.substring(body, at + 2, F.lit(1)))).otherwise(F.lit(0))
            return F.hex(_shifted(pair, 6 - rest).bitwiseAND(F.lit(15)))

        return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), nibble), ""))

    def without_checks(plain: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.substring(plain, j * 14 + 1, F.lit(13))), "")

    return _let(F.regexp_replace(normalized(text), "-", ""), lambda plain: _let(without_checks(plain), of))
