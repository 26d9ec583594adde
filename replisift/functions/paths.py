"""Relative paths and the predicates that names must pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES = 255


def depth(name: Column) -> Column:
    """The number of slashes."""
    return (F.length(name) - F.length(F.replace(name, F.lit("/"), F.lit("")))).cast("int")


def basename(name: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(name, "/", -1)


def parent(name: Column) -> Column:
    """What precedes the last slash; null at the top."""
    return F.when(name.contains("/"), F.regexp_extract(name, r"(?s)^(.*)/[^/]*$", 1))


def split_extension(name: Column) -> Column:
    """(stem, extension): the extension starts at the last dot of the last component, and may be empty."""
    pattern = r"(?s)^(.*?)((?:\.[^./]*)?)$"
    return F.struct(F.regexp_extract(name, pattern, 1).alias("stem"), F.regexp_extract(name, pattern, 2).alias("extension"))


def join(folder: Column, name: Column, cap: int = MAX_BYTES) -> Column:
    """``folder/name``; null if longer than ``cap`` bytes.  An empty folder adds nothing."""
    out = F.when(F.coalesce(folder, F.lit("")) == "", name).otherwise(F.concat_ws("/", folder, name))
    return F.when(F.octet_length(out) <= cap, out)


def name_safe(name: Column) -> Column:
    """Whether a name can't leave its folder: not empty, no colon or backslash, no empty, ``.`` or ``..`` component."""
    bad = name.rlike(r"[:\\]") | F.exists(F.split(name, "/"), lambda c: c.isin("", ".", ".."))
    return F.coalesce(~bad, F.lit(False))


def text_safe(text: Column) -> Column:
    """Whether a text has no control character and no quotation mark."""
    return F.coalesce(~text.rlike(r'[\x00-\x1f\x7f"]'), F.lit(False))


def utf8_valid(data: Column) -> Column:
    """Whether bytes are UTF-8 without overlong forms, surrogates or values beyond U+10FFFF."""
    return F.is_valid_utf8(data.cast("string"))


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z as a-z."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def within(inner: Column, outer: Column) -> Column:
    """Whether ``inner`` is ``outer`` or lies below it; a volume's name ends in a colon."""
    i, o = ascii_lower(inner), ascii_lower(outer)
    return (i == o) | i.startswith(F.concat(o, F.lit("/"))) | (o.endswith(":") & i.startswith(o))


def overlap(a: Column, b: Column) -> Column:
    """Whether one path lies within the other."""
    return within(a, b) | within(b, a)


def host_address(url: Column, host_cap: int = 64) -> Column:
    """(host, port) of ``tcp://host:port``; null for anything else or a port outside 1 to 65535."""
    host = F.regexp_extract(url, r"^tcp://([A-Za-z0-9._-]+):\s*\+?(\d{1,18})[^:]*$", 1)
    port = F.regexp_extract(url, r"^tcp://([A-Za-z0-9._-]+):\s*\+?(\d{1,18})[^:]*$", 2)
    number = F.when(port != "", port.cast("long"))
    ok = (host != "") & (F.length(host) < host_cap) & number.between(1, 65535)
    return F.when(ok, F.struct(host.alias("host"), number.cast("int").alias("port")))


def _per_component(name: Column, change) -> Column:
    return F.array_join(F.transform(F.split(name, "/"), change), "/")


def to_local(name: Column) -> Column:
    """A UTF-8 name as the bytes of a Latin-1 file system.

    Each component whose characters all fit becomes Latin-1; one with wider
    characters keeps its UTF-8 bytes.
    """
    def one(c: Column) -> Column:
        return F.when(c.rlike("^[\\x00-\\xff]*$"), F.hex(F.encode(c, "ISO-8859-1"))).otherwise(F.hex(F.encode(c, "UTF-8")))

    return F.unhex(F.array_join(F.transform(F.split(name, "/"), one), "2F"))


def from_local(data: Column) -> Column:
    """The inverse: components that are UTF-8 with characters beyond Latin-1 stay, all others are read as Latin-1."""
    latin = F.decode(data, "ISO-8859-1")

    def one(c: Column) -> Column:
        raw = F.encode(c, "ISO-8859-1")
        wide = F.is_valid_utf8(raw.cast("string")) & F.try_validate_utf8(raw.cast("string")).rlike("[^\\x00-\\xff]")
        return F.when(wide, raw.cast("string")).otherwise(c)

    return _per_component(latin, one)
