"""Blocks and hashes of contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import COUNTER

# Fixed values.
SMALLEST_BLOCK, LARGEST_BLOCK, WANTED_BLOCKS = 128 << 10, 16 << 20, 2000
LARGEST_STORED_BLOCK, MOST_BLOCKS = 1 << 20, 2048
_LOW = 0xFFFFFFFF


def block_size(size: Column, smallest: int = SMALLEST_BLOCK, largest: int = LARGEST_BLOCK, wanted: int = WANTED_BLOCKS) -> Column:
    """The smallest power of two from ``smallest`` to ``largest`` of which fewer than ``wanted`` hold ``size``; else the largest."""
    out, bs = None, smallest
    while bs < largest:
        test = size < wanted * bs
        out = F.when(test, F.lit(bs)) if out is None else out.when(test, F.lit(bs))
        bs *= 2
    return (F.lit(largest) if out is None else out.otherwise(F.lit(largest))).cast("int")


def n_blocks(size: Column, bs: Column) -> Column:
    """The number of blocks; an empty file has one."""
    return F.greatest(F.lit(1), F.ceil(size / bs)).cast("int")


def too_big(size: Column) -> Column:
    """Whether a file has more blocks, of the largest size, than a record can keep: it is listed, but not hashed."""
    return n_blocks(size, block_size(size)) > MOST_BLOCKS


def block_spans(size: Column, bs: Column) -> Column:
    """Array of (offset, size) of a file's blocks."""
    size, bs = size.cast("long"), bs.cast("long")
    return F.transform(
        F.sequence(F.lit(0).cast("long"), n_blocks(size, bs).cast("long") - 1),
        lambda i: F.struct((i * bs).alias("offset"), F.greatest(F.lit(0).cast("long"), F.least(bs, size - i * bs)).alias("size")),
    )


def read_block(content: Column, offset: Column, size: Column) -> Column:
    """``size`` bytes at ``offset``; null if there are fewer."""
    got = F.substring(content, (offset + 1).cast("int"), size.cast("int"))
    return F.when(F.length(got) == size, got)


def sha256(data: Column) -> Column:
    """The SHA-256 of bytes, as bytes."""
    return F.unhex(F.sha2(data, 256))


def block_hashes(content: Column, bs: Column) -> Column:
    """The hash of each block, in order."""
    n = n_blocks(F.length(content), bs)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: sha256(F.substring(content, (i * bs + 1).cast("int"), bs.cast("int"))))


def content_hash(hashes: Column) -> Column:
    """A content's fingerprint: the hash of its blocks' hashes in order."""
    return sha256(F.unhex(F.array_join(F.transform(hashes, lambda h: F.hex(h)), "")))


def storable(bs: Column, blocks: Column) -> Column:
    """Whether a record's blocks can be kept; one without blocks can."""
    n = F.coalesce(F.size(blocks), F.lit(0))
    return (n <= 0) | ((bs > 0) & (bs <= LARGEST_STORED_BLOCK) & (n <= MOST_BLOCKS))


def _bytes(data: Column) -> Column:
    places = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(places, lambda k: F.conv(F.hex(F.substring(data, k, F.lit(1))), 16, 10).cast("long"))


def fnv32(data: Column) -> Column:
    """The 32-bit FNV-1a hash of bytes, as a long."""
    return F.aggregate(_bytes(data), F.lit(0x811C9DC5).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 0x01000193).bitwiseAND(F.lit(_LOW)))


def fnv64(data: Column) -> Column:
    """The 64-bit FNV-1a hash of bytes, in hexadecimal digits.

    Kept as two halves, as a product of 64 bits doesn't fit a long: the prime is
    2^40 + 0x1B3, so the upper half gains the lower one shifted by 8 bits.
    """
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(h: Column, b: Column) -> Column:
        low = h["lo"].bitwiseXOR(b)
        small = low * 0x1B3
        high = h["hi"] * 0x1B3 + F.shiftright(small, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(F.lit(_LOW)).alias("hi"), small.bitwiseAND(F.lit(_LOW)).alias("lo"))

    half = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.aggregate(_bytes(data), start, step, lambda h: F.concat(half(h["hi"]), half(h["lo"])))


def short_id(raw: Column) -> Column:
    """The first eight bytes of a device's hash as an unsigned big-endian number."""
    return F.conv(F.substring(F.hex(raw), 1, 16), 16, 10).cast(COUNTER)


def resume_block(temp_size: Column, bs: Column, blocks: Column) -> Column:
    """The block at which to resume a partial file; 0 if it is longer than its blocks can be."""
    whole = F.floor(temp_size / bs)
    return F.when(temp_size > blocks.cast("long") * bs, F.lit(0).cast("long")).otherwise(F.least(whole, blocks.cast("long")))


def verify(found: Column, expected: Column, bs: Column) -> Column:
    """(ok, bad_block, offset) of block hashes against the expected ones; the first bad block counts from 0, null if none."""
    same = F.zip_with(found, expected, lambda a, b: F.coalesce(a == b, F.lit(False)))
    at = F.array_position(same, F.lit(False))
    bad = F.when(at > 0, at - 1)
    return F.struct((at == 0).alias("ok"), bad.alias("bad_block"), (bad * bs).alias("offset"))
