"""Version vectors: maps from a device's short id to its counter.

Ids and counters are unsigned 64-bit numbers, so counters are DECIMAL(20,0) and
ids are their decimal text.  A null vector is an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CONCURRENT, COUNTER, EQUAL, OURS, THEIRS, VERSION

MAX_COUNTERS = 16


def vector(v: Column) -> Column:
    """``v``, or an empty vector for null."""
    return F.coalesce(v, F.expr(f"cast(map() as {VERSION})"))


def vector_of(entries: Column) -> Column:
    """A vector from an array of (id, value) structs; of entries with one id the first counts."""
    ids = F.transform(entries, lambda e: e["id"])
    first = F.filter(entries, lambda e, i: F.array_position(ids, e["id"]) == i + 1)
    return F.map_from_entries(first)


def compare(ours: Column, theirs: Column) -> Column:
    """EQUAL, OURS, THEIRS or CONCURRENT; a missing counter is 0."""
    zero = F.lit(0).cast(COUNTER)
    gaps = F.map_values(F.map_zip_with(vector(ours), vector(theirs), lambda k, x, y: F.coalesce(x, zero) - F.coalesce(y, zero)))
    ahead, behind = F.exists(gaps, lambda g: g > 0), F.exists(gaps, lambda g: g < 0)
    return (
        F.when(ahead & behind, F.lit(CONCURRENT)).when(ahead, F.lit(OURS)).when(behind, F.lit(THEIRS)).otherwise(F.lit(EQUAL))
    )


def has(v: Column, device: Column) -> Column:
    """Whether a vector has a counter other than 0 for a device."""
    return F.coalesce(F.try_element_at(v, device) != 0, F.lit(False))


def only_of(v: Column, device: Column) -> Column:
    """Whether a vector isn't empty and no other device has a counter in it."""
    return (F.size(vector(v)) > 0) & ~F.exists(F.map_keys(vector(v)), lambda k: k != device)


def bump(previous: Column, device: Column, value: Column, max_counters: int = MAX_COUNTERS) -> Column:
    """``previous`` with the device's counter raised to max(value, counter + 1).

    A vector that is full and lacks the device stays as it is.
    """
    old, value = vector(previous), value.cast(COUNTER)
    counter = F.try_element_at(old, device)
    # One more than a full counter doesn't fit: it wraps to 0, as unsigned numbers do.
    up = F.when(counter == F.lit("18446744073709551615").cast(COUNTER), F.lit(0).cast(COUNTER)).otherwise((counter + 1).cast(COUNTER))
    new = F.greatest(value, F.coalesce(up, value)).cast(COUNTER)
    others = F.map_filter(old, lambda k, v: k != device)
    full = counter.isNull() & (F.size(old) >= max_counters)
    return F.when(full, old).otherwise(F.map_concat(others, F.create_map(device, new)))


def stamp(now: Column, modified_s: Column) -> Column:
    """The value for a new counter: the later of now and the file's time."""
    return F.greatest(now, modified_s)
