"""Rows of the index schema, briefly."""

from decimal import Decimal

from replisift.schema import INDEX

BASE = {
    "folder": "f", "name": "a", "type": 0, "size": 10, "permissions": 420, "modified_s": 100, "modified_ns": 0, "modified_by": Decimal(0), "sequence": 1,
    "block_size": 131072, "version": {}, "content_hash": b"\x01" * 32, "deleted": False, "invalid": False, "block_hashes": [b"\x01" * 32],
}


def record(**own):
    r = {**BASE, **own}
    r["version"] = {k: Decimal(v) for k, v in r["version"].items()}
    if own.get("deleted"):
        r |= {"content_hash": None, "block_hashes": []}
    return tuple(r[f.name] for f in INDEX)


def index(spark, *rows):
    return spark.createDataFrame([record(**r) for r in rows], INDEX)


def value(spark, column):
    """The value of an expression of constants."""
    return spark.range(1).select(column.alias("v")).first().v
