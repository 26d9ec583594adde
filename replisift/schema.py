"""The canonical schema of an index of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTER = "DECIMAL(20,0)"
VERSION = f"MAP<STRING,{COUNTER}>"
_COUNTER = T.DecimalType(20, 0)
INDEX = T.StructType(
    [
        T.StructField("folder", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.IntegerType()),
        T.StructField("size", T.LongType()),
        T.StructField("permissions", T.LongType()),
        T.StructField("modified_s", T.LongType()),
        T.StructField("modified_ns", T.IntegerType()),
        T.StructField("modified_by", _COUNTER),
        T.StructField("sequence", T.LongType()),
        T.StructField("block_size", T.IntegerType()),
        T.StructField("version", T.MapType(T.StringType(), _COUNTER)),
        T.StructField("content_hash", T.BinaryType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("invalid", T.BooleanType()),
        T.StructField("block_hashes", T.ArrayType(T.BinaryType())),
    ]
)
KEY = ["folder", "name"]

# File types, folder modes, actions and version relations.
FILE, DIRECTORY, SYMLINK = 0, 1, 4
SEND_RECEIVE, SEND_ONLY, RECEIVE_ONLY = 0, 1, 2
IGNORE, FETCH, DELETE, ADOPT, CONFLICT = "IGNORE", "FETCH", "DELETE", "ADOPT", "CONFLICT"
EQUAL, OURS, THEIRS, CONCURRENT = "EQUAL", "OURS", "THEIRS", "CONCURRENT"

#: What a record has where nothing is known of a field.
DEFAULTS = {
    "type": FILE, "size": 0, "permissions": 0, "modified_s": 0, "modified_ns": 0, "modified_by": 0, "sequence": 0,
    "block_size": 0, "content_hash": None, "deleted": False, "invalid": False,
}


def conform(df: DataFrame) -> DataFrame:
    """``df`` with exactly the columns of the index schema; missing ones get their defaults."""

    def one(f: T.StructField) -> Column:
        if f.name in df.columns:
            return F.col(f.name).cast(f.dataType).alias(f.name)
        if f.name == "version":
            return F.expr(f"cast(map() as {VERSION})").alias("version")
        if f.name == "block_hashes":
            return F.expr("cast(array() as array<binary>)").alias("block_hashes")
        return F.lit(DEFAULTS.get(f.name)).cast(f.dataType).alias(f.name)

    return df.select(*[one(f) for f in INDEX])
