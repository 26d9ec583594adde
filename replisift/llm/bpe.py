"""Byte-level BPE by tree reduction.

A text is halved down to leaves, leaves are encoded, and neighbours are joined
by encoding a window around their border anew.  The window grows until both its
ends lie at *safe cuts*.  A safe cut is a place where no match of the pattern
can span, whatever stands on either side, and where matching begins afresh:

* between a visible ASCII character and ASCII white space, and
* between ASCII letters, digits and other visible ASCII characters, save from
  other characters to letters (a contraction such as ``'s`` spans that).

No alternative of the pattern continues over such a place, none looks behind,
and the only look-ahead is within white space, so the tokens on either side
don't depend on each other: those outside the window are final.  Where a window
finds no safe cut it grows to the whole node, whose ends are cuts by definition.
Decoding concatenates bytes up the same kind of tree.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from ._common import held, map_texts, ship
from .token_counts import load_ranks

#: Characters of a leaf, ids of a leaf in decoding, and of the first window on each side.
LEAF_CHARS, LEAF_IDS, FIRST_WINDOW = 2048, 4096, 32

SAFE_CUT = re.compile(
    r"(?<=[!-~])(?=[\t-\r ])|(?<=[A-Za-z])(?=[!-@\[-`{-~])|(?<=[0-9])(?=[!-/:-~])|(?<=[!-/:-@\[-`{-~])(?=[0-9])"
)


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import tiktoken

        ranks = load_ranks(ranks_path)
        self._encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.token = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}

    def encode(self, text: str, leaf: int = LEAF_CHARS, window: int = FIRST_WINDOW) -> list[int]:
        """The ids of ``text``."""
        return self._node(text, 0, len(text), leaf, window)

    def _node(self, text: str, lo: int, hi: int, leaf: int, window: int) -> list[int]:
        if hi - lo <= leaf:
            return self._encode(text[lo:hi])
        mid = (lo + hi) // 2
        left, right = self._node(text, lo, mid, leaf, window), self._node(text, mid, hi, leaf, window)
        return self._join(text, lo, mid, hi, left, right, window)

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int], window: int) -> list[int]:
        start, end, reach = None, None, window
        while start is None or end is None:
            if start is None:
                at = max(lo, mid - reach)
                cuts = [m.start() for m in SAFE_CUT.finditer(text, at, min(hi, mid + 1)) if at < m.start() <= mid]
                start = cuts[-1] if cuts else lo if at == lo else None
            if end is None:
                at = min(hi, mid + reach)
                cut = next((m.start() for m in SAFE_CUT.finditer(text, mid, at) if mid <= m.start() < at), None)
                end = cut if cut is not None else hi if at == hi else None
            reach *= 2
        keep = self._count_back(left, len(text[start:mid].encode()))
        skip = self._count_on(right, len(text[mid:end].encode()))
        return left[:keep] + self._encode(text[start:end]) + right[skip:]

    def _count_back(self, ids: list[int], n: int) -> int:
        """The number of ids before the last ``n`` bytes; a cut is always between ids."""
        k = len(ids)
        while n > 0:
            k -= 1
            n -= self.size[ids[k]]
        return k

    def _count_on(self, ids: list[int], n: int) -> int:
        k = 0
        while n > 0:
            n -= self.size[ids[k]]
            k += 1
        return k

    def decode(self, ids: list[int], leaf: int = LEAF_IDS) -> bytes:
        """The bytes of ``ids``."""
        if len(ids) <= leaf:
            return b"".join(map(self.token.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid], leaf) + self.decode(ids[mid:], leaf)


def coder(ranks_path: str, pattern: str) -> ByteBpe:
    """The worker's coder for a rank file and pattern."""
    loaded, key = held("bpe"), (ranks_path, pattern)
    if key not in loaded:
        loaded[key] = ByteBpe(ranks_path, pattern)
    return loaded[key]


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``ids`` (array of int), the whole text's token ids.

    Each match of ``pattern`` is encoded separately and there are no special
    tokens.  Null or empty text: no ids.  Repeated rows and null ids: a row
    each.  Empty table: no row.  Columns other than the two named are not read.
    Invalid UTF-8 is read as U+FFFD.
    """

    def make():
        bpe = coder(ranks_path, pattern)
        return lambda data: [(bpe.encode(data.decode("utf-8", "replace")),)]

    return map_texts(df, make, [("ids", "array<int>")], id_col, text_col)


def bpe_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and ``decoded`` (binary).  Null or empty ids: no bytes.  An id that isn't in the vocabulary is an error."""
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    ship(df.sparkSession)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            decoded = [bpe.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], [id_col, "decoded"])

    return df.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("__ids")).mapInArrow(run, schema)


def bpe_digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, decodes its ids, and returns digests of both: the round trip without the ids' bulk.

    Per row: id, ``n_tokens``, ``ids_sha256`` (of little-endian unsigned 32-bit
    ids) and ``decoded_sha256``.  Edge cases as in :func:`bpe_encode`.
    """

    def make():
        bpe = coder(ranks_path, pattern)

        def one(data: bytes) -> list[tuple]:
            ids = bpe.encode(data.decode("utf-8", "replace"))
            packed = np.asarray(ids, "<u4").tobytes()
            return [(len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest())]

        return one

    return map_texts(df, make, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], id_col, text_col)
