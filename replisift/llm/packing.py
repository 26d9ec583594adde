"""Packing by power-of-two decomposition.

A document of n tokens becomes pieces whose lengths are powers of two: as many
of the largest length as fit, then the binary digits of the rest, longest first.
Every piece is a sequence of its own, so no sequence crosses documents and none
is padded; sequences of one length form a bucket, from which a trainer draws
batches of equal token counts (2048 / length sequences for each full one).
Each document is decomposed alone, so there is no shuffle at all.
"""

from __future__ import annotations

import zlib
from functools import cached_property
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held, map_texts

#: Words (delimited by white space) whose ids a worker remembers in each of two
#: generations, the share of that for pieces of words, and their longest size.
WORDS_HELD, PIECES_SHARE, CACHED_BYTES = 600_000, 2 / 3, 64

#: Fixed value: how the tokenizer's file splits normalised text, each match apart.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Below this character all text is in normal form C.
LATIN_END = "\u0250"


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies; the space stays, as a separator."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)} | {32: " "}


BYTE_CHARS = _byte_chars()


class Generations:
    """A bounded memory of two dictionaries: when the young one is full it becomes the old one, and what is asked for again moves back."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def keep(self, found: dict[bytes, bytes]) -> None:
        """Puts some keys and values, but for keys that are too long, and no more than a generation holds."""
        if len(found) and max(map(len, found)) > CACHED_BYTES:
            found = {k: v for k, v in found.items() if len(k) <= CACHED_BYTES}
        if len(self.young) + len(found) > self.size:
            self.old, self.young = self.young, {}
        self.young.update(found if len(found) <= self.size else islice(found.items(), self.size))


class WordIds:
    """Token ids of texts, as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never lets a token span it, so ids of a
    text are those of its words in order.  ASCII white space is split here.
    Words seen before come from a bounded memory; other words are split into
    the tokenizer's pieces, and only pieces that are new as well reach its
    model, all of a text's in one call.  Each piece ends in the one token with a
    word end, which tells the pieces' ids apart.  Words that aren't plain Latin
    text go through the whole tokenizer one by one.

    With ``special`` the tokenizer's special tokens that are written out in a
    text (such as an end mark) get their own ids, as the tokenizer does unless
    told otherwise; without it they are text.  Only a text that holds one goes
    through the whole tokenizer at once.
    """

    def __init__(self, tokenizer_path: str, words_held: int = WORDS_HELD, special: bool = False) -> None:
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        #: The model alone, for pieces that are normalised and split already.
        self.path, self.model = tokenizer_path, Tokenizer.from_file(tokenizer_path)
        self.model.encode_special_tokens = True
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.words, self.pieces = Generations(words_held), Generations(int(words_held * PIECES_SHARE))
        self.split = regex.compile(PIECE).findall
        vocab = self.model.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.special = [a.content.encode() for a in self.model.get_added_tokens_decoder().values() if a.special] if special else []

    @cached_property
    def tokenizer(self):
        """The whole tokenizer, loaded once it is needed."""
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path)
        whole.encode_special_tokens = True
        return whole

    def __call__(self, data: bytes) -> bytes:
        if any(x in data for x in self.special):
            self.tokenizer.encode_special_tokens = False
            ids = self._ids(self.tokenizer, data.decode("utf-8", "replace"))
            self.tokenizer.encode_special_tokens = True
            return np.asarray(ids, "<u4").tobytes()
        words = data.split()
        ids = list(map(self.words.young.get, words))
        if None in ids:
            places = [k for k, x in enumerate(ids) if x is None]
            new = list(dict.fromkeys([words[k] for k in places]))
            found = dict(zip(new, map(self.words.old.get, new), strict=True))
            ask = [w for w in new if found[w] is None]
            found |= zip(ask, self._encode(ask), strict=True)
            self.words.keep(found)
            for k in places:
                ids[k] = found[words[k]]
        return b"".join(ids)

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        # A word of plain letters is one piece, whatever the pattern does with others.
        split = [(w.lower(),) if w.isalpha() else self._plain(w) for w in words]
        pieces = list(dict.fromkeys([p for parts in split if parts for p in parts]))
        known = dict(zip(pieces, map(self.pieces.young.get, pieces), strict=True))
        ask = [p for p in pieces if known[p] is None]
        if ask:
            found = dict(zip(ask, map(self.pieces.old.get, ask), strict=True))
            ask = [p for p in ask if found[p] is None]
            if ask:
                joined = b" ".join(ask).decode("latin-1").translate(BYTE_CHARS)
                ids = np.asarray(self._ids(self.model, joined), "<u4")
                raw, at = ids.tobytes(), 0
                for p, end in zip(ask, (np.flatnonzero(self.ends[ids]) * 4 + 4).tolist(), strict=True):
                    found[p] = raw[at:end]
                    at = end
            self.pieces.keep(found)
            known |= found
        return [
            known[parts[0]] if parts is not None and len(parts) == 1
            else b"".join([known[p] for p in parts]) if parts is not None
            else np.asarray(self._ids(self.tokenizer, w.decode("utf-8", "replace")), "<u4").tobytes()
            for w, parts in zip(words, split, strict=True)
        ]

    def _plain(self, word: bytes) -> list[bytes] | None:
        """A word's pieces; None for what only the tokenizer itself can normalise and split."""
        text = word.decode("utf-8", "replace")
        if text.isascii() and text.isprintable() or text.isprintable() and max(text) < LATIN_END:
            return [p.encode() for p in self.split(text.lower())]
        return None

    @staticmethod
    def _ids(tokenizer, text: str) -> list[int]:
        return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


def word_ids(tokenizer_path: str, words_held: int = WORDS_HELD, special: bool = False) -> WordIds:
    """The worker's tokenizer for a file."""
    loaded, key = held("packing"), (tokenizer_path, words_held, special)
    if key not in loaded:
        loaded[key] = WordIds(tokenizer_path, words_held, special)
    return loaded[key]


def decompose(n: int, longest: int) -> list[int]:
    """Powers of two that sum to ``n``, none above ``longest`` (itself a power of two), longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def pack_documents(
    df: DataFrame,
    tokenizer_path: str,
    longest: int = 2048,
    end_id: int | None = 1,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_held: int = WORDS_HELD,
    special: bool = False,
) -> DataFrame:
    """Per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``bucket``, [``ids``], ``sequence_id``, ``offset``.

    A document's tokens are the ids of its whole text and then ``end_id`` (none
    if it is None).  A piece starts at token ``start`` of its document.  Each
    piece is a sequence: ``offset`` is 0, ``bucket`` is the length's logarithm
    to base 2, and no sequence is padded.  ``sequence_id`` is unique in the
    result; write the result before reading it twice, as rereading other files
    may number sequences otherwise.  ``ids_crc32`` is of little-endian unsigned
    32-bit ids.  ``words_held`` bounds what a worker remembers (about 350 bytes a
    word), and with it memory; fewer take more time.  ``special``: whether special
    tokens that a text writes out get their own ids (see :class:`WordIds`).

    Null or empty text: the end id alone, or no piece where that is None.
    Repeated rows and null ids: their own pieces.  Empty table: no row.  Columns
    other than the two named are not read.  Invalid UTF-8 is read as U+FFFD.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def make():
        ids_of = word_ids(tokenizer_path, words_held, special)
        tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

        def one(data: bytes) -> list[tuple]:
            ids = ids_of(data) + tail
            total, start, rows = len(ids) // 4, 0, []
            for n in decompose(total, longest):
                piece = ids[4 * start : 4 * (start + n)]
                row = (start, n, zlib.crc32(piece), total, n.bit_length() - 1)
                rows.append((*row, np.frombuffer(piece, "<u4").astype(np.int32)) if with_ids else row)
                start += n
            return rows

        return one

    out = [("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("bucket", "int")]
    pieces = map_texts(df, make, out + [("ids", "array<int>")] * with_ids, id_col, text_col)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_packed(packed: DataFrame, path: str) -> None:
    """Writes sequences as Parquet, one folder a bucket, so that a reader takes equal lengths together.

    Empty table: no folder of a bucket.  Repeated sequences are written as often as they occur; an existing path is an error.
    """
    packed.write.partitionBy("bucket").parquet(path)
