"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes.  Each node has a failure link and the
number of pieces that following it pops, so one left-to-right pass gives the
number of pieces of the greedy longest-match segmentation without building a
piece.  The time is linear in the text, also where greedy matching backtracks.
"""

from __future__ import annotations

import base64
from collections import deque

from pyspark.sql import DataFrame

from ._common import held, map_texts

#: Pieces of text whose counts a worker remembers.
CACHE_SIZE = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class LongestMatch:
    """Counts pieces of the greedy longest-match segmentation of byte strings.

    Every single byte that occurs must be in the vocabulary; a byte that isn't
    counts as a piece of its own.
    """

    def __init__(self, vocab) -> None:
        self.goto: dict[int, int] = {}
        ends = [False]
        children: list[list[tuple[int, int]]] = [[]]
        for token in set(vocab) | {bytes([b]) for b in range(256)}:
            node = 0
            for b in token:
                nxt = self.goto.get(node << 8 | b)
                if nxt is None:
                    nxt = len(ends)
                    self.goto[node << 8 | b] = nxt
                    children[node].append((b, nxt))
                    ends.append(False)
                    children.append([])
                node = nxt
            ends[node] = node != 0
        self.fail, self.popped = [-1] * len(ends), [0] * len(ends)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for b, child in children[node]:
                queue.append(child)
                if ends[child]:
                    self.fail[child], self.popped[child] = 0, 1
                    continue
                back, pops = self.fail[node], self.popped[node]
                while back >= 0 and (back << 8 | b) not in self.goto:
                    pops += self.popped[back]
                    back = self.fail[back]
                if back >= 0:
                    self.fail[child], self.popped[child] = self.goto[back << 8 | b], pops

    def count(self, data: bytes) -> int:
        """The number of pieces of ``data``."""
        goto, fail, popped = self.goto, self.fail, self.popped
        node = total = 0
        for b in data:
            nxt = goto.get(node << 8 | b)
            while nxt is None:
                total += popped[node]
                node = fail[node]
                nxt = goto.get(node << 8 | b)
            node = nxt
        while node > 0:
            total += popped[node]
            node = fail[node]
        return total


class _Counts(dict):
    """Counts by piece of text in two generations: when the young one is full it becomes the old one, and what is asked for again moves back."""

    def __init__(self, automaton: LongestMatch, most: int = CACHE_SIZE) -> None:
        super().__init__()
        self.automaton, self.most = automaton, most
        self.old: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            n = self.automaton.count(piece.encode())
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = n
        return n


def counter(vocab_path: str) -> _Counts:
    """The worker's counts for a vocabulary file."""
    loaded = held("token_counts")
    if vocab_path not in loaded:
        loaded[vocab_path] = _Counts(LongestMatch(load_ranks(vocab_path)))
    return loaded[vocab_path]


def token_counts(df: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_pieces`` (matches of ``pattern``), ``n_tokens`` and ``n_bytes``.

    ``n_tokens`` sums, over the matches of ``pattern``, the length of the greedy
    longest-match segmentation by the byte vocabulary in ``vocab_path``.

    Null or empty text: zeros.  Repeated rows and null ids: a row each.  Empty
    table: no row.  Columns other than the two named are not read.  Invalid
    UTF-8 counts as U+FFFD.
    """

    def make():
        import regex

        counts, find = counter(vocab_path), regex.compile(pattern).findall

        def one(data: bytes) -> list[tuple]:
            pieces = find(data.decode("utf-8", "replace"))
            return [(len(pieces), sum(map(counts.__getitem__, pieces)), len(data))]

        return one

    return map_texts(df, make, [("n_pieces", "long"), ("n_tokens", "long"), ("n_bytes", "long")], id_col, text_col)
