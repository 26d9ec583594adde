"""Runs of repeated words: maximal periodic stretches, found in linear time on an ordered alphabet.

A run of smallest period p is marked by its Lyndon roots: under one of the two
orders of the alphabet, the longest Lyndon word that starts at a root's place
is the root itself, so the next smaller suffix stands p words further.  One
pass from left to right finds all next smaller suffixes with a chain of
previous smaller ones.  It needs the common extension of two suffixes each time,
and gets most of them from extensions that were matched before: by the last
match that reached furthest (what lies inside it repeats what stood a shift
earlier), and by the two neighbours in the chain (of two different extensions
the smaller one is the third).  Only what lies beyond the furthest match is
compared word by word, so each word is matched a constant number of times.
There is no suffix array or tree, and no fingerprint.

Only words that occur often enough in a text can lie in a run of it, so the
text is cut at the others first; no run extends over such a word.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh_name, map_texts

#: A run's length is at least so many periods, and at least so many words.
TIMES, SHORTEST = 4, 6


def next_smaller(t: list[int], up: bool = True) -> tuple[list[int], list[int], int]:
    """For each suffix of ``t`` the next smaller one (``len(t)`` for none), their common extension, and how many words were compared.

    ``up``: whether smaller numbers are smaller.  A suffix that begins another is smaller than it.
    """
    n = len(t)
    after, far = [n] * n, [0] * n
    before, back = [-1] * n, [0] * n
    first = shift = reach = 0  # t[first:reach] repeats what stands ``shift`` earlier
    compared = 0
    for j in range(1, n):
        i, met, popped = j - 1, -1, -1
        while i >= 0:
            length = exact = 0
            if popped >= 0:
                own = back[popped]
                if own != met:
                    length, exact = (own if own < met else met), 1
                else:
                    length = met
            if not exact and j < reach and i >= first:
                x, y = i - shift, j - shift
                known = far[x] if after[x] == y else back[y] if before[y] == x else -1
                if known >= 0:
                    if j + known < reach:
                        length, exact = known, 1
                    elif reach - j > length:
                        length = reach - j
            if not exact:
                a, b = i + length, j + length
                while b < n and t[a] == t[b]:
                    a += 1
                    b += 1
                compared += b - j - length + 1
                length = b - j
                if b > reach:
                    first, shift, reach = j, j - i, b
            b = j + length
            if b < n and (t[i + length] < t[b]) == up:
                before[j], back[j] = i, length
                break
            after[i], far[i], met, popped = j, length, length, i
            i = before[i]
    return after, far, compared


def runs(t: list[int], times: int = TIMES, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``t`` of at least ``times`` periods and ``shortest`` numbers, by start, then period.

    A run has several roots; the first that has its whole extension ahead stands
    less than a period from the start, so the extension to the left is shorter than a period.
    """
    found = set()
    for up in (True, False):
        after, far, _ = next_smaller(t, up)
        roots: dict[tuple[int, int], int] = {}
        for i, length in enumerate(far):
            p = after[i] - i
            if length > (times - 2) * p:
                roots.setdefault((p, after[i] + length), i)
        for (p, end), start in roots.items():
            while start and t[start - 1] == t[start - 1 + p]:
                start -= 1
            if end - start >= max(shortest, times * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def word_runs(words: list[bytes], times: int = TIMES, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """The runs of a list of words.

    Each word of a run occurs ``times`` times in it at least, and so would the word that extends it.
    """
    often = [w for w, n in Counter(words).items() if n >= times]
    if not often:
        return []
    rank = {w: k for k, w in enumerate(often)}
    marks, found = bytes([w in rank for w in words]), []
    for m in re.finditer(b"\x01{%d,}" % shortest, marks):
        at, end = m.span()
        found += [(at + s, n, p) for s, n, p in runs([rank[w] for w in words[at:end]], times, shortest)]
    return found


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not found:
        return words
    kept, at = [], 0
    for begin, end in sorted((s + p, s + n) for s, n, p in found):
        if begin > at:
            kept += words[at:begin]
        at = max(at, end)
    return kept + words[at:]


def _check(times: int, shortest: int) -> None:
    if times < 2 or shortest < 1:
        raise ValueError("a run has two periods at least, and a word")


def find_runs(df: DataFrame, times: int = TIMES, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per run of a text: id, ``start`` (number of its first word), ``length``, ``period``, all in words.

    Words are what white space (ASCII) delimits.  The period is the smallest one.
    Null, empty or short text: no row.  Repeated rows: their runs as often.  Null
    ids: kept.  Empty table: no row.  Very long texts: linear in their words.
    Columns other than the two named are not read.
    """
    _check(times, shortest)
    out = [("start", "long"), ("length", "long"), ("period", "long")]
    return map_texts(df, lambda: lambda data: word_runs(data.split(), times, shortest), out, id_col, text_col)


def collapse_runs(df: DataFrame, times: int = TIMES, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: id, ``text`` with each run reduced to its first period and words joined by one space, ``n_runs``, ``n_dropped``.

    Null text: empty, no run.  Other cases as in :func:`find_runs`, a row for each row.
    """
    _check(times, shortest)

    def one(data: bytes) -> list[tuple]:
        words = data.split()
        found = word_runs(words, times, shortest)
        kept = collapsed(words, found)
        return [(b" ".join(kept).decode("utf-8", "replace"), len(found), len(words) - len(kept))]

    return map_texts(df, lambda: one, [("text", "string"), ("n_runs", "long"), ("n_dropped", "long")], id_col, text_col)


def repeated_tail(words: list[bytes], h: int) -> list[bytes]:
    """A tenth of all documents get a tail that repeats, by the checksum ``h`` of their ids: the rule that the query's contract gives."""
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def digest(words: list[bytes]) -> tuple:
    """What the query returns of a document's words."""
    found = word_runs(words)
    best = (None,) * 4
    if found:
        top = found[0]
        for s, n, p in found[1:]:
            # By exact exponent; of equal ones the first by start, then period, stands first already.
            if n * top[2] > top[1] * p:
                top = (s, n, p)
        best = (*top, 1000 * top[1] // top[2])
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
    return (len(found), *best, hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest())


def run_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The query's rows: per document ``n_runs``, the run of the greatest exponent, and digests of all runs and of the collapsed text.

    A tenth of the documents get a repeated tail by their id first
    (:func:`repeated_tail`); a null id gets none.  Other cases as in :func:`collapse_runs`.
    """
    raw = fresh_name(df, "__keyed")
    key = F.crc32(F.col(id_col).cast("string").cast("binary")).cast("string")
    keyed = df.select(id_col, F.concat(F.coalesce(key, F.lit("")), F.lit(":"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias(raw))

    def one(data: bytes) -> list[tuple]:
        key, _, body = data.partition(b":")
        words = body.split()
        return [digest(repeated_tail(words, int(key)) if key else words)]

    out = [("n_runs", "long"), ("start", "long"), ("length", "long"), ("period", "long"), ("exponent_milli", "long"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    return map_texts(keyed, lambda: one, out, id_col, raw)
