"""N-gram Jaccard self-join by PartEnum signatures, exact.

A document's set holds the hashes of its distinct word n-grams.  Sizes fall into
bands.  Two sets that are similar enough, the smaller with size in [l, r], differ
in at most k = r (1 - g) / g elements, g being the similarity.  The feature domain
is dealt into parts, and a signature is the hash of a set's content of a subset of
them.  A set emits the signatures of its own band, and of a lower band where
partners may be found.

* Bands with k up to ``SMALL_K``: k + 2 parts, all pairs of them.  At most k parts
  hold a difference, so similar sets agree on a pair.
* Larger k: k + 1 + s parts, each alone (two-level enumeration would make more
  signatures, not fewer).  The sets agree on at least s + 1 parts; since so many
  agree, each set may leave out the s signatures that come last in any order
  common to all: by the number of elements of a part's content, most first, so
  what goes is the least selective.
* The hash of nothing is no signature, or unrelated short sets would share it.
  A set with such a signature emits, in place of it, its prefix: the n - ceil(g n)
  + 1 smallest of its n elements.  Similar sets that agree on empty content alone
  both have it there, so both emit their prefixes, and these meet.

From signatures to links, without ever forming all pairs of a group:

1. ``digest``: one pass over the texts gives sizes, a 128-bit key of the set and
   the signatures (only once a task for equal sets).  Written to the shared folder.
2. Of each group that shares a signature, the smallest id is the hub, and members
   belong to that hub's family.  Every pair that shares a signature lies in one
   family.  Signatures with very many rows are reduced before they are shuffled.
   A large family that mostly lies in another becomes part of that.
3. Families are dealt into blocks, bounded by members and by elements.  A block
   gets its texts and its hub's, and is compared exactly on its own: first all
   with the hub, then only those that aren't connected yet.  A family of copies
   of its hub thus costs one comparison a member.
4. In a family of several blocks some members may not be connected with the hub
   within their block.  If meeting all other blocks takes them at most ``STREAMED``
   meetings for each member of the family, they stream past these.  Otherwise members
   emit their prefixes by an order of the family, in which the hub's elements
   come last (what a family shares without linking, such as a passage that all
   quote, is in the hub).  These prefixes are signatures for step 2 again, without
   the hub; unrelated members part there.  After ``LEVELS`` levels all stream.
5. Links (a spanning forest from each block) and equal sets give components by
   alternating large-star and small-star steps, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Scratch, fresh_name, held, release, ship, text_bytes

#: s as a share of k + 1, the ratio of a band's ends, the largest k for which pairs of parts are enumerated.
SPARE, BAND_RATIO, SMALL_K = 0.4, 1.5, 3
#: Members and set elements of a block, levels of prefixes, and meetings a member of a family that streams.
BLOCK, BLOCK_ELEMENTS, LEVELS, STREAMED = 256, 2_000_000, 3, 8
#: A signature counts as very frequent by so many rows in a sample of one in ``SAMPLED``; at most ``HOT`` are treated apart.
SAMPLED, FREQUENT, HOT = 128, 32, 1000
#: Groups that rows of one key are dealt into where they meet what is known of it, and blocks whose hub's text travels in one row.
SALT, HUB_BLOCKS = 16, 64
#: Edges of which a task can hold all.
ONE_TASK = 1_000_000
#: Keys of sets that a task remembers so as not to repeat signatures.
SEEN = 200_000

_U = np.uint64
_P, _M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0xD6E8FEB86659FD93)
_P_INVERSE = _U(pow(int(_P), -1, 2**64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random number for each byte, the same for A-Z as for a-z.
_BYTE = _mix(np.arange(1, 257, dtype=_U) * _M3)
_BYTE[65:91] = _BYTE[97:123]
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        _POWERS[:] = [np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, base, _U)]), dtype=_U) for base in (_P, _P_INVERSE)]
    return _POWERS[0], _POWERS[1]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text's UTF-8 bytes, in order, A-Z as a-z."""
    raw = np.frombuffer(data, np.uint8)
    gap = _SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, _U)
    power, inverse = _powers(len(raw) + 1)
    sums = np.concatenate([[_U(0)], np.cumsum(_BYTE[raw] * power[: len(raw)], dtype=_U)])
    return _mix((sums[ends] - sums[starts]) * inverse[starts])


def shingle_set(data: bytes, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's n-grams of ``words`` words; of fewer words the whole sequence is one."""
    h = word_hashes(data)
    if not len(h):
        return h
    width = min(words, len(h))
    x = np.full(len(h) - width + 1, _U(width))
    for i in range(width):
        x = _mix(x * _P + h[i : len(h) - width + 1 + i])
    return np.unique(x)


def _bands() -> list[int]:
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, int(starts[-1] * BAND_RATIO)))
    return starts


_BAND_STARTS = np.array(_bands())


def _prefix(ordered: np.ndarray, percent: int) -> np.ndarray:
    """The elements, of a set in some order, of which similar sets in the same order share one."""
    n = len(ordered)
    return ordered[: n + 1 - -(-n * percent // 100)] if n else ordered


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of a set, for similarities of at least ``percent``; none for sets that only equal sets resemble."""
    n, out, empty = len(s), [], False
    if not n:
        return s
    lowest = -(-n * percent // 100)
    first, last = np.searchsorted(_BAND_STARTS, [lowest, n], "right") - 1
    for band in range(first, last + 1):
        k = int(_BAND_STARTS[band + 1] - 1) * (100 - percent) // percent
        if not k:
            continue
        parts = k + 2 if k <= SMALL_K else k + 1 + int(SPARE * (k + 1))
        part = ((s >> _U(32)) % _U(parts)).astype(np.int64)
        content, filled = np.zeros(parts, _U), np.bincount(part, minlength=parts)
        np.add.at(content, part, _mix(s ^ _M3))
        if k <= SMALL_K:
            x, y = np.triu_indices(parts, 1)
            content, filled, tag = content[x] + _mix(content[y] + _M3), filled[x] + filled[y], x * parts + y
        else:
            tag = np.argsort(-filled, kind="stable")[: k + 1]
            content, filled = content[tag], filled[tag]
        some = filled > 0
        empty |= not some.all()
        tag = tag.astype(_U) + _U((band << 40) & (2**64 - 1))
        out.append(_mix(content + _mix(tag * _P))[some])
    if empty:
        out.append(_mix(_prefix(s, percent) * _M2))
    return np.concatenate(out) if out else np.zeros(0, _U)


def similar(common, a, b, percent: int):
    """Whether sets of sizes a and b with so many common elements are similar enough, in whole numbers."""
    return (100 * common >= percent * (a + b - common)) & (common > 0)


def digest(df: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, key, sigs) of every row."""
    import hashlib

    ship(df.sparkSession)
    schema = T.StructType(
        [T.StructField("id", df.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("sigs", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("ngram_join")
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, keys, sigs, known = [], [], [], part.column(0).is_valid().to_pylist()
                for text, has_id in zip(part.column(1), known, strict=True):
                    s = shingle_set(text.as_py(), words)
                    key = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                    if key is None or key in seen or not has_id:
                        sig = np.zeros(0, np.int64)
                    else:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        sig = signatures(s, percent).view(np.int64)
                    sizes.append(len(s))
                    keys.append(key)
                    sigs.append(sig)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists], schema.names)
        release()

    return df.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")).mapInArrow(run, schema)


def _families(rows: DataFrame) -> DataFrame:
    """(hub, id): every id of ``rows`` (sig, id) that shares a signature with a smaller id, by that id, once.

    With a column ``apart``, ids that are apart come before others, and a signature that none of them has counts for nothing.
    """
    id_type = rows.schema["id"].dataType
    marked = "apart" in rows.columns
    schema = T.StructType([T.StructField("hub", id_type), T.StructField("id", id_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub, tells = None, None, True  # signature and hub of the group that goes on, and whether it counts
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, ids = batch.column(0).to_numpy(), batch.column(1)
            new = np.concatenate([[last is None or sig[0] != last], sig[1:] != sig[:-1]])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
            goes_on = lead < 0
            hubs = ids.take(pa.array(np.where(goes_on, 0, lead)))
            if goes_on.any():
                n = int(goes_on.sum())
                hubs = pa.concat_arrays([pa.concat_arrays([hub] * n), hubs.slice(n)])
            member = ~new
            if marked:
                counts = np.where(goes_on, tells, batch.column(2).to_numpy(zero_copy_only=False)[lead])
                member, tells = member & counts, counts[-1]
            member = pa.array(member)
            yield pa.RecordBatch.from_arrays([hubs.filter(member), ids.filter(member)], schema.names)
            last, hub = sig[-1], hubs.slice(len(sig) - 1, 1)
        release()

    # Where a signature's rows go depends on the sample; what comes out doesn't.  At most HOT signatures are collected.
    sampled = rows.where(F.pmod(F.xxhash64("id", "sig"), F.lit(SAMPLED)) == 0).groupBy("sig").agg(F.count("*").alias("k"))
    hot = [r.sig for r in sampled.where(F.col("k") >= FREQUENT).orderBy(F.col("k").desc(), "sig").limit(HOT).collect()]
    found = None
    if hot:
        few = F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in hot], "sig long"))
        crowd = rows.join(few, "sig")
        if marked:
            crowd = crowd.join(F.broadcast(crowd.groupBy("sig").agg(F.bool_or("apart").alias("tells")).where("tells")), "sig")
            least = F.coalesce(F.min(F.when(F.col("apart"), F.col("id"))), F.min("id"))
        else:
            least = F.min("id")
        hubs = crowd.groupBy("sig").agg(least.alias("hub"))  # combined before the shuffle, at most HOT rows
        found = crowd.join(F.broadcast(hubs), "sig").select("hub", "id")
        rows = rows.join(few, "sig", "left_anti")
    columns, order = (["sig", "id", "apart"], ["sig", F.desc("apart"), "id"]) if marked else (["sig", "id"], ["sig", "id"])
    dealt = rows.select(*columns).repartition("sig").sortWithinPartitions(*order).mapInArrow(run, schema)
    return (dealt.unionByName(found) if found is not None else dealt).where("hub != id").distinct()


def _sizes(families: DataFrame, weight: DataFrame, block: int) -> DataFrame:
    """(hub, many): the blocks of families of more than one."""
    many = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_ELEMENTS))
    return families.join(weight, "id").groupBy("hub").agg(many.alias("many")).where("many > 1")


def _merged(families: DataFrame, weight: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """``families``, in which each large family that mostly lies in another large one is part of that.

    Near copies of one text share many signatures by chance, so most of what
    shares a rare one also lies in that text's family, where all its pairs are
    looked at anyway.  A root is a large family whose hub is in no other.  A family
    joins the first root that has its hub and at least half of its members: all
    pairs of both still lie in one family, and no more rows are left than before.
    """
    large = scratch.write(_salted(families, _sizes(families, weight, block), "hub", "inner").select("hub", "id"), "large")
    hubs = large.select("hub").distinct()
    inside = large.select(F.col("hub").alias("into"), F.col("id").alias("hub")).join(hubs, "hub", "left_semi")
    inside = scratch.write(inside, "inside")
    if inside.isEmpty():
        scratch.drop(large, inside)
        return families
    held_hubs = inside.select(F.col("hub").alias("into")).distinct()
    roots = inside.join(held_hubs, "into", "left_anti").groupBy("hub").agg(F.min("into").alias("into"))
    there = large.select(F.col("hub").alias("into"), "id", F.lit(True).alias("there"))
    moved = scratch.write(_salted(large, roots, "hub", "inner").where("id != into").join(there, ["into", "id"], "left").select("hub", "id", "into", "there"), "moved")
    joins = moved.groupBy("hub").agg((2 * F.count("there") >= F.count("*")).alias("joins")).where("joins")
    joins = scratch.write(joins, "joins")
    stay = _salted(families, joins, "hub", "left").where("joins IS NULL").select("hub", "id")
    come = _salted(moved.where("there IS NULL"), joins, "hub", "inner").select(F.col("into").alias("hub"), "id").distinct()
    out = scratch.write(stay.unionByName(come), "families")
    scratch.drop(families, large, inside, moved, joins)
    return out


class _Index:
    """Common elements of a set with each of a block's sets."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        rows = np.repeat(np.arange(len(sets)), self.sizes)
        elements = np.concatenate(sets)
        order = np.argsort(elements, kind="stable")
        self.elements, self.rows = elements[order], rows[order]

    def common(self, s: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.elements, s, "left"), np.searchsorted(self.elements, s, "right")
        n = hi - lo
        places = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.rows[places], minlength=len(self.sizes))


class _Forest:
    """Union-find; ``join`` says whether it connected anything."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[b] = a
        return a != b


def _compare_block(hub, members: list, words: int, percent: int) -> list[tuple]:
    """A spanning forest of the links among a hub and a block's members, as (a, b, False), and (hub, id, True) of members apart from the hub.

    The hub is (id, text), members (id, large, text); only members of a large family are reported as apart.
    """
    sets = [shingle_set(x[-1], words) for x in (hub, *members)]
    ids = [x[0] for x in (hub, *members)]
    index, forest, out = _Index(sets), _Forest(), []

    def probe(k: int) -> None:
        ok = similar(index.common(sets[k]), len(sets[k]), index.sizes, percent)
        for j in np.flatnonzero(ok).tolist():
            if forest.join(k, j):
                out.append((ids[k], ids[j], False))

    probe(0)
    for k in range(1, len(sets)):
        if forest.find(k) != forest.find(0):
            probe(k)
    out += [(hub[0], x[0], True) for k, x in enumerate(members, 1) if x[1] and forest.find(k) != forest.find(0)]
    return out


def _block_links(dealt: DataFrame, words: int, percent: int, id_type: T.DataType, streaming: bool) -> DataFrame:
    """Links (a, b) of blocks, and with ``apart`` (hub, id).  ``dealt``: (hub, block, role, id, comp, text) sorted.

    Roles: 0 the hub, 1 a member, 2 a member of another block.  ``comp``: what a member is known to be connected with,
    or, where blocks are compared on their own, not null in a large family.
    """
    schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("apart", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, hub, members, index, forest = None, None, [], None, None

        def close() -> list[tuple]:
            return _compare_block(hub, members, words, percent) if hub and members and not streaming else []

        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(k) for k in range(6)]
            for k in range(batch.num_rows):
                now = (cols[0][k].as_py(), cols[1][k].as_py())
                if now != unit:
                    out += close()
                    unit, hub, members, index, forest = now, None, [], None, _Forest()
                role, one, comp = cols[2][k].as_py(), cols[3][k].as_py(), cols[4][k].as_py()
                if role == 0:
                    hub = (one, cols[5][k].as_py())
                elif role == 1 and not streaming:
                    members.append((one, comp is not None, cols[5][k].as_py()))
                elif role == 1:
                    members.append((one, comp, shingle_set(cols[5][k].as_py(), words)))
                elif members:
                    if index is None:
                        index = _Index([m[2] for m in members])
                    s = shingle_set(cols[5][k].as_py(), words)
                    for j in np.flatnonzero(similar(index.common(s), len(s), index.sizes, percent)).tolist():
                        if forest.join(comp, members[j][1]):
                            out.append((one, members[j][0], False))
            if out:
                yield _rows(out, schema)
        if out := close():
            yield _rows(out, schema)
        release()

    return dealt.select("hub", "block", "role", "id", "comp", "text").mapInArrow(run, schema)


def _next_signatures(dealt: DataFrame, words: int, percent: int, id_type: T.DataType) -> DataFrame:
    """(sig, id, apart) from blocks in which ``comp`` is set for members that are apart from their hub."""
    schema = T.StructType([T.StructField("hub", id_type), T.StructField("token", T.LongType()), T.StructField("id", id_type), T.StructField("apart", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_set = np.zeros(0, _U)
        for batch in batches:
            cols = [batch.column(k) for k in range(6)]
            owner, tokens = [], []
            for k in range(batch.num_rows):
                s = shingle_set(cols[5][k].as_py(), words)
                if cols[2][k].as_py() == 0:
                    hub_set = s
                    continue
                shared = np.isin(s, hub_set, assume_unique=True)
                got = _prefix(np.concatenate([s[~shared], s[shared]]), percent)
                owner.append(np.full(len(got), k))
                tokens.append(got)
            if owner:
                at = pa.array(np.concatenate(owner))
                yield pa.RecordBatch.from_arrays([cols[0].take(at), pa.array(np.concatenate(tokens).view(np.int64)), cols[3].take(at), cols[4].take(at).is_valid()], schema.names)
        release()

    rows = dealt.select("hub", "block", "role", "id", "comp", "text").mapInArrow(run, schema)
    return rows.select(F.xxhash64("hub", "token").alias("sig"), "id", "apart")


def _rows(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(to_arrow_schema(schema))], schema.names)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of ``edges`` (a, b) reaches.

    Alternating large-star and small-star steps until nothing changes; each
    result is written, so lineage stays short and no step is done twice.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    scratch = Scratch(edges.sparkSession, "components")
    current, before = scratch.write(ordered, "edges"), None
    while True:
        state = tuple(current.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
        if state == before or not state[0]:
            break
        before = state
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        met = _meet(both.where("b > a"), least, 2 * state[0])
        large = scratch.write(met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "edges")
        scratch.drop(current)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _meet(large, low, state[0]).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = scratch.write(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "edges")
        scratch.drop(large)
    return current.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))


def _meet(rows: DataFrame, facts: DataFrame, total: int) -> DataFrame:
    """``rows`` (a, b) with the one fact of ``a``; each ``a`` with more than a thousandth of many rows is dealt to ``SALT`` tasks.

    Fewer than a thousand are so frequent, and only these are collected.  Up to ``ONE_TASK`` rows in all suit any task.
    """
    if total <= ONE_TASK:
        return rows.join(facts, "a")
    hot = [r.a for r in rows.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > total // 1000).select("a").collect()]
    if not hot:
        return rows.join(facts, "a")
    few = F.broadcast(rows.sparkSession.createDataFrame([(x, True) for x in hot], T.StructType([T.StructField("a", rows.schema["a"].dataType), T.StructField("hot", T.BooleanType())])))
    salted = rows.join(few, "a", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int")).otherwise(0)).drop("hot")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(facts.join(few, "a", "left").withColumn("salt", F.explode(copies)).drop("hot"), ["a", "salt"])


def _grouped(units: DataFrame) -> DataFrame:
    """(id, group, in): the (hub, block, role, id, comp) units of each id, a hub's in rows of at most ``HUB_BLOCKS`` blocks."""
    group = F.when(F.col("role") == 1, F.lit(0)).otherwise(F.floor(F.col("block") / HUB_BLOCKS))
    return units.groupBy("id", group.alias("group")).agg(F.collect_set(F.struct("hub", "block", "role", "comp")).alias("in"))


def _spread(rows: DataFrame) -> DataFrame:
    """Texts with what ``_grouped`` tells of them, block by block and in order."""
    rows = rows.select("id", "text", F.explode("in").alias("u")).select("u.*", "id", "text")
    return rows.repartition("hub", "block").sortWithinPartitions("hub", "block", "role", "id")


def _deal(texts: DataFrame, units: DataFrame) -> DataFrame:
    """The texts of units, together and in order.  A text travels once for all units of its id, but a hub's once a group of blocks."""
    return _spread(texts.join(_grouped(units), "id"))


def _salted(rows: DataFrame, facts: DataFrame, key: str, how: str) -> DataFrame:
    """A join of rows (with ``id``) to one fact a key, in which a key with very many rows goes to ``SALT`` tasks."""
    copies = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALT))).join(copies, [key, "salt"], how).drop("salt")


def similar_documents(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row: id, ``n_shingles`` and ``component_id``, the smallest id that links reach.

    Documents link when the Jaccard similarity of their sets of distinct word
    n-grams is at least ``percent`` per cent, computed in whole numbers.  Words
    are runs of bytes other than space and 0x09-0x0D, A-Z in lower case.  No
    link between different sets is lost; sets are of 64-bit hashes.

    Null, empty or wordless text: an empty set, linked with nothing.  A text of
    fewer words than ``words``: its sequence is its one n-gram.  Repeated rows:
    a row each; rows that share an id are one document, with the links of all.
    A null id links by equal sets alone and is in no one's component (null where
    no equal set has an id).  Empty table: no row.  Other columns aren't read.
    """
    scratch = Scratch(df.sparkSession, "ngram_join")
    table = scratch.write(digest(df, words, percent, id_col, text_col), "digests")
    links, texts = _links(df, table, scratch, words, percent, id_col, text_col, block)

    # Equal sets: of each key with several rows, the smallest id.  The others' links are that id's.
    equal = table.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    copies = _salted(table.select("id", "key"), equal, "key", "inner").where("id != least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    # Copies matter to components only where one of them has links of its own, or another text under its id.
    twofold = table.where("key IS NOT NULL").groupBy("id").agg((F.min("key") != F.max("key")).alias("two")).where("two").select("id")
    linked = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).unionByName(twofold).distinct()
    known = components(links.unionByName(copies.join(linked, F.col("a") == F.col("id"), "left_semi")))
    scratch.drop(*texts)
    # A group of equal sets learns its component by its smallest id, before it is spread to the group's rows.
    groups = equal.join(known.withColumnRenamed("id", "least"), "least", "left").select("key", F.coalesce("component", "least").alias("of_group"))
    rows = _salted(table.select("id", "n", "key"), groups, "key", "left").join(known, "id", "left")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("of_group", "component", "id").alias("component_id"))


def _links(df: DataFrame, table: DataFrame, scratch: Scratch, words: int, percent: int, id_col: str, text_col: str, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) that connect all documents that links connect, equal sets apart, and the tables to drop at last."""
    id_type = table.schema["id"].dataType
    weight = table.groupBy("id").agg(F.max("n").alias("n"))
    rows = table.select(F.explode("sigs").alias("sig"), "id")
    texts, links, done, spent = None, None, [], []
    for level in range(LEVELS + 1):
        families = scratch.write(_families(rows), "families")
        scratch.drop(*spent)
        families = _merged(families, weight, block, scratch)
        dealt = _salted(families, _sizes(families, weight, block), "hub", "left").select("hub", "id", F.coalesce("many", F.lit(1).cast("long")).alias("blocks"))
        dealt = scratch.write(dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))), "blocks")
        scratch.drop(families)
        spent = [dealt]
        members = dealt.select("hub", "block", F.lit(1).alias("role"), "id", F.when(F.col("blocks") > 1, F.col("hub")).alias("comp"))
        hubs = dealt.select("hub", "block", F.lit(0).alias("role"), F.col("hub").alias("id"), F.lit(None).cast(id_type).alias("comp")).distinct()
        units = members.unionByName(hubs)
        if texts is None:
            # All texts are shuffled once, to where the first level's units are.  Either side may be of any size, so neither is broadcast.
            one = _grouped(units).withColumn("lead", F.col("group") == F.min("group").over(Window.partitionBy("id")))
            first = scratch.write(df.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")).join(one.hint("merge"), "id"), "texts")
            done.append(first)
            texts, blocks = first.where("lead").select("id", "text"), _spread(first)
        else:
            blocks = _deal(texts, units)
        new = scratch.write(_block_links(blocks, words, percent, id_type, False), "links")
        done.append(new)
        found = new.where("NOT apart").select("a", "b")
        links = links.unionByName(found) if links is not None else found

        # Who is apart from the hub, family by family: a few meet the other blocks, many go to the next level.
        apart = new.where("apart").groupBy(F.col("a").alias("hub")).agg(F.count("*").alias("k"))
        large = dealt.where("blocks > 1")
        apart = apart.join(large.groupBy("hub").agg(F.count("*").alias("m"), F.max("blocks").alias("many")), "hub")
        apart = scratch.write(apart.select("hub", ((F.col("k") * F.col("many") <= STREAMED * F.col("m")) | F.lit(level == LEVELS)).alias("few")), "apart")
        spent.append(apart)
        has_few, has_many = apart.agg(F.coalesce(F.bool_or("few"), F.lit(False)), F.coalesce(F.bool_or(~F.col("few")), F.lit(False))).first()
        if not has_few and not has_many:
            break
        marks = new.where("apart").select(F.col("a").alias("hub"), F.col("b").alias("id"), F.lit(True).alias("apart"))
        labelled = _salted(large, apart, "hub", "inner").join(marks, ["hub", "id"], "left")
        labelled = scratch.write(labelled, "labelled")
        spent.append(labelled)
        if has_few:
            few = labelled.where("few").withColumn("comp", F.when(F.col("apart"), F.col("id")).otherwise(F.col("hub")))
            probes = few.where("apart").select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("to"), "block", "id", "comp").where("to != block")
            units = few.select("hub", "block", F.lit(1).alias("role"), "id", "comp").unionByName(probes.select("hub", F.col("to").alias("block"), F.lit(2).alias("role"), "id", "comp"))
            more = scratch.write(_block_links(_deal(texts, units), words, percent, id_type, True), "links")
            links = links.unionByName(more.select("a", "b"))
            done.append(more)
        if not has_many:
            break
        crowd = labelled.where("NOT few")
        units = crowd.select("hub", "block", F.lit(1).alias("role"), "id", F.when(F.col("apart"), F.col("id")).alias("comp"))
        units = units.unionByName(hubs.join(apart.where("NOT few"), "hub", "left_semi"))
        tokens = scratch.write(_next_signatures(_deal(texts, units), words, percent, id_type), "tokens")
        spent.append(tokens)
        # Only what a member that is apart has can tell anything new.
        rows = tokens
    scratch.drop(*spent)
    return links, done


def one_of_each(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", by_text: bool = False) -> DataFrame:
    """The rows of ``df``, with its columns, one of each component: that with the smallest id.

    Of repeated rows with one id, one stays: the one with the longest text, of
    equally long ones that with the largest.  With ``by_text``, rows of one id
    with different texts are documents of their own, and only rows equal in id
    and text count as repeated.  Rows with a null id stay.  Other edge cases as
    in :func:`similar_documents`.
    """
    own, text = F.col(f"`{id_col}`"), text_bytes(text_col)
    seen = df.where(own.isNotNull()).groupBy(own.alias("id")).agg(F.count("*").alias("n"), F.min(F.xxhash64(text)).alias("low"), F.max(F.xxhash64(text)).alias("high"))
    repeated, twofold = seen.agg(F.coalesce(F.max("n") > 1, F.lit(False)), F.coalesce(F.bool_or(F.col("low") != F.col("high")), F.lit(False))).first()
    if by_text and twofold:
        # An id that sorts as the given one does, then the text's digest.
        whole = isinstance(df.schema[id_col].dataType, T.IntegralType)
        front = F.unhex(F.lpad(F.hex(own.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")) if whole else F.concat(own.cast("string").cast("binary"), F.lit(b"\0"))
        key = fresh_name(df, "row_key")
        keyed = df.withColumn(key, F.concat(front, F.unhex(F.md5(text))))
        return one_of_each(keyed, words, percent, key, text_col).drop(key)
    found = similar_documents(df, words, percent, id_col, text_col)
    mark = fresh_name(df, "kept_id")
    keep = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(mark)).distinct()
    rows = df.join(keep, own == F.col(mark), "left_semi")
    if twofold:
        last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(F.length(text), text)).alias("r")
        rows = rows.groupBy(own.alias("id")).agg(last).select("r.*")
    elif repeated:
        rows = rows.dropDuplicates([id_col])
    return rows.unionByName(df.where(own.isNull()))
