"""What a decision does to the state: whole scan passes, deletions, finished fetches, parked records, requests.

Each operator gives new records or a verdict for each row; :func:`commit` turns
new records into the next state, with sequences of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing, paths
from ..schema import CONFLICT, COUNTER, DELETE, FETCH, FILE, INDEX, KEY, RECEIVE_ONLY, SEND_RECEIVE, VERSION, conform
from ..session import materialized
from . import classify, scan
from .index import assign_sequence, forget, high_water, upsert

LARGEST_BLOCK = 1 << 20
#: Seconds without a block after which a transfer is abandoned, and the tries of a block.
STALL_S, RETRIES = 120, 3
NO_SUCH_FILE, SERVED = "NO_SUCH_FILE", "OK"


def commit(index: DataFrame, records: DataFrame, order: list[Column | str] | None = None) -> DataFrame:
    """``index`` with ``records`` in place of those of their keys, numbered on from their folder's highest sequence."""
    numbered = assign_sequence(conform(records), high_water(index), order or ["name"])
    return upsert(conform(index), numbered.withColumn("sequence", F.col("sequence").cast("long")))


def scan_changes(listing: DataFrame, index: DataFrame, ignored: Column, temp_suffix: str) -> DataFrame:
    """What a walk finds to be new, changed or missing, against the index, written once: a scan pass reads it several times.

    Records come without their block hashes.  What is unchanged isn't written, so this grows with the changes.
    """
    marked = index.withColumn("block_hashes", F.when(F.size("block_hashes") > 0, F.array(F.lit(b"").cast("binary"))))
    diffed = scan.diff(scan.walk(listing, ignored, temp_suffix), marked).where(F.col("change").isin("new", "changed", "missing"))
    return materialized(diffed.withColumn("record", F.col("record").dropFields("block_hashes")), "scan")


def scanned(changes: DataFrame, contents: DataFrame, ignored: Column, device: str, now_s: int, mode: int = SEND_RECEIVE, complete: bool = True, sheltered: DataFrame | None = None) -> DataFrame:
    """The new records of a scan pass: hashed files, directories, and what the sweep concludes; sequences come later.

    ``changes`` is of :func:`scan_changes`.  ``contents`` has (folder, name,
    content, status); only files that are new or changed are joined with it.
    ``status``: null for a file that was read, else ``vanished``, ``unreadable`` or
    ``too_big`` (see :func:`scan.hash_outcome`; a size beyond what a record's blocks
    can hold is that in any case); only a file whose content has the listed size
    is committed.  A file that vanished after it was listed isn't
    seen, so the sweep has its live record like that of a file that wasn't
    listed; one that can't be read, is too big or changed meanwhile keeps its
    record.  A mirror (receive-only) commits directories alone and deletes
    nothing; see :func:`scan_pass`.  An incomplete walk sweeps nothing, and no
    walk what it couldn't see (``sheltered`` keys, of :meth:`walk.Walk.sheltered`).
    """
    directories = conform(scan.commit_directories(changes, device, now_s))
    if mode == RECEIVE_ONLY:
        return directories
    dirty = changes.where(F.col("change").isin("new", "changed") & ~F.col("entry.is_dir"))
    read = dirty.join(contents.select(*KEY, "content", "status"), KEY)
    status = F.when(hashing.too_big(F.col("entry.size")), "too_big").otherwise(F.coalesce("status", F.lit("")))
    outcome = scan.hash_outcome(status, F.col("entry.size"), F.octet_length("content"))
    read = read.withColumn("outcome", outcome)
    good = read.where("outcome = 'commit'").select(*KEY, "entry.size", "entry.modified_s", F.col("record.version").alias("version"), "content")
    out = conform(scan.commit_files(good, device, now_s)).unionByName(directories)
    if not complete:
        return out
    vanished = read.where("outcome = 'swept' AND NOT record.deleted AND NOT record.invalid")
    missing = changes.where("change = 'missing'").select(*KEY, "record.*")
    if sheltered is not None:
        missing = missing.join(sheltered.select(*KEY), KEY, "left_anti")
    unseen = missing.unionByName(vanished.select(*KEY, "record.*"))
    # Nothing is numbered before the walk ends, so all sequences are below its start.
    swept = scan.judged_unseen(unseen, ignored, F.lit(2**63 - 1))
    return out.unionByName(conform(scan.swept_records(swept, device, now_s)))


def scan_pass(listing: DataFrame, index: DataFrame, contents: DataFrame, ignored: Column, device: str, now_s: int, temp_suffix: str, mode: int = SEND_RECEIVE, complete: bool = True, sheltered: DataFrame | None = None) -> DataFrame:
    """The index after a scan pass.

    New records (:func:`scanned`) are numbered by name.  A mirror forgets, rather
    than deletes, what is missing or was changed here, so that the next index
    brings it back; an incomplete walk forgets only what was changed.
    ``temp_suffix``: how the receiver's staged files end, which no walk sees.
    """
    changes = scan_changes(listing, index, ignored, temp_suffix)
    state = commit(index, scanned(changes, contents, ignored, device, now_s, mode, complete, sheltered))
    if mode != RECEIVE_ONLY:
        return state
    lost = scan.receive_only(changes).where(F.col("verdict").isin("forget", "unseen") if complete else F.col("verdict") == "forget")
    if sheltered is not None:
        lost = lost.join(sheltered.select(*KEY), KEY, "left_anti")
    return forget(state, lost)


def advanced(before: DataFrame, after: DataFrame) -> DataFrame:
    """The folders whose highest sequence a pass raised."""
    old = high_water(before).withColumnRenamed("high", "old")
    return high_water(after).join(old, "folder", "left").where(F.col("old").isNull() | (F.col("high") > F.col("old"))).select("folder")


def peer_tombstones(classified: DataFrame, undeleted: DataFrame | None = None) -> DataFrame:
    """Records of the peer's deletions that were applied, at the peer's version; what is still on disk (``undeleted`` keys) gets none and is tried again."""
    gone = classified.where(F.col("action") == DELETE)
    if undeleted is not None:
        gone = gone.join(undeleted.select(*KEY).distinct(), KEY, "left_anti")
    return gone.select(*KEY, "peer.*").withColumn("block_hashes", F.expr("cast(array() as array<binary>)"))


def fetch_outcome(status: Column) -> Column:
    """``done``, ``retry`` or ``drop`` for a fetch: a name that no disk takes won't get shorter, all other faults may pass."""
    return F.when(status == "ok", "done").when(status.isin("path", "rename"), "drop").otherwise("retry")


def finished(classified: DataFrame, fetched: DataFrame) -> DataFrame:
    """Records of fetches that were verified, at the peer's version with the peer's blocks.  ``fetched`` has keys and ``status``."""
    done = fetched.where(fetch_outcome(F.col("status")) == "done").select(*KEY).distinct()
    return classified.where(F.col("action").isin(FETCH, CONFLICT)).join(done, KEY, "left_semi").select(*KEY, "peer.*")


def reclassified(parked: DataFrame, have: DataFrame, gone: DataFrame, ignored: Column, mode: int = SEND_RECEIVE) -> DataFrame:
    """Parked records of a peer with ``verdict``, judged by our state when they are read back.

    ``hidden`` by a rule, ``gone`` if the peer deleted the name meanwhile,
    ``settled`` if there is nothing to fetch any more, else ``fetch`` or ``conflict``.
    """
    marks = gone.select(*KEY, F.lit(True).alias("__gone")).distinct()
    rows = classify.classify(have, parked, mode).join(marks, KEY, "left")
    verdict = F.when(ignored, "hidden").when(F.col("__gone"), "gone").when(F.col("action") == FETCH, "fetch").when(F.col("action") == CONFLICT, "conflict").otherwise("settled")
    return rows.withColumn("verdict", verdict).drop("__gone")


def deferred_deletes(deferred: DataFrame, have: DataFrame, wants: DataFrame, mode: int = SEND_RECEIVE) -> DataFrame:
    """Deferred deletions with ``verdict``: ``held`` while anyone wants the content that we have, else as classified now: ``apply`` or ``dropped``."""
    wanted = wants.select(F.col("size").alias("__size"), F.col("content_hash").alias("__hash"), F.lit(True).alias("__wanted")).distinct()
    rows = classify.classify(have, deferred, mode)
    live = ~F.col("have.deleted") & (F.col("have.size") == F.col("__size")) & (F.col("have.content_hash") == F.col("__hash"))
    rows = rows.join(wanted, live, "left")
    return rows.withColumn("verdict", F.when(F.col("__wanted"), "held").when(F.col("action") == DELETE, "apply").otherwise("dropped")).drop("__size", "__hash", "__wanted")


def served(requests: DataFrame, folders: DataFrame, ignored: Column, largest: int = LARGEST_BLOCK) -> DataFrame:
    """Requests (folder, name, size) with ``code``: served only from a known folder, of 0 to ``largest`` bytes, by a safe name that no rule hides."""
    known = folders.select("folder", F.lit(True).alias("__known")).distinct()
    ok = F.coalesce(F.col("__known"), F.lit(False)) & F.col("size").between(0, largest) & paths.name_safe(F.col("name")) & ~ignored
    return requests.join(known, "folder", "left").withColumn("code", F.when(ok, SERVED).otherwise(NO_SUCH_FILE)).drop("__known")


def answered(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses with the request in flight that they answer (``request``, null for none), by connection and id."""
    return responses.join(requests.select("conn", "id", F.struct(*[c for c in requests.columns if c not in ("conn", "id")]).alias("request")), ["conn", "id"], "left")


def transfer_state(transfers: DataFrame, now_s: int, quiet_s: int = STALL_S, tries: int = RETRIES) -> DataFrame:
    """Transfers (``last_s``, ``attempts``) with ``state``: ``abandoned`` after ``tries`` failed attempts, ``stalled`` without a block for ``quiet_s`` seconds, else ``active``."""
    return transfers.withColumn("state", F.when(F.col("attempts") >= tries, "abandoned").when(F.lit(now_s) - F.col("last_s") >= quiet_s, "stalled").otherwise("active"))


def live_counts(items: DataFrame) -> DataFrame:
    """(kind, n): folders and peers that aren't removed."""
    return items.groupBy("kind").agg(F.count_if(~F.col("removed")).alias("n"))


def tallies(warnings: DataFrame) -> DataFrame:
    """(kind, n, example) of directory warnings (kind, at, prefix, name): their number, and the first as a short path."""
    cut = F.col("prefix").contains("/")
    short = F.concat(F.when(cut, ".../").otherwise(""), F.element_at(F.split("prefix", "/"), -1), F.when(F.col("name").isNotNull(), F.concat(F.lit("/"), "name")).otherwise(""))
    return warnings.groupBy("kind").agg(F.count("*").alias("n"), F.min_by(short, "at").alias("example"))


def present(changes: DataFrame) -> DataFrame:
    """(folder, name) of a set of names after adds and drops (folder, name, at, add): those whose last change is an add."""
    return changes.groupBy(*KEY).agg(F.max_by("add", "at").alias("add")).where("add").select(*KEY)


def kept_against(contested: DataFrame, spoken: DataFrame, restarted: DataFrame) -> DataFrame:
    """Records kept against a deletion (folder, name, at), less those that the peer spoke of as live later (folder, name, at) and those of folders whose full index started later (folder, at)."""
    live = spoken.groupBy(*KEY).agg(F.max("at").alias("__live"))
    full = restarted.groupBy("folder").agg(F.max("at").alias("__full"))
    rows = contested.join(live, KEY, "left").join(full, "folder", "left")
    return rows.where(~F.coalesce(F.greatest("__live", "__full") > F.col("at"), F.lit(False))).drop("__live", "__full")


def to_recycle(sessions: DataFrame, folders: DataFrame) -> DataFrame:
    """Sessions (session, folder, need_gen) that must start again: the folder needs something since (``need_gen`` is higher), which only a fresh index tells."""
    now = folders.select("folder", F.col("need_gen").alias("__now"))
    return sessions.join(now, "folder").where(F.col("__now") > F.col("need_gen")).select("session").distinct()


def in_order(blocks: DataFrame, ahead: int) -> DataFrame:
    """Blocks (key, i, at: order of arrival) with ``early``: the places from the first block still missing when it came.

    ``staged`` if that is above 0, ``refused`` if above ``ahead``.  A window over one file's blocks, whose number the block sizes bound.
    """
    still = Window.partitionBy("key").orderBy("at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = blocks.withColumn("early", F.col("i") - F.min("i").over(still))
    return rows.withColumns({"staged": F.col("early") > 0, "refused": F.col("early") > ahead})


def metadata(records: DataFrame) -> DataFrame:
    """Records without their blocks; :func:`schema.conform` is the inverse, with no blocks."""
    return records.drop("block_hashes")


def small_tombstone(key: DataFrame, device: str, when_s: int) -> DataFrame:
    """Tombstones of keys (folder, name, counter, sequence) with a vector of one counter and the permissions of a file."""
    return conform(
        key.select(
            *KEY, F.lit(FILE).alias("type"), F.lit(0o644).cast("long").alias("permissions"), F.lit(when_s).cast("long").alias("modified_s"), F.lit(device).cast(COUNTER).alias("modified_by"),
            F.create_map(F.lit(device), F.col("counter").cast(COUNTER)).cast(VERSION).alias("version"), "sequence", F.lit(True).alias("deleted"),
        )
    ).select(*INDEX.fieldNames())
