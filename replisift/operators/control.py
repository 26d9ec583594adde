"""Control commands as a log of events, folded into state, and the report on that state.

What a log says of a key (a peer, a folder, a setting) is a small row that
composes with the row of the log before it; so a log is folded by aggregation,
in parts and in any grouping, and a long log never passes one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources import device_id
from . import status
from .index import latest_change

# The words of commands, and the levels of the log.
VERBS = ("STATUS", "DISCOVERED", "ADDPEER", "ADDFOLDER", "REMOVEFOLDER", "RESCAN", "PAUSE", "RESUME", "LOGLEVEL", "VERSION", "HELP", "QUIT")
LEVELS = ("debug", "info", "warn", "error")
MODE_NAMES = {0: "sendreceive", 1: "sendonly", 2: "receiveonly"}
#: Of a log or a part of one: (kind, id, cleared_at, first_at, first, last_at, last).
STATE = ["kind", "id", "cleared_at", "first_at", "first", "last_at", "last"]
EVERY = "*"


def parse(log: DataFrame) -> DataFrame:
    """(at, line) with ``verb`` (null if unknown), ``args`` and ``valid``: whether the command can be carried out as it stands.

    Words are separated by white space, verbs in any case.  A mode that isn't
    known is refused rather than guessed; so is a device id that isn't one.
    """
    words = F.filter(F.split(F.trim(F.coalesce("line", F.lit(""))), r"\s+"), lambda w: w != "")
    verb = F.upper(F.get(words, F.lit(0)))
    rows = log.select("*", F.when(verb.isin(*VERBS), verb).alias("verb"), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))).alias("args"))
    n, first = F.size("args"), F.get("args", F.lit(0))
    named = device_id.normalized(first).isNotNull()
    valid = (
        F.when(F.col("verb").isNull(), False)
        .when(F.col("verb") == "ADDPEER", F.coalesce(named, F.lit(False)))
        .when(F.col("verb").isin("PAUSE", "RESUME"), (n == 0) | F.coalesce(named, F.lit(False)))
        .when(F.col("verb") == "ADDFOLDER", (n >= 2) & ((n < 3) | F.lower(F.get("args", F.lit(2))).isin(*MODE_NAMES.values())))
        .when(F.col("verb") == "REMOVEFOLDER", n >= 1)
        .when(F.col("verb") == "LOGLEVEL", (n == 0) | F.lower(first).isin(*LEVELS))
        .otherwise(True)
    )
    return rows.withColumn("valid", valid)


def _marks(parsed: DataFrame) -> DataFrame:
    """(kind, id, at, clears, value): what each valid command says of a key."""
    v, first = F.col("verb"), F.get("args", F.lit(0))
    peer = F.when(F.size("args") > 0, device_id.normalized(first)).otherwise(EVERY)
    kind = (
        F.when(v == "ADDPEER", "peer").when(v.isin("ADDFOLDER", "REMOVEFOLDER"), "folder").when(v.isin("PAUSE", "RESUME"), "pause")
        .when(v == "RESCAN", "rescan").when(v == "QUIT", "quit").when((v == "LOGLEVEL") & (F.size("args") > 0), "level")
    )
    value = (
        F.when(v == "ADDPEER", F.coalesce(F.get("args", F.lit(1)), F.lit("")))
        .when(v == "ADDFOLDER", F.concat_ws(" ", F.lower(F.coalesce(F.get("args", F.lit(2)), F.lit("sendreceive"))), F.get("args", F.lit(1))))
        .when(v.isin("PAUSE", "RESUME"), v).when(v == "LOGLEVEL", F.lower(first)).otherwise("")
    )
    ident = F.when(v.isin("ADDPEER", "PAUSE", "RESUME"), peer).when(v.isin("ADDFOLDER", "REMOVEFOLDER"), first).otherwise(EVERY)
    rows = parsed.where("valid").select(kind.alias("kind"), ident.alias("id"), "at", (v == "REMOVEFOLDER").alias("clears"), value.alias("value"))
    return rows.where("kind IS NOT NULL")


def state_of(log: DataFrame) -> DataFrame:
    """The state (:data:`STATE`) that a log of (at, line) leads to: a key's last clearing, and its first and last word after that.

    Times must be unique.  Two aggregations, both combined before the shuffle.
    """
    marks = _marks(parse(log))
    cleared = marks.groupBy("kind", "id").agg(F.max(F.when(F.col("clears"), F.col("at"))).alias("cleared_at"))
    since = marks.join(cleared, ["kind", "id"]).where(F.col("cleared_at").isNull() | (F.col("at") > F.col("cleared_at")))
    said = since.groupBy("kind", "id").agg(F.min("at").alias("first_at"), F.min_by("value", "at").alias("first"), F.max("at").alias("last_at"), F.max_by("value", "at").alias("last"))
    return cleared.join(said, ["kind", "id"], "left").select(*STATE)


def composed(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """The state of two logs, one after the other, from the states of both.  Associative; the empty state is its unit."""
    a, b = earlier.select("kind", "id", F.struct(*STATE[2:]).alias("a")), later.select("kind", "id", F.struct(*STATE[2:]).alias("b"))
    both = a.join(b, ["kind", "id"], "full_outer")
    new = F.col("a").isNull() | F.col("b.cleared_at").isNotNull()
    begun = ~new & F.col("a.first_at").isNotNull()
    pick = lambda c: F.when(begun, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    end = lambda c: F.when(~new & F.col("b.last_at").isNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    cleared = F.when(new, F.col("b.cleared_at")).otherwise(F.col("a.cleared_at"))
    return both.select("kind", "id", cleared.alias("cleared_at"), pick("first_at").alias("first_at"), pick("first").alias("first"), end("last_at").alias("last_at"), end("last").alias("last"))


def peers(state: DataFrame) -> DataFrame:
    """(device, address, paused): the peers of a state.  The last word counts, for one peer or for all that were there when it was said."""
    known = state.where("kind = 'peer'").select(F.col("id").alias("device"), F.col("first").alias("address"), F.col("first_at").alias("__since"))
    words = state.where("kind = 'pause'").select("id", F.struct(F.col("last_at").alias("at"), (F.col("last") == "PAUSE").alias("paused")).alias("w"))
    own = words.where(F.col("id") != EVERY).select(F.col("id").alias("device"), F.col("w").alias("__own"))
    # One row at most: the last word to all.
    everyone = words.where(F.col("id") == EVERY).agg(F.max("w").alias("__all"))
    rows = known.join(own, "device", "left").crossJoin(F.broadcast(everyone))
    heard = lambda c: F.when(F.col(f"{c}.at") > F.col("__since"), F.col(c))
    return rows.select("device", "address", F.coalesce(F.greatest(heard("__own"), heard("__all"))["paused"], F.lit(False)).alias("paused"))


def folders(state: DataFrame) -> DataFrame:
    """(folder, path, mode): the folders of a state, as first added since they were last removed."""
    rows = state.where("kind = 'folder' AND first_at IS NOT NULL")
    return rows.select(F.col("id").alias("folder"), F.expr("substring(first, instr(first, ' ') + 1)").alias("path"), text.mode_of(F.substring_index("first", " ", 1)).alias("mode"))


def settings(state: DataFrame) -> DataFrame:
    """(level, rescan_at, quit_at), one row: the log's level (``info`` unless said), and when a rescan or an end was last asked for."""
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return state.agg(F.coalesce(of("level", "last"), F.lit("info")).alias("level"), of("rescan", "last_at").alias("rescan_at"), of("quit", "last_at").alias("quit_at"))


def due(state: DataFrame, scanned: DataFrame) -> DataFrame:
    """The folders (folder, scanned_at) that were last scanned before a rescan was asked for."""
    asked = settings(state).select("rescan_at")  # one row
    return scanned.crossJoin(F.broadcast(asked)).where(F.col("scanned_at").isNull() | (F.col("scanned_at") < F.col("rescan_at"))).select("folder")


def replies(log: DataFrame) -> DataFrame:
    """(at, line, verb, reply): what each command is told: ``ok``, ``error``, or that a key is already there, or unknown.

    Whether a key is there when a command comes is told by the clearing and the
    word before it: the last command about the key, found by counting words since
    clearings, which are sums over ranges, not a walk through the key's commands.
    """
    parsed = parse(log)
    asked = F.col("verb").isin("ADDPEER", "ADDFOLDER", "REMOVEFOLDER")
    from pyspark.sql.window import Window

    ident = F.when(F.col("verb") == "ADDPEER", device_id.normalized(F.get("args", F.lit(0)))).otherwise(F.get("args", F.lit(0)))
    kind = F.when(F.col("verb") == "ADDPEER", "peer").otherwise("folder")
    keyed = parsed.where(asked & F.col("valid")).select("at", kind.alias("kind"), ident.alias("id"), (F.col("verb") != "REMOVEFOLDER").alias("adds"))
    before = F.lag("adds").over(Window.partitionBy("kind", "id").orderBy("at"))
    told = keyed.select("at", F.when(F.col("adds"), F.when(before, "already configured").otherwise("added")).otherwise(F.when(before, "removed").otherwise("unknown folder")).alias("told"))
    return parsed.join(told, "at", "left").select("at", "line", "verb", F.when(~F.col("valid"), "error").otherwise(F.coalesce("told", F.lit("ok"))).alias("reply"))


# --- the report


def _plural(n: Column, one: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))


def folder_lines(folders: DataFrame, index: DataFrame, scans: DataFrame, items: DataFrame, changes: DataFrame, now_s: int) -> DataFrame:
    """(folder, place, line) of the folders (folder, label, path, mode): what they hold, what isn't as it seems, and the latest change.

    ``scans``: (folder, scanned_s).  ``items``: see :func:`status.backlog`.  ``changes``: see :func:`index.latest_change`.
    """
    name = text.display_label(F.col("label"), F.col("folder"))
    head = F.when(name == F.col("folder"), F.col("folder")).otherwise(F.concat(name, F.lit(" ["), "folder", F.lit("]")))
    modes = F.create_map(*[x for k, v in MODE_NAMES.items() for x in (F.lit(k), F.lit(v))])
    rows = folders.join(status.folder_totals(index), "folder", "left").join(scans.select("folder", "scanned_s"), "folder", "left")
    rows = rows.join(status.backlog(items).select("folder", "kept", "reverted"), "folder", "left").join(latest_change(changes), "folder", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    since = F.when(F.col("scanned_s").isNull(), "not scanned yet").otherwise(F.concat(F.lit("scanned "), text.format_duration(text.minutes_since(F.col("scanned_s"), F.lit(now_s))), F.lit(" ago")))
    held = F.concat(F.lit("  "), F.concat_ws(", ", _plural(count("files"), "file"), _plural(count("dirs"), "dir"), text.format_size(count("bytes"))), F.lit(" - "), since)
    lost = F.when(count("reverted") > 0, F.concat(F.lit("  "), _plural(count("reverted"), "local edit"), F.lit(" replaced by a peer's copy")))
    kept = F.when(count("kept") > 0, F.concat(F.lit("  "), _plural(count("kept"), "file"), F.lit(" kept against a peer's deletion")))
    change = F.concat(F.lit("  latest change: "), F.coalesce(F.concat_ws(" ", "verb", "name"), F.lit("")))
    change = F.when(F.col("verb").isNull(), "  latest change: (none yet)").otherwise(change)
    first = F.concat(F.lit(""), F.concat_ws("  ", head, "path", F.element_at(modes, F.col("mode"))))
    lines = F.filter(F.array(first, held, lost, kept, change), lambda x: x.isNotNull())
    return rows.select("folder", F.posexplode(lines).alias("place", "line"))


def peer_lines(peers: DataFrame, sessions: DataFrame) -> DataFrame:
    """(device, place, line) of the peers (device, address, paused); ``sessions``: (device, connected, running, pending, client, bytes_in, bytes_out)."""
    rows = peers.join(sessions, "device", "left")
    pending = F.coalesce("pending", F.lit(0).cast("long"))
    state = (
        F.when(F.col("connected") & (pending > 0), F.concat(F.lit("syncing ("), _plural(pending, "file"), F.lit(")")))
        .when(F.col("connected"), "up to date").when(F.col("paused"), "paused").when(F.col("running"), "connecting").otherwise("idle")
    )
    short = F.substring("device", 1, 7)
    first = F.concat_ws("  ", short, F.coalesce(F.nullif("address", F.lit("")), F.lit("(discovering)")), state)
    moved = F.coalesce("bytes_in", F.lit(0)) + F.coalesce("bytes_out", F.lit(0)) > 0
    second = F.when(F.col("client").isNotNull() | moved, F.concat(
        F.lit("  "), F.coalesce("client", F.lit("?")), F.lit(" - received "), text.format_size(F.coalesce("bytes_in", F.lit(0).cast("long"))), F.lit(", sent "), text.format_size(F.coalesce("bytes_out", F.lit(0).cast("long")))
    ))
    return rows.select("device", F.posexplode(F.filter(F.array(first, second), lambda x: x.isNotNull())).alias("place", "line"))


def report(folder_lines: DataFrame, peer_lines: DataFrame, seen: DataFrame | None = None, offered: DataFrame | None = None) -> DataFrame:
    """(section, key, place, line) of the whole report, to be read in that order; sections without a row have their heading only, the last two not even that.

    ``seen``: (device, address) of devices that aren't configured, ``offered``: (folder, label, device) of folders that aren't.
    """
    heading = lambda n, title, df, key: df.agg(F.countDistinct(key).alias("n")).select(F.lit(n).alias("section"), F.lit("").alias("key"), F.lit(-1).alias("place"), F.concat(F.lit(f"{title} ("), F.col("n").cast("string"), F.lit(")")).alias("line"), "n")
    out = heading(1, "Folders", folder_lines, "folder").drop("n").unionByName(folder_lines.select(F.lit(1).alias("section"), F.col("folder").alias("key"), "place", "line"))
    out = out.unionByName(heading(2, "Remote devices", peer_lines, "device").drop("n")).unionByName(peer_lines.select(F.lit(2).alias("section"), F.col("device").alias("key"), "place", "line"))
    if seen is not None:
        lines = seen.select(F.lit(3).alias("section"), F.col("device").alias("key"), F.lit(0).alias("place"), F.concat_ws("  ", F.substring("device", 1, 7), "address").alias("line"))
        out = out.unionByName(heading(3, "Discovered, not configured", seen, "device").where("n > 0").drop("n")).unionByName(lines)
    if offered is not None:
        label = text.display_label(F.col("label"), F.col("folder"))
        named = F.when(label == F.col("folder"), F.col("folder")).otherwise(F.concat(label, F.lit(" ["), "folder", F.lit("]")))
        lines = offered.select(F.lit(4).alias("section"), F.col("folder").alias("key"), F.lit(0).alias("place"), F.concat(named, F.lit("  (from "), F.coalesce("device", F.lit("?")), F.lit(")")).alias("line"))
        out = out.unionByName(heading(4, "Offered, not configured", offered, "folder").where("n > 0").drop("n")).unionByName(lines)
    return out
