"""Configuration files: settings, peers and folders; and edits of their lines.

Configuration is small and parsed on the driver.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import MODES
from .device_id import normalize

DEFAULT_PORT, MOST_WINDOW = 22000, 4

# Settings with their kind and default.
SETTINGS: dict[str, tuple[str, object]] = {
    "logfile": ("text", None), "rexxport": ("text", None), "certfile": ("text", None), "keyfile": ("text", None), "statedir": ("text", None),
    "devicename": ("text", None), "logmax": ("number", 256), "keepdeletes": ("number", 180), "listenport": ("number", DEFAULT_PORT),
    "maxsend": ("positive", 0), "sockbuf": ("positive", 0), "window": ("window", MOST_WINDOW), "discovery": ("flag", True),
    "seriallog": ("flag", False), "appicon": ("flag", True), "versioning": ("flag", False), "compression": ("compression", True),
    "tzoffset": ("tz", None), "loglevel": ("level", 1),
}
LEVELS = {"debug": 0, "info": 1, "warn": 2, "error": 3}
TRUE = ("yes", "on", "true", "1")


@dataclass
class Config:
    """A parsed configuration: settings by name, peers, folders and warnings, all in the order of their lines."""

    settings: dict[str, object] = field(default_factory=lambda: {k: v for k, (_, v) in SETTINGS.items()})
    peers: list[dict] = field(default_factory=list)
    folders: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(peers, folders) as DataFrames."""
        peers = [(p["device"], p["id"], p["host"], p["port"]) for p in self.peers]
        folders = [(f["folder"], f["label"], f["path"], f["mode"]) for f in self.folders]
        return (
            spark.createDataFrame(peers, "device string, id string, host string, port int"),
            spark.createDataFrame(folders, "folder string, label string, path string, mode int"),
        )


def leading_int(text: str) -> int:
    """The number at the start of a text, 0 if there is none."""
    m = re.match(r"\s*([+-]?\d+)", text)
    return int(m[1]) if m else 0


def tz_seconds(text: str) -> int | None:
    """Seconds east of UTC of ``[+-]HH[:MM]`` within 14 hours, else None."""
    m = re.fullmatch(r"[ \t]*([+-]?)(\d{1,2})(?:[:.](\d{1,2}))?[ \t]*", text)
    if not m:
        return None
    h, minute = int(m[2]), int(m[3] or 0)
    if h > 14 or minute > 59 or (h == 14 and minute):
        return None
    return (-1 if m[1] == "-" else 1) * (h * 3600 + minute * 60)


def parse_line(line: str) -> tuple[str, str] | None:
    """(key, value) of a line, the key in lower case; None for blank lines, comments, sections and lines without ``=``."""
    text = line.strip(" \t\r\n")
    if not text or text[0] in ";#[" or "=" not in text:
        return None
    key, value = text.split("=", 1)
    return key.strip(" \t").lower(), value.strip(" \t")


def parse_config(text: str | None) -> Config:
    """The configuration of a file's text; None, for a file that isn't there, keeps the defaults."""
    cfg = Config()
    for line in (text or "").split("\n"):
        if (kv := parse_line(line)) is None:
            continue
        key, value = kv
        if key == "peer":
            _peer(cfg, value)
        elif key == "folder":
            _folder(cfg, value)
        elif key in SETTINGS:
            _setting(cfg, key, value)
        else:
            cfg.warnings.append(f"unknown key {key}")
    return cfg


def _setting(cfg: Config, key: str, value: str) -> None:
    kind, low, number = SETTINGS[key][0], value.lower(), leading_int(value)
    if kind == "compression" and low not in ("metadata", "never"):
        cfg.warnings.append(f"bad compression {value}")
        return
    if kind == "tz" and low != "locale" and tz_seconds(value) is None:
        cfg.warnings.append(f"bad tzoffset {value}")
        return
    cfg.settings[key] = {
        "text": lambda: value,
        "number": lambda: number,
        "positive": lambda: max(0, number),
        "window": lambda: min(MOST_WINDOW, max(1, number)),
        "flag": lambda: low in TRUE,
        "compression": lambda: low == "metadata",
        "tz": lambda: "locale" if low == "locale" else tz_seconds(value),
        "level": lambda: LEVELS.get(low, number),
    }[kind]()


def _peer(cfg: Config, value: str) -> None:
    words = value.split()
    device = normalize(words[0]) if words else None
    if device is None:
        cfg.warnings.append("malformed peer line")
    elif any(p["device"] == device for p in cfg.peers):
        cfg.warnings.append("peer is already configured")
    else:
        host, port = (words[1] if len(words) > 1 else ""), 0
        if host:
            if ":" in host:
                host, _, tail = host.rpartition(":")
                port = leading_int(tail) & 0xFFFF
            port = port or DEFAULT_PORT
        cfg.peers.append({"device": device, "id": words[0], "host": host, "port": port})


def _folder(cfg: Config, value: str) -> None:
    words = value.split()
    if len(words) < 2:
        cfg.warnings.append("malformed folder line")
    elif any(f["folder"] == words[0] for f in cfg.folders):
        cfg.warnings.append("folder is already configured")
    else:
        mode = MODES.get(words[2].lower()) if len(words) > 2 else MODES["sendreceive"]
        if mode is None:
            cfg.warnings.append(f"unknown folder mode {words[2]}")
        label = words[3] if len(words) > 3 else words[0]
        cfg.folders.append({"folder": words[0], "path": words[1], "mode": mode or 0, "label": label})


def field_ok(text: str) -> bool:
    """Whether a text can stand in a line of its own: no control characters or quotation marks."""
    return not re.search(r'[\x00-\x1f\x7f"]', text)


def append_line(text: str, key: str, value: str, note: str | None = None) -> str:
    """``text`` with a line for ``key`` after the last such line (commented-out ones count), or at the end."""
    if not field_ok(value):
        raise ValueError("control characters in a configuration value")
    lines = text.split("\n")
    at = max((k for k, x in enumerate(lines) if re.match(rf"[ \t]*[;#]?[ \t]*{key}[ \t]*=", x, re.I)), default=None)
    new = ([note] if note else []) + [f"{key} = {value}"]
    if at is None:
        at = len(lines) - 1 if lines[-1] else len(lines) - 2
    lines[at + 1 : at + 1] = new
    return "\n".join(lines) + ("" if lines[-1] == "" else "\n")


def remove_lines(text: str, match: Callable[[str, str], bool], note_prefix: str = "# added") -> str:
    """``text`` without the lines whose (key, value) match, and without the note right above each."""
    out: list[str] = []
    for line in text.split("\n"):
        kv = parse_line(line)
        if kv and match(*kv):
            if out and out[-1].startswith(note_prefix):
                out.pop()
            continue
        out.append(line)
    return "\n".join(out)


def remove_peer(text: str, device: str) -> str:
    """``text`` without a peer's lines, however its id is spelt there."""
    want = normalize(device)
    return remove_lines(text, lambda k, v: k == "peer" and bool(v.split()) and want is not None and normalize(v.split()[0]) == want)


def remove_folder(text: str, folder: str) -> str:
    """``text`` without a folder's lines."""
    return remove_lines(text, lambda k, v: k == "folder" and v.split()[:1] == [folder])


def save(path: str, text: str) -> None:
    """Writes a configuration so that a reader sees the old or the new one."""
    temp = f"{path}.new"
    with open(temp, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)


def command(words: Iterable[str], status: Callable[[], str], config: str) -> tuple[str, str]:
    """(reply, new configuration text) of a control command.

    STATUS, HELP and VERSION tell; ADDPEER, ADDFOLDER, REMOVEPEER and
    REMOVEFOLDER edit; anything else, or a bad argument, is an error.
    """
    words = list(words)
    verb, rest = (words[0].upper(), words[1:]) if words else ("", [])
    if verb == "STATUS":
        return status(), config
    if verb in ("HELP", "VERSION"):
        return "STATUS ADDPEER REMOVEPEER ADDFOLDER REMOVEFOLDER HELP VERSION", config
    if verb == "ADDPEER" and rest and normalize(rest[0]) and all(map(field_ok, rest)):
        known = {p["device"] for p in parse_config(config).peers}
        return ("EXISTS", config) if normalize(rest[0]) in known else ("OK", append_line(config, "peer", " ".join(rest[:2])))
    if verb == "ADDFOLDER" and len(rest) >= 2 and all(map(field_ok, rest)) and (len(rest) < 3 or rest[2].lower() in MODES):
        folders = parse_config(config).folders
        if any(f["folder"] == rest[0] for f in folders):
            return "EXISTS", config
        low = rest[1].lower().rstrip("/")
        if any(a == b or a.startswith(b + "/") for f in folders for o in [f["path"].lower().rstrip("/")] for a, b in ((low, o), (o, low))):
            return "OVERLAP", config
        return "OK", append_line(config, "folder", " ".join(rest[:4]))
    if verb == "REMOVEPEER" and rest:
        return "OK", remove_peer(config, rest[0])
    if verb == "REMOVEFOLDER" and rest:
        return "OK", remove_folder(config, rest[0])
    return "ERROR", config
