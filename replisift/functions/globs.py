"""Ignore rules: their text, their globs as regular expressions, and their match.

Rules are few and parsed on the driver.  A path is ignored by the first rule
that matches it, unless that rule is negated; with none it is kept.  The regular
expressions are plain enough for Java and RE2 alike.

A glob: ``*`` any run without a slash, ``**`` (with a slash after it, if there is
one) any run, ``?`` one character but a slash, ``[...]`` a class, negated by
``!`` or ``^``, which never matches a slash.  A class without end or members
never matches.  Case is that of ASCII and doesn't count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import ascii_lower

MOST_RULES, LONGEST_RULE, DEEPEST_INCLUDE, MOST_BYTES = 48, 128, 4, 8192
NEVER = r"[^\s\S]"


@dataclass(frozen=True)
class Rule:
    """One rule: its glob, whether it is negated, and whether it is about whole paths."""

    glob: str
    negate: bool = False
    has_slash: bool = False


@dataclass
class RuleSet:
    """Rules in order, and how many lines were dropped for being too many or too long."""

    rules: list[Rule]
    dropped: int = 0


def _lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def parse_rules(
    text: str, load: Callable[[str], str | None] | None = None, most: int = MOST_RULES, longest: int = LONGEST_RULE, _into: RuleSet | None = None, _level: int = 0
) -> RuleSet:
    """The rules of a file's text.  ``load`` gives the text of a file that ``#include`` names, or None."""
    out = _into if _into is not None else RuleSet([])
    for line in text.split("\n"):
        line = line.removesuffix("\r")
        if not line or line.startswith("//"):
            continue
        if line.startswith("#"):
            if load and line.startswith(("#include ", "#include\t")) and _level < DEEPEST_INCLUDE:
                name = line[9:].lstrip(" \t")
                more = load(name) if 0 < len(name) < longest else None
                if more is not None:
                    parse_rules(more, load, most, longest, out, _level + 1)
            continue
        negate = line.startswith("!")
        glob = line[negate:]
        while len(glob) >= 4 and glob[:2] == "(?" and glob[3] == ")":
            glob = glob[4:]
        rooted = glob.startswith("/")
        glob = glob[rooted:]
        if not glob:
            continue
        if len(glob.encode()) >= longest or len(out.rules) >= most:
            out.dropped += 1
            continue
        out.rules.append(Rule(glob, negate, rooted or "/" in glob))
    return out


def load_rules(read: Callable[[str], str | None], name: str = ".stignore") -> RuleSet | None:
    """The rules of a named file: an empty set if there is none, None if it is there but can't be read or is too long.

    ``read`` gives a file's text, None if there is none, and raises OSError otherwise.
    """
    try:
        text = read(name)
    except OSError:
        return None
    if text is None:
        return RuleSet([])
    return None if len(text.encode()) > MOST_BYTES else parse_rules(text, read)


def _literal(c: str) -> str:
    return c if c.isalnum() or c in "_ " or ord(c) > 127 else f"\\x{{{ord(c):x}}}"


def _class(glob: str, at: int) -> tuple[str, int]:
    """The expression of the class that opens at ``at``, and where the glob goes on."""
    k = at + 1
    negated = k < len(glob) and glob[k] in "!^"
    k += negated
    chars: set[str] = set()
    while k < len(glob) and glob[k] != "]":
        if k + 2 < len(glob) and glob[k + 1] == "-" and glob[k + 2] != "]":
            low, high = ord(_lower(glob[k])), ord(_lower(glob[k + 2]))
            chars.update(map(chr, range(low, min(high, low + 0x3000) + 1)))
            k += 3
        else:
            chars.add(_lower(glob[k]))
            k += 1
    if k >= len(glob):
        return NEVER, len(glob)
    if k == at + 1 + negated:
        return NEVER, k + 1
    if negated:
        return "[^" + "".join(map(_literal, sorted(chars | {"/"}))) + "]", k + 1
    own = sorted(chars - {"/"})
    return ("[" + "".join(map(_literal, own)) + "]" if own else NEVER), k + 1


def glob_regex(glob: str, cross: bool = True) -> str:
    """The expression of a glob, to be matched against text in ASCII lower case.  Without ``cross``, ``**`` stops at slashes."""
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**", k):
            while k < len(glob) and glob[k] == "*":
                k += 1
            if cross:
                k += k < len(glob) and glob[k] == "/"
                out.append(r"[\s\S]*")
            else:
                out.append(r"[^/]*")
        elif c == "*":
            out.append(r"[^/]*")
            k += 1
        elif c == "?":
            out.append(r"[^/]")
            k += 1
        elif c == "[":
            one, k = _class(glob, k)
            out.append(one)
        else:
            out.append(_literal(_lower(c)))
            k += 1
    return "".join(out)


def rule_regex(rule: Rule) -> str:
    """The expression that finds a rule's match in a path in ASCII lower case: the path or a folder above it, or one component."""
    if rule.has_slash:
        return rf"^(?:{glob_regex(rule.glob)})(?:/[\s\S]*)?\z"
    return rf"(?:^|/)(?:{glob_regex(rule.glob, cross=False)})(?:/|\z)"


def first_match(name: Column, rules: list[Rule]) -> Column:
    """The place, from 1, of the first rule that matches a path; null if none."""
    path, out = ascii_lower(name), None
    for k, rule in enumerate(rules, 1):
        test = path.rlike(rule_regex(rule))
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def ignored(name: Column, rules: list[Rule]) -> Column:
    """Whether a path is ignored."""
    path, out = ascii_lower(name), None
    for rule in rules:
        test, verdict = path.rlike(rule_regex(rule)), F.lit(not rule.negate)
        out = F.when(test, verdict) if out is None else out.when(test, verdict)
    return F.lit(False) if out is None else F.coalesce(out.otherwise(F.lit(False)), F.lit(False))


def fingerprint(rules: list[Rule]) -> str:
    """A digest that changes with the rules and their order, not with comments."""
    text = "".join(f"{r.glob}\0{int(r.negate)}{int(r.has_slash)}\n" for r in rules) + str(len(rules))
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprints(rules: Column) -> Column:
    """:func:`fingerprint` of a column of rule texts, by Arrow batches; equal texts are parsed once a batch.  Null: that of no rule."""

    @F.pandas_udf("string")
    def run(texts):
        plain = texts.fillna("")
        known = {t: fingerprint(parse_rules(t).rules) for t in plain.unique()}
        return plain.map(known)

    return run(rules)
