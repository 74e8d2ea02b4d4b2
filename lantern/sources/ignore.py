"""Ignore rules in git's pattern language, as regular expressions that the driver, executors and Columns share."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lantern.functions.languages import suffix, suffix_of

#: Lowest in precedence, so a later `!build/` takes one back.
DEFAULT_DIRS = tuple(f"{d}/" for d in ".cache .eggs .git .hg .lantern .mypy_cache .next .pytest_cache .ruff_cache .semble .svn .tox .venv __pycache__ build dist node_modules venv".split())


@dataclass(frozen=True)
class Rule:
    """One pattern: what it matches (paths below `base`, directories with a slash at the end) and whether it ignores."""

    base: str
    regex: str
    ignores: bool
    named: bool  # has its last part a suffix?  Then a negation takes a file back whatever its suffix


def _glob(text: str) -> str:
    """A pattern without slashes at its ends, as the body of a regular expression."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if text.startswith("**/", i) and (i == 0 or text[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if c == "*":
            while i + 1 < len(text) and text[i + 1] == "*":
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = text.find("]", i + 2)
            if end < 0:
                out.append(r"\[")
            else:
                body = text[i + 1 : end].replace("\\", r"\\")
                out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
                i = end
        elif c == "\\" and i + 1 < len(text):
            i += 1
            out.append(re.escape(text[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def rule(line: str, base: str = "") -> Rule | None:
    """The rule of one line; None for blank lines and comments."""
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    ignores = not line.startswith("!")
    body = line if ignores else line[1:]
    only_dirs = body.endswith("/")
    core = body.rstrip("/")
    anchored = "/" in core
    core = core.lstrip("/")
    if not core:
        return None
    inside = core.endswith("/**")
    start = "" if anchored and not core.startswith("**/") else "(?:.*/)?"
    if core.startswith("**/"):
        core = core[3:]
    tail = "/.+" if inside else "/.*" if only_dirs else "(?:/.*)?"
    return Rule(base, f"^{start}{_glob(core[:-3] if inside else core)}{tail}$", ignores, bool(suffix_of(core)))


def rules(lines: list[str], base: str = "") -> list[Rule]:
    return [r for r in (rule(x, base) for x in lines) if r is not None]


def verdict(path: str, ordered: list[Rule]) -> tuple[bool, bool]:
    """(ignored, taken back by name) of a path, with a slash at the end if it is a directory; the last rule that matches decides."""
    ignored = found = False
    for r in ordered:
        if r.base and not path.startswith(r.base + "/"):
            continue
        if re.match(r.regex, path[len(r.base) + 1 :] if r.base else path):
            ignored = r.ignores
            found = not ignored and r.named
    return ignored, found


def selected(path: Column, ordered: list[Rule], extensions: list[str]) -> Column:
    """Would a walk return this file?  For paths from a table, all of one tree.

    A file goes if it or a directory above it is ignored.  Null paths give null.
    """

    def state(p: Column) -> Column:
        out = F.struct(F.lit(False).alias("ignored"), F.lit(False).alias("found"))
        for r in ordered:
            below = p if not r.base else F.when(p.startswith(r.base + "/"), F.substring(p, len(r.base) + 2, 1 << 30)).otherwise("")
            out = F.when((below != "") & below.rlike(r.regex), F.struct(F.lit(r.ignores).alias("ignored"), F.lit(not r.ignores and r.named).alias("found"))).otherwise(out)
        return out

    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))
    closed = F.when(F.size(parts) > 1, F.exists(above, lambda d: state(d)["ignored"])).otherwise(False)
    own = state(path)
    return ~closed & ~own["ignored"] & (own["found"] | suffix(path).isin(*sorted({x.lower() for x in extensions})))
