"""Source trees as tables: a walk that honours ignore files, and the files' texts, hashes and languages.

Spark's own file sources skip names that begin with `_` or `.` and know no ignore
rules, so the walk is our own.  The driver descends a few levels only; the subtrees
below are walked by tasks, and files are read where they are hashed.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions.languages import detect_language, extensions, suffix_of
from lantern.sources.ignore import DEFAULT_DIRS, Rule, rules, verdict

MAX_FILE_BYTES = 1_000_000
IGNORE_FILES = (".gitignore", ".indexignore")
FILES = "path string, size long, sha256 string, language string, text string, error string"


def _lines(path: str) -> list[str]:
    try:
        with open(path, encoding="utf-8", errors="ignore") as f:
            return f.read().splitlines()
    except OSError:
        return []


def ignore_lines(folder: str) -> list[str]:
    """What the ignore files of one folder say, in order of precedence."""
    return [line for name in IGNORE_FILES for line in _lines(os.path.join(folder, name))]


def repo_root(folder: str) -> str | None:
    """The nearest folder upward that holds `.git` (a folder or a file), or None."""
    while True:
        if os.path.exists(os.path.join(folder, ".git")):
            return folder
        above = os.path.dirname(folder)
        if above == folder:
            return None
        folder = above


def _outer(root: str) -> list[tuple[str, list[str]]]:
    """(folder, lines) of the repository's exclude file and of ignore files from its root down to, not including, `root`."""
    top = repo_root(root)
    if top is None:
        return []
    out = [(top, _lines(os.path.join(top, ".git", "info", "exclude")))]
    between, at = [], root
    while at != top:
        at = os.path.dirname(at)
        between.append(at)
    out += [(d, ignore_lines(d)) for d in reversed(between)]
    return [x for x in out if x[1]]


def _all_rules(root: str, sources: list[tuple[str, list[str]]]) -> list[Rule]:
    return rules(list(DEFAULT_DIRS), root) + [r for folder, lines in sources for r in rules(lines, folder)]


def _step(folder: str, root: str, sources: list[tuple[str, list[str]]], wanted: frozenset[str]):
    """(rule sources that hold below this folder, its files, its folders); what can't be listed is empty."""
    own = ignore_lines(folder)
    sources = [*sources, (folder, own)] if own else sources
    ordered = _all_rules(root, sources)
    files, folders = [], []
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return sources, files, folders
    for e in entries:
        if e.is_symlink():
            continue
        is_dir = e.is_dir(follow_symlinks=False)
        ignored, found = verdict(e.path + "/" if is_dir else e.path, ordered)
        if ignored:
            continue
        if is_dir:
            folders.append(e.path)
        elif e.is_file(follow_symlinks=False) and (found or suffix_of(e.name) in wanted):
            files.append(e.path)
    return sources, files, folders


def walk(root: str, wanted: list[str], sources: list[tuple[str, list[str]]] | None = None, start: str | None = None) -> Iterator[str]:
    """Paths of the files below `start` (or `root`) that a walk of `root` returns, in order; no Spark involved."""
    sources, files, folders = _step(start or root, root, _outer(root) if sources is None else sources, frozenset(x.lower() for x in wanted))
    for path in sorted(files + folders):
        if path in folders:
            yield from walk(root, wanted, sources, path)
        else:
            yield path


def walk_files(spark: SparkSession, root: str, wanted: list[str] | None = None, include_text: bool = False, depth: int = 2) -> DataFrame:
    """path (below root) and size of every file to index.

    Levels down to `depth` are listed by the driver, subtrees below them by tasks; the
    rules that hold at their tops travel with them.  Symbolic links and files that
    can't be read are left out, an empty or missing root gives an empty table.
    """
    root = os.path.realpath(root)
    wanted = extensions(include_text) if wanted is None else list(wanted)
    keep = frozenset(x.lower() for x in wanted)
    level, files = [(root, _outer(root))], []
    for _ in range(depth):
        below = []
        for folder, sources in level:
            inner, found, folders = _step(folder, root, sources, keep)
            files += found
            below += [(f, inner) for f in folders]
        level = below

    def sized(paths: list[str]) -> pa.RecordBatch:
        rows = []
        for p in paths:
            try:
                rows.append((os.path.relpath(p, root), os.stat(p).st_size))
            except OSError:
                continue
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["path", "size"])

    def subtrees(batches):
        for b in batches:
            for at in b.column(0).to_pylist():
                if at < 0:
                    yield sized(files)
                else:
                    folder, sources = level[at]
                    yield sized(list(walk(root, wanted, sources, folder)))

    parts = min(max(1, len(level) + 1), 10_000)
    return spark.range(-1, len(level), 1, parts).mapInArrow(subtrees, "path string, size long")


def read_files(spark: SparkSession, root: str, include_text: bool = False, max_bytes: int = MAX_FILE_BYTES, wanted: list[str] | None = None) -> DataFrame:
    """path, size, sha256, language, text and error of every file of at most `max_bytes`.

    Bad UTF-8 becomes replacement characters.  A file that can't be read has an error
    and neither hash nor text, so that the next run tries it again.
    """
    base = os.path.realpath(root)
    found = walk_files(spark, base, wanted, include_text).where(F.col("size") <= max_bytes)

    def run(batches):
        for b in batches:
            rows = []
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    with open(os.path.join(base, path), "rb") as f:
                        raw = f.read()
                    text = raw.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
                    rows.append((path, size, hashlib.sha256(raw).hexdigest(), detect_language(path), text, None))
                except OSError as e:
                    rows.append((path, size, None, detect_language(path), None, str(e)))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in FILES.split(", ")])

    return found.mapInArrow(run, FILES)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One text per line that isn't blank."""
    return spark.read.text(path).select(F.col("value").alias("text")).where(F.trim("text") != "")


def ensure_ignored(root: str, name: str = ".lantern/") -> bool:
    """Adds the index folder to the tree's `.gitignore` if it isn't there; only in a repository or beside an existing file."""
    path = os.path.join(root, ".gitignore")
    if not os.path.exists(path) and not os.path.exists(os.path.join(root, ".git")):
        return False
    lines = _lines(path)
    if name in lines or name.rstrip("/") in lines:
        return False
    with open(path, "a", encoding="utf-8") as f:
        f.write(("" if not lines or open(path, encoding="utf-8").read().endswith("\n") else "\n") + name + "\n")
    return True
