"""A stream of changes of a source tree, and a query that keeps its index up to date.

The source lists the tree and compares hashes with those of its last offset, so it
reports additions, changes and removals; Spark's file source knows no removals.  A
micro-batch is one burst of changes: the trigger's interval debounces, batches never
overlap, and each one runs the same reconciliation as a batch job does.
"""

from __future__ import annotations

import hashlib
import json
import logging
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from lantern.functions.languages import extensions
from lantern.plans.engine import Engine
from lantern.sources.files import MAX_FILE_BYTES, walk

log = logging.getLogger(__name__)
POLL_SECONDS, DEBOUNCE_SECONDS, MIN_INTERVAL_SECONDS = 3.0, 2.0, 5.0
CHANGES = "path string, change string, sha256 string"


def hashes(root: str, include_text: bool) -> dict[str, str]:
    """sha256 of every file that an index of the tree would hold."""
    out = {}
    for p in walk(root, extensions(include_text)):
        try:
            if os.stat(p).st_size <= MAX_FILE_BYTES:
                with open(p, "rb") as f:
                    out[os.path.relpath(p, root)] = hashlib.sha256(f.read()).hexdigest()
        except OSError:
            continue
    return out


def changes(old: dict[str, str], new: dict[str, str]) -> list[tuple[str, str, str | None]]:
    """(path, change, sha256) in order of path."""
    found = [(p, "added" if p not in old else "changed", h) for p, h in new.items() if old.get(p) != h]
    return sorted(found + [(p, "removed", None) for p in old if p not in new])


class _TreeReader(SimpleDataSourceStreamReader):
    """Offsets are numbers; what the tree held at each is kept in a small folder, so that a batch can be read again."""

    def __init__(self, options):
        self.root = os.path.realpath(options["path"])
        self.text = str(options.get("includeText", "false")).lower() == "true"
        self.log = options["state"]
        os.makedirs(self.log, exist_ok=True)

    def _state(self, n: int) -> dict[str, str]:
        path = os.path.join(self.log, f"{n}.json")
        if n <= 0 or not os.path.exists(path):
            return {}
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        old, new = self._state(start["n"]), hashes(self.root, self.text)
        found = changes(old, new)
        if not found:
            return iter([]), start
        n = start["n"] + 1
        path = os.path.join(self.log, f"{n}.json")
        with open(path + ".new", "w", encoding="utf-8") as f:
            json.dump(new, f)
        os.replace(path + ".new", path)
        return iter(found), {"n": n}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(changes(self._state(start["n"]), self._state(end["n"])))

    def commit(self, end: dict) -> None:
        for n in range(max(1, end["n"] - 8), end["n"]):
            try:
                os.remove(os.path.join(self.log, f"{n}.json"))
            except OSError:
                continue


class TreeChanges(DataSource):
    """`spark.readStream.format("tree_changes")` with options path, state and includeText."""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return CHANGES

    def simpleStreamReader(self, schema):
        return _TreeReader(self.options)


def stream_changes(spark: SparkSession, root: str, state: str, include_text: bool = False) -> DataFrame:
    """Changes of a tree as a stream; `state` is the folder of what was seen."""
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format("tree_changes").option("path", root).option("state", state).option("includeText", str(include_text).lower()).load()


def watch(engine: Engine, checkpoint: str, poll_seconds: float = POLL_SECONDS, debounce: float = DEBOUNCE_SECONDS, min_interval: float = MIN_INTERVAL_SECONDS, once: bool = False):
    """Start a query that reindexes after each burst of changes; `stop()` ends it.

    Within a batch it waits `debounce` seconds for more changes and until `min_interval`
    has passed since the last run.  A run that fails is logged and tried again with the
    next change; the text setting is the index's own.
    """
    last = [0.0]

    def run(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        time.sleep(max(debounce, min_interval - (time.time() - last[0])) if not once else 0)
        try:
            engine.index()
        except Exception:
            log.exception("reindexing %s failed", engine.root)
        last[0] = time.time()

    changed = stream_changes(engine.spark, engine.root, os.path.join(checkpoint, "seen"), engine.include_text)
    writer = changed.writeStream.foreachBatch(run).option("checkpointLocation", os.path.join(checkpoint, "query"))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(poll_seconds, 0.1)} seconds")).start()
