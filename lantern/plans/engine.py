"""The engine over one source tree: index, search, resolve, explain, status."""

from __future__ import annotations

import hashlib
import os
import threading
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lantern.operators import dense, graph, lexical, ranking, tables
from lantern.plans import index as ix
from lantern.sources.files import repo_root

#: Suffixes after which `:line` names a place.
PLACES = tuple(f".{s}" for s in "go java js jsx py rs ts tsx".split())
LEG = 200
#: How many of each kind a pack keeps.
CAPS = {"primary": 10, "related_files": 5, "test_files": 3, "imports": 2, "imported_by": 1, "symbols": 5, "callers": 2, "callees": 2, "dependency_chain": 3}
EMPTY = {**{k: [] for k in CAPS}, "total_tokens": 0, "confidence": 0.0}


#: Of a run's figures, those that the status tells.
_TOLD = ("errors", "index_time_ms", "indexed_files", "languages", "memo_hits", "memo_misses", "total_chunks")


def _said(text: str, what: str) -> str:
    """The text without white space around it, which must leave something."""
    if not (text or "").strip():
        raise ValueError(f"the {what} is empty")
    return text.strip()


def index_folder(root: str, model_name: str) -> str:
    """Below the repository's (or else the tree's) own folder, one for each tree and model."""
    home = repo_root(os.path.realpath(root)) or os.path.realpath(root)
    return os.path.join(home, ".lantern", hashlib.sha256(f"{os.path.realpath(root)}:{model_name}".encode()).hexdigest()[:16])


class Engine:
    """One tree and its index.  `model` has a name, `embed(df, text, out)` and `query(text)`."""

    def __init__(self, spark: SparkSession, root: str, model: Any, folder: str | None = None, chunk_size: int = 2048):
        self.spark, self.root, self.model, self.chunk_size = spark, os.path.realpath(root), model, chunk_size
        self.folder = folder or index_folder(self.root, model.name)
        self.store = ix.Store(spark, self.folder)
        self.last_error: str | None = None
        self.is_indexing = False
        self._lock = threading.RLock()
        self._graph: tuple[str, DataFrame, DataFrame] | None = None

    # Index.

    @property
    def index_exists(self) -> bool:
        state = self.store.state
        return state is not None and state.get("model") == self.model.name

    @property
    def include_text(self) -> bool:
        state = self.store.state
        return bool(state and state.get("include_text"))

    def index(self, force: bool = False, include_text: bool | None = None, chunk_size: int | None = None, progress: ix.Callback | None = None) -> ix.Stats:
        """Bring the index up to date; what isn't said is as in the run before.  A run that fails leaves the index as it was."""
        with self._lock:
            if self.is_indexing:
                raise RuntimeError("an index run is already in progress")
            self.is_indexing, self.last_error = True, None
            try:
                text = self.include_text if include_text is None else include_text
                found = ix.scan(self.spark, self.root, text)
                return ix.reconcile(self.store, found, self.model, chunk_size or self.chunk_size, force, {"include_text": text, "root": self.root}, progress)
            except Exception as e:
                self.last_error = str(e)
                raise
            finally:
                self.is_indexing = False

    def load(self) -> bool:
        """Is there an index of this model?"""
        return self.index_exists

    def clear(self) -> bool:
        self._graph = None
        return self.store.clear()

    def stats(self) -> ix.Stats:
        state = self.store.state
        return ix.Stats(**state["stats"]) if state else ix.Stats()

    def status(self) -> dict[str, Any]:
        """What an agent needs to know of the index."""
        state, stats = self.store.state, self.stats()
        at = datetime.fromtimestamp(state["finished_at"], timezone.utc).isoformat() if state else None
        name = "indexing" if self.is_indexing else "error" if self.last_error else "ready" if stats.total_chunks else "empty"
        return {
            "status": name, "model": self.model.name, "root": self.root, "index_dir": self.folder, "is_indexing": self.is_indexing, "index_exists": self.index_exists, "include_text_files": self.include_text,
            "last_index_error": self.last_error, "last_indexed_at": at, "up_to_date": stats.up_to_date if state else None, **{k: getattr(stats, k) for k in _TOLD},
        }

    def changes(self) -> DataFrame:
        """(path, change) of the tree against the index, under the settings of its last run."""
        now = ix.scan(self.spark, self.root, self.include_text).where("sha256 is not null")
        old = self.store.table("files") if self.index_exists else now.limit(0)
        return tables.snapshot_diff(old, now)

    # Search.

    def chunks(self) -> DataFrame:
        return self.store.table("chunks")

    def search(self, query: str, top_k: int = 10, alpha: float | None = None, min_score: float = 0, *, only: DataFrame | None = None) -> DataFrame:
        """(rank, id, path, start_line, end_line, content, score, exact, language, source) of the best chunks; empty without an index.

        `only` (column id) restricts both legs: vectors before they are ranked, lexical
        hits after a longer list is cut.
        """
        _said(query, "query")
        if top_k < 1:
            raise ValueError(f"{top_k} results can't be found")
        shape = "rank int, id string, path string, start_line int, end_line int, content string, score double, exact boolean, language string, source string"
        state = self.store.state
        if state is None or not state["stats"]["total_chunks"]:
            return self.spark.createDataFrame([], shape)
        every, n = self.chunks(), state["stats"]["total_chunks"]
        most = max(min(LEG, n), top_k)
        lex = lexical.top(lexical.indexed_scores(self.store.table("postings"), query, n, state["avgdl"], buckets=state["buckets"]), most * 3)
        if only is not None:
            lex = lex.join(only.select("id"), "id", "left_semi")
        lex = lexical.top(lex, most)
        hashes = dense.nearest(self.store.table("vectors").withColumnRenamed("chunk_hash", "id"), self.model.query(query), most, "id", "vector") if only is None else None
        if hashes is None:
            mine = every.join(only.select("id"), "id", "left_semi").select("id", "chunk_hash").join(self.store.table("vectors"), "chunk_hash")
            near = dense.nearest(mine, self.model.query(query), most, "id", "vector").select("id", "score")
        else:
            # Vectors are of contents: chunks of one content share the score, and the best `most` chunks are among those of the best contents.
            near = lexical.top(every.select("id", "chunk_hash").join(F.broadcast(hashes.select(F.col("id").alias("chunk_hash"), "score")), "chunk_hash").select("id", "score"), most)
        found = ranking.search_hybrid(query, near, lex, every, top_k, alpha, min_score)
        return every.select("id", "language").join(F.broadcast(found), "id").withColumn("source", F.lit("hybrid")).select(*[c.split()[0] for c in shape.split(", ")]).orderBy("rank")

    def find_symbol(self, name: str, top_k: int = 10) -> DataFrame:
        """Where a symbol is defined or named: the lexical leg alone."""
        return self.search(name, top_k, 0.0)

    def find_related(self, chunk_id: str, top_k: int = 5) -> DataFrame:
        """Chunks that a search for this chunk's content finds, without itself; empty for an unknown id."""
        row = self.chunks().where(F.col("id") == chunk_id).select("content").first() if self.index_exists else None
        if row is None:
            return self.search("x", top_k).limit(0)
        found = self.search(row["content"], top_k + 1)
        return found.where(F.col("id") != chunk_id).orderBy("rank").limit(top_k)

    # Context.

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of the indexed Python files, built once a version."""
        version = self.store.state["version"]
        if self._graph is None or self._graph[0] != version:
            nodes, edges = graph.build(self.store.table("files"))
            self._graph = (version, nodes, edges)
        return self._graph[1:]

    def _pack(self, query: str, primary: list[Row]) -> dict[str, Any]:
        """Everything around the primary chunks, cut to the caps."""
        if not primary:
            return {"query": query, **EMPTY}
        nodes, edges = self.graph()
        files = sorted({r["path"] for r in primary})
        mine = self.spark.createDataFrame([(f,) for f in files], "path string")
        names = lambda df: sorted(r["path"] for r in df.collect())
        tests = names(graph.test_files(self.store.table("files"), mine).orderBy("path").limit(100))
        out, into = (names(graph.imports(nodes, edges, mine, way).orderBy("path").limit(100)) for way in ("out", "in"))
        rows = lambda df: [r.asDict() for r in df.collect()]
        scores = [r["score"] for r in primary if r["score"] > 0]
        pack = {
            "query": query, "confidence": round(sum(scores) / len(scores), 3) if scores else 0.0, "primary": primary, "related_files": sorted({*files, *out, *into, *tests}), "test_files": tests, "imports": out, "imported_by": into,
            "symbols": rows(graph.symbols(nodes, mine)), "callers": rows(graph.callers(nodes, edges, mine)), "callees": rows(graph.callers(nodes, edges, mine, way="out")),
            "dependency_chain": [r["path"] for r in graph.dependency_chain(nodes, edges, mine).collect()],
        }
        pack = {k: v[: CAPS[k]] if k in CAPS else v for k, v in pack.items()}
        return {**pack, "total_tokens": sum(len(r["content"]) for r in pack["primary"]) // 4}

    def resolve(self, query: str, top_k: int = 5) -> dict[str, Any]:
        """A search with its tests, imports, symbols, callers and dependencies."""
        return self._pack(query, self.search(query, top_k).collect())

    def indexed_file(self, location: str) -> str | None:
        """The indexed path that a location means: itself, an absolute path in the tree, or the only one that ends in it."""
        if not self.index_exists:
            return None
        said = location.strip()
        wanted = "/".join(said.split("\\"))
        wanted = wanted[2:] if wanted.startswith("./") else wanted
        if os.path.isabs(os.path.expanduser(said)):
            inside = os.path.relpath(os.path.realpath(os.path.expanduser(said)), self.root)
            wanted = wanted if inside.startswith("..") else inside
        p = F.col("path")
        found = [r["path"] for r in self.store.table("files").where((p == wanted) | p.endswith("/" + wanted)).select("path").orderBy(p != wanted, "path").limit(2).collect()]
        return found[0] if found and (found[0] == wanted or len(found) == 1) else None

    def explain(self, location: str) -> dict[str, Any]:
        """A file, a `file:line`, or else a search for what is written."""
        where = _said(location, "location")
        place, _, line = where.rpartition(":")
        choices = [(where, 0)]
        if place.endswith(PLACES):
            choices.append((place, int(line) if line.lstrip("-").isdigit() else 0))
        for name, at in choices:
            path = self.indexed_file(name)
            if path is not None:
                here = self.chunks().where(F.col("path") == path)
                if at > 0:
                    here = here.where((F.col("start_line") <= at) & (F.col("end_line") >= at))
                rows = here.withColumn("score", F.lit(1.0)).withColumn("source", F.lit("semantic")).orderBy("start_line", "id").collect()
                if rows:
                    return self._pack(where, rows)
        return self.resolve(where, 3)

    def graph_context(self, results: DataFrame) -> DataFrame:
        """Results with the first neighbour of their file each way."""
        _, edges = self.graph()
        return results.join(graph.graph_context(edges, results.select("path")), "path", "left").orderBy("rank")


def format_context(pack: dict[str, Any]) -> str:
    """A pack as text for a reader."""
    out = ["[{confidence:.2f}] {query}".format(**pack)]
    if pack["primary"]:
        out.append(f"  ({len(pack['primary'])} files)")
    out.append("")
    for n, r in enumerate(pack["primary"], 1):
        span = str(r["start_line"]) if r["start_line"] == r["end_line"] else f"{r['start_line']}-{r['end_line']}"
        out.append(f"  {n}. {r['path']}:{span}  [{r['score']:.2f}]")
        out += [f"     {line}" for line in r["content"].strip()[:300].split("\n")]
    if pack["symbols"]:
        out.append("  sym: " + " ".join([row["name"] for row in pack["symbols"]][:6] + ["..."] * (len(pack["symbols"]) > 6)))
    base = lambda paths: ", ".join(p.rsplit("/", 1)[-1] for p in paths[:2])
    hints = [f"{label}: {base(names)}" for label, names in (("tests", pack["test_files"]), ("deps", pack["imports"]), ("callers", [c["name"] for c in pack["callers"]])) if names]
    return "\n".join(out + (["  " + " | ".join(hints)] if hints else []))


def result_json(r: Row) -> dict[str, Any]:
    """A search result for JSON: score to four places, content to 500 characters."""
    fields = r.asDict()
    out = {"file": r["path"], "lines": f"{r['start_line']}-{r['end_line']}", "language": r["language"], "score": round(r["score"], 4), "source": r["source"], "content": r["content"][:500]}
    if "incoming" in fields:
        out["graph_context"] = {"key_symbol": "", "incoming": [x for x in [r["incoming"]] if x], "outgoing": [x for x in [r["outgoing"]] if x]}
    return out


def pack_json(pack: dict[str, Any], location: str | None = None, formatted: bool = False) -> dict[str, Any]:
    """A pack for JSON; with `location`, as the answer to `explain`."""
    head = {"query": pack["query"]} if location is None else {"location": location}
    keys = ["related_files", "test_files", "imports", "imported_by", "symbols", "callers", "callees", "dependency_chain", "total_tokens"]
    if location is not None:
        keys = [k for k in keys if k not in ("imports", "imported_by")]
    files = sorted({r["path"] for r in pack["primary"]})
    out = {**head, "primary_files": files, "confidence": pack["confidence"], **{k: pack[k] for k in keys}}
    return {**out, "formatted": format_context(pack)} if formatted else out


