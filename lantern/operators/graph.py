"""A repository's symbols as two tables: nodes (files, functions, classes) and edges.

Python files are parsed by tasks into rows of facts (definitions, imports, calls); all
names are resolved by joins.  The order of files is the order of their paths: with
`so_far`, a name resolves only to files up to its own, as a single pass over them would;
without, to all.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions.text import file_name, stem
from lantern.plans.staging import staged

FACTS = "path string, ord int, what string, name string, extra string, line int, doc string"
#: Nodes that a called name may stand for.
CANDIDATES = 3


def _facts(path: str, source: str) -> list[tuple]:
    """(path, ord, what, name, extra, line, doc) in the order of a breadth-first walk: definitions, then imports, then calls."""
    try:
        nodes = list(ast.walk(ast.parse(source)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[tuple] = []

    def add(what: str, name: str, extra: str = "", line: int = 0, doc: str = "") -> None:
        out.append((path, len(out), what, name, extra, line, doc))

    for n in nodes:
        if isinstance(n, ast.ClassDef):
            add("define", n.name, "class", n.lineno, ast.get_docstring(n) or "")
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            add("define", n.name, "function", n.lineno, ast.get_docstring(n) or "")
    for n in nodes:
        if isinstance(n, ast.Import):
            for a in n.names:
                add("module", a.name.partition(".")[0])
        elif isinstance(n, ast.ImportFrom) and n.module is not None:
            add("module", n.module.partition(".")[0])
            for a in n.names:
                add("import", a.name)
    for n in nodes:
        if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute)):
            add("call", n.func.id if isinstance(n.func, ast.Name) else n.func.attr)
    return out


def python_facts(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """What Python files say, a row a fact; files that don't parse say nothing, null texts neither."""

    def run(batches):
        for b in batches:
            rows = [r for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if p is not None and t is not None for r in _facts(p, t)]
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in FACTS.split(", ")])

    return files.select(F.col(path).cast("string"), F.col(text).cast("string")).mapInArrow(run, FACTS)


def _file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def nodes_of(files: DataFrame, facts: DataFrame, path: str = "path") -> DataFrame:
    """(id, kind, name, path, line, docstring); of definitions of one name in a file the last stands."""
    own = files.select(F.col(path).alias("path")).where("path is not null").distinct()
    as_files = own.select(_file_id(F.col("path")).alias("id"), F.lit("file").alias("kind"), file_name(F.col("path")).alias("name"), "path", F.lit(0).alias("line"), F.lit("").alias("docstring"))
    last = facts.where("what = 'define'").groupBy("path", "name").agg(F.max_by(F.struct("extra", "line", "doc"), "ord").alias("d"))
    return as_files.unionByName(last.select(F.concat(F.lit("sym:"), "path", F.lit("::"), "name").alias("id"), F.col("d.extra").alias("kind"), "name", "path", F.col("d.line").alias("line"), F.col("d.doc").alias("docstring")))


def edges_of(files: DataFrame, facts: DataFrame, nodes: DataFrame, so_far: bool = True) -> DataFrame:
    """(src, dst, kind, weight, path, ord): DEFINES, IMPORTS, IMPORTS_FROM, REFERENCES and CALLS, parallel ones each.

    A module's first name leads to the file of that name at the root, else to the first
    file whose path ends in it.  An imported name leads to every node of that name.  A
    call leads to the first three nodes of its name in order of path and id, from the
    file that it is in; they are chosen before calls are joined, so that a name that is
    everywhere costs three rows a call.
    """
    ok = (lambda at: at <= F.col("path")) if so_far else (lambda at: F.lit(True))
    src = _file_id(F.col("path")).alias("src")

    def edge(dst: Column, kind: str, weight: float) -> list[Column]:
        return [src, dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"), F.col("path"), F.col("ord")]

    define = facts.where("what = 'define'").select(*edge(F.concat(F.lit("sym:"), "path", F.lit("::"), "name"), "DEFINES", 1.0))
    paths = nodes.where("kind = 'file'").select(F.col("path").alias("at")).where(F.col("at").endswith(".py"))
    name = F.regexp_replace(file_name(F.col("at")), r"\.py$", "")
    ends = paths.withColumn("stem", name).select("at", F.explode(F.transform(F.sequence(F.lit(1), F.length("stem")), lambda i: F.substring("stem", i, F.length("stem")))).alias("name")).where("name <> ''")
    asked = facts.where("what = 'module'").select("path", "ord", "name")
    # Of the files that end in a name: the one at the root, else the first.  One row a name, or one a name and file that may see it.
    best = F.min(F.struct((F.col("at") != F.concat("name", F.lit(".py"))).alias("elsewhere"), "at")).alias("best")
    if so_far:
        # The first path doesn't depend on who asks, except that it must not come later; so does the root's.
        first = ends.groupBy("name").agg(F.min("at").alias("first"), F.max(F.when(F.col("at") == F.concat("name", F.lit(".py")), F.col("at"))).alias("root"))
        hit = asked.join(first, "name").withColumn("best", F.when(F.col("root") <= F.col("path"), F.col("root")).when(F.col("first") <= F.col("path"), F.col("first"))).where("best is not null")
        module = hit.select(*edge(_file_id(F.col("best")), "IMPORTS", 1.0))
    else:
        module = asked.join(ends.groupBy("name").agg(best), "name").select(*edge(_file_id(F.col("best.at")), "IMPORTS", 1.0))
    named = nodes.select("name", F.col("id").alias("to"), F.col("path").alias("at"))
    imported = facts.where("what = 'import'").select("path", "ord", "name").join(named, "name").where(ok(F.col("at")) & (F.col("to") != _file_id(F.col("path")))).select(*edge(F.col("to"), "IMPORTS_FROM", 0.5))
    few = named.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("at", "to"))).where(F.col("nth") <= CANDIDATES)
    called = facts.where("what = 'call'").select("path", "ord", "name").join(few, "name").where(ok(F.col("at")))
    return define.unionByName(module).unionByName(imported).unionByName(called.select(*edge(F.col("to"), "REFERENCES", 0.3))).unionByName(called.select(*edge(F.col("to"), "CALLS", 0.3)))


def build(files: DataFrame, path: str = "path", text: str = "text", so_far: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the Python files; an edge's ends are always nodes."""
    files = files.where(F.col(path).endswith(".py"))
    facts = staged(python_facts(files, path, text), "graph-facts")
    nodes = staged(nodes_of(files, facts, path), "graph-nodes")
    return nodes, staged(edges_of(files, facts, nodes, so_far), "graph-edges")


def edges_from(edges: DataFrame, node: str, kind: str | None = None) -> DataFrame:
    return edges.where((F.col("src") == node) & (F.lit(kind is None) | (F.col("kind") == (kind or ""))))


def edges_to(edges: DataFrame, node: str, kind: str | None = None) -> DataFrame:
    return edges.where((F.col("dst") == node) & (F.lit(kind is None) | (F.col("kind") == (kind or ""))))


def neighbors(edges: DataFrame, node: str, kind: str | None = None, way: str = "out") -> DataFrame:
    """(id, kind) at the other ends of the node's edges in one direction, parallel ones each."""
    return edges_from(edges, node, kind).select(F.col("dst").alias("id"), "kind") if way == "out" else edges_to(edges, node, kind).select(F.col("src").alias("id"), "kind")


def file_node(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where((F.col("kind") == "file") & (F.col("path") == path))


def nodes_in_file(nodes: DataFrame, path: str) -> DataFrame:
    """The symbols of a file, not the file itself."""
    return nodes.where((F.col("kind") != "file") & (F.col("path") == path))


def nodes_by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("name") == name)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, n_files, n_functions and n_classes."""
    kinds = {"n_files": ["file"], "n_functions": ["function", "method"], "n_classes": ["class"]}
    of_nodes = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), *[F.count(F.when(F.col("kind").isin(*v), 1)).alias(k) for k, v in kinds.items()])
    return of_nodes.crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("n_edges")))).select("n_nodes", "n_edges", *kinds)  # one row each


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2, max_size: int | None = None, last_only: bool = False) -> DataFrame:
    """(id, hop): every node within `hops` out-edges of the seeds (column id), at its least distance.

    Each hop is staged, so none is computed twice.  `max_size` keeps the nearest, ties by
    id, and stops once that many are found; `last_only` returns the seeds and the last
    frontier alone.
    """
    steps = edges.select("src", "dst").distinct()
    seen = front = staged(seeds.select("id").where("id is not null").distinct().withColumn("hop", F.lit(0)), "graph-seeds")
    first = seen
    for h in range(1, hops + 1):
        found = front.join(steps, front["id"] == steps["src"]).select(F.col("dst").alias("id")).distinct()
        front = staged(found.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(h)), "graph-hop")
        seen = seen.union(front)
        if front.isEmpty() or (max_size is not None and seen.limit(max_size).count() >= max_size):
            break
    out = first.union(front) if last_only else seen
    return out if max_size is None else out.orderBy("hop", "id").limit(max_size)


def test_files(files: DataFrame, primary: DataFrame) -> DataFrame:
    """(path): files beside those of `primary` that are named as their tests, `test_x.s` or `x_test.s`."""
    p = F.col("path")
    folder = F.array_join(F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - 1), "/")
    prefix = F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise("")
    tail = F.substring(file_name(p), F.length(stem(p)) + 1, F.length(p))
    names = F.array(F.concat(prefix, F.lit("test_"), stem(p), tail), F.concat(prefix, stem(p), F.lit("_test"), tail))
    wanted = primary.select("path", F.explode(names).alias("want")).where("want <> path").select(F.col("want").alias("path")).distinct()
    return files.select("path").distinct().join(wanted, "path", "left_semi")


def _ends(edges: DataFrame, nodes: DataFrame, primary: DataFrame, kinds: list[str], here: str, there: str) -> DataFrame:
    """Edges of some kinds whose end `here` is a node of a primary file, with the node at the other end in another file."""
    mine = nodes.join(primary.select("path"), "path", "left_semi").select(F.col("id").alias(here), F.col("path").alias("own"), F.col("kind").alias("own_kind"))
    far = nodes.select(F.col("id").alias(there), F.col("path").alias("far"), F.col("name").alias("far_name"), F.col("line").alias("far_line"))
    return edges.where(F.col("kind").isin(*kinds)).join(mine, here).join(far, there)


def imports(nodes: DataFrame, edges: DataFrame, primary: DataFrame, way: str = "out") -> DataFrame:
    """(path): files outside `primary` that its files import, or (`in`) that import them."""
    here, there = ("src", "dst") if way == "out" else ("dst", "src")
    found = _ends(edges, nodes, primary, ["IMPORTS", "IMPORTS_FROM"], here, there).where("own_kind = 'file'")
    return found.select(F.col("far").alias("path")).distinct().join(primary.select("path"), "path", "left_anti")


def symbols(nodes: DataFrame, primary: DataFrame, most: int = 15) -> DataFrame:
    """(name, kind, file, line) of definitions in primary files, in order of file and line."""
    found = nodes.where("kind <> 'file'").join(primary.select("path"), "path", "left_semi")
    return found.select("name", "kind", F.col("path").alias("file"), "line").orderBy("file", "line", "name").limit(most)


def callers(nodes: DataFrame, edges: DataFrame, primary: DataFrame, most: int = 10, way: str = "in") -> DataFrame:
    """(name, file, line): for each symbol of the primary files the first call from another file; `out`, the first into one.

    Calls start at files, so callers are files, and symbols have no callees.
    """
    here, there = ("dst", "src") if way == "in" else ("src", "dst")
    found = _ends(edges, nodes, primary, ["CALLS"], here, there).where("own_kind <> 'file' and far <> own")
    first = found.groupBy(here).agg(F.min(F.struct("path", "ord", "far_name", "far", "far_line")).alias("f"))
    return first.select(F.col("f.far_name").alias("name"), F.col("f.far").alias("file"), F.col("f.far_line").alias("line"), F.col(here).alias("symbol")).orderBy("symbol").limit(most).drop("symbol")


def dependency_chain(nodes: DataFrame, edges: DataFrame, primary: DataFrame, depth: int = 1, most: int = 10) -> DataFrame:
    """(path): files that nodes within `depth` out-edges of the primary files lie in, other than those, nearest first."""
    seeds = nodes.where("kind = 'file'").join(primary.select("path"), "path", "left_semi").select("id")
    near = expand(edges, seeds, depth).where("hop > 0")
    found = near.join(nodes.select("id", "path"), "id").groupBy("path").agg(F.min("hop").alias("hop")).join(primary.select("path"), "path", "left_anti")
    return found.orderBy("hop", "path").limit(most).select("path")


def graph_context(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, incoming, outgoing): the last part of the name of the first neighbour each way, or null."""
    ids = paths.select("path").distinct().withColumn("id", _file_id(F.col("path")))

    def first(here: str, there: str, name: str) -> DataFrame:
        one = edges.join(ids.select(F.col("id").alias(here)), here, "left_semi").groupBy(here).agg(F.min_by(there, F.struct("path", "ord")).alias("n"))
        label = F.when(F.col("n").contains("::"), F.element_at(F.split("n", "::"), -1)).otherwise(F.element_at(F.split("n", ":"), -1))
        return one.select(F.col(here).alias("id"), label.alias(name))

    return ids.join(first("dst", "src", "incoming"), "id", "left").join(first("src", "dst", "outgoing"), "id", "left").select("path", "incoming", "outgoing")


