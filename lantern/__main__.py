"""Command line: index, status, search, resolve, explain, clear, watch, embed."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
from typing import Any

from lantern.plans.index import Progress

_ROOT_KEYS = "working_directory current_directory workspace_root project_root cwd root".split()


def resolve_root(details: str | None = None, root: str | None = None) -> str:
    """The folder meant by `root`, or by `details`: a path, JSON with one of six keys, or lines `key: value`; else the current one."""
    if root:
        path = os.path.realpath(os.path.expanduser(root))
        if not os.path.isdir(path):
            raise ValueError(f"not a folder: {path}")
        return path
    text = (details or "").strip()
    tried = [text]
    try:
        data = json.loads(text) if text else {}
        if isinstance(data, dict):
            tried += [data[k] for k in _ROOT_KEYS if isinstance(data.get(k), str) and data[k]][:1]
    except json.JSONDecodeError:
        pass
    for line in text.splitlines():
        key, sign, value = line.partition(":")
        if sign and "_".join(key.lower().strip(" -*").split()) in _ROOT_KEYS:
            tried.append(value.strip())
    for t in tried:
        if t and os.path.isdir(os.path.expanduser(t)):
            return os.path.realpath(os.path.expanduser(t))
    return os.path.realpath(os.getcwd())


class Bar:
    """Progress on standard error: redrawn on a terminal, a line every tenth otherwise."""

    def __init__(self, enabled: bool = True, stream=None):
        self.enabled, self.stream, self.said = enabled, stream or sys.stderr, ("", -1)

    def __call__(self, p: Progress) -> None:
        if not self.enabled:
            return
        left = p.elapsed * (1 - p.fraction) / p.fraction if 0 < p.fraction < 1 else 0.0
        line = f"[lantern] {p.phase} {p.percent}% {p.message}" + (f" ({left:.0f}s left)" if left else "")
        if self.stream.isatty():
            self.stream.write("\r\x1b[2K" + line + ("\n" if p.phase == "done" else ""))
        elif (p.phase, p.percent // 10) != self.said:
            self.stream.write(line + "\n")
        self.said = (p.phase, p.percent // 10)
        self.stream.flush()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lantern", description="Hybrid search over a source tree.")
    top.add_argument("-q", "--query", help="search, as the command of that name does")
    _common(top)
    _search(top)
    sub = top.add_subparsers(dest="command")
    for name, text in (("index", "build or update the index"), ("status", "state of the index"), ("search", "search"), ("resolve", "search with its context"), ("explain", "a file, file:line or symbol"), ("clear", "delete indexes"), ("watch", "keep the index up to date"), ("embed", "vectors of texts")):
        p = sub.add_parser(name, help=text)
        _common(p)
        if name in ("search", "resolve"):
            p.add_argument("text", help="the query")
            _search(p, 10 if name == "search" else 5)
        elif name == "explain":
            p.add_argument("text", help="the location")
        elif name == "clear":
            _switches(p, {"all": "delete all indexes of the tree", "dry-run": "only say what would go"})
        elif name == "embed":
            p.add_argument("texts", nargs="*")
            p.add_argument("--file", help="a text a line; - is standard input")
            p.add_argument("--dim", type=int)
            _switches(p, {"no-normalize": "lengths as they are"})
        if name in ("explain", "index", "clear"):
            _switches(p, {"force": "build again, or delete without asking"})
        if name == "explain":
            _switches(p, {"no-index": "the index as it is"})
    return top


def _switches(p: argparse.ArgumentParser, named: dict[str, str]) -> None:
    for name, text in named.items():
        p.add_argument(f"--{name}", action="store_true", help=text)


def _common(p: argparse.ArgumentParser) -> None:
    for name, text in (("environment-details", "where the tree is, in words"), ("root", "the tree's folder"), ("model", "a checkpoint's folder or short name; without one, an offline hash embedding")):
        p.add_argument(f"--{name}", help=text)
    p.add_argument("--include-text", help="index prose and data, too", default=None, action="store_true")
    p.add_argument("--fast", "-f", help="the 2-bit form of a model", action="store_true")
    _switches(p, {"plain": "text rather than JSON", "quiet": "no progress", "no-progress": "no progress"})


def _search(p: argparse.ArgumentParser, k: int = 10) -> None:
    for name, kind, default in (("top-k", int, k), ("alpha", float, None), ("min-score", float, 0.0)):
        p.add_argument(f"--{name}", type=kind, default=default)
    _switches(p, {"hybrid": "with graph neighbours of each file", "no-index": "search the index as it is", "force": "build the index again"})


def _spark():
    from pyspark.sql import SparkSession

    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    return SparkSession.builder.appName("lantern").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()


def _model(spark, name: str | None, fast: bool) -> Any:
    from lantern.operators import embedding

    if not name:
        return embedding.hash_model(spark)
    return embedding.StaticEmbedder(embedding.resolve_model_id(name, fast))


def plain_result(r: Any) -> str:
    f = r.asDict()
    around = "".join(f"  {sign}{f[k]}" for sign, k in (("<-", "incoming"), ("->", "outgoing")) if f.get(k))
    return f"{r['path']}:{r['start_line']}-{r['end_line']} score={r['score']:.4f} source={r['source']}{around}\n{r['content'][:500].rstrip()}\n"


def plain_pack(pack: dict[str, Any], location: str | None = None) -> str:
    from lantern.plans.engine import format_context

    files = sorted({r["path"] for r in pack["primary"]})
    names = lambda key: ", ".join(p.rsplit("/", 1)[-1] for p in pack[key][:5])
    if location is None:
        counts = "  ".join(f"{label}={len(pack[key])}" for label, key in (("primary", "primary"), ("related", "related_files"), ("tests", "test_files"), ("imports", "imports"), ("symbols", "symbols")))
        out = [format_context(pack), "", "confidence={confidence:.3f}  ".format(**pack) + counts]
    else:
        out = [f"=== explain: {location} ===", "confidence={confidence:.3f}".format(**pack)]
    out += [f"primary files: {', '.join(files)}"] if files else []
    out += [f"{label}: {names(key)}" for label, key in (("tests", "test_files"), ("imports", "imports"), ("imported_by", "imported_by")) if pack[key]]
    if location is None:
        out += ["symbols: " + " ".join([row["name"] for row in pack["symbols"]][:8])] if pack["symbols"] else []
        out += ["dep_chain: " + " -> ".join(p.rsplit("/", 1)[-1] for p in pack["dependency_chain"][:6])] if pack["dependency_chain"] else []
    else:
        for label, rows in (("symbols", pack["symbols"][:10]), ("callers", pack["callers"][:5]), ("callees", pack["callees"][:5])):
            out += ["", f"{label}:"] + ["  " + "{} {name}  {file}:{line}".format(row.get("kind", ""), **row).strip() for row in rows] if rows else []
    return "\n".join(out)


def clear(root: str, force: bool, dry_run: bool) -> int:
    """Delete all indexes of the tree's repository; asks on a terminal."""
    from lantern.sources.files import repo_root

    folder = os.path.join(repo_root(root) or root, ".lantern")
    if not os.path.isdir(folder):
        print(f"no indexes in {folder}")
    elif dry_run:
        print(f"would delete {folder}")
    elif not force and sys.stdin.isatty() and input(f"delete all indexes in {folder}? [y/N] ").strip().lower() not in ("y", "yes"):
        print("nothing deleted", file=sys.stderr)
        return 1
    else:
        shutil.rmtree(folder)
        print(f"deleted {folder}")
    return 0


def main(argv: list[str] | None = None) -> int:
    top = parser()
    a = top.parse_args(argv)
    command = a.command or ("search" if a.query else None)
    if command is None:
        top.print_help()
        return 2
    if command in ("search", "resolve"):
        if a.alpha is not None and not 0 <= a.alpha <= 1:
            top.error("--alpha must lie between 0 and 1")
        if a.min_score < 0 or a.top_k <= 0:
            top.error("--top-k must be positive and --min-score not negative")
    root = resolve_root(a.environment_details, a.root)
    if command == "clear":
        if not a.all:
            top.error("clear needs --all")
        return clear(root, a.force, a.dry_run)
    spark = _spark()
    if command == "embed":
        return _embed(spark, a)
    from lantern.plans.engine import Engine, pack_json, result_json

    engine = Engine(spark, root, _model(spark, a.model, a.fast))
    say = (lambda x: print(x)) if a.plain else (lambda x: print(json.dumps(x, indent=2, ensure_ascii=False)))
    if command == "status":
        s = engine.status()
        say("\n".join(f"{k}: {v}" for k, v in s.items()) if a.plain else s)
        return 0
    bar = Bar(not (a.quiet or a.no_progress))
    if command == "watch":
        from lantern.streaming.watch import watch

        engine.index(include_text=a.include_text, progress=bar)
        watch(engine, os.path.join(engine.folder, "watch")).awaitTermination()
        return 0
    if command == "index" or not getattr(a, "no_index", False):
        stats = engine.index(force=getattr(a, "force", False), include_text=a.include_text, progress=bar)
        if command == "index":
            say(f"{'up to date' if stats.up_to_date else 'ready'}: {stats.indexed_files} files, {stats.total_chunks} chunks ({stats.embedded_chunks} embedded, {stats.memo_hits} reused) in {stats.index_time_ms / 1000:.2f}s" if a.plain else stats.as_dict())
            return 0
    text = a.query if a.command is None else a.text
    if command == "search":
        found = engine.search(text, a.top_k, a.alpha, a.min_score)
        rows = (engine.graph_context(found) if a.hybrid else found).collect()
        say("\n".join(map(plain_result, rows)) if a.plain else [result_json(r) for r in rows])
    elif command == "resolve":
        pack = engine.resolve(text, a.top_k)
        say(plain_pack(pack) if a.plain else pack_json(pack, formatted=True))
    else:
        pack = engine.explain(text)
        say(plain_pack(pack, text) if a.plain else pack_json(pack, text))
    return 0


def _embed(spark, a) -> int:
    from lantern.operators import embedding

    texts = list(a.texts)
    if a.file:
        lines = sys.stdin.read().splitlines() if a.file == "-" else open(a.file, encoding="utf-8").read().splitlines()
        texts += [x for x in lines if x.strip()]
    if not texts:
        print("nothing to embed", file=sys.stderr)
        return 2
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    if a.model:
        out = embedding.embed(rows, embedding.load(embedding.resolve_model_id(a.model, a.fast)), normalize=not a.no_normalize, dim=a.dim)
    else:
        out = embedding.hash_model(spark, a.dim or 32).embed(rows)
    for r in out.orderBy("n").collect():
        print(json.dumps([round(float(x), 6) for x in r["embedding"]]) if a.plain else json.dumps({"text": r["text"], "embedding": [float(x) for x in r["embedding"]]}, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
