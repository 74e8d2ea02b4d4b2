import json
import os
import time

import pytest

from lantern import __main__ as cli
from lantern.operators.embedding import hash_model
from lantern.plans import tools
from lantern.plans.engine import Engine, format_context, pack_json
from lantern.streaming import watch

AUTH = 'def verify_token(token):\n    """Check a JWT token."""\n    return token.startswith("ey")\n'
PARSER = 'def parse_csv(text):\n    """Parse a CSV file."""\n    return [line.split(",") for line in text.splitlines()]\n'


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    for folder in ("pkg", ".git"):
        os.makedirs(root / folder)
    (root / "pkg/auth.py").write_text(AUTH)
    (root / "pkg/parser.py").write_text(PARSER)
    (root / "README.md").write_text("Demo of tokens\nand tables.\n")
    return root


@pytest.fixture
def engine(spark, tree):
    return Engine(spark, str(tree), hash_model(spark))


def test_first_run_search_and_reload(spark, tree, engine):
    assert engine.status()["status"] == "empty" and engine.search("x").count() == 0 and not engine.load()
    seen = []
    stats = engine.index(progress=seen.append)
    assert (stats.indexed_files, stats.total_chunks, stats.languages) == (2, 2, {"python": 2})
    assert (stats.embedded_chunks, stats.memo_hits, stats.memo_misses, stats.changed_files, stats.up_to_date) == (2, 0, 2, 2, False)
    phases = [p.phase for p in seen]
    assert phases[0] == "scan" and phases[-1] == "done" and set("bm25 chunk embed model save".split()) <= set(phases) and seen[-1].percent == 100
    rows = engine.search("verify a JWT token", top_k=2).collect()
    assert rows[0]["path"] == "pkg/auth.py" and all(r["score"] > 0 for r in rows) and rows[0]["language"] == "python"
    again = Engine(spark, str(tree), hash_model(spark))
    assert again.load() and again.search("parse_csv").first()["path"] == "pkg/parser.py" and again.find_symbol("parse_csv").first()["path"] == "pkg/parser.py"
    first = rows[0]["id"]
    assert first not in [r["id"] for r in again.find_related(first).collect()] and again.find_related("none").count() == 0
    s = again.status()
    assert s["status"] == "ready" and s["total_chunks"] == 2 and s["index_exists"] and s["last_indexed_at"].endswith("+00:00")
    assert [r["path"] for r in again.search("token csv", only=again.chunks().where("path = 'pkg/parser.py'")).collect()] == ["pkg/parser.py"]
    for bad in ({"query": " "}, {"query": "x", "top_k": 0}, {"query": "x", "alpha": 2.0}):
        with pytest.raises(ValueError):
            again.search(**bad)
    assert again.clear() and again.status()["status"] == "empty"


def test_reconciliation(spark, tree, engine):
    engine.index()
    s = engine.index()
    assert s.up_to_date and s.memo_hits == s.total_chunks == 2 and s.memo_misses == s.embedded_chunks == 0
    (tree / "pkg/auth_copy.py").write_text(AUTH)
    s = engine.index()
    assert s.memo_hits >= 1 and s.embedded_chunks == 0 and s.total_chunks == 3 and s.changed_files == 1
    (tree / "pkg/auth.py").write_text("# note\n" + AUTH)
    assert engine.index().total_chunks == 3
    assert "# note" in "".join(r["content"] for r in engine.chunks().collect())
    (tree / "pkg/auth.py").write_text(AUTH)
    s = engine.index()
    assert s.total_chunks == 3 and s.embedded_chunks == 0
    os.remove(tree / "pkg/auth_copy.py")
    assert [tuple(r) for r in engine.changes().collect()] == [("pkg/auth_copy.py", "removed")]
    s = engine.index()
    assert (s.removed_files, s.total_chunks) == (1, 2) and engine.changes().isEmpty()
    ids = {r["id"] for r in engine.chunks().collect()}
    assert {r["id"] for r in engine.store.table("postings").select("id").distinct().collect()} == ids
    fresh = Engine(spark, str(tree), hash_model(spark), folder=str(tree.parent / "other"))
    fresh.index()
    key = lambda e: sorted(map(tuple, e.store.table("postings").select("id", "term", "tf", "dl").collect()))
    assert key(fresh) == key(engine) and fresh.store.state["avgdl"] == engine.store.state["avgdl"]
    s = engine.index(include_text=True)
    assert s.languages == {"python": 2, "markdown": 1} and engine.include_text and engine.index().up_to_date
    assert engine.index(force=True).embedded_chunks == s.total_chunks
    versions = [d for d in os.listdir(engine.folder) if d.startswith("v0")]
    assert len(versions) == 2


def test_a_run_that_fails_keeps_the_index(tree, engine):
    engine.index()
    (tree / "pkg/new.py").write_text("x = 1\n")
    good, engine.model.embed = engine.model.embed, lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):
        engine.index()
    assert engine.status()["status"] == "error" and engine.search("parse_csv").first()["path"] == "pkg/parser.py" and not engine.is_indexing
    engine.model.embed = good
    assert engine.index().total_chunks == 3 and engine.status()["status"] == "ready"


def test_resolve_and_explain(tree, engine):
    (tree / "main.py").write_text("from auth import verify_token\nfrom parser import parse_csv\n\ndef main():\n    return verify_token('x'), parse_csv('a')\n")
    (tree / "pkg/test_auth.py").write_text("def test_it():\n    assert verify_token('ey')\n")
    assert engine.resolve("verify") if engine.index_exists else engine.explain("verify")["primary"] == []
    engine.index()
    for where in ("pkg/auth.py", "pkg/auth.py:2", "./pkg/auth.py", str(tree / "pkg/auth.py"), "auth.py", "pkg\\auth.py"):
        pack = engine.explain(where)
        assert {r["path"] for r in pack["primary"]} == {"pkg/auth.py"} and pack["confidence"] == 1.0
    assert pack["test_files"] == ["pkg/test_auth.py"] and pack["symbols"] == [{"name": "verify_token", "kind": "function", "file": "pkg/auth.py", "line": 1}]
    assert [c["file"] for c in pack["callers"]] == ["pkg/test_auth.py"] and pack["callees"] == [] and pack["total_tokens"] == len(AUTH) // 4
    pack = engine.explain("main.py")
    assert pack["imports"] == []  # main comes before pkg in order, so its names aren't known yet
    assert engine.indexed_file("nothing.py") is None and engine.indexed_file("py") is None
    pack = engine.resolve("verify_token")
    assert pack["query"] == "verify_token" and pack["primary"][0]["exact"] and "pkg/auth.py" in pack["related_files"]
    text = format_context(pack)
    assert text.startswith(f"[{pack['confidence']:.2f}] verify_token") and "sym: " in text
    assert set(pack_json(pack)) >= {"query", "primary_files", "imports", "callees"} and "location" in pack_json(pack, "x")
    assert engine.explain("verify_token")["primary"]
    with pytest.raises(ValueError):
        engine.explain(" ")


def test_tools(engine):
    assert sorted(tools.TOOLS) == "explain reindex resolve search status".split()
    assert tools.reindex(engine, force=True, include_text=True)["total_chunks"] == 3
    found = tools.search(engine, "parse_csv", 3)
    assert found["count"] == len(found["results"]) and found["results"][0]["file"] == "pkg/parser.py" and found["results"][0]["start_line"] == 1
    assert tools.resolve(engine, "parse_csv")["formatted"] and tools.explain(engine, "pkg/auth.py")["confidence"] == 1.0 and tools.status(engine)["status"] == "ready"
    json.dumps([found, tools.resolve(engine, "csv"), tools.status(engine)])
    for bad in (("", 1), ("x", 0), ("x", 101), ("x", 1, -1.0)):
        with pytest.raises(ValueError):
            tools.search(engine, *bad)


def test_command_line(tree, capsys, monkeypatch):
    run = lambda *a: (cli.main([*a, "--root", str(tree)]), capsys.readouterr().out)
    code, out = run("index", "--quiet")
    assert code == 0 and json.loads(out)["total_chunks"] == 2
    assert json.loads(run("search", "parse_csv", "--quiet", "--hybrid")[1])[0]["graph_context"]["outgoing"] == ["parse_csv"]
    assert "pkg/parser.py:1-3 score=" in run("-q", "parse_csv", "--plain", "--quiet")[1]
    assert json.loads(run("status")[1])["status"] == "ready" and "status: ready" in run("status", "--plain")[1]
    assert json.loads(run("resolve", "parse_csv", "--no-index")[1])["primary_files"] and "=== explain: pkg/auth.py ===" in run("explain", "pkg/auth.py", "--no-index", "--plain")[1]
    assert "confidence=" in run("resolve", "parse_csv", "--no-index", "--plain")[1]
    with pytest.raises(SystemExit):
        run("search", "x", "--alpha", "2")
    with pytest.raises(SystemExit):
        run("clear")
    assert "would delete" in run("clear", "--all", "--dry-run")[1] and "deleted" in run("clear", "--all", "--force")[1] and "no indexes" in run("clear", "--all")[1]
    assert len(json.loads(run("embed", "a text", "--dim", "16")[1])["embedding"]) == 16
    monkeypatch.chdir(tree)
    assert cli.resolve_root() == cli.resolve_root(json.dumps({"cwd": str(tree)})) == cli.resolve_root(f"OS: x\nWorking directory: {tree}") == cli.resolve_root(str(tree)) == os.path.realpath(tree)
    with pytest.raises(ValueError):
        cli.resolve_root(root=str(tree / "none"))


def test_watch(spark, tree, engine, tmp_path):
    engine.index()
    old = watch.hashes(str(tree), False)
    assert sorted(old) == ["pkg/auth.py", "pkg/parser.py"] and watch.changes(old, old) == []
    (tree / "pkg/auth.py").write_text("# x\n" + AUTH)
    os.remove(tree / "pkg/parser.py")
    (tree / "pkg/z.py").write_text("z = 1\n")
    assert [(p, c) for p, c, _ in watch.changes(old, watch.hashes(str(tree), False))] == [("pkg/auth.py", "changed"), ("pkg/parser.py", "removed"), ("pkg/z.py", "added")]
    q = watch.watch(engine, str(tmp_path / "w"), poll_seconds=0.2, debounce=0.1, min_interval=0.1)
    try:
        def until(what):
            for _ in range(300):
                if what():
                    return True
                time.sleep(0.2)
            return False

        paths = lambda: {r["path"] for r in engine.chunks().select("path").distinct().collect()}
        assert until(lambda: paths() == {"pkg/auth.py", "pkg/z.py"})
        os.remove(tree / "pkg/z.py")
        (tree / "pkg/y.py").write_text("y = 1\n")
        assert until(lambda: paths() == {"pkg/auth.py", "pkg/y.py"})
    finally:
        q.stop()


def test_reconciliation_writes_texts_once(spark, tree, tmp_path, monkeypatch):
    """Texts go where they stay and are not staged elsewhere; joins with many keys and with few agree; equal chunks of the same lines are one."""
    from lantern.plans import index as ix

    names = []
    monkeypatch.setattr(ix, "staged", lambda df, name, put=ix.staged: (names.append(name), put(df, name))[1])
    (tree / "pkg/twice.py").write_text(("x = 1" * 500 + "\x0b") * 2 + "y = 2\n")
    engines = [Engine(spark, str(tree), hash_model(spark), folder=str(tmp_path / f"i{i}")) for i in range(3)]
    for e in engines[:2]:
        e.index()
    assert "index-once" in names and set(names) <= {"index-diff", "index-split", "index-once"}
    del names[:]
    (tree / "pkg/auth.py").write_text("# note\n" + AUTH)
    (tree / "pkg/auth_copy.py").write_text("# note\n" + AUTH)
    os.remove(tree / "pkg/twice.py")
    stats = []
    for e, few in zip(engines, (ix.FEW, 0, ix.FEW)):
        monkeypatch.setattr(ix, "FEW", few)
        s = e.index()
        stats.append((s.total_chunks, s.memo_hits, s.memo_misses, s.embedded_chunks, s.changed_files, s.removed_files))
    assert stats == [(3, 0, 2, 1, 2, 1)] * 2 + [(3, 0, 3, 2, 3, 0)] and set(names) == {"index-diff", "index-split"}
    rows = lambda e: [sorted(map(tuple, e.store.table(t).collect()), key=str) for t in ("files", "chunks", "vectors", "postings")]
    assert rows(engines[0]) == rows(engines[1]) == rows(engines[2])
    assert all(len([d for d in os.listdir(e.folder) if d.startswith("v0")]) <= 2 for e in engines)
