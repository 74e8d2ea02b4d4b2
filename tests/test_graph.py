import ast
import random

import pytest

from lantern.operators import graph

FILES = {
    "a.py": "import os\nfrom utils import helper, Thing\n\ndef run():\n    '''Runs.'''\n    return helper(Thing()).go()\n",
    "broken.py": "def (:\n",
    "lib/myutils.py": "def helper(x):\n    return x\n\nclass Inner:\n    def go(self):\n        return helper(self)\n",
    "lib/utils.py": "from . import x\nimport myutils.sub\n\nclass Thing:\n    class Deep:\n        def go(self):\n            pass\n    async def go(self):\n        return run()\n\ndef helper(x):\n    def helper():\n        pass\n    return helper\n",
    "test_a.py": "from a import run\n\ndef test_run():\n    assert run() and helper(1) and missing()\n",
    "a_test.py": "import a\n",
    "z.py": "from utils import run\nimport utils\nrun()\nhelper()\nhelper()\n",
}


def brute(files, so_far=True):
    """The same graph by one loop over files, in order of path."""
    nodes, edges, known = {}, [], []
    order = sorted(files) if so_far else None

    def name_of(i):
        return nodes[i][1]

    def add(i, kind, name, path, line=0):
        if i not in nodes:
            known.append(i)
        nodes[i] = (kind, name, path, line)

    trees = {}

    def first(path):
        add(f"file:{path}", "file", path.split("/")[-1], path)
        try:
            trees[path] = ast.parse(files[path])
        except SyntaxError:
            return
        for n in ast.walk(trees[path]):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                add(f"sym:{path}::{n.name}", "class" if isinstance(n, ast.ClassDef) else "function", n.name, path, n.lineno)
                edges.append((f"file:{path}", f"sym:{path}::{n.name}", "DEFINES"))

    def second(path):
        me = f"file:{path}"
        candidates = sorted(known, key=lambda i: (nodes[i][2], i))
        for n in ast.walk(trees[path]):
            if isinstance(n, ast.Import) or (isinstance(n, ast.ImportFrom) and n.module):
                for m in [x.name for x in n.names] if isinstance(n, ast.Import) else [n.module]:
                    want = m.split(".")[0] + ".py"
                    hits = [i for i in candidates if i == "file:" + want] or [i for i in candidates if i.endswith(want)]
                    edges.extend([(me, hits[0], "IMPORTS")] if hits else [])
                if isinstance(n, ast.ImportFrom):
                    for x in n.names:
                        edges.extend((me, i, "IMPORTS_FROM") for i in candidates if name_of(i) == x.name and i != me)
        for n in ast.walk(trees[path]):
            if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute)):
                called = n.func.id if isinstance(n.func, ast.Name) else n.func.attr
                for i in [i for i in candidates if name_of(i) == called][:3]:
                    edges.extend([(me, i, "REFERENCES"), (me, i, "CALLS")])

    if so_far:
        for p in order:
            first(p)
            if p in trees:
                second(p)
    else:
        for p in sorted(files):
            first(p)
        for p in sorted(trees):
            second(p)
    return nodes, edges


@pytest.mark.parametrize("so_far", [True, False])
def test_graph_by_a_loop(spark, so_far):
    rows = spark.createDataFrame([(p, t) for p, t in FILES.items()] + [("README.md", "import a"), ("none.py", None)], "path string, text string")
    nodes, edges = graph.build(rows, so_far=so_far)
    want_nodes, want_edges = brute({**FILES, "none.py": ""}, so_far)
    assert {r["id"]: (r["kind"], r["name"], r["path"], r["line"]) for r in nodes.collect()} == want_nodes
    assert sorted((r["src"], r["dst"], r["kind"]) for r in edges.collect()) == sorted(want_edges)
    s = graph.stats(nodes, edges).first()
    assert (s["n_nodes"], s["n_edges"], s["n_files"]) == (len(want_nodes), len(want_edges), 8)
    assert s["n_functions"] == sum(k == "function" for k, *_ in want_nodes.values()) and s["n_classes"] == sum(k == "class" for k, *_ in want_nodes.values())


def test_graph_lookups(spark):
    rows = spark.createDataFrame(list(FILES.items()), "path string, text string")
    nodes, edges = graph.build(rows)
    assert [r["docstring"] for r in graph.nodes_by_name(nodes, "run").collect()] == ["Runs."]
    assert graph.file_node(nodes, "a.py").first()["id"] == "file:a.py" and sorted(r["name"] for r in graph.nodes_in_file(nodes, "lib/utils.py").collect()) == ["Deep", "Thing", "go", "helper"]
    out = sorted(r["id"] for r in graph.neighbors(edges, "file:z.py", "CALLS").collect())
    assert out.count("sym:lib/myutils.py::helper") == 2 and graph.neighbors(edges, "sym:a.py::run", way="in").count() == edges.where("dst = 'sym:a.py::run'").count()
    assert graph.edges_from(edges, "file:z.py", "IMPORTS").count() == 2 and graph.edges_to(edges, "file:a.py").count() == 2
    primary = spark.createDataFrame([("a.py",)], "path string")
    assert sorted(r["path"] for r in graph.test_files(rows, primary).collect()) == ["a_test.py", "test_a.py"]
    assert sorted(r["path"] for r in graph.imports(nodes, edges, primary, "in").collect()) == ["a_test.py", "test_a.py"]  # z.py imports a symbol, not the file
    assert [r["path"] for r in graph.dependency_chain(nodes, edges, spark.createDataFrame([("z.py",)], "path string")).collect()] == ["a.py", "lib/myutils.py", "lib/utils.py"]
    assert [(r["name"], r["line"]) for r in graph.symbols(nodes, primary).collect()] == [("run", 4)]
    assert [(r["name"], r["file"], r["line"]) for r in graph.callers(nodes, edges, primary).collect()] == [("utils.py", "lib/utils.py", 0)] and graph.callers(nodes, edges, primary, way="out").isEmpty()
    ctx = {r["path"]: (r["incoming"], r["outgoing"]) for r in graph.graph_context(edges, spark.createDataFrame([("a.py",), ("lib/utils.py",), ("no.py",)], "path string")).collect()}
    assert ctx == {"a.py": ("a_test.py", "run"), "lib/utils.py": ("z.py", "Thing"), "no.py": (None, None)} or ctx["no.py"] == (None, None)


def test_expand_like_a_search_by_breadth(spark):
    rng = random.Random(6)
    pairs = [(f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 40)}") for _ in range(60)]
    edges = spark.createDataFrame([(a, b, "E") for a, b in pairs + pairs[:5]], "src string, dst string, kind string")
    seeds = spark.createDataFrame([("n1",), ("n2",), ("n2",), (None,)], "id string")
    want, front = {"n1": 0, "n2": 0}, {"n1", "n2"}
    for h in (1, 2, 3):
        front = {b for a, b in pairs if a in front} - want.keys()
        want |= {b: h for b in front}
    assert {r["id"]: r["hop"] for r in graph.expand(edges, seeds, 3).collect()} == want
    cut = [(r["hop"], r["id"]) for r in graph.expand(edges, seeds, 3, max_size=5).orderBy("hop", "id").collect()]
    assert cut == sorted((h, i) for i, h in want.items())[:5]
    two = {i: h for i, h in want.items() if h in (0, 2)}
    assert {r["id"]: r["hop"] for r in graph.expand(edges, seeds, 2, last_only=True).collect()} == two
    assert graph.expand(edges.limit(0), seeds, 2).count() == 2
