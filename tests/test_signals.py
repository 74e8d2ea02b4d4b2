import re

import pytest
from pyspark.sql import functions as F

from lantern.operators import signals as sg


def one(spark, col, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v) if not isinstance(v, (list, dict)) else F.expr(v) if isinstance(v, str) else (F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.create_map(*[F.lit(x) for kv in v.items() for x in kv])))
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("query,path,want", [("axis", "plot/test_axis.py", 1.0), ("axis color", "axis.py", 0.5), ("my_func", "my_func.py", 0.0), ("", "a.py", 0.0), ("py", "a.PY", 1.0)])
def test_filename(spark, query, path, want):
    assert one(spark, sg.filename_score(query, F.col("p")), p=path) == want


@pytest.mark.parametrize("query,path,want", [("tests", "a/tests/b.py", 1.0), ("data base", "data_base/x.py", 1.0), ("b", "a/b.py", 0.0), ("x", "b.py", 0.0)])
def test_path(spark, query, path, want):
    assert one(spark, sg.path_score(query, F.col("p")), p=path) == want


def test_symbols_and_idf(spark):
    s = lambda query, syms, text: one(spark, sg.symbol_score(query, F.col("s"), F.col("t")), s=syms, t=text)
    assert s("load doc", ["sym:a.py::load_doc", "sym:a.py::x"], "") == 1.0 and s("load doc", ["sym:a.py::load"], "load doc now") == 0.5 and s("load doc", [], "doc") == 0.25 and s("", ["a"], "b") == 0.0
    i = lambda query, m: one(spark, sg.idf_score(query, F.col("m")), m=m)
    assert i("a b", {"a": 5.0, "c": 1.0}) == pytest.approx(0.5) and i("a a", {"a": 20.0}) == 1.0 and i("", {"a": 1.0}) == 0.0


def test_graph_and_imports(spark):
    files = spark.createDataFrame([(x,) for x in "abcdef"], "path string")
    adjacency = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "a")], "path string, other string")
    seeds = spark.createDataFrame([("a",)], "path string")
    assert {r["path"]: r["graph"] for r in sg.graph_scores(files, adjacency, seeds).collect()} == {"a": 0, "b": 1, "c": 0.5, "d": 0, "e": 0, "f": 0}
    imports = spark.createDataFrame([("a", "os"), ("b", "os"), ("b", "a"), ("c", "a"), ("d", "re"), ("e", "re"), ("e", "os")], "path string, target string")
    two = spark.createDataFrame([("a",), ("d",)], "path string")
    got = {r["path"]: round(r["import_rel"], 6) for r in sg.import_scores(files, imports, two).collect()}
    assert got == {"a": 0, "b": 0.4, "c": 0.3, "d": 0, "e": 0.2, "f": 0}


def test_weights(spark):
    cols = {"embedding": F.lit(1.5), "filename": F.lit(0.5), "graph": F.lit(None).cast("double")}
    assert spark.range(1).select(sg.combined(cols).alias("x")).first()["x"] == pytest.approx(0.40 + 0.075)
    w = sg.Weights(embedding=1, filename=1, path=0, symbol=0, graph=0, import_rel=0, idf=0)
    assert spark.range(1).select(sg.combined(cols, w).alias("x")).first()["x"] == pytest.approx(0.75)


def test_context_search_like_a_loop(spark):
    texts = {"pkg/auth.py": "def verify(token)", "pkg/parser.py": "parse csv", "tests/test_auth.py": "verify tests", "pkg/util.py": "helper", "far/other.py": "nothing", "pkg/auth_test.py": "auth test"}
    rows = [(f"{p}#{k}", p, t, [float(len(re.findall(w, t))) for w in ("verify", "csv", "helper")]) for p, t in texts.items() for k in range(2)]
    c = sg.Corpus(
        spark.createDataFrame(rows, "id string, path string, content string, vector array<double>"),
        symbols=spark.createDataFrame([("pkg/auth.py", "sym:pkg/auth.py::verify")], "path string, name string"),
        adjacency=spark.createDataFrame([("pkg/auth.py", "pkg/util.py"), ("pkg/auth.py", "gone.py")], "path string, other string"),
        imports=spark.createDataFrame([("pkg/util.py", "os"), ("pkg/auth.py", "os")], "path string, target string"),
        idf=spark.createDataFrame([("pkg/auth.py", {"verify": 2.0})], "path string, idf map<string,double>"),
    )
    primary, related = sg.context_search(c, "verify auth", [1.0, 0.0, 0.0], top_dense=2, top_final=1)
    p = primary.collect()
    assert [(r["rank"], r["path"], r["id"]) for r in p] == [(1, "pkg/auth.py", "pkg/auth.py#0")]
    want = 0.40 * 1 + 0.15 * 0.5 + 0.15 * 0.5 + 0.05 * (2.0 / 2 / 5)
    assert p[0]["score"] == pytest.approx(want) and p[0]["components"]["symbol"] == 0.5
    got = {r["path"]: r["score"] for r in related.collect()}
    assert got.keys() == {"pkg/util.py", "tests/test_auth.py", "pkg/auth_test.py"}
    assert got["pkg/util.py"] == pytest.approx(0.10 * 1 + 0.05 * 0.1) and got["pkg/auth_test.py"] == pytest.approx(0.15 * 0.5 + 0.15 * 0.25)
    text = sg.to_text("verify auth", p, related.collect())
    assert "### pkg/auth.py (score:" in text and "Signals: embedding=1.00" in text and "## Related files" in text
    assert sg.context_search(c, "verify", [1.0, 0.0, 0.0], expand=False)[1].count() == 0
    best = spark.createDataFrame([("f", 1, 0.5), ("f", 2, 0.9), ("f", 0, 0.9), ("g", 3, -1.0)], "path string, id long, score double")
    assert sorted(map(tuple, sg.best_per_file(best).collect())) == [("f", 0, 0.9), ("g", 3, -1.0)]
