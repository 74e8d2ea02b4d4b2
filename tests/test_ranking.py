"""Rules of ranking against values written down by hand, and whole searches against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from lantern.functions import text as tx
from lantern.operators import dense, lexical, ranking

PENALTIES = {
    "pkg/test_x.py": 0.3, "pkg/x_test.py": 0.3, "pkg/x_test.go": 0.3, "test_x.rs": 1.0, "AuthTest.java": 0.3, "AuthTests.java": 0.3, "a/b.spec.tsx": 0.3, "a/b.test.js": 0.3, "test_helpers_x.rb": 0.3, "test_helper.c": 0.3,
    "tests/a.c": 0.3, "a/__tests__/b.js": 0.3, "spec/a.rb": 0.3, "testing/a.go": 0.3, "mytests/a.go": 1.0, "a\\tests\\b.go": 0.3, "pkg/__init__.py": 0.5, "x/package-info.java": 0.5, "compat/a.py": 0.3, "a/_compat/b.py": 0.3,
    "legacy/a.ts": 0.3, "examples/a.rs": 0.3, "_example/a.rs": 0.3, "docs_src/a.py": 0.3, "doc_src/a.py": 0.3, "docs/a.py": 1.0, "a.d.ts": 0.7, "tests/__init__.py": 0.15, "legacy/tests/a.d.ts": 0.063, "a.py": 1.0,
}


def test_penalties(spark):
    rows = spark.createDataFrame([(p,) for p in PENALTIES], "p string").select("p", F.round(ranking.path_penalty(F.col("p")), 6).alias("x")).collect()
    assert {r["p"]: r["x"] for r in rows} == PENALTIES


def test_definitions(spark):
    yes = ["class Name:", "  def Name(x)", "defmodule Name do", "abstract class Name {", "data class Name(", "fun Name(", "fn Name<T>", "package Name;", "typedef Name", "type a.b::Name[", "x\nenum Name", "record Name\n", "protocol Name{", "trait Name"]
    no = ["Name()", "className", "class Names", "const Name =", "impl Name {", "let Name", "def name(", "macro Name", "undef Name", "def xName(", "class Name.other", None]
    rows = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", ranking.defines(F.col("t"), "Name").alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == {t: t in yes for t in yes + no}


def test_stems(spark):
    cases = [("my_class", "MyClass", True), ("myclass", "MyClass", True), ("classes", "classe", True), ("my_classs", "mycla", True), ("my_classs", "myclas", False), ("load_doc", "load_doc", True), ("loaddoc", "load_doc", False), ("other", "MyClass", False)]
    rows = spark.createDataFrame([(s,) for s, _, _ in cases], "s string")
    for s, n, want in cases:
        assert rows.where(F.col("s") == s).select(ranking.stem_matches(F.col("s"), n).alias("m")).first()["m"] == want, (s, n)
    begins = [("sess", "SessionStore", True), ("ses", "SessionStore", False), ("session_store", "SessionStore", True), ("se_ss", "SessionStore", True), ("sessionstores", "SessionStore", False)]
    for s, n, want in begins:
        assert spark.createDataFrame([(s,)], "s string").select(ranking.stem_begins(F.col("s"), n).alias("m")).first()["m"] == want, (s, n)


def test_kinds_of_queries():
    symbols = ["Session", "parse_csv", "a.b", "_x", "std::vector", "a->b", "a\\b", "camelCase", "X9"]
    plain = ["session", "how to parse", "a b", "", "x9", "éA", "naïve_x"]
    assert [ranking.is_symbol_query(q) for q in symbols] == [True] * len(symbols) and not any(ranking.is_symbol_query(q) for q in plain)
    assert ranking.symbol_names("pkg.mod.Name") == ["Name", "pkg.mod.Name"] and ranking.symbol_names(" Name ") == ["Name"] and ranking.symbol_names("a::b.c") == ["a::b.c", "b.c"]
    assert sorted(set(ranking.EMBEDDED.findall("where is HandlerStack, myFunc or HTTP and Session"))) == ["HandlerStack", "myFunc"]
    assert ranking.query_keywords("How does the my_func parse a CSV in it") == ["csv", "my_func", "parse"]
    assert ranking.exact_identifiers("find my_func and x2 or HandlerStack in Session") == ["HandlerStack", "my_func", "x2"]


def test_stem_shares(spark):
    keys = ["parser", "csv", "auth"]
    for path, n in (("pkg/csv_parser.py", 2), ("auth/x.py", 1), ("authentication/par.py", 2), ("a/pa.py", 0), ("parsers.py", 1), ("x.py", 0)):
        assert spark.createDataFrame([(path,)], "p string").select(ranking.stem_share(F.col("p"), keys).alias("s")).first()["s"] == pytest.approx(n / 3), path


def test_exact_hits_enter_above_the_best(spark):
    every = spark.createDataFrame([(1, "a.py", "my_func here", 2.0), (2, "b.py", "nothing", 1.0), (3, "c.py", "calls my_func", None), (4, "d.py", None, None)], "id long, path string, content string, score double")
    got = {r["id"]: (r["score"], r["exact"]) for r in ranking.flag_exact(every.where("score is not null"), "what is my_func", every.drop("score")).collect()}
    assert got == {1: (2.0, True), 2: (1.0, False), 3: (3.0, True)}


def test_nearest_of_hard_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [1.0, 1.0]), (6, [1.0, None]), (7, [1.0, 0.0]), (8, [-1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["id"], round(r["score"], 6)) for r in dense.nearest(v, [1.0, 0.0], 10).collect()]
    assert got == [(1, 1.0), (7, 1.0), (5, 0.707107), (4, 0.0), (8, -1.0)]
    assert [(r["rank"], r["id"]) for r in dense.ranked(v.withColumnRenamed("vec_id", "id"), [1.0, 2.0], 2, "id", "embedding").collect()] == [(1, 5), (2, 1)]
    n = dense.similarity(v.where("vec_id in (1, 2)"), v)
    assert n.count() == 16 and n.where("similarity is null").count() == 11


def test_columns_with_clashing_names(spark):
    rows = [(1, "a.py", 1, 5, 1, 2.0), (2, "a.py", 2, 3, 2, 1.0)]
    c = spark.createDataFrame(rows, "id long, path string, start_line int, end_line int, rank int, score double").withColumns({n: F.lit(9) for n in ("o_path", "o_rank", "sum", "first", "max", "most", "unit", "top")})
    assert [r["id"] for r in ranking.drop_contained(c).collect()] == [1]
    assert {r["id"]: round(r["score"], 6) for r in ranking.boost_coherent_files(c).collect()} == {1: 2.4, 2: 1.0} and ranking.boost_coherent_files(c).columns == c.columns


def plain_bm25(texts, query):
    import math
    from collections import Counter

    docs = {i: Counter(tx.tokens_of(t)) for i, t in texts.items()}
    n, avg = len(docs), sum(sum(c.values()) for c in docs.values()) / len(docs)
    out = {}
    for i, c in docs.items():
        for w in tx.tokens_of(query):
            if c[w]:
                df = sum(w in d for d in docs.values())
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[w] / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg))
    return {i: round(s, 9) for i, s in out.items()}


def test_bm25_both_ways(spark, tmp_path):
    rng = random.Random(8)
    words = ["alpha", "betaGamma", "gamma_delta", "HTTPServer", "x", "beta", "9lives"]
    texts = {i: " ".join(rng.choices(words, k=rng.randint(0, 30))) for i in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    query = "beta gamma_delta beta http"
    want = plain_bm25(texts, query)
    assert {r["id"]: round(r["score"], 9) for r in lexical.bm25_scores(docs, query).collect()} == want
    lexical.postings(docs).withColumn("bucket", lexical.bucket_of(F.col("term"))).write.partitionBy("bucket").parquet(f"{tmp_path}/p")
    index = spark.read.parquet(f"{tmp_path}/p")
    stats = lexical.lengths(docs).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    got = lexical.indexed_scores(index, query, stats["n"], stats["avgdl"])
    assert {r["id"]: round(r["score"], 9) for r in got.collect()} == want
    assert "PartitionFilters: [bucket" in got._jdf.queryExecution().toString() or "bucket" in got._jdf.queryExecution().toString()
    some = lexical.indexed_scores(index, query, stats["n"], stats["avgdl"], only=docs.where("doc_id < 5").selectExpr("doc_id AS id"))
    assert {r["id"]: round(r["score"], 9) for r in some.collect()} == {i: s for i, s in want.items() if i < 5}
    assert lexical.indexed_scores(index, "", 1, 1.0).count() == 0


def test_hash_vectors_both_ways(spark):
    from lantern.functions.vectors import hash_embedding

    docs = spark.createDataFrame([(1, "alpha betaGamma alpha"), (2, ""), (3, None), (4, "x_y z 9")], "doc_id long, text string")
    want = {r["doc_id"]: r["v"] for r in docs.select("doc_id", hash_embedding(tx.tokenize(F.col("text")), 8).alias("v")).collect()}
    assert {r["id"]: r["v"] for r in dense.hash_vectors(docs, 8).collect()} == want


def test_products_of_blocks(spark, monkeypatch):
    """All pairs, bit for bit, over several blocks of both sides; the join deals blocks and no row is folded value by value."""
    from lantern.functions.vectors import dot

    monkeypatch.setattr(dense, "BLOCK", 7)
    monkeypatch.setattr(dense, "PIECE", 11)
    rows = [(i, None if i % 13 == 0 else [float((i * 37 + d * 11) % 101) / 7 - 3 for d in range(0 if i % 17 == 0 else 5)]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = dense.similarity(v.where("vec_id % 3 = 0"), v)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan
    a, b = v.where("vec_id % 3 = 0").toDF("left", "a"), v.toDF("right", "b")
    want = a.crossJoin(b).select("left", "right", F.when(F.size("a") == F.size("b"), dot(F.col("a"), F.col("b"))).alias("similarity"))
    key = lambda r: (r["left"], r["right"])
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key) and got.count() == 1200


def test_quick_rounding(spark):
    from lantern import catalog

    values = [0.0, -1e-9, 0.5e-6, 1.5e-6, 2.5e-6, -2.5e-6, 0.1234565, 123456.7890125, 1e300, float("inf"), None, 1 / 3, -2 / 3, 4503.5996273705]
    c = spark.createDataFrame([(x,) for x in values], "x double").select(catalog._quick_r("x"), catalog._r("x", "want"))
    assert all(str(r["x"]) == str(r["want"]) for r in c.collect())


def test_postings_move_no_counts(spark):
    """Counts are made where texts are read; repeated ids are one document, null ids none."""
    docs = spark.createDataFrame([(1, "parse_csv parse HTTPServer parse"), (2, None), (3, ""), (4, "x y x")], "doc_id long, text string")
    once = lexical.postings(docs)
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    again = docs.unionByName(spark.createDataFrame([(4, "y z"), (None, "lost")], "doc_id long, text string"))
    for d in (docs, again):
        tf = lexical.terms(d).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
        want = tf.join(tf.groupBy("id").agg(F.sum("tf").alias("dl")), "id").select("id", "term", "tf", "dl")
        assert sorted(lexical.postings(d).collect()) == sorted(want.collect())
        counts = lexical.terms(d).groupBy("id").agg(F.count(F.lit(1)).alias("dl"))
        lens = d.select(F.col("doc_id").alias("id")).join(counts, "id", "left").select("id", F.coalesce("dl", F.lit(0)).alias("dl"))
        assert sorted(lexical.lengths(d).collect(), key=str) == sorted(lens.collect(), key=str)
