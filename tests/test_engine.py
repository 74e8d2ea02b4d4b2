import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lantern import catalog
from lantern.functions import text as tx
from lantern.operators import chunking, lexical, ranking

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["tok_identifiers", "enrich_path", "bm25_topk", "vec_topk_filtered", "file_coherence", "definition_match", "saturation_rerank", "containment_dedup", "snapshot_diff", "graph_expand"])
def test_same_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.ORACLE_SQL[name]).fetchdf()[list(got.columns)]
    assert sorted(map(repr, got.to_dict("records"))) == sorted(map(repr, want.to_dict("records")))


def test_tokens_on_driver_and_in_columns(spark):
    words = ["HTTPServer", "parse_csv2", "__init__", "camelCase", "x", "ABC", "getHTTPResponse9", "a_b"]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select("t", tx.tokenize(F.col("t")).alias("k")).collect()
    for r in rows:
        assert list(r["k"]) == tx.tokens_of(r["t"]), r["t"]


def test_line_chunks_like_a_loop(spark):
    rng = random.Random(3)
    texts = ["".join("x" * rng.randint(0, 30) + "\n" for _ in range(rng.randint(0, 20))) + "end" * rng.randint(0, 2) for _ in range(40)] + ["", "\n\n"]
    docs = spark.createDataFrame([(i, t, "p.py") for i, t in enumerate(texts)], "doc_id long, text string, path string")
    got = {}
    for r in chunking.line_chunks(docs, size=50).collect():
        got.setdefault(r["id"], []).append((r["start_line"], r["end_line"], r["content"]))
    for i, t in enumerate(texts):
        want, cur, at = [], "", 1
        for u in t.splitlines(keepends=True):
            if cur and len(cur) + len(u) > 50:
                want.append(cur)
                cur = ""
            cur += u
        want += [cur] if cur else []
        rows = []
        for c in want:
            if c.strip():
                rows.append((at, at + c[:-1].count("\n"), c))
            at += c.count("\n")
        assert sorted(got.get(i, [])) == rows


def test_saturation_like_a_greedy_loop(spark):
    rng = random.Random(5)
    rows = [(i, f"f{rng.randint(0, 4)}", rng.random()) for i in range(60)]
    got = [(r["id"], round(r["score"], 9)) for r in ranking.saturate(spark.createDataFrame(rows, "id long, path string, score double"), 15).collect()]
    left, seen, out = sorted(rows, key=lambda r: (-r[2], r[0])), {}, []
    for i, p, s in left:
        out.append((i, s * 0.5 ** seen.get(p, 0)))
        seen[p] = seen.get(p, 0) + 1
    assert got == [(i, round(s, 9)) for i, s in sorted(out, key=lambda r: (-r[1], r[0]))[:15]]


def test_query_kinds():
    assert [ranking.is_symbol_query(q) for q in ("Session", "session", "parse_csv", "a.b", "how to parse", "_x")] == [True, False, True, True, False, True]
    assert ranking.resolve_alpha("Session") == 0.3 and ranking.resolve_alpha("open a file") == 0.75
    with pytest.raises(ValueError):
        ranking.resolve_alpha("x", 1.5)


def test_empty_query_and_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lexical.bm25_scores(docs, "").count() == 0
    assert lexical.bm25_scores(docs, "word").count() == 0


def test_containment_of_every_order(spark, tmp_path):
    """Order keys of any size get a decision."""
    lines = [(key, rank, part, supp) for key in (1, 1999, 2000, 600_000) for rank, part, supp in ((1, 3, 9), (2, 5, 2), (3, 40, 1))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted((r["path"], r["rank"]) for r in catalog.containment_dedup(spark, str(tmp_path)).collect())
    assert got == [(key, rank) for key in (1, 1999, 2000, 600_000) for rank in (1, 3)]


def test_definitions_in_every_document(spark, tmp_path):
    """One row a document; definitions in plain text count, the names alone don't."""
    texts = {0: "a\ndef load_doc_1(x):", 1: "prose", 2: "prose", 3: "class LoadDoc2 {", 4: "load_doc_1 and DocRow5 in prose", 5: "prose", 6: "def load_doc_10(x):", 7: "pub struct m::DocRow5;"}
    spark.createDataFrame([(i, t, "s", "en") for i, t in texts.items()], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["one"], r["two"], r["three"]) for r in catalog.definition_match(spark, str(tmp_path)).collect()}
    assert got == {i: (i in (0, 1), i in (2, 3), i in (5, 7)) for i in texts}


def test_term_statistics_of_every_term(spark, tmp_path):
    """Terms of one document are there as well as common ones, with N and the mean length."""
    texts = [" ".join(f"w{chr(97 + i)}{chr(97 + k)}" for k in range(26)) + " common common" for i in range(8)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["term"]: (r["df"], r["cf"]) for r in catalog.bm25_term_stats(spark, str(tmp_path)).collect()}
    assert got == {w: (1, 1) for t in texts for w in t.split() if w != "common"} | {"common": (8, 16)}
    assert [tuple(r) for r in catalog.bm25_corpus_stats(spark, str(tmp_path)).collect()] == [(8, 28.0)]


def test_definers_outside_the_candidates(spark, duck):
    """They enter with their gain if their file is named after the symbol; the query still equals its SQL."""
    rows = [(1, "a/x.py", "def load_doc(p):", 2.0), (2, "a/load_doc.py", "no definition", 1.0), (3, "b/load_doc.py", "def load_doc(p):", None), (4, "b/y.py", "def load_doc(p):", None), (5, "b/loaddoc.py", "load_doc()", None)]
    every = spark.createDataFrame(rows, "id long, path string, content string, score double")
    unit = 3.0 * F.max("score").over(ranking.everything())
    got = ranking.boost_definitions(every.where("score is not null"), ["load_doc"], unit, chunks=every.drop("score")).collect()
    assert sorted((r["id"], r["score"]) for r in got) == [(1, 8.0), (2, 1.0), (3, 9.0)]
    mine = catalog.definition_boost(spark, SF).collect()
    assert sorted(tuple(r) for r in mine) == sorted(duck.execute(catalog.ORACLE_SQL["definition_boost"]).fetchall())
