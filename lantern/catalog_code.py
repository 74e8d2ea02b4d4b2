"""Queries of the engine's sources, graph, signals and index over a data folder, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern import catalog as base
from lantern.functions import languages
from lantern.operators import chunking, dense, graph, lexical, ranking, signals
from lantern.operators.embedding import hash_model
from lantern.plans import index as ix
from lantern.plans.staging import shared_folder
from lantern.sources import ignore

table = base.table

# Sources: paths of a tree, derived from documents.

_TREE = """CASE doc_id % 12 WHEN 0 THEN concat('src/m', doc_id, '.py') WHEN 1 THEN concat('src/m', doc_id, '.log') WHEN 2 THEN concat('src/keep', doc_id % 24, '.log') WHEN 3 THEN concat('build/m', doc_id, '.py')
 WHEN 4 THEN concat('src/gen/m', doc_id, '.py') WHEN 5 THEN concat('docs/m', doc_id, '.md') WHEN 6 THEN concat('lib/sub/m', doc_id, '.go') WHEN 7 THEN concat('lib/sub/deep/m', doc_id, '.py') WHEN 8 THEN concat('node_modules/p', doc_id, '/index.js')
 WHEN 9 THEN concat('Makefile', doc_id) WHEN 10 THEN concat('src/.hidden', doc_id) ELSE concat('web/App', doc_id, '.TSX') END"""
_RULES = ["*.log", "!keep2.log", "gen/", "/lib/sub/*.go", "# comment", "", "docs/**"]


def walk_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Which files of a tree with an ignore file are indexed, prose included."""
    paths = table(spark, sf, "documents").selectExpr("doc_id", f"{_TREE} AS path")
    rules = ignore.rules(list(ignore.DEFAULT_DIRS)) + ignore.rules(_RULES)
    return paths.select("doc_id", "path", ignore.selected(F.col("path"), rules, languages.extensions(True)).alias("indexed"))


def languages_of_files(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every path, null without one, and whether it is prose or data."""
    paths = table(spark, sf, "documents").selectExpr("doc_id", f"{_TREE} AS path")
    name = languages.language(F.col("path"))
    return paths.select("doc_id", name.alias("language"), F.coalesce(languages.is_text(name), F.lit(False)).alias("is_text"))


# Chunks and places.


def chunks_at_line(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks that line 12 of every document lies in."""
    c = chunking.line_chunks(base.files(spark, sf), text_col="content")
    return c.where("start_line <= 12 AND end_line >= 12").select("id", "start_line", "end_line", "chunk_hash")


_LOCATIONS = ["doc_1.py", "tests/doc_2.go", "__init__.py", "src_3/en/doc_9.py", "nothing.py", "pkg_6/__init__.py"]


def resolved_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Locations and the only path that each means: an exact one, else the only one that ends in it."""
    asked = spark.createDataFrame([(x,) for x in _LOCATIONS], "location string")
    paths = base.files(spark, sf).select("path").distinct()
    # A location is a whole number of last parts, so ends are joined by equality.
    parts = F.split("path", "/")
    ends = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("location"))
    hit = ends.join(F.broadcast(asked), "location").groupBy("location").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"), F.max((F.col("path") == F.col("location")).cast("int")).alias("exact"))
    found = hit.where("exact = 1 OR n = 1").select("location", F.when(F.col("exact") == 1, F.col("location")).otherwise(F.col("path")).alias("path"))
    return asked.join(found, "location", "left")


# Queries and scores.


def query_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Is each text a bare symbol, and what weight has its dense leg."""
    texts = table(spark, sf, "part").selectExpr("p_partkey", "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN regexp_replace(p_name, ' ', '_') WHEN 2 THEN regexp_replace(p_name, ' ', '.') ELSE p_brand END AS q")
    symbol = F.trim("q").rlike(ranking.SYMBOL_QUERY.pattern)
    return texts.select("p_partkey", symbol.alias("symbol"), F.when(symbol, 0.3).otherwise(0.75).alias("alpha"))


def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The best documents of one language, statistics over all."""
    docs = table(spark, sf, "documents")
    return lexical.top(lexical.bm25_scores(docs, base.QUERY).join(docs.where("lang = 'de'").select(F.col("doc_id").alias("id")), "id", "left_semi"), 20).select("id", base._r("score"))


def bm25_index(spark: SparkSession, sf: str) -> DataFrame:
    """The best documents again, from stored postings."""
    docs = table(spark, sf, "documents")
    path = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    ix.bucketed(lexical.postings(docs), lexical.BUCKETS).write.partitionBy("bucket").parquet(path)
    size = lexical.lengths(docs).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    return lexical.top(lexical.indexed_scores(spark.read.parquet(path), base.QUERY, size["n"], size["avgdl"]), 20).select("id", base._r("score"))


def dot_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The best rows by raw product, with ranks."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id = 7").select("embedding").first()[0]
    return dense.ranked(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), q, 15).select("rank", "id", base._r("score"))


def best_of_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest vector of each label."""
    e = table(spark, sf, "embeddings")
    q = base._query_vector(spark, sf)
    from lantern.functions.vectors import as_double, cosine

    scored = e.select(F.col("label").alias("path"), F.col("vec_id").alias("id"), cosine(as_double(F.col("embedding")), F.array(*[F.lit(float(x)) for x in q])).alias("score"))
    return signals.best_per_file(scored).select("path", "id", base._r("score"))


_SIGNAL_QUERY = "doc tests loaddoc session 17"
_WEIGHTS = signals.Weights()


def file_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Name, folder, symbol and idf signals of every unit, and their weighted mean."""
    u = base.units(spark, sf)
    p = F.col("path")
    idf = F.create_map(F.lit("doc"), F.lit(4.0), F.lit("tests"), F.col("start_line").cast("double"))
    s = u.select(
        "id", signals.filename_score(_SIGNAL_QUERY, p).alias("filename"), signals.path_score(_SIGNAL_QUERY, p).alias("path_part"),
        signals.symbol_score(_SIGNAL_QUERY, F.array(F.concat(F.lit("sym:x::load_doc_"), F.col("start_line").cast("string")), F.concat(F.lit("sym:y::doc_"), F.col("end_line").cast("string"))), F.col("content")).alias("symbol"), signals.idf_score(_SIGNAL_QUERY, idf).alias("idf"),
    )
    total = signals.combined({"filename": F.col("filename"), "path": F.col("path_part"), "symbol": F.col("symbol"), "idf": F.col("idf")}, _WEIGHTS)
    return s.select("id", base._r("filename"), base._r("path_part"), base._r("symbol"), base._r("idf"), base._r(total, "score"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return base._edges(spark, sf).select(F.col("src").alias("path"), F.col("dst").alias("other"))


def graph_signal(spark: SparkSession, sf: str) -> DataFrame:
    """1/hop from two seeds over the tables' keys."""
    e = _pairs(spark, sf)
    files = e.select("path").union(e.select("other")).distinct()
    return signals.graph_scores(files, e, spark.createDataFrame([("r1",), ("n3",)], "path string"))


def import_signal(spark: SparkSession, sf: str) -> DataFrame:
    """What files share with seeds, lineitem's orders being files and its parts what they import."""
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.concat(F.when(F.col("l_partkey") % 7 == 0, F.lit("")).otherwise(F.lit("p")), (F.col("l_partkey") % 40).cast("string")).alias("target"))
    seeds = spark.createDataFrame([("1",), ("2",), ("5",), ("7",)], "path string")
    return signals.import_scores(e.select("path"), e, seeds).select("path", base._r("import_rel"))


def sif_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weight a / (a + p) of every term of the corpus."""
    n = lexical.terms(table(spark, sf, "documents")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    return n.crossJoin(F.broadcast(total)).select("term", base._r(F.lit(0.05) / (F.lit(0.05) + F.col("n") / F.col("total")), "weight"))


# Graph: Python files, one a part.

_PY = """concat('import m', p_partkey % 9, chr(10), 'from m', p_partkey % 5, '.sub import f', p_partkey % 11, chr(10), chr(10), 'class C', p_partkey % 3, ':', chr(10), '    pass', chr(10), chr(10),
 'def f', p_partkey, '(x):', chr(10), '    return f', p_partkey % 13, '(x)', CASE WHEN p_partkey % 17 = 0 THEN ' (' ELSE '' END, chr(10))"""
_PY_PATH = "concat(CASE WHEN p_partkey % 4 = 0 THEN 'lib/' ELSE '' END, 'm', p_partkey, '.py')"


def _code(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return graph.build(table(spark, sf, "part").selectExpr(f"{_PY_PATH} AS path", f"{_PY} AS text"))


def code_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of Python files; some don't parse."""
    return _code(spark, sf)[0].select("id", "kind", "name", "path", "line")


def code_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of Python files, names resolved to files so far."""
    return _code(spark, sf)[1].select("src", "dst", "kind", base._r("weight"))


def code_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of nodes by kind and of edges."""
    return graph.stats(*_code(spark, sf))


_PRIMARY = ["m1.py", "lib/m4.py", "m10.py"]


def _primary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in _PRIMARY], "path string")


def code_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Files that three files import, and that import them."""
    n, e = _code(spark, sf)
    return graph.imports(n, e, _primary(spark)).withColumn("way", F.lit("out")).union(graph.imports(n, e, _primary(spark), "in").withColumn("way", F.lit("in")))


def code_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Definitions in three files."""
    return graph.symbols(_code(spark, sf)[0], _primary(spark))


def code_callers(spark: SparkSession, sf: str) -> DataFrame:
    """First callers of the symbols of three files."""
    n, e = _code(spark, sf)
    return graph.callers(n, e, _primary(spark))


def code_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """Files one step away from three files."""
    n, e = _code(spark, sf)
    return graph.dependency_chain(n, e, _primary(spark))


_TESTED = "concat('d', p_partkey % 3, '/', CASE WHEN p_size % 3 = 0 THEN 'test_' ELSE '' END, 'm', p_partkey % 50, CASE WHEN p_size % 3 = 1 THEN '_test' ELSE '' END, '.py')"


def tests_of_files(spark: SparkSession, sf: str) -> DataFrame:
    """Test files beside files, by name."""
    files = table(spark, sf, "part").selectExpr(f"{_TESTED} AS path")
    return graph.test_files(files, files.where("NOT path LIKE '%test%'").distinct())


# The index.


def index_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of an index that was built, and brought up to date after files were removed, changed and copied."""
    files = base.files(spark, sf).select("path", F.lit(1).cast("long").alias("size"), "language", F.col("content").alias("text"), F.lit(None).cast("string").alias("error"), "doc_id")
    files = files.withColumn("sha256", F.sha2("text", 256))
    new = files.where("doc_id % 10 <> 0").withColumn("text", F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    new = new.unionByName(files.where("doc_id % 10 = 2").withColumn("path", F.concat(F.lit("copy/"), "path"))).withColumn("sha256", F.sha2("text", 256))
    store, model = ix.Store(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"), hash_model(spark, base.DIM)
    columns = ["path", "size", "sha256", "language", "text", "error"]
    ix.reconcile(store, files.select(*columns), model)
    ix.reconcile(store, new.select(*columns), model)
    return store.table("chunks").select("path", "start_line", "end_line", "chunk_hash", F.col("id").alias("chunk_id"))


_VERSION = f"""base0 AS (SELECT doc_id, {base._PATH} AS path, {base._CODE} AS content FROM documents),
files AS (SELECT doc_id * 2 AS doc_id, path, CASE WHEN doc_id % 10 = 1 THEN content || '!' ELSE content END AS content FROM base0 WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id * 2 + 1, 'copy/' || path, content FROM base0 WHERE doc_id % 10 = 2)"""

_HOPS = f"WITH RECURSIVE {base._EDGES}, b AS (SELECT unnest(['r1', 'n3']) AS id, 0 AS hop UNION SELECT dst, hop + 1 FROM b JOIN edges ON src = id WHERE hop < 2)"
_CODE_SQL = f"""WITH f0 AS (SELECT p_partkey AS k, {_PY_PATH} AS path, p_partkey % 17 <> 0 AS ok FROM part),
nodes AS (SELECT 'file:' || path AS id, 'file' AS kind, 'm' || k || '.py' AS name, path, 0 AS line FROM f0
  UNION ALL SELECT 'sym:' || path || '::C' || (k % 3), 'class', 'C' || (k % 3), path, 4 FROM f0 WHERE ok UNION ALL SELECT 'sym:' || path || '::f' || k, 'function', 'f' || k, path, 7 FROM f0 WHERE ok),
mods AS (SELECT path, 'm' || (k % 9) || '.py' AS want FROM f0 WHERE ok UNION ALL SELECT path, 'm' || (k % 5) || '.py' FROM f0 WHERE ok),
hit AS (SELECT m.path, m.want, row_number() OVER () AS i FROM mods m),
edges AS (SELECT 'file:' || path AS src, id AS dst, 'DEFINES' AS kind, 1.0 AS weight FROM nodes WHERE kind <> 'file'
  UNION ALL SELECT 'file:' || h.path, 'file:' || coalesce(max(CASE WHEN n.path = h.want THEN n.path END), min(n.path)), 'IMPORTS', 1.0 FROM hit h JOIN nodes n ON n.kind = 'file' AND n.path <= h.path AND ends_with(n.path, h.want) GROUP BY h.i, h.path
  UNION ALL SELECT 'file:' || f.path, n.id, 'IMPORTS_FROM', 0.5 FROM f0 f JOIN nodes n ON n.name = 'f' || (f.k % 11) AND n.path <= f.path WHERE f.ok
  UNION ALL SELECT 'file:' || f.path, n.id, t.kind, 0.3 FROM f0 f JOIN nodes n ON n.name = 'f' || (f.k % 13) AND n.path <= f.path, (SELECT unnest(['REFERENCES', 'CALLS']) AS kind) t WHERE f.ok),
prim AS (SELECT unnest({_PRIMARY!r}) AS path)"""


def _tokens_sql(text: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({text}), '[a-z0-9_]+'))"


_ASKED = sorted(set(signals.query_tokens(_SIGNAL_QUERY)))


def _overlap_sql(tokens: str) -> str:
    return f"(len(list_intersect({tokens}, {_ASKED!r}))::DOUBLE / {len(_ASKED)})"


_SYMBOLS = " , ".join(_overlap_sql(_tokens_sql(x)) for x in ("'load doc ' || start_line", "'doc ' || end_line"))

ORACLE_SQL: dict[str, str] = {
    "walk_rules": rf"""WITH t AS (SELECT doc_id, {_TREE} AS path FROM documents)
SELECT doc_id, path, NOT (regexp_matches(path, '(^|/)(build|node_modules|gen)/') OR regexp_matches(path, '^docs/.') OR regexp_matches(path, '^lib/sub/[^/]*[.]go$'))
  AND (regexp_matches(path, '(^|/)keep2[.]log$') OR (NOT ends_with(path, '.log') AND regexp_matches(lower(path), '[.](py|go|md|js|tsx)$'))) AS indexed FROM t""",
    "languages_of_files": f"""WITH t AS (SELECT doc_id, {_TREE} AS path FROM documents), l AS (SELECT doc_id, CASE regexp_extract(lower(path), '[^/][.]([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'md' THEN 'markdown' WHEN 'go' THEN 'go' WHEN 'js' THEN 'javascript' WHEN 'tsx' THEN 'tsx' END AS language FROM t)
SELECT doc_id, language, coalesce(language = 'markdown', false) AS is_text FROM l""",
    "chunks_at_line": f"SELECT id, start_line, end_line, chunk_hash FROM ({base._CHUNKS_SQL}) WHERE start_line <= 12 AND end_line >= 12",
    "resolved_paths": f"""WITH {base.FILES}, p AS (SELECT DISTINCT path FROM files), a AS (SELECT unnest({_LOCATIONS!r}) AS location),
h AS (SELECT location, p.path FROM a JOIN p ON p.path = a.location OR ends_with(p.path, '/' || a.location))
SELECT a.location, CASE WHEN bool_or(h.path = a.location) THEN a.location WHEN count(h.path) = 1 THEN min(h.path) END AS path FROM a LEFT JOIN h USING (location) GROUP BY a.location""",
    "query_kinds": r"""WITH q AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN replace(p_name, ' ', '.') ELSE p_brand END AS q FROM part),
s AS (SELECT p_partkey, regexp_full_match(trim(q), '[A-Za-z_]\w*((::|\\|->|[.])[A-Za-z_]\w*)+') OR regexp_full_match(trim(q), '_\w*') OR regexp_full_match(trim(q), '[A-Za-z][0-9A-Za-z]*[A-Z_]\w*') OR regexp_full_match(trim(q), '[A-Z][A-Za-z0-9]*') AS symbol FROM q)
SELECT p_partkey, symbol, CASE WHEN symbol THEN 0.3 ELSE 0.75 END::DOUBLE AS alpha FROM s""",
    "bm25_filtered": f"WITH {base._bm25_sql()} SELECT id, round(score, 6) AS score FROM lex WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'de') ORDER BY lex.score DESC, id LIMIT 20",
    "bm25_index": f"WITH {base._bm25_sql()} SELECT id, round(score, 6) AS score FROM lex ORDER BY lex.score DESC, id LIMIT 20",
    "dot_topk": "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id AS id, list_dot_product(embedding::DOUBLE[], q.v) AS p FROM embeddings, q ORDER BY p DESC, id LIMIT 15) SELECT row_number() OVER (ORDER BY p DESC, id)::INT AS rank, id, round(p, 6) AS score FROM s",
    "best_of_labels": f"WITH s AS (SELECT label AS path, vec_id AS id, {base._COS.format(a='embedding::DOUBLE[]', b=base._QV)} AS c FROM embeddings) SELECT path, id, round(c, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY path ORDER BY c DESC, id) = 1",
    "file_signals": f"""WITH {base.UNITS}, s AS (SELECT id, {_overlap_sql(_tokens_sql("translate(parse_filename(path), '._', '  ')"))} AS filename,
  {_overlap_sql(_tokens_sql("replace(array_to_string(string_split(path, '/')[1:len(string_split(path, '/')) - 1], '/'), '_', ' ')"))} AS path_part,
  least(1.0, greatest({_SYMBOLS}, 0.5 * {_overlap_sql(_tokens_sql('content'))})) AS symbol, least(1.0, (4.0 + start_line) / {len(signals.query_tokens(_SIGNAL_QUERY))} / 5) AS idf FROM units)
SELECT id, round(filename, 6) AS filename, round(path_part, 6) AS path_part, round(symbol, 6) AS symbol, round(idf::DOUBLE, 6) AS idf, round(0.15 * filename + 0.10 * path_part + 0.15 * symbol + 0.05 * idf, 6)::DOUBLE AS score FROM s""",
    "graph_signal": f"{_HOPS}, h AS (SELECT id, min(hop) AS hop FROM b GROUP BY id), n AS (SELECT src AS path FROM edges UNION SELECT dst FROM edges) SELECT path, CASE WHEN hop > 0 THEN 1.0 / hop ELSE 0 END::DOUBLE AS graph FROM n LEFT JOIN h ON h.id = n.path",
    "import_signal": """WITH e AS (SELECT DISTINCT l_orderkey::VARCHAR AS path, CASE WHEN l_partkey % 7 = 0 THEN '' ELSE 'p' END || (l_partkey % 40) AS target FROM lineitem), s AS (SELECT unnest(['1', '2', '5', '7']) AS seed),
a AS (SELECT x.path, count(DISTINCT s.seed) AS n FROM e x JOIN e y USING (target) JOIN s ON s.seed = y.path WHERE x.path <> y.path GROUP BY x.path), d AS (SELECT path, count(DISTINCT target) AS n FROM e JOIN s ON s.seed = e.target GROUP BY path)
SELECT p.path, CASE WHEN p.path IN (SELECT seed FROM s) THEN 0 ELSE round(least(1.0, coalesce(a.n, 0) * 0.1 + coalesce(d.n, 0) * 0.3), 6) END::DOUBLE AS import_rel FROM (SELECT DISTINCT path FROM e) p LEFT JOIN a USING (path) LEFT JOIN d USING (path)""",
    "sif_weights": f"WITH t AS (SELECT unnest({base._tokens_sql('text')}) AS term FROM documents), n AS (SELECT term, count(*) AS n FROM t GROUP BY term) SELECT term, round(0.05 / (0.05 + n / (SELECT sum(n) FROM n)), 6) AS weight FROM n",
    "code_nodes": f"{_CODE_SQL} SELECT * FROM nodes",
    "code_edges": f"{_CODE_SQL} SELECT src, dst, kind, weight::DOUBLE AS weight FROM edges",
    "code_stats": f"{_CODE_SQL} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM nodes WHERE kind = 'file') AS n_files, (SELECT count(*) FROM nodes WHERE kind = 'function') AS n_functions, (SELECT count(*) FROM nodes WHERE kind = 'class') AS n_classes",
    "code_imports": f"""{_CODE_SQL}, x AS (SELECT a.path AS from_, b.path AS to_ FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE e.kind IN ('IMPORTS', 'IMPORTS_FROM')),
i AS (SELECT b.path AS to_, a.path AS from_ FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst AND b.kind = 'file' WHERE e.kind IN ('IMPORTS', 'IMPORTS_FROM'))
SELECT DISTINCT to_ AS path, 'out' AS way FROM x WHERE from_ IN (FROM prim) AND to_ NOT IN (FROM prim) UNION ALL SELECT DISTINCT from_, 'in' FROM i WHERE to_ IN (FROM prim) AND from_ NOT IN (FROM prim)""",
    "code_symbols": f"{_CODE_SQL} SELECT name, kind, path AS file, line FROM nodes WHERE kind <> 'file' AND path IN (FROM prim) ORDER BY path, line, name LIMIT 15",
    "code_callers": f"""{_CODE_SQL}, c AS (SELECT e.dst, min(a.path) AS path FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE e.kind = 'CALLS' AND b.kind <> 'file' AND b.path IN (FROM prim) AND a.path <> b.path GROUP BY e.dst ORDER BY e.dst LIMIT 10)
SELECT parse_filename(path) AS name, path AS file, 0 AS line FROM c""",
    "code_dependencies": f"{_CODE_SQL} SELECT DISTINCT b.path FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.kind = 'file' AND a.path IN (FROM prim) AND b.path NOT IN (FROM prim) ORDER BY b.path LIMIT 10",
    "tests_of_files": f"""WITH f AS (SELECT DISTINCT {_TESTED} AS path FROM part), s AS (SELECT regexp_extract(path, '^(.*/)([^/]*)[.]py$', 1) AS d, regexp_extract(path, '^(.*/)([^/]*)[.]py$', 2) AS s FROM f WHERE NOT contains(path, 'test'))
SELECT path FROM f WHERE path IN (SELECT d || 'test_' || s || '.py' FROM s) OR path IN (SELECT d || s || '_test.py' FROM s)""",
    "index_reconcile": f"SELECT path, start_line, end_line, chunk_hash, chunk_id FROM ({base._CHUNKS_SQL.replace(base.FILES, _VERSION)})",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        walk_rules, languages_of_files, chunks_at_line, resolved_paths, query_kinds, bm25_filtered, bm25_index, dot_topk, best_of_labels, file_signals, graph_signal, import_signal, sif_weights,
        code_nodes, code_edges, code_stats, code_imports, code_symbols, code_callers, code_dependencies, tests_of_files, index_reconcile,
    )
}
