"""The engine's queries over a data folder, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.functions import text as tx
from lantern.functions.vectors import hash_embedding
from lantern.operators import chunking, dense, graph, lexical, ranking, tables

QUERY = "the licensed benchmark session of code"
PLAIN_QUERY = "where does LoadDoc7 open the benchmark session of examples"
SYMBOL = "pkg.doc_17"
DIM = 16

#: Documents stand in for source files: a path of every kind that rules look at, and a definition in some.
_PATH = """concat(source, '/', lang, '/', CASE doc_id % 8 WHEN 0 THEN concat('test_doc_', doc_id, '.py') WHEN 1 THEN concat('doc_', doc_id, '.py')
 WHEN 2 THEN concat('tests/doc_', doc_id, '.go') WHEN 3 THEN concat('legacy/doc_', doc_id, '.ts') WHEN 4 THEN concat('examples/doc_', doc_id, '.rs')
 WHEN 5 THEN concat('doc_', doc_id, '.d.ts') WHEN 6 THEN concat('pkg_', doc_id, '/__init__.py') ELSE concat('doc_', doc_id, '.md') END)"""
_CODE = """CASE doc_id % 8 WHEN 1 THEN concat('def load_doc_', doc_id, '(path):', chr(10), text) WHEN 2 THEN concat('func LoadDoc', doc_id, '(path string) {', chr(10), text)
 WHEN 5 THEN concat('interface DocRow', doc_id, ' {', chr(10), text) WHEN 6 THEN concat('from doc import load_doc_', doc_id, chr(10), text) ELSE text END"""
_LANGUAGE = "CASE doc_id % 8 WHEN 2 THEN 'go' WHEN 3 THEN 'typescript' WHEN 5 THEN 'typescript' WHEN 4 THEN 'rust' WHEN 7 THEN 'markdown' ELSE 'python' END"
FILES = f"files AS (SELECT doc_id, {_PATH} AS path, {_CODE} AS content, {_LANGUAGE} AS language, text FROM documents)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("doc_id", f"{_PATH} AS path", f"{_CODE} AS content", f"{_LANGUAGE} AS language", "text")


#: Units of search: forty files of each kind, with several chunks each and definitions that some files are named after.
_UNIT_PATH = """CASE doc_id % 8 WHEN 0 THEN concat('pkg/test_doc_', doc_id % 40, '.py') WHEN 1 THEN concat('pkg/doc_', doc_id % 40, '.py') WHEN 2 THEN concat('src/tests/doc', doc_id % 40, '.go')
 WHEN 3 THEN concat('legacy/doc_', doc_id % 40, '.ts') WHEN 4 THEN concat('examples/session_', doc_id % 40, '.rs') WHEN 5 THEN concat('types/docRow', doc_id % 40, '.d.ts') WHEN 6 THEN concat('pkg_', doc_id % 40, '/__init__.py') ELSE concat('load/loaddoc', doc_id % 40, 's.md') END"""
_UNIT_CODE = """CASE doc_id % 8 WHEN 1 THEN concat('def doc_', doc_id % 40, '(path):', chr(10), text) WHEN 2 THEN concat('func LoadDoc', doc_id % 40, '(path string) {', chr(10), text)
 WHEN 5 THEN concat('interface DocRow', doc_id % 40, ' {', chr(10), text) WHEN 6 THEN concat('from doc import doc_', doc_id % 40, chr(10), text) WHEN 7 THEN concat('abstract class m.LoadDoc', doc_id % 40, ':', chr(10), text) ELSE text END"""
_LINES = "CAST(doc_id % 7 + 1 AS INT) AS start_line, CAST(doc_id % 7 + 1 + doc_id % 5 AS INT) AS end_line"
UNITS = f"units AS (SELECT doc_id AS id, {_UNIT_PATH} AS path, {_UNIT_CODE} AS content, {_LINES} FROM documents)"


def units(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("doc_id AS id", f"{_UNIT_PATH} AS path", f"{_UNIT_CODE} AS content", *_LINES.split(", "))


_SPLIT = r"""list_transform(CASE WHEN contains(t, '_') THEN list_filter(string_split(t, '_'), lambda p: p <> '') ELSE regexp_extract_all(regexp_replace(t, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '\d+|[A-Z]?[a-z]+|[A-Z]+') END, lambda p: lower(p))"""


def _tokens_sql(text: str) -> str:
    split = _SPLIT
    return f"flatten(list_transform(regexp_extract_all({text}, '{tx.IDENTIFIER}'), lambda t: CASE WHEN len({split}) >= 2 THEN list_concat([lower(t)], {split}) ELSE [lower(t)] END))"


def _bm25_sql(name: str = "lex", source: str = "documents", text: str = "text", query: str = QUERY) -> str:
    terms = tx.tokens_of(query)
    return f"""{name}_t AS (SELECT doc_id, {_tokens_sql(text)} AS toks FROM {source}),
{name}_q AS (SELECT term, count(*) AS mult FROM (SELECT unnest({terms!r}) AS term) GROUP BY term),
{name}_s AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM {name}_t),
{name}_p AS (SELECT doc_id, len(toks)::DOUBLE AS dl, q.term, q.mult, len(list_filter(toks, lambda x: x = q.term))::DOUBLE AS tf FROM {name}_t, {name}_q q),
{name}_d AS (SELECT term, count(*) FILTER (WHERE tf > 0)::DOUBLE AS df FROM {name}_p GROUP BY term),
{name} AS (SELECT doc_id AS id, sum(mult * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM {name}_p JOIN {name}_d USING (term), {name}_s WHERE tf > 0 GROUP BY doc_id)"""


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    return table(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()[0]


def _lex(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25_scores(table(spark, sf, "documents"), QUERY)


def _dense_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = dense.hash_vectors(table(spark, sf, "documents"), DIM)
    q = spark.range(1).select(hash_embedding(F.array(*[F.lit(t) for t in tx.tokens_of(QUERY)]), DIM).alias("v")).first()[0]
    return dense.nearest(docs, q, 200, "id", "v").select("id", "score")


_EMBED = "list_transform(range({d}), lambda i: len(list_filter({t}, lambda k: ('0x' || substr(md5(k), 1, 8))::BIGINT % {d} = i))::DOUBLE)"
_COS = "list_dot_product({a}, {b}) / ((sqrt(list_dot_product({a}, {a})) + 1e-10) * (sqrt(list_dot_product({b}, {b})) + 1e-10))"
_QV = "(SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)"
_DENSE_SQL = f"""demb AS (SELECT doc_id AS id, {_EMBED.format(d=DIM, t=_tokens_sql('text'))} AS v FROM documents),
dq AS (SELECT {_EMBED.format(d=DIM, t=repr(tx.tokens_of(QUERY)))} AS q),
dn AS (SELECT id, list_transform(v, lambda x: CASE WHEN list_dot_product(v, v) > 0 THEN x / sqrt(list_dot_product(v, v)) ELSE 0 END) AS v, list_transform(q, lambda x: x / sqrt(list_dot_product(q, q))) AS q FROM demb, dq),
dense AS (SELECT id, {_COS.format(a='v', b='q')} AS score FROM dn ORDER BY 1 - score, id LIMIT 200)"""


def _r(c: str, alias: str | None = None):
    return F.round(c, 6).alias(alias or c)


def _quick_r(c: str):
    """The same as `_r`, whose decimals cost a microsecond a row, by float arithmetic where no tie is near."""
    y = F.col(c) * 1e6
    return F.when((F.abs(y) < 1e9) & (F.abs(y - F.floor(y) - 0.5) > 1e-3), F.rint(y) / 1e6 + 0.0).otherwise(F.round(c, 6)).alias(c)


def tok_identifiers(spark, sf):
    toks = files(spark, sf).select("doc_id", tx.tokenize(F.col("content")).alias("toks"))
    return toks.select("doc_id", F.size("toks").cast("long").alias("n_tokens"), F.sha2(F.array_join("toks", " "), 256).alias("digest"))


def enrich_path(spark, sf):
    return files(spark, sf).select("doc_id", F.sha2(tx.enrich(F.col("text"), F.col("path")), 256).alias("digest"), tx.stem(F.col("path")).alias("stem"))


def word_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(tx.words(F.col("text"))).cast("long").alias("n_words"))


def line_chunks(spark, sf):
    return chunking.line_chunks(files(spark, sf), text_col="content").select("id", "path", "start_line", "end_line", "byte_start", "byte_end", "chunk_hash", "chunk_id", F.length("content").alias("n_chars"))


def chunk_ids(spark, sf):
    one = files(spark, sf).select("doc_id", "path", F.lit(1).alias("start_line"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("end_line"), F.col("text").alias("content"))
    return tables.identified(one).select("doc_id", "chunk_hash", "chunk_id")


def bm25_term_stats(spark, sf):
    return lexical.term_stats(lexical.terms(table(spark, sf, "documents")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")))


def bm25_corpus_stats(spark, sf):
    return lexical.corpus_stats(table(spark, sf, "documents")).select("n", _r("avgdl"))


def bm25_topk(spark, sf):
    return lexical.top(_lex(spark, sf), 20).select("id", _r("score"))


def vec_topk(spark, sf):
    return dense.nearest(table(spark, sf, "embeddings"), _query_vector(spark, sf), 20).select("id", _r("distance"), _r("score"))


def vec_topk_filtered(spark, sf):
    e = table(spark, sf, "embeddings")
    return dense.nearest(e, _query_vector(spark, sf), 20, only=e.where("label = 3").select(F.col("vec_id").alias("id"))).select("id", _r("distance"), _r("score"))


def vec_related(spark, sf):
    e = table(spark, sf, "embeddings")
    return dense.nearest(e.where("vec_id <> 0"), _query_vector(spark, sf), 5).select("id", _r("score"))


def sim_matrix(spark, sf):
    e = table(spark, sf, "embeddings")
    return dense.similarity(e.where("vec_id % 100 = 0"), e).select("left", "right", _quick_r("similarity"))


def hash_embed(spark, sf):
    v = dense.hash_vectors(table(spark, sf, "documents"), DIM)
    return v.select(F.col("id").alias("doc_id"), F.posexplode("v").alias("pos", "x")).select("doc_id", F.col("pos").cast("long").alias("pos"), _r("x"))


def _hybrid(spark, sf, how):
    return ranking.fuse(_dense_docs(spark, sf), lexical.top(_lex(spark, sf), 200), ranking.resolve_alpha(QUERY), how)


def hybrid_minmax(spark, sf):
    return _hybrid(spark, sf, "minmax").select("id", _r("score"))


def hybrid_rrf(spark, sf):
    return _hybrid(spark, sf, "rrf").select("id", _r("score"))


def _candidates(spark, sf):
    """Lexical candidates with a pseudo-file of several chunks each."""
    some = lexical.top(_lex(spark, sf), 200)
    return some.join(files(spark, sf).withColumnRenamed("doc_id", "id"), "id").withColumn("file", F.concat(F.lit("f"), (F.col("id") % 20).cast("string"), F.lit(".py")))


_CAND = f"""{FILES}, {_bm25_sql()}, cand AS (SELECT lex.id, score, path, content, 'f' || (lex.id % 20) || '.py' AS file FROM (SELECT * FROM lex ORDER BY score DESC, id LIMIT 200) lex JOIN files ON files.doc_id = lex.id)"""


def file_coherence(spark, sf):
    return ranking.boost_coherent_files(_candidates(spark, sf), "file").select("id", _r("score"))


def path_penalty(spark, sf):
    return files(spark, sf).select("doc_id", _f(ranking.path_penalty(F.col("path")), "penalty"))


def _f(c, alias):
    return F.round(c, 6).alias(alias)


def _search(spark, sf, query, k=20, alpha=None):
    every = units(spark, sf)
    lex = lexical.top(lexical.bm25_scores(every.select("id", tx.enrich(F.col("content"), F.col("path")).alias("text")), query, "id"), max(200, k))
    q = spark.range(1).select(hash_embedding(F.array(*[F.lit(t) for t in tx.tokens_of(query)]), DIM).alias("v")).first()[0]
    near = dense.nearest(dense.hash_vectors(every, DIM, "id", "content"), q, max(200, k), "id", "v").select("id", "score")
    return ranking.search_hybrid(query, near, lex, every, k, alpha).select("rank", "id", "path", "start_line", "end_line", "exact", _r("score"))


def search_hybrid(spark, sf):
    """Plain language that names a symbol: stems, embedded symbols and exact hits."""
    return _search(spark, sf, PLAIN_QUERY)


def search_symbol(spark, sf):
    """A qualified symbol: definitions."""
    return _search(spark, sf, SYMBOL)


def search_words(spark, sf):
    """Plain language alone."""
    return _search(spark, sf, QUERY)


def find_symbol(spark, sf):
    """A symbol by the lexical leg alone."""
    return _search(spark, sf, "doc_9", 10, 0.0)


def definition_boost(spark, sf):
    every = units(spark, sf)
    c = lexical.top(_lex(spark, sf), 200).join(every, "id")
    return ranking.boost_definitions(c, _NAMES, 3.0 * F.max("score").over(ranking.everything()), chunks=every).select("id", _r("score"))


def definition_match(spark, sf):
    return files(spark, sf).select("doc_id", ranking.defines(F.col("content"), "load_doc_1").alias("one"), ranking.defines(F.col("content"), "LoadDoc2").alias("two"), ranking.defines(F.col("content"), "DocRow5").alias("three"))


def stem_boost(spark, sf):
    c = _candidates(spark, sf)
    return ranking.boost_stems(c, "doc examples session", F.max("score").over(ranking.everything())).select("id", _r("score"))


def saturation_rerank(spark, sf):
    c = _candidates(spark, sf)
    c = c.withColumn("score", F.col("score") * ranking.path_penalty(F.col("path")))
    return ranking.saturate(c, 20, "file").select("id", _r("score"))


def exact_identifier(spark, sf):
    return files(spark, sf).where(F.col("content").contains("load_doc_1")).select("doc_id", "path")


def containment_dedup(spark, sf):
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("rank"), (F.col("l_partkey") % 50).alias("start_line"), (F.col("l_partkey") % 50 + F.col("l_suppkey") % 30).alias("end_line"))
    return ranking.drop_contained(c)


def _hashed(df):
    return df.select("path", F.sha2("text", 256).alias("sha256"))


def snapshot_diff(spark, sf):
    old = files(spark, sf).select("doc_id", "path", "text")
    new = old.where("doc_id % 10 <> 0").withColumn("text", F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    added = old.where("doc_id % 10 = 2").withColumn("path", F.concat(F.lit("copy/"), "path"))
    return tables.snapshot_diff(_hashed(old), _hashed(new.union(added)))


def memo_hits(spark, sf):
    c = files(spark, sf).select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("chunk_hash"))
    return tables.memo_split(c, c.where("doc_id % 2 = 0")).select("doc_id", "hit")


def index_stats_lang(spark, sf):
    return tables.language_stats(files(spark, sf))


def _edges(spark, sf):
    def e(name, src, s, dst, d):
        return table(spark, sf, name).select(F.concat(F.lit(src), F.col(s).cast("string")).alias("src"), F.concat(F.lit(dst), F.col(d).cast("string")).alias("dst"), F.lit(name).alias("kind"))

    return e("nation", "r", "n_regionkey", "n", "n_nationkey").union(e("customer", "n", "c_nationkey", "c", "c_custkey")).union(e("orders", "c", "o_custkey", "o", "o_orderkey")).union(e("supplier", "n", "s_nationkey", "s", "s_suppkey"))


_EDGES = """edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'nation' AS kind FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'customer' FROM customer
UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'orders' FROM orders UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'supplier' FROM supplier)"""


def graph_expand(spark, sf):
    return graph.expand(_edges(spark, sf), spark.createDataFrame([("r1",), ("n3",)], "id string"), 3)


def graph_neighbors(spark, sf):
    e = _edges(spark, sf)
    return graph.neighbors(e, "n3").withColumn("way", F.lit("out")).union(graph.neighbors(e, "n3", way="in").withColumn("way", F.lit("in")))


def graph_stats(spark, sf):
    return _edges(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("src").alias("n_src"))


def user_last_event(spark, sf):
    """Last state of every user after the whole change log."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf, "events").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", "event_id", "event_type")


_MINMAX = "CASE WHEN max({s}) OVER () = min({s}) OVER () THEN CASE WHEN max({s}) OVER () > 0 THEN 1.0 ELSE 0.0 END ELSE ({s} - min({s}) OVER ()) / (max({s}) OVER () - min({s}) OVER ()) END"
_ALPHA = ranking.resolve_alpha(QUERY)
#: Written from the blueprint's wording, not from the engine's constants.
_TEST = r"regexp_matches(path, '(^|/)(test_[^/]*[.]py|[^/]*_test[.]py|[^/]*_test[.]go|[^/]*Test[.]java|[^/]*Tests[.]java|[^/]*[.](test|spec)[.](js|ts|jsx|tsx)|test_helper[^/]*[.][0-9A-Za-z_]+)$') OR regexp_matches(path, '(^|/)(test|tests|__tests__|spec|testing)(/|$)')"
_PENALTY = f"""((CASE WHEN {_TEST} THEN 0.3 ELSE 1.0 END)::DOUBLE * (CASE WHEN parse_filename(path) = '__init__.py' OR parse_filename(path) = 'package-info.java' THEN 0.5 ELSE 1.0 END)::DOUBLE
 * (CASE WHEN regexp_matches(path, '(^|/)(compat|_compat|legacy)(/|$)') THEN 0.3 ELSE 1.0 END)::DOUBLE * (CASE WHEN regexp_matches(path, '(^|/)(example|examples|_example|_examples|doc_src|docs_src)(/|$)') THEN 0.3 ELSE 1.0 END)::DOUBLE
 * (CASE WHEN ends_with(path, '.d.ts') THEN 0.7 ELSE 1.0 END)::DOUBLE)"""
#: The two-word forms of "class" are covered by it.
_DEF_WORDS = "typedef|type|trait|struct|record|protocol|package|object|namespace|module|interface|func|function|fun|fn|enum|defmodule|def|class"


def _def_sql(name: str) -> str:
    return rf"regexp_matches(content, '(^|\s)({_DEF_WORDS})\s+([A-Za-z_]\w*(\.|::))*{name}(\s|$|[<({{:;]|\[)', 'n')"


_STEM = r"regexp_replace(parse_filename(path), '^(.+)\.[^.]+$', '\1')"
_NAMES = ["doc_1", "doc_9", "LoadDoc2", "DocRow5"]


def _stem_is(name: str) -> str:
    n = name.lower()
    s = f"lower({_STEM})"
    b = f"replace({s}, '_', '')"
    return f"({s} = '{n}' OR {b} = '{n}' OR rtrim({s}, 's') = '{n}' OR rtrim({b}, 's') = '{n}')"


def _stem_starts(name: str) -> str:
    n = name.lower()
    s = f"lower({_STEM})"
    b = f"replace({s}, '_', '')"
    return f"({s} = '{n}' OR {b} = '{n}' OR (length({s}) >= 4 AND starts_with('{n}', {s})) OR (length({b}) >= 4 AND starts_with('{n}', {b})))"


def _either(tests: list[str]) -> str:
    return "(" + " OR ".join(tests or ["false"]) + ")"


def _tier_sql(names: list[str], unit: str) -> str:
    return f"CASE WHEN {_either([_def_sql(n) for n in names])} THEN {unit} * CASE WHEN {_either([_stem_is(n) for n in names])} THEN 1.5 ELSE 1.0 END ELSE 0 END"


_PARENT = "coalesce(string_split(path, '/')[len(string_split(path, '/')) - 1], '')"


def _share_sql(keywords: list[str]) -> str:
    def split(t: str) -> str:
        parts = _SPLIT.replace("(t,", f"({t},").replace("contains(t", f"contains({t}")
        return f"list_concat([lower({t})], CASE WHEN len({parts}) >= 2 THEN {parts} ELSE []::VARCHAR[] END)"

    parts = f"list_concat({split(_STEM)}, {split(_PARENT)})"
    return f"len(list_filter({keywords!r}, lambda k: len(list_filter({parts}, lambda p: k = p OR (length(p) >= 3 AND starts_with(k, p)) OR starts_with(p, k))) > 0))::DOUBLE / {len(keywords)}"


def _search_sql(query: str, alpha: float, names: list[str], enters: list[str], scale: float, keywords: list[str], exact: list[str], k: int = 20) -> str:
    """A whole search; what a query's kind, names, keywords and identifiers are is written down by hand."""
    stems = f"CASE WHEN {_share_sql(keywords)} >= 0.1 THEN top * {_share_sql(keywords)} ELSE 0 END" if keywords else "0"
    holds = _either([f"contains(content, '{x}')" for x in exact])
    embed = _EMBED.format(d=DIM, t=_tokens_sql("content"))
    return f"""WITH {UNITS},
en AS (SELECT id AS doc_id, concat_ws(' ', content, {_STEM}, {_STEM}, array_to_string(string_split(path, '/')[1:len(string_split(path, '/')) - 1], ' ')) AS text FROM units),
{_bm25_sql('lex', 'en', 'text', query)},
demb AS (SELECT id, {embed} AS v FROM units), dq AS (SELECT {_EMBED.format(d=DIM, t=repr(tx.tokens_of(query)))} AS q),
dn AS (SELECT id, list_transform(v, lambda x: CASE WHEN list_dot_product(v, v) > 0 THEN x / sqrt(list_dot_product(v, v)) ELSE 0 END) AS v, list_transform(q, lambda x: x / sqrt(list_dot_product(q, q))) AS q FROM demb, dq),
dense AS (SELECT id, {_COS.format(a='v', b='q')} AS score FROM dn ORDER BY 1 - score, id LIMIT 200),
l AS (SELECT id, {_MINMAX.format(s='score')} AS s FROM (SELECT * FROM lex ORDER BY score DESC, id LIMIT 200)), d AS (SELECT id, {_MINMAX.format(s='score')} AS s FROM dense),
f AS (SELECT coalesce(d.id, l.id) AS id, ({alpha} * coalesce(d.s, 0) + {1 - alpha} * coalesce(l.s, 0))::DOUBLE AS score FROM d FULL JOIN l ON d.id = l.id),
c0 AS (SELECT u.*, f.score FROM f JOIN units u USING (id)),
w AS (SELECT *, sum(score) OVER (PARTITION BY path) AS fs, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS rn, max(score) OVER () AS mx FROM c0),
c1 AS (SELECT * EXCLUDE (fs, rn, mx, score), score + CASE WHEN rn = 1 AND mx <> 0 THEN 0.2 * mx * fs / (SELECT max(fs) FROM w) ELSE 0 END AS score FROM w),
c2 AS (SELECT * EXCLUDE (score, top), score + {stems} + {_tier_sql(names, f'{scale} * top')} AS score FROM (SELECT *, max(score) OVER () AS top FROM c1)),
c3 AS (SELECT id, path, content, start_line, end_line, score FROM c2
  UNION ALL SELECT id, path, content, start_line, end_line, {_tier_sql(names, f'{scale} * (SELECT max(score) FROM c1)')} FROM units WHERE id NOT IN (SELECT id FROM c1) AND {_either([_def_sql(n) for n in names])} AND {_either(enters)}),
c4 AS (SELECT *, {holds} AS exact FROM c3 UNION ALL SELECT id, path, content, start_line, end_line, (SELECT max(score) + 1 FROM c3), true FROM units WHERE {holds} AND id NOT IN (SELECT id FROM c3)),
p AS (SELECT *, score * {_PENALTY if alpha < 1 else '1'} AS s FROM c4),
e AS (SELECT *, s * pow(0.5, row_number() OVER (PARTITION BY path ORDER BY s DESC, id) - 1) AS eff FROM p),
t AS (SELECT * FROM e ORDER BY eff DESC, id LIMIT {2 * k}),
o AS (SELECT *, row_number() OVER (ORDER BY exact DESC, eff DESC, id) AS rk FROM t WHERE eff > 0),
z AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.path = o.path AND b.start_line <= o.start_line AND b.end_line >= o.end_line AND b.rk < o.rk) ORDER BY rk LIMIT {k})
SELECT row_number() OVER (ORDER BY rk)::INT AS rank, id, path, start_line, end_line, exact, round(eff, 6) AS score FROM z"""


_CHUNKS_SQL = f"""WITH RECURSIVE {FILES}, ln AS (SELECT doc_id, path, string_split(content, chr(10)) AS ls FROM files WHERE content IS NOT NULL),
u AS (SELECT doc_id, path, i, CASE WHEN i < len(ls) THEN ls[i] || chr(10) ELSE ls[i] END AS unit FROM ln, unnest(range(1, len(ls) + 1)) AS r(i) WHERE i < len(ls) OR ls[i] <> ''),
g(doc_id, i, chunk, used) AS (SELECT doc_id, 1::BIGINT, 1, length(unit) FROM u WHERE i = 1
  UNION ALL SELECT g.doc_id, g.i + 1, CASE WHEN g.used + length(u.unit) > 2048 THEN g.chunk + 1 ELSE g.chunk END, CASE WHEN g.used + length(u.unit) > 2048 THEN length(u.unit) ELSE g.used + length(u.unit) END FROM g JOIN u ON u.doc_id = g.doc_id AND u.i = g.i + 1),
c AS (SELECT doc_id AS id, any_value(path) AS path, chunk, min(i) AS start_line, string_agg(unit, '' ORDER BY i) AS content FROM g JOIN u USING (doc_id, i) GROUP BY doc_id, chunk),
b AS (SELECT *, coalesce(sum(strlen(content)) OVER (PARTITION BY id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_start, left(content, length(content)::BIGINT - 1) AS inner_ FROM c),
e AS (SELECT *, start_line + length(inner_) - length(replace(inner_, chr(10), '')) AS end_line FROM b WHERE trim(content, ' ' || chr(10) || chr(9) || chr(13)) <> '')
SELECT id, path, start_line::INT AS start_line, end_line::INT AS end_line, byte_start, byte_start + strlen(inner_) AS byte_end, substr(sha256(content), 1, 16) AS chunk_hash,
  substr(sha256(path || ':' || start_line || ':' || end_line || ':' || content), 1, 16) AS chunk_id, length(content)::INT AS n_chars FROM e"""


ORACLE_SQL: dict[str, str] = {
    "tok_identifiers": f"WITH {FILES}, t AS (SELECT doc_id, {_tokens_sql('content')} AS toks FROM files) SELECT doc_id, len(toks)::BIGINT AS n_tokens, sha256(coalesce(array_to_string(toks, ' '), '')) AS digest FROM t",
    "enrich_path": f"""WITH {FILES}, p AS (SELECT doc_id, text, {_STEM} AS stem, string_split(path, '/') AS parts FROM files), q AS (SELECT *, parts[1:len(parts) - 1] AS dirs FROM p)
SELECT doc_id, sha256(concat_ws(' ', text, stem, stem, array_to_string(dirs[greatest(len(dirs) - 2, 1):len(dirs)], ' '))) AS digest, stem FROM q""",
    "word_counts": "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+'))::BIGINT AS n_words FROM documents",
    "chunk_ids": f"""WITH {FILES} SELECT doc_id, substr(sha256(text), 1, 16) AS chunk_hash, substr(sha256(path || ':1:' || (length(text) - length(replace(text, chr(10), '')) + 1) || ':' || text), 1, 16) AS chunk_id FROM files""",
    "bm25_term_stats": f"""WITH t AS (SELECT doc_id, unnest({_tokens_sql('text')}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL)
SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term""",
    "bm25_corpus_stats": f"SELECT count(*)::BIGINT AS n, round(avg(len({_tokens_sql('text')})), 6) AS avgdl FROM documents",
    "bm25_topk": f"WITH {_bm25_sql()} SELECT id, round(score, 6) AS score FROM lex ORDER BY lex.score DESC, id LIMIT 20",
    "vec_topk": f"WITH s AS (SELECT vec_id AS id, {_COS.format(a='embedding::DOUBLE[]', b=_QV)} AS c FROM embeddings) SELECT id, round(1 - c, 6) AS distance, round(c, 6) AS score FROM s ORDER BY 1 - c, id LIMIT 20",
    "vec_topk_filtered": f"WITH s AS (SELECT vec_id AS id, {_COS.format(a='embedding::DOUBLE[]', b=_QV)} AS c FROM embeddings WHERE label = 3) SELECT id, round(1 - c, 6) AS distance, round(c, 6) AS score FROM s ORDER BY 1 - c, id LIMIT 20",
    "vec_related": f"WITH s AS (SELECT vec_id AS id, {_COS.format(a='embedding::DOUBLE[]', b=_QV)} AS c FROM embeddings WHERE vec_id <> 0) SELECT id, round(c, 6) AS score FROM s ORDER BY 1 - c, id LIMIT 5",
    "sim_matrix": "SELECT a.vec_id AS \"left\", b.vec_id AS \"right\", round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0",
    "hash_embed": f"""WITH e AS (SELECT doc_id, {_EMBED.format(d=DIM, t=_tokens_sql('text'))} AS v FROM documents)
SELECT doc_id, unnest(range({DIM}))::BIGINT AS pos, unnest(list_transform(v, lambda x: round(CASE WHEN list_dot_product(v, v) > 0 THEN x / sqrt(list_dot_product(v, v)) ELSE 0 END, 6))) AS x FROM e""",
    "hybrid_minmax": f"""WITH {_bm25_sql()}, {_DENSE_SQL}, l AS (SELECT id, {_MINMAX.format(s='score')} AS s FROM (SELECT * FROM lex ORDER BY score DESC, id LIMIT 200)), d AS (SELECT id, {_MINMAX.format(s='score')} AS s FROM dense)
SELECT coalesce(d.id, l.id) AS id, round({_ALPHA} * coalesce(d.s, 0) + {1 - _ALPHA} * coalesce(l.s, 0), 6) AS score FROM d FULL JOIN l ON d.id = l.id""",
    "hybrid_rrf": f"""WITH {_bm25_sql()}, {_DENSE_SQL}, l AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS s FROM (SELECT * FROM lex ORDER BY score DESC, id LIMIT 200)), d AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS s FROM dense)
SELECT coalesce(d.id, l.id) AS id, round(({_ALPHA} * coalesce(d.s, 0) + {1 - _ALPHA} * coalesce(l.s, 0))::DOUBLE, 6) AS score FROM d FULL JOIN l ON d.id = l.id""",
    "file_coherence": f"""WITH {_CAND}, w AS (SELECT *, sum(score) OVER (PARTITION BY file) AS fs, row_number() OVER (PARTITION BY file ORDER BY score DESC, id) AS rn, max(score) OVER () AS mx FROM cand)
SELECT id, round(score + CASE WHEN rn = 1 AND mx > 0 THEN 0.2 * mx * fs / (SELECT max(fs) FROM w) ELSE 0 END, 6) AS score FROM w""",
    "path_penalty": f"WITH {FILES} SELECT doc_id, round({_PENALTY}, 6) AS penalty FROM files",
    "definition_match": f"WITH {FILES} SELECT doc_id, {_def_sql('load_doc_1')} AS one, {_def_sql('LoadDoc2')} AS two, {_def_sql('DocRow5')} AS three  FROM files",
    "definition_boost": f"""WITH {UNITS}, {_bm25_sql()}, cand AS (SELECT u.*, lex.score FROM (SELECT * FROM lex ORDER BY score DESC, id LIMIT 200) lex JOIN units u USING (id))
SELECT id, round(score + {_tier_sql(_NAMES, '3.0 * (SELECT max(score) FROM cand)')}, 6) AS score FROM cand
UNION ALL SELECT id, round({_tier_sql(_NAMES, '3.0 * (SELECT max(score) FROM cand)')}, 6) FROM units WHERE id NOT IN (SELECT id FROM cand) AND {_either([_def_sql(n) for n in _NAMES])} AND {_either([_stem_is(n) for n in _NAMES])}""",
    "stem_boost": f"WITH {_CAND} SELECT id, round(score + CASE WHEN {_share_sql(['doc', 'examples', 'session'])} >= 0.1 THEN (SELECT max(score) FROM cand) * {_share_sql(['doc', 'examples', 'session'])} ELSE 0 END, 6) AS score FROM cand",
    "line_chunks": _CHUNKS_SQL,
    "search_hybrid": _search_sql(PLAIN_QUERY, 0.75, ["LoadDoc7"], [_stem_starts("LoadDoc7")], 1.5, ["benchmark", "examples", "loaddoc7", "open", "session"], ["LoadDoc7"]),
    "search_symbol": _search_sql(SYMBOL, 0.3, ["doc_17", "pkg\\.doc_17"], [_stem_is("doc_17")], 3.0, [], ["doc_17"]),
    "search_words": _search_sql(QUERY, 0.75, [], [], 1.5, ["benchmark", "code", "licensed", "session"], []),
    "find_symbol": _search_sql("doc_9", 0.0, ["doc_9"], [_stem_is("doc_9")], 3.0, [], ["doc_9"], 10),
    "saturation_rerank": f"""WITH {_CAND}, p AS (SELECT id, file, score * {_PENALTY} AS s FROM cand), r AS (SELECT id, s * pow(0.5, row_number() OVER (PARTITION BY file ORDER BY s DESC, id) - 1) AS e FROM p)
SELECT id, round(e, 6) AS score FROM r ORDER BY e DESC, id LIMIT 20""",
    "exact_identifier": f"WITH {FILES} SELECT doc_id, path FROM files WHERE contains(content, 'load_doc_1')",
    "containment_dedup": """WITH c AS (SELECT l_orderkey AS path, l_linenumber AS rank, l_partkey % 50 AS start_line, l_partkey % 50 + l_suppkey % 30 AS end_line FROM lineitem)
SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.path = c.path AND o.start_line <= c.start_line AND o.end_line >= c.end_line AND o.rank < c.rank)""",
    "snapshot_diff": f"""WITH {FILES}, o AS (SELECT path, sha256(text) AS h FROM files), n AS (SELECT path, sha256(CASE WHEN doc_id % 10 = 1 THEN text || '!' ELSE text END) AS h FROM files WHERE doc_id % 10 <> 0 UNION ALL SELECT 'copy/' || path, sha256(text) FROM files WHERE doc_id % 10 = 2)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.path = n.path WHERE o.h IS DISTINCT FROM n.h""",
    "memo_hits": "SELECT doc_id, sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) AS hit FROM documents",
    "index_stats_lang": f"WITH {FILES} SELECT language, count(DISTINCT path) AS files, count(*) AS chunks FROM files GROUP BY language",
    "graph_expand": f"""WITH RECURSIVE {_EDGES}, b AS (SELECT unnest(['r1', 'n3']) AS id, 0 AS hop UNION SELECT dst, hop + 1 FROM b JOIN edges ON src = id WHERE hop < 3) SELECT id, min(hop) AS hop FROM b GROUP BY id""",
    "graph_neighbors": f"WITH {_EDGES} SELECT dst AS id, kind, 'out' AS way FROM edges WHERE src = 'n3' UNION ALL SELECT src, kind, 'in' FROM edges WHERE dst = 'n3'",
    "graph_stats": f"WITH {_EDGES} SELECT kind, count(*) AS n_edges, count(DISTINCT src) AS n_src FROM edges GROUP BY kind",
    "user_last_event": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tok_identifiers, enrich_path, word_counts, line_chunks, chunk_ids, bm25_term_stats, bm25_corpus_stats, bm25_topk, vec_topk, vec_topk_filtered, vec_related, sim_matrix, hash_embed,
        hybrid_minmax, hybrid_rrf, file_coherence, path_penalty, definition_match, definition_boost, stem_boost, saturation_rerank, exact_identifier, search_hybrid, search_symbol, search_words, find_symbol, containment_dedup,
        snapshot_diff, memo_hits, index_stats_lang, graph_expand, graph_neighbors, graph_stats, user_last_event,
    )
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_topk(spark, sf_dir)
