"""The file score: eight signals of a file for a query, weighted, and the search that uses it."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions.text import file_name, words
from lantern.operators import dense
from lantern.plans.staging import staged

NAMES = ("embedding", "filename", "path", "symbol", "graph", "import_rel", "idf", "structural")


@dataclass(frozen=True)
class Weights:
    """Weight of each signal; they are normalised, `structural` has no signal yet."""

    embedding: float = 0.4
    symbol: float = 0.15
    filename: float = 0.15
    graph: float = 0.1
    path: float = 0.1
    idf: float = 0.05
    import_rel: float = 0.05
    structural: float = 0


def query_tokens(query: str) -> list[str]:
    """Tokens of a query, repeats included."""
    return re.findall(r"\w+", query.lower(), re.ASCII)


def _set(tokens: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in sorted(set(tokens))]).cast("array<string>")


def _overlap(tokens: Column, query: str) -> Column:
    asked = set(query_tokens(query))
    return F.size(F.array_intersect(tokens, _set(sorted(asked)))) / F.lit(float(max(1, len(asked))))


def _apart(text: Column, signs: str = "._") -> Column:
    return words(F.translate(text, signs, " " * len(signs)))


def filename_score(query: str, path: Column) -> Column:
    """Part of the query's tokens in the file name; tokens of the query keep their underscores, those of the name don't."""
    return F.coalesce(_overlap(_apart(file_name(path)), query), F.lit(0.0))


def path_score(query: str, path: Column) -> Column:
    """Part of the query's tokens in the names of the folders."""
    parts = F.split(path, "/")
    folders = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    return F.coalesce(F.least(_overlap(_apart(folders, "_"), query), F.lit(1.0)), F.lit(0.0))


def symbol_score(query: str, symbols: Column, text: Column) -> Column:
    """The best overlap of a symbol's last segment, or half that of the text; at most 1."""
    each = F.transform(symbols, lambda s: _overlap(_apart(F.element_at(F.split(s, "::"), -1), "_"), query))
    best = F.coalesce(F.array_max(each), F.lit(0.0))
    return F.least(F.greatest(best, 0.5 * F.coalesce(_overlap(words(text), query), F.lit(0.0))), F.lit(1.0))


def idf_score(query: str, idf: Column) -> Column:
    """Mean weight (map of term to idf in the file) of the query's tokens, a fifth of it, at most 1."""
    tokens = query_tokens(query)
    if not tokens:
        return F.lit(0.0)
    total = F.lit(0.0)
    for t in tokens:
        total = total + F.coalesce(F.try_element_at(idf, F.lit(t)), F.lit(0.0))
    return F.least(total / len(tokens) / 5.0, F.lit(1.0))


def graph_scores(files: DataFrame, adjacency: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(path, graph): 1/hop from the nearest seed over `adjacency` (path, other), at most `hops` away; 0 for seeds and others."""
    seen = front = seeds.select("path").distinct().withColumn("hop", F.lit(0))
    for h in range(1, hops + 1):
        found = adjacency.join(front.select("path"), "path", "left_semi").select(F.col("other").alias("path")).distinct()
        front = staged(found.join(seen.select("path"), "path", "left_anti").withColumn("hop", F.lit(h)), "signal-hop")
        seen = seen.union(front)
    near = seen.select("path", F.when(F.col("hop") > 0, 1.0 / F.greatest("hop", F.lit(1))).alias("graph"))
    return files.select("path").distinct().join(near, "path", "left").select("path", F.coalesce("graph", F.lit(0.0)).alias("graph"))


def import_scores(files: DataFrame, imports: DataFrame, seeds: DataFrame) -> DataFrame:
    """(path, import_rel): for every seed 0.1 if both import one thing, 0.3 if the file imports the seed; at most 1, 0 for seeds.

    `imports` is (path, target).  Counts are of different seeds; pairs of a file and a
    seed are formed only over what both import, and the seeds are those of one query.
    """
    own = imports.select("path", "target").distinct()
    seed = seeds.select("path").distinct()
    theirs = own.join(seed, "path", "left_semi").select(F.col("path").alias("seed"), "target")
    shared = own.join(theirs, "target").where("path <> seed").select("path", "seed").distinct().groupBy("path").agg((F.count(F.lit(1)) * 0.1).alias("shared"))
    direct = own.join(seed.select(F.col("path").alias("target")), "target", "left_semi").groupBy("path").agg((F.count(F.lit(1)) * 0.3).alias("direct"))
    rest = files.select("path").distinct().join(seed.withColumn("is_seed", F.lit(True)), "path", "left").join(shared, "path", "left").join(direct, "path", "left")
    total = F.least(F.coalesce("shared", F.lit(0.0)) + F.coalesce("direct", F.lit(0.0)), F.lit(1.0))
    return rest.select("path", F.when(F.col("is_seed"), 0.0).otherwise(total).alias("import_rel"))


def combined(signals: dict[str, Column], weights: Weights | None = None) -> Column:
    """Weighted mean of the signals, the embedding's clipped to 0..1; missing ones count zero."""
    w = asdict(weights or Weights())
    total = sum(w.values())
    zero = F.lit(0.0)
    out = zero
    for name in NAMES:
        value = F.coalesce(signals.get(name, zero).cast("double"), zero)
        if name == "embedding":
            value = F.least(F.greatest(value, zero), F.lit(1.0))
        out = out + value * F.lit(w[name] / total if total > 0 else w[name])
    return out


def best_per_file(scored: DataFrame, id_col: str = "id") -> DataFrame:
    """The best chunk of each file: path, id and score; ties to the lesser id."""
    nth = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), id_col))
    return scored.withColumn("nth", nth).where("nth = 1").select("path", id_col, "score")


@dataclass
class Corpus:
    """What the context search reads: chunks (id, path, content, vector), and optionally symbols (path, name), imports (path, target), adjacency (path, other) and idf (path, idf map)."""

    chunks: DataFrame
    symbols: DataFrame | None = None
    imports: DataFrame | None = None
    adjacency: DataFrame | None = None
    idf: DataFrame | None = None


def _scored(c: Corpus, query: str, files: DataFrame, seeds: DataFrame, weights: Weights | None) -> DataFrame:
    """`files` (path, id, embedding, content) with every signal and score; of one query, so few."""
    spark = files.sparkSession
    paths = files.select("path")
    syms = c.symbols.join(F.broadcast(paths), "path", "left_semi").groupBy("path").agg(F.collect_set("name").alias("symbols")) if c.symbols is not None else spark.createDataFrame([], "path string, symbols array<string>")
    idf = c.idf.join(F.broadcast(paths), "path", "left_semi") if c.idf is not None else spark.createDataFrame([], "path string, idf map<string,double>")
    near = graph_scores(files, c.adjacency, seeds) if c.adjacency is not None else paths.withColumn("graph", F.lit(0.0))
    rel = import_scores(files, c.imports, seeds) if c.imports is not None else paths.withColumn("import_rel", F.lit(0.0))
    out = files.join(syms, "path", "left").join(idf, "path", "left").join(near, "path").join(rel, "path")
    p = F.col("path")
    signals = {
        "embedding": F.col("embedding"), "filename": filename_score(query, p), "path": path_score(query, p), "symbol": symbol_score(query, F.col("symbols"), F.col("content")),
        "graph": F.col("graph"), "import_rel": F.col("import_rel"), "idf": F.coalesce(idf_score(query, F.col("idf")), F.lit(0.0)), "structural": F.lit(0.0),
    }
    clipped = F.least(F.greatest(F.coalesce("embedding", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    parts = F.create_map(*[x for n in NAMES for x in (F.lit(n), (clipped if n == "embedding" else signals[n]).cast("double"))])
    return out.select("path", combined(signals, weights).alias("score"), parts.alias("components"), "id", F.substring("content", 1, 500).alias("snippet"))


def related_files(c: Corpus, primary: DataFrame, seeds: DataFrame) -> DataFrame:
    """(path): files beside the primary ones: neighbours (three each, in order of name) and tests by name, with chunks and no seeds."""
    p = F.col("path")
    base = F.replace(p, F.lit(".py"), F.lit(""))
    last = F.element_at(F.split(base, "/"), -1)
    names = F.array(F.concat(F.lit("tests/test_"), last, F.lit(".py")), F.concat(F.lit("test_"), last, F.lit(".py")), F.concat(base, F.lit("_test.py")))
    found = primary.select(F.explode(names).alias("path"))
    if c.adjacency is not None:
        nth = F.row_number().over(Window.partitionBy("path").orderBy("other"))
        near = c.adjacency.select("path", "other").distinct().join(F.broadcast(primary.select("path")), "path", "left_semi").withColumn("nth", nth).where("nth <= 3")
        found = found.union(near.select("other"))
    return c.chunks.select("path").join(F.broadcast(found.distinct()), "path", "left_semi").distinct().join(seeds.select("path"), "path", "left_anti")


def context_search(c: Corpus, query: str, query_vector: list[float], top_dense: int = 50, top_final: int = 10, expand: bool = True, max_related: int = 8, weights: Weights | None = None) -> tuple[DataFrame, DataFrame]:
    """(primary, related), each (rank, path, score, components, id, snippet).

    Primary files are those of the `top_dense` chunks by raw product, scored by all
    signals, the best `top_final`.  Related files add no embedding; their first chunk
    speaks for them.  Everything after the first scan is of `top_dense` rows at most.
    """
    best = dense.ranked(c.chunks.select("id", "path", F.col("vector").alias("v")), query_vector, top_dense)
    top = staged(best_per_file(best.select("path", "id", "score")), "context-top")
    seeds = top.select("path")
    files = c.chunks.select("id", "content").join(F.broadcast(top), "id").select("path", "id", F.col("score").alias("embedding"), "content")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "path")  # top_dense rows
    primary = staged(_scored(c, query, files, seeds, weights).orderBy(F.desc("score"), "path").limit(top_final), "context-primary")
    out = primary.withColumn("rank", F.row_number().over(order)).orderBy("rank")
    if not expand:
        return out, out.limit(0)
    more = staged(related_files(c, primary, seeds), "context-related")
    first = c.chunks.join(F.broadcast(more), "path", "left_semi").groupBy("path").agg(F.min(F.struct("id", "content")).alias("f"))
    files = first.select("path", "f.id", F.lit(0.0).alias("embedding"), "f.content")
    related = _scored(c, query, files, primary.select("path"), weights).orderBy(F.desc("score"), "path").limit(max_related)
    return out, staged(related, "context-files").withColumn("rank", F.row_number().over(order)).orderBy("rank")


def to_text(query: str, primary: list, related: list) -> str:
    """Markdown of collected rows: each file with its score, signals above zero and its snippet."""
    out = [f"# Context for: {query}", "", "## Primary files"]
    for r in primary:
        out.append(f"\n### {r['path']} (score: {r['score']:.3f})")
        shown = ", ".join(f"{k}={r['components'][k]:.2f}" for k in NAMES if r["components"][k] > 0)
        out += ([f"  Signals: {shown}"] if shown else []) + ["```", r["snippet"], "```"]
    if related:
        out.append("\n## Related files (context expansion)")
        for r in related:
            out += [f"\n### {r['path']} (score: {r['score']:.3f})", "```", r["snippet"][:300], "```"]
    return "\n".join(out)
