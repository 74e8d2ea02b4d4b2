"""Fusion, boosts, penalties, saturation and containment, on a table of candidates."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions.columns import unused
from lantern.functions.text import directories, file_name, split_identifier, stem

_NAME = r"[A-Za-z_]\w*"
#: Between the parts of a qualified name; the first of these that occurs splits it.
_MARKS = ["::", "\\"] + ["->", "."]
SYMBOL_QUERY = re.compile(rf"^(?:{_NAME}(?:(?:::|\\|->|\.){_NAME})+|_\w*|[A-Za-z][A-Za-z0-9]*[A-Z_]\w*|[A-Z][A-Za-z0-9]*)$", re.ASCII)
#: Names in mixed case within plain language.
EMBEDDED = re.compile(r"\b(?:[A-Z][a-z][^\W_]*[A-Z][^\W_]*|[a-z][^\W_]*[A-Z][^\W_]+)\b", re.ASCII)
#: Words that introduce a definition, of two words each in some languages.
DEFINERS = "abstract class|class|data class|def|defmodule|enum|fn|fun|func|function|interface|module|namespace|object|package|protocol|record|struct|trait|type|typedef"
STOP = frozenset("a an as at be by do if in is it of on or to and are for has how not the was who why does from have what when with where which".split())
DEFINITION, EMBEDDED_SCALE, COHERENCE, NAMED_FILE = 3.0, 0.5, 0.2, 1.5
STEM_LENGTH = 4
_TEST_FILE = r"(?:^|/)(?:test_[^/]*\.py|[^/]*_test\.(?:py|go)|[^/]*Tests?\.java|[^/]*\.(?:test|spec)\.[jt]sx?|test_helpers?[^/]*\.\w+)$"


def everything():
    """The window of all candidates, which are few: two legs of at most 200, and exact hits."""
    return Window.partitionBy(F.lit(0))


def is_symbol_query(query: str) -> bool:
    """A bare or qualified identifier, rather than plain language."""
    return bool(SYMBOL_QUERY.match(query.strip()))


def resolve_alpha(query: str, alpha: float | None = None) -> float:
    """Weight of the dense leg: as given, else 0.3 for a symbol and 0.75 for plain language."""
    if alpha is not None:
        if not 0 <= alpha <= 1:
            raise ValueError("alpha must lie between 0 and 1")
        return alpha
    return 0.3 if is_symbol_query(query) else 0.75


def relative(score: Column) -> Column:
    """Min-max over all candidates; a constant positive leg counts one."""
    low, high = F.min(score).over(everything()), F.max(score).over(everything())
    return F.when(high == low, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((score - low) / (high - low))


def fuse(dense: DataFrame, lexical: DataFrame, alpha: float, how: str = "minmax", rrf_k: int = 60) -> DataFrame:
    """(id, score) over the union of both legs; a missing leg counts zero."""

    def leg(df: DataFrame, name: str) -> DataFrame:
        if how == "rrf":
            return df.select("id", (1.0 / (rrf_k + F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")))).alias(name))
        return df.select("id", relative(F.col("score")).alias(name))

    both = leg(dense, "dense").join(leg(lexical, "lexical"), "id", "full_outer").fillna(0.0, ["dense", "lexical"])
    return both.select("id", (F.lit(alpha) * F.col("dense") + F.lit(1 - alpha) * F.col("lexical")).alias("score"))


def boost_coherent_files(c: DataFrame, path: str = "path", score: str = "score", weight: float = COHERENCE) -> DataFrame:
    """The best chunk of each file (least id on ties) gains weight x max score x (sum of its file / largest sum); nothing if the max is zero."""
    total, first, top, most = unused(c, "sum", "first", "max", "most")
    per = Window.partitionBy(path)
    c = c.withColumns({total: F.sum(score).over(per), first: F.row_number().over(per.orderBy(F.desc(score), "id")) == 1, top: F.max(score).over(everything())})
    c = c.withColumn(most, F.max(total).over(everything()))
    gain = F.when(F.col(first) & (F.col(top) != 0), weight * F.col(top) * F.col(total) / F.col(most)).otherwise(0.0)
    return c.withColumn(score, F.col(score) + gain).drop(total, first, top, most)


def defines(content: Column, name: str) -> Column:
    """Does the text define `name`, qualified or not?  Case counts."""
    return F.coalesce(content.rlike(rf"(?m)(?:^|\s)(?:{DEFINERS})\s+(?:[A-Za-z_]\w*(?:\.|::))*{re.escape(name)}(?:\s|[<(\{{:\[;]|$)"), F.lit(False))


def stem_matches(stem_col: Column, name: str) -> Column:
    """Is a file stem the name, in lower case, without underscores in the stem or letters s at its end?"""
    s, n = F.lower(stem_col), name.lower()
    bare = F.replace(s, F.lit("_"), F.lit(""))
    return (s == n) | (bare == n) | (F.regexp_replace(s, "s+$", "") == n) | (F.regexp_replace(bare, "s+$", "") == n)


def stem_begins(stem_col: Column, name: str) -> Column:
    """Is a file stem the name, or a beginning of it of four characters or more?"""
    s, n = F.lower(stem_col), F.lit(name.lower())
    bare = F.replace(s, F.lit("_"), F.lit(""))
    begins = lambda x: (F.length(x) >= STEM_LENGTH) & F.startswith(n, x)
    return (s == n) | (bare == n) | begins(s) | begins(bare)


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def symbol_names(query: str) -> list[str]:
    """The last segment of a qualified name, and all of it."""
    mark = next((m for m in _MARKS if m in query), None)
    return sorted({query.strip() if mark is None else query.rsplit(mark, 1)[-1], query.strip()})


def tier(content: Column, path: Column, names: list[str], unit: Column) -> Column:
    """What a chunk gains that defines one of `names`: `unit`, half as much again where its file is named after one; else 0."""
    named = _any([stem_matches(stem(path), n) for n in names])
    return F.when(_any([defines(content, n) for n in names]), unit * F.when(named, NAMED_FILE).otherwise(1.0)).otherwise(0.0)


def boost_definitions(c: DataFrame, names: list[str], unit: Column, content: str = "content", path: str = "path", score: str = "score", chunks: DataFrame | None = None, enters: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks that define one of `names` gain their tier, once each.

    Of `chunks` (all of them, with id), those outside the candidates that define a name
    and whose file stem `enters` accepts (by default: is named after a name) come in
    with their tier as score.
    """
    if not names:
        return c
    boosted = c.withColumn(score, F.col(score) + tier(F.col(content), F.col(path), names, unit))
    if chunks is None:
        return boosted
    (mark,) = unused(c, "unit")
    ok = enters(stem(F.col(path))) if enters else _any([stem_matches(stem(F.col(path)), n) for n in names])
    one = c.select(unit.alias(mark)).limit(1)  # one row
    more = chunks.where(ok & _any([defines(F.col(content), n) for n in names])).join(F.broadcast(c.select("id")), "id", "left_anti").crossJoin(F.broadcast(one))
    return boosted.unionByName(more.withColumn(score, tier(F.col(content), F.col(path), names, F.col(mark))).drop(mark), allowMissingColumns=True)


def query_keywords(query: str) -> list[str]:
    """Identifiers of three characters or more that aren't stop words, in lower case, once each."""
    return sorted({w.lower() for w in re.findall(_NAME, query, re.ASCII) if len(w) > 2 and w.lower() not in STOP})


def stem_share(path: Column, keywords: list[str]) -> Column:
    """Part of the keywords that the stem or its directory names; prefixes of three characters count."""
    dirs = directories(path)
    parent = F.when(F.size(dirs) > 0, F.element_at(dirs, -1)).otherwise("")
    parts = F.array_distinct(F.concat(split_identifier(stem(path)), split_identifier(parent)))
    keys = F.array(*[F.lit(k) for k in keywords])
    near = F.filter(keys, lambda k: F.exists(parts, lambda p: (k == p) | ((F.length(p) >= 3) & k.startswith(p)) | p.startswith(k)))
    return F.size(near) / F.lit(float(max(1, len(keywords))))


def boost_stems(c: DataFrame, query: str, top: Column, path: str = "path", score: str = "score") -> DataFrame:
    """Chunks gain `top` x the part of the query's keywords that their path names, from a tenth on."""
    keys = query_keywords(query)
    if not keys:
        return c
    share = stem_share(F.col(path), keys)
    return c.withColumn(score, F.col(score) + F.when(share >= 0.10, top * share).otherwise(0.0))


def boost_query(c: DataFrame, query: str, chunks: DataFrame, score: str = "score") -> DataFrame:
    """The boosts of a query's kind, all measured against the best score before them: definitions of a symbol, or stems and then embedded symbols."""
    (mark,) = unused(c, "top")
    c = c.withColumn(mark, F.max(score).over(everything()))
    if is_symbol_query(query):
        names = symbol_names(query)
        last = names[0] if len(names) == 1 else next(n for n in names if n != query.strip())
        return boost_definitions(c, names, DEFINITION * F.col(mark), score=score, chunks=chunks, enters=lambda s: stem_matches(s, last)).drop(mark)
    c = boost_stems(c, query, F.col(mark), score=score)
    names = sorted(set(EMBEDDED.findall(query)))
    return boost_definitions(c, names, DEFINITION * EMBEDDED_SCALE * F.col(mark), score=score, chunks=chunks, enters=lambda s: _any([stem_begins(s, n) for n in names])).drop(mark)


def exact_identifiers(query: str) -> list[str]:
    """Words of a query with an underscore, a capital after the first letter, or a digit."""
    words = re.findall(_NAME, query, re.ASCII)
    return sorted({w for w in words if "_" in w or any(x.isupper() for x in w[1:]) or any(x.isdigit() for x in w)})


def flag_exact(c: DataFrame, query: str, chunks: DataFrame, score: str = "score") -> DataFrame:
    """With `exact`: does the content hold an identifier of the query?  Of `chunks`, those that do and are no candidates enter one above the best score."""
    names = exact_identifiers(query)
    if not names:
        return c.withColumn("exact", F.lit(False))
    holds = F.coalesce(_any([F.col("content").contains(n) for n in names]), F.lit(False))
    best = c.agg((F.coalesce(F.max(score), F.lit(0.0)) + 1.0).alias(score))  # one row
    more = chunks.where(holds).join(c.select("id"), "id", "left_anti").crossJoin(F.broadcast(best)).withColumn("exact", F.lit(True))
    return c.withColumn("exact", holds).unionByName(more, allowMissingColumns=True)


def path_penalty(path: Column) -> Column:
    """Factor for tests, re-exports, compatibility code, examples and type declarations; they multiply."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))

    def below(names: str) -> Column:
        return p.rlike(rf"(?:^|/)(?:{names})(?:/|$)")

    return (
        F.when(p.rlike(_TEST_FILE) | below("tests?|__tests__|spec|testing"), 0.3).otherwise(1.0)
        * F.when(file_name(path).isin("__init__.py", "package-info.java"), 0.5).otherwise(1.0)
        * F.when(below("_?compat|legacy"), 0.3).otherwise(1.0)
        * F.when(below("_?examples?|docs?_src"), 0.3).otherwise(1.0)
        * F.when(p.endswith(".d.ts"), 0.7).otherwise(1.0)
    )


def saturate(c: DataFrame, k: int | None = None, path: str = "path", score: str = "score", decay: float = 0.5) -> DataFrame:
    """The n-th best chunk of a file counts decay**(n-1) of its score; then the best k."""
    nth = F.row_number().over(Window.partitionBy(path).orderBy(F.desc(score), "id"))
    out = c.withColumn(score, F.col(score) * F.pow(F.lit(decay), nth - 1))
    return out if k is None else out.orderBy(F.desc(score), "id").limit(k)


def drop_contained(c: DataFrame, rank: str = "rank", path: str = "path") -> DataFrame:
    """Without chunks whose line range lies inside that of a better-ranked chunk of their file."""
    names = unused(c, "o_path", "o_start", "o_end", "o_rank")
    op, os, oe, orank = (F.col(n) for n in names)
    o = c.select(*[F.col(x).alias(n) for x, n in zip((path, "start_line", "end_line", rank), names)])
    inside = (F.col(path) == op) & (os <= F.col("start_line")) & (oe >= F.col("end_line")) & (orank < F.col(rank))
    return c.join(o, inside, "left_anti")


def rank_results(c: DataFrame, k: int, penalise: bool = True, min_score: float = 0.0) -> DataFrame:
    """The last steps of a search over flagged candidates: penalties, saturation to 2k, exact hits first, containment, k, score limits.

    Ties are broken by id.  Scores aren't monotone, since exact hits come first; `rank`
    counts from 1.
    """
    if penalise:
        c = c.withColumn("score", F.col("score") * path_penalty(F.col("path")))
    c = saturate(c, 2 * k)
    c = c.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf")) & (F.col("score") > 0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("exact"), F.desc("score"), "id")  # of 2k rows
    c = drop_contained(c.withColumn("rank", F.row_number().over(order))).orderBy("rank").limit(k)
    return c.where(F.col("score") >= min_score).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rank")))


def local(df: DataFrame) -> DataFrame:
    """The rows of a table with a proven bound, held by the driver, so that later steps don't compute them again."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def search_hybrid(query: str, dense: DataFrame, lexical: DataFrame, chunks: DataFrame, k: int = 10, alpha: float | None = None, min_score: float = 0) -> DataFrame:
    """(rank, id, path, start_line, end_line, content, score, exact) of the k best chunks.

    `dense` and `lexical` have id and score of the best candidates of each leg, at most
    max(200, k); `chunks` has id, path, start_line, end_line and content of all.  The
    candidates, twice that many at most and without their texts, are held by the driver
    between steps.  `chunks` is read for the candidates' texts, for chunks that define a
    name or hold an identifier of the query (which stay distributed until the best 2k
    are taken), and for the texts of the result.
    """
    if not (query or "").strip() or k < 1:
        raise ValueError("a search needs a query and a place for its result")
    weight = resolve_alpha(query, alpha)
    every = chunks.select("id", "path", "start_line", "end_line", "content")
    symbol = is_symbol_query(query)
    names = symbol_names(query) if symbol else sorted(set(EMBEDDED.findall(query)))
    scale = DEFINITION if symbol else DEFINITION * EMBEDDED_SCALE
    last = next((n for n in names if n != query.strip()), names[0]) if symbol else None
    file_stem = stem(F.col("path"))
    enters = stem_matches(file_stem, last) if symbol else _any([stem_begins(file_stem, n) for n in names])
    keys = [] if symbol else query_keywords(query)
    share = stem_share(F.col("path"), keys) if keys else F.lit(0.0)
    factor = tier(F.col("content"), F.col("path"), names, F.lit(1.0))
    identifiers = exact_identifiers(query)
    holds = F.coalesce(_any([F.col("content").contains(n) for n in identifiers]), F.lit(False))
    place = ["id", "path", "start_line", "end_line"]

    fused = local(fuse(dense, lexical, weight))
    c = local(every.join(F.broadcast(fused), "id").select(*place, "score", factor.alias("factor"), share.alias("share"), holds.alias("exact")))
    c = boost_coherent_files(c).withColumn("top", F.max("score").over(everything()))
    c = c.withColumn("score", F.col("score") + F.when(F.col("share") >= 0.10, F.col("top") * F.col("share")).otherwise(0.0) + scale * F.col("top") * F.col("factor"))
    c = local(c.select(*place, "score", "exact", "top"))
    best = c.agg(F.max("score").alias("best"), F.max("top").alias("top")).first()
    top = best["top"] or 0.0
    if names or identifiers:
        others = every.join(F.broadcast(c.select("id")), "id", "left_anti").withColumn("tier", F.when(enters, factor).otherwise(0.0) * F.lit(scale * top)).withColumn("exact", holds)
        highest = best["best"] or 0.0
        if names and identifiers:
            highest = max(highest, others.agg(F.max("tier")).first()[0] or 0.0)
        more = others.where((F.col("tier") > 0) | F.col("exact")).select(*place, F.when(F.col("tier") > 0, F.col("tier")).otherwise(highest + 1.0).alias("score"), "exact")
        c = c.drop("top").unionByName(more)
    found = local(rank_results(c, k, weight < 1.0, min_score).select("rank", *place, "score", "exact"))
    return every.select("id", "content").join(F.broadcast(found), "id").select("rank", *place, "content", "score", "exact").orderBy("rank")
