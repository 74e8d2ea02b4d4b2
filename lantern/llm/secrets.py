"""Secret scans over an incremental blob ledger (DataFrame functions only).

Every version of every path is addressed by the SHA-256 of its text.  The ledger has a
row for each (blob, rule version) that was ever scanned, so a run scans only pairs
that it lacks, each blob once however many paths and versions carry it, and joins the
findings back to all paths.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.tables import join_hot, staged

KINDS = ("assign", "access", "hex")
#: Leftmost, non-overlapping.  A run that is too short for `access` or `hex` has no later start within it that is long enough, so their least lengths stand in the pattern; a failing `assign` uses up its text, so its value is measured afterwards.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
MIN_VALUE = 6
RULE_VERSION = hashlib.sha256(repr((PATTERNS, MIN_VALUE)).encode()).hexdigest()[:16]
LEDGER = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _may(text: Column, kind: str) -> Column:
    """False only where the kind can't match; cheaper than its pattern."""
    if kind == "assign":
        low = F.lower(text)
        return (low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("key")) & text.rlike(PATTERNS[kind])
    return text.contains("AKIA") if kind == "access" else text.rlike(PATTERNS[kind])


def _spans(text: Column, kind: str) -> Column:
    """array<struct<start, kind, end>> in code points: what lies between the matches, and the matches, have lengths."""
    pattern = PATTERNS[kind]
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else F.array().cast("array<string>")
    found = F.struct(gaps.alias("gaps"), hits.alias("hits"), values.alias("values"))

    def each(f: Column) -> Column:
        pairs = F.arrays_zip(F.slice(f["gaps"], F.lit(1), F.size(f["hits"])).alias("gap"), f["hits"].alias("hit"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + x["gap"]
            e = s + x["hit"]
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), e.alias("end")))).alias("out"))

        out = F.aggregate(pairs, start, step, lambda acc: acc["out"])
        if kind == "assign":
            return F.filter(out, lambda x, i: F.length(F.get(f["values"], i)) >= MIN_VALUE)
        return out

    # A one-element array binds `found`, so that each pattern runs once.
    return F.when(_may(text, kind), F.get(F.transform(F.array(found), each), F.lit(0))).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """Ledger rows of (blob, text)."""
    text = F.col("text")
    spans = blobs.select("blob", *[_spans(text, k).alias(k) for k in KINDS])
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = F.array_join(F.transform(F.array_sort(F.concat(*KINDS)), lambda x: F.concat(F.get(names, x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")
    out = spans.select("blob", F.lit(RULE_VERSION).alias("rule_version"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], joined.alias("spans"))
    return out.select("blob", "rule_version", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings of every row of `versions`, new ledger rows to append).

    `versions` may hold many texts of one path.  Null texts are empty, null paths and
    repeated rows stay as rows, other columns are not read.  Findings have the path,
    the blob and the ledger's columns; offsets are code points, the end exclusive.
    """
    rows = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    addressed = staged(rows.select("path", "blob"), "secret-blobs")
    seen = None if ledger is None else ledger.where(F.col("rule_version") == RULE_VERSION)
    unseen = addressed.groupBy("blob").agg(F.min("path").alias("path"))
    if seen is not None:
        unseen = unseen.join(seen.select("blob").distinct(), "blob", "left_anti")
    one = unseen.select(F.col("blob").alias("b"), F.col("path").alias("p"))
    # Only ids are built into hash tables; texts stream past them, unsorted, each blob's text once per row of its first path.
    texts = rows.join(one.hint("shuffle_hash"), F.col("path").eqNullSafe(F.col("p")) & (F.col("blob") == F.col("b")), "left_semi")
    new = staged(scan_blobs(texts.select("blob", "text")).dropDuplicates(["blob"]), "secret-ledger")
    known = new if seen is None else new.unionByName(seen.select(*new.columns).dropDuplicates(["blob"]))
    counts = addressed.groupBy("blob").agg(F.count(F.lit(1)).alias("rows"))
    of_blob = staged(known.join(counts, "blob"), "secret-known")
    found = join_hot(addressed, of_blob, ["blob"], addressed.count())  # one text may be a third of all rows
    return found.withColumnRenamed("path", path), new


def _sql_spans(kind: str) -> str:
    p = PATTERNS[kind].replace("'", "''")
    k = KINDS.index(kind)
    keep = f"length(vals[i]) >= {MIN_VALUE}" if kind == "assign" else "true"
    vals = f"regexp_extract_all(t, '{p}', 2)" if kind == "assign" else "[]::VARCHAR[]"
    return f"""{kind}_parts AS (SELECT doc_id, list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS gaps,
  list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x)) AS hits, {vals} AS vals FROM d),
{kind}_spans AS (SELECT doc_id, list_transform(list_filter(range(1, len(hits) + 1), lambda i: {keep}), lambda i:
  {{'s': coalesce(list_sum(gaps[1:i]), 0)::BIGINT + coalesce(list_sum(hits[1:i-1]), 0)::BIGINT, 'k': {k},
    'e': coalesce(list_sum(gaps[1:i]), 0)::BIGINT + coalesce(list_sum(hits[1:i]), 0)::BIGINT}}) AS v FROM {kind}_parts)"""


SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{', '.join(_sql_spans(k) for k in KINDS)},
j AS (SELECT doc_id, len(assign_spans.v)::BIGINT AS n_assign, len(access_spans.v)::BIGINT AS n_access, len(hex_spans.v)::BIGINT AS n_hex,
  array_to_string(list_transform(list_sort(list_concat(list_concat(assign_spans.v, access_spans.v), hex_spans.v)),
    lambda x: (['assign', 'access', 'hex'])[x.k + 1] || ':' || x.s || ':' || x.e), ',') AS spans
  FROM assign_spans JOIN access_spans USING (doc_id) JOIN hex_spans USING (doc_id))
SELECT doc_id, n_assign, n_access, n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM j"""
