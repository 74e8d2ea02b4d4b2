"""Mixing sources by temperature (DataFrame functions only).

A source with share p of all tokens gets the weight p**a / sum(p**a).  The exponent a
lies on a grid of 2**-20 and is found by bisection: the least a in [0, 1] whose mixture
repeats no source more than `max_epochs` times, or whose entropy (in nats) has come down
from that of the uniform mixture to `target_entropy`, or both.  Both quantities fall as
a rises to 1; an entropy below that of the sources as they are is sought up to MOST.
Without a budget the mixture has the least size that drops nothing: one source is read
exactly once, all others more often.  With one, sources are read for their part of it.

Each source is read as whole epochs and then a part of one, cut from a permutation of
its documents.  The permutation is split into blocks by hash, so a source with a third
of all rows is many groups: a document's place is its block's offset plus its place in
the block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.llm.tables import staged, unused

MAX_EPOCHS = 2.0
STEPS, WAYS = 1 << 20, 32
BLOCK_ROWS = 20_000
SEED = "mix-1"
#: The greatest exponent that is tried for an entropy.
MOST = 8


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _tokens() -> Column:
    words = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[ \t\n\r]+"), lambda w: w != "")
    return F.size(words).cast("long")


def _place() -> Column:
    """What orders a source: a hash of the id, or of the text where there is none, so that those don't meet in one block."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))), F.lit("|" + SEED)).cast("binary"))


def exponent(sources: DataFrame, max_epochs: float | None = MAX_EPOCHS, target_entropy: float | None = None) -> float:
    """The least exponent on the grid that meets the limits; 1 without tokens.  `sources`: source, tokens (all above 0).

    Raises where no exponent does: `max_epochs` below 1, an entropy that isn't reached
    at MOST, or one that only exponents beyond 1 reach which repeat a source too often.
    Every job narrows the bracket 32-fold, five halvings at once; one short row for
    each trial comes to the driver.
    """
    if max_epochs is not None and max_epochs < 1:
        raise ValueError("max_epochs must be 1 or more")
    total = sources.agg(F.sum("tokens").alias("s"), F.max("tokens").alias("m"), F.min("tokens").alias("l")).first()
    if not total["s"]:
        return 1.0

    def tried(steps: list[int]) -> list[tuple[int, float, float]]:
        """(step, entropy, epochs of the source read most often) of each."""
        rows = sources.select("tokens", F.explode(F.array(*[F.lit(k) for k in steps])).alias("k")).withColumn("a", F.col("k") / F.lit(float(STEPS)))
        w = F.pow(F.col("tokens") / F.lit(float(total["s"])), F.col("a"))
        stats = rows.groupBy("k").agg(F.sum(w).alias("z"), F.sum(w * F.log(w)).alias("wl")).collect()
        return sorted((r["k"], math.log(r["z"]) - r["wl"] / r["z"], (total["m"] / total["l"]) ** abs(r["k"] / STEPS - 1)) for r in stats)

    def fits(entropy: float, epochs: float) -> bool:
        return (max_epochs is None or epochs <= max_epochs) and (target_entropy is None or entropy <= target_entropy)

    end = STEPS
    if target_entropy is not None:
        (_, at_one, _), (_, at_most, _) = tried([STEPS, MOST * STEPS])
        if at_most > target_entropy:
            raise ValueError(f"no mixture has an entropy of {target_entropy}; the least is {at_most:.6f}")
        end = STEPS if at_one <= target_entropy else MOST * STEPS
    low, high = (-1, end) if end == STEPS else (STEPS, end)  # low fails, high is taken
    by_entropy = end != STEPS
    while high - low > 1:
        width = max(1, (high - low) // WAYS)
        for k, entropy, epochs in tried(list(range(low + width, high, width))):
            if entropy <= target_entropy if by_entropy else fits(entropy, epochs):
                high = min(high, k)
                break
            low = max(low, k)
    if by_entropy and max_epochs is not None and not fits(*tried([high])[0][1:]):
        raise ValueError(f"an entropy of {target_entropy} repeats a source more than {max_epochs} times")
    return high / STEPS


def _planned(docs: DataFrame, max_epochs: float | None, target_entropy: float | None, budget: int | None) -> tuple[DataFrame, int]:
    """(a row for each block of each source: source, block, offset, full, part; digits of a block's name)."""
    rows = staged(docs.select(_source().alias("source"), _tokens().alias("n_tokens"), F.substring(_place(), 1, 8).alias("hash")), "mix-rows")
    sources = staged(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "mix-sources")
    some = sources.where("tokens > 0").coalesce(1)
    a = exponent(some, max_epochs, target_entropy)
    most = sources.agg(F.max("tokens").alias("t"), F.max("n").alias("n")).first()
    digits = min(8, max(1, math.ceil(math.log((most["n"] or 1) / BLOCK_ROWS, 16)))) if (most["n"] or 0) > BLOCK_ROWS else 1
    scale = F.pow(F.col("tokens") / F.lit(float(most["t"] or 1)), F.lit(a - 1.0))
    if budget is None:
        # For exponents up to 1 the largest source has the least scale, 1; beyond, the smallest one has.
        least = 1.0 if a <= 1 else some.agg(F.min(scale)).first()[0]
    else:
        whole = some.agg(F.sum(scale * F.col("tokens"))).first()[0]
        least = (whole or 1.0) / budget
    epochs = F.when(F.col("tokens") > 0, scale / F.lit(least)).otherwise(F.lit(1.0))
    plan = sources.select("source", epochs.alias("epochs"), "tokens")
    plan = plan.select("source", F.floor(F.col("epochs") + 1e-9).cast("long").alias("full"), F.floor((F.col("epochs") - F.floor(F.col("epochs") + 1e-9)) * F.col("tokens") + 1e-6).cast("long").alias("part"))
    blocks = rows.groupBy("source", F.substring("hash", 1, digits).alias("block")).agg(F.sum("n_tokens").alias("t"))
    before = F.sum("t").over(Window.partitionBy("source").orderBy("block")) - F.col("t")
    return blocks.select("source", "block", before.alias("offset")).join(plan, "source"), digits


def _read(docs: DataFrame, max_epochs: float | None, target_entropy: float | None, budget: int | None) -> tuple[DataFrame, list[str]]:
    """`docs` with source, n_tokens, copies, block and start, under the names that are returned."""
    names = unused(docs, "m_source", "m_tokens", "copies", "m_block", "start", "m_key", "m_upto")
    src, n, copies, block, start, key, upto = names
    plan, digits = _planned(docs, max_epochs, target_entropy, budget)
    rows = docs.withColumns({src: _source(), n: _tokens(), key: _place()}).withColumn(block, F.substring(key, 1, digits))
    inside = Window.partitionBy(src, block).orderBy(key, "doc_id", n).rowsBetween(Window.unboundedPreceding, 0)
    renamed = plan.select(F.col("source").alias(src), F.col("block").alias(block), *[F.col(c).alias(f"{upto}_{c}") for c in ("offset", "full", "part")])
    placed = rows.withColumn(upto, F.sum(n).over(inside)).join(renamed, [src, block])
    end = F.col(f"{upto}_offset") + F.col(upto)
    placed = placed.withColumn(copies, F.col(f"{upto}_full") + (end <= F.col(f"{upto}_part")).cast("long")).withColumn(start, end - F.col(n))
    return placed, names


def mixture(docs: DataFrame, max_epochs: float | None = MAX_EPOCHS, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """One row per document: doc_id, source, n_tokens, copies, block and start.

    `copies` is how often the mixture reads the document (once at least, unless there is
    a `budget` of tokens); `start` is the number of tokens before it in its source's
    permutation.  Null sources and texts count as empty strings; tokens are stretches
    without white space; documents without tokens are read once an epoch.  Repeated rows
    stay and share the budget as different documents do; an empty table gives an empty one.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    placed, (src, n, copies, block, start, *_) = _read(narrow, max_epochs, target_entropy, budget)
    return placed.select("doc_id", F.col(src).alias("source"), F.col(n).alias("n_tokens"), F.col(copies).alias("copies"), F.col(block).alias("block"), F.col(start).alias("start"))


def mix(docs: DataFrame, max_epochs: float | None = MAX_EPOCHS, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """`docs` with every row repeated as often as its mixture reads it, rows of a block in the order of its permutation.

    Rows are placed and repeated where they are, one by one, so null and repeated
    doc_ids need no care.
    """
    placed, (_, _, copies, *rest) = _read(docs, max_epochs, target_entropy, budget)
    return placed.where(F.col(copies) > 0).withColumn(rest[0], F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


SQL = f"""WITH RECURSIVE r AS (SELECT doc_id, coalesce(source, '') AS source, md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || '|{SEED}') AS key,
  len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda w: w <> ''))::BIGINT AS n_tokens FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS n FROM r GROUP BY source),
lim AS (SELECT max(tokens)::DOUBLE AS m, min(tokens) FILTER (WHERE tokens > 0)::DOUBLE AS l, max(n) AS n FROM s),
b(i, lo, hi) AS (SELECT 0, -1, {STEPS} UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
  FROM (SELECT i, lo, hi, (lo + hi) // 2 AS mid, pow(l / m, ((lo + hi) // 2) / {float(STEPS)} - 1) <= {MAX_EPOCHS} AS ok FROM b, lim WHERE hi - lo > 1)),
a AS (SELECT min(hi) / {float(STEPS)} AS a FROM b),
e AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(tokens / m, a - 1.0) ELSE 1.0 END AS epochs, CASE WHEN n <= {BLOCK_ROWS} THEN 1 ELSE greatest(1, ceil(ln(n / {float(BLOCK_ROWS)}) / ln(16)))::INT END AS digits FROM (SELECT source, tokens FROM s), lim, a),
p AS (SELECT source, digits, floor(epochs + 1e-9)::BIGINT AS whole, floor((epochs - floor(epochs + 1e-9)) * tokens + 1e-6)::BIGINT AS part FROM e),
q AS (SELECT r.doc_id, r.source, r.n_tokens, substr(key, 1, digits) AS block, whole, part,
  sum(n_tokens) OVER (PARTITION BY r.source ORDER BY key, doc_id, n_tokens ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM r JOIN p USING (source))
SELECT doc_id, source, n_tokens, whole + (upto <= part)::BIGINT AS copies, block, upto - n_tokens AS "start" FROM q"""
