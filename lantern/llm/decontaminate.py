"""Benchmark decontamination by template windows (DataFrame functions only).

Text becomes a template: runs of capitalised words inside a sentence turn into a name
placeholder, numbers into a number placeholder, and units after a number into a unit
placeholder; all else is lower-cased words.  Windows of five template tokens are hashed
and joined by hash with those of the benchmark.  Matches that lie on one alignment of
a document with an item must fill their slots consistently (one value of the item, one
value of the document, and the other way round), else only windows without a slot
count.  A document is contaminated by an item if at least half of the item's windows
are found: verbatim, with other case or punctuation, or with other parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.tables import BROADCAST_ROWS, beside, row_key, staged, unused

WINDOW = 5
#: Part of an item's windows that must be found.
MIN_SHARE = 0.5
#: Literal tokens that a window needs for its slots to be placeholders.
MIN_LITERAL = 2
#: Windows of the benchmark that are broadcast at most (34 bytes each, some 15 MB as a hash table); beyond it the join is shuffled.
BROADCAST_WINDOWS = 200_000
NAME, NUMBER, UNIT, END = "\ue001", "\ue002", "\ue003", "\ue004"
_UNITS = "km/h|kwh|kg|mg|km|cm|mm|ml|gb|mb|kb|ghz|mhz|hz|min|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|meters|metres|miles|feet|inches|dollars|euros|pounds|percent|usd|eur|g|m|l|s|h|w|v|a|%|€|\\$|£|°c|°f|°"
#: Repeated groups are possessive: greedy ones recurse once a repetition and long runs of names or numbers end the stack.
_STEPS = [
    (r"([\p{L}\p{N},;:])((?: +\p{Lu}[\p{Ll}\p{M}]+)++)", f"$1 {NAME}$2{END}"),
    (r"([0-9]+(?:[.,:/][0-9]+)*+)", f" {NUMBER}$1{END}"),
    (rf"(?i)({END}) ?({_UNITS})([^\p{{L}}\p{{N}}]|$)", f"$1 {UNIT}$2{END}$3"),
]
_TOKEN = rf"[{NAME}{NUMBER}{UNIT}][^{END}]*{END}|[\p{{L}}\p{{M}}\p{{N}}]+"


def tokens(text: Column) -> Column:
    """Template tokens; a slot is its placeholder, its value and END."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NAME}-{END}]", " ")
    for pattern, to in _STEPS:
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_extract_all(F.lower(out), F.lit(_TOKEN), F.lit(0))


def _is_slot(t: Column) -> Column:
    return t.endswith(END)


def _template(t: Column) -> Column:
    return F.when(_is_slot(t), F.substring(t, 1, 1)).otherwise(t)


def windows(toks: Column, width: int = WINDOW) -> Column:
    """Hashes of all windows of `width` tokens, in order; none for fewer tokens.

    A window with MIN_LITERAL literals or more is hashed as a template, any other by
    the values of its slots, or every list of numbers would be equal to every other.
    """
    parts = F.transform(toks, lambda t: F.struct(F.xxhash64(_template(t)).alias("t"), F.xxhash64(t).alias("v"), _is_slot(t).cast("int").alias("s")))

    def all_of(h: Column) -> Column:
        def one(i: Column) -> Column:
            at = [F.get(h, i + k) for k in range(width)]
            as_is = F.xxhash64(*[x["v"] for x in at])
            if width < MIN_LITERAL:
                return as_is
            return F.when(sum((x["s"] for x in at[1:]), at[0]["s"]) <= width - MIN_LITERAL, F.xxhash64(*[x["t"] for x in at])).otherwise(as_is)

        return F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(0), F.size(h) - width), one)).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(parts), all_of), F.lit(0))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item (hash of its text), ipos, w (hash), width, slots (is a slot a placeholder in it) and total (windows of the item).

    An item of fewer than WINDOW tokens is one window, its whole sequence.
    """
    toks = benchmark.where("text is not null").select(F.xxhash64(F.col("text").cast("string")).alias("item"), tokens(F.col("text")).alias("toks")).where(F.size("toks") > 0).dropDuplicates(["item"])
    width = F.least(F.size("toks"), F.lit(WINDOW))
    of_width = windows(F.col("toks"))
    for k in range(1, WINDOW):
        of_width = F.when(F.size("toks") == k, windows(F.col("toks"), k)).otherwise(of_width)
    all_w = toks.select("item", "toks", width.alias("width"), F.posexplode(of_width).alias("ipos", "w"))
    n = F.size(F.filter(F.slice(F.col("toks"), F.col("ipos") + 1, F.col("width")), _is_slot))
    total = F.size("toks") - F.col("width") + 1
    return all_w.select("item", "ipos", "w", "width", ((n > 0) & (F.col("width") - n >= MIN_LITERAL)).alias("slots"), total.alias("total"))


def contaminated(docs: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per (row of `docs`, item) found: k and h (`row_key`), item (hash of its text), found, total, verbatim (no slot differs).

    Null texts, and texts without a letter or digit, have no window, on either side;
    rows that share a doc_id but not the text are judged apart, rows without doc_id as
    all others, repeated rows once.
    """
    asked = staged(item_windows(benchmark), "decon-items")
    keyed = beside(asked, BROADCAST_WINDOWS)
    widths = sorted(r["width"] for r in asked.select("width").distinct().collect())  # WINDOW numbers at most
    k, h = row_key()
    base = docs.select(k.alias("k"), h.alias("h"), F.col("text").cast("string").alias("text"))
    toks = base.select("k", "h", tokens(F.col("text")).alias("toks"))
    lists = F.array(*[F.struct(F.lit(n).alias("width"), windows(F.col("toks"), n).alias("ws")) for n in widths]) if widths else F.array().cast("array<struct<width:int,ws:array<bigint>>>")
    if len(widths) == 1:  # the usual case
        every = toks.select("k", "h", F.lit(widths[0]).alias("width"), F.posexplode(windows(F.col("toks"), widths[0])).alias("pos", "w"))
    else:
        every = toks.select("k", "h", F.explode(lists).alias("l")).select("k", "h", "l.width", F.posexplode("l.ws").alias("pos", "w"))
    hit = every.join(keyed, ["w", "width"])
    lines = hit.groupBy("k", "h", "item", "total", (F.col("pos") - F.col("ipos")).alias("off")).agg(F.collect_set("ipos").alias("at"), F.collect_set(F.when(~F.col("slots"), F.col("ipos"))).alias("plain"))
    # What can't reach the share over all alignments is dropped before slots are looked at.
    per_item = lines.groupBy("k", "h", "item", "total").agg(F.collect_list(F.struct("off", "at", "plain")).alias("lines"))
    enough = F.size(F.array_distinct(F.flatten(F.col("lines")["at"]))) >= F.col("total") * min_share
    found = staged(per_item.where(enough), "decon-found")
    line = found.select("k", "h", "item", "total", F.explode("lines").alias("l")).select("k", "h", "item", "total", "l.off", "l.at", "l.plain")
    slotted = staged(line.where(F.size("at") > F.size("plain")).select("k", "h", "item", "off", "at"), "decon-slots")
    if slotted.isEmpty():
        checked = line.withColumn("same", F.lit(True)).withColumn("good", F.lit(True))
    else:
        values = benchmark.select(F.xxhash64(F.col("text").cast("string")).alias("item"), F.posexplode(tokens(F.col("text"))).alias("tpos", "ivalue")).where(_is_slot(F.col("ivalue"))).distinct()
        need = slotted.join(values, "item").where(F.exists("at", lambda p: (F.col("tpos") >= p) & (F.col("tpos") < p + WINDOW))).select("k", "h", "item", "off", (F.col("tpos") + F.col("off")).alias("dpos"), "ivalue")
        some = base.join(beside(staged(slotted.select("k", "h").distinct(), "decon-asked")), ["k", "h"], "left_semi")
        have = some.select("k", "h", F.posexplode(tokens(F.col("text"))).alias("dpos", "dvalue")).where(_is_slot(F.col("dvalue")))
        pairs = need.join(have, ["k", "h", "dpos"]).groupBy("k", "h", "item", "off").agg(
            F.countDistinct("ivalue").alias("a"), F.countDistinct("dvalue").alias("b"), F.countDistinct("ivalue", "dvalue").alias("ab"), F.min((F.col("ivalue") == F.col("dvalue")).cast("int")).alias("same")
        )
        verdict = pairs.select("k", "h", "item", "off", ((F.col("a") == F.col("ab")) & (F.col("b") == F.col("ab"))).alias("good"), (F.col("same") == 1).alias("same"))
        checked = line.join(verdict, ["k", "h", "item", "off"], "left").withColumn("good", F.coalesce("good", F.lit(True))).withColumn("same", F.coalesce("same", F.lit(True)))
    kept = checked.groupBy("k", "h", "item", "total").agg(F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("good"), F.col("at")).otherwise(F.col("plain")))))).cast("long").alias("found"), F.min(F.col("same").cast("int")).alias("same"))
    return kept.where(F.col("found") >= F.col("total") * min_share).select("k", "h", "item", "found", "total", (F.col("same") == 1).alias("verbatim"))


def flag(docs: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """Every row: doc_id, contaminated, n_items and items (ids in ascending order, comma-joined).

    An item whose text several ids share counts under each of them; one without an id
    contaminates but isn't listed.
    """
    ids = benchmark.select(F.xxhash64(F.col("text").cast("string")).alias("item"), F.col("item_id").alias("id")).distinct()
    per_row = contaminated(docs, benchmark, min_share).join(ids, "item").groupBy("k", "h").agg(F.array_sort(F.collect_set("id")).alias("its"))
    k, h = row_key()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), k.alias("k"), h.alias("h"))
    out = rows.join(beside(staged(per_row, "decon-docs"), BROADCAST_ROWS // 4), ["k", "h"], "left")
    return out.select("doc_id", F.col("its").isNotNull().alias("contaminated"), F.when(F.col("its").isNull(), 0).otherwise(F.size("its")).cast("long").alias("n_items"), F.coalesce(F.array_join("its", ","), F.lit("")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of `docs` that no item contaminates, those without doc_id judged as all others."""
    names = unused(docs, "k", "h")
    bad = staged(contaminated(docs, benchmark, min_share).select(*[F.col(c).alias(n) for c, n in zip("kh", names)]).distinct(), "decon-bad")
    k, h = row_key()
    return docs.join(beside(bad), (k == F.col(names[0])) & (h == F.col(names[1])), "left_anti")


def _sql_tokens(t: str) -> str:
    out = f"regexp_replace(coalesce({t}, ''), '[{NAME}-{END}]', ' ', 'g')"
    for pattern, to in _STEPS:
        p = pattern.replace("'", "''").replace(")++", ")+").replace(")*+", ")*")  # that engine knows no possessive groups and needs none
        to = to.replace("$1", "\\1").replace("$2", "\\2").replace("$3", "\\3")
        out = f"regexp_replace({out}, '{p}', '{to}', 'g')"
    return f"regexp_extract_all(lower({out}), '{_TOKEN}', 0)"


def _sql_windows(t: str, width: str) -> str:
    slot = f"ends_with(x, '{END}')"
    tpl = f"list_transform({t}, lambda x: CASE WHEN {slot} THEN substr(x, 1, 1) ELSE x END)"
    w = f"CASE WHEN len(list_filter({t}[i+1:i+{width}], lambda x: NOT {slot})) >= {MIN_LITERAL} THEN array_to_string(({tpl})[i+1:i+{width}], ' ') ELSE array_to_string({t}[i+1:i+{width}], ' ') END"
    n = f"len(list_filter({t}[i+1:i+{width}], lambda x: NOT {slot}))"
    return f"list_transform(range(0, greatest(0, len({t}) - {width} + 1)), lambda i: {{'p': i, 'w': {w}, 'slots': {n} >= {MIN_LITERAL} AND {n} < {width}}})"


SQL = f"""WITH dt AS (SELECT text, {_sql_tokens('text')} AS toks FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
bt AS (SELECT text AS item, {_sql_tokens('text')} AS toks FROM (SELECT DISTINCT text FROM benchmark WHERE text IS NOT NULL)),
bk AS (SELECT *, least(len(toks), {WINDOW}) AS width FROM bt WHERE len(toks) > 0),
wide AS (SELECT DISTINCT width FROM bk),
dw AS (SELECT text, width, unnest({_sql_windows('toks', 'width')}, recursive := true) FROM dt, wide),
bw AS (SELECT item, width, len(toks) - width + 1 AS total, unnest({_sql_windows('toks', 'width')}, recursive := true) FROM bk),
hit AS (SELECT DISTINCT text, item, total, dw.p - bw.p AS off, bw.p AS ipos, bw.width, bw.slots FROM dw JOIN bw USING (w, width)),
ds AS (SELECT text, unnest(range(0, len(toks))) AS pos, unnest(toks) AS v FROM dt),
bs AS (SELECT item, unnest(range(0, len(toks))) AS pos, unnest(toks) AS v FROM bt),
pairs AS (SELECT DISTINCT h.text, h.item, h.off, bs.v AS a, ds.v AS b FROM hit h JOIN bs ON bs.item = h.item AND bs.pos BETWEEN h.ipos AND h.ipos + h.width - 1 AND ends_with(bs.v, '{END}')
  JOIN ds ON ds.text = h.text AND ds.pos = bs.pos + h.off AND ends_with(ds.v, '{END}')
  WHERE (h.text, h.item, h.off) IN (SELECT (text, item, off) FROM hit WHERE slots)),
good AS (SELECT text, item, off, count(DISTINCT a) = count(*) AND count(DISTINCT b) = count(*) AS good FROM pairs GROUP BY ALL),
kept AS (SELECT h.text, h.item, h.total, count(DISTINCT ipos) AS found FROM hit h LEFT JOIN good USING (text, item, off) WHERE coalesce(good, true) OR NOT slots GROUP BY ALL),
per AS (SELECT k.text, list_sort(list(DISTINCT item_id)) AS its FROM kept k JOIN benchmark b ON b.text = k.item WHERE found >= total * {MIN_SHARE} GROUP BY k.text)
SELECT doc_id, its IS NOT NULL AS contaminated, coalesce(len(its), 0)::BIGINT AS n_items, coalesce(array_to_string(its, ','), '') AS items FROM documents LEFT JOIN per USING (text)"""
