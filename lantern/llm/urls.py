"""URL filters with redirect equivalence (DataFrame functions only).

A page's own rule decides where one fits.  Otherwise a block spreads over aliases:
redirects, refreshes and canonical links are edges between URLs, and a page without a
rule is blocked if anything in its connected component is blocked by a rule and nothing
in it is allowed by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.tables import connected_components, staged

#: (verdict, host, path prefix)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_TRACKING = r"^(ref|utm_[a-z]+)="
_TARGET = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits; null fields without one.  Ties go to allow, then to the first listed."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """What stands for a URL in the graph: host, path without a last slash, query; neither scheme nor fragment."""
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    tail = F.regexp_replace(F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1), r"/(\?|$)", "$1")
    return F.when(host != "", F.concat(host, tail))


def resolved(base: Column, link: Column) -> Column:
    """`link` as an absolute URL, seen from the page `base`; null if empty."""
    scheme = F.regexp_extract(base, r"^([^:]*):", 1)
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    root = F.concat(scheme, F.lit("://"), host_of(base))
    return (
        F.when(link == "", None)
        .when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (src_url, dst_url) that the pages themselves declare."""
    u, h = F.col(url), F.col(html)
    some = pages.where(h.rlike(_CANONICAL) | h.rlike(_REFRESH))
    links = F.array(
        F.regexp_extract(F.regexp_extract(h, _CANONICAL, 0), _HREF, 1),
        F.regexp_extract(F.regexp_extract(h, _REFRESH, 0), _TARGET, 1),
    )
    return some.select(u.alias("src_url"), F.explode(links).alias("link")).select("src_url", resolved(F.col("src_url"), F.col("link")).alias("dst_url")).where("dst_url is not null")


def canonical(url: Column) -> Column:
    """What a URL redirects to by convention: its host without `www.` or `m.`, its query without tracking parameters; null without a host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    query = F.filter(F.split(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), "&"), lambda q: (q != "") & ~q.rlike(_TRACKING))
    return F.when(host != "", F.concat(F.lit("https://"), host, path_of(url), F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")))


def conventional_aliases(pages: DataFrame, url: str = "url") -> DataFrame:
    """(src_url, dst_url): redirects that conventions state, for URLs that aren't their own canonical form."""
    u = F.col(url)
    return pages.select(u.alias("src_url"), canonical(u).alias("dst_url")).where(node_of(F.col("src_url")) != node_of(F.col("dst_url")))


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    `redirects` has src_url and dst_url.  A null URL has empty host and path, no rule,
    no alias and is allowed; repeated rows stay as rows; a null html declares nothing.
    """
    edges = link_edges(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src_url", "dst_url"))
    edges = staged(edges.where("src_url is not null and dst_url is not null"), "url-edges")
    u = F.col(url)
    base = pages.select(F.col(page_id).alias("page_id"), u.alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    base = base.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    if edges.isEmpty():
        spread = F.lit(None).cast("string")
        return base.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", spread, F.lit("allow")).alias("verdict"))
    parts = connected_components(edges.select(node_of(F.col("src_url")).alias("src"), node_of(F.col("dst_url")).alias("dst")).dropna(), "url-cc")
    ends = edges.select(F.col("src_url").alias("u")).union(edges.select("dst_url")).distinct()
    judged = ends.select(node_of(F.col("u")).alias("node"), rule_of(host_of(F.col("u")), path_of(F.col("u")), rules)["verdict"].alias("v"))
    judged = judged.union(base.select("node", F.col("own.verdict"))).where("v is not null and node is not null").distinct()
    said = judged.join(parts, "node").groupBy("component").agg(F.max((F.col("v") == "block").cast("int")).alias("b"), F.max((F.col("v") == "allow").cast("int")).alias("a"))
    blocked = staged(parts.join(said.where("b = 1 and a = 0"), "component").select("node").distinct().withColumn("spread", F.lit("block")), "url-blocked")
    # Pages without a host have no node; they would all meet in one task of the join.
    joined = base.where("node is not null").join(blocked, "node", "left").unionByName(base.where("node is null").withColumn("spread", F.lit(None).cast("string")))
    return joined.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "spread", F.lit("allow")).alias("verdict"))


def _sql_rule(field: int) -> str:
    whens = []
    for verdict, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow")):
        whens.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if not field else verdict}'")
    return "CASE " + " ".join(whens) + " END"


def _sql_rest(u: str) -> str:
    return f"(CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END)"


def _sql_host(u: str) -> str:
    return f"coalesce(translate(regexp_extract({_sql_rest(u)}, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}'), '')"


def _sql_path(u: str) -> str:
    return f"coalesce(regexp_extract({_sql_rest(u)}, '^[^/?#]*([^?#]*)', 1), '')"


def _sql_node(u: str) -> str:
    host = f"regexp_replace({_sql_host(u)}, ':(80|443)$', '')"
    tail = f"regexp_replace(regexp_extract({_sql_rest(u)}, '^[^/?#]*([^#]*)', 1), '/(\\?|$)', '\\1')"
    return f"CASE WHEN {host} <> '' THEN {host} || {tail} END"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


SQL = f"""WITH RECURSIVE p AS (SELECT page_id, url, html, {_sql_host('url')} AS host, {_sql_path('url')} AS path, {_sql_node('url')} AS node FROM pages),
own AS (SELECT *, {_sql_rule(0)} AS rule, {_sql_rule(1)} AS said FROM p),
raw AS (SELECT url AS src_url, host, path, unnest([regexp_extract(regexp_extract(html, {_q(_CANONICAL)}, 0), {_q(_HREF)}, 1), regexp_extract(regexp_extract(html, {_q(_REFRESH)}, 0), {_q(_TARGET)}, 1)]) AS link
  FROM p WHERE url IS NOT NULL AND html IS NOT NULL),
abs AS (SELECT src_url, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN regexp_extract(src_url, '^([^:]*):', 1) || ':' || link
  WHEN starts_with(link, '/') THEN regexp_extract(src_url, '^([^:]*):', 1) || '://' || host || link
  ELSE regexp_extract(src_url, '^([^:]*):', 1) || '://' || host || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || link END AS dst_url FROM raw WHERE link <> ''),
canon0 AS (SELECT url, regexp_replace(host, '^(www|m)[.]', '') AS ch, path, list_filter(string_split(regexp_extract({_sql_rest('url')}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(ref|utm_[a-z]+)=')) AS qs FROM p WHERE url IS NOT NULL),
canon AS (SELECT url AS src_url, 'https://' || ch || path || CASE WHEN len(qs) > 0 THEN '?' || array_to_string(qs, '&') ELSE '' END AS dst_url FROM canon0 WHERE ch <> ''),
e AS (SELECT {_sql_node('src_url')} AS a, {_sql_node('dst_url')} AS b FROM (SELECT src_url, dst_url FROM abs UNION ALL SELECT src_url, dst_url FROM canon)),
sym AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
ends AS (SELECT node, said FROM own UNION SELECT node, {_sql_rule(1)} FROM (SELECT {_sql_node('dst_url')} AS node, {_sql_host('dst_url')} AS host, {_sql_path('dst_url')} AS path FROM (SELECT dst_url FROM abs UNION ALL SELECT dst_url FROM canon))),
spread AS (SELECT r.a AS node FROM reach r JOIN ends ON ends.node = r.b WHERE said IS NOT NULL GROUP BY r.a HAVING bool_or(said = 'block') AND NOT bool_or(said = 'allow'))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN spread.node IS NOT NULL THEN 'block' END, 'allow') AS verdict FROM own LEFT JOIN spread ON spread.node = own.node"""
