"""URL rules, and block decisions carried along redirects and canonical links to a page's aliases."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, small
from .components import connected_components

#: Rules up to which they are an expression over each url; more are joined with the suffixes of hosts.
MAX_RULES = 2000
RULED = "struct<rule: string, verdict: string>"
# Verdict, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def after_scheme(url: Column) -> Column:
    """What follows the first ://; empty for null and for none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(after_scheme(url), r"\A[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"\A[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """A url without scheme and fragment, its host in lower case; null where there is none."""
    tail = F.regexp_extract(after_scheme(url), r"\A[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), tail))


def resolved(target: Column, base: Column) -> Column:
    """An absolute url for a link found in a page at base."""
    scheme = F.regexp_extract(base, r"\A[^:]*:", 0)
    site = F.regexp_extract(base, r"\A[^:]*://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"\A[^:]*://[^/?#]*(?:[^?#]*/)?", 0)
    return (
        F.when(F.instr(target, "://") > 0, target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(site, target))
        .otherwise(F.concat(folder, F.when(folder.endswith("/"), F.lit("")).otherwise(F.lit("/")), target))
    )


def links(html: Column) -> Column:
    """Targets of <link rel=canonical> and of <meta http-equiv=refresh> in a page, as written but for &amp;."""
    value = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    attribute = lambda tag, name: F.concat(*(F.regexp_extract(tag, rf"(?i)\b{name}{value}", k) for k in (1, 2, 3)))
    canonical = F.transform(F.filter(tags, lambda t: F.lower(F.trim(attribute(t, "rel"))) == "canonical"), lambda t: attribute(t, "href"))
    refresh = F.transform(
        F.filter(tags, lambda t: F.lower(F.trim(attribute(t, "http-equiv"))) == "refresh"),
        lambda t: F.regexp_extract(attribute(t, "content"), r"(?i)url\s*=\s*['\"]?([^'\"]*)", 1),
    )
    both = F.transform(F.concat(canonical, refresh), lambda x: F.trim(F.regexp_replace(x, "&amp;", "&")))
    return F.filter(both, lambda x: x != "")


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. A rule fits its host and all subdomains."""
    out = F.lit(None).cast(RULED)
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_rules(rows: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """rows (host, path, and others) with `own`: as ruled(). Many rules meet the suffixes of each distinct host."""
    if len(rules) <= MAX_RULES:
        return rows.withColumn("own", ruled(F.col("host"), F.col("path"), rules))
    # of rules with one host and path, the one given last, as in the expression
    known = rows.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(rules)], "given int, verdict string, rule_host string, rule_path string")
    parts = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    pairs = rows.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes))
    fitting = pairs.join(known, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    found = F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    best = fitting.groupBy("host", "path").agg(F.max_by(found, F.struct(F.length(F.concat("rule_host", "rule_path")), "given")).cast(RULED).alias("own"))
    return rows.join(best, ["host", "path"], "left")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page (page_id, url, html), and via: rule, alias or none.

    The longest fitting rule decides a page. Others are blocked if a page or link target that a rule blocks is
    connected with them by canonical links, refreshes and `redirects` (from_url, to_url), in either direction and over
    any number of steps, unless a rule explicitly allows the page itself: its own rule always comes first. The rest is
    allowed. Null urls and urls without :// have an empty host and path and no alias; null html has no links. Equal
    urls are one node; each row is judged, so repeated and null page_ids give a row each. No page, no row.
    """
    ws = Workspace(pages.sparkSession, "urls")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = pages.where(F.col("html").rlike("(?i)canonical|refresh")).select("url", F.explode(links(F.col("html"))).alias("target"))
    edges = found.select("url", resolved(F.col("target"), F.col("url")).alias("target"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("from_url").alias("url"), F.col("to_url").alias("target")))
    # both ends as nodes under their own rules; a link target need not be a page
    edges = ws.save(edges.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b")).where("a is not null and b is not null and a <> b").distinct(), "edges")
    # each url gets a number of its own, once, and saved with it: no two share one, as they could a hash
    nodes = ws.save(edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct().withColumn("id", F.monotonically_increasing_id()), "nodes")
    numbered = edges.join(small(nodes.select(F.col("node").alias("a"), F.col("id").alias("u"))), "a").join(small(nodes.select(F.col("node").alias("b"), F.col("id").alias("v"))), "b")
    classes = connected_components(numbered.select("u", "v"), ws, "alias")
    url = F.concat(F.lit("x://"), F.col("node"))
    named = with_rules(nodes.select("node", "id", host_of(url).alias("host"), path_of(url).alias("path")), rules).select("node", "id", F.col("own.verdict").alias("verdict"))
    placed = named.join(classes.select(F.col("node").alias("id"), "component"), "id")
    bad = placed.where("verdict = 'block'").select("component").distinct()
    tainted = ws.save(placed.join(bad, "component", "left_semi").select("node").distinct(), "tainted")

    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    own = with_rules(own, rules)
    # urls without a node are many under one key, and have no alias
    hit = small(tainted.withColumn("alias", F.lit(True)))
    aliased = own.where("node is not null").join(hit, "node", "left").select(*own.columns, F.coalesce("alias", F.lit(False)).alias("alias"))
    out = aliased.unionByName(own.where("node is null").withColumn("alias", F.lit(False)))
    return out.select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.verdict"), F.when(F.col("alias"), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(F.col("alias"), "alias").otherwise("none").alias("via"),
    )


_RULED = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
) + " END"
_PARTS = """translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path"""
_NODE = "translate(regexp_extract({0}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract({0}, '^[^/?#]*([^#]*)', 1)"

#: The same judgement over absolute link targets.
ORACLE_SQL = f"""
WITH RECURSIVE p AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, coalesce(contains(url, '://'), false) AS placed FROM pages
), q AS (SELECT page_id, placed, {_PARTS}, {_NODE.format("rest")} AS node, html FROM p),
tags AS (SELECT node, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM q WHERE placed),
targets AS (
  SELECT node AS a, substr(t, strpos(t, '://') + 3) AS t FROM (
    SELECT node, CASE WHEN regexp_matches(tag, '(?i)\\brel\\s*=\\s*["'']?canonical') THEN regexp_extract(tag, '(?i)\\bhref\\s*=\\s*["'']?([^"''>]*)', 1)
                      WHEN regexp_matches(tag, '(?i)http-equiv\\s*=\\s*["'']?refresh') THEN regexp_extract(tag, '(?i)url\\s*=\\s*([^"''>]*)', 1) END AS t FROM tags
  ) WHERE contains(t, '://')
), edges AS (SELECT a, {_NODE.format("t")} AS b FROM targets),
nodes AS (SELECT a AS node FROM edges UNION SELECT b FROM edges),
bad AS (SELECT node FROM (SELECT node, node AS rest, {_PARTS.replace("rest", "node")} FROM nodes) WHERE starts_with({_RULED}, 'block')),
tainted(node) AS (
  SELECT node FROM bad
  UNION
  SELECT CASE WHEN e.a = t.node THEN e.b ELSE e.a END FROM tainted t JOIN edges e ON e.a = t.node OR e.b = t.node
), j AS (SELECT q.*, {_RULED} AS own FROM q)
SELECT page_id, host, path, split_part(own, ' ', 2) AS rule,
  coalesce(split_part(own, ' ', 1), CASE WHEN placed AND node IN (SELECT node FROM tainted) THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN own IS NOT NULL THEN 'rule' WHEN placed AND node IN (SELECT node FROM tainted) THEN 'alias' ELSE 'none' END AS via
FROM j
"""
