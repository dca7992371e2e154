"""URL filtering with redirect equivalence.

Explicit rules judge each URL by host and path. Two URLs are aliases where one redirects to the other or names it as
canonical, and where servers do so without saying it in the page: other scheme, www. and m. hosts, default ports, trailing
slashes, tracking parameters. Distributed connected components over those links carry a block to every alias that has no rule
of its own, unless an alias of the component is explicitly allowed. Everything is built from DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgraph.llm.shared import ascii_lower, components

#: (verdict, host, path prefix) of the registered query.
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)

# (?s) so that a line break inside a URL is an ordinary character; the first :// counts.
_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
_CANONICAL = r"(?is)<link\s(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_VARIANT = r"^(?:www|m)\.([^.]+\..+)$"
_TRACKING = "(?i)(?:^|&)(?:utm_[a-z_]+|gclid|fbclid|msclkid|ref)=[^&]*"
_REFRESH = r"(?is)<meta\s(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?\s*[0-9.]+\s*[;,]\s*url\s*=\s*'?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)


def node_of(url: Column) -> Column:
    """A URL's name in the alias graph: no scheme, host in lower case, no fragment."""
    return F.concat(host_of(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1))


def form_of(url: Column) -> Column:
    """The alias-graph name of the address that a URL's common variants redirect to."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), ":(?:80|443)$", ""), _VARIANT, "$1")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), _TRACKING, ""), "^&+", "")
    return F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits; of equally long ones an allow wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _resolved(url: Column, target: Column) -> Column:
    """Absolute form of a link found on the page at url; relative forms without a leading slash are resolved too."""
    scheme, host = F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.regexp_extract(url, _HOST, 1)
    base = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(scheme, F.lit("://"), host, target))
        .otherwise(F.concat(scheme, F.lit("://"), host, F.when(base == "", "/").otherwise(base), target))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): pairs of URL nodes that a canonical link, a refresh or a variant of one address makes aliases. Pages without URL
    give none, those without text only the last."""
    url, html = F.col(url_col), F.coalesce(F.col(html_col), F.lit(""))
    known = pages.where(url.contains("://"))
    found = known.where(html.rlike("(?i)canonical|refresh")).select(url.alias("u"), F.explode(F.array(F.regexp_extract(html, _CANONICAL, 1), F.regexp_extract(html, _REFRESH, 1))).alias("t"))
    whole = F.replace(F.col("t"), F.lit("&amp;"), F.lit("&"))
    named = found.where(F.col("t") != "").select(node_of(F.col("u")).alias("a"), _resolved(F.col("u"), whole).alias("to"))
    named = named.select("a", F.explode(F.array(node_of(F.col("to")), form_of(F.col("to")))).alias("b"))
    return named.union(known.select(node_of(url).alias("a"), form_of(url).alias("b"))).where("a <> b").distinct()


def redirect_edges(redirects: DataFrame, from_col: str = "url", to_col: str = "target") -> DataFrame:
    """(a, b): pairs of URL nodes from a table of redirects. Targets may be relative; both ends are aliases of their variants too.
    Rows with a null end, or whose source has no ://, give none; repeats and chains do no harm."""
    url = F.col(from_col)
    ends = redirects.where(url.contains("://") & (F.col(to_col) != "")).select(url.alias("u"), _resolved(url, F.col(to_col)).alias("to"))
    links = ends.select(node_of(F.col("u")).alias("a"), F.explode(F.array(node_of(F.col("to")), form_of(F.col("to")), form_of(F.col("u")))).alias("b"))
    return links.where("a <> b").distinct()


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, edges: DataFrame | None = None, redirects: DataFrame | None = None,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """One row for each row of pages: id, host, path, rule, verdict.

    The verdict is the longest rule's. Without a rule it is block where an alias is blocked by rule and no alias is
    allowed by rule, else allow. edges: (a, b) URL nodes as node_of names them, by default those of the pages' own URLs
    and texts. redirects: (url, target), a crawler's redirect log, whose links are joined to them. A null URL, or one without ://, has empty host and path,
    no rule and no alias, and is allowed. Repeated rows are judged alike; extra columns are ignored.
    """
    edges = alias_edges(pages, url_col, html_col) if edges is None else edges
    if redirects is not None:
        edges = edges.select("a", "b").union(redirect_edges(redirects))
    groups = components(edges)
    host, path = ascii_lower(F.regexp_extract(F.concat(F.lit("://"), F.col("id")), _HOST, 1)), path_of(F.concat(F.lit("://"), F.col("id")))
    ruled = rule_of(host, path, rules)[1]
    judged = groups.withColumn("v", ruled).groupBy("component").agg(F.bool_or(F.col("v") == "block").alias("bad"), F.bool_or(F.col("v") == "allow").alias("good"))
    spread = groups.join(judged.where(F.coalesce("bad", F.lit(False)) & ~F.coalesce("good", F.lit(False))), "component").select(F.col("id").alias("node"), F.lit(True).alias("by_alias"))
    url = F.col(url_col)
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), F.when(url.contains("://"), node_of(url)).alias("node"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = rows.withColumns({"rule": rule, "ruled": verdict}).join(spread, "node", "left")
    return out.select(id_col, "host", "path", "rule", F.coalesce("ruled", F.when(F.col("by_alias"), "block"), F.lit("allow")).alias("verdict"))


SQL = r"""
WITH RECURSIVE rules(kind, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
                                            ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
p AS (SELECT row_number() OVER () AS r, page_id, url, html, coalesce(url, '') AS u FROM pages),
q AS (SELECT *, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
             regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS tail FROM p),
links AS (SELECT host || tail AS a, regexp_extract(regexp_extract(html, '(?is)<link\s[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0),
                                                 '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS t, * EXCLUDE (html) FROM q WHERE contains(u, '://')
          UNION ALL
          SELECT host || tail, regexp_extract(html, '(?is)<meta\s[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\bcontent\s*=\s*["'']?\s*[0-9.]+\s*[;,]\s*url\s*=\s*''?([^"''\s>]+)', 1),
                 * EXCLUDE (html) FROM q WHERE contains(u, '://')),
whole AS (SELECT a, CASE WHEN contains(t, '://') THEN replace(t, '&amp;', '&')
                         WHEN starts_with(t, '//') THEN 'x:' || replace(t, '&amp;', '&')
                         WHEN starts_with(t, '/') THEN 'x://' || host || replace(t, '&amp;', '&')
                         ELSE 'x://' || host || coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || replace(t, '&amp;', '&') END AS b
          FROM links WHERE t <> ''),
e0 AS (SELECT a, translate(regexp_extract(b, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                || regexp_extract(b, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS b FROM whole),
forms AS (SELECT x, regexp_replace(regexp_replace(translate(regexp_extract(x, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(80|443)$', ''), '^(?:www|m)\.([^.]+\..+)$', '\1')
                    || regexp_replace(regexp_extract(x, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/+$', '') AS place,
                 regexp_replace(regexp_replace(regexp_extract(x, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '(?i)(^|&)(utm_[a-z_]+|gclid|fbclid|msclkid|ref)=[^&]*', '', 'g'), '^&+', '') AS query
          FROM (SELECT u AS x FROM q WHERE contains(u, '://') UNION SELECT b FROM whole)),
variants AS (SELECT x, place || CASE WHEN query = '' THEN '' ELSE '?' || query END AS form FROM forms),
e AS (SELECT a, b FROM e0 UNION SELECT a, form FROM whole JOIN variants ON x = b UNION SELECT host || tail, form FROM q JOIN variants ON x = u WHERE contains(u, '://')),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
ruled AS (SELECT b AS node, arg_max(kind, length(h || p)) AS v
          FROM (SELECT DISTINCT b FROM both_ways), rules
          WHERE (regexp_extract(b, '^[^/?#]*') = h OR ends_with(regexp_extract(b, '^[^/?#]*'), '.' || h)) AND starts_with(regexp_extract(b, '^[^/?#]*([^?#]*)', 1), p) GROUP BY b),
spread AS (SELECT a AS node FROM reach JOIN ruled ON ruled.node = reach.b GROUP BY a HAVING bool_or(v = 'block') AND NOT bool_or(v = 'allow')),
own AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(kind, length(h || p)) AS v FROM q, rules
        WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN spread.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM q LEFT JOIN own USING (r) LEFT JOIN spread ON contains(u, '://') AND spread.node = host || tail
"""
