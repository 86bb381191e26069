"""URL filters with redirect equivalence.

Explicit rules (host and path prefix, longest wins) decide the urls they fit. Pages that redirect to each other or name the
same canonical url are aliases: distributed connected components over redirect and canonical-link edges join them, and a
page without a rule takes its component's decision, in which an explicit allow goes before a block. Without any decision the
verdict is allow.

Edges: `<link rel=canonical>` and `<meta http-equiv=refresh>` outside comments, scripts and styles, nothing else; relative targets
are resolved by the page's `<base href>` or its url. A node is the 64-bit hash of a url without its fragment: scheme and host
in lower case, the path without dot segments, the query as it is, an empty path being `/`.

Defined results: a null url or one without `://` has an empty host and path, fits no rule, and has no aliases; null html
has no links. Ties: of rules that fit the longest wins, and no two have one length and one form. Repeated rows give repeated
rows. Very long urls and pages are scanned once, and only hashes of urls leave the row. An empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

# Fixed values: (host, path, verdict), as the contract has them.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url):
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _AZ, _AZ.lower()), F.lit(""))


def path_of(url):
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(F.regexp_replace(url, r"(?s)^.*?://", ""), r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_of(host, path):
    """The longest rule that fits, as a struct (size, rule, verdict); null without one."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in RULES]
    return F.array_max(F.array(*fits))


def without_dots(path):
    """A path that starts with `/` without `.` and `..` segments (RFC 3986, 5.2.4)."""
    parts = F.split(path, "/", -1)
    end = F.element_at(parts, -1)
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.array().cast("array<string>"), step)
    kept = F.when(end.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def node_of(url):
    """The form that stands for a url among links; null for one without a host."""
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    query = F.regexp_extract(F.regexp_replace(url, r"(?s)^.*?://", ""), r"(?s)^[^?#]*(\?[^#]*)", 1)
    path = path_of(url)
    return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host_of(url), F.when(path == "", "/").otherwise(without_dots(path)), query))


def _absolute(t, scheme, host, path):
    """A link's target as a full url, by the parts of the url that it is relative to; null if it isn't a web address."""
    site = F.concat(scheme, F.lit("://"), host)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    return (
        F.when(t.rlike(r"(?i)^https?://"), t)
        .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
        .when(t.startswith("/"), F.concat(site, t))
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (t == "") | t.startswith("#"), None)
        .when(t.startswith("?"), F.concat(site, path, t))
        .otherwise(F.concat(site, folder, t))
    )


def scheme_of(url):
    return F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))


def _plain(t):
    return F.trim(F.regexp_replace(t, r"(?i)&(?:amp|#38|#x26);", "&"))


HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def _href(t):
    """The first href of a tag, however it is quoted."""
    out = F.lit("")
    for p in (r"(?is)\bhref\s*=\s*([^\s>\"']+)", r"(?is)\bhref\s*=\s*'([^']*)", r"(?is)\bhref\s*=\s*\"([^\"]*)"):
        got = F.regexp_extract(t, p, 1)
        out = F.when(got != "", got).otherwise(out)
    return out


def targets(pages: DataFrame) -> DataFrame:
    """pages(node, url, html) to (node, to): nodes of the urls that a page redirects to or names as canonical. Tags in comments,
    scripts and styles don't count; the first `<base href>` is what relative targets are relative to. Each step is a column of
    its own, so that no expression holds another several times."""
    c = F.col
    p = pages.filter("url is not null").filter(c("html").rlike("(?i)canonical|refresh")).select("node", "url", F.regexp_replace("html", HIDDEN, " ").alias("seen"))
    p = p.select("node", "url", F.regexp_extract_all("seen", F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1).alias("tags"), F.regexp_extract("seen", r"(?is)(<base\b[^>]*>)", 1).alias("based"))
    p = p.select("node", "url", F.explode("tags").alias("tag"), "based").filter(c("tag").rlike(r"(?is)\brel\s*=\s*[\"']?canonical\b|http-equiv\s*=\s*[\"']?refresh\b"))
    p = p.withColumns({"based": _plain(_href(c("based"))), "s": scheme_of(c("url")), "h": host_of(c("url")), "p": path_of(c("url"))})
    p = p.withColumn("base", F.coalesce(_absolute(c("based"), c("s"), c("h"), c("p")), "url"))
    p = p.withColumns({"s": scheme_of(c("base")), "h": host_of(c("base")), "p": path_of(c("base"))})
    raw = F.when(c("tag").rlike(r"(?is)^<link"), _href(c("tag"))).otherwise(F.regexp_extract("tag", r"(?is)url\s*=\s*'?([^\"'>]*)", 1))
    p = p.withColumn("t", _plain(raw)).withColumn("u", _absolute(c("t"), c("s"), c("h"), c("p")))
    # an array's elements: filters on them aren't pushed down through all these columns, which would write them out in full
    return p.withColumn("form", node_of(c("u"))).select("node", F.explode(F.filter(F.array("form"), lambda x: x != "")).alias("to"))


def judge(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    base = pages.select("page_id", "html", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("form"))
    base = base.select("*", rule_of(F.col("host"), F.col("path")).alias("r"), F.when(F.col("form").isNotNull(), F.xxhash64("form")).alias("node"))
    rows = base.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("own"), "node")
    # a link's end is a node even if no page has it, and rules judge it too
    ends = targets(base.filter("node is not null and html is not null").select("node", "url", "html"))
    ends = materialize(spark, ends.select("node", F.xxhash64("to").alias("end"), rule_of(host_of(F.col("to")), path_of(F.col("to")))["verdict"].alias("said")).filter("node != end").distinct(), "ends")
    linked = materialize(spark, connected_components(spark, ends.select("node", "end")), "aliases")
    # decisions by node are partial aggregates: a url that a third of all pages share doesn't gather in one task
    told = rows.select("node", F.col("own").alias("said")).unionByName(ends.select(F.col("end").alias("node"), "said")).filter("node is not null and said is not null")
    told = told.join(linked.withColumnRenamed("id", "node"), "node")  # only nodes with links decide for others
    said = told.groupBy("component").agg(F.max(F.col("said") == "allow").alias("allow")).select("component", F.when(F.col("allow"), "allow").otherwise("block").alias("said"))
    decided = linked.join(said, "component").select(F.col("id").alias("node"), "said")
    # only pages without a rule have to ask
    asking = rows.filter("rule is null").join(decided, "node", "left")
    done = rows.filter("rule is not null").select("page_id", "host", "path", "rule", F.col("own").alias("verdict"))
    return done.unionByName(asking.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict")))


def oracle() -> str:
    """The same as SQL: links by regular expressions, components by a recursive walk (few pages have links)."""
    rules = ",".join(f"('{h}','{p}','{v}')" for h, p, v in RULES)

    def rest(u: str) -> str:
        return f"CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) END"

    def host(u: str) -> str:
        return f"coalesce(translate(regexp_extract({rest(u)}, '^[^/?#]*'), '{_AZ}', '{_AZ.lower()}'), '')"

    def path(u: str) -> str:
        return f"coalesce(regexp_extract({rest(u)}, '^[^/?#]*([^?#]*)', 1), '')"

    def dots(p: str) -> str:
        parts = f"list_transform(list_slice(string_split({p}, '/'), 2, NULL), lambda x: [x])"
        kept = f"list_reduce(list_concat([[]::VARCHAR[]], {parts}), lambda a, x: CASE WHEN x[1] = '..' THEN list_slice(a, 1, len(a) - 1) WHEN x[1] = '.' THEN a ELSE list_concat(a, x) END)"
        return f"CASE WHEN contains({p}, '/.') THEN '/' || array_to_string(list_concat({kept}, CASE WHEN regexp_matches({p}, '/\\.\\.?$') THEN [''] ELSE [] END), '/') ELSE {p} END"

    def node(u: str) -> str:
        return f"CASE WHEN {host(u)} <> '' THEN {scheme(u)} || '://' || {host(u)} || CASE WHEN {path(u)} = '' THEN '/' ELSE {dots(path(u))} END || regexp_extract({rest(u)}, '(?s)^[^?#]*(\\?[^#]*)', 1) END"

    def scheme(u: str) -> str:
        return f"lower(substr({u}, 1, instr({u}, '://') - 1))"

    def full(t: str, u: str) -> str:
        site = f"{scheme(u)} || '://' || {host(u)}"
        return f"CASE WHEN regexp_matches({t}, '(?i)^https?://') THEN {t} WHEN starts_with({t}, '//') THEN {scheme(u)} || ':' || {t} WHEN starts_with({t}, '/') THEN {site} || {t} WHEN {t} = '' OR starts_with({t}, '#') OR regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with({t}, '?') THEN {site} || {path(u)} || {t} ELSE {site} || CASE WHEN {path(u)} = '' THEN '/' ELSE regexp_extract({path(u)}, '(?s)^(.*/)', 1) END || {t} END"

    href = "coalesce(nullif(regexp_extract(tag, '(?is)\\bhref\\s*=\\s*\"([^\"]*)', 1), ''), nullif(regexp_extract(tag, '(?is)\\bhref\\s*=\\s*''([^'']*)', 1), ''), regexp_extract(tag, '(?is)\\bhref\\s*=\\s*([^\\s>\"'']+)', 1))"
    plain = lambda x: f"trim(regexp_replace({x}, '(?i)&(?:amp|#38|#x26);', '&', 'g'))"
    raw = plain(f"CASE WHEN regexp_matches(tag, '(?i)^<link') THEN {href} ELSE regexp_extract(tag, '(?is)url\\s*=\\s*''?([^\"''>]*)', 1) END")
    return f"""
WITH RECURSIVE rules(rh, rp, verdict) AS (VALUES {rules}),
p AS (SELECT row_number() OVER () AS i, page_id, url, regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g') AS html, {host("url")} AS host, {path("url")} AS path, {node("url")} AS node FROM pages),
r AS (SELECT i, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY i ORDER BY length(rh || rp) DESC) AS k FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
q AS (SELECT node, url, html, {plain(href)} AS bt FROM (SELECT node, url, html, regexp_extract(html, '(?is)<base\\b[^>]*>') AS tag FROM p WHERE node IS NOT NULL)),
o AS (SELECT node, html, coalesce({full("bt", "url")}, url) AS base FROM q),
tags AS (SELECT node, base, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM o),
links AS (SELECT *, {raw} AS t FROM tags WHERE regexp_matches(tag, '(?is)\\brel\\s*=\\s*["'']?canonical\\b|http-equiv\\s*=\\s*["'']?refresh\\b')),
fulls AS (SELECT node, {full("t", "base")} AS u FROM links),
e AS (SELECT DISTINCT node AS a, b, {host("b")} AS bh, {path("b")} AS bp FROM (SELECT node, {node("u")} AS b FROM fulls WHERE u IS NOT NULL)),
ways AS (SELECT a, b FROM e WHERE b IS NOT NULL AND a <> b UNION SELECT b, a FROM e WHERE b IS NOT NULL AND a <> b),
walk(a, b) AS (SELECT a, b FROM ways UNION SELECT w.a, x.b FROM walk w JOIN ways x ON w.b = x.a),
told AS (SELECT node, verdict FROM p JOIN r ON r.i = p.i AND k = 1 UNION SELECT b, arg_max(verdict, length(rh || rp)) FROM e JOIN rules ON (bh = rh OR ends_with(bh, '.' || rh)) AND starts_with(bp, rp) GROUP BY b, bh, bp),
said AS (SELECT w.a AS node, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS said FROM walk w JOIN told ON told.node = w.b GROUP BY w.a)
SELECT page_id, host, path, rule, coalesce(r.verdict, said, 'allow') AS verdict FROM p LEFT JOIN r ON r.i = p.i AND k = 1 LEFT JOIN said ON said.node = p.node"""
