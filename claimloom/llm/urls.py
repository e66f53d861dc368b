"""URL filters with redirect equivalence, in DataFrame operations only.

Rules name a host and a path; the longest that fits a URL decides it. Redirects and canonical links say that two addresses are one
resource: their connected components are found with distributed star contraction, and a component with a blocked address is blocked for
all its addresses that no rule names. A rule that allows an address outranks what comes from its aliases; an address that neither a rule
nor an alias decides is allowed.

Edge cases: a null URL or one without `://` has empty host and path, fits no rule and has no aliases; repeated rows are judged alike;
empty tables and pages without links work; a null html has no links; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.base import let

from .graph import components

#: The rules of the registered query.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path with its segments `.` and `..` carried out; above the root there is nothing to go up to."""
    kept = F.aggregate(
        F.slice(F.split(path, "/"), 2, F.length(path) + 1),
        F.expr("cast(array() as array<string>)"),
        lambda out, x: F.when(x == ".", out).when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x))),
    )
    end = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/"), end), "^//$", "/")


def address(url: Column) -> Column:
    """The node of a URL: host, path without dot segments, and query, without scheme and fragment; null where there is no host."""
    query = F.regexp_extract(url, "://[^/?#]*[^?#]*([^#]*)", 1)
    plain = let(path(url), lambda own: F.when(own.rlike(r"/\.\.?(/|$)"), without_dots(own)).otherwise(own))
    return let(host(url), lambda h: F.when(h != "", F.concat(h, plain, query)))


def fitting(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits; of equal ones the one that allows."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow")):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule string")


def fitted(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds `rule` and `decision`, the longest rule that fits and what it says, to urls (host, path, ...), from a table of rules (verdict, rule) of any size.

    Every suffix of a host at a dot is looked up for the lengths that rules of that host have; only beginnings of the path of such a length are looked up as
    rules. Both lookups are joins on equal keys, and what a URL sends is bounded by its own length. Of rules that are written twice, and of equally long ones, one that allows counts."""
    own = rules.groupBy("rule").agg(F.min("verdict").alias("decision"))
    own = own.select("rule", "decision", F.regexp_extract("rule", "^([^/]*)", 1).alias("_h"), F.regexp_extract("rule", "^[^/]*(.*)$", 1).alias("_p"))
    lengths = own.groupBy("_h").agg(F.collect_set(F.length("_p")).alias("_lengths"))  # a number for each length of a path, at most
    asked = urls.select("host", "path").where("host <> ''").distinct()
    parts = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    met = asked.select("host", "path", F.explode(suffix).alias("_h")).join(lengths, "_h")
    met = met.select("host", "path", "_h", F.explode(F.filter("_lengths", lambda n: n <= F.length("path"))).alias("_n"))
    met = met.select("host", "path", F.concat("_h", F.expr("left(path, _n)")).alias("rule")).join(own.select("rule", "decision"), "rule")
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("decision") == "allow").alias("allows"), "rule", "decision")).alias("_best"))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, F.col("_best.rule").alias("rule"), F.col("_best.decision").alias("decision"))


def decided(rule: Column, rules: list[tuple[str, str]]) -> Column:
    allow = {r for what, r in rules if what == "allow"}
    return F.when(rule.isin(sorted(allow)), "allow").when(rule.isNotNull(), "block")


def links(pages: DataFrame) -> DataFrame:
    """src, dst: the redirect and canonical-link edges that the pages declare; what stands in comments declares nothing."""
    tag = lambda what: F.regexp_extract(F.regexp_replace("html", "(?s)<!--.*?(?:-->|$)", " "), what, 0)
    value = lambda x, name: F.regexp_replace(F.regexp_extract(x, rf"(?is)\b{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1), "^[\"']|[\"']$", "")
    canonical = value(tag(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), "href")
    refresh = F.regexp_extract(value(tag(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), "content"), r"(?is)^\s*\d+\s*[;,]\s*(?:url\s*=\s*)?[\"']?([^\"']+)", 1)
    some = pages.where("url is not null and html is not null").where(F.col("html").rlike("(?i)canonical|refresh"))
    out = some.select("url", F.explode(F.array(canonical, refresh)).alias("to")).where("to <> ''")
    scheme, to = F.regexp_extract("url", "^([^:]*):", 1), F.replace(F.trim("to"), F.lit("&amp;"), F.lit("&"))
    base = F.regexp_extract("url", "^[^:]*://[^/?#]*", 0)
    folder = F.regexp_extract("url", "^[^:]*://[^/?#]*(?:/[^?#]*/|/)?", 0)
    full = F.when(to.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), to).when(to.startswith("?"), F.concat(F.regexp_extract("url", "^[^?#]*", 0), to)).when(to.startswith("#"), F.col("url")).when(to.startswith("//"), F.concat(scheme, F.lit(":"), to)).when(to.startswith("/"), F.concat(base, to)).otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), to))
    out = out.select("url", full.alias("full"))
    return out.select(address(F.col("url")).alias("src"), address(F.col("full")).alias("dst")).where("src is not null and dst is not null and src <> dst")


def judge(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each page. rules: a short list, or a table (verdict, rule); edges (src, dst): further redirects between
    addresses."""

    def with_rule(urls: DataFrame) -> DataFrame:
        if isinstance(rules, DataFrame):
            return fitted(urls, rules)
        return urls.withColumn("rule", fitting(F.col("host"), F.col("path"), rules)).withColumn("decision", decided(F.col("rule"), rules))

    own = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), address(F.col("url")).alias("node"))
    own = with_rule(own)
    found = links(pages)
    if edges is not None:
        found = found.unionByName(edges.select("src", "dst"))
    group = components(found, "src", "dst")
    as_url = F.concat(F.lit("x://"), F.col("node"))
    bad = with_rule(group.select("component", host(as_url).alias("host"), path(as_url).alias("path"))).where("decision = 'block'").select("component").distinct()
    blocked = group.join(bad, "component", "left_semi").select("node", F.lit("block").alias("alias"))
    return own.join(blocked, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("decision", "alias", F.lit("allow")).alias("verdict"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), RULES)


OP8_SQL = r"""
WITH RECURSIVE r AS (SELECT * FROM (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
                 ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')) AS t(rule, h, p, verdict)),
raw AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
        translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '://[^/?#]*([^#]*)', 1) AS rest FROM pages),
edge AS (SELECT DISTINCT host || rest AS src, translate(regexp_extract(t, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(t, '://[^/?#]*([^#]*)', 1) AS dst
         FROM (SELECT host, rest, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']([^"'']*)', 1) AS t FROM raw) WHERE host <> '' AND contains(t, '://')),
both_ways AS (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge),
reach AS (SELECT src AS a, src AS b FROM both_ways UNION SELECT reach.a, both_ways.dst FROM reach JOIN both_ways ON reach.b = both_ways.src),
fit AS (SELECT node, arg_max(verdict, length(rule)) AS verdict FROM (SELECT DISTINCT b AS node, regexp_extract(b, '^[^/?#]*') AS host, regexp_extract(b, '^[^/?#]*([^?#]*)', 1) AS path FROM reach) n
        JOIN r ON (n.host = r.h OR ends_with(n.host, '.' || r.h)) AND starts_with(n.path, r.p) GROUP BY node),
alias AS (SELECT DISTINCT a FROM reach JOIN fit ON fit.node = reach.b WHERE fit.verdict = 'block'),
best AS (SELECT page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict FROM raw JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT raw.page_id, host, path, best.rule AS rule, CASE WHEN best.verdict IS NOT NULL THEN best.verdict WHEN alias.a IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM raw LEFT JOIN best USING (page_id) LEFT JOIN alias ON alias.a = raw.host || raw.rest AND raw.host <> ''
"""

QUERIES = {"op8_url_filter": op8}
SQL = {"op8_url_filter": OP8_SQL}
