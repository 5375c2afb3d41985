"""URL filters with redirect equivalence, by DataFrame operations only.

A url takes the verdict of the longest rule that fits it. Urls that redirect to
one another (redirect and canonical-link edges) are aliases: connected
components over these edges, found in distributed rounds, carry the block of
any member to all members without a rule of their own. An explicit allow comes
first: a url that a rule allows stays allowed. What no rule and no alias
blocks is allowed.

Urls that differ in scheme, host case, fragment or a final ``/`` only are the same node.

Defined cases: a null url, or one without ``://``, has empty host and path, fits
no rule, is alias of nothing and is allowed; of rules of the same length the
first by text wins; repeated rows each get their verdict; edges with an end
that is no url are ignored; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .license_scan import LOWER, UPPER
from .shared import cut

# The rules of the contract.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""

BASE = r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
#: What follows ``&#`` in a numeric character reference.
NUMBER = "^([xX][0-9a-fA-F]{1,8}|[0-9]{1,8});?"


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``(verdict, rule, rule_host, rule_path)``; a rule is ``host/path``."""
    rows = [(v, r, r.split("/", 1)[0].lower(), "/" + r.split("/", 1)[1] if "/" in r else "") for v, r in rules]
    return spark.createDataFrame(rows, "verdict string, rule string, rule_host string, rule_path string")


def _after(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_after(url), F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_after(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def node(url: Column) -> Column:
    """What a url and its trivial variants share; null without a host."""
    query = F.regexp_extract(_after(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(host(url) != "", F.concat(host(url), F.regexp_replace(path(url), "/$", ""), query))


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (distinct ``node``, ``host``, ``path``) with ``rule`` and
    ``own`` verdict. The rules of each of the host's suffixes are joined
    (labels of a host bound how often a row is copied); Spark broadcasts the rules
    where it finds them small."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = urls.withColumn("suffix", F.explode(suffixes))
    fits = (F.col("suffix") == F.col("rule_host")) & F.startswith("path", "rule_path")
    best = F.min(F.when(F.col("rule").isNotNull(), F.struct((-F.length("rule")).alias("n"), "rule", "verdict")))
    return (parts.join(rules, fits, "left").groupBy("node", "host", "path").agg(best.alias("best"))
            .select("node", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("own")))


def unescaped(text: Column) -> Column:
    """Character references of an attribute's value decoded, each once:
    numeric ones and those of ``&``, ``<``, ``>`` and quotes."""
    named = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(
        c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')),
        F.lit("&apos;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))

    def decoded(part: Column) -> Column:
        code = F.regexp_extract(part, NUMBER, 1)
        n = F.when(F.lower(code).startswith("x"), F.conv(F.substr(code, F.lit(2)), 16, 10)).otherwise(code).cast("bigint")
        valid = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(valid, F.concat(char, named(F.regexp_replace(part, NUMBER, "")))).otherwise(F.concat(F.lit("&#"), named(part)))

    parts = F.split(text, "&#(?=[xX][0-9a-fA-F]{1,8}|[0-9]{1,8})", -1)
    whole = F.concat(named(parts[0]), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decoded), ""))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def resolved(df: DataFrame, target: str, base: str) -> DataFrame:
    """``df`` with ``target`` as the url that it means on a page at ``base``;
    what names a scheme stays. In steps, as each uses the last one's columns several times."""
    t, names = F.col(target), df.columns
    own = F.regexp_extract(t, "^[^?#]*", 0)
    steps = df.withColumns({"__path": path(F.col(base)), "__site": F.concat(F.lit("http://"), host(F.col(base))), "__own": own})
    folder = F.regexp_replace(F.when(F.col("__path") == "", "/").otherwise(F.col("__path")), "[^/]*$", "")
    steps = steps.withColumn("__own", F.when(F.startswith("__own", F.lit("/")), F.col("__own")).otherwise(F.concat(folder, "__own")))
    # without the segments . and ..
    none = F.array().cast("array<string>")
    held = F.aggregate(F.split("__own", "/", -1), none, lambda held, x: F.when(x == ".", held)
                       .when(x == "..", F.when(F.size(held) > 2, F.slice(held, 1, F.size(held) - 1)).otherwise(F.array(F.lit(""))))
                       .otherwise(F.concat(held, F.array(x))))
    end = F.when(F.col("__own").rlike(r"/\.\.?$"), F.array(F.lit(""))).otherwise(none)
    steps = steps.withColumn("__own", F.when(F.col("__own").rlike(r"/\.\.?(/|$)"), F.array_join(F.concat(held, end), "/")).otherwise(F.col("__own")))
    whole = (F.when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), t)
             .when(F.startswith(t, F.lit("//")), F.concat(F.lit("http:"), t))
             .when((t == "") | F.startswith(t, F.lit("#")), F.col(base))
             .when(F.startswith(t, F.lit("?")), F.concat("__site", "__path", t))
             .otherwise(F.concat("__site", "__own", F.regexp_extract(t, "^[^?#]*(.*)$", 1))))
    return steps.withColumn(target, whole).select(*names)


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(source, target)`` urls: all canonical links and refreshes of the pages;
    a relative target is resolved against the page's ``<base>``, or its url. Written, as they are read more than once."""
    tags = F.when(F.lower(F.col(html)).rlike(r"(?i)canonical|http-equiv"), F.col(html))
    every = lambda pattern: F.regexp_extract_all(tags, F.lit(pattern), F.lit(1))
    found = pages.select(F.col(url).alias("source"), F.regexp_extract(tags, BASE, 1).alias("base"),
                         F.explode(F.concat(every(CANONICAL), every(REFRESH))).alias("target"))
    found = cut(found.where("source is not null and target <> ''"))
    found = found.select("source", unescaped(F.col("base")).alias("base"), unescaped(F.col("target")).alias("target"))
    found = cut(resolved(found, "base", "source"))
    return cut(resolved(found, "target", "base")).select("source", "target")


def filter_urls(pages: DataFrame, edges: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``alias_of``
    (smallest node of its component where the verdict comes from an alias,
    else null); columns of these names are replaced. ``edges``: ``(source,
    target)`` urls."""
    ends = edges.select(node(F.col("source")).alias("a"), node(F.col("target")).alias("b"),
                        F.explode(F.array("source", "target")).alias("url")).where("a is not null and b is not null")
    member = components(ends, "a", "b")
    marked = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url)), "__node": node(F.col(url))})
    # the path decides the rule and a final "/" is not in the node: both are keys
    seen = marked.select(F.col("__node").alias("node"), "host", "path").unionByName(
        ends.select(node(F.col("url")).alias("node"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path")))
    own = judged(seen.where("node is not null").distinct(), rules)
    named = own.join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
    blocked = cut(named.where("own = 'block'").select("root").distinct().withColumn("hit", F.lit(True)))
    final = named.join(blocked, "root", "left").select(
        F.col("node").alias("__node"), F.col("path").alias("__path"), F.col("rule").alias("__rule"),
        F.coalesce("own", F.when(F.col("hit"), F.lit("block")), F.lit("allow")).alias("__verdict"),
        F.when(F.col("own").isNull() & F.col("hit"), F.col("root")).alias("__alias"))
    out = marked.withColumn("__path", F.col("path")).drop("rule", "verdict", "alias_of").join(final, ["__node", "__path"], "left")
    return out.withColumns({"rule": F.col("__rule"), "verdict": F.coalesce("__verdict", F.lit("allow")),
                            "alias_of": F.col("__alias")}).drop("__node", "__path", "__rule", "__verdict", "__alias")


def oracle_sql() -> str:
    """The same over ``pages`` in DuckDB, with the rules of ``RULES``."""
    rules = ", ".join(f"('{v}', '{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for v, r in RULES)
    after = lambda u: f"CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"
    parse = lambda u: (f"translate(regexp_extract({after(u)}, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, "  # noqa: E731
                       f"regexp_extract({after(u)}, '^[^/?#]*([^?#]*)', 1) AS path, "
                       f"regexp_extract({after(u)}, '^[^?#]*(\\?[^#]*)?', 1) AS query")
    key = "CASE WHEN host <> '' THEN host || regexp_replace(path, '/$', '') || query END"
    # RE2 has no look-ahead: the tag first, its target then
    tag = lambda name, mark, at: (f"regexp_extract(regexp_extract(html, '(?is)<{name}\\b[^>]*{mark}[^>]*>'), "  # noqa: E731
                                  f"'(?is)\\b{at}\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1)")
    link = tag("link", "\\brel\\s*=\\s*[\"'']?canonical\\b", "href")
    refresh = tag("meta", "\\bhttp-equiv\\s*=\\s*[\"'']?refresh\\b", "url")
    return f"""
WITH RECURSIVE rules(verdict, rule, rule_host, rule_path) AS (VALUES {rules}),
p AS (SELECT page_id, url, {parse('coalesce(url, \'\')')} FROM pages),
e0 AS (SELECT url AS source, {link} AS target FROM pages UNION ALL SELECT url, {refresh} FROM pages),
e1 AS (SELECT source, CASE WHEN target LIKE '//%' THEN 'http:' || target
         WHEN target LIKE '/%' THEN 'http://' || translate(regexp_extract({after('source')}, '^[^/?#]*'), '{UPPER}', '{LOWER}') || target
         ELSE target END AS target FROM e0 WHERE target <> ''),
e2 AS (SELECT (SELECT {key} FROM (SELECT {parse('source')})) AS a, (SELECT {key} FROM (SELECT {parse('target')})) AS b, source, target FROM e1),
u AS (SELECT {key} AS node, host, path FROM p
      UNION SELECT {key}, host, path FROM (SELECT {parse('url')} FROM (SELECT unnest([source, target]) AS url FROM e2 WHERE a IS NOT NULL AND b IS NOT NULL))),
j AS (SELECT node, host, path, min({{'n': -length(rule), 'rule': rule, 'verdict': verdict}}) FILTER (rule IS NOT NULL) AS best
      FROM u LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
      WHERE node IS NOT NULL GROUP BY node, host, path),
s AS (SELECT a, b FROM e2 WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e2 WHERE a IS NOT NULL AND b IS NOT NULL),
reach(a, b) AS (SELECT node, node FROM j UNION SELECT reach.a, s.b FROM reach JOIN s ON reach.b = s.a),
hit AS (SELECT DISTINCT reach.a AS node FROM reach JOIN j ON reach.b = j.node WHERE j.best.verdict = 'block')
SELECT page_id, p.host, p.path, j.best.rule AS rule,
  coalesce(j.best.verdict, CASE WHEN hit.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM (SELECT *, {key} AS node FROM p) p LEFT JOIN j ON p.node = j.node AND p.path = j.path LEFT JOIN hit ON p.node = hit.node"""
