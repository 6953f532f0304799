"""URL filter with redirect equivalence, in DataFrame functions only.

Rules judge URLs by host and path. URLs that redirect to one another, or name one
another as canonical, are aliases: the connected components over these links pass
decisions on to URLs that no rule fits. A rule that fits a URL always decides for
that URL. Among aliases an explicit allow takes precedence over a block.

Rules are a table and may be millions. A URL looks up its host's suffixes, a few,
and of each suffix that has rules the prefixes of its path that are as long as one
of them; the longest find decides. A handful of rules is an expression instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, lower_ascii, materialize, scratch
from .components import connected_components

#: Up to this many rules are branches of an expression; more are joined.
INLINE_RULES = 200
#: Keys that rows without an alias are spread over, and files of the table of aliases.
SALTS, ALIAS_FILES = 1024, 32


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    if verdict not in ("allow", "block") or not host:
        raise ValueError(f"not a rule: {verdict} {text}")
    return Rule(verdict, host, slash + path)


#: The rules of the judged task.
RULES = (
    parse_rule("allow", "org/"),
    parse_rule("block", "example.org/es/"),
    parse_rule("block", "example.org/en/1"),
    parse_rule("allow", "com/fr/"),
    parse_rule("block", "com/de/"),
)


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does.

    Of rules of one length the first in the list wins.
    """
    out = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return none if out is None else out.otherwise(none)


def _looked_up(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, r): the rule for every distinct pair of ``rows`` that one fits.

    ``rules`` has (verdict, host, path, i); of rules of one length the least i wins.
    """
    rules = rules.select(F.col("host").alias("rh"), F.col("path").alias("rp"), F.struct((F.length("host") + F.length("path")).alias("n"), (-F.col("i")).alias("i"), F.concat("host", "path").alias("rule"), "verdict").alias("r"))
    rules = materialize(rules.groupBy("rh", "rp").agg(F.max("r").alias("r")), "rules")
    lengths = rules.groupBy("rh").agg(F.collect_set(F.length("rp")).alias("lengths"))  # a path's length bounds them
    urls = rows.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = urls.select("host", "path", F.explode(suffixes).alias("rh")).join(lengths, "rh")
    found = found.select("host", "path", "rh", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    found = found.withColumn("rp", F.substring(F.col("path"), F.lit(1), F.col("n"))).join(rules, ["rh", "rp"])
    return found.groupBy("host", "path").agg(F.max("r").alias("m")).select("host", "path", F.struct("m.rule", "m.verdict").alias("r"))


def with_rule(rows: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES) -> DataFrame:
    """``rows``, which have host and path, plus ``r`` (rule, verdict), null where no rule fits."""
    if isinstance(rules, tuple):
        if len(rules) <= INLINE_RULES:
            return rows.withColumn("r", fitting_rule(F.col("host"), F.col("path"), rules))
        rules = rows.sparkSession.createDataFrame([(r.verdict, r.host, r.path, i) for i, r in enumerate(rules)], "verdict string, host string, path string, i long")
    return rows.join(_looked_up(rows, rules), ["host", "path"], "left")


def without_fragment(url: Column) -> Column:
    """A fragment never reaches the server, so it names the same resource."""
    return F.substring_index(url, "#", 1)


def _without_dots(path: Column) -> Column:
    """'/a/./b/../c' is '/a/c'; a dot segment at the end leaves its slash."""
    step = lambda a, x: F.when(x == "..", F.regexp_replace(a, "/[^/]*$", "")).when(x == ".", a).otherwise(F.concat(a, F.lit("/"), x))
    walked = let(F.split(path, "/"), lambda parts: F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.lit(""), step))
    return F.concat(walked, F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))


def normal(url: Column) -> Column:
    """A URL's name among aliases: without its fragment, scheme and host in lower
    case, an empty path as ``/`` and dot segments worked out; as it is without ``://``."""
    worked = lambda path: F.when(path == "", "/").when(path.contains("/."), _without_dots(path)).otherwise(path)
    made = lambda bare: F.concat(lower_ascii(F.substring_index(bare, "://", 1)), F.lit("://"), host_of(bare), let(path_of(bare), worked), F.regexp_extract(bare, r"(\?.*)$", 1))
    return let(without_fragment(url), lambda bare: F.when(F.contains(bare, F.lit("://")), made(bare)).otherwise(bare))


def _resolved(target: Column, base: Column) -> Column:
    """An absolute URL for a link's target on the page ``base``; null if there is none.

    Targets may be absolute, without a scheme (``//host/x``), without a host (``/x``),
    a query alone (``?x``), or relative to the page's path (``x``, ``../x``). A base
    without ``://`` has absolute targets only.
    """
    scheme = F.substring_index(base, "://", 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(_after_scheme(base), r"^([^/?#]*)", 1))
    folder = F.coalesce(F.nullif(F.regexp_extract(path_of(base), r"^(.*/)", 1), F.lit("")), F.lit("/"))

    def absolute(t: Column) -> Column:
        relative = F.when(t.startswith("//"), F.concat(scheme, F.lit(":"), t)).when(t.startswith("/"), F.concat(root, t)).when(t.startswith("?"), F.concat(root, path_of(base), t)).otherwise(F.concat(root, folder, t))
        other = t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (t == "") | ~F.contains(base, F.lit("://"))
        return F.when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(~other, relative)

    return normal(let(without_fragment(F.replace(F.trim(target), F.lit("&amp;"), F.lit("&"))), absolute))


#: Only tags that may hold such a link are searched for their attributes.
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""


def alias_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): URL and the URL that its page redirects to or names as canonical.

    Both are in their normal form, which tells no fragments, dot segments or cases of
    the host apart.
    """
    url, html = F.col(url_col), F.col(html_col)
    # Most pages have neither word and are not searched further.
    likely = F.contains(F.lower(html), F.lit("canonical")) | F.contains(F.lower(html), F.lit("http-equiv"))
    found = F.concat(*[F.regexp_extract_all(html, F.lit(pattern), F.lit(1)) for pattern in (_CANONICAL, _REFRESH)])
    links = pages.where(url.isNotNull() & likely).select(normal(url).alias("a"), F.explode(found).alias("t"))
    return links.select("a", _resolved(F.col("t"), F.col("a")).alias("b")).where("a <> b")


def judge_urls(pages: DataFrame, *, rules: tuple[Rule, ...] | DataFrame = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row.

    ``rules`` are a tuple, in which the first of equal length wins, or a table of
    (verdict, host, path, i) with numbers in their place. ``redirects`` may give
    further (a, b) edges between URLs. Null URLs and those without ``://`` have empty
    host and path, and no rule fits them. Verdict of a URL that no rule fits: allow if
    an alias is allowed by a rule, else block if one is blocked, else ``default``.
    Repeated rows get the same verdict. Aliases that are no pages count by their own
    rules too, in their normal form.
    """
    edges = alias_edges(pages, url_col=url_col, html_col=html_col)
    if redirects is not None:
        edges = edges.union(redirects.select(normal(F.col("a")), normal(F.col("b"))))
    with scratch() as keep:
        labels = connected_components(edges)
        # Members are decided by rules on their URLs alone, whether pages or not.
        named = labels.select("v", "root", host_of(F.col("v")).alias("host"), path_of(F.col("v")).alias("path"))
        said = with_rule(named, rules).select("v", "root", F.col("r.verdict").alias("said"))
        classes = said.groupBy("root").agg(F.max(F.col("said") == "allow").alias("allowed"), F.max(F.col("said") == "block").alias("blocked"))
        passed = said.where("said is null").join(classes.where("allowed or blocked"), "root")
        passed = keep(materialize(passed.select(F.col("v").alias("alias"), F.when(F.col("allowed"), "allow").otherwise("block").alias("inherited")), "inherited", files=ALIAS_FILES))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("u"))
    rows = with_rule(rows.withColumn("host", host_of(F.col("u"))).withColumn("path", path_of(F.col("u"))), rules)
    # Rows that a rule decides, and null URLs, have no alias: their keys name none and are many.
    none = F.concat(F.lit("none "), F.pmod(F.xxhash64("page_id", "u"), F.lit(SALTS)).cast("string"))
    rows = rows.withColumn("alias", F.when(F.col("r").isNull() & F.col("u").isNotNull(), normal(F.col("u"))).otherwise(none))
    out = rows.join(passed, "alias", "left")
    return out.select(F.col("page_id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "inherited", F.lit(default)).alias("verdict"))


def oracle(rules: tuple[Rule, ...] = RULES, default: str = "allow") -> str:
    """``judge_urls`` of ``pages``, for DuckDB."""
    listed = ", ".join(f"({i}, '{r.verdict}', '{r.host}', '{r.path}')" for i, r in enumerate(rules))

    def split(url: str) -> str:
        rest = f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) END"
        host = f"translate(coalesce(regexp_extract({rest}, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"{host} AS host, coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path"

    def normal_sql(url: str) -> str:
        bare = f"split_part({url}, '#', 1)"
        rest = f"substr({bare}, strpos({bare}, '://') + 3)"
        path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
        walk = f"list_reduce(list_concat([''], string_split({path}, '/')[2:]), lambda a, x: CASE x WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN '.' THEN a ELSE a || '/' || x END)"
        worked = f"{walk} || CASE WHEN regexp_matches({path}, '/\\.\\.?$') THEN '/' ELSE '' END"
        low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        head = f"{low(f"split_part({bare}, '://', 1)")} || '://' || {low(f"regexp_extract({rest}, '^([^/?#]*)', 1)")}"
        return f"CASE WHEN contains({bare}, '://') THEN {head} || CASE WHEN {path} = '' THEN '/' WHEN contains({path}, '/.') THEN {worked} ELSE {path} END || regexp_extract({bare}, '(\\?.*)$', 1) ELSE {bare} END"

    return rf"""
WITH RECURSIVE rules(i, verdict, host, path) AS (VALUES {listed}),
base AS (SELECT page_id, url, html, {normal_sql("url")} AS bare FROM pages),
tags AS (
  SELECT bare, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS tag, 'link' AS kind FROM base
  UNION ALL SELECT bare, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*>')), 'meta' FROM base),
raw AS (
  SELECT bare, split_part(replace(trim(CASE kind WHEN 'link' THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) ELSE regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END), '&amp;', '&'), '#', 1) AS target
  FROM tags WHERE bare IS NOT NULL AND (kind = 'link' AND regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical\b') OR kind = 'meta' AND regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b'))),
place AS (SELECT bare, target, split_part(bare, '://', 1) AS scheme, regexp_extract(substr(bare, strpos(bare, '://') + 3), '^([^/?#]*)', 1) AS h, regexp_extract(substr(bare, strpos(bare, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS p FROM raw),
absolute AS (
  SELECT bare, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') OR target = '' OR NOT contains(bare, '://') THEN NULL
    WHEN starts_with(target, '//') THEN scheme || ':' || target WHEN starts_with(target, '/') THEN scheme || '://' || h || target
    WHEN starts_with(target, '?') THEN scheme || '://' || h || p || target ELSE scheme || '://' || h || coalesce(nullif(regexp_extract(p, '^(.*/)', 1), ''), '/') || target END AS u FROM place),
full_url AS (SELECT bare AS a, {normal_sql("u")} AS b FROM absolute),
edge AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM full_url UNION ALL SELECT b, a FROM full_url) u WHERE a <> b),
reach(v, r) AS (SELECT a, a FROM edge UNION SELECT reach.v, edge.b FROM reach JOIN edge ON reach.r = edge.a),
member AS (SELECT v, min(r) AS root, {split("v")} FROM reach GROUP BY v),
said AS (SELECT v, any_value(root) AS root, arg_max(rules.verdict, length(rules.host || rules.path) * 10000 - i) AS verdict
         FROM member LEFT JOIN rules ON (member.host = rules.host OR ends_with(member.host, '.' || rules.host)) AND starts_with(member.path, rules.path) GROUP BY v),
class AS (SELECT root, bool_or(verdict = 'allow') AS allowed, bool_or(verdict = 'block') AS blocked FROM said GROUP BY root),
heir AS (SELECT v, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END AS verdict FROM said JOIN class USING (root)),
page AS (SELECT row_number() OVER () AS n, page_id, bare, {split("url")} FROM base),
ruled AS (SELECT page.n, any_value(page_id) AS page_id, any_value(bare) AS bare, any_value(page.host) AS host, any_value(page.path) AS path,
                 arg_max(rules.host || rules.path, length(rules.host || rules.path) * 10000 - i) AS rule, arg_max(rules.verdict, length(rules.host || rules.path) * 10000 - i) AS verdict
          FROM page LEFT JOIN rules ON (page.host = rules.host OR ends_with(page.host, '.' || rules.host)) AND starts_with(page.path, rules.path) GROUP BY page.n)
SELECT page_id, host, path, rule, coalesce(ruled.verdict, heir.verdict, '{default}') AS verdict FROM ruled LEFT JOIN heir ON heir.v = ruled.bare"""
