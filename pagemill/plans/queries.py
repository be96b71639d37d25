"""Every registered query, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import nodes as N
from pagemill.functions import pages as P
from pagemill.functions import text as X
from pagemill.functions import urls as U
from pagemill.operators import archive, cookies, crawl, evaluate, images, manifest, policy, requests, robots, state
from pagemill.session import shared_folder, ship, stored

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(df: DataFrame) -> DataFrame:
    """Rows over all cores before Python sees them where the scan has fewer partitions than there are cores: of a small file. Large tables
    are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


class Rows:
    """A small fixed table, for Spark and as SQL VALUES."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.names = [c.split()[0] for c in schema.split(", ")]

    def df(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self) -> str:
        kinds = {"string": "VARCHAR", "bigint": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE", "int": "INT"}
        cast = ", ".join(f"CAST({n} AS {kinds[c.split()[1]]}) {n}" for n, c in zip(self.names, self.schema.split(", ")))
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        return f"(SELECT {cast} FROM (VALUES {values}) v({', '.join(self.names)}))"


# ---- addresses -------------------------------------------------------------------------------------------------------

#: What each page's url becomes, to meet every branch: Spark's and DuckDB's form of the same expression.
_VARIANTS = (
    ("plain", lambda u: u, "url"),
    ("shout", lambda u: F.regexp_replace(F.regexp_replace(u, "^https?", "HTTPS"), r"example\.", "EXAMPLE."), "regexp_replace(regexp_replace(url, '^https?', 'HTTPS'), 'example\\.', 'EXAMPLE.', 'g')"),
    ("port", lambda u: F.regexp_replace(u, r"(example\.[a-z]+)", "$1:443"), "regexp_replace(url, '(example\\.[a-z]+)', '\\1:443', 'g')"),
    ("odd_port", lambda u: F.regexp_replace(u, r"(example\.[a-z]+)", "$1:8080"), "regexp_replace(url, '(example\\.[a-z]+)', '\\1:8080', 'g')"),
    ("bad_port", lambda u: F.regexp_replace(u, r"(example\.[a-z]+)", "$1:99999"), "regexp_replace(url, '(example\\.[a-z]+)', '\\1:99999', 'g')"),
    ("user", lambda u: F.regexp_replace(u, "://", "://me:pw@"), "regexp_replace(url, '://', '://me:pw@')"),
    ("fragment", lambda u: F.concat(u, F.lit("#part")), "url || '#part'"),
    ("dot", lambda u: F.regexp_replace(u, r"(example\.[a-z]+)", "$1."), "regexp_replace(url, '(example\\.[a-z]+)', '\\1.', 'g')"),
    ("mail", lambda u: F.regexp_replace(u, "^https?://", "mailto:"), "regexp_replace(url, '^https?://', 'mailto:')"),
    ("escape", lambda u: F.concat(F.regexp_replace(u, r"[?#].*$", ""), F.lit("/%2e%2e/a%2Fb/c d é.x.html")), "regexp_replace(url, '[?#].*$', '') || '/%2e%2e/a%2Fb/c d é.x.html'"),
)
_SQL_VARIANTS = "(" + " UNION ALL ".join(f"SELECT page_id, '{n}' variant, {s} url FROM pages" for n, _, s in _VARIANTS) + ")"


def variants(spark, sf_dir: str) -> DataFrame:
    forms = F.array(*[F.struct(F.lit(n).alias("variant"), f(F.col("url")).alias("url")) for n, f, _ in _VARIANTS])
    return table(spark, sf_dir, "pages").select("page_id", F.explode(forms).alias("v")).select("page_id", "v.*")


@query("url_split", f"SELECT page_id, variant, sch scheme, net netloc, pat path, qry query, frg fragment, host, port FROM ({U.sql_parts(_SQL_VARIANTS)})")
def url_split(spark, sf_dir):
    v = variants(spark, sf_dir).withColumn("s", U.split_url(F.col("url")))
    return v.select("page_id", "variant", *[f"s.{c}" for c in ("scheme", "netloc", "path", "query", "fragment", "host", "port")])


@query("url_identity", f"SELECT page_id, variant, {U.SQL_IDENTITY} AS identity FROM ({U.sql_parts(_SQL_VARIANTS)})")
def url_identity(spark, sf_dir):
    return U.with_identity(variants(spark, sf_dir)).select("page_id", "variant", "identity")


@query("url_keys", f"""SELECT page_id, variant, sch || '://' || lower(net) AS origin, lower(net) AS limiter, sch || '://' || net || '/robots.txt' AS robots,
  regexp_matches(url, '^(?i)https?://[^/?#]+') AS is_url, coalesce(sch IN ('http', 'https'), false) AS is_remote FROM ({U.sql_parts(_SQL_VARIANTS)})""")
def url_keys(spark, sf_dir):
    u = F.col("url")
    return variants(spark, sf_dir).select(
        "page_id", "variant", U.origin_key(u).alias("origin"), U.limiter_key(u).alias("limiter"), U.robots_url(u).alias("robots"), U.is_url(u).alias("is_url"), U.is_remote(u).alias("is_remote")
    )


_LABEL = "[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"


@query("destination_origins", f"""SELECT page_id, variant, CASE WHEN ok THEN h END AS host, CASE WHEN ok THEN coalesce(try_cast(port AS INT), CASE sch WHEN 'https' THEN 443 ELSE 80 END) END AS port
FROM (SELECT *, regexp_replace(host, '\\.+$', '') h, sch IN ('http', 'https') AND usr IS NULL AND {U.SQL_PORT_OK}
  AND regexp_matches(regexp_replace(host, '\\.+$', ''), '^{_LABEL}(\\.{_LABEL})*$') AND len(host) <= 253 ok FROM ({U.sql_parts(_SQL_VARIANTS)}))""")
def destination_origins(spark, sf_dir):
    return variants(spark, sf_dir).withColumn("o", U.destination_origin(F.col("url"))).select("page_id", "variant", "o.host", "o.port")


_PORT = "coalesce(nullif(try_cast({0}port AS INT), 0), CASE {0}sch WHEN 'https' THEN 443 ELSE 80 END)"
_BASE = "https://blog.tionsh.example.com/en/"


@query("crawl_scope", f"""WITH a AS (SELECT * FROM ({U.sql_parts(_SQL_VARIANTS)})),
s AS (SELECT page_id, variant, sch IN ('http', 'https') AND host <> '' AND usr IS NULL AND {U.SQL_PORT_OK} ok, regexp_replace(host, '\\.+$', '') h, {_PORT.format('')} p, url FROM a)
SELECT page_id, variant, coalesce(ok AND h = 'blog.tionsh.example.com' AND p = 443, false) AS domain_only, coalesce(ok AND h = 'blog.tionsh.example.com', false) AS host_only,
  coalesce(ok AND (h = 'example.com' OR ends_with(h, '.example.com')), false) AS subdomain, coalesce(ok AND regexp_matches(url, '/(en|fr)/[0-9]+'), false) AS pattern FROM s""")
def crawl_scope(spark, sf_dir):
    u, b = F.col("url"), F.lit(_BASE)
    return variants(spark, sf_dir).select(
        "page_id", "variant", U.in_scope(u, b, "domain-only").alias("domain_only"), U.in_scope(u, b, "host-only").alias("host_only"),
        U.in_scope(u, F.lit("https://example.com/"), "subdomain").alias("subdomain"), U.in_scope(u, b, "/(en|fr)/[0-9]+").alias("pattern"),
    )


_SQL_IDENTITIES = f"(SELECT page_id, variant, identity, regexp_extract(identity, '^[a-z]+://([^/?#]*)', 1) net, regexp_extract(identity, '^[a-z]+://[^/?#]*([^?#]*)', 1) pat FROM (SELECT page_id, variant, {U.SQL_IDENTITY} AS identity FROM ({U.sql_parts(_SQL_VARIANTS)})))"


@query("output_paths", f"SELECT page_id, variant, {', '.join(f'{U.sql_output_path(x)} AS {x}_path' for x in U.LAYOUTS)} FROM (SELECT *, {U.SQL_SEGMENTS} FROM {_SQL_IDENTITIES})")
def output_paths(spark, sf_dir):
    v = variants(spark, sf_dir).withColumn("identity", U.identity(F.col("url")))
    return v.select("page_id", "variant", *[U.output_path(F.col("identity"), x).alias(f"{x}_path") for x in U.LAYOUTS])


_SEGMENTS = Rows("value string, expected string", [("a b", "a_b"), ("%2e%2e", "_"), ("..", "_"), ("a%2Fb", "a_b"), ("été-1.html", "été-1.html"), ("", "_"), ("a+b", "a_b"), (" x. ", "x"), ("100%", "100_"), ("50%%20a%41", "50__aA"), ("日本", "日本"), ("a:b*c", "a_b_c")])


@query("safe_segments", f"SELECT value, expected AS segment FROM {_SEGMENTS.sql()}")
def safe_segments(spark, sf_dir):
    return _SEGMENTS.df(spark).select("value", U.safe_segment(F.col("value")).alias("segment"))


@query("srcset", "SELECT page_id, url || ' 1x, ' || url || '?b 200w, ' || url || '/c' AS serialized, CAST(3 AS BIGINT) AS n FROM pages")
def srcset(spark, sf_dir):
    url = F.col("url")
    value = F.concat(F.lit("  "), url, F.lit(" 1x,  "), url, F.lit("?b   200w ,, "), url, F.lit("/c "))
    parsed = table(spark, sf_dir, "pages").select("page_id", U.parse_srcset(value).alias("c"))
    return parsed.select("page_id", U.format_srcset(F.col("c")).alias("serialized"), F.size("c").cast("bigint").alias("n"))


# ---- pages -----------------------------------------------------------------------------------------------------------

_TITLE = "(?s)<title>(.*?)</title>"
_SQL_TITLE = f"nullif(trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '{_TITLE}', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g')), '')"
_SQL_LANG = "nullif(regexp_extract(html, '<html[^>]* lang=\"([^\"]*)\"', 1), '')"


def page_title():
    t = F.regexp_extract("html", _TITLE, 1)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return X.collapse(t)


def page_language():
    return F.nullif(F.regexp_extract("html", r'<html[^>]* lang="([^"]*)"', 1), F.lit(""))


_HREF = r'<a href="([^"]*)"'
_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"


@query("page_catalog", f"""SELECT page_id, identity, net AS host, {U.sql_output_path()} AS output_path, title, language, n_links FROM (
  SELECT *, {U.SQL_SEGMENTS} FROM (SELECT *, regexp_extract(identity, '^[a-z]+://([^/?#]*)', 1) net, regexp_extract(identity, '^[a-z]+://[^/?#]*([^?#]*)', 1) pat FROM (
  SELECT page_id, {U.SQL_IDENTITY} AS identity, {_SQL_TITLE} AS title, {_SQL_LANG} AS language,
    CAST(len(list_distinct(regexp_extract_all(html, '{_HREF}', 1))) AS BIGINT) AS n_links FROM ({U.sql_parts('pages')}))))""")
def page_catalog(spark, sf_dir):
    """The flagship: native expressions alone."""
    p = table(spark, sf_dir, "pages").withColumn("identity", U.identity(F.col("url")))
    links = F.size(F.array_distinct(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)))).cast("bigint")
    return p.select(
        "page_id", "identity", U.split_url(F.col("identity"))["netloc"].alias("host"), U.output_path(F.col("identity")).alias("output_path"),
        page_title().alias("title"), page_language().alias("language"), links.alias("n_links"),
    )


@query("html_links", f"""SELECT page_id, link FROM (SELECT page_id, unnest(list_distinct([{_ORIGIN} || replace(h, '&amp;', '&') FOR h IN regexp_extract_all(html, '{_HREF}', 1)])) link FROM pages)""")
def html_links(spark, sf_dir):
    return N.links(wide(table(spark, sf_dir, "pages"))).select("page_id", "link")


@query("page_metadata", f"SELECT page_id, {_SQL_TITLE} AS title, CAST(NULL AS VARCHAR) AS author, CAST(NULL AS VARCHAR) AS date, url AS canonical_url, CAST(NULL AS VARCHAR) AS description, {_SQL_LANG} AS language FROM pages")
def page_metadata(spark, sf_dir):
    return N.metadata(wide(table(spark, sf_dir, "pages")))


_ESC = "'\"' || replace(replace({0}, '\\', '\\\\'), '\"', '\\\"') || '\"'"


@query("front_matter", f"""SELECT page_id, '---' || chr(10) || concat_ws(chr(10), 'title: ' || {_ESC.format('title')}, 'canonical_url: ' || {_ESC.format('url')}, 'language: ' || {_ESC.format('language')}) || chr(10) || '---' || chr(10) || chr(10) AS front_matter
FROM (SELECT page_id, url, {_SQL_TITLE} AS title, {_SQL_LANG} AS language FROM pages)""")
def front_matter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.front_matter(title=page_title(), canonical_url=F.col("url"), language=page_language()).alias("front_matter"))


def _pages_by(want, mode="full", selector=None):
    def run(spark, sf_dir):
        page = P.page_udf(mode, selector, want)
        return wide(table(spark, sf_dir, "pages")).select("page_id", page("html", "url").alias("p"))

    return run


@query("page_markdown")
def page_markdown(spark, sf_dir):
    return _pages_by(("markdown",))(spark, sf_dir).select("page_id", "p.markdown", "p.error")


@query("main_markdown")
def main_markdown(spark, sf_dir):
    return _pages_by(("markdown",), "main")(spark, sf_dir).select("page_id", "p.markdown", "p.error")


_NAV = r"(?s)<nav><ul><li>.*?</li><li><a href=\"(/[^\"]*)\">(.*?)</a>"


@query("selected_html", f"""SELECT page_id, '<main><a href="' || {_ORIGIN} || regexp_extract(html, '{_NAV}', 1) || '">' || regexp_extract(html, '{_NAV}', 2) || '</a>' || regexp_extract(html, '(?s)<article>(<h1>.*?</h1>)', 1) || '</main>' AS selected_html,
  CAST(NULL AS VARCHAR) AS error FROM pages""")
def selected_html(spark, sf_dir):
    return N.selected_html(wide(table(spark, sf_dir, "pages")), "article > h1, nav li:nth-child(2) a[href^='http']")


#: Selectors by child, descendant, sibling, attribute and place; in SQL, what each finds in the pages' own layout.
_SELECTED = {
    "nav > ul > li": "regexp_extract_all(nav, '<li>')", "nav a": "regexp_extract_all(nav, '<a href=')", "li + li": "regexp_extract_all(nav, '<li>')[2:]", "nav ~ article > h1": "regexp_extract_all(html, '<article><h1>')",
    "li:nth-child(odd) > a[href^='/t']": "list_filter(regexp_extract_all(nav, '<li><a href=\"([^\"]*)\"', 1), lambda x, i: i % 2 = 1 AND starts_with(x, '/t'))",
}


@query("selected_nodes", "WITH p AS (SELECT page_id, html, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages) " + " UNION ALL ".join(f"SELECT page_id, '{k.replace(chr(39), chr(39) * 2)}' AS selector, CAST(len({v}) AS BIGINT) AS n FROM p WHERE len({v}) > 0" for k, v in _SELECTED.items()))
def selected_nodes(spark, sf_dir):
    nodes = stored(N.node_table(wide(table(spark, sf_dir, "pages"))), "nodes")
    out = None
    for selector in _SELECTED:
        n = N.select(nodes, selector).groupBy("page_id").agg(F.count("*").alias("n")).select("page_id", F.lit(selector).alias("selector"), "n")
        out = n if out is None else out.unionByName(n)
    return out


_FOLDER = r"regexp_extract(url, '^([a-z]+://[^/?#]*[^?#]*/)', 1)"


@query("page_assets", f"""SELECT page_id, pos, [{_ORIGIN} || '/i.png', {_FOLDER} || 'a.png', {_FOLDER} || 'b.png', {_FOLDER} || 'bg.jpg'][pos + 1] AS asset FROM pages, (SELECT unnest(range(0, 4))::INT pos)""")
def page_assets(spark, sf_dir):
    p = wide(table(spark, sf_dir, "pages")).withColumn("html", F.concat(F.lit('<img src="/i.png" srcset="a.png 1x, b.png 2x"><p style="background-image: url(bg.jpg)">'), "html"))
    page = P.page_udf(want=("assets",))
    return p.select("page_id", page("html", "url").alias("p")).select("page_id", F.posexplode("p.assets").alias("pos", "asset"))


@query("tab_markdown")
def tab_markdown(spark, sf_dir):
    return wide(table(spark, sf_dir, "pages")).select("page_id", P.tab_markdown(F.col("html"), remove=("nav", "footer")).alias("markdown"))


@query("html_nodes", r"""SELECT page_id, 'a' AS tag, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS n FROM pages UNION ALL SELECT page_id, 'article', CAST(len(regexp_extract_all(html, '<article>')) AS BIGINT) FROM pages""")
def html_nodes(spark, sf_dir):
    return N.node_table(wide(table(spark, sf_dir, "pages"))).where("tag IN ('a', 'article')").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


_RAW = Rows("html string, title string, expected string", [
    ("<p>x</p>", "T", "<!DOCTYPE html><html><head><title>T</title></head><body><p>x</p></body></html>"), ("   ", "T", None),
    ("<html><body>" + "y" * 100 + "</body></html>", "T", "<html><body>" + "y" * 100 + "</body></html>"),
    ("z" * 120, None, "<!DOCTYPE html><html><head><title></title></head><body>" + "z" * 120 + "</body></html>")])


@query("normalize_extracted", f"SELECT html, expected AS normalized FROM {_RAW.sql()}")
def normalize_extracted(spark, sf_dir):
    return _RAW.df(spark).select("html", X.normalize_extracted(F.col("html"), F.col("title")).alias("normalized"))


# ---- texts -----------------------------------------------------------------------------------------------------------

_BROKEN = "## Part[](#part)\n\n\n\n<pre><code>x</code></pre>\n"


@query("format_markdown", r"""SELECT doc_id, md5(regexp_replace(replace(replace(regexp_replace('## Part[](#part)' || repeat(chr(10), 4) || '<pre><code>x</code></pre>' || chr(10) || text, '(#{1,6} )([^\[]+)\[\]\((#[^\)]+)\)', '\1[\2](\3)', 'g'), '<pre><code>', '```' || chr(10)), '</code></pre>', chr(10) || '```'), '\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents WHERE text IS NOT NULL""")
def format_markdown(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.md5(X.format_markdown(F.concat(F.lit(_BROKEN), "text"))).alias("digest"))


@query("nth_occurrence", """SELECT doc_id, CAST(CASE WHEN len(p) > 3 THEN len(array_to_string(p[1:3], 'th')) ELSE -1 END AS INT) AS at FROM (SELECT doc_id, string_split(text, 'th') p FROM documents WHERE text IS NOT NULL)""")
def nth_occurrence(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", X.nth_occurrence(F.col("text"), F.lit("th"), 3).alias("at"))


@query("slugs", r"SELECT doc_id, substr(regexp_replace(regexp_replace(lower(text), '[^A-Za-z0-9_\s]', '', 'g'), '\s+', '-', 'g'), 1, 50) AS slug FROM documents")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.slug(F.col("text")).alias("slug"))


_SECRETS = "Authorization: Basic abc\nCookie: a=b; c=d\nx Bearer abc.def-1\n{'x-api-key': 'v', 'cookie': 'q'}\npassword=hunter2 token: t1\nhttps://u:p@h.org/x?api_key=1&b=2&sig=3#state=4\n"


def _sql_passes(value: str) -> str:
    for _, pattern, new in X.PASSES:
        new = new.replace("$", "\\")
        value = f"regexp_replace({value}, {_literal(pattern)}, {_literal(new)}, 'g')"
    return value


@query("redact_passes", f"SELECT doc_id, md5({_sql_passes(_literal(_SECRETS) + ' || coalesce(text, chr(32))')}) AS digest FROM documents")
def redact_passes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(X.redact_passes(F.concat(F.lit(_SECRETS), F.coalesce("text", F.lit(" "))))).alias("digest"))


_SQL_TEXT = "(SELECT doc_id, " + _literal(_SECRETS) + " || coalesce(text, chr(32)) AS t FROM documents)"


@query("redact_text", f"SELECT doc_id, md5({_sql_passes('r')}) AS digest FROM (SELECT doc_id, {X.sql_redact_addresses('t')} AS r FROM {_SQL_TEXT})")
def redact_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(X.redact(F.concat(F.lit(_SECRETS), F.coalesce("text", F.lit(" "))))).alias("digest"))


_KEYS = Rows("key string, sensitive boolean", [("X-Api-Key", True), ("color", False), ("Set-Cookie", True), ("my.secret", True), ("stateful", False), ("db password", True), ("monkey", False), ("", False), ("__token__", True)])


@query("sensitive_keys", f"SELECT key, sensitive FROM {_KEYS.sql()}")
def sensitive_keys(spark, sf_dir):
    return _KEYS.df(spark).select("key", X.sensitive_key(F.col("key")).alias("sensitive"))


_PARAMS = Rows("query string, expected string", [("a=1&token=2;b=3", "a=1&token=[REDACTED];b=3"), ("", ""), ("api%5Fkey=x", "api%5Fkey=[REDACTED]"), ("token&code=", "token&code=[REDACTED]"), ("my+secret=1&&", "my+secret=[REDACTED]&&")])


@query("redact_parameters", f"SELECT query, expected AS redacted FROM {_PARAMS.sql()}")
def redact_parameters(spark, sf_dir):
    return _PARAMS.df(spark).select("query", X.redact_parameters(F.col("query")).alias("redacted"))


_LINK = "'see https://me:pw@h.org/x?n=' || event_id || '&token=' || event_type || ' Bearer abc'"


@query("redact_mapping", f"SELECT event_id, CAST('[REDACTED]' AS VARCHAR) AS token, event_type AS kind, {_sql_passes('r')} AS link FROM (SELECT *, {X.sql_redact_addresses('t')} AS r FROM (SELECT *, {_LINK} AS t FROM events))")
def redact_mapping(spark, sf_dir):
    link = F.concat(F.lit("see https://me:pw@h.org/x?n="), F.col("event_id").cast("string"), F.lit("&token="), F.col("event_type"), F.lit(" Bearer abc"))
    m = F.create_map(F.lit("access-token"), F.col("props"), F.lit("kind"), F.col("event_type"), F.lit("link"), link)
    return table(spark, sf_dir, "events").select("event_id", X.redact_mapping(m).alias("m")).select("event_id", *[F.col("m")[k].alias(n) for k, n in (("access-token", "token"), ("kind", "kind"), ("link", "link"))])


_DATES = Rows("header string, epoch bigint, wait bigint", [
    ("Sun, 06 Nov 1994 08:49:37 GMT", 784111777, 11), ("Sunday, 06-Nov-94 08:49:37 GMT", 784111777, 11), ("Sun Nov  6 08:49:37 1994", 784111777, 11),
    ("7", None, 7), ("-3", None, 0), ("soon", None, None), ("Sun, 06 Nov 1994 08:49:00 GMT", 784111740, 0)])


@query("http_dates", f"SELECT header, epoch, wait FROM {_DATES.sql()}")
def http_dates(spark, sf_dir):
    h = F.col("header")
    return _DATES.df(spark).select("header", X.parse_http_date(h).alias("epoch"), X.retry_after(h, F.lit(784111766)).alias("wait"))


@query("http_date_format", "SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS header FROM events")
def http_date_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.format_http_date(F.floor(policy.micros() / 1_000_000)).alias("header"))


@query("content_types", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/' || event_type WHEN 2 THEN event_type ELSE '' END AS media_type,
  CASE event_id % 4 WHEN 0 THEN event_type WHEN 2 THEN user_id::VARCHAR END AS charset FROM events""")
def content_types(spark, sf_dir):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    header = F.element_at(F.array(F.concat(F.lit("text/html; charset="), kind), F.upper(F.concat(F.lit("Text/"), kind)), F.concat(kind, F.lit('; q=1; Charset="'), user, F.lit('"')), F.lit("")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", X.content_type(F.create_map(F.lit("content-TYPE"), header)).alias("t")).select("event_id", "t.*")


_MD = "See [a](https://e.org/a_(b)), ![i](https://e.org/i.png) and <https://e.org/x>.\n```\n[c](https://e.org/c)\n```\n<a href=\"https://e.org/h\">h</a>\nhttps://e.org/line\n"


@query("markdown_links")
def markdown_links(spark, sf_dir):
    d = wide(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.explode(P.md_links(F.concat(F.lit(_MD), F.coalesce("text", F.lit(""))))).alias("l")).select("doc_id", "l.*")


@query("markdown_urls", f"SELECT doc_id, pos, url FROM documents, (VALUES (0, 'https://e.org/a_(b)'), (1, 'https://e.org/i.png'), (2, 'https://e.org/x'), (3, 'https://e.org/c'), (4, 'https://e.org/h'), (5, 'https://e.org/line')) v(pos, url)")
def markdown_urls(spark, sf_dir):
    d = wide(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.posexplode(P.md_urls(F.concat(F.lit(_MD), F.coalesce("text", F.lit(""))))).alias("pos", "url"))


_REFERENCES = ("g", "./g", "g/", "/g", "//h.org", "//h.org/../x", "?y", "g?y", "#s", "g#s", "g?y#s", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../../g", "/./g", "/../g", "g.", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g//h", "g?y/./x", "http://x.org/a/../b", "mailto:a@b.c")


@query("url_join", f"""WITH r AS (SELECT unnest([{', '.join(f"'{x}'" for x in _REFERENCES)}]) AS ref),
p AS (SELECT page_id, url, ref, regexp_extract(url, '^([a-z]+):', 1) AS s, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS n, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS b, regexp_extract(url, '[?]([^#]*)', 1) AS q,
  regexp_extract(ref, '^(//)?([^/?#]*)', 2) AS rn, regexp_extract(ref, '^[^?#]*') AS rp, regexp_extract(ref, '[?#].*$') AS rest FROM pages, r),
m AS (SELECT *, CASE WHEN rp LIKE '/%' THEN rp ELSE regexp_replace(CASE WHEN b = '' THEN '/' ELSE b END, '[^/]*$', '') || rp END AS path FROM p),
g AS (SELECT *, string_split(CASE WHEN rp LIKE '/%' THEN path ELSE regexp_replace(path, '(.)/+', '\\1/', 'g') END, '/')[2:] AS segs FROM m),
f AS (SELECT *, list_reduce(list_concat([''], segs), lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN x = '.' THEN a ELSE a || '/' || x END) || CASE WHEN segs[-1] IN ('.', '..') THEN '/' ELSE '' END AS folded FROM g)
SELECT page_id, ref, CASE WHEN ref SIMILAR TO '[a-z]+:.*' THEN ref WHEN ref LIKE '//%' THEN s || ':' || ref
  WHEN rp = '' THEN s || '://' || n || b || CASE WHEN rest LIKE '?%' THEN rest WHEN q <> '' THEN '?' || q || rest ELSE rest END
  ELSE s || '://' || n || CASE WHEN folded = '' THEN '/' ELSE folded END || rest END AS joined FROM f""")
def url_join(spark, sf_dir):
    """References of every shape against every page's address."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array(*map(F.lit, _REFERENCES))).alias("ref"))
    return p.select("page_id", "ref", U.url_join(F.col("url"), F.col("ref")).alias("joined"))


# ---- archives --------------------------------------------------------------------------------------------------------


def fetched(spark, sf_dir: str) -> DataFrame:
    """Every page twice: as it is, and asked for with another fragment."""
    p = table(spark, sf_dir, "pages")
    first = p.select((F.col("page_id") * 2).alias("ordinal"), F.col("url").alias("requested_url"), F.col("url").alias("final_url"))
    again = p.select((F.col("page_id") * 2 + 1).alias("ordinal"), F.concat("url", F.lit("?again=1")).alias("requested_url"), F.concat("url", F.lit("#again")).alias("final_url"))
    return first.unionByName(again)


_SQL_FETCHED = "(SELECT page_id * 2 AS ordinal, url AS requested, url FROM pages UNION ALL SELECT page_id * 2 + 1, url || '?again=1', url || '#again' FROM pages)"
_SQL_ARCHIVED = f"""(SELECT *, {U.sql_output_path()} AS output_path FROM (SELECT *, {U.SQL_SEGMENTS} FROM (
  SELECT ordinal, identity, regexp_extract(identity, '^[a-z]+://([^/?#]*)', 1) net, regexp_extract(identity, '^[a-z]+://[^/?#]*([^?#]*)', 1) pat, row_number() OVER (PARTITION BY identity ORDER BY ordinal) > 1 AS reused
  FROM (SELECT ordinal, {U.SQL_IDENTITY} AS identity FROM ({U.sql_parts(_SQL_FETCHED)})))))"""


@query("archive_once", f"SELECT ordinal, identity, reused, output_path FROM {_SQL_ARCHIVED}")
def archive_once(spark, sf_dir):
    return archive.archive_once(fetched(spark, sf_dir)).select("ordinal", "identity", "reused", "output_path")


_SQL_RUNS = """(SELECT page_id AS ordinal, url AS requested, url AS final FROM pages UNION ALL SELECT 1000000 + page_id, url || '?again=1', url || '#again' FROM pages
  UNION ALL SELECT 2000000 + page_id, CASE WHEN page_id % 5 = 0 THEN url ELSE url || '?third=1' END, CASE WHEN page_id % 5 = 0 THEN url || '?own=1' ELSE url || '?again=1' END FROM pages)"""


@query("incremental_archive", f"""WITH RECURSIVE f AS MATERIALIZED (SELECT * FROM {_SQL_RUNS}),
i AS MATERIALIZED (SELECT url, {U.SQL_IDENTITY} AS identity FROM ({U.sql_parts('(SELECT requested AS url FROM f UNION SELECT final FROM f)')})),
p AS MATERIALIZED (SELECT identity, {U.sql_output_path()} AS path FROM (SELECT *, {U.SQL_SEGMENTS} FROM (
  SELECT identity, regexp_extract(identity, '^[a-z]+://([^/?#]*)', 1) net, regexp_extract(identity, '^[a-z]+://[^/?#]*([^?#]*)', 1) pat FROM (SELECT DISTINCT identity FROM i)))),
c AS MATERIALIZED (SELECT ordinal, x.identity AS final, y.identity AS alias FROM f JOIN i x ON x.url = f.final JOIN i y ON y.url = f.requested),
w AS MATERIALIZED (SELECT claimed, arg_min(target, t) AS target, min(t) AS t FROM (SELECT final AS claimed, final AS target, ordinal * 2 AS t FROM c UNION ALL SELECT alias, final, ordinal * 2 + 1 FROM c) GROUP BY claimed),
r AS (SELECT claimed, target, t % 2 AS k FROM w UNION ALL SELECT r.claimed, w.target, w.t % 2 FROM r JOIN w ON w.claimed = r.target WHERE r.k = 1),
m AS MATERIALIZED (SELECT claimed, path FROM r JOIN p ON p.identity = r.target WHERE k = 0)
SELECT ordinal, final AS identity, a.path AS output_path, w.t <> ordinal * 2 AS reused, CASE WHEN b.path <> a.path THEN b.path END AS conflict
FROM c JOIN m a ON a.claimed = c.final JOIN m b ON b.claimed = c.alias JOIN w ON w.claimed = c.final""")
def incremental_archive(spark, sf_dir):
    """Three runs on one manifest: pages as they are; asked for in another way; found at what the second run has asked for, or asked for at another page's."""
    p = table(spark, sf_dir, "pages")
    own = F.col("page_id") % 5 == 0
    add = lambda c, mark: F.concat(c, F.lit(mark))
    url = F.col("url")
    runs = [
        p.select(F.col("page_id").alias("ordinal"), url.alias("requested_url"), url.alias("final_url")),
        p.select((F.col("page_id") + 1_000_000).alias("ordinal"), add(url, "?again=1").alias("requested_url"), add(url, "#again").alias("final_url")),
        p.select((F.col("page_id") + 2_000_000).alias("ordinal"), F.when(own, url).otherwise(add(url, "?third=1")).alias("requested_url"), F.when(own, add(url, "?own=1")).otherwise(add(url, "?again=1")).alias("final_url")),
    ]
    folder = shared_folder(spark, "manifest")
    out = None
    for run in runs:
        made = manifest.Manifest(spark, folder, buckets=8).archive(run)
        rows = made.pages.join(made.conflicts.select("ordinal", F.col("output_path").alias("conflict")), "ordinal", "left").select("ordinal", "identity", "output_path", "reused", "conflict")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("batch_urls", f"SELECT identity, min(ordinal) AS ordinal FROM (SELECT ordinal, {U.SQL_IDENTITY} AS identity FROM ({U.sql_parts(_SQL_FETCHED)})) GROUP BY identity UNION ALL SELECT 'https://xn--bcher-kva.example/x', 7")
def batch_urls(spark, sf_dir):
    rows = fetched(spark, sf_dir).select("ordinal", F.col("final_url").alias("url"))
    more = spark.createDataFrame([(7, "https://bücher.example/x#part"), (8, "https://xn--bcher-kva.example:443/x")], "ordinal bigint, url string")
    return archive.batch_urls([rows, more]).select("identity", "ordinal")


@query("alias_conflicts", f"SELECT identity, CAST(2 AS BIGINT) AS paths FROM (SELECT DISTINCT {U.SQL_IDENTITY} AS identity FROM ({U.sql_parts('(SELECT url FROM pages WHERE page_id % 3 = 0)')}))")
def alias_conflicts(spark, sf_dir):
    """Pages of two archives with different layouts, one of which has a third of them."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ordinal"), F.col("url").alias("requested_url"), F.col("url").alias("final_url"))
    parts = archive.archive_once(p), archive.archive_once(p.where("ordinal % 3 = 0"), "flatten_all")
    return archive.conflicts(archive.aliases(parts[0].where("NOT reused")).union(archive.aliases(parts[1].where("NOT reused"))))


@query("resolve_aliases", f"SELECT a.ordinal, b.output_path FROM {_SQL_ARCHIVED} a JOIN (SELECT DISTINCT identity, output_path FROM {_SQL_ARCHIVED}) b USING (identity)")
def resolve_aliases(spark, sf_dir):
    rows = archive.archive_once(fetched(spark, sf_dir))
    names = archive.aliases(rows.where("NOT reused"))
    return archive.resolve(rows.select("ordinal", F.col("final_url").alias("url")), names).select("ordinal", "output_path")


_RELATIVE = """array_to_string(list_concat(['..' FOR k IN range(len(ss) - same)], ts[same + 1:]), '/')"""
_FRAGMENT = "CASE WHEN contains({0}, '#') THEN regexp_extract({0}, '#.*$') ELSE '' END"


@query("rewrite_links", f"""WITH a AS (SELECT * FROM {_SQL_ARCHIVED}), n AS (SELECT count(*) n FROM pages),
p AS (SELECT page_id, url, a.output_path FROM pages JOIN a ON a.ordinal = page_id * 2 WHERE NOT a.reused),
q AS (SELECT p.page_id AS doc, p.output_path AS source, p.url AS own, o.url AS next, b.output_path AS target FROM p, n JOIN pages o ON o.page_id = (p.page_id + 1) % n.n JOIN a b ON b.ordinal = o.page_id * 2),
r AS (SELECT *, string_split(target, '/') ts, string_split(source, '/')[:-2] ss FROM q),
s AS (SELECT *, len([k FOR k IN range(1, least(len(ss), len(ts) - 1) + 1) IF ss[1:k] = ts[1:k]]) same FROM r)
SELECT doc, CAST(3 AS INT) AS rewritten, '[self](' || regexp_extract(source, '[^/]*$') || '#x) [other](https://nowhere.example/) ![image](' || next || ') [again](' || regexp_extract(source, '[^/]*$') || {_FRAGMENT.format('own')}
  || ') [next](' || {_RELATIVE} || {_FRAGMENT.format('next')} || ')' AS markdown FROM s""")
def rewrite_links(spark, sf_dir):
    """Every page links to itself in two ways, to the page after it, and elsewhere; images stay."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    rows = archive.archive_once(fetched(spark, sf_dir)).where("NOT reused")
    n = p.agg(F.count("*").alias("n"))
    after = p.crossJoin(F.broadcast(n)).select(F.pmod(F.col("page_id") - 1, F.col("n")).alias("doc"), F.col("url").alias("next"))
    pages = rows.where("ordinal % 2 = 0").select((F.col("ordinal") / 2).cast("bigint").alias("doc"), F.col("final_url").alias("own"), "output_path").join(after, "doc")
    body = F.concat(
        F.lit("[self]("), F.regexp_replace("own", "#.*$", ""), F.lit("#x) [other](https://nowhere.example/) ![image]("), "next", F.lit(") [again]("), "own", F.lit(") [next]("), "next", F.lit(")")
    )
    return archive.rewrite(pages.select("doc", "output_path", body.alias("markdown")), archive.aliases(rows)).select("doc", "rewritten", "markdown")


@query("batch_report", "SELECT count(*) AS total, count(*) FILTER (page_id % 7 <> 0) AS processed, count(*) FILTER (page_id % 7 = 0) AS failed, count(*) FILTER (page_id % 7 = 0) = 0 AS success FROM pages")
def batch_report(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("url", F.when(F.col("page_id") % 7 == 0, "HTTP 500").alias("error"))
    return archive.batch_report(p)


@query("newest_per_user", "SELECT user_id, event_id, k FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) k FROM events) WHERE k <= 5")
def newest_per_user(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("k")).where("k <= 5")


@query("merge_retries", "SELECT event_type AS identity, max(user_id) AS attempts FROM events GROUP BY event_type")
def merge_retries(spark, sf_dir):
    return state.merge_retries(table(spark, sf_dir, "events").select(F.col("event_type").alias("identity"), F.col("user_id").alias("attempts")))


# ---- policies --------------------------------------------------------------------------------------------------------


@query("window_counts", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS n_window FROM events")
def window_counts(spark, sf_dir):
    return policy.window_counts(table(spark, sf_dir, "events"), "event_type").select("event_id", "n_window")


@query("adaptive_delay", """SELECT event_id, round(a, 9) AS avg_time, round(CASE WHEN a > 2 THEN least(1.5 * a, 60) ELSE 0 END, 9) AS delay FROM
  (SELECT event_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) a FROM events)""")
def adaptive_delay(spark, sf_dir):
    rows = policy.adaptive_delay(table(spark, sf_dir, "events"), "user_id")
    return rows.select("event_id", F.round("avg_time", 9).alias("avg_time"), F.round("delay", 9).alias("delay"))


@query("request_stats", "SELECT event_type, count(*) AS total_requests, count(*) FILTER (value >= 50) AS successful_requests, count(*) FILTER (value < 50) AS failed_requests FROM events GROUP BY event_type")
def request_stats(spark, sf_dir):
    return policy.key_stats(table(spark, sf_dir, "events"), "event_type", F.col("value") < 50).drop("last_request")


_FAILED = "value < 50"
_TRY = policy.Limits(failures=3, recovery=3600.0, tests=2)


@query("circuit_breaker", f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, coalesce({_FAILED}, false) bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) k FROM events),
r AS (SELECT user_id, 0::BIGINT k, NULL::BIGINT event_id, true allowed, 'CLOSED' state, 0::BIGINT failures, 0.0::DOUBLE last, 0 tests FROM e WHERE k = 1
 UNION ALL SELECT user_id, k, event_id, ok,
  CASE WHEN NOT ok THEN s WHEN bad THEN CASE WHEN s = 'HALF_OPEN' OR failures + 1 >= 3 THEN 'OPEN' ELSE s END WHEN s = 'HALF_OPEN' AND n + 1 >= 2 THEN 'CLOSED' ELSE s END,
  CASE WHEN NOT ok THEN failures WHEN bad THEN failures + 1 WHEN s = 'HALF_OPEN' AND n + 1 >= 2 THEN 0 WHEN s = 'CLOSED' THEN greatest(failures - 1, 0) ELSE failures END,
  CASE WHEN ok AND bad THEN t ELSE last END, CASE WHEN ok AND NOT bad AND s = 'HALF_OPEN' THEN n + 1 ELSE n END
 FROM (SELECT *, s = 'CLOSED' OR woke OR (s = 'HALF_OPEN' AND n < 2) ok FROM (SELECT *, CASE WHEN woke THEN 'HALF_OPEN' ELSE state END s, CASE WHEN woke THEN 0 ELSE tests END n FROM (
  SELECT r.user_id, e.k, e.event_id, r.state, r.failures, r.last, r.tests, e.t, e.bad, r.state = 'OPEN' AND e.t - r.last >= 3600 woke FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))))
SELECT user_id, event_id, allowed, state, failures FROM r WHERE k > 0""")
def circuit_breaker(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("failed", F.coalesce(F.expr(_FAILED), F.lit(False)))
    return policy.breaker_states(e, "user_id", _TRY)


_SLOW = policy.Limits(requests_per_minute=3, window=3600.0)


@query("admissions", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) k FROM events),
r AS (SELECT user_id, 0::BIGINT k, NULL::BIGINT event_id, true admitted, []::DOUBLE[] held FROM e WHERE k = 1
 UNION ALL SELECT user_id, k, event_id, len(l) < 3, CASE WHEN len(l) < 3 THEN list_append(l, t) ELSE l END
 FROM (SELECT r.user_id, e.k, e.event_id, e.t, list_filter(r.held, lambda x: x >= e.t - 3600) l FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
SELECT user_id, event_id, admitted FROM r WHERE k > 0""")
def admissions(spark, sf_dir):
    return policy.admissions(table(spark, sf_dir, "events"), "user_id", _SLOW).drop("wait")


@query("schedule", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, CASE WHEN event_type = 'error' THEN 7.0 ELSE 1.0 END AS gap, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) k FROM events),
r AS (SELECT user_id, 0::BIGINT k, NULL::BIGINT event_id, 0.0::DOUBLE begins, 0.0::DOUBLE waited, 0.0::DOUBLE ready FROM e WHERE k = 1
 UNION ALL SELECT r.user_id, e.k, e.event_id, greatest(e.t, r.ready), greatest(e.t, r.ready) - e.t, greatest(e.t, r.ready) + e.gap FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, begins AS start, waited FROM r WHERE k > 0""")
def schedule(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("retry_after", F.when(F.col("event_type") == "error", 7.0))
    return policy.schedule(e, "user_id")


# ---- crawls ----------------------------------------------------------------------------------------------------------


def graph(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Seeds and edges over page ids: each page links to two others."""
    p = table(spark, sf_dir, "pages").select("page_id")
    n = p.agg(F.count("*").alias("n"))
    edges = p.crossJoin(F.broadcast(n)).select(F.col("page_id").alias("src"), F.posexplode(F.array((F.col("page_id") * 2 + 1) % F.col("n"), (F.col("page_id") * 3 + 2) % F.col("n"))).alias("pos", "dst"))
    return p.where("page_id = 0").select(F.col("page_id").alias("node"), F.lit(0).alias("ordinal")), edges


_SQL_EDGES = "(SELECT page_id src, unnest([(page_id * 2 + 1) % n, (page_id * 3 + 2) % n]) dst FROM pages, (SELECT count(*) n FROM pages))"


@query("crawl_depths", f"""WITH RECURSIVE r AS (SELECT CAST(0 AS BIGINT) node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN {_SQL_EDGES} ON src = node WHERE depth < 4) SELECT node, CAST(min(depth) AS INT) AS depth FROM r GROUP BY node""")
def crawl_depths(spark, sf_dir):
    return crawl.traverse(*graph(spark, sf_dir), max_depth=4).select("node", "depth")


_CHILDREN = "[(queue[1].n * 2 + 1) % c, (queue[1].n * 3 + 2) % c]"


@query("crawl_budget", f"""WITH RECURSIVE c AS (SELECT count(*) c FROM pages),
r AS (SELECT 0::BIGINT AS rank, NULL::BIGINT AS node, NULL::INT AS depth, [{{'n': 0::BIGINT, 'd': 0}}] AS queue, [0::BIGINT] AS seen FROM c WHERE c > 0
 UNION ALL SELECT rank + 1, queue[1].n, queue[1].d, list_concat(queue[2:], [{{'n': x, 'd': queue[1].d + 1}} FOR x IN new]), list_concat(seen, new)
 FROM (SELECT r.*, CASE WHEN queue[1].d < 6 THEN [x FOR x, i IN {_CHILDREN} IF NOT list_contains(seen, x) AND list_position({_CHILDREN}, x) = i] ELSE [] END AS new FROM r, c WHERE len(queue) > 0 AND rank < 20))
SELECT node, depth, rank FROM r WHERE rank > 0""")
def crawl_budget(spark, sf_dir):
    return crawl.traverse(*graph(spark, sf_dir), max_depth=6, max_pages=20)


_KINDS = "CASE WHEN n % 11 = 3 THEN 'blocked' WHEN n % 5 = 4 AND tries < least(n % 4, 2) THEN 'retry' WHEN n % 7 = 6 OR (n % 5 = 4 AND n % 4 = 3) THEN 'failed' ELSE 'processed' END"


@query("crawl", f"""WITH RECURSIVE c AS (SELECT count(*) c FROM pages),
r AS (SELECT 0::BIGINT AS rank, NULL::BIGINT AS n, NULL::INT AS depth, NULL::INT AS tries, NULL::VARCHAR AS outcome, [{{'n': 0::BIGINT, 'd': 0, 't': 0}}] AS queue, [0::BIGINT] AS seen FROM c WHERE c > 0
 UNION ALL SELECT rank + 1, n, depth, tries, kind, list_concat(queue[2:], CASE WHEN kind = 'retry' THEN [{{'n': n, 'd': depth, 't': tries + 1}}] ELSE [{{'n': x, 'd': depth + 1, 't': 0}} FOR x IN new] END), list_concat(seen, new)
 FROM (SELECT *, CASE WHEN kind = 'processed' AND depth < 5 THEN [x FOR x, i IN kids IF NOT list_contains(seen, x) AND list_position(kids, x) = i AND x % 11 <> 3 AND x % 13 <> 12] ELSE []::BIGINT[] END AS new
 FROM (SELECT *, {_KINDS} AS kind FROM (SELECT rank, queue[1].n AS n, queue[1].d AS depth, queue[1].t AS tries, queue, seen, {_CHILDREN} AS kids FROM r, c WHERE len(queue) > 0 AND rank < 60))))
SELECT rank, n AS page_id, depth, tries AS retries, outcome FROM r WHERE rank > 0""")
def crawled(spark, sf_dir):
    """Every page links to two others; some answer 429 first, some fail, some are out of scope or blocked."""
    _, edges = graph(spark, sf_dir)
    site = lambda n: F.concat(F.when(n % 13 == 12, "https://other.org/").otherwise("https://e.org/"), n.cast("string"))
    n = F.col("page_id")
    p = table(spark, sf_dir, "pages").select("page_id", site(n).alias("url"))
    late, bad = n % 5 == 4, n % 7 == 6
    status = F.when(late & (F.col("attempt") <= n % 4), 429).when(bad, 404).otherwise(200)
    fetches = p.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(4)))).select("url", "attempt", status.alias("status"), F.col("url").alias("final_url"), F.lit(None).cast("array<string>").alias("hops"))
    links = edges.select(site(F.col("src")).alias("url"), "pos", site(F.col("dst")).alias("target"))
    robots_rules = p.select("url", (n % 11 != 3).alias("allowed"))
    seeds = spark.createDataFrame([("https://e.org/0", 0, 0, 0)], "url string, depth int, retries int, ordinal int")
    run = crawl.crawl(seeds, fetches, links, "https://e.org/0", "host-only", 5, 60, robots_rules)
    return run.attempts.select("rank", F.regexp_extract("url", "[0-9]+$", 0).cast("bigint").alias("page_id"), "depth", "retries", "outcome")


_LED = "CASE WHEN n % 8 = 5 THEN 'https://e.org/' || (n + 1) WHEN n % 9 = 7 THEN 'https://other.org/' || n WHEN n % 10 = 6 THEN 'https://e.org/private/' || n ELSE 'https://e.org/' || n END"
_LED_KIND = f"CASE WHEN n % 11 = 3 THEN 'blocked' WHEN n > 0 AND led LIKE 'https://other%' OR led LIKE '%/private/%' OR (n % 8 = 5 AND (n + 1) % 11 = 3) THEN 'failed' WHEN n % 5 = 4 AND tries < least(n % 4, 2) THEN 'retry' WHEN n % 5 = 4 AND n % 4 = 3 THEN 'failed' ELSE 'processed' END"


@query("crawl_resumed", f"""WITH RECURSIVE c AS (SELECT count(*) c FROM pages),
r AS (SELECT 0::BIGINT AS rank, NULL::BIGINT AS n, NULL::INT AS depth, NULL::INT AS tries, NULL::VARCHAR AS outcome, NULL::VARCHAR AS final_url, [{{'n': 0::BIGINT, 'd': 0, 't': 0}}] AS queue, [0::BIGINT] AS seen FROM c WHERE c > 0
 UNION ALL SELECT rank + 1, n, depth, tries, kind, led, list_concat(queue[2:], CASE WHEN kind = 'retry' THEN [{{'n': n, 'd': depth, 't': tries + 1}}] ELSE [{{'n': x, 'd': depth + 1, 't': 0}} FOR x IN new] END), list_concat(seen, new)
 FROM (SELECT *, CASE WHEN kind = 'processed' AND depth < 8 THEN [x FOR x, i IN kids IF NOT list_contains(seen, x) AND list_position(kids, x) = i AND x % 11 <> 3] ELSE []::BIGINT[] END AS new
 FROM (SELECT *, {_LED_KIND} AS kind FROM (SELECT *, {_LED} AS led FROM (SELECT rank, queue[1].n AS n, queue[1].d AS depth, queue[1].t AS tries, queue, seen, {_CHILDREN} AS kids FROM r, c WHERE len(queue) > 0 AND rank < 60)))))
SELECT rank, n AS page_id, depth, tries AS retries, outcome, final_url FROM r WHERE rank > 0""")
def crawl_resumed(spark, sf_dir):
    """A crawl that is stopped after every other round and goes on from its log, with budgets of 10, 25 and 60 pages. Pages redirect: to their neighbours, out of
    the scope, and to where robots rules forbid."""
    _, edges = graph(spark, sf_dir)
    site = lambda n: F.concat(F.lit("https://e.org/"), n.cast("string"))
    n = F.col("page_id")
    p = table(spark, sf_dir, "pages").select("page_id", site(n).alias("url"))
    led = F.when(n % 8 == 5, site(n + 1)).when(n % 9 == 7, F.concat(F.lit("https://other.org/"), n.cast("string"))).when(n % 10 == 6, F.concat(F.lit("https://e.org/private/"), n.cast("string"))).otherwise(F.col("url"))
    late = n % 5 == 4
    fetches = p.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(4)))).select(
        "url", "attempt", F.when(late & (F.col("attempt") <= n % 4), 429).otherwise(200).alias("status"), led.alias("final_url"), F.when(n % 2 == 0, F.array(led)).alias("hops")
    )
    links = edges.select(site(F.col("src")).alias("url"), "pos", site(F.col("dst")).alias("target"))
    rules = p.select("url", (n % 11 != 3).alias("allowed")).unionByName(p.select(F.concat(F.lit("https://e.org/private/"), n.cast("string")).alias("url"), F.lit(False).alias("allowed")))
    # the last page's neighbour has no row of its own
    rules = rules.unionByName(p.where((n + 1) % 11 == 3).select(site(n + 1).alias("url"), F.lit(False).alias("allowed")))
    seeds = spark.createDataFrame([("https://e.org/0", 0, 0, 0)], "url string, depth int, retries int, ordinal int")
    log = shared_folder(spark, "crawl-log")
    for budget in (10, 25, 60):
        crawl.crawl(seeds, fetches, links, "https://e.org/0", "host-only", 8, budget, rules, log=log, rounds=2)
    run = crawl.crawl(seeds, fetches, links, "https://e.org/0", "host-only", 8, 60, rules, log=log)
    return run.attempts.select("rank", F.regexp_extract("url", "[0-9]+$", 0).cast("bigint").alias("page_id"), "depth", "retries", "outcome", "final_url")


_HOPS = Rows("url string, seq int, target string", [("https://e.org/a", 1, "https://e.org/b"), ("https://e.org/a", 2, "https://e.org/c"), ("https://e.org/d", 1, "http://e.org/d"), ("https://e.org/f", 1, "https://x.org/")])


@query("redirect_scope", "SELECT * FROM (VALUES ('https://e.org/a', true, 'https://e.org/c'), ('https://e.org/d', false, 'http://e.org/d'), ('https://e.org/f', false, 'https://x.org/')) v(url, allowed, final_url)")
def redirect_scope(spark, sf_dir):
    return crawl.redirects_allowed(_HOPS.df(spark), F.lit("https://e.org/"), "host-only")


#: Each page adds a rule to its origin's file: a prefix of its path, as long as its number says; every eleventh one fits all.
_SQL_RULES = """(SELECT page_id, origin, CASE WHEN page_id % 3 = 1 THEN 'allow' ELSE 'disallow' END AS kind, CASE WHEN page_id % 11 = 10 THEN '*' ELSE substring(path, 1, (page_id % 12 + 2)::INT) END AS rule
  FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages))"""
_SQL_CHECKED = "(SELECT url FROM pages UNION SELECT url || '/more' FROM pages WHERE url NOT LIKE '%#%' UNION SELECT regexp_extract(url, '^[a-z]+://[^/?#]*') || '/en/1' FROM pages)"


@query("robots_decisions", f"""SELECT u.url, coalesce(arg_min(r.kind = 'allow', r.page_id), true) AS allowed FROM (SELECT url, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS path FROM {_SQL_CHECKED}) u
LEFT JOIN {_SQL_RULES} r ON r.origin = u.origin AND (r.rule = '*' OR starts_with(u.path, r.rule)) GROUP BY u.url""")
def robots_decisions(spark, sf_dir):
    """Every page's address and others of its origin, against files in which each page of the origin has a rule."""
    p = table(spark, sf_dir, "pages")
    origin, path = F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    rule = F.when(F.col("page_id") % 11 == 10, "*").otherwise(F.substring(path, F.lit(1), (F.col("page_id") % 12 + 2).cast("int")))
    line = F.concat(F.when(F.col("page_id") % 3 == 1, "Allow: ").otherwise("Disallow: "), rule)
    lines = p.select(origin.alias("origin"), "page_id", line.alias("line")).groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("page_id", "line"))).alias("l"))
    content = F.concat(F.lit("User-agent: other\nDisallow: /\n\nUser-agent: mill\n"), F.array_join("l.line", "\n"))
    more = p.where("url NOT LIKE '%#%'").select(F.concat("url", F.lit("/more")).alias("url"))
    asked = p.select("url").union(more).union(p.select(F.concat(origin, F.lit("/en/1")).alias("url"))).distinct()
    return robots.decisions(asked, lines.select("origin", F.lit(200).alias("status"), content.alias("content")), "mill/1.0")


@query("crawl_delays", """SELECT origin, coalesce(arg_min(page_id % 30 + 0.5, page_id) FILTER (WHERE page_id % 4 <> 0), min(page_id) % 10)::DOUBLE AS delay
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin FROM pages) GROUP BY origin""")
def crawl_delays(spark, sf_dir):
    """Files with a delay for everyone and one of each page of the origin for the product, a fourth of them no numbers."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0).alias("origin"))
    line = F.concat(F.lit("Crawl-delay: "), F.when(F.col("page_id") % 4 == 0, "x").otherwise(F.concat((F.col("page_id") % 30).cast("string"), F.lit(".5"))))
    files = p.groupBy("origin").agg(F.min("page_id").alias("least"), F.sort_array(F.collect_list(F.struct("page_id", line.alias("line")))).alias("l"))
    content = F.concat(F.lit("User-agent: *\nCrawl-delay: "), (F.col("least") % 10).cast("string"), F.lit("\n\nUser-agent: not-mill\nCrawl-delay: 99\n\nUser-agent: Mill\n"), F.array_join("l.line", "\n"))
    return robots.crawl_delays(files.select("origin", F.lit(200).alias("status"), content.alias("content")), "mill/1.0")


@query("robots_fetches", f"""SELECT origin, min(origin || '/robots.txt') AS robots_url FROM (SELECT page_id, sch || '://' || lower(net) AS origin FROM ({U.sql_parts(_SQL_VARIANTS)}) WHERE variant IN ('plain', 'port')) u
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT page_id, sch || '://' || lower(net) AS origin FROM ({U.sql_parts(_SQL_VARIANTS)}) WHERE variant = 'plain') f WHERE f.origin = u.origin AND f.page_id > 100) GROUP BY origin""")
def robots_fetches(spark, sf_dir):
    """The robots files to fetch for all urls, where each page's own was fetched page_id seconds after a time 3,700 seconds ago."""
    v = variants(spark, sf_dir).where(F.col("variant").isin("plain", "port"))
    fetched = v.where("variant = 'plain'").select(U.origin_key(F.col("url")).alias("origin"), F.col("page_id").alias("fetched_at"))
    return robots.to_fetch(v, fetched, F.lit(3700))


# ---- cookies, images, state, evaluation ------------------------------------------------------------------------------

_SQL_COOKIES = """(SELECT page_id AS pos, 'p' || page_id AS name, CASE WHEN page_id % 50 = 1 THEN regexp_extract(host, '[^.]*[.][^.]*$') ELSE host END AS d, page_id % 50 <> 1 AS host_only,
  CASE WHEN page_id % 2 = 0 THEN '/' ELSE '/en' END AS path, CASE WHEN page_id % 7 = 0 THEN page_id END AS expires, page_id % 5 = 0 AS secure FROM (SELECT page_id, regexp_extract(url, '://([^/?#:]*)', 1) AS host FROM pages))"""


@query("cookie_headers", f"""SELECT url, string_agg(name || '=' || pos, '; ' ORDER BY length(c.path) DESC, pos) AS header
FROM (SELECT DISTINCT url, regexp_extract(url, '://([^/?#:]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p FROM pages) r
JOIN {_SQL_COOKIES} c ON (r.host = d OR (NOT host_only AND ends_with(r.host, '.' || d))) AND (NOT secure OR url LIKE 'https:%') AND (expires IS NULL OR expires > 100)
  AND (c.path = '/' OR p = c.path OR starts_with(p, c.path || '/')) GROUP BY url""")
def cookie_headers(spark, sf_dir):
    """Each page's cookie, some for its whole domain, against every page's address."""
    p = table(spark, sf_dir, "pages")
    n, host = F.col("page_id"), F.regexp_extract("url", "://([^/?#:]*)", 1)
    wide_ = n % 50 == 1
    jar = p.select(
        n.alias("pos"), F.concat(F.lit("p"), n.cast("string")).alias("name"), n.cast("string").alias("value"), F.when(wide_, F.concat(F.lit("."), F.regexp_extract(host, "[^.]*[.][^.]*$", 0))).otherwise(host).alias("domain"),
        F.when(n % 2 == 0, "/").otherwise("/en").alias("path"), F.when(n % 7 == 0, n).alias("expires"), (n % 5 == 0).alias("secure"), (~wide_).alias("host_only"),
    )
    return cookies.cookie_header(p.select("url").distinct(), jar, F.lit(100))


_EXPORTED = '[{"name":"a","value":"1","domain":".e.org","expirationDate":1.9,"secure":true},{"name":"b","value":"2"},{"value":"3"}]'


@query("cookie_export", "SELECT * FROM (VALUES ('a', '.e.org', '/', 1::BIGINT, true, false), ('b', 'e.org', '/', NULL, false, true), ('name', 'e.org', '/', NULL, false, true), ('value', 'e.org', '/', NULL, false, true)) v(name, domain, path, expires, secure, host_only)")
def cookie_export(spark, sf_dir):
    return cookies.from_export(spark.createDataFrame([(1, _EXPORTED), (2, '{"name": "s", "value": 9}')], "export_id int, json string"), "e.org").select("name", "domain", "path", "expires", "secure", "host_only")


_STORES = Rows("name string, value string, domain string, expiry bigint, expires_utc bigint", [("a", "1", ".e.org", 100, 11644473700000000), ("b", "2", "e.org", 0, 0), ("c", "", "e.org", 99, 11644473701000000), ("d", "4", "e.org", 101, 11644473701000000)])


@query("browser_cookies", "SELECT * FROM (VALUES ('chrome', 'b', NULL::BIGINT, true), ('chrome', 'd', 101, true), ('firefox', 'a', 100, false), ('firefox', 'b', NULL, true), ('firefox', 'd', 101, true)) v(store, name, expires, host_only)")
def browser_cookies(spark, sf_dir):
    s = _STORES.df(spark)
    part = lambda d, n: d.select(F.lit(n).alias("store"), "name", "expires", "host_only")
    return part(cookies.firefox_rows(s, F.lit(100)), "firefox").unionByName(part(cookies.chrome_rows(s, F.lit(100)), "chrome"))


_IMAGES = Rows("hex string, declared string, mime string", [("FFD8FFE0", "image/jpeg", "image/jpeg"), ("89504E470D0A1A0A00", "image/png; q=1", "image/png"), ("474946383961", "image/jpeg", None), ("524946460000000057454250", "", "image/webp"),
    ("424D00", "image/bmp", "image/bmp"), ("00000100", "image/vnd.microsoft.icon", "image/x-icon"), ("000000006674797061766966", "image/avif", "image/avif"), ("3C737667", "image/svg+xml", None)])


@query("image_types", f"SELECT hex, mime FROM {_IMAGES.sql()}")
def image_types(spark, sf_dir):
    return _IMAGES.df(spark).select("hex", images.verified_mime(F.unhex("hex"), F.col("declared")).alias("mime"))


@query("image_budget", """WITH RECURSIVE e AS (SELECT user_id AS doc, event_id::INT AS pos, CAST(floor(coalesce(value, 0)) AS BIGINT) AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) k FROM events),
r AS (SELECT doc, 0::BIGINT k, NULL::INT pos, false AS accepted, 0::BIGINT total FROM e WHERE k = 1
 UNION ALL SELECT e.doc, e.k, e.pos, e.size <= 60 AND r.total + e.size <= 200, r.total + CASE WHEN e.size <= 60 AND r.total + e.size <= 200 THEN e.size ELSE 0 END FROM r JOIN e ON e.doc = r.doc AND e.k = r.k + 1)
SELECT doc, pos, accepted FROM r WHERE k > 0""")
def image_budget(spark, sf_dir):
    """Events as images: of a user's page, as large as their value."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").cast("int").alias("pos"), F.floor(F.coalesce("value", F.lit(0.0))).alias("size"))
    return images.within_budget(rows, "doc", 60, 200).select("doc", "pos", "accepted")


_NAMES = Rows("doc int, pos int, url string, mime string, filename string", [(1, 0, "https://e.org/a b.png", "image/png", "a_b.png"), (1, 1, "https://e.org/x/a%20b.jpg", "image/png", "a_b_1.png"), (1, 2, "https://e.org/a_b.gif", "image/gif", "a_b.gif"), (1, 3, "https://e.org/a_b_1.png", "image/png", "a_b_1_1.png"), (1, 4, "https://e.org/y/a_b.png", "image/png", "a_b_2.png"), (2, 0, "https://e.org/a b.png", "image/png", "a_b.png")])


@query("image_names", f"SELECT doc, pos, filename FROM {_NAMES.sql()}")
def image_names(spark, sf_dir):
    return images.unique_names(_NAMES.df(spark).drop("filename"), "doc").select("doc", "pos", "filename")


_DNS = Rows("origin string, pos int, address string", [("https://a.org", 0, "93.184.216.34"), ("https://a.org", 1, "93.184.216.34"), ("https://b.org", 0, "10.0.0.1"), ("https://c.org", 0, "::ffff:127.0.0.1"), ("https://d.org", 0, "64:ff9b::a00:1"), ("https://e.org", 0, "2606:4700::1111")])


@query("safe_origins", "SELECT * FROM (VALUES ('https://a.org', true, 1), ('https://b.org', false, 1), ('https://c.org', false, 1), ('https://d.org', false, 1), ('https://e.org', true, 1)) v(origin, allowed, n)")
def safe_origins(spark, sf_dir):
    return images.safe_origins(_DNS.df(spark)).select("origin", "allowed", F.size("addresses").alias("n"))


_STATES = [('{"crawl_id":"a","progress":{"urls_visited":{"u":"f","v":"g"},"urls_failed":{"u":"e"}}}',), ('{"version":"1.1","crawl_id":"b","progress":{"attempted_count":4}}',), ('{"version":"99.0","crawl_id":"c"}',), ('{"crawl_id":"d","version":"1.1","progress":{"attempted_count":-1}}',)]


@query("state_migration", "SELECT * FROM (VALUES ('a', '1.1', 2::BIGINT, true), ('b', '1.1', 4, true), ('c', '1.1', 0, false), ('d', '1.1', -1, false)) v(crawl_id, version, attempted_count, valid)")
def state_migration(spark, sf_dir):
    rows = spark.createDataFrame(_STATES, "j string").select(F.from_json("j", state.SCHEMA).alias("s")).select("s.*")
    return state.migrate(rows).select("crawl_id", "version", "attempted_count", F.col("error").isNull().alias("valid"))


@query("evaluation")
def evaluation(spark, sf_dir):
    return evaluate.scores(evaluate.CORPUS.df(spark))


_CHAINS = Rows("url string, method string, seq int, status int, target string", [
    ("https://a.org/1", "POST", 1, 301, "https://a.org/2"), ("https://a.org/1", "POST", 2, 307, "https://b.org/"), ("https://a.org/2", "PUT", 1, 307, "https://b.org/"),
    ("https://a.org/3", "GET", 1, 302, "http://a.org/"), ("https://a.org/3", "GET", 2, 302, "https://a.org/"), ("https://a.org/4", "GET", 1, 301, "https://a.org:443/x")])


@query("redirect_chains", """SELECT * FROM (VALUES ('https://a.org/1', 1, 'GET', true, NULL), ('https://a.org/1', 2, 'GET', false, NULL), ('https://a.org/2', 1, 'PUT', false, 'a body must not cross origins'),
  ('https://a.org/3', 1, 'GET', false, 'https must not lead to http'), ('https://a.org/4', 1, 'GET', true, NULL)) v(url, seq, method_after, same_origin, error)""")
def redirect_chains(spark, sf_dir):
    return requests.redirect_chains(_CHAINS.df(spark)).drop("target")


@query("header_sets", "SELECT page_id, 'x/1 (Contact: me)' AS agent, 'own' AS accept, CAST(6 AS INT) AS n FROM pages")
def header_sets(spark, sf_dir):
    m = requests.header_set(requests.user_agent("x", "1", "me"), F.create_map(F.lit("Accept"), F.lit("own")))
    return table(spark, sf_dir, "pages").select("page_id", m.alias("m")).select("page_id", F.col("m")["User-Agent"].alias("agent"), F.col("m")["Accept"].alias("accept"), F.size("m").alias("n"))


@query("place_assets", "SELECT page_id, CAST(CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS INT) AS placed FROM pages")
def place_assets(spark, sf_dir):
    name = F.concat(F.lit("https://img.example/"), F.col("page_id").cast("string"), F.lit(".png"))
    p = wide(table(spark, sf_dir, "pages")).withColumn("html", F.concat(F.lit('<img src="'), name, F.lit('">'), "html"))
    acquired = table(spark, sf_dir, "pages").where("page_id % 2 = 0").select(name.alias("url"), F.concat(F.lit("images/"), F.col("page_id").cast("string"), F.lit(".png")).alias("path"))
    return requests.place_assets(p, acquired).select("page_id", "placed")


# ---- listings and progress -------------------------------------------------------------------------------------------

_SQL_DOC_PATH = "coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.html' ELSE '.txt' END"


@query("archive_tree", f"""WITH p AS (SELECT string_split({_SQL_DOC_PATH}, '/') s FROM documents WHERE doc_id IS NOT NULL)
SELECT DISTINCT array_to_string(s[:k], '/') AS path, k::INT AS level, repeat('  ', (k - 1)::INT) || CASE WHEN k < 3 THEN '{archive.FOLDER}' WHEN s[3] LIKE '%.md' THEN '{archive.NOTE}' WHEN s[3] LIKE '%.html' THEN '{archive.PAGE}' ELSE '{archive.OTHER}' END
  || ' ' || s[k] AS line FROM p, range(1, 4) r(k)""")
def archive_tree(spark, sf_dir):
    """An archive's listing, of paths made of every document's source, language and id."""
    end = F.element_at(F.array(*map(F.lit, (".md", ".html", ".txt"))), (F.col("doc_id") % 3 + 1).cast("int"))
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), end)
    return archive.tree(table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(path.alias("path")))


_SQL_RESULTS = "SELECT event_type AS crawl_id, event_id AS pos, 'u' || user_id AS url, value >= 20 AS success, CASE WHEN event_id % 7 <> 0 THEN 'f' || event_id END AS output_path, CASE WHEN event_id % 5 <> 0 THEN 'e' || event_id END AS error FROM events"


def _results(spark, sf_dir) -> DataFrame:
    """Every event as the result of a page: of a user's url, in the crawl of its type."""
    kept = lambda n, mark: F.when(F.col("event_id") % n != 0, F.concat(F.lit(mark), F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("crawl_id"), F.col("event_id").alias("pos"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"),
        (F.col("value") >= 20).alias("success"), kept(7, "f").alias("output_path"), kept(5, "e").alias("error"),
    )


@query("crawl_outcomes", f"""WITH r AS ({_SQL_RESULTS}) SELECT crawl_id, url, arg_max(output_path, pos) FILTER (WHERE success AND output_path IS NOT NULL) AS output_path,
  arg_max(error, pos) FILTER (WHERE NOT success AND error IS NOT NULL) AS error FROM r GROUP BY crawl_id, url HAVING output_path IS NOT NULL OR error IS NOT NULL""")
def crawl_outcomes(spark, sf_dir):
    """The results in two parts, the later ones on top of the state that the first 5,000 lead to."""
    rows = _results(spark, sf_dir)
    return state.outcomes(rows.where("pos >= 5000"), state.outcomes(rows.where("pos < 5000")))


@query("crawl_counters", f"WITH r AS ({_SQL_RESULTS}) SELECT crawl_id, count(*) AS urls_processed, count(*) FILTER (WHERE NOT success AND error IS NOT NULL) AS urls_failed FROM r GROUP BY crawl_id")
def crawl_counters(spark, sf_dir):
    rows = _results(spark, sf_dir)
    return state.counters(rows.where("pos % 2 = 1"), state.counters(rows.where("pos % 2 = 0")))
