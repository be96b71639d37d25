"""Cookies as rows: which apply to a request, in what order, and how browsers' exports become rows. No store is opened or decrypted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.urls import normalize_hostname, split_url
from pagemill.session import stored

EXPORT = "array<struct<name:string,value:string,domain:string,path:string,expirationDate:double,secure:boolean,httpOnly:boolean,sameSite:string,hostOnly:boolean>>"
#: Seconds between 1601 and 1970.
CHROME_EPOCH = 11_644_473_600
#: Bytes of a result that a copy of a header becomes at most, and that a task writes on average.
PIECE = 128 << 20


def host_suffixes(host: Column) -> Column:
    """The host and its parents: a suffix test becomes an equi-join."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def domain_matches(host: Column, domain: Column, host_only: Column) -> Column:
    h, d = normalize_hostname(host), normalize_hostname(domain)
    return (h != "") & (d != "") & ((h == d) | (~host_only & h.endswith(F.concat(F.lit("."), d))))


def path_matches(path: Column, cookie: Column) -> Column:
    c = F.when(cookie.startswith("/"), cookie).otherwise("/")
    return (path == c) | (path.startswith(c) & (c.endswith("/") | (F.substr(path, F.length(c) + 1, F.lit(1)) == "/")))


def _kinds(requests: DataFrame, jar: DataFrame) -> DataFrame:
    """url, kind, https, host, met: each url once, with the places (d, at) of the jar that it is at. Urls of a kind, which names scheme, host and places, are sent the
    same cookies. A path meets the places that are its prefixes, of the lengths that a domain's paths have: not every path of the domain."""
    s, path = split_url(F.col("url")), F.col("path")
    asked = requests.select("url").distinct().select("url", s.alias("s")).select(
        "url", (F.col("s.scheme") == "https").alias("https"), normalize_hostname(F.col("s.host")).alias("host"), F.when(F.col("s.path") == "", "/").otherwise(F.col("s.path")).alias("path")
    )
    lengths = jar.groupBy("d").agg(F.collect_set(F.length("at")).alias("lengths"))
    near = asked.withColumn("d", F.explode(host_suffixes(F.col("host")))).join(lengths, "d")
    near = near.withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length(path)))).withColumn("at", F.substring(path, F.lit(1), F.col("n")))
    there = near.where(path_matches(path, F.col("at"))).join(jar.select("d", "at").distinct(), ["d", "at"], "left_semi")
    met = there.groupBy("url", "https", "host").agg(F.sort_array(F.collect_list(F.struct("d", "at"))).alias("met"))
    return met.withColumn("kind", F.to_json(F.struct("https", "host", "met")))


def cookie_header(requests: DataFrame, cookies: DataFrame, now: Column) -> DataFrame:
    """url, header: longer paths first, then the order of `pos`.

    A kind's header is made once, so what is joined, sorted and gathered grows with the cookies, and not with urls times cookies: only the result does, as each url has its
    whole header. Headers travel to pieces of their urls, and there are as many tasks as the result's bytes need: neither a popular host nor a writer that guesses how
    many rows it can hold makes one of them large.
    """
    at = F.when(F.col("path").startswith("/"), F.col("path")).otherwise("/")
    jar = cookies.where(F.col("expires").isNull() | (F.col("expires") > now)).withColumn("d", normalize_hostname(F.col("domain"))).withColumn("at", at).where("d <> ''")
    asked = stored(_kinds(requests, jar), "asked")
    kinds = asked.groupBy("kind").agg(*[F.first(c).alias(c) for c in ("https", "host", "met")], F.count("*").alias("urls"))
    fits = (~F.col("host_only") | (F.col("host") == F.col("d"))) & (~F.col("secure") | F.col("https"))
    rows = kinds.select("kind", "https", "host", F.explode("met").alias("m")).select("kind", "https", "host", "m.*").join(jar, ["d", "at"]).where(fits)
    sent = F.array_sort(F.collect_list(F.struct((-F.length("path")).alias("k"), F.col("pos"), F.concat_ws("=", "name", "value").alias("v"))))
    headers = rows.groupBy("kind").agg(F.array_join(F.transform(sent, lambda x: x["v"]), "; ").alias("header")).join(kinds.select("kind", "urls"), "kind")
    headers = stored(headers.withColumn("bytes", F.col("urls") * F.octet_length("header")), "headers")
    tasks = max(requests.sparkSession.sparkContext.defaultParallelism, (headers.agg(F.sum("bytes")).first()[0] or 0) // PIECE)
    piece = F.pmod(F.xxhash64("url"), F.floor(F.col("bytes") / PIECE) + 1)
    pieces = asked.join(headers.select("kind", "bytes"), "kind").groupBy("kind", piece.alias("piece")).agg(F.collect_list("url").alias("urls"))
    return pieces.join(headers.select("kind", "header"), "kind").repartition(tasks, "kind", "piece").select(F.explode("urls").alias("url"), "header")


def replace_domain(current: DataFrame, new: DataFrame, host: str) -> DataFrame:
    """The cookies after those of a host were replaced by others that apply to it."""
    hit = domain_matches(F.lit(host), F.col("domain"), F.col("host_only"))
    return current.where(~hit).unionByName(new.where(hit))


def from_export(exports: DataFrame, host: str | None = None) -> DataFrame:
    """json -> cookie rows: a list of cookies, of which those without name or value are left out, or an object of names and values, whose
    cookies are the host's alone and need one."""
    listed = F.ltrim("json").startswith("[")
    c = exports.where(listed).select("export_id", F.posexplode(F.from_json("json", EXPORT)).alias("pos", "c")).where("c.name IS NOT NULL AND c.value IS NOT NULL")
    domain = F.coalesce("c.domain", F.lit(host or ""))
    rows = c.select(
        "export_id", "pos", "c.name", "c.value", domain.alias("domain"), F.coalesce(F.nullif("c.path", F.lit("")), F.lit("/")).alias("path"),
        F.col("c.expirationDate").cast("bigint").alias("expires"), F.coalesce("c.secure", F.lit(False)).alias("secure"),
        F.coalesce("c.httpOnly", F.lit(False)).alias("http_only"), F.col("c.sameSite").alias("same_site"),
        F.coalesce("c.hostOnly", ~domain.startswith(".")).alias("host_only"),
    )
    if host is not None:
        rows = rows.where(domain_matches(F.lit(host), F.col("domain"), F.col("host_only")))
    scope = F.raise_error(F.lit("cookies without a domain need a target host")).cast("string") if host is None else F.lit(host)
    plain = exports.where(~listed).select("export_id", F.posexplode(F.from_json("json", "map<string,string>")).alias("pos", "name", "value")).select(
        "export_id", "pos", "name", "value", scope.alias("domain"), F.lit("/").alias("path"), F.lit(None).cast("bigint").alias("expires"), F.lit(False).alias("secure"),
        F.lit(False).alias("http_only"), F.lit(None).cast("string").alias("same_site"), F.lit(True).alias("host_only"),
    )
    return rows.unionByName(plain)


def firefox_rows(cookies: DataFrame, now: Column) -> DataFrame:
    """expiry seconds: 0 and null are session cookies; older than now are left out."""
    session = F.coalesce("expiry", F.lit(0)) == 0
    return cookies.where(session | (F.col("expiry") >= now)).withColumn("expires", F.when(~session, F.col("expiry"))).withColumn("host_only", ~F.col("domain").startswith("."))


def chrome_rows(cookies: DataFrame, now: Column) -> DataFrame:
    """expires_utc microseconds since 1601: 0 is a session cookie; now and older, and empty values, are left out."""
    expires = F.when(F.col("expires_utc") != 0, F.floor(F.col("expires_utc") / 1_000_000 - CHROME_EPOCH).cast("bigint"))
    rows = cookies.withColumn("expires", expires).where((F.col("expires").isNull() | (F.col("expires") > now)) & (F.col("value") != ""))
    return rows.withColumn("host_only", ~F.col("domain").startswith("."))
