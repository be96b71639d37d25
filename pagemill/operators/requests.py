"""Requests as rows: header sets, redirect chains, retries, and assets put in place of their addresses. No network."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from pagemill.functions.dom import parse
from pagemill.functions.pages import asset_urls, rewrite_assets
from pagemill.functions.urls import effective_port, split_url

MAX_HOPS, ATTEMPTS = 5, 3
#: What a request carries to another origin, and what no custom header may set.
SAFE_HEADERS = ("accept", "accept-encoding", "accept-language", "cache-control", "connection", "pragma", "user-agent", "content-type")
TRANSPORT_HEADERS = ("host", "content-length", "transfer-encoding", "connection", "proxy-authorization", "te", "trailer", "upgrade")


def user_agent(name: str, version: str, contact: str | None = None, info: str | None = None) -> str:
    notes = "; ".join(f"{k}: {v}" for k, v in (("Contact", contact), ("Info", info)) if v)
    return f"{name}/{version}" + (f" ({notes})" if notes else "")


def header_set(agent: str, custom: Column | None = None) -> Column:
    """The base headers as a map; custom ones win."""
    base = {"User-Agent": agent, "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8", "Accept-Encoding": "gzip, deflate", "Accept-Language": "en-US,en;q=0.9", "Connection": "keep-alive", "Cache-Control": "no-cache"}
    fixed = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])
    if custom is None:
        return fixed
    own = F.coalesce(custom, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(fixed, lambda k, v: ~F.array_contains(F.map_keys(own), k)), own)


def check_headers(headers: dict[str, str]) -> dict[str, str]:
    """Refuses names and values that could change a request's shape."""
    for name, value in headers.items():
        if not isinstance(value, str) or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name) or re.search(r"[\r\n]", value) or name.lower() in TRANSPORT_HEADERS:
            raise ValueError(f"not a header to set: {name!r}")
    return headers


def redirect_chains(hops: DataFrame) -> DataFrame:
    """url, method, seq, status, target -> the same with method_after, same_origin and error of every hop. 303, 302, and 301 of a POST, turn into
    GET; https never leads to http; a body never crosses origins; five hops at most. After an error the chain has ended."""
    order = W.partitionBy("url").orderBy("seq")
    source = F.coalesce(F.lag("target").over(order), F.col("url"))
    rows = hops.withColumn("from", source).withColumn("a", split_url(F.col("from"))).withColumn("b", split_url(F.col("target")))
    same = (F.col("a.scheme") == F.col("b.scheme")) & (F.col("a.host") == F.col("b.host")) & (effective_port(F.col("a")) == effective_port(F.col("b")))
    turns = F.col("status").isin(302, 303) | ((F.col("status") == 301) & (F.col("method") == "POST"))
    # a method that has become GET stays that
    ever = F.max((turns & (F.col("method") != "HEAD")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) == 1
    after = F.when(ever, "GET").otherwise(F.col("method"))
    error = (
        F.when(F.row_number().over(order) > MAX_HOPS, "too many redirects")
        .when(~F.col("b.scheme").isin("http", "https"), "not an HTTP(S) address")
        .when((F.col("a.scheme") == "https") & (F.col("b.scheme") == "http"), "https must not lead to http")
        .when(~same & ~after.isin("GET", "HEAD"), "a body must not cross origins")
    )
    rows = rows.withColumn("method_after", after).withColumn("same_origin", same).withColumn("error", error)
    failed = F.coalesce(F.max(F.col("error").isNotNull().cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_ended", failed).where("_ended = 0").select("url", "seq", "target", "method_after", "same_origin", "error")


def carried_headers(headers: Column, same_origin: Column) -> Column:
    return F.when(same_origin, headers).otherwise(F.map_filter(headers, lambda k, v: F.lower(k).isin(*SAFE_HEADERS)))


def retry_delay(attempt: Column, status: Column, network_error: Column) -> Column:
    """Seconds before the next attempt (1, then 2), null where there is none: after three, and for answers that another try does not change."""
    again = network_error | F.coalesce(status >= 500, F.lit(False))
    return F.when(again & (attempt < ATTEMPTS), F.pow(F.lit(2.0), attempt - 1))


@arrow_udf(T.ArrayType(T.StringType()))
def _assets(html: pa.Array, url: pa.Array) -> pa.Array:
    return pa.array([asset_urls(parse(h or ""), u or "") for h, u in zip(html.to_pylist(), url.to_pylist())], pa.list_(pa.string()))


@arrow_udf(T.StringType())
def _placed(html: pa.Array, url: pa.Array, local: pa.Array) -> pa.Array:
    out = []
    for h, u, m in zip(html.to_pylist(), url.to_pylist(), local.to_pylist()):
        if h is not None and m:
            root = parse(h)
            rewrite_assets(root, u or "", dict(m))
            h = root.html()
        out.append(h)
    return pa.array(out, pa.string())


def place_assets(pages: DataFrame, images: DataFrame) -> DataFrame:
    """page_id, url, html with the addresses of acquired images (url, path) made local; others stay. Each address is looked up once per
    page, and texts do not travel with the addresses."""
    wanted = pages.select("page_id", F.explode(_assets("html", "url")).alias("asset"))
    found = wanted.join(images.select(F.col("url").alias("asset"), "path"), "asset")
    local = found.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("asset", "path"))).alias("local"))
    joined = pages.join(local, "page_id", "left")
    return joined.select("page_id", "url", _placed("html", "url", "local").alias("html"), F.coalesce(F.size("local"), F.lit(0)).alias("placed"))
