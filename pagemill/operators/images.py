"""Images: format by content, size budgets, file names that do not collide, and addresses that may be asked at all."""

from __future__ import annotations

import ipaddress
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from pagemill.functions.urls import split_url

#: Image types and their extensions.
EXTENSIONS = {
    "image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/bmp": ".bmp", "image/x-icon": ".ico",
    "image/vnd.microsoft.icon": ".ico", "image/avif": ".avif",
}
EACH, TOTAL, NAME = 10 << 20, 50 << 20, 200


def detected_mime(content: Column) -> Column:
    """The type that the first bytes tell; null for others, SVG among them."""
    at = lambda a, n: F.hex(F.substring(content, a, n))
    return (
        F.when(at(1, 3) == "FFD8FF", "image/jpeg")
        .when(at(1, 8) == "89504E470D0A1A0A", "image/png")
        .when(at(1, 6).isin("474946383761", "474946383961"), "image/gif")
        .when((at(1, 4) == "52494646") & (at(9, 4) == "57454250"), "image/webp")
        .when(at(1, 2) == "424D", "image/bmp")
        .when(at(1, 4) == "00000100", "image/x-icon")
        .when((at(5, 4) == "66747970") & at(9, 4).isin("61766966", "61766973"), "image/avif")
    )


def extension(mime: Column) -> Column:
    return reduce(lambda c, kv: F.when(mime == kv[0], kv[1]).otherwise(c), EXTENSIONS.items(), F.lit(None).cast("string"))


def verified_mime(content: Column, declared: Column) -> Column:
    """The detected type if the declared one (without parameters; empty: none) is supported and has the same extension."""
    found = detected_mime(content)
    said = F.lower(F.trim(F.regexp_extract(F.coalesce(declared, F.lit("")), "^([^;]*)", 1)))
    return F.when((F.coalesce(declared, F.lit("")) == "") | F.coalesce(extension(said) == extension(found), F.lit(False)), found)


def within_budget(images: DataFrame, key: str, each: int = EACH, total: int = TOTAL) -> DataFrame:
    """Adds accepted: an image that is too large, or does not fit into what is left, is refused; a later smaller one may still fit.
    A document's images are folded in their order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "size")))
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<int>").alias("taken"))

    def step(acc, x):
        ok = (x["size"] <= each) & (acc["sum"] + x["size"] <= total)
        return F.struct((acc["sum"] + F.when(ok, x["size"]).otherwise(0)).alias("sum"), F.when(ok, F.concat(acc["taken"], F.array(x["pos"]))).otherwise(acc["taken"]).alias("taken"))

    folded = images.groupBy(key).agg(F.aggregate(rows, start, step, lambda a: a["taken"]).alias("taken"))
    return images.join(folded, key).withColumn("accepted", F.array_contains("taken", F.col("pos"))).drop("taken")


def file_stem(url: Column) -> Column:
    """A safe name from an image's url, or one made of its digest."""
    base = F.regexp_extract(F.coalesce(F.try_url_decode(F.regexp_replace(split_url(url)["path"], r"\+", "%2B")), split_url(url)["path"]), r"([^/]*)$", 1)
    stem = F.when(base.rlike(r"^\.[^.]*$"), base).otherwise(F.regexp_replace(base, r"^(.+)\.[^.]*$", "$1"))
    stem = F.when((stem == "") | stem.startswith("."), F.concat(F.lit("image_"), F.substring(F.sha2(url, 256), 1, 12))).otherwise(stem)
    clean = F.regexp_replace(F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", "_"), r"^[._]+|[._]+$", "")
    return F.when(clean == "", "image").otherwise(clean)


def unique_names(images: DataFrame, key: str) -> DataFrame:
    """Adds filename: a name that an earlier image of the folder has gets the first of _1, _2, ... that none has; at most NAME characters. A
    document's images are folded in the order of pos, which is unique in it."""
    ext = extension(F.col("mime"))
    stem = F.substr(file_stem(F.col("url")), F.lit(1), NAME - F.length(ext))
    rows = F.array_sort(F.collect_list(F.struct("pos", stem.alias("s"), ext.alias("e"))))
    kind = dict(images.dtypes)["pos"]
    start = F.array().cast(f"array<struct<pos:{kind},filename:string>>")

    def step(done: Column, x: Column) -> Column:
        # only names that begin alike can be in the way, and of as many candidates and one more one is free
        near = F.filter(F.transform(done, lambda d: d["filename"]), lambda n: n.startswith(F.substring(x["s"], 1, NAME // 2)))

        def named(k: Column) -> Column:
            tail = F.when(k > 0, F.concat(F.lit("_"), k.cast("string"))).otherwise("")
            return F.concat(F.substr(x["s"], F.lit(1), NAME - F.length(x["e"]) - F.length(tail)), tail, x["e"])

        free = F.filter(F.transform(F.sequence(F.lit(0), F.size(near)), named), lambda n: ~F.array_contains(near, n))
        return F.concat(done, F.array(F.struct(x["pos"].alias("pos"), F.get(free, F.lit(0)).alias("filename"))))

    names = images.groupBy(key).agg(F.aggregate(rows, start, step).alias("_names")).select(key, F.inline("_names"))
    return images.join(names, [key, "pos"])


def _public(address: str) -> bool:
    try:
        a = ipaddress.ip_address(address.split("%")[0])
    except ValueError:
        return False
    inner = None
    if a.version == 6:
        last = ipaddress.IPv4Address(a.packed[-4:])
        low = a in ipaddress.ip_network("64:ff9b::/96") or a in ipaddress.ip_network("::/96")
        inner = a.ipv4_mapped or a.sixtofour or (last if low else None)
    return a.is_global and (inner is None or inner.is_global)


@arrow_udf(T.BooleanType())
def public_address(address: pa.Array) -> pa.Array:
    """Whether an address, and an IPv4 address inside it, is global."""
    return pa.array([a is not None and _public(a) for a in address.to_pylist()], pa.bool_())


def safe_origins(dns: DataFrame) -> DataFrame:
    """origin, pos, address -> origin, allowed (all its addresses are public) and its distinct addresses in their order."""
    rows = dns.withColumn("ok", public_address("address"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "address"))), lambda x: x["address"])
    return rows.groupBy("origin").agg(F.bool_and("ok").alias("allowed"), F.array_distinct(ordered).alias("addresses"))
