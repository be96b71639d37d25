"""Archives: one page per identity, output paths, aliases, and links rewritten between archived pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from pagemill.functions.mdscan import splice
from pagemill.functions.pages import md_links
from pagemill.functions.urls import any_identity, output_path, relative_path, split_url


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; the order must be total for a repeatable result."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def union_inputs(parts: list[DataFrame], order: str = "ordinal") -> DataFrame:
    """All rows of the inputs; `source` has the place of the input a row is from, so that source and order give the whole order."""
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("source", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


#: The marks of a listing's entries.
FOLDER, NOTE, PAGE, OTHER = "\U0001f4c1", "\U0001f4dd", "\U0001f310", "\U0001f4c4"


def tree(paths: DataFrame, depth: int = 3) -> DataFrame:
    """path -> path, level, line of every folder and file down to `depth` levels, each once; ordered by path they read as a tree, folders
    above what they hold. A folder at the last level stands for what is below it."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    level = F.explode(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(depth)))).alias("level")
    cut = paths.select(parts.alias("parts")).where(F.size("parts") > 0).select("parts", level)
    entry = cut.select(F.array_join(F.slice("parts", F.lit(1), F.col("level")), "/").alias("path"), F.element_at("parts", F.col("level")).alias("name"), "level", (F.size("parts") > F.col("level")).alias("folder"))
    entry = entry.groupBy("path", "name", "level").agg(F.max("folder").alias("folder"))
    mark = F.when(F.col("folder"), FOLDER).when(F.col("name").endswith(".md"), NOTE).when(F.col("name").endswith(".html"), PAGE).otherwise(OTHER)
    return entry.select("path", "level", F.concat(F.repeat(F.lit("  "), F.col("level") - 1), mark, F.lit(" "), F.col("name")).alias("line"))


def batch_urls(parts: list[DataFrame]) -> DataFrame:
    """ordinal, url -> each identity once, where it came first. An invalid url fails the batch."""
    rows = union_inputs(parts).withColumn("identity", any_identity(F.col("url")))
    rows = rows.withColumn("identity", F.when(F.col("identity").isNull(), F.raise_error(F.concat(F.lit("not an HTTP(S) url: "), "url"))).otherwise(F.col("identity")))
    first = F.min_by(F.struct(*rows.columns), F.struct("source", "ordinal"))
    return rows.groupBy("identity").agg(first.alias("first")).select("first.*")


def archive_once(fetched: DataFrame, layout: str = "default") -> DataFrame:
    """ordinal, requested_url, final_url -> which of them are converted, and the path each is found at. Only the first page of a
    final identity is; the others are aliases of its file. Errors: invalid urls. Ordinals are unique. A popular identity is no sorted
    partition, and invalid urls meet nothing: the least ordinals are pre-aggregated and joined."""
    f = fetched.withColumn("identity", any_identity(F.col("final_url"))).withColumn("alias", any_identity(F.col("requested_url")))
    least = f.where("identity IS NOT NULL").groupBy("identity").agg(F.min("ordinal").alias("_least"))
    f = f.join(least, "identity", "left").select(*f.columns, (F.col("ordinal") > F.col("_least")).alias("reused"))
    return f.withColumn("output_path", output_path(F.col("identity"), layout)).withColumn(
        "error", F.when(F.col("identity").isNull() | F.col("alias").isNull(), "not an HTTP(S) url without credentials")
    )


def aliases(archived: DataFrame) -> DataFrame:
    """identity, output_path: every identity that a page was asked for or found under. Page-authored canonicals are no aliases."""
    good = archived.where("error IS NULL")
    return good.select(F.explode(F.array_distinct(F.array("identity", "alias"))).alias("identity"), "output_path").distinct()


def conflicts(alias_rows: DataFrame) -> DataFrame:
    """Identities that would name two files."""
    return alias_rows.groupBy("identity").agg(F.countDistinct("output_path").alias("paths")).where("paths > 1")


def resolve(urls: DataFrame, alias_rows: DataFrame, url: str = "url") -> DataFrame:
    """Adds output_path: null for urls that are invalid or not archived."""
    return urls.withColumn("identity", any_identity(F.col(url))).join(alias_rows, "identity", "left")


def link_targets(documents: DataFrame, alias_rows: DataFrame) -> DataFrame:
    """doc, start, end, target for every inline link to an archived page: with its query if that is archived, else without and the
    query kept. Links are few against the texts, so texts stay where they are."""
    links = documents.select("doc", "output_path", F.explode(md_links(F.col("markdown"))).alias("l")).select("doc", F.col("output_path").alias("source"), "l.*")
    s = split_url(F.col("destination"))
    links = links.withColumn("s", s).where(F.col("s.scheme").isin("http", "https"))
    links = links.withColumn("exact", any_identity(F.col("destination")))
    bare = F.regexp_replace(F.col("exact"), r"(?s)\?.*$", "")
    # with its query before without, in one join
    keys = F.array_distinct(F.array("exact", F.when(F.col("s.query") != "", bare).otherwise(F.col("exact"))))
    asked = links.select("*", F.posexplode(keys).alias("k", "identity")).join(alias_rows, "identity")
    found = asked.groupBy("doc", "start", "end").agg(F.min_by(F.struct("source", "s", "output_path", "k"), "k").alias("f")).select("doc", "start", "end", "f.source", "f.s", F.col("f.output_path").alias("path"), "f.k")
    target = F.concat(
        relative_path(F.col("path"), F.col("source")),
        F.when(F.col("k") == 1, F.concat(F.lit("?"), F.col("s.query"))).otherwise(""),
        F.when(F.col("s.fragment") != "", F.concat(F.lit("#"), F.col("s.fragment"))).otherwise(""),
    )
    return found.select("doc", "start", "end", target.alias("target"))


@arrow_udf(T.StringType())
def _splice(text: pa.Array, edits: pa.Array) -> pa.Array:
    return pa.array([t if t is None or not e else splice(t, [(x["start"], x["end"], x["target"]) for x in e]) for t, e in zip(text.to_pylist(), edits.to_pylist())], pa.string())


def rewrite(documents: DataFrame, alias_rows: DataFrame) -> DataFrame:
    """doc, output_path, markdown with links between archived pages made relative, and how many were."""
    edits = link_targets(documents, alias_rows).groupBy("doc").agg(F.collect_list(F.struct("start", "end", "target")).alias("edits"))
    joined = documents.join(edits, "doc", "left")
    return joined.select("doc", "output_path", _splice("markdown", "edits").alias("markdown"), F.coalesce(F.size("edits"), F.lit(0)).alias("rewritten"))


def batch_report(results: DataFrame) -> DataFrame:
    """url, output_path, error -> one row: totals and whether the batch succeeded."""
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("error").isNull()).alias("processed"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        (F.count_if(F.col("error").isNull()) > 0).alias("any"),
    ).select("total", "processed", "failed", (F.col("any") & (F.col("failed") == 0)).alias("success"))


def report_text(report: Column, files: Column) -> Column:
    """A batch's summary in Markdown, with its first ten files."""
    lines = F.array(
        F.lit("# Batch report"),
        F.concat(F.lit("- Total: "), report["total"].cast("string")),
        F.concat(F.lit("- Failed: "), report["failed"].cast("string")),
    )
    return F.concat_ws("\n", lines, F.transform(F.slice(files, 1, 10), lambda f: F.concat(F.lit("- "), f)))
