"""robots.txt as tables: rules, decisions and delays. The file's order decides: the first rule that fits wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.urls import origin_key, robots_url, split_url


#: Seconds that a fetched robots file counts.
TTL = 3600


def contents(responses: DataFrame) -> DataFrame:
    """origin, status, body (status null: no answer) -> origin, status, content: a 2xx body, nothing but permission for 4xx, else null."""
    return responses.select("origin", "status", F.when(F.col("status").between(200, 299), F.coalesce("body", F.lit(""))).when(F.col("status").between(400, 499), F.lit("")).alias("content"))


def to_fetch(urls: DataFrame, fetched: DataFrame, now: Column, ttl: int = TTL) -> DataFrame:
    """origin, robots_url: once for each origin of the urls whose robots file was not fetched (origin, fetched_at in seconds) within `ttl`."""
    wanted = urls.select(origin_key(F.col("url")).alias("origin"), robots_url(F.col("url")).alias("robots_url")).where("origin IS NOT NULL")
    fresh = fetched.where(now - F.col("fetched_at") < ttl).select("origin").distinct()
    return wanted.join(fresh, "origin", "left_anti").groupBy("origin").agg(F.min("robots_url").alias("robots_url"))


def product_token(agent: str) -> str:
    return agent.split("/")[0].strip().lower()


def _quote(path: Column) -> Column:
    """A rule's path as it compares: percent-decoded and encoded again, without which equal paths would differ."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), path)


def directives(robots: DataFrame) -> DataFrame:
    """origin, line, field, value, grp: the lines of each file's groups. Agent lines that follow one another begin one group."""
    lines = robots.select("origin", F.posexplode(F.split(F.coalesce("content", F.lit("")), r"\r\n|\r|\n")).alias("line", "raw"))
    text = F.trim(F.regexp_replace("raw", r"#.*$", ""))
    lines = lines.withColumn("text", text).where(F.contains("text", F.lit(":")))
    lines = lines.select("origin", "line", F.lower(F.trim(F.regexp_extract("text", "^([^:]*):", 1))).alias("field"), F.trim(F.regexp_replace("text", "^[^:]*:", "")).alias("value"))
    order = W.partitionBy("origin").orderBy("line")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    return lines.withColumn("opens", opens).withColumn("grp", F.sum(F.col("opens").cast("int")).over(order)).drop("opens").where("grp > 0")


def _groups(rows: DataFrame, token: str) -> DataFrame:
    """origin, grp of the groups that name the product, or where none does, of those for everyone."""
    agents = rows.where("field = 'user-agent'").select("origin", "grp", F.lower("value").alias("agent")).where(F.col("agent").isin(token, "*"))
    own = agents.groupBy("origin").agg(F.max((F.col("agent") == token).cast("int")).alias("own"))
    return agents.join(own, "origin").where((F.col("agent") == token) == (F.col("own") == 1)).select("origin", "grp").distinct()


def decisions(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """url -> allowed. robots: origin, status, content. A 4xx file allows all; a missing one, or another failure, nothing."""
    token = product_token(agent)
    rows = directives(robots)
    groups = _groups(rows, token)
    rules = rows.where(F.col("field").isin("allow", "disallow")).join(groups, ["origin", "grp"])
    first = rules.groupBy("origin").agg(F.min("grp").alias("grp"))
    rules = rules.join(first, ["origin", "grp"])  # the first group that applies
    rules = rules.select("origin", "line", ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"), _quote(F.col("value")).alias("rule"))
    s = split_url(F.col("url"))
    path = F.concat(F.when(s["path"] == "", "/").otherwise(s["path"]), F.when(s["query"] != "", F.concat(F.lit("?"), s["query"])).otherwise(""))
    asked = urls.select("url").distinct().withColumn("origin", origin_key(F.col("url"))).withColumn("path", _quote(path))
    # a path meets the rules that are its prefixes, of the lengths that its origin's rules have: not every rule of the origin
    rules = rules.withColumn("prefix", F.when(F.col("rule") == "*", "").otherwise(F.col("rule")))
    rules = rules.groupBy("origin", "prefix").agg(F.min(F.struct("line", "allow")).alias("first"))
    lengths = rules.groupBy("origin").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    asked_at = asked.join(lengths, "origin").withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))))
    hit = asked_at.select("url", "origin", F.substring("path", F.lit(1), F.col("n")).alias("prefix")).join(rules, ["origin", "prefix"])
    hit = hit.groupBy("url").agg(F.min("first").alias("f")).select("url", F.col("f.allow").alias("allow"))
    known = asked.join(robots.select("origin", "status", F.col("content").isNotNull().alias("has")), "origin", "left").join(hit, "url", "left")
    refused = F.col("status").between(400, 499)
    return known.select("url", F.when(refused, True).when(F.coalesce("has", F.lit(False)), F.coalesce("allow", F.lit(True))).otherwise(False).alias("allowed"))


def crawl_delays(robots: DataFrame, agent: str) -> DataFrame:
    """origin -> delay in seconds: the first valid number of the product's groups, else of those for everyone; null without one."""
    token = product_token(agent)
    rows = directives(robots)
    names = rows.where("field = 'user-agent'").select("origin", "grp", F.lower("value").alias("agent"))
    values = rows.where("field = 'crawl-delay'").withColumn("delay", F.col("value").try_cast("double")).where("delay IS NOT NULL").select("origin", "grp", "line", "delay")
    by = names.join(values, ["origin", "grp"]).groupBy("origin", "agent").agg(F.min_by("delay", "line").alias("delay")).where(F.col("agent").isin(token, "*"))
    best = by.groupBy("origin").agg(F.max_by("delay", (F.col("agent") == token).cast("int")).alias("delay"))
    return robots.select("origin").join(best, "origin", "left")


def effective_delay(minimum: Column, robots_delay: Column) -> Column:
    return F.greatest(minimum, F.coalesce(robots_delay, F.lit(0.0)))
