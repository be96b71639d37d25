"""Crawls over tables of pages and links: level by level, in first-in first-out order, within scope, robots rules and a budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.urls import check_crawl_policy, identity, in_scope
from pagemill.operators.crawl_log import CrawlLog
from pagemill.session import shared_folder
from pagemill.session import stored as _stored

#: How often a page that answers 429 is asked for again, at the queue's end.
RETRIES = 2


def traverse(seeds: DataFrame, edges: DataFrame, max_depth: int = 3, max_pages: int | None = None) -> DataFrame:
    """node, depth and rank of every page that a crawl attempts. Seeds have node and ordinal; edges src, dst and pos.

    A level's order is that of the pages that found it, then of their links; a node belongs to the level that finds it first.
    With a budget only the first max_pages of the whole order are attempted, and only those are expanded.
    """
    check_crawl_policy(max_depth, max_pages or 1)
    level = _ranked(seeds.groupBy("node").agg(F.min("ordinal").alias("o")), ["o", "node"], 0)
    level = _stored(level.select("node", "rank", F.lit(0).alias("depth")), "level")
    seen, done = level, 0
    for depth in range(max_depth + 1):
        if max_pages is not None:
            level = level.where(F.col("rank") <= max_pages)
        count = level.count()
        done += count
        if not count or depth == max_depth or max_pages is not None and done >= max_pages:
            break
        found = (
            level.join(edges, F.col("node") == F.col("src"))
            .groupBy(F.col("dst").alias("node"))
            .agg(F.min(F.struct("rank", "pos")).alias("by"))
            .join(seen.select("node"), "node", "left_anti")
        )
        # a level's places, with the sort spread out: ranges first, then offsets of their sizes
        placed = _ranked(found, ["by.rank", "by.pos", "node"], done)
        level = _stored(placed.select("node", "rank", F.lit(depth + 1).alias("depth")), "level")
        seen = seen.unionByName(level)
    out = seen if max_pages is None else seen.where(F.col("rank") <= max_pages)
    return out.select("node", "depth", "rank")


def _ranked(df: DataFrame, order: list[str], after: int) -> DataFrame:
    """Adds rank, the place in a total order, without gathering the rows: rows are range-partitioned and partitions counted."""
    spread = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    spread = _stored(spread.withColumn("part", F.spark_partition_id()), "order")
    sizes = spread.groupBy("part").count()
    offset = sizes.withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    inside = F.row_number().over(W.partitionBy("part").orderBy(*order))
    return spread.withColumn("k", inside).join(F.broadcast(offset), "part").withColumn("rank", F.lit(after).cast("bigint") + F.col("before") + F.col("k")).drop("part", "k", "before")


def follow(links: DataFrame, start: str, rule: str, robots_allowed: Column | None = None) -> DataFrame:
    """Links in scope, then those that robots rules allow: the cheap test comes first."""
    kept = links.where(in_scope(F.col("url"), F.lit(start), rule))
    return kept if robots_allowed is None else kept.where(robots_allowed)


def redirects_allowed(hops: DataFrame, start: Column, rule: str) -> DataFrame:
    """url, seq, target -> url and whether all its hops stay in scope, at most five of them, none from https down to http."""
    previous = F.lag("target", 1).over(W.partitionBy("url").orderBy("seq"))
    from_ = F.coalesce(previous, F.col("url"))
    down = from_.rlike("(?i)^https:") & ~F.col("target").rlike("(?i)^https:")
    judged = hops.withColumn("ok", in_scope(F.col("target"), start, rule) & ~down)
    return judged.groupBy("url").agg((F.bool_and("ok") & (F.count("*") <= 5)).alias("allowed"), F.max_by("target", "seq").alias("final_url"))


def result(pages: DataFrame) -> DataFrame:
    """status of attempted pages (processed, failed, blocked) -> one row; blocked ones are neither."""
    return pages.agg(F.count_if(F.col("status") == "processed").alias("processed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("attempted")).select(
        "*",
        ((F.col("processed") > 0) & (F.col("failed") == 0)).alias("success"),
        F.when(F.col("processed") == 0, "no page was processed").when(F.col("failed") > 0, "some pages failed").otherwise("completed").alias("message"),
    )


@dataclass
class Crawl:
    """What a crawl did and what is left: attempts (rank, url, depth, retries, status, final_url, outcome) in their order, and the queue (url, depth,
    retries, place), from which another crawl goes on. They are read from the crawl's log and hold until another crawl goes on with it."""

    attempts: DataFrame
    queue: DataFrame
    scope: str

    def result(self) -> DataFrame:
        return result(self.attempts.drop("status").withColumnRenamed("outcome", "status"))


def _answers(fetches: DataFrame, robots: DataFrame | None) -> DataFrame:
    """url, answers: each attempt's status, final address, all addresses it was redirected to, and whether robots rules forbid one of them."""
    hops = F.concat(F.coalesce("hops", F.array().cast("array<string>")), F.array("final_url"))
    f = fetches.select("url", "attempt", "status", "final_url", F.array_distinct(F.filter(hops, lambda h: h.isNotNull() & (h != F.col("url")))).alias("targets"))
    if robots is None:
        f = f.withColumn("forbidden", F.lit(False))
    else:
        no = robots.where("NOT allowed").select(F.col("url").alias("target")).distinct()
        hit = f.select("url", "attempt", F.explode("targets").alias("target")).withColumn("target", F.coalesce(identity(F.col("target")), "target")).join(no, "target", "left_semi")
        f = f.join(hit.select("url", "attempt").distinct().withColumn("forbidden", F.lit(True)), ["url", "attempt"], "left").withColumn("forbidden", F.coalesce("forbidden", F.lit(False)))
    return f.groupBy("url").agg(F.sort_array(F.collect_list(F.struct("attempt", "status", "final_url", "targets", "forbidden"))).alias("answers"))


def crawl(
    seeds: DataFrame, fetches: DataFrame, links: DataFrame, start: str, rule: str = "domain-only", max_depth: int = 3, max_pages: int = 100,
    robots: DataFrame | None = None, done: DataFrame | None = None, attempted: int = 0, log: str | None = None, rounds: int | None = None,
) -> Crawl:
    """A crawl of known answers, in the exact order of a first-in first-out queue.

    seeds: url, depth, retries, ordinal (a queue to begin or to go on with). fetches: url, attempt (from 1), status, final_url, hops (array of
    redirect targets or null); of an url that is asked for more often than it has answers the last one counts. links: url, pos, target.
    robots: url, allowed. done: urls that earlier runs finished; attempted: how many attempts they made. Urls are identities.

    Every attempt counts against max_pages: pages that robots rules block, failures and retries too. 429 sends a page to the queue's end, RETRIES
    times at most. No page must be redirected to where robots rules forbid, and none but the start page out of the scope; the final address counts as a
    hop, whether hops are told or not. The start page's final address becomes what the scope is about. Links of processed pages are followed up to
    max_depth, if they are in scope and allowed, once each.

    The queue is taken in rounds: what is in it now is attempted before all that is appended meanwhile, so a round is a table, and the
    next one is the retries and links of this one by the rank of their page and their place in it. A round's state (depth, retries) goes with its rows.

    log: the folder of a crawl log. Each round is committed to it; a crawl that finds commits there goes on from the last one, with its queue, scope, retries and
    attempts, and seeds, done and attempted are not read. A crawl that was killed at any moment ends as one that was not, and a larger max_pages goes on
    where a smaller one ended. The start must be the same, ValueError otherwise. rounds: stop after so many.
    """
    check_crawl_policy(max_depth, max_pages, rule=rule)
    spark = fetches.sparkSession
    book = CrawlLog(spark, log or shared_folder(spark, "crawl"))
    state = book.last()
    if state is None:
        level = seeds.groupBy("url").agg(F.min_by(F.struct("depth", "retries", "ordinal"), "ordinal").alias("q")).select("url", F.col("q.depth").cast("int").alias("depth"), F.col("q.retries").cast("int").alias("retries"), F.col("q.ordinal").alias("o"))
        if done is not None:
            level = level.join(done.select("url").distinct(), "url", "left_anti")
        part = book.new_part()
        level = book.write(part, "queue", _ranked(level, ["o", "url"], attempted))
        book.write(part, "seen", level.select("url") if done is None else level.select("url").unionByName(done.select("url").distinct()))
        size = level.count()
        state = book.begin(part, start=start, scope=start, rooted=False, placed=attempted + size, queued=size)
    elif state["start"] != start:
        raise ValueError(f"the log in {log} is of a crawl from {state['start']}")
    # what is known of pages, once for all rounds
    answers = _stored(_answers(fetches, robots), "answers")
    allowed = None if robots is None else _stored(robots.groupBy("url").agg(F.bool_and("allowed").alias("allowed")), "robots")
    if allowed is not None:
        forbidden = allowed.where("NOT allowed").select(F.col("url").alias("target"))
        links = _stored(links.join(forbidden, "target", "left_anti").select("url", "pos", "target"), "links")
    while rounds is None or rounds > 0:
        queue = book.table(state, "queue")
        within = queue.where(F.col("rank") <= max_pages)
        if within.isEmpty():
            break
        part, rounds = book.new_part(), None if rounds is None else rounds - 1
        answer = F.coalesce(F.get(F.filter("answers", lambda a: a["attempt"] > F.col("retries")), F.lit(0)), F.element_at("answers", -1))
        tried = within.join(answers, "url", "left").withColumn("a", F.when(F.size("answers") > 0, answer)).drop("answers")
        if allowed is not None:
            tried = tried.join(allowed, "url", "left")
        blocked = F.lit(False) if allowed is None else ~F.coalesce("allowed", F.lit(True))
        root = (F.col("url") == start) & (F.col("depth") == 0)
        found = None if state["rooted"] else _root(tried.where(root & ~blocked))
        scope = found or state["scope"]
        refused = F.col("a.forbidden") | F.exists("a.targets", lambda h: ~in_scope(h, F.lit(scope), rule)) & ~root
        outcome = (
            F.when(blocked, "blocked")
            .when(F.coalesce(refused, F.lit(False)), "failed")
            .when((F.col("a.status") == 429) & (F.col("retries") < RETRIES), "retry")
            .when(F.col("a.status").between(200, 399), "processed")
            .otherwise("failed")
        )
        tried = book.write(part, "attempts", tried.select("rank", "url", "depth", "retries", "a.status", "a.final_url", outcome.alias("outcome")))
        again = tried.where("outcome = 'retry'").select("url", "depth", (F.col("retries") + 1).alias("retries"), F.struct("rank", F.lit(-1).cast("bigint").alias("pos")).alias("by"))
        onward = tried.where(F.expr("outcome = 'processed'") & (F.col("depth") < max_depth)).select("url", "rank", "depth").join(links, "url")
        onward = onward.select(F.col("target").alias("url"), (F.col("depth") + 1).alias("depth"), F.lit(0).alias("retries"), F.struct("rank", F.col("pos").cast("bigint").alias("pos")).alias("by"))
        onward = onward.where(in_scope(F.col("url"), F.lit(scope), rule))
        onward = onward.groupBy("url").agg(F.min_by(F.struct("depth", "retries", "by"), "by").alias("q")).select("url", "q.*")
        fresh = book.write(part, "seen", onward.join(book.table(state, "seen"), "url", "left_anti"), "depth int, retries int, by struct<rank:bigint,pos:bigint>")
        later = _ranked(again.unionByName(fresh), ["by.rank", "by.pos", "url"], state["placed"])
        queued = book.write(part, "queue", later.unionByName(queue.where(F.col("rank") > max_pages), allowMissingColumns=True))
        placed = queued.agg(F.max("rank")).head()[0] or state["placed"]
        state = book.append(state, part, tried.count(), scope=scope, rooted=state["rooted"] or found is not None, placed=max(placed, state["placed"]))
    queue = book.table(state, "queue").select("url", "depth", "retries", F.col("rank").alias("place"))
    return Crawl(book.table(state, "attempts"), queue, state["scope"])


def _root(tried: DataFrame) -> str | None:
    """The start page's final address once it has been processed: one row at most."""
    found = tried.where("a.status BETWEEN 200 AND 399 AND NOT a.forbidden").select(F.coalesce("a.final_url", "url")).head()
    return found[0] if found else None
