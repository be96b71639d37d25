"""Crawl state as rows: migration, checkpoints, resuming, and the store of state documents."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.sources.files import hadoop

SCHEMA = (
    "version string, crawl_id string, created_at string, last_checkpoint string, start_url string, output_dir string, config map<string,string>,"
    " progress struct<urls_queued:array<array<string>>,urls_visited:map<string,string>,urls_failed:map<string,string>,attempted_count:bigint,"
    "retry_attempts:map<string,bigint>,statistics:map<string,double>>, checkpoints array<struct<timestamp:string,trigger:string,message:string>>"
)
CURRENT, LEGACY = "1.1", "1.0"
KEPT_CHECKPOINTS, CHECKPOINT_SECONDS, CHECKPOINT_PAGES = 10, 300, 100
_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{0,127}")


def fault(states_progress: str = "progress") -> Column:
    """What keeps a document from being read: a version that is not known, or negative counts; null where nothing does."""
    version, p = F.coalesce("version", F.lit(LEGACY)), F.col(states_progress)
    negative = (F.coalesce(p["attempted_count"], F.lit(0)) < 0) | F.exists(F.map_values(F.coalesce(p["retry_attempts"], F.create_map().cast("map<string,bigint>"))), lambda v: v < 0)
    return F.when(~version.isin(CURRENT, LEGACY), F.concat(F.lit("unsupported crawl-state version: "), version)).when(negative, "attempt counts cannot be negative")


def migrate(states: DataFrame) -> DataFrame:
    """Documents of versions 1.0 (or none) and 1.1 as 1.1; others, and negative counts, have an error."""
    version = F.coalesce("version", F.lit(LEGACY))
    p = F.col("progress")
    no_map = F.create_map().cast("map<string,string>")
    visited, failed = F.coalesce(p["urls_visited"], no_map), F.coalesce(p["urls_failed"], no_map)
    terminal = F.size(F.array_union(F.map_keys(visited), F.map_keys(failed))).cast("bigint")
    attempted = F.coalesce(p["attempted_count"], F.when(version == LEGACY, terminal).otherwise(0))
    retries = F.coalesce(p["retry_attempts"], F.create_map().cast("map<string,bigint>"))
    return states.select(
        F.lit(CURRENT).alias("version"), "crawl_id", "created_at", "last_checkpoint", "start_url", "output_dir", F.coalesce(p["urls_queued"], F.array().cast("array<array<string>>")).alias("urls_queued"),
        visited.alias("urls_visited"), failed.alias("urls_failed"), attempted.alias("attempted_count"), retries.alias("retry_attempts"),
        F.coalesce("checkpoints", F.array().cast("array<struct<timestamp:string,trigger:string,message:string>>")).alias("checkpoints"), fault().alias("error"),
    )


def due(elapsed: Column, pages: Column) -> Column:
    """Whether a checkpoint is due."""
    return (elapsed > CHECKPOINT_SECONDS) | (pages >= CHECKPOINT_PAGES)


def with_checkpoint(checkpoints: Column, new: Column) -> Column:
    """The last ten checkpoints, the new one included."""
    grown = F.concat(checkpoints, F.array(new))
    return F.slice(grown, F.greatest(F.size(grown) - KEPT_CHECKPOINTS + 1, F.lit(1)), F.lit(KEPT_CHECKPOINTS))


def resume(states: DataFrame) -> DataFrame:
    """What a crawl goes on with: the queue, and the urls that are done."""
    return states.select("crawl_id", "urls_queued", F.array_union(F.map_keys("urls_visited"), F.map_keys("urls_failed")).alias("terminal"), "attempted_count", "retry_attempts")


def merge_retries(counters: DataFrame) -> DataFrame:
    """identity, attempts: where identities meet the larger count stays."""
    return counters.groupBy("identity").agg(F.max("attempts").alias("attempts"))


def outcomes(results: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """crawl_id, url, output_path, error: what each url ended with. Of the results (crawl_id, pos, url, success, output_path, error) the last
    success with a path and the last failure with a message count; those of `before`, in the same columns as this result, yield to them."""
    path = F.when(F.col("success"), F.nullif("output_path", F.lit("")))
    error = F.when(~F.col("success"), F.nullif("error", F.lit("")))
    rows = results.select("crawl_id", "url", F.col("pos").cast("bigint").alias("pos"), path.alias("output_path"), error.alias("error"))
    if before is not None:
        rows = rows.unionByName(before.select("crawl_id", "url", F.lit(None).cast("bigint").alias("pos"), "output_path", "error"))
    place = F.coalesce("pos", F.lit(-(2**63)))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(place.alias("p"), F.col(c).alias("v"))))["v"]
    done = rows.groupBy("crawl_id", "url").agg(last("output_path").alias("output_path"), last("error").alias("error"))
    return done.where("output_path IS NOT NULL OR error IS NOT NULL")


def counters(results: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """crawl_id, urls_processed, urls_failed: every result counts as processed, a failure with a message as failed, on top of `before`."""
    failed = F.coalesce(~F.col("success") & (F.col("error") != ""), F.lit(False)).cast("bigint")
    rows = results.select("crawl_id", F.lit(1).cast("bigint").alias("p"), failed.alias("f"))
    if before is not None:
        rows = rows.unionByName(before.selectExpr("crawl_id", "urls_processed AS p", "urls_failed AS f"))
    return rows.groupBy("crawl_id").agg(F.sum("p").alias("urls_processed"), F.sum("f").alias("urls_failed"))


def progress_percent(processed: Column, queued: Column) -> Column:
    return F.when(processed + queued > 0, F.round(100.0 * processed / (processed + queued), 1)).otherwise(0.0)


class StateStore:
    """State documents as JSON files in one folder, `<crawl_id>.json`, through Spark's own readers and writers. What a save replaces stays
    as `<crawl_id>.bak`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @staticmethod
    def check_id(crawl_id: str) -> str:
        if not _ID.fullmatch(crawl_id):
            raise ValueError(f"not a crawl id: {crawl_id!r}")
        return crawl_id

    def documents(self) -> DataFrame:
        """Each crawl's document, in the columns of SCHEMA: the one in its file, or where that can't be read, is of a version that is not
        known or names another crawl, the one in its backup."""
        files = self.spark.read.schema(SCHEMA).option("multiLine", "true").option("pathGlobFilter", "*.{json,bak}").json(self.folder)
        name = F.col("_metadata.file_name")
        rows = files.select("*", name.endswith(".bak").alias("_backup")).where(F.col("crawl_id") == F.regexp_replace(name, r"\.(json|bak)$", ""))
        order = W.partitionBy("crawl_id").orderBy(fault().isNotNull(), "_backup")
        return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_backup")

    def read(self) -> DataFrame:
        return migrate(self.documents())

    def resolve(self, wanted: str) -> str:
        """An id, or the only one that begins with at least eight characters."""
        ids = [r["crawl_id"] for r in self.read().select("crawl_id").where(F.col("crawl_id").startswith(self.check_id(wanted))).distinct().limit(3).collect()]
        if wanted in ids:
            return wanted
        if len(wanted) < 8 or len(ids) != 1:
            raise ValueError(f"{'ambiguous' if len(ids) > 1 else 'unknown'} crawl id: {wanted}")
        return ids[0]

    def load(self, wanted: str) -> DataFrame:
        return self.read().where(F.col("crawl_id") == self.resolve(wanted))

    def save(self, states: DataFrame, crawl_id: str) -> None:
        """states in the columns of SCHEMA, one row; the document replaces an earlier one, which becomes the backup."""
        place = f"{self.folder}/{self.check_id(crawl_id)}"
        self._place(states, f"{place}.json", f"{place}.bak")

    def export(self, wanted: str, path: str) -> None:
        """Writes a crawl's document to a file."""
        self._place(self.documents().where(F.col("crawl_id") == self.resolve(wanted)), path)

    def _place(self, states: DataFrame, target: str, backup: str | None = None) -> None:
        """Writes the one document beside its place, in a folder that readers pass over, and renames it."""
        draft = f"{self.folder}/_{uuid.uuid4().hex}"
        states.coalesce(1).write.json(draft)
        store, work = hadoop(self.spark, draft)
        parts = store.globStatus(hadoop(self.spark, f"{draft}/part-*")[1])
        end_store, end = hadoop(self.spark, target)
        if backup and end_store.exists(end):
            kept = hadoop(self.spark, backup)[1]
            end_store.delete(kept, False)
            end_store.rename(end, kept)
        util, conf = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil, self.spark.sparkContext._jsc.hadoopConfiguration()
        end_store.mkdirs(end.getParent())
        if not parts or not (store.rename(parts[0].getPath(), end) if backup else util.copy(store, parts[0].getPath(), end_store, end, True, True, conf)):
            raise OSError(f"not written: {target}")
        store.delete(work, True)

    def listing(self) -> DataFrame:
        rows = self.read()
        return rows.select("crawl_id", "start_url", "last_checkpoint", F.size("urls_visited").alias("visited"), F.size("urls_queued").alias("queued"), F.size("urls_failed").alias("failed")).orderBy(
            F.desc("last_checkpoint"), "crawl_id"
        )

    def import_state(self, states: DataFrame) -> str:
        """Under a new id."""
        crawl_id = str(uuid.uuid4())
        self.save(states.withColumn("crawl_id", F.lit(crawl_id)), crawl_id)
        return crawl_id

    def older_than(self, days: int, now: Column) -> DataFrame:
        """Files strictly older than that."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(self.folder)
        return files.select("path", "modificationTime").where(F.col("modificationTime") < now - F.make_dt_interval(F.lit(days)))

    def clean(self, days: int, now: Column) -> int:
        """Deletes those files and their backups, and returns how many crawls that were."""
        cleaned = 0
        for row in self.older_than(days, now).select("path").toLocalIterator():
            store, place = hadoop(self.spark, row["path"])
            cleaned += bool(store.delete(place, False))
            store.delete(hadoop(self.spark, row["path"].removesuffix(".json") + ".bak")[1], False)
        return cleaned
