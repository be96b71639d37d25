"""The manifest of an archive, kept between runs: which file each identity is found in.

The table is bucketed by identity, and each run is a partition of it, so what earlier runs wrote is read bucket by bucket and never shuffled. New pages' identities are
tested against a Bloom filter first; only those that may be there are joined with the table. A run's rows count once its commit, a small document,
has been put beside the others by one rename; what a killed run has written is overwritten by the next one. After MERGE runs their partitions become one.

An identity is claimed by the first page, in the order of runs and ordinals, that was found under it or asked for by it. Found under it: the page's own file, if
the identity was not claimed before, and else the file of the claim. Asked for: the file of the page's final address. A later claim of another
file changes nothing and is a conflict. Page-authored canonical addresses claim nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.urls import any_identity, output_path
from pagemill.session import stored
from pagemill.sources.files import hadoop

BUCKETS, MERGE = 64, 10
#: Bits per identity and hashes of the filter: one in a hundred new identities is joined for nothing.
BITS, HASHES = 10, 7
#: Identities that a filter is made for at first.
CAPACITY = 1 << 20


@dataclass
class Archived:
    """A run's pages (the columns of the input, identity, alias, output_path, reused, error) and conflicts (identity, output_path, claimed_path, ordinal)."""

    pages: DataFrame
    conflicts: DataFrame


# ---- the filter ------------------------------------------------------------------------------------------------------


def _segment(identity: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(identity, F.lit(2)), F.lit(segments)).cast("int")


def _places(identity: Column, bits: int) -> Column:
    """The bits of an identity in its segment."""
    a, b = F.pmod(F.xxhash64(identity), F.lit(bits)), F.pmod(F.xxhash64(identity, F.lit(1)), F.lit(bits))
    return F.array([(a + i * b) % bits for i in range(HASHES)])


def grown_filter(identities: DataFrame, segments: int, words: int, old: DataFrame | None = None) -> DataFrame:
    """segment, words (array<bigint>): a Bloom filter of the identities, on top of an old one of the same size. Bits are summed up per word before anything is
    gathered; a segment has `words` words, however many identities there are."""
    bits = words * 64
    place = identities.select(_segment(F.col("identity"), segments).alias("segment"), F.explode(_places(F.col("identity"), bits)).alias("p"))
    ones = place.select("segment", F.expr("CAST(p DIV 64 AS int)").alias("word"), F.expr("shiftleft(1L, CAST(p % 64 AS int))").alias("bits"))
    if old is None:
        spark = identities.sparkSession
        rest = spark.range(segments * words).select(F.expr(f"CAST(id DIV {words} AS int)").alias("segment"), F.expr(f"CAST(id % {words} AS int)").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    else:
        rest = old.select("segment", F.posexplode("words").alias("word", "bits"))
    merged = ones.unionByName(rest).groupBy("segment", "word").agg(F.bit_or("bits").alias("bits"))
    return merged.groupBy("segment").agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))


def maybe_in(identities: DataFrame, bloom: DataFrame, segments: int, words: int) -> DataFrame:
    """Adds maybe: false means that the identity is not in the filter."""
    bits = words * 64
    has = lambda p: F.expr("0") if p is None else F.getbit(F.get("words", F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1
    joined = identities.withColumn("segment", _segment(F.col("identity"), segments)).join(bloom, "segment", "left")
    return joined.withColumn("maybe", F.coalesce(F.forall(_places(F.col("identity"), bits), has), F.lit(False))).drop("segment", "words")


# ---- the table -------------------------------------------------------------------------------------------------------


class Manifest:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, capacity: int = CAPACITY):
        """buckets and capacity count for a new manifest; one that is there keeps its own."""
        self.spark, self.folder = spark, folder.rstrip("/")
        last = self._last()
        if last:
            self.state = json.loads(spark.read.text(self._commit(last), wholetext=True).first()[0])
        else:
            self.state = {"run": 0, "runs": [], "filter": None, "buckets": buckets, "words": max(1, -(-capacity * BITS // (buckets * 64))), "identities": 0}
        self.name = f"manifest_{hashlib.md5(self.folder.encode()).hexdigest()}"
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        spark.sql(
            f"CREATE TABLE {self.name} (identity string, output_path string, run bigint) USING parquet PARTITIONED BY (run)"
            f" CLUSTERED BY (identity) INTO {self.state['buckets']} BUCKETS LOCATION '{self.folder}/aliases'"
        )
        for run in self.state["runs"]:
            spark.sql(f"ALTER TABLE {self.name} ADD IF NOT EXISTS PARTITION (run={run})")

    def _last(self) -> int:
        """The number of the last run that was committed; 0 for none."""
        store, place = hadoop(self.spark, f"{self.folder}/commits/*.json")
        return max((int(h.getPath().getName().removesuffix(".json")) for h in store.globStatus(place) or ()), default=0)

    def _commit(self, run: int) -> str:
        return f"{self.folder}/commits/{run:08d}.json"

    def table(self) -> DataFrame:
        """identity, output_path of all committed runs; each identity once."""
        return self.spark.table(self.name).where(F.col("run").isin(self.state["runs"])).select("identity", "output_path")

    def _filter(self) -> DataFrame | None:
        return self.spark.read.schema("segment int, words array<bigint>").parquet(f"{self.folder}/filters/{self.state['filter']}") if self.state["filter"] else None

    def known(self, identities: DataFrame) -> DataFrame:
        """identity, output_path of those that are in the table. The filter lets few others through to the join."""
        if not self.state["runs"]:
            return identities.select("identity", F.lit(None).cast("string").alias("output_path")).where("false")
        likely = maybe_in(identities.select("identity").distinct(), self._filter(), self.state["buckets"], self.state["words"]).where("maybe")
        return likely.select("identity").join(self.table(), "identity")

    def resolve(self, urls: DataFrame, url: str = "url") -> DataFrame:
        """Adds identity and output_path: null for urls that are invalid or not archived."""
        rows = urls.withColumn("identity", any_identity(F.col(url)))
        return rows.join(self.known(rows.where("identity IS NOT NULL")), "identity", "left")

    def archive(self, fetched: DataFrame, layout: str = "default") -> Archived:
        """ordinal, requested_url, final_url -> which pages are converted, the path each is found at, and what conflicts; then commits the run.

        reused: false for the one page that claims its final identity for its own file. Ordinals order the pages of a run; of pages with one ordinal the smaller
        addresses come first. Invalid urls have an error and claim nothing. Runs in any parts give the rows of one run over all.
        """
        if self._last() != self.state["run"]:
            raise RuntimeError(f"another run has been committed to {self.folder} since this one was begun")
        rows = fetched.withColumn("identity", any_identity(F.col("final_url"))).withColumn("alias", any_identity(F.col("requested_url")))
        bad = F.col("identity").isNull() | F.col("alias").isNull()
        rows = stored(rows.withColumn("own_path", F.when(~bad, output_path(F.col("identity"), layout))).withColumn("error", F.when(bad, "not an HTTP(S) url without credentials")), "fetched")
        good = rows.where("error IS NULL")
        # 0: for its own file, 1: for that of the final identity
        at = F.struct("ordinal", "final_url", "requested_url", F.col("k"))
        both = F.array(F.struct(F.lit(0).alias("k"), F.col("identity").alias("claimed")), F.struct(F.lit(1).alias("k"), F.col("alias").alias("claimed")))
        claims = good.withColumn("c", F.explode(both)).select("ordinal", "final_url", "requested_url", F.col("c.k").alias("k"), F.col("c.claimed").alias("claimed"), "identity", "own_path")
        first = claims.groupBy("claimed").agg(F.min_by(F.struct(at.alias("at"), "identity", "own_path"), at).alias("f"))
        first = stored(first.select(F.col("claimed").alias("identity"), "f.at", F.col("f.identity").alias("target"), "f.own_path"), "claims")
        old = stored(self.known(first), "known")
        new = first.join(old.select("identity"), "identity", "left_anti")
        settled = old.unionByName(new.where("at.k = 0").select("identity", F.col("own_path").alias("output_path")))
        settled = stored(settled, "settled")
        fresh = settled.join(old.select("identity"), "identity", "left_anti")
        # aliases point to final identities that were claimed earlier, so pointers end; each round halves what is left of their chains
        left = stored(new.where("at.k = 1").select("identity", "target"), "pointers")
        while not left.isEmpty():
            done = left.join(settled.withColumnRenamed("identity", "target"), "target").select("identity", "output_path")
            hop = left.select(F.col("identity").alias("target"), F.col("target").alias("next"))
            step = stored(done, "resolved")
            settled, fresh = settled.unionByName(step), fresh.unionByName(step)
            rest = left.join(step.select("identity"), "identity", "left_anti")
            left = stored(rest.join(hop, "target", "left").select("identity", F.coalesce("next", "target").alias("target")), "pointers")
        fresh = self._append(fresh)
        # what the run's pages are found at
        own = first.join(old.select("identity"), "identity", "left_anti").where("at.k = 0").select("identity", "at")
        pages = rows.join(settled, "identity", "left").join(own, "identity", "left")
        converts = (F.col("at.ordinal") == F.col("ordinal")) & F.col("at.final_url").eqNullSafe(F.col("final_url")) & F.col("at.requested_url").eqNullSafe(F.col("requested_url"))
        pages = pages.withColumn("reused", F.when(F.col("error").isNull(), ~F.coalesce(converts, F.lit(False))))
        pages = stored(pages.select(*fetched.columns, "identity", "alias", "output_path", "reused", "error"), "archived")
        asked = pages.where("error IS NULL").select("ordinal", F.col("alias").alias("identity"), F.col("output_path").alias("claimed_path"))
        clash = asked.join(settled, "identity").where("output_path <> claimed_path").select("identity", "output_path", "claimed_path", "ordinal").distinct()
        return Archived(pages, clash)

    def _append(self, fresh: DataFrame) -> DataFrame:
        """Writes new rows as a run, grows the filter, and commits both."""
        state, run = dict(self.state), self.state["run"] + 1
        fresh = stored(fresh, "fresh")
        fresh.repartition(state["buckets"], "identity").createOrReplaceTempView("pagemill_fresh")
        self._insert(run, "SELECT identity, output_path FROM pagemill_fresh")
        old = self._filter()
        state |= {"run": run, "runs": [*state["runs"], run], "identities": state["identities"] + fresh.count(), "filter": uuid.uuid4().hex}
        if len(state["runs"]) > MERGE:
            state["runs"] = [self._merged(state["runs"], run)]
        room = state["words"] * 64 * state["buckets"] // BITS
        if state["identities"] > room:  # twice as many bits as are needed, from all identities
            state["words"] = -(-2 * state["identities"] * BITS // (state["buckets"] * 64))
            every = self.spark.table(self.name).where(F.col("run").isin(state["runs"]))
            bloom = grown_filter(every, state["buckets"], state["words"])
        else:
            bloom = grown_filter(fresh, state["buckets"], state["words"], old)
        bloom.write.parquet(f"{self.folder}/filters/{state['filter']}")
        store, draft = hadoop(self.spark, f"{self.folder}/commits/_{uuid.uuid4().hex}")
        out = store.create(draft, False)
        out.write(json.dumps(state).encode())
        out.close()
        end = hadoop(self.spark, self._commit(run))[1]
        if store.exists(end) or not store.rename(draft, end):
            store.delete(draft, False)
            raise RuntimeError(f"another run has committed {run} to {self.folder}")
        before, self.state = self.state, state
        for gone in set(before["runs"]) - set(state["runs"]):
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (run={gone})")
            store.delete(hadoop(self.spark, f"{self.folder}/aliases/run={gone}")[1], True)
        if before["filter"]:
            store.delete(hadoop(self.spark, f"{self.folder}/filters/{before['filter']}")[1], True)
        return fresh

    def _merged(self, runs: list[int], run: int) -> int:
        """One partition in the place of several, bucket by bucket: its number is the run's, negative."""
        self._insert(-run, f"SELECT identity, output_path FROM {self.name} WHERE run IN ({', '.join(map(str, runs))})")
        return -run

    def _insert(self, run: int, rows: str) -> None:
        """Writes a partition anew; what is there is of a run that was killed."""
        store, place = hadoop(self.spark, f"{self.folder}/aliases/run={run}")
        store.delete(place, True)
        self.spark.sql(f"INSERT INTO {self.name} PARTITION (run={run}) {rows}")
