"""An append-only log of a crawl's rounds: what a crawl that was stopped at any moment goes on from.

A log is a folder in any store that Spark writes to. A round's rows go to a new folder below `parts`; then a commit, a small document that names all parts of
the state, is put beside the others under the round's number by one rename. A round without its commit did not happen: its rows are never read, and are
deleted at the next checkpoint. So a crawl that is killed loses at most the round that it was in, and goes on from the last whole one.

Parts are appended, not rewritten. When a table has more than PARTS of them they are merged into one, so each row is rewritten once in PARTS rounds and recovery
reads a bounded number of parts. Every so many attempts or seconds a commit is a checkpoint; the last ten of those are kept, with the latest commit, and
what none of these names is deleted. Two crawls that share a log can't both commit a round: the second one's rename fails.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from pagemill.operators.state import CHECKPOINT_PAGES, CHECKPOINT_SECONDS, KEPT_CHECKPOINTS
from pagemill.sources.files import hadoop

#: Parts of one table before they are merged.
PARTS = 10

ATTEMPTS = "rank bigint, url string, depth int, retries int, status int, final_url string, outcome string"
QUEUE = "url string, depth int, retries int, rank bigint"
SEEN = "url string"
_SCHEMAS = {"attempts": ATTEMPTS, "queue": QUEUE, "seen": SEEN}


class CrawlLog:
    def __init__(self, spark: SparkSession, folder: str, pages: int | None = None, seconds: float | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.pages, self.seconds = CHECKPOINT_PAGES if pages is None else pages, CHECKPOINT_SECONDS if seconds is None else seconds
        self.began = time.time()

    def commits(self) -> list[int]:
        """Numbers of the rounds whose commits are there."""
        store, place = hadoop(self.spark, f"{self.folder}/commits/*.json")
        return sorted(int(hit.getPath().getName().removesuffix(".json")) for hit in store.globStatus(place) or ())

    def read(self, number: int) -> dict:
        return json.loads(self.spark.read.text(self._commit(number), wholetext=True).first()[0])

    def last(self) -> dict | None:
        numbers = self.commits()
        return self.read(numbers[-1]) if numbers else None

    def _commit(self, number: int) -> str:
        return f"{self.folder}/commits/{number:08d}.json"

    def table(self, state: dict, name: str) -> DataFrame:
        """The attempts, queue or seen urls of a commit."""
        paths = [f"{self.folder}/parts/{p}/{name}" for p in state[name]]
        reader = self.spark.read.schema(_SCHEMAS[name])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMAS[name])

    def new_part(self) -> str:
        return uuid.uuid4().hex

    def write(self, part: str, name: str, rows: DataFrame, more: str = "") -> DataFrame:
        """Rows of a part that no commit names yet, as they were written; with `more` columns, which table() leaves out."""
        path = f"{self.folder}/parts/{part}/{name}"
        columns = [c.split()[0] for c in _SCHEMAS[name].split(", ")]
        rows.select(*columns, *[c for c in rows.columns if more and c not in columns]).write.parquet(path)
        return self.spark.read.schema(f"{_SCHEMAS[name]}, {more}" if more else _SCHEMAS[name]).parquet(path)

    def begin(self, part: str, **facts) -> dict:
        """Commits the queue and the seen urls that a crawl starts with."""
        state = {"round": 0, "attempts": [], "queue": [part], "seen": [part], "attempted": facts["placed"] - facts["queued"], "checkpoints": [], **facts}
        state["checked"] = state["attempted"]
        return self._put(state, "start")

    def append(self, state: dict, part: str, attempted: int, **facts) -> dict:
        """Commits a round: its attempts and newly seen urls beside the earlier ones, its queue in the place of the last one."""
        new = state | facts | {"round": state["round"] + 1, "attempted": state["attempted"] + attempted, "queue": [part]}
        for name in ("attempts", "seen"):
            new[name] = [*state[name], part]
            if len(new[name]) > PARTS:
                merged = self.new_part()
                self.write(merged, name, self.table(new, name))
                new[name] = [merged]
        trigger = "pages" if new["attempted"] - state["checked"] >= self.pages else "time" if time.time() - self.began > self.seconds else None
        return self._put(new, trigger)

    def _put(self, state: dict, trigger: str | None) -> dict:
        if trigger:
            entry = {"round": state["round"], "trigger": trigger, "attempted": state["attempted"], "timestamp": round(time.time(), 3)}
            state["checkpoints"] = [*state["checkpoints"], entry][-KEPT_CHECKPOINTS:]
            state["checked"] = state["attempted"]
            self.began = time.time()
        store, draft = hadoop(self.spark, f"{self.folder}/commits/_{uuid.uuid4().hex}")
        out = store.create(draft, False)
        out.write(json.dumps(state).encode())
        out.close()
        end = hadoop(self.spark, self._commit(state["round"]))[1]
        # the local store renames onto an existing file, others refuse
        if store.exists(end) or not store.rename(draft, end):
            store.delete(draft, False)
            raise RuntimeError(f"another crawl has committed round {state['round']} to {self.folder}")
        if trigger:
            self.prune(state)
        return state

    def prune(self, state: dict) -> None:
        """Deletes commits that are neither the latest nor a kept checkpoint, and parts that no other names: merged ones, and those of torn rounds."""
        kept = {c["round"] for c in state["checkpoints"]} | {state["round"]}
        named = set()
        store = hadoop(self.spark, self.folder)[0]
        for number in self.commits():
            if number in kept:
                named |= {p for name in _SCHEMAS for p in self.read(number)[name]}
            elif number < state["round"]:
                store.delete(hadoop(self.spark, self._commit(number))[1], False)
        for hit in store.globStatus(hadoop(self.spark, f"{self.folder}/parts/*")[1]) or ():
            if hit.getPath().getName() not in named:
                store.delete(hit.getPath(), True)
