"""Helpers shared by the corpus operators: shared folders, worker imports, words of Arrow text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.session import shared_folder, ship, stored  # noqa: F401

#: Words are runs of other characters than these, in Java's and DuckDB's regular expressions.
NOT_WORD = r"[\x20\x09-\x0D]+"
#: Bytes of text that one numpy round takes; a single longer text is a round of its own.
ROUND_BYTES = 3 << 19


#: Parts that the rows of one class are dealt into where they meet their class.
SALTS = 64


def of_classes(rows: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Adds head, the smallest doc_id of the rows (doc_id, h1, h2) with the same two hashes, and the columns of `heads` (head, ...).

    The minimum is pre-aggregated by class and part, and a class comes back once for each part that has rows of it: however large
    a class is, no task has more than a part of it, and none is joined to `heads` more than once a part.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    least = rows.withColumn("part", part).groupBy("h1", "h2", "part").agg(F.min("doc_id").alias("head"))
    classes = least.groupBy("h1", "h2").agg(F.min("head").alias("head"), F.collect_set("part").alias("parts"))
    if heads is not None:
        classes = classes.join(heads, "head", "left")
    classes = classes.withColumn("part", F.explode("parts")).drop("parts")
    return rows.withColumn("part", part).join(classes, ["h1", "h2", "part"], "left").drop("part")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even where body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: Column) -> Column:
    """The words of a text as an array; of null, an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NOT_WORD), lambda w: w != "")


# ---- text in Arrow batches -------------------------------------------------------------------------------------------


def rounds(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = ROUND_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text each and a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = string_buffers(column)[1]
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
            stop = min(max(stop, at + 1), batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    big = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the bytes, and for each row the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    inside = ~_SPACE[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    edge[ends[:-1][ends[:-1] < len(data)]] = True  # a row ends a word even where no space does
    cuts = np.flatnonzero(edge)
    keep = inside[cuts]
    stops = np.append(cuts[1:], len(data))[keep]
    starts = cuts[keep]
    return starts, stops, np.searchsorted(starts, ends)


_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 18)
        for k, p in enumerate((_P, _P_INVERSE)):
            table = np.full(n, p, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, chunk: int = 1 << 17) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over prefix sums, a bounded chunk of bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        end = max(int(np.searchsorted(stops, starts[at] + chunk, side="right")), at + 1)
        low, high = int(starts[at]), int(stops[end - 1])
        power, inverse = _power_tables(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_TABLE[data[low:high]] * power[: high - low], out=sums[1:])
        s, e = starts[at:end] - low, stops[at:end] - low
        out[at:end] = mix((sums[e] - sums[s]) * inverse[s])
        at = end
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, by the position of its first; runs may cross rows, callers mask those."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[k : len(words) - n + 1 + k]
    return mix(out)
