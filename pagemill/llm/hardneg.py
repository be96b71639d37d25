"""Hard-negative mining with a vector-approximation file.

Vectors are integers, floor(SCALE * x) by component. The file holds, for each vector, one byte per dimension: the cell that the component lies in. Cells hold
about equally many vectors of a bounded sample; their outer edges are the extremes of the whole table, so every component lies in its cell. An anchor turns
the cells' edges into two tables per dimension, the least and the greatest product of its component with any value of a cell; the sums of looked-up products
bound a row's score from below and above.

A search asks for an anchor's first k rows whose scores lie in a window. It scans the file alone. A row is a candidate if its bounds reach into the window and
its upper bound is not below the k-th best lower bound of rows that are surely inside. That bar is taken within each share of the rows, then over all shares;
vectors are fetched for what is left, by joins on ids, and scored exactly. So the result is exact whatever the cells are; cells decide the
cost alone.

Positives are a search among rows of the anchor's label in an open window; negatives one among all other rows, in one window for each positive's score.

Of equal vectors of one label, the k + 1 smallest ids alone can be among the first k of anything, as ties go by id and one may be the anchor itself; the others
are left out of the file by a limit that Spark applies before it shuffles. Anchors and rows are dealt into blocks; each pair of blocks
is one task's group, of bounded size on both sides whatever vectors or labels are frequent. All anchors meet all rows, in blocks: that product is the operator's
definition, and what the file saves is bytes and exact scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import ship, stored

SCALE = 256
#: Cells of a dimension at most, and rows that their edges are fitted on at most.
CELLS, SAMPLE = 64, 20_000
#: Anchors and rows of a block, about; rows go to SHARES blocks at least.
ANCHORS, ROWS, SHARES = 1024, 1 << 16, 24
#: Tasks of a scan at most; beyond that a task has several groups, one after another.
MOST_TASKS = 20_000
#: Rows that one lookup takes, so that what it writes stays in the processor's cache.
CHUNK = 4096
#: Components beyond this count as this: sums of products of 8,192 of them are exact in 64-bit floats.
LARGEST = 1 << 20


# ---- rows ------------------------------------------------------------------------------------------------------------


def integer_vectors(rows: DataFrame, label: Column | None = None, scale: int = SCALE) -> DataFrame:
    """vec_id, label, q (array<int>) and h (a hash of label and q) of the rows that take part.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Components beyond LARGEST / scale count as that.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), (F.col("label") if label is None else label).cast("bigint").alias("label"), "embedding")
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(~F.exists("embedding", bad))
    whole = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * scale))).cast("int")
    return rows.select("vec_id", "label", F.transform("embedding", whole).alias("q")).withColumn("h", F.xxhash64("label", "q"))


def score(a: Column, b: Column) -> Column:
    """The inner product; what one vector has beyond the other's length counts as 0."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("bigint") * y, F.lit(0).cast("bigint")))
    return F.aggregate(products, F.lit(0).cast("bigint"), lambda s, x: s + x)


def _first_of_equals(rows: DataFrame, k: int) -> DataFrame:
    """The k smallest ids of each label and vector; rows that repeat one another count once."""
    w = Window.partitionBy("label", "h", "q").orderBy("vec_id")
    return rows.withColumn("_k", F.dense_rank().over(w)).where(F.col("_k") <= k).dropDuplicates(["label", "h", "q", "vec_id"]).drop("_k")


# ---- the file --------------------------------------------------------------------------------------------------------


def _extremes(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest component of each dimension; one row per dimension reaches the driver. Shorter vectors have 0 there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch["q"])
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array([q.min(0)], pa.list_(pa.int32())), pa.array([q.max(0)], pa.list_(pa.int32()))], ["low", "high"])

    ends = rows.select("q").mapInArrow(run, "low array<int>, high array<int>").select(F.posexplode(F.arrays_zip("low", "high")).alias("d", "e"))
    found = ends.groupBy("d").agg(F.min("e.low").alias("low"), F.max("e.high").alias("high"), F.count("*").alias("n")).orderBy("d").toArrow()
    low, high, n = (found[c].to_numpy().astype(np.int64) for c in ("low", "high", "n"))
    partial = n < n.max(initial=0)  # some batch has only shorter vectors
    return np.where(partial, np.minimum(low, 0), low), np.where(partial, np.maximum(high, 0), high)


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Arrays as rows of one matrix, padded with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    width = int(size.max(initial=0)) if width is None else width
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return values.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int32)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def cell_edges(rows: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> list[np.ndarray]:
    """For each dimension the first value of every cell but the first cell's, then one past the last value; the first cell begins at the least value."""
    low, high = _extremes(rows)
    some = _matrix(rows.orderBy(F.xxhash64("vec_id", "h"), "vec_id").limit(sample).select("q").toArrow()["q"], len(low)) if len(low) else np.zeros((0, 0))
    out = []
    for d in range(len(low)):
        inner = np.unique(np.quantile(some[:, d], np.arange(1, cells) / cells).astype(np.int64))
        inner = inner[(inner > low[d]) & (inner <= high[d])]
        out.append(np.concatenate([[low[d]], inner, [high[d] + 1]]))
    return out


def approximations(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """The file: vec_id, h, label and cells, one byte for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch["q"], len(edges))
            codes = np.empty(q.shape, np.uint8)
            for d, e in enumerate(edges):
                codes[:, d] = np.searchsorted(e[1:-1], q[:, d], side="right")
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["h"], batch["label"], packed], ["vec_id", "h", "label", "cells"])

    return rows.select("vec_id", "h", "label", "q").mapInArrow(run, "vec_id bigint, h bigint, label bigint, cells binary")


# ---- the scan --------------------------------------------------------------------------------------------------------


class Share:
    """A block of the file: rows in order of label, one row of cells for each dimension."""

    def __init__(self, table: pa.Table, width: int):
        order = np.argsort(table["label"].to_numpy(), kind="stable")
        self.ids, self.hashes, self.labels = (table[c].to_numpy()[order] for c in ("vec_id", "h", "label"))
        codes = np.frombuffer(b"".join(table["cells"].to_pylist()), np.uint8).reshape(len(order), width)
        self.cells = np.ascontiguousarray(codes[order].T.astype(np.intp))

    def spans(self, label: int, same: bool) -> list[tuple[int, int]]:
        a, z = (int(np.searchsorted(self.labels, label, side=s)) for s in ("left", "right"))
        return [(a, z)] if same else [(0, a), (z, len(self.labels))]

    def bounds(self, tables: np.ndarray, a: int, z: int) -> np.ndarray:
        """Lower bounds as real parts, upper bounds as imaginary ones, of rows a to z."""
        out = np.zeros(z - a, np.complex128)
        part = np.empty(min(CHUNK, z - a), np.complex128)
        for s in range(a, z, CHUNK):
            e = min(s + CHUNK, z)
            for table, cells in zip(tables, self.cells):
                np.take(table, cells[s:e], out=part[: e - s], mode="clip")
                out[s - a : e - a] += part[: e - s]
        return out


def _tables(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each dimension and cell, the least and the greatest product of the anchor's component with the cell's values."""
    a, b = q[:, None] * low, q[:, None] * high
    return np.minimum(a, b) + 1j * np.maximum(a, b)


_CANDIDATES = "anchor_id bigint, anchor_h bigint, low bigint, high bigint, vec_id bigint, h bigint, lower bigint, upper bigint"
_KEYS = ["anchor_id", "anchor_h", "low", "high"]


def candidates(file: DataFrame, anchors: DataFrame, edges: list[np.ndarray], same: bool, k: int, n_rows: int, n_anchors: int) -> DataFrame:
    """Rows of the file that may be among the first k of an anchor's window, with the bounds of their scores.

    anchors: vec_id, h, label, q and windows, an array of (low, high). same: search in the anchor's label, or in all others.
    """
    blocks, shares = max(1, -(-n_anchors // ANCHORS)), max(SHARES, -(-n_rows // ROWS))
    width, cells = len(edges), max([len(e) - 1 for e in edges], default=1)
    low, high = np.zeros((width, cells)), np.zeros((width, cells))
    for d, e in enumerate(edges):
        low[d, : len(e) - 1], high[d, : len(e) - 1] = e[:-1], e[1:] - 1

    def search(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        share = Share(rows, width)
        out: list[list[np.ndarray]] = [[] for _ in range(8)]
        q = _matrix(wanted["q"], width).astype(np.float64)
        for n, a in enumerate(wanted.select(["vec_id", "h", "label", "windows"]).to_pylist()):
            tables = _tables(q[n], low, high)
            for start, stop in share.spans(a["label"], same):
                if start == stop:
                    continue
                both = share.bounds(tables, start, stop)
                for w in a["windows"]:
                    hit = _possible(both.real, both.imag, share.ids[start:stop] != a["vec_id"], w["low"], w["high"], k)
                    found = (share.ids[start:stop][hit], share.hashes[start:stop][hit], both.real[hit].astype(np.int64), both.imag[hit].astype(np.int64))
                    for column, values in zip(out, [*(np.full(len(hit), x) for x in (a["vec_id"], a["h"], w["low"], w["high"])), *found]):
                        column.append(values)
        names = [c.split()[0] for c in _CANDIDATES.split(", ")]
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], names)

    dealt = file.withColumns({"share": F.pmod(F.xxhash64("vec_id"), F.lit(shares)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    wanted = anchors.withColumns({"block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"), "share": F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))})
    # a stated number of partitions, as few bytes make much work here
    dealt, wanted = (x.repartition(min(blocks * shares, MOST_TASKS), "block", "share") for x in (dealt, wanted))
    found = dealt.groupBy("block", "share").cogroup(wanted.groupBy("block", "share")).applyInArrow(search, _CANDIDATES)
    # the bar over all shares
    w = Window.partitionBy(*_KEYS)
    inside = (F.col("lower") >= F.col("low")) & (F.col("upper") <= F.col("high"))
    ranked = found.withColumn("place", F.row_number().over(w.orderBy(F.when(inside, F.col("lower")).desc_nulls_last())))
    bar = F.max(F.when(inside & (F.col("place") == k), F.col("lower"))).over(w)
    return ranked.withColumn("bar", bar).where("bar IS NULL OR upper >= bar").drop("place", "bar")


def _possible(lower: np.ndarray, upper: np.ndarray, other: np.ndarray, low: int, high: int, k: int) -> np.ndarray:
    """Rows whose bounds reach into the window, and are not all below k rows that are surely in it."""
    hit = np.flatnonzero((upper >= low) & (lower <= high) & other)
    sure = lower[hit][(lower[hit] >= low) & (upper[hit] <= high)]
    if len(sure) > k:
        hit = hit[upper[hit] >= np.partition(sure, len(sure) - k)[len(sure) - k]]
    return hit


def first_in_windows(found: DataFrame, rows: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """Exact scores of the candidates, and the first k of each anchor and window: the candidates' keys, vec_id, score and rank."""
    near = found.select(*_KEYS, "vec_id", "h").join(rows.select("vec_id", "h", "q"), ["vec_id", "h"])
    near = near.join(anchors.select(F.col("vec_id").alias("anchor_id"), F.col("h").alias("anchor_h"), F.col("q").alias("anchor_q")), ["anchor_id", "anchor_h"])
    near = near.select(*_KEYS, "vec_id", "h", score(F.col("anchor_q"), F.col("q")).alias("score")).where("score BETWEEN low AND high")
    w = Window.partitionBy(*_KEYS).orderBy(F.desc("score"), "vec_id", "h")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, percent: int = 80, cells: int = CELLS, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its positives the first `negatives` rows of
    other labels with percent * positive_score <= 100 * negative_score <= 100 * positive_score.

    vectors: vec_id, label, q and h of integer_vectors(). Anchors are the rows whose vec_id is divisible by `every`; positives are an anchor's best rows of its
    label. Ties go to the smaller vec_id. Rows with the anchor's vec_id are none of its partners; rows that repeat one another count once; rows of one vec_id and
    different labels or vectors are rows of their own. An anchor without positives, or a positive without a negative in its window, has no row; an empty table
    gives an empty one. Vectors of different lengths are compared as if the shorter had zeros. Other columns are ignored.
    """
    ship(vectors.sparkSession)
    anchors = stored(vectors.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "h"]), "anchors")
    rows = stored(_first_of_equals(vectors, max(positives, negatives) + 1), "vectors")
    n_rows, n_anchors = rows.count(), anchors.count()
    edges = cell_edges(rows, min(cells, 256), sample)
    file = stored(approximations(rows, edges), "approximations")

    def search(wanted: DataFrame, same: bool, k: int) -> DataFrame:
        return first_in_windows(candidates(file, wanted, edges, same, k, n_rows, n_anchors), rows, anchors, k)

    ends = np.iinfo(np.int64)
    all_ = F.array(F.struct(F.lit(ends.min).cast("bigint").alias("low"), F.lit(ends.max).cast("bigint").alias("high")))
    near = search(anchors.withColumn("windows", all_), True, positives)
    # percent * s <= 100 * t: the least whole t. Windows of negative scores are empty
    least = F.expr(f"(score * {int(percent)} + 99) div 100")
    near = stored(near.select("anchor_id", "anchor_h", F.col("vec_id").alias("positive_id"), F.col("h").alias("positive_h"), least.alias("low"), F.col("score").alias("high")).where("low <= high"), "positives")
    windows = near.groupBy("anchor_id", "anchor_h").agg(F.collect_set(F.struct("low", "high")).alias("windows"))
    wanted = anchors.join(windows.withColumnsRenamed({"anchor_id": "vec_id", "anchor_h": "h"}), ["vec_id", "h"])
    far = search(wanted, False, negatives)
    return near.join(far, _KEYS).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("high").alias("positive_score"), F.col("score").alias("negative_score")
    )


def query(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label))


ORACLE = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""
