"""Quality classifier: Bradley-Terry scores learned from preference pairs.

Labelled documents of either class make pairs, "this one is preferred to that one"; the logistic loss on the differences of
their features gives weights, and a document's score is its features' weighted sum. The threshold is the quantile of the
training scores that classes most training documents rightly, and a one-dimensional logistic fit turns scores into values from 0 to 1
that cross 0.5 at the threshold.

Features are counts over whole texts (letters, marks, symbols, words, lines, repetition), computed from the bytes of Arrow
batches: no shuffle, and no input but the text.

The fit is on every labelled document and every pair of them, and no pair is made. A pair's loss is a smooth function of the
difference of two scores, so within a narrow cell of scores it is, to some twelve digits, the polynomial through its values at a few
nodes. Each step of Newton's method is one pass that adds up, for each class, cell and node, the documents' shares, features and products
of features; the loss of all pairs, its gradient and its curvature follow from these sums, whose size depends on the range of the scores alone.
The threshold comes from a range-partitioned sort of all training scores. What comes to the driver is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import ROUND_BYTES, rounds, ship, string_buffers, word_bounds, word_hashes
from pagemill.session import scratch, stored

#: Width of a cell of scores, and Chebyshev nodes in it: the loss is analytic up to pi from the real line, which leaves an error of 1e-12 or less.
CELL, NODES = 2.0, 16
#: Documents that one numpy round of the fit takes.
ROUND_ROWS = 4096
#: Ranges that the training scores are dealt into for the threshold.
RANGES = 64
#: Ridge on the standardized weights, and on the slope of the last fit.
RIDGE, SLOPE_RIDGE = 1e-3, 1e-3
#: Standardized features are held to this many standard deviations.
CLIP = 6.0

_SETS = {
    "upper": bytes(range(0x41, 0x5B)),
    "lower": bytes(range(0x61, 0x7B)),
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>@^~=+_\\{}[]",
    "stop": b".!?",
    "comma": b",;:",
    "wide": bytes(range(0x80, 0x100)),
    "newline": b"\n",
}
_CLASSES = np.zeros((256, len(_SETS)))
for _k, _s in enumerate(_SETS.values()):
    _CLASSES[list(_s), _k] = 1
_SYMBOL, _UPPER, _STOP = (_CLASSES[:, list(_SETS).index(n)].astype(bool) for n in ("symbol", "upper", "stop"))
FEATURES = (
    "log_words", "word_bytes", "upper", "digit", "symbols_a_word", "stops_a_word", "commas_a_word", "wide", "words_a_line",
    "distinct", "same_as_before", "ends_in_symbol", "capitalized", "stopped_lines", "log_longest_word",
)


def text_features(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a buffer."""
    n = len(ends) - 1
    counts = np.zeros((n, len(_SETS)))
    for k in range(n):
        if ends[k + 1] > ends[k]:
            for at in range(int(ends[k]), int(ends[k + 1]), ROUND_BYTES):
                counts[k] += np.bincount(data[at : min(at + ROUND_BYTES, int(ends[k + 1]))], minlength=256) @ _CLASSES
    c = dict(zip(_SETS, counts.T))
    starts, stops, first = word_bounds(data, ends)
    words = np.diff(first)
    owner = np.repeat(np.arange(n), words)
    per = lambda flags: np.bincount(owner, flags, n)
    hashes = word_hashes(data, starts, stops)
    size = stops - starts
    before = np.zeros(len(starts), bool)
    before[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    keyed = np.sort(hashes * np.uint64(0x9E3779B97F4A7C15) ^ (owner.astype(np.uint64) << np.uint64(40))) if n == 1 else None
    if keyed is not None:
        distinct = np.array([1 + np.count_nonzero(np.diff(keyed)) if len(keyed) else 0], float)
    else:
        order = np.lexsort((hashes, owner))
        h, o = hashes[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        distinct = np.bincount(o[new], minlength=n).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, size)
    line_end = np.flatnonzero(data == 10)
    stopped = np.zeros(n)
    if len(line_end):
        good = line_end[~np.isin(line_end, ends[:-1])]  # a text's first byte has none before it
        good = good[_STOP[data[good - 1]]]
        stopped = np.bincount(np.searchsorted(ends, good, side="right") - 1, minlength=n)[:n].astype(float)
    closing = np.zeros(n)
    full = ends[1:] > ends[:-1]
    closing[full] = _STOP[data[ends[1:][full] - 1]]
    some, length = np.maximum(words, 1), np.maximum(np.diff(ends), 1)
    lines = c["newline"] + 1
    return np.column_stack(
        [
            np.log1p(words),
            per(size) / some,
            c["upper"] / length,
            c["digit"] / length,
            c["symbol"] / some,
            c["stop"] / some,
            c["comma"] / some,
            c["wide"] / length,
            np.log1p(words / lines),
            distinct / some,
            per(before) / some,
            per(_SYMBOL[data[stops - 1]] if len(stops) else np.zeros(0)) / some,
            per(_UPPER[data[starts]] if len(starts) else np.zeros(0)) / some,
            (stopped + closing) / lines,
            np.log1p(longest),
        ]
    )


@dataclass
class Ranker:
    """Weights on standardized features, the threshold and slope of the scores; as fitted, or neutral without both classes."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(FEATURES)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    threshold: float = 0.0
    slope: float = 1.0
    quantile: float | None = None

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -CLIP, CLIP)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Added up feature by feature: a document's score does not depend on which others share its batch."""
        s = np.zeros(len(x))
        for column, weight in zip(self.standard(x).T, self.weights):
            s += column * weight
        return s

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * (self.raw(x) - self.threshold))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _settled(v: np.ndarray) -> np.ndarray:
    """To ten significant digits: the order in which parts are summed leaves no trace."""
    return np.array([float(f"{a:.10g}") for a in np.atleast_1d(v)])


# ---- sums over the training documents ---------------------------------------------------------------------------------

#: Sums by two integers. A part makes them of some documents' features and labels; a total adds them up over all documents.
Sums = dict[tuple[int, int], np.ndarray]
Part = Callable[[np.ndarray, np.ndarray], Sums]

_AT = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
_BASIS = np.polynomial.chebyshev.chebvander(_AT, NODES - 1).T * np.where(np.arange(NODES) == 0, 1, 2)[:, None] / NODES


def _nodes(cell: int) -> np.ndarray:
    return (cell + (_AT + 1) / 2) * CELL


def _added(sums: Sums, more: Sums) -> Sums:
    for key, value in more.items():
        sums[key] = sums[key] + value if key in sums else value
    return sums


def _total_of_arrays(x: np.ndarray, y: np.ndarray) -> Callable[[Part], Sums]:
    def total(part: Part) -> Sums:
        sums: Sums = {}
        for at in range(0, len(x), ROUND_ROWS):
            _added(sums, part(x[at : at + ROUND_ROWS], y[at : at + ROUND_ROWS]))
        return sums

    return total


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch["features"].flatten().to_numpy().reshape(-1, len(FEATURES)), batch["quality"].to_numpy(zero_copy_only=False)


def _total_of_table(data: DataFrame) -> Callable[[Part], Sums]:
    """Each task adds up its documents; the tasks' sums meet by key."""
    kind = "a int, b int, sums array<double>"

    def rows(sums: Sums) -> list[pa.Array]:
        size = np.array([0, *(v.size for v in sums.values())]).cumsum().astype(np.int32)
        flat = np.concatenate([v.ravel() for v in sums.values()]).astype(float)
        return [*(pa.array([key[k] for key in sums], pa.int32()) for k in (0, 1)), pa.ListArray.from_arrays(size, pa.array(flat, pa.float64()))]

    def total(part: Part) -> Sums:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: Sums = {}
            for batch in batches:
                x, y = _arrays(batch)
                for at in range(0, len(x), ROUND_ROWS):
                    _added(sums, part(x[at : at + ROUND_ROWS], y[at : at + ROUND_ROWS]))
            if sums:
                yield pa.RecordBatch.from_arrays(rows(sums), ["a", "b", "sums"])

        def meet(table: pa.Table) -> pa.Table:
            values = table["sums"].combine_chunks().flatten().to_numpy().reshape(len(table), -1).sum(0)
            return pa.Table.from_arrays(rows({(table["a"][0].as_py(), table["b"][0].as_py()): values}), ["a", "b", "sums"])

        found = data.mapInArrow(run, kind).groupBy("a", "b").applyInArrow(meet, kind).collect()
        return {(r["a"], r["b"]): np.array(r["sums"]) for r in sorted(found)}

    return total


# ---- fit --------------------------------------------------------------------------------------------------------------


def _by_node(r: Ranker) -> Part:
    """For each class and cell: at each node, the sum of (1, features) times (1, features) of its documents, by the node's share in each."""

    def part(x: np.ndarray, y: np.ndarray) -> Sums:
        sums: Sums = {}
        s, full = r.raw(x), np.column_stack([np.ones(len(x)), r.standard(x)])
        cells = np.floor(s / CELL).astype(int)
        for label in (0, 1):
            for cell in np.unique(cells[y == label]):
                mine = (y == label) & (cells == cell)
                share = np.polynomial.chebyshev.chebvander(2 * (s[mine] / CELL - cell) - 1, NODES - 1) @ _BASIS
                f = full[mine]
                sums[label, int(cell)] = ((share[:, :, None] * f[:, None, :]).reshape(len(f), -1).T @ f).ravel()
        return sums

    return part


def _pair_loss(sums: Sums, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean loss of all pairs with the ridge, its gradient and its curvature."""
    size = len(w) + 1
    cells = {label: [(_nodes(cell), v.reshape(NODES, size, size)) for (own, cell), v in sums.items() if own == label] for label in (0, 1)}
    at, low = (np.concatenate(part) for part in zip(*cells[0]))
    n, x = low[:, 0, 0], low[:, 0, 1:]
    loss, gradient, curve, pairs = 0.0, np.zeros(len(w)), np.zeros((len(w), len(w))), n.sum() * sum(v[:, 0, 0].sum() for _, v in cells[1])
    for place, high in cells[1]:
        m, z = high[:, 0, 0], high[:, 0, 1:]
        gap = place[:, None] - at[None, :]
        p = _sigmoid(-gap)
        q = p * (1 - p)
        loss += m @ np.logaddexp(0, -gap) @ n
        gradient -= (p @ n) @ z - (m @ p) @ x
        cross = z.T @ q @ x
        curve += np.tensordot(q @ n, high[:, 1:, 1:], 1) + np.tensordot(m @ q, low[:, 1:, 1:], 1) - cross - cross.T
    return loss / pairs + RIDGE / 2 * w @ w, gradient / pairs + RIDGE * w, curve / pairs + RIDGE * np.eye(len(w))


def _place(gain: int, low: float | None, high: float, all_bad: int, top: float) -> float:
    """The threshold between two scores; the lowest score if all are to pass, just above the highest if none is."""
    if all_bad > gain:
        return top + 1e-6 * max(1.0, abs(top))  # far enough for a score that differs from 0.5
    middle = high if low is None else low / 2 + high / 2
    return middle if low is None or middle > low else high


def _cut_of_arrays(x: np.ndarray, y: np.ndarray) -> Callable[[Ranker], float]:
    def cut(r: Ranker) -> float:
        s, owner = np.unique(r.raw(x), return_inverse=True)
        gains = np.concatenate([[0], np.bincount(owner, (y == 0).astype(int) - (y == 1)).cumsum().astype(int)])
        best = max(range(len(s)), key=lambda k: (gains[k], s[k] - s[k - 1] if k else -1.0, s[k]))
        return _place(gains[best], s[best - 1] if best else None, s[best], gains[-1], s[-1])

    return cut


def _cut_of_table(data: DataFrame) -> Callable[[Ranker], float]:
    """Every training score in its order: ranges of scores, their counts, and running counts within them."""

    def cut(r: Ranker) -> float:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = _arrays(batch)
                yield pa.RecordBatch.from_arrays([pa.array(r.raw(x)), pa.array((y == 0).astype(int) - (y == 1))], ["s", "gain"])

        scores = data.mapInArrow(run, "s double, gain bigint").groupBy("s").agg(F.sum("gain").alias("gain"))
        ranged = stored(scores.repartitionByRange(RANGES, "s").withColumn("part", F.spark_partition_id()), "scores")
        before, inside = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("part").orderBy("s")
        parts = ranged.groupBy("part").agg(F.sum("gain").alias("gains"), F.max("s").alias("last"))
        parts = parts.select("part", F.coalesce(F.sum("gains").over(before), F.lit(0)).alias("gains"), F.max("last").over(before).alias("last"))
        found = ranged.join(F.broadcast(parts), "part").select(
            "s",
            F.col("gain").alias("own"),
            (F.col("gains") + F.sum("gain").over(inside) - F.col("gain")).alias("gain"),
            F.coalesce(F.lag("s").over(inside), F.col("last")).alias("low"),
        )
        best = F.max(F.struct("gain", F.coalesce(F.col("s") - F.col("low"), F.lit(-1.0)).alias("gap"), "s", "low")).alias("best")
        row = found.agg(best, F.sum("own").alias("all_bad"), F.max("s").alias("top")).first()
        return _place(row["best"]["gain"], row["best"]["low"], row["best"]["s"], row["all_bad"], row["top"])

    return cut


def _learn(total: Callable[[Part], Sums], cut: Callable[[Ranker], float]) -> Ranker:
    """Newton's method on the pairwise loss, the threshold, the slope. Without documents of both classes every score is 0.5."""
    first = total(lambda x, y: {(0, 0): np.array([len(x), (y == 1).sum(), (y == 0).sum(), *x.sum(0)], float)}).get((0, 0))
    if first is None or not first[1] or not first[2]:
        return Ranker()
    n, mean = first[0], first[3:] / first[0]
    scale = np.maximum(np.sqrt(total(lambda x, y: {(0, 0): ((x - mean) ** 2).sum(0)})[0, 0] / n), 1e-6)
    r = Ranker(mean=_settled(mean), scale=_settled(scale))
    r.weights = np.zeros(len(mean))
    loss, gradient, curve = _pair_loss(total(_by_node(r)), r.weights)
    for _ in range(40):
        w, step = r.weights, np.linalg.solve(curve, gradient)
        if np.abs(step).max() < 1e-8:
            r.weights = w - step
            break
        for half in range(12):
            r.weights = w - step / 2**half
            tried = _pair_loss(total(_by_node(r)), r.weights)
            if tried[0] <= loss + 1e-12:
                break
        loss, gradient, curve = tried
    r.weights = np.round(r.weights, 9)
    r.threshold = float(cut(r))
    a = 1.0
    for _ in range(60):

        def part(x: np.ndarray, y: np.ndarray, a=a) -> Sums:
            u = r.raw(x) - r.threshold
            p = _sigmoid(a * u)
            return {(0, 0): np.array([((p - (y == 1)) * u).sum(), (p * (1 - p) * u * u).sum(), (u < 0).sum()], float)}

        g, h, below = total(part)[0, 0] / n
        r.quantile = float(below)
        old, a = a, float(np.clip(a - (g + SLOPE_RIDGE * a) / (h + SLOPE_RIDGE), a / 2, a * 2))
        if abs(a - old) < 1e-9 * old:
            break
    r.slope = max(float(_settled(a)[0]), 1e-3)
    return r


def fit(x: np.ndarray, y: np.ndarray) -> Ranker:
    """The fit of train() on arrays of features and labels."""
    return _learn(_total_of_arrays(x, y), _cut_of_arrays(x, y))


def featurize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranker: Ranker | None = None) -> DataFrame:
    """doc_id and features (array<double>), or doc_id and score with a ranker."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rounds(batches, "_text"):
            x = text_features(*string_buffers(batch["_text"]))
            if ranker is not None:
                out = pa.array(ranker.score(x), pa.float64())
            else:
                out = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["_id"], out], ["doc_id", "score" if ranker is not None else "features"])

    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = dict(named.dtypes)["_id"]
    return named.mapInArrow(run, f"doc_id {kind}, " + ("score double" if ranker is not None else "features array<double>"))


def held_out(doc_id="doc_id"):
    """Whether a document's label is kept from the fit."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Fits on all labelled documents that are not held out. Of several labels of an id the smallest counts, of several texts one; a
    null label or id is none. Features, not texts, meet the labels."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))
    first = featurize(docs.where(F.col("doc_id").isNotNull() & ~held_out())).groupBy("doc_id").agg(F.min("features").alias("features"))
    with scratch(docs.sparkSession):
        data = stored(first.join(chosen, "doc_id").select("features", "quality"), "training")
        return _learn(_total_of_table(data), _cut_of_table(data))


def classify(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, held_out, score, predicted of each row. A null text is scored as an empty one, repeated rows each get a row, a null
    id counts as not held out; other columns are ignored."""
    return featurize(docs, ranker=ranker).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, ranker: Ranker, columns: list[str]) -> DataFrame:
    """The rows of `docs` that score 0.5 or more, with the given columns."""
    ship(docs.sparkSession)
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rounds(batches, "text"):
            good = ranker.score(text_features(*string_buffers(batch["text"]))) >= 0.5
            yield batch.filter(pa.array(good))

    picked = docs.select(*names)
    return picked.mapInArrow(run, picked.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, train(docs, labels))
