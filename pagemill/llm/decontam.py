"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of PASSAGE words, each overlapping the next by half. Passages and benchmark items are TF-IDF vectors over the
items' words (bounded by the benchmark; document frequencies count all passages). A distributed randomised SVD of the passage
matrix gives a latent space: each of a bounded number of tasks adds up its share of A'A times a thin matrix, the shares are summed by
Spark, and only matrices of the vocabulary's size reach the driver. Passages whose cosine to an item reaches COSINE are its candidates. Those are
confirmed by the longest common subsequence of words, and in doubt by the item's answer (its last sentence) being there too. Long items are
searched for by their parts, and compared with as many words on both sides of the passage as the item has.

Frequent terms have no weight in that search. An item that owes them half of its length or more, as it is copied all over the table or made of common
words, is searched for by its words themselves: every window that holds as many of them as a leak must is compared.

A benchmark is a stated set of items, taken in blocks. MAX_BLOCKS of them at a time are fitted, broadcast and searched for, which bounds what the driver
and the workers hold; a larger benchmark takes a pass for each group, and what the passes find meets by the digests of the leaking texts. Documents
are read without a shuffle in every pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import rounds, ship, stored, string_buffers, word_bounds, word_hashes

PASSAGE, STRIDE = 64, 32
RANK, EXTRA = 208, 16
#: Words of an item's part at most: of a longer one a passage would have too small a share to be near it.
PART = 128
#: Items (parts, if they are long) of one block at most, no more than the space has dimensions, and words: term numbers fit 16 bits.
BLOCK_ITEMS, BLOCK_WORDS = 208, 60_000
#: Blocks that one pass takes: what it broadcasts is bounded by them (about 25 MB each).
MAX_BLOCKS = 16
#: Tasks that add up matrices of the vocabulary's size, at most: what they shuffle does not grow with the table.
PARTIALS = 4096
#: The power of the inverse document frequency's logarithm that terms weigh.
DAMPING = 2.0
#: Entries of the sparse matrix that one product takes, about.
ENTRIES = 2000
#: Entries of a unit row below this are left out of it. A row of 64 words loses a fortieth of its squared length at most; one of common words alone loses none.
FAINT = 0.02
#: The cosine that a whole copy of an item is to have to a passage whose other words weigh PLENTY times what a passage's words weigh on average, if the
#: search by cosine is to be trusted with it; items below are searched for exactly.
TRUSTED, PLENTY = 0.4, 2.0
#: How much the items' own rows weigh in the decomposition, against all passages together; 0: the space is the passages' alone, whose leading directions are
#: those of common words: on the 0.1 table none of 246 leaks is found in it, and all with the items' rows.
ITEM_WEIGHT = 1.0
#: Candidates; then the share of an item's words in common order that is a leak, or is one together with the answer.
COSINE, LEAK, PARAPHRASE = 0.2, 0.7, 0.5
#: An answer shorter than this many words decides nothing; an item shorter than SHORT must occur word by word.
ANSWER_WORDS, SHORT = 3, 8

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[0x41:0x5B] += 0x20
_PLAIN[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 0x20


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words without case and ASCII punctuation, and each text's first."""
    plain = _PLAIN[data]
    starts, stops, first = word_bounds(plain, ends)
    return word_hashes(plain, starts, stops), first


def _text_words(texts: list[str]) -> list[np.ndarray]:
    words, first = _words(*string_buffers(pa.array(texts, pa.string())))
    return [words[a:b] for a, b in zip(first[:-1], first[1:])]


def _answer(text: str) -> str:
    """The last sentence that has words."""
    parts = [p for p in text.replace("!", ".").replace("?", ".").replace("\n", ".").split(".") if any(c.isalnum() for c in p)]
    return parts[-1] if len(parts) > 1 else ""


def _parts(n: int) -> int:
    return -(-n // PART)


@dataclass
class Block:
    """Benchmark items as term numbers, their parts and whose they are, and the latent space once it is fitted."""

    ids: list
    vocabulary: np.ndarray
    items: list[np.ndarray]
    answers: list[np.ndarray]
    parts: list[np.ndarray]
    owner: np.ndarray
    weight: np.ndarray | None = None
    axes: np.ndarray | None = None
    latent: np.ndarray | None = None
    hot: np.ndarray | None = None

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Block:
        words, answers = _text_words([t for _, t in rows]), _text_words([_answer(t) for _, t in rows])
        vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        number = lambda ws: [np.searchsorted(vocabulary, w) for w in ws]
        items = number(words)
        parts = [np.array_split(i, _parts(len(i))) for i in items]
        owner = np.repeat(np.arange(len(items)), [len(p) for p in parts])
        return cls([i for i, _ in rows], vocabulary, items, number(answers), [p for ps in parts for p in ps], owner)

    def terms(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are in the vocabulary, and their numbers there."""
        return _numbered(self.vocabulary, words)


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark's items in order of their ids, a bounded number at a time. Null texts and texts without words are no items. An item with a null id is
    one, and is reported as null, after the others; texts of one id are items of their own."""
    rows, size, parts = [], 0, 0
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        n = len(_text_words([r["text"]])[0])
        if not n:
            continue
        if rows and (parts + _parts(n) > BLOCK_ITEMS or size + n > BLOCK_WORDS):
            yield Block.of(rows)
            rows, size, parts = [], 0, 0
        rows.append((r["item_id"], r["text"]))
        size += n
        parts += _parts(n)
    if rows:
        yield Block.of(rows)


def _passages(first: np.ndarray, found: np.ndarray, terms: np.ndarray, v: int, stride: int = STRIDE):
    """Passages of all texts (of two strides), numbered through: each text's first, and the distinct (passage, term) with how often."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - stride) // stride))
    begin = np.append(0, np.cumsum(count))
    text = np.searchsorted(first[1:], found, side="right")
    q = (found - first[text]) // stride
    p, t = [], []
    for back in (0, 1):
        ok = (q - back >= 0) & (q - back < count[text])
        p.append((begin[text] + q - back)[ok])
        t.append(terms[ok])
    key, times = np.unique(np.concatenate(p) * v + np.concatenate(t), return_counts=True)
    return begin, key // v, key % v, times


def _weighted(passage: np.ndarray, term: np.ndarray, times: np.ndarray, weight: np.ndarray):
    """Unit TF-IDF rows as (passage, term, value), without what is faint in its own row."""
    value = (1 + np.log(times)) * weight[term]
    keep = value > 0
    passage, term, value = passage[keep], term[keep], value[keep]
    if not len(value):
        return passage, term, value.astype(np.float32), passage
    first = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    norm = np.sqrt(np.add.reduceat(value * value, first))
    value = (value / np.repeat(norm, np.diff(np.append(first, len(value))))).astype(np.float32)
    keep = value >= FAINT
    passage, term, value = passage[keep], term[keep], value[keep]
    return passage, term, value, np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))


def _times_dense(term: np.ndarray, value: np.ndarray, first: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Rows of the sparse matrix times a dense one: rows of about one length at a time as one batched product, a bounded number of entries; a longer row by pieces."""
    ends = np.append(first[1:], len(term))
    order = np.argsort(ends - first, kind="stable")
    sizes = (ends - first)[order]
    out = np.empty((len(first), dense.shape[1]), np.float32)
    at = 0
    while at < len(order):
        n = int(sizes[at])
        if n > ENTRIES:
            k = order[at]
            out[k] = sum(value[s : min(s + ENTRIES, ends[k])] @ dense[term[s : min(s + ENTRIES, ends[k])]] for s in range(first[k], ends[k], ENTRIES))
            at += 1
            continue
        stop = min(at + max(1, ENTRIES // max(n, 1)), int(np.searchsorted(sizes, min(2 * n + 8, ENTRIES), side="right")))
        rows = order[at:stop]
        place = np.arange(sizes[stop - 1])
        inside = place < sizes[at:stop, None]
        place = np.where(inside, first[rows][:, None] + place, first[rows][:, None])
        out[rows] = np.matmul(np.where(inside, value[place], np.float32(0))[:, None, :], dense[term[place]])[:, 0]
        at = stop
    return out


def _summed(parts: DataFrame, n: int, width: int) -> np.ndarray:
    """The sums of rows (i, v) by i as a matrix; at most one row per term reaches the driver."""
    rows = parts.groupBy("i").agg(*[F.sum(F.col("v")[k].cast("double")).alias(f"v{k}") for k in range(width)]).toArrow()
    out = np.zeros((n, width))
    if rows.num_rows:
        out[rows["i"].to_numpy()] = np.column_stack([rows[f"v{k}"].to_numpy() for k in range(width)])
    return out


_PART = "i int, v array<float>"


def _part(matrix: np.ndarray, which: np.ndarray) -> Iterator[pa.RecordBatch]:
    for s in range(0, len(which), 5000):
        w = which[s : s + 5000]
        values = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * matrix.shape[1], pa.array(matrix[w].astype(np.float32).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), values], ["i", "v"])


def _term_table(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """For a number of texts at a time: where words of the vocabulary stand, and the texts' first words. Written once for all blocks of a pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rounds(batches):
            words, first = _words(*string_buffers(batch["text"]))
            found, terms = _numbered(vocabulary, words)
            packed = [first.astype(np.uint32), found.astype(np.uint32), terms.astype(_term_type(len(vocabulary)))]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in packed], ["first", "found", "terms"])

    return docs.select("text").mapInArrow(run, "first binary, found binary, terms binary")


def _numbered(vocabulary: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the words are in the vocabulary, and their numbers there."""
    at = np.searchsorted(vocabulary, words)
    at[at == len(vocabulary)] = 0
    found = np.flatnonzero(vocabulary[at] == words)
    return found, at[found]


def _term_type(v: int) -> type:
    """16 bits where they are enough."""
    return np.uint16 if v <= 1 << 16 else np.uint32


def _unpacked(batches: Iterator[pa.RecordBatch], v: int, number: np.ndarray | None = None):
    """Each text's first word, the places of the words found, and their terms: as in the table, or as `number` has them, without those it has as -1."""
    for batch in batches:
        for f, w, t in zip(batch["first"], batch["found"], batch["terms"]):
            first, found = (np.frombuffer(x.as_py(), np.uint32).astype(np.int64) for x in (f, w))
            terms = np.frombuffer(t.as_py(), _term_type(v)).astype(np.int64)
            if number is not None:
                terms = number[terms]
                found, terms = found[terms >= 0], terms[terms >= 0]
            yield first, found, terms


def _frequencies(table: DataFrame, v: int) -> tuple[np.ndarray, float]:
    """How many passages have each term, and how many there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((v + 1, 1))
        for first, found, terms in _unpacked(batches, v):
            begin, _, term, _ = _passages(first, found, terms, v)
            total[:v, 0] += np.bincount(term, minlength=v)
            total[v] += begin[-1]
        # shares of 2**20 or more lose their last digits as floats: two summands
        high = np.floor(total / 2**20)
        yield from _part(np.column_stack([high, total - high * 2**20]), np.flatnonzero(total[:, 0]))

    counted = _summed(table.mapInArrow(count, _PART), v + 1, 2)
    df = counted[:, 0] * 2.0**20 + counted[:, 1]
    return df[:v], max(df[v], 1.0)


def fit(table: DataFrame, vocabulary: np.ndarray, df: np.ndarray, n: float, block: Block, rank: int = RANK, seed: int = 11, item_weight: float = ITEM_WEIGHT) -> Block:
    """Term weights from all passages, then the latent space: a randomised range finder and the eigenvectors inside it.

    table: where the words of `vocabulary` stand; df and n: passages of each word, and of all. The block's vocabulary is part of it.
    """
    v, whole = len(block.vocabulary), len(vocabulary)
    own_terms = np.searchsorted(vocabulary, block.vocabulary)
    number = np.full(whole, -1, np.int64)
    number[own_terms] = np.arange(v)
    df = df[own_terms]
    weight = block.weight = np.log1p(n / np.maximum(df, 1.0)) ** DAMPING
    usual = PLENTY * (df * weight**2).sum() / n
    lengths = np.array([(weight[np.unique(i)] ** 2).sum() for i in block.items])
    block.hot = lengths < TRUSTED**2 * (lengths + usual)
    width = min(rank + EXTRA, v)
    sizes = [np.unique(i, return_counts=True) for i in block.parts]
    own = _weighted(np.repeat(np.arange(len(sizes)), [len(t) for t, _ in sizes]), np.concatenate([t for t, _ in sizes]), np.concatenate([c for _, c in sizes]), weight)

    def gram(dense: np.ndarray) -> np.ndarray:
        """A'A times a thin matrix, A being the passages and, so far as they weigh, the items' parts."""
        thin = dense.astype(np.float32)

        def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((v, thin.shape[1]), np.float32)
            for first, found, terms in _unpacked(batches, whole, number):
                _, passage, term, times = _passages(first, found, terms, v)
                add(total, *_weighted(passage, term, times, weight))
            yield from _part(total, np.flatnonzero(total.any(1)))

        def add(total, passage, term, value, first):
            if not len(value):
                return
            z = _times_dense(term, value, first, thin)
            row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(value))))
            order = np.argsort(term, kind="stable")
            t = term[order]
            f = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            total[t[f]] += _times_dense(row[order], value[order], f, z)

        out = _summed(table.mapInArrow(share, _PART), v, thin.shape[1])
        if item_weight:
            mine = np.zeros((v, thin.shape[1]), np.float32)
            add(mine, *own)
            out += mine * (item_weight * max(1.0, n / len(block.parts)))
        return out

    # one pass over the passages: the eigenvectors of A'A by Nystroem's formula from Y = A'A test
    test = np.linalg.qr(np.random.default_rng(seed).standard_normal((v, width)))[0]
    y = gram(test)
    shift = 1e-7 * np.linalg.norm(y) + 1e-30
    y += shift * test
    core = test.T @ y
    root = np.linalg.cholesky((core + core.T) / 2 + 1e-12 * np.trace(core) * np.eye(width))
    vectors = np.linalg.svd(np.linalg.solve(root, y.T).T, full_matrices=False)[0]
    block.axes = np.ascontiguousarray(vectors[:, : min(rank, width)], np.float32)
    latent = np.zeros((len(block.parts), block.axes.shape[1]), np.float32)
    if len(own[3]):
        latent[own[0][own[3]]] = _times_dense(own[1], own[2], own[3], block.axes)
    block.latent = latent
    return block


def common(masks: dict[int, int], length: int, terms) -> int:
    """Length of the longest common subsequence, with one bit for each of the item's words."""
    ones = (1 << length) - 1
    row = ones
    for t in terms:
        m = masks.get(t)
        if m is not None:
            u = row & m
            row = (row + u | row - u) & ones
    return length - row.bit_count()


class Judge:
    def __init__(self, block: Block):
        self.block = block
        self.masks, self.answers = [], []
        for sequences, out in ((block.items, self.masks), (block.answers, self.answers)):
            for s in sequences:
                masks: dict[int, int] = {}
                for k, t in enumerate(s.tolist()):
                    masks[t] = masks.get(t, 0) | 1 << k
                out.append(masks)

    def confirmed(self, item: int, at: np.ndarray, terms: np.ndarray) -> float:
        """The share of the item's words in common order if that is a leak, else 0; at: the words' places."""
        n = len(self.block.items[item])
        if n < SHORT:
            where = at[: len(at) - n + 1][(np.lib.stride_tricks.sliding_window_view(terms, n) == self.block.items[item]).all(1)] if len(at) >= n else []
            ends = set(at.tolist())
            return 1.0 if any(all(w + k in ends for k in range(n)) for w in where) else 0.0
        share = common(self.masks[item], n, terms.tolist()) / n
        if share >= LEAK:
            return share
        a = len(self.block.answers[item])
        if share >= PARAPHRASE and a >= ANSWER_WORDS and common(self.answers[item], a, terms.tolist()) == a:
            return share
        return 0.0

    def judge(self, words: np.ndarray, first: np.ndarray) -> list[dict[int, float]]:
        """For each text its leaked items (by place in the block) and the largest share found."""
        out: list[dict[int, float]] = [{} for _ in range(len(first) - 1)]
        found, terms = self.block.terms(words)
        if not len(found):
            return out
        for d, i, low, high in chain(self._near(first, found, terms), self._held(first, found, terms)):
            if out[d].get(i, 0.0) < 1.0:
                share = self.confirmed(i, found[low:high], terms[low:high])
                if share > out[d].get(i, 0.0):
                    out[d][i] = share
        return out

    def _near(self, first: np.ndarray, found: np.ndarray, terms: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Candidates of the latent search: text, item, and which of the found words are to be compared."""
        b = self.block
        begin, passage, term, times = _passages(first, found, terms, len(b.vocabulary))
        p, t, value, starts = _weighted(passage, term, times, b.weight)
        sizes = np.array([len(i) for i in b.items], np.int64)
        steps = np.maximum(1, sizes // (4 * STRIDE))
        for s in range(0, len(starts), 8192):
            e = min(s + 8192, len(starts))
            stop = starts[e] if e < len(starts) else len(t)
            z = _times_dense(t[starts[s] : stop], value[starts[s] : stop], starts[s:e] - starts[s], b.axes)
            near, part = np.nonzero(z @ b.latent.T >= COSINE)
            number, item = p[starts[s:e][near]], b.owner[part]
            text = np.searchsorted(begin, number, side="right") - 1
            # of a long item's many passages in a row some are compared for all, with that much more on both sides
            place = (number - begin[text]) // steps[item] * steps[item]
            text, item, place = np.unique(np.column_stack([text, item, place]), axis=0).T
            low, reach = first[text] + place * STRIDE, np.maximum(STRIDE, sizes[item])
            a = np.searchsorted(found, np.maximum(low - reach, first[text]))
            z_ = np.searchsorted(found, np.minimum(low + PASSAGE + (steps[item] - 1) * STRIDE + reach, first[text + 1]))
            yield from zip(text.tolist(), item.tolist(), a.tolist(), z_.tolist())

    def _held(self, first: np.ndarray, found: np.ndarray, terms: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """The same for hot items: all windows that hold as many of an item's words as a leak must. A window's second half is the first of
        the next, so that half as many words again as the item has are in one window wherever they stand."""
        b, v = self.block, len(self.block.vocabulary)
        hot = np.flatnonzero(b.hot)
        n = np.array([len(b.items[i]) for i in hot], np.int64)
        # windows are no wider than three times the item, or chance would fill half of a short one
        halves = -(-3 * n // 32) * 16
        for half in np.unique(halves).tolist():
            begin, passage, term, times = _passages(first, found, terms, v, half)
            for i in hot[halves == half].tolist():
                size = len(b.items[i])
                have = np.minimum(times, np.bincount(b.items[i], minlength=v)[term])
                number = np.flatnonzero(np.bincount(passage, have, begin[-1]) >= (size if size < SHORT else PARAPHRASE * size))
                text = np.searchsorted(begin, number, side="right") - 1
                low = first[text] + (number - begin[text]) * half
                a, z = np.searchsorted(found, low), np.searchsorted(found, np.minimum(low + 2 * half, first[text + 1]))
                yield from zip(text.tolist(), [i] * len(text), a.tolist(), z.tolist())


def fitted(docs: DataFrame, benchmark: DataFrame, **options) -> Iterator[Block]:
    """The benchmark's blocks, each fitted when it is asked for; those of one pass from one table of terms. options: of fit()."""
    ship(docs.sparkSession)
    left = blocks(benchmark)
    while group := list(islice(left, MAX_BLOCKS)):
        vocabulary = np.unique(np.concatenate([b.vocabulary for b in group]))
        table = stored(_term_table(docs, vocabulary), "terms").coalesce(PARTIALS)
        df, n = _frequencies(table, len(vocabulary))
        for block in group:
            yield fit(table, vocabulary, df, n, block, **options)


def _groups(models: Iterable[Block]) -> Iterator[tuple[list[Block], bool]]:
    """MAX_BLOCKS blocks at a time, and if they are the last; without blocks one empty group. No group is held while the next is made."""
    left = iter(models)
    group = list(islice(left, MAX_BLOCKS))
    while group is not None:
        after = next(left, None)
        yield group, after is None
        group = None
        if after is not None:
            group = [after, *islice(left, MAX_BLOCKS - 1)]


_FINDINGS = "item_ids array<bigint>, share double"


def _columns(found: list[dict[int, float]]) -> list[pa.Array]:
    ordered = lambda x: sorted(x, key=lambda i: (i is None, i or 0))
    return [pa.array([ordered(x) for x in found], pa.list_(pa.int64())), pa.array([max(x.values(), default=0.0) for x in found], pa.float64())]


def _leaking(docs: DataFrame, groups: Iterable[tuple[list[Block], bool]]) -> DataFrame:
    """digest (of the text), item_ids and share of every leaking text, one pass over the documents for each group of blocks."""
    spark = docs.sparkSession
    texts = docs.where("text IS NOT NULL").select(F.md5("text").alias("digest"), "text")
    parts = []
    for group, _ in groups:
        shared = spark.sparkContext.broadcast(group)
        del group

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            judges = [Judge(b) for b in shared.value]
            for batch in rounds(batches):
                found = _found(judges, batch["text"])
                leak = pa.array([bool(x) for x in found], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch["digest"], *_columns(found)], ["digest", "item_ids", "share"]).filter(leak)

        parts.append(stored(texts.mapInArrow(run, f"digest string, {_FINDINGS}").distinct(), "leaking"))
        shared.destroy()
    every = reduce(DataFrame.union, parts)
    return every.groupBy("digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("share").alias("share"))


def leaks(docs: DataFrame, models: Iterable[Block]) -> DataFrame:
    """doc_id, contaminated, item_ids (ascending) and share (the largest part of an item found) for every row of `docs`.

    Null and empty texts are clean, and so is everything where the benchmark has no items. Repeated rows are judged one by one; other
    columns are ignored; an empty table gives an empty one. An item with a null id is reported as null, last; of several texts of one id the largest share
    counts.
    """
    spark = docs.sparkSession
    ship(spark)
    groups = _groups(models)
    group, last = next(groups)
    if not last:
        groups = chain([(group, last)], groups)
        del group
        found = _leaking(docs, groups)
        rows = docs.select("doc_id", F.md5("text").alias("digest")).join(found, "digest", "left")
        return rows.select(
            "doc_id",
            F.col("share").isNotNull().alias("contaminated"),
            F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
            F.coalesce("share", F.lit(0.0)).alias("share"),
        )
    shared = spark.sparkContext.broadcast(group)  # vocabularies, axes and items of the benchmark: bounded by its blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges = [Judge(b) for b in shared.value]
        for batch in rounds(batches):
            found = _found(judges, batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([bool(x) for x in found]), *_columns(found)], ["doc_id", "contaminated", "item_ids", "share"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, contaminated boolean, {_FINDINGS}")


def _found(judges: list[Judge], texts: pa.Array) -> list[dict[int, float]]:
    words, first = _words(*string_buffers(texts))
    out: list[dict[int, float]] = [{} for _ in range(len(texts))]
    for j in judges:
        for d, hits in enumerate(j.judge(words, first)):
            for i, share in hits.items():  # an id may have several texts: the largest share counts
                out[d][j.block.ids[i]] = max(share, out[d].get(j.block.ids[i], 0.0))
    return out


def keep_clean(docs: DataFrame, models: Iterable[Block]) -> DataFrame:
    """The rows of `docs` without leaks, all columns."""
    ship(docs.sparkSession)
    groups = _groups(models)
    group, last = next(groups)
    if not last:
        groups = chain([(group, last)], groups)
        del group
        found = _leaking(docs, groups).select("digest")
        return docs.join(found, F.md5(docs["text"]) == found["digest"], "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges = [Judge(b) for b in shared.value]
        for batch in rounds(batches):
            yield batch.filter(pa.array([not x for x in _found(judges, batch["text"])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, fitted(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
