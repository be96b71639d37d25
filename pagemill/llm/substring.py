"""Substring dedup: FM-indexes of shards find the word windows that a document shares with an earlier one.

A window is WINDOW consecutive words. It goes from a document if its word sequence also starts in a document with a smaller
doc_id. Work is in proportion to the text, whatever the number of shards:

1. every window has an anchor, the least hash among its short word runs. Equal windows have equal anchors, so a window whose
   anchor occurs in one text only is unique. Anchors are counted with a pre-aggregated minimum and maximum of texts' hashes;
   rows that repeat a whole text are settled by its hash and take no further part;
2. documents with shared anchors cut out the stretches around those. Windows that repeat within a batch are settled there,
   and all but one leave; the others go to the shard of their anchor. Windows with a very frequent anchor travel by
   themselves, by their own hash, so that no anchor gathers a large part of the table in one task. They need no index: a task remembers the smallest doc_id
   that it has seen of each and settles what is larger, so that few rows of a window leave it however many texts have it, and the shard streams those in the order
   of doc_id and holds the first;
3. a shard indexes its stretches, a bounded number of symbols at a time (equal keys stay together), and streams them through
   backward search on the wavelet tree. That gives each window's matching statistic; where it reaches WINDOW the smallest
   doc_id of the interval decides;
4. intervals return to their documents, which drop the words covered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import gram_hashes, mix, of_classes, rounds, ship, stored, string_buffers, word_bounds, word_hashes
from pagemill.llm.fmindex import FMIndex

WINDOW = 13
#: Words of the runs that anchors are chosen among.
RUN = 6
#: Windows of an anchor that more rows have travel one by one.
FREQUENT = 4096
#: Frequent windows that a task remembers; those beyond travel each time.
REMEMBERED = 1 << 20
#: A shard's index holds about so many symbols at a time; equal keys are never split.
BLOCK = 1_500_000
#: Bytes of a word's hash that travel.
WIDTH = 6


def _hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, ends = string_buffers(batch["text"])
    starts, stops, first = word_bounds(data, ends)
    return data, starts, stops, first, word_hashes(data, starts, stops)


def _content(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's word sequence."""
    place = (np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64)
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(mix(words + mix(place + np.uint64(salt))), dtype=np.uint64))
        out.append(mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _window_anchors(words: np.ndarray, first: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position of each window's first word, its document's index in the batch and its anchor."""
    size = np.diff(first)
    count = np.maximum(size - window + 1, 0)
    doc = np.repeat(np.arange(len(size)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][doc]
    if not len(at):
        return at, doc, np.zeros(0, np.uint64)
    least = gram_hashes(words, run)
    have, want = 1, window - run + 1
    while have < want:  # the least of `want` neighbours from the least of `have`
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return at, doc, least[at]


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and two hashes of the word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rounds(batches):
            *_, first, words = _hashed(batch)
            h1, h2 = _content(words, first)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(first)), pa.array(h1), pa.array(h2)], ["doc_id", "n_words", "h1", "h2"])

    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, h1 bigint, h2 bigint")


def anchors(docs: DataFrame, window: int, run: int) -> DataFrame:
    """anchor and h1 of every text; of equal texts in a task one takes part."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in rounds(batches):
            *_, first, words = _hashed(batch)
            h1, _ = _content(words, first)
            fresh = np.zeros(len(h1), bool)
            for k, h in enumerate(h1.tolist()):
                if h not in known:
                    known.add(h)
                    fresh[k] = True
            _, doc, anchor = _window_anchors(words, first, window, run)
            new = np.ones(len(doc), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            new &= fresh[doc]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[new].view(np.int64)), pa.array(h1[doc[new]])], ["anchor", "h1"])

    return docs.mapInArrow(find, "anchor bigint, h1 bigint")


_STRETCH = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("h1", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("words", pa.binary()), ("alone", pa.bool_())])
_STRETCH_SQL = "key bigint, doc_id bigint, h1 bigint, start bigint, stop bigint, words binary, alone boolean"


def _runs(start: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of windows that follow one another."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(start), bool)
    new[1:] = ~same | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(start)) - 1


class Smallest:
    """The smallest doc_id of each window seen so far, of a bounded number of windows."""

    def __init__(self):
        self.windows, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def settled(self, windows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of the windows (distinct) have a smaller doc_id already."""
        place = np.searchsorted(self.windows, windows)
        old = place < len(self.windows)
        old[old] = self.windows[place[old]] == windows[old]
        out = np.zeros(len(windows), bool)
        out[old] = self.ids[place[old]] < ids[old]
        self.ids[place[old]] = np.minimum(self.ids[place[old]], ids[old])
        new = np.flatnonzero(~old)
        new = new[np.unique(windows[new], return_index=True)[1]][: max(0, REMEMBERED - len(self.windows))]
        if len(new):
            merged = np.concatenate([self.windows, windows[new]])
            order = np.argsort(merged, kind="stable")
            self.windows, self.ids = merged[order], np.concatenate([self.ids, ids[new]])[order]
        return out


def stretches(found: DataFrame, window: int, run: int, frequent: int) -> DataFrame:
    """From documents with their shared anchors: stretches of words for the shards, frequent windows (alone), and (words null) intervals that a smaller
    doc_id of the same batch, or for frequent windows of the same task, has already settled."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Smallest()
        for batch in rounds(batches, limit=6 << 20):
            *_, first, words = _hashed(batch)
            h1, _ = _content(words, first)
            ids = np.asarray(batch["doc_id"], dtype=np.int64)
            at, doc, anchor = _window_anchors(words, first, window, run)
            lists = batch["anchors"]
            lists = lists.slice(0)
            flat = lists.flatten()
            values = np.asarray(flat.field("anchor"), dtype=np.int64).view(np.uint64)
            numbers = np.asarray(flat.field("n"), dtype=np.int64)
            owner = np.repeat(np.arange(len(ids)), np.diff(np.asarray(lists.offsets)))
            salt = lambda v, d: mix(v + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            listed = salt(values, owner)
            order = np.argsort(listed)
            listed, numbers = listed[order], numbers[order]
            asked = salt(anchor, doc)
            place = np.minimum(np.searchsorted(listed, asked), max(len(listed) - 1, 0))
            pick = np.flatnonzero(listed[place] == asked) if len(listed) else np.zeros(0, np.int64)
            at, doc, anchor, number = at[pick], doc[pick], anchor[pick], numbers[place[pick]] if len(pick) else np.zeros(0, np.int64)
            if not len(at):
                continue
            whole = gram_hashes(words, window)[at]
            # settled here: the same window in a smaller doc_id of this batch
            order = np.lexsort((ids[doc], whole))
            w, d = whole[order], ids[doc][order]
            new = np.ones(len(w), bool)
            new[1:] = w[1:] != w[:-1]
            least = d[new][np.cumsum(new) - 1]
            gone = np.zeros(len(w), bool)
            gone[order] = d > least
            often = np.flatnonzero((number > frequent) & ~gone)
            gone[often] = known.settled(whole[often], ids[doc[often]])
            for settled in (True, False):
                sub = np.flatnonzero(gone == settled)
                if not len(sub):
                    continue
                a, o = at[sub], doc[sub]
                alone = number[sub] > frequent if not settled else np.zeros(len(sub), bool)
                key = np.where(alone, whole[sub], anchor[sub]) if not settled else np.zeros(len(sub), np.uint64)
                f, l = _runs(a, (o[1:] == o[:-1]) & (key[1:] == key[:-1]) & ~alone[1:])  # noqa: E741
                start, stop = a[f], a[l] + window
                o = o[f]
                base = first[:-1][o]
                if settled:
                    columns = [pa.array(mix(ids[o].view(np.uint64)).view(np.int64)), None]
                    packed = pa.nulls(len(o), pa.binary())
                else:
                    columns = [pa.array(key[f].view(np.int64)), None]
                    size = stop - start
                    index = np.repeat(start - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                    data = np.ascontiguousarray(words[index].view(np.uint8).reshape(-1, 8)[:, :WIDTH])
                    offsets = (np.append(0, np.cumsum(size)) * WIDTH).astype(np.int32)
                    packed = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                for s in range(0, len(o), 20_000):
                    e = slice(s, s + 20_000)
                    yield pa.RecordBatch.from_arrays(
                        [columns[0][e], pa.array(ids[o[e]]), pa.array(h1[o[e]]), pa.array((start - base)[e]), pa.array((stop - base)[e]), packed[e], pa.array(alone[f][e])],
                        schema=_STRETCH,
                    )

    return found.mapInArrow(cut, _STRETCH_SQL)


def match_block(key: np.ndarray, doc: np.ndarray, size: np.ndarray, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a shard's block, and for each run of windows that a smaller doc_id has too: row, first window and last in the row.

    Equal stretches are indexed once, with their smallest doc_id.
    """
    at = np.append(0, np.cumsum(size))
    symbols = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    sigma = int(symbols.max()) + 1
    place = (np.arange(len(words)) - np.repeat(at[:-1], size)).astype(np.uint64)
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(mix(words + mix(place)), dtype=np.uint64))
    content = mix(sums[at[1:]] - sums[at[:-1]] + size.astype(np.uint64) + mix(key.view(np.uint64)))
    _, sample, group = np.unique(content, return_index=True, return_inverse=True)
    least = np.full(len(sample), np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc)
    length = size[sample]
    begin = np.append(0, np.cumsum(length + 1))  # each text is closed by 0
    text = np.zeros(begin[-1], np.int64)
    owner = np.repeat(np.arange(len(sample)), length)
    inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    text[begin[:-1][owner] + inner] = symbols[at[:-1][sample][owner] + inner]
    in_text = np.repeat(np.arange(len(sample)), length + 1)
    index = FMIndex(text, sigma, window, in_text)
    count = length - window + 1
    which = np.repeat(np.arange(len(sample)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    matched, low, high = index.search(text, begin[:-1][which] + offset + window, window)
    # the smallest doc_id among an interval's texts; intervals of whole windows are equal or apart
    best = np.append(least[index.owners], np.iinfo(np.int64).max)
    first = least[which].copy()
    full = np.flatnonzero(matched == window)
    if len(full):
        l, back = np.unique(low[full], return_inverse=True)  # noqa: E741
        h = np.zeros(len(l), np.int64)
        h[back] = high[full]
        first[full] = np.minimum.reduceat(best, np.column_stack([l, h]).ravel())[::2][back]
    # every row against the windows of its text
    n = count[group]
    row = np.repeat(np.arange(len(doc)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    shared = np.flatnonzero(first[np.append(0, np.cumsum(count))[:-1][group[row]] + offset] < doc[row])
    row, offset = row[shared], offset[shared]
    f, l = _runs(offset, row[1:] == row[:-1])  # noqa: E741
    return row[f], offset[f], offset[l]


def intervals(cut: DataFrame, window: int, shards: int, block: int) -> DataFrame:
    """doc_id, h1, start and stop (words) of what goes, from every shard."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "h1", "start", "stop"]
        held: list[pa.RecordBatch] = []
        symbols = 0
        last, smallest = None, {}

        def first_of(batch: pa.RecordBatch) -> pa.RecordBatch:
            """Of frequent windows in the order of key and doc_id those with a smaller doc_id; one key's words are held."""
            nonlocal last, smallest
            late = []
            for n, (key, doc, words) in enumerate(zip(*(batch[c].to_pylist() for c in ("key", "doc_id", "words")))):
                if key != last:
                    last, smallest = key, {}
                if smallest.setdefault(words, doc) < doc:
                    late.append(n)
            return batch.take(pa.array(late, pa.int64())).select(names)

        def flush(parts: list[pa.RecordBatch]):
            table = pa.Table.from_batches(parts).combine_chunks()
            key, doc, h1, start = (table[c].to_numpy() for c in ("key", "doc_id", "h1", "start"))
            packed = table["words"].combine_chunks()
            packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
            offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
            raw = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, WIDTH)
            words = np.zeros((len(raw), 8), np.uint8)
            words[:, :WIDTH] = raw
            row, low, high = match_block(key, doc, np.diff(offsets) // WIDTH, words.view(np.uint64).ravel(), window)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[row], h1[row], start[row] + low, start[row] + high + window)], names)

        for batch in batches:
            known = batch.filter(pa.compute.is_null(batch["words"]))
            if known.num_rows:
                yield known.select(names)
            batch = batch.filter(pa.compute.is_valid(batch["words"]))
            alone = batch.filter(batch["alone"])
            if alone.num_rows:
                yield first_of(alone)
                batch = batch.filter(pa.compute.invert(batch["alone"]))
            while batch.num_rows:
                size = (np.asarray(batch["stop"]) - np.asarray(batch["start"])).cumsum()
                room = int(np.searchsorted(size, block - symbols))
                if room >= batch.num_rows:
                    held.append(batch)
                    symbols += int(size[-1])
                    break
                key = np.asarray(batch["key"])
                # full: take what still has the last key, and index
                last = key[room]
                stop = room + int(np.searchsorted(key[room:] != last, True))
                if stop >= batch.num_rows:
                    held.append(batch)
                    symbols += int(size[-1])
                    break
                held.append(batch.slice(0, stop))
                yield flush(held)
                held, symbols, batch = [], 0, batch.slice(stop)
        if held:
            yield flush(held)

    import pyarrow.compute  # noqa: F401

    return cut.repartition(shards, "key").sortWithinPartitions("key", "doc_id").mapInArrow(search, "doc_id bigint, h1 bigint, start bigint, stop bigint")


def repeated_intervals(docs: DataFrame, window: int = WINDOW, run: int = RUN, frequent: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """doc_id, h1 (of the text) and gone, an array of structs of start and stop: the word intervals to remove."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    seen = stored(texts(docs), "texts").where(F.col("n_words") >= window)
    heads = seen.groupBy("h1", "h2").agg(F.min("doc_id").alias("head"))
    heads = stored(heads, "heads")
    copies = of_classes(seen).where("doc_id > head").select("doc_id", "h1", F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("stop"))
    anchor = anchors(docs, window, run)
    shared = anchor.groupBy("anchor").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.count("*").alias("n")).where("low <> high").select("anchor", "n")
    hits = anchor.join(shared, "anchor").groupBy("h1").agg(F.collect_set(F.struct("anchor", "n")).alias("anchors"))
    hits = hits.join(heads, "h1").groupBy(F.col("head").alias("doc_id")).agg(F.flatten(F.collect_list("anchors")).alias("anchors"))  # of every text that an id heads
    hits = stored(hits, "anchors")
    cut = stretches(docs.join(hits, "doc_id").select("doc_id", "text", "anchors"), window, run, frequent)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = intervals(cut, window, shards, block).union(copies)
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "start", "stop")).alias("gone"))


OUTPUTS = {"kept_text": pa.string(), "kept_sha256": pa.string(), "clean_text": pa.string()}


def _clean(raw: bytes, low: int, high: int, starts: np.ndarray, stops: np.ndarray, kept: np.ndarray) -> str:
    """A text without its removed stretches: what stays keeps its own spacing."""
    if kept.all():
        return raw[low:high].decode("utf-8")
    own = np.flatnonzero(kept)
    first = np.append(True, np.diff(own) != 1) if len(own) else np.zeros(0, bool)
    last = np.append(first[1:], True) if len(own) else first
    return b" ".join([raw[a:b] for a, b in zip(starts[own[first]].tolist(), stops[own[last]].tolist())]).decode("utf-8")


def remove_repeats(docs: DataFrame, window: int = WINDOW, outputs: tuple[str, ...] = ("kept_text",), carry: tuple[str, ...] = (), **options) -> DataFrame:
    """doc_id, n_words, n_removed and `outputs` of every row of `docs`, and the columns to carry along.

    kept_text has the kept words joined by a blank, kept_sha256 its digest; clean_text keeps the spacing between kept words, and
    is the text itself where nothing goes. A null text has no words. A row with a null doc_id keeps all its words and is no source; rows
    that repeat a doc_id do not count as earlier than one another. Other columns are ignored; an empty table gives an empty one.
    """
    kind = dict(docs.dtypes)["doc_id"]
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *carry)
    gone = repeated_intervals(own.select("doc_id", "text"), window, **options)
    joined = own.join(gone, "doc_id", "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rounds(batches):
            data, starts, stops, first, words = _hashed(batch)
            ends = string_buffers(batch["text"])[1]
            n = np.diff(first)
            change = np.zeros(len(words) + 1, np.int64)
            lists = batch["gone"]
            if lists.null_count < len(lists):
                h1, _ = _content(words, first)
                sizes = np.diff(np.asarray(lists.offsets))
                sizes[np.asarray(lists.is_null())] = 0
                flat = lists.flatten()
                owner = np.repeat(np.arange(len(lists)), sizes)
                right = np.asarray(flat.field("h1"), dtype=np.int64) == h1[owner]
                owner = owner[right]
                np.add.at(change, first[:-1][owner] + np.asarray(flat.field("start"), dtype=np.int64)[right], 1)
                np.add.at(change, first[:-1][owner] + np.asarray(flat.field("stop"), dtype=np.int64)[right], -1)
            kept = np.cumsum(change)[:-1] == 0
            removed = n - np.diff(np.append(0, np.cumsum(kept))[first])
            raw = data.tobytes()
            texts, clean = [], []
            for k in range(len(n)):
                if "clean_text" in outputs:
                    own = slice(first[k], first[k + 1])
                    clean.append(_clean(raw, ends[k], ends[k + 1], starts[own], stops[own], kept[own]))
                if not {"kept_text", "kept_sha256"} & set(outputs):
                    continue
                own = np.arange(first[k], first[k + 1])[kept[first[k] : first[k + 1]]]
                texts.append(b" ".join([raw[a:b] for a, b in zip(starts[own].tolist(), stops[own].tolist())]))
            made = {"clean_text": lambda: clean, "kept_text": lambda: [t.decode("utf-8") for t in texts], "kept_sha256": lambda: [hashlib.sha256(t).hexdigest() for t in texts]}
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n), pa.array(removed), *(pa.array(made[o](), OUTPUTS[o]) for o in outputs), *(batch[c] for c in carry)],
                ["doc_id", "n_words", "n_removed", *outputs, *carry],
            )

    schema = "doc_id bigint, n_words bigint, n_removed bigint" + "".join(f", {o} string" for o in outputs)
    schema += "".join(f", `{c}` {dict(own.dtypes)[c]}" for c in carry)
    out = joined.select("doc_id", "text", "gone", *carry).mapInArrow(apply, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), outputs=("kept_sha256",))


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) i FROM d WHERE len(ws) >= {WINDOW}),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) x FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) m FROM w) WHERE m < doc_id),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest(range(0, {WINDOW})) k)),
n AS (SELECT doc_id, list(i) gone FROM g GROUP BY doc_id),
k AS (SELECT d.doc_id, d.ws, coalesce(n.gone, []) gone FROM d LEFT JOIN n USING (doc_id)),
u AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) i FROM d WHERE len(ws) > 0),
t AS (SELECT u.doc_id, string_agg(u.ws[u.i], ' ' ORDER BY u.i) kept FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.i = g.i GROUP BY u.doc_id)
SELECT k.doc_id, CAST(len(k.ws) AS BIGINT) n_words, CAST(len(k.gone) AS BIGINT) n_removed, sha256(coalesce(t.kept, '')) kept_sha256
FROM k LEFT JOIN t USING (doc_id)"""
