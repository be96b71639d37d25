"""MinHash near-dedup with DartMinHash signatures.

Every element of a weighted set throws darts into its region, weight by rank: how many fall into a cell, and where, is hashed
from the element and the cell alone, so equal elements throw equal darts in every document. A coordinate of the signature keeps
its earliest dart. A document with few elements reads more rank strips, one with many reads few: the work follows the elements
plus about K ln K + 2 K darts. Elements are shingles of five words, weighted by how often the text has them; similarity is weighted
Jaccard's, the sum of the lesser weights over that of the greater ones. Without weights it is Jaccard's.

Finding the groups:

1. one pass gives each document a hash of its words and BANDS band keys; equal word sequences are one class from here on,
   represented by their smallest id: a pre-aggregated minimum, so that copies leave before anything is joined. Rows learn their
   class's id in a join over salted classes;
2. representatives meet in buckets of equal band keys. Each is compared with its bucket's pivot, the member with the most bucket
   mates: in a group of copies that is a central one, the same in most buckets;
3. pairs are held to the exact similarity: a shingle's occurrences are numbered, and Jaccard's of the numbered ones is the weighted one;
4. links make components by minimum labels and pointer jumping, every round written to the shared folder;
5. documents in buckets whose members are in different components still meet where they share one of their rarest shingles, as any
   two that reach the threshold do; so no link depends on the choice of pivots.

Nothing grows on the driver; no bucket, component or partner list is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import gram_hashes, mix, of_classes, rounds, ship, stored, string_buffers, word_bounds, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold shares a band with probability 1 - (1 - 0.8**6)**40 = 0.999995, and two with 0.99992.
BANDS, ROWS = 40, 6
#: Shingles in so many documents or fewer are rare.
RARE = 32
#: The first rank strip; the others double it.
FIRST_STRIP = 2.0**-4
_POISSON = 24
_CELL, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x632BE59BD9B4E019)


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _cell_darts(elements: np.ndarray, tag: np.ndarray, area: float, low: np.ndarray, height: float, k: int):
    """The darts of cells (of at most unit area), one for each element: index of the element, coordinate, rank, identity, uniform weight
    position. tag and low tell the cell's number and the rank it begins at, for each element or for all."""
    h = mix(elements ^ (tag * _CELL + _SALT))
    u = _uniform(h)
    p = math.exp(-area)
    at = np.flatnonzero(u >= p)
    if not len(at):
        return None
    u, h = u[at], h[at]
    number, total, term = np.ones(len(u), np.int64), p, p
    for n in range(1, _POISSON):
        term *= area / n
        total += term
        more = u >= total
        if not more.any():
            break
        number[more] = n + 1
    index = np.repeat(np.arange(len(u)), number)
    turn = np.arange(len(index)) - np.repeat(np.cumsum(number) - number, number)
    dart = mix(h[index] + (turn.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
    at = at[index]
    rank = (low[at] if len(low) > 1 else low) + height * _uniform(dart)
    second = mix(dart ^ np.uint64(0xA0761D6478BD642F))
    coordinate = ((second >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    return at, coordinate, rank, dart, second


def signatures(elements: np.ndarray, sizes: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """k coordinates (uint64) for each of the sets that lie one after another in `elements`; sets of none have all ones.

    Without weights every element weighs 1. Coordinates of two sets agree with the probability of their (weighted) Jaccard
    similarity.
    """
    n = len(sizes)
    out = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    mass = sizes.astype(float) if weights is None else np.bincount(owner, weights, n)
    darts = k * math.log(k) + 2 * k
    with np.errstate(divide="ignore"):
        need = np.ceil(np.log2(np.maximum(darts / np.maximum(mass, 1e-9) / FIRST_STRIP, 1)))
    heaviest = 1.0 if weights is None or not len(weights) else float(weights.max())
    strips = int(math.ceil(math.log2(heaviest))) + 1 if heaviest > 1 else 1
    live = np.flatnonzero(mass > 0)
    heavy = np.flatnonzero(weights > 1) if weights is not None else live[:0]
    # elements of weight 1 and more fill the lowest cell, so all its darts count; few weigh more
    full = weights is None or not len(weights) or float(weights.min()) >= 1
    strip = 0
    while len(live):
        mine = np.zeros(n, bool)
        mine[live] = True
        pick, more = np.flatnonzero(mine[owner]), heavy[mine[owner[heavy]]]
        low, high = (0.0, FIRST_STRIP) if strip == 0 else (FIRST_STRIP * 2.0 ** (strip - 1), FIRST_STRIP * 2.0**strip)
        for v in range(strips):
            floor, width = (0.0, 1.0) if v == 0 else (2.0 ** (v - 1), 2.0 ** (v - 1))
            some = pick if v == 0 else more[weights[more] > floor]
            if not len(some):
                continue
            area = width * (high - low)
            cells = max(1, math.ceil(area))
            height, first = (high - low) / cells, (strip * 64 + v) << 40
            for s in range(0, cells * len(some), 1 << 18):
                # cell after cell, each with all the elements
                if cells == 1:
                    part, c = some[s : s + (1 << 18)], np.zeros(1, np.uint64)
                else:
                    c, part = np.divmod(np.arange(s, min(s + (1 << 18), cells * len(some))), len(some))
                    part, c = some[part], c.astype(np.uint64)
                got = _cell_darts(elements[part], c + np.uint64(first), area / cells, low + height * c, height, k)
                if got is None:
                    continue
                at, coordinate, rank, dart, second = got
                at = part[at]
                if v or not full:
                    ok = floor + width * _uniform(mix(second)) < weights[at]
                    at, coordinate, rank, dart = at[ok], coordinate[ok], rank[ok], dart[ok]
                key = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | dart & np.uint64(0xFFFFFFFF)
                np.minimum.at(out, owner[at] * k + coordinate, key)
        strip += 1
        due = live[need[live] <= strip - 1]
        filled = (out.reshape(n, k)[due] != np.iinfo(np.uint64).max).all(1)
        done = np.zeros(n, bool)
        done[due[filled]] = True
        live = live[~done[live]]
    return out.reshape(n, k)


def shingle_sets(data: np.ndarray, ends: np.ndarray, n: int = SHINGLE, counts: bool = False):
    """Distinct shingle hashes of each text one after another, how many each has, and (counts) how often each occurs; also words'
    hashes and first words. A text of fewer words has its whole as its only shingle; one without words has none."""
    starts, stops, first = word_bounds(data, ends)
    words = word_hashes(data, starts, stops)
    grams = gram_hashes(words, n)
    sets, times = [], []
    for k in range(len(first) - 1):
        a, b = int(first[k]), int(first[k + 1])
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
        elif b > a:
            g = mix(np.array([np.bitwise_xor.reduce(mix(words[a:b] + np.arange(1, b - a + 1).astype(np.uint64)))]))
        else:
            g = np.zeros(0, np.uint64)
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        sets.append(g[new])
        if counts:
            times.append(np.diff(np.append(np.flatnonzero(new), len(g))))
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, sizes, (np.concatenate(times).astype(float) if times else None), words, first


def _content(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's word sequence."""
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    out = []
    for salt in (0x8BB84B93962EACC9, 0x2D358DCCAA6C78A5):
        v = mix(words + mix(place.astype(np.uint64) + np.uint64(salt)))
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64))
        out.append(mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def band_keys(sig: np.ndarray, bands: int = BANDS, per: int = ROWS) -> np.ndarray:
    """A key for each band of each signature; equal only for the same band."""
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), np.uint64(b + 1))
        for r in range(per):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * per + r])
        out[:, b] = h
    return out.view(np.int64)


def sketches(docs: DataFrame, weighted: bool = True) -> DataFrame:
    """doc_id, n_words, two content hashes and the band keys of every document."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rounds(batches):
            flat, sizes, times, words, first = shingle_sets(*string_buffers(batch["text"]), counts=weighted)
            keys = band_keys(signatures(flat, sizes, BANDS * ROWS, times))
            h1, h2 = _content(words, first)
            bands = pa.ListArray.from_arrays(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS, pa.array(keys.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.diff(first), pa.int64()), pa.array(h1), pa.array(h2), bands], ["doc_id", "n_words", "h1", "h2", "bands"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, h1 bigint, h2 bigint, bands array<bigint>")


def numbered(flat: np.ndarray, sizes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every occurrence as an element of its own, the first being the shingle itself, and how many each text has."""
    times = times.astype(np.int64)
    turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    out = np.repeat(flat, times)
    later = turn > 0
    out[later] = mix(out[later] + turn[later].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out, np.diff(np.append(0, np.cumsum(times))[np.append(0, np.cumsum(sizes))])


def _shingles(docs: DataFrame, weighted: bool = True) -> DataFrame:
    """doc_id and its shingles, distinct or numbered, hashed to 32 bits, for the exact comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rounds(batches):
            flat, sizes, times, *_ = shingle_sets(*string_buffers(batch["text"]), counts=weighted)
            if weighted:
                flat, sizes = numbered(flat, sizes, times)
            values = pa.array((flat >> np.uint64(32)).astype(np.uint32).view(np.int32))
            at = np.append(0, np.cumsum(sizes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(at, values)], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, shingles array<int>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are as similar as that; an id of several texts has a set for each."""
    a, b = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    # sizes alone tell many pairs apart, and the intersection is computed once
    both = F.size(F.array_intersect("sa", "sb"))
    least = F.least(F.size("sa"), F.size("sb"))
    most = F.greatest(F.size("sa"), F.size("sb"))
    # i / (x + y - i) >= t, without a division: i * (1 + t) >= t * (x + y)
    return (
        pairs.join(a, "a").join(b, "b").where((least >= threshold * most - 1e-9) & (both * (1 + threshold) >= threshold * (F.size("sa") + F.size("sb")) - 1e-9)).select("a", "b")
    )


def components(links: DataFrame) -> DataFrame:
    """doc_id and comp, the smallest id that links (a, b) lead to. Minimum labels with pointer jumping; rounds are written."""
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).select(F.col("a").alias("doc_id"), "comp"), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("doc_id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("comp").alias("near"))
        )
        lower = labels.join(near, "doc_id", "left").select("doc_id", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        lower = stored(lower, "labels")
        # a component's label is one of its members, whose own label may be lower already
        jump = lower.select(F.col("doc_id").alias("comp"), F.col("comp").alias("next"))
        after = lower.join(jump, "comp", "left").select("doc_id", F.least("comp", F.col("next")).alias("comp"), "old")
        after = stored(after, "labels")
        labels = after.select("doc_id", "comp")
        if after.where("comp <> old").isEmpty():
            return labels


def _prefixes(placed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """doc_id, comp, n (shingles), m1 and m2 (how many of them are in more than one document, in more than RARE), p1 and p2: of the first ones by document
    frequency, as many as two sets of that similarity must share one of, those in 2 to RARE documents, and those in more."""
    listed = placed.join(sets, "doc_id").select("doc_id", "text", "comp", F.size("shingles").alias("n"), F.explode("shingles").alias("t"))
    often = listed.groupBy("t").agg(F.count("*").alias("c"))
    length = (F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1).cast("int")
    rare = listed.join(often, "t").groupBy("doc_id", "text", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("s"))
    held = lambda least: F.size(F.filter("s", lambda e: e["c"] > least))
    part = lambda keep: F.transform(F.filter(F.slice("s", F.lit(1), length), keep), lambda e: e["t"])
    return rare.select("doc_id", "comp", "n", held(1).alias("m1"), held(RARE).alias("m2"), part(lambda e: (e["c"] > 1) & (e["c"] <= RARE)).alias("p1"), part(lambda e: e["c"] > RARE).alias("p2"))


def _step(size: Column) -> Column:
    """The step of a size; each is a thirty-second wider than the one before."""
    return F.floor(F.log(size.cast("double")) * (1 / math.log1p(1 / 32)) + 1e-9).cast("int")


def frequent_meetings(rare: DataFrame, threshold: float) -> DataFrame:
    """Rows a, b (and what decides about them) that meet in a frequent shingle, as they may have no rarer one in common.

    Such two share frequent shingles alone, i of them. From i / (x + y - i) >= t follows i >= t (x + y) / (1 + t); as i is at most either's number m of frequent
    shingles, the larger, of x shingles, meets only sizes y from t x to m (1 + t) / t - x, and the smaller needs m >= 2 t y / (1 + t). Sizes meet by steps. So pages
    of one template, whose own words keep them apart, do not meet at all: those with enough in common to be the smaller are linked with one another. Of the
    documents of one shingle and step those of its largest component are not compared, as they are linked already: a family of variants costs its size times the
    number of strangers that may be as similar.
    """
    n, m = F.col("n"), F.col("m2")
    most = F.floor(m * ((1 + threshold) / threshold) - n + 1e-9)
    large = rare.where((F.size("p2") > 0) & (most >= threshold * n - 1e-9)).withColumn("most", F.least(most, n)).withColumn("t", F.explode("p2"))
    large = large.withColumn("cell", F.explode(F.sequence(_step(F.ceil(threshold * n - 1e-9)), _step(F.col("most")))))
    small = rare.where((F.size("p2") > 0) & (m * (1 + threshold) >= 2 * threshold * n - 1e-9)).withColumn("t", F.explode("p2")).withColumn("cell", _step(n))
    large, small = stored(large, "cells"), stored(small, "cells")
    sides = large.select("t", "cell", "comp", F.lit(1).alias("l"), F.lit(0).alias("s")).unionByName(small.select("t", "cell", "comp", F.lit(0).alias("l"), F.lit(1).alias("s")))
    families = sides.groupBy("t", "cell", "comp").agg(F.sum("l").alias("l"), F.sum("s").alias("s")).groupBy("t", "cell")
    families = families.agg(F.max_by("comp", F.struct(F.col("l") + F.col("s"), "comp")).alias("largest"), F.count("*").alias("families"), F.sum("l").alias("l"), F.sum("s").alias("s"))
    families = families.where("families > 1 AND l > 0 AND s > 0").select("t", "cell", "largest")
    large, small = large.join(families, ["t", "cell"]), small.join(families, ["t", "cell"])
    x = lambda w: large.where(w).select("t", "cell", "largest", "most", *[F.col(c).alias(c + "a") for c in ("doc_id", "comp", "n", "m2", "p2")])
    y = lambda w: small.where(w).select("t", "cell", *[F.col(c).alias(c + "b") for c in ("doc_id", "comp", "n", "m2", "p2")])
    met = x("true").join(y("comp <> largest"), ["t", "cell"]).unionByName(x("comp <> largest").join(y("comp = largest"), ["t", "cell"]))
    # of two of one size either may be the larger
    return met.where("compa <> compb AND nb <= most AND (nb < na OR doc_ida < doc_idb)")


def _prefix_pairs(placed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of documents (doc_id, comp) in different components that can be as similar as that.

    Two sets of that similarity share one of their rarest shingles: of |x| shingles in the order of their document frequency, one of
    the first |x| - ceil(t |x|) + 1. Either the rarest that they share is in RARE documents or fewer, and so meets few; or their
    intersection has only shingles of more documents, and each has at least a share t of such; see frequent_meetings().
    """
    rare = stored(_prefixes(placed, sets, threshold), "prefixes")
    enough = lambda m: F.least(m + "a", m + "b") * (1 + threshold) >= threshold * (F.col("na") + F.col("nb")) - 1e-9
    once = lambda p: F.array_min(F.array_intersect(p + "a", p + "b")) == F.col("t")  # noqa: E731  each pair at the least of the shingles that it meets in
    few = rare.where(F.size("p1") > 0).withColumn("t", F.explode("p1"))
    few = [few.select("t", *[F.col(c).alias(c + side) for c in ("doc_id", "comp", "n", "m1", "p1")]) for side in "ab"]
    few = few[0].join(few[1], "t").where(F.expr("doc_ida < doc_idb AND compa <> compb") & enough("m1") & once("p1"))
    many = frequent_meetings(rare, threshold).where(enough("m2") & once("p2"))
    pair = lambda d: d.select(F.least("doc_ida", "doc_idb").alias("a"), F.greatest("doc_ida", "doc_idb").alias("b"))
    return pair(few).union(pair(many)).distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, weighted: bool = True) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its group) and copy_of (that of its exact copies) for every row of `docs`.

    Texts without words (null, empty, blank) are in no group: class_id is their own id. So are rows with a null doc_id, whose
    class_id is null unless they copy another text. Rows that repeat an id share its class, and each of their texts is compared. Texts
    exactly as similar as the threshold are linked. Other columns are ignored. An empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    seen = stored(sketches(docs, weighted), "sketches")
    texts = seen.where("n_words > 0")
    # equal texts have equal bands; the copies of a task leave before the shuffle
    heads = texts.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands")).where("doc_id IS NOT NULL")
    heads = stored(heads.select("doc_id", "bands"), "heads")
    rows = heads.select("doc_id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = stored(rows.join(shared, "key"), "buckets")
    # first every member with one pivot of its bucket, the one with the most bucket mates: groups of copies have few pivots
    mates = rows.groupBy("doc_id").agg(F.sum("n").alias("mates"))
    rows = stored(rows.join(mates, "doc_id"), "buckets")
    pivots = rows.groupBy("key").agg(F.max(F.struct("mates", (-F.col("doc_id")).alias("minus"))).alias("p")).select("key", (-F.col("p.minus")).alias("p"))
    star = rows.join(pivots, "key").where("doc_id <> p").select(F.least("doc_id", "p").alias("a"), F.greatest("doc_id", "p").alias("b"))
    pairs = stored(star.distinct(), "pairs")
    wanted = rows.select("doc_id").distinct()
    # no broadcast of the ids, whose number grows with the table
    sets = _shingles(docs.join(wanted.hint("merge"), "doc_id", "left_semi"), weighted).groupBy("doc_id").agg(F.collect_set("shingles").alias("s"))
    sets = stored(sets.select("doc_id", F.posexplode("s").alias("text", "shingles")), "shingles")
    links = stored(verified(pairs, sets, threshold), "links")
    groups = components(links)
    # then the members of buckets that are in different components still
    placed = rows.join(groups, "doc_id", "left").select("doc_id", "key", F.coalesce("comp", "doc_id").alias("comp"))
    placed = stored(placed, "buckets")
    mixed = placed.groupBy("key").agg((F.min("comp") < F.max("comp")).alias("mixed")).where("mixed").select("key")
    apart = stored(placed.join(mixed, "key", "left_semi").select("doc_id", "comp").distinct(), "apart")
    rest = stored(_prefix_pairs(apart, sets, threshold).join(pairs, ["a", "b"], "left_anti"), "pairs")
    more = stored(verified(rest, sets, threshold), "links")
    if not more.isEmpty():
        groups = components(links.union(more))
    copies = of_classes(texts.select("doc_id", "h1", "h2"), groups.select(F.col("doc_id").alias("head"), "comp"))
    plain = seen.where("n_words = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"))
    return copies.select("doc_id", F.coalesce("comp", "head").alias("class_id"), F.col("head").alias("copy_of")).unionByName(plain)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
