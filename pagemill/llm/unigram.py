"""Token counts: trie-shared dynamic programming over a unigram vocabulary.

The distinct pre-tokens of a batch go into a trie, built a level at a time. The best score of a prefix depends on its letters
alone, so each trie node is scored once, however many pre-tokens share it: the best over the pieces that end there, found by
the hashes of the node's last 1 to MAX_PIECE letters. A pre-token's number of tokens is what its last node stores.

Pieces come from the public vocabulary file at `path` (a parameter). The file lists them by rank and has no probabilities, so a
piece of rank r has the log probability of a Zipf-Mandelbrot law, -log(r + 2.7); a letter that no piece has is spelled in bytes, each
one token of the lowest probability. Of segmentations with equal scores the one of fewer tokens counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import mix, rounds, ship, string_buffers, word_bounds, word_hashes

VOCABULARY = "piece_bpe_32k.model"
ZIPF_SHIFT = 2.7
#: Stands for the blank before a pre-token.
MARK = "▁"
#: Pre-tokens whose counts a worker remembers; beyond them it starts anew.
MEMO = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _fold(letters: np.ndarray) -> np.ndarray:
    return mix(letters.astype(np.uint64) + np.uint64(0x51ED270B))

#: Letters of a word that goes through the trie, at most.
LONG = 256


class Pieces:
    """Piece scores by hash: a piece of letters a, b, c has the hash of its letters, the last one first."""

    def __init__(self, pieces: list[tuple[str, float]], byte_score: float):
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self.byte_score = byte_score
        hashes, scores = [], []
        for p, s in pieces:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in reversed(p):
                    h = mix(np.array([h * _BASE + _fold(np.array([ord(c)]))[0]]))[0]
            hashes.append(h)
            scores.append(s)
        order = np.argsort(np.array(hashes, np.uint64))
        self.hashes, self.scores = np.array(hashes, np.uint64)[order], np.array(scores)[order]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Scores, minus infinity where there is no such piece."""
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == h, self.scores[at], -np.inf)


@lru_cache(2)
def load(path: str) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    scored = [(sp.id_to_piece(i), -float(np.log(rank + 1 + ZIPF_SHIFT))) for rank, i in enumerate(plain)]
    return Pieces(scored, -float(np.log(len(plain) + 1 + ZIPF_SHIFT)))


def _widths(letters: np.ndarray) -> np.ndarray:
    """Bytes of each letter in UTF-8."""
    return np.where(letters < 0x80, 1, np.where(letters < 0x800, 2, np.where(letters < 0x10000, 3, 4)))


def long_count(word: str, pieces: Pieces, chunk: int = 1 << 16) -> int:
    """Tokens of one word by itself. The pieces that end at each letter are looked up for many letters at once; the scores are added up letter by letter, over the
    pieces that are there, with those of the last few letters at hand."""
    letters = np.frombuffer((MARK + word).encode("utf-32-le"), np.uint32).astype(np.int64)
    scores, counts = [0.0], [0]  # of the prefixes before the chunk, as far back as a piece reaches
    for start in range(0, len(letters), chunk):
        stop = min(start + chunk, len(letters))
        low = max(0, start - pieces.longest + 1)
        folded, ends = _fold(letters[low:stop]), np.arange(start, stop)
        h, at, length, gain = np.zeros(len(ends), np.uint64), [], [], []
        for back in range(1, pieces.longest + 1):
            begin = ends - back + 1
            ok = np.flatnonzero(begin >= 0)
            h[ok] = mix(h[ok] * _BASE + folded[begin[ok] - low])
            s = pieces.find(h[ok])
            hit = np.flatnonzero(s > -np.inf)
            at.append(ok[hit])
            length.append(np.full(len(hit), back))
            gain.append(s[hit])
        at, length, gain = map(np.concatenate, (at, length, gain))
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(len(ends) + 1)).tolist()
        length, gain, width = length[order].tolist(), gain[order].tolist(), _widths(letters[start:stop]).tolist()
        for k in range(len(ends)):
            best, fewest = scores[-1] + pieces.byte_score * width[k], counts[-1] + width[k]
            for n in range(first[k], first[k + 1]):
                s, c = scores[-length[n]] + gain[n], counts[-length[n]] + 1
                if s > best + 1e-9 or s > best - 1e-9 and c < fewest:
                    best, fewest = s, c
            scores.append(best)
            counts.append(fewest)
        del scores[: -pieces.longest], counts[: -pieces.longest]
    return counts[-1]


def token_counts(words: list[str], pieces: Pieces) -> np.ndarray:
    """Tokens in the best segmentation of each word (with the mark before it). Words of more than LONG letters share no prefix of that length to speak of and
    leave the trie."""
    if any(len(w) > LONG for w in words):
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        out = np.array([0 if len(w) <= LONG else long_count(w, pieces) for w in words], np.int64)
        out[short] = token_counts([words[k] for k in short], pieces)
        return out
    order = sorted(range(len(words)), key=words.__getitem__)
    size = np.array([len(words[k]) + 1 for k in order], np.int64)
    if not len(size):
        return np.zeros(0, np.int64)
    letters = np.frombuffer("".join(MARK + words[k] for k in order).encode("utf-32-le"), np.uint32).astype(np.int64)
    begin = np.cumsum(size) - size
    # levels of the trie: sorted words that share a prefix stand together, so a node is a run of them
    node = np.zeros(len(size), np.int64)  # of each word at the level before; the root is 0
    parents, marks = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    score, count = [np.zeros(1)], [np.zeros(1, np.int64)]
    out = np.zeros(len(size), np.int64)
    live = np.arange(len(size))
    for depth in range(1, int(size.max()) + 1):
        c = letters[begin[live] + depth - 1]
        above = node[live]
        new = np.ones(len(live), bool)
        new[1:] = (c[1:] != c[:-1]) | (above[1:] != above[:-1])
        here = np.cumsum(new) - 1
        node[live] = here
        parents.append(above[new])
        marks.append(c[new])
        n = int(new.sum())
        width = _widths(c[new])
        best = score[depth - 1][parents[depth]] + pieces.byte_score * width
        fewest = count[depth - 1][parents[depth]] + width
        h, walk = np.zeros(n, np.uint64), np.arange(n)
        for back in range(1, min(depth, pieces.longest) + 1):
            level = depth - back + 1
            h = mix(h * _BASE + _fold(marks[level][walk]))
            walk = parents[level][walk]
            s = pieces.find(h)
            s += score[level - 1][walk]
            k = count[level - 1][walk] + 1
            better = (s > best + 1e-9) | (s > best - 1e-9) & (k < fewest)
            best, fewest = np.where(better, s, best), np.where(better, k, fewest)
        score.append(best)
        count.append(fewest)
        last = size[live] == depth
        out[live[last]] = fewest[here[last]]
        live = live[~last]
        if depth >= pieces.longest:  # levels that no piece reaches back to any more
            for past in (parents, marks, score, count):
                past[depth - pieces.longest] = None
        if not len(live):
            break
    result = np.zeros(len(words), np.int64)
    result[np.array(order)] = out
    return result


class Counter:
    """Counts of pre-tokens that a worker has seen: sorted hashes and counts."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def of(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Tokens of each word of the bytes."""
        distinct, sample, which = np.unique(word_hashes(data, starts, stops), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        found = self.known[at] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        out = np.zeros(len(distinct), np.int64)
        out[found] = self.counts[at[found]]
        new = np.flatnonzero(~found)
        if len(new):
            raw = data.tobytes()
            out[new] = token_counts([raw[starts[k] : stops[k]].decode("utf-8") for k in sample[new]], self.pieces)
            if len(self.known) + len(new) > MEMO:
                self.known, self.counts = distinct[new][:MEMO], out[new][:MEMO]
            else:
                both = np.concatenate([self.known, distinct[new]])
                order = np.argsort(both)
                self.known, self.counts = both[order], np.concatenate([self.counts, out[new]])[order]
        return out[which]


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every row of `docs`; pre-tokens are runs of other characters than white space.

    No shuffle. Null and empty texts have none; repeated rows stay; an empty table gives an empty one; other columns are
    ignored. Every executor needs the vocabulary at `path`.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.setdefault(path, Counter(load(path)))
        for batch in rounds(batches, "_text"):
            data, ends = string_buffers(batch["_text"])
            starts, stops, first = word_bounds(data, ends)
            total = np.append(0, np.cumsum(counter.of(data, starts, stops)))
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], pa.array(np.diff(first)), pa.array(total[first[1:]] - total[first[:-1]])], ["doc_id", "n_pretokens", "n_tokens"]
            )

    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return named.mapInArrow(run, f"doc_id {dict(named.dtypes)['_id']}, n_pretokens bigint, n_tokens bigint")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
