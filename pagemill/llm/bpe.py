"""BPE encoding and decoding in batched numpy merge rounds.

The distinct words of a batch are laid out as symbols in one flat array. A round looks up the rank of every adjacent pair at
once, by binary search over the sorted pair keys, finds each word's lowest rank, and merges that pair's occurrences in all
words; it ends when no word has a pair left. Words that were seen before come from a bounded memo, so a batch pays for new ones.

The vocabulary is a file of the tokenizers library (a parameter, read where it is, never copied): byte-level BPE with an
optional end-of-word suffix, the normalizers NFC, Replace and Lowercase, a Split pre-tokenizer and special added tokens.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pagemill.llm.common import rounds, ship

VOCABULARY = "word_bpe_49k.json"
#: Words that a worker remembers; beyond them it starts anew.
MEMO = 400_000


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


LETTERS = _byte_letters()


class Vocabulary:
    """Pair ranks, symbols and text rules of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path} is not a byte-level BPE vocabulary")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.names = np.full(size, "", object)
        for name, i in [*self.ids.items(), *self.special.items()]:
            self.names[i] = name
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([self.ids[a] << 32 | self.ids[b] for a, b in pairs], np.uint64)
        # a pair that is listed twice has its last rank, as in the library's table
        order = np.lexsort((-np.arange(len(keys)), keys))
        keep = np.append(True, np.diff(keys[order]) != 0) if len(keys) else np.zeros(0, bool)
        order = order[keep]
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([self.ids[a + b] for a, b in pairs], np.int64)
        self.byte_id = np.array([self.ids.get(c, -1) for c in LETTERS], np.int64)
        self.last_id = np.array([self.ids.get(c + self.suffix, -1) for c in LETTERS], np.int64)
        self.steps = self._normalizers(spec.get("normalizer"))
        self.pattern = regex.compile(self._pattern(spec.get("pre_tokenizer")))
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @staticmethod
    def _normalizers(spec) -> list:
        steps = []
        for s in [] if spec is None else spec["normalizers"] if spec["type"] == "Sequence" else [spec]:
            if s["type"] == "NFC":
                steps.append(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t))
            elif s["type"] == "Replace":
                if "Regex" in s["pattern"]:
                    found = regex.compile(s["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
                    steps.append(lambda t, f=found, c=s["content"]: f.sub(lambda _: c, t))
                else:
                    steps.append(lambda t, a=s["pattern"]["String"], b=s["content"]: t.replace(a, b))
            elif s["type"] == "Lowercase":
                # letter by letter: a final sigma is lower-cased like any other
                steps.append(lambda t: t.replace("Σ", "σ").lower())
            else:
                raise ValueError(f"unknown normalizer {s['type']}")
        return steps

    @staticmethod
    def _pattern(spec) -> str:
        for s in [] if spec is None else spec["pretokenizers"] if spec["type"] == "Sequence" else [spec]:
            if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]:
                return s["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}")
        raise ValueError("the pre-tokenizer has no Split that keeps its matches")

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        for step in self.steps:
            text = step(text)
        return self.pattern.findall(text)

    def parts(self, text: str) -> list[str]:
        """A text cut at special tokens; those are the odd entries."""
        return self.special_pattern.split(text) if self.special_pattern else [text]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and where each word's begin (one more at the end)."""
        raw = [w.encode("utf-8") for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.byte_id[data]
        owner = np.repeat(np.arange(len(words)), size)
        last = np.cumsum(size)[size > 0] - 1
        if self.suffix:
            symbols[last] = self.last_id[data[last]]
        keep = symbols >= 0  # the library drops symbols that have no id and no unknown token
        symbols, owner = symbols[keep], owner[keep]
        done_s, done_o = [], []
        while len(symbols):
            pair = symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:].astype(np.uint64)
            at = np.searchsorted(self.keys, pair)
            at[at == len(self.keys)] = 0
            found = (self.keys[at] == pair) & (owner[:-1] == owner[1:]) if len(self.keys) else np.zeros(len(pair), bool)
            rank = np.where(found, self.ranks[at] if len(self.keys) else 0, np.iinfo(np.int64).max)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(np.append(rank, np.iinfo(np.int64).max), first)
            runs = np.diff(np.append(first, len(symbols)))
            each = np.repeat(least, runs)
            open_ = each != np.iinfo(np.int64).max
            if not open_.all():  # finished words leave the array
                done_s.append(symbols[~open_])
                done_o.append(owner[~open_])
                if not open_.any():
                    break
                pick = np.flatnonzero(open_)
                symbols, owner, each = symbols[pick], owner[pick], each[pick]
                rank = np.append(rank, np.iinfo(np.int64).max)[pick][:-1]
            hit = rank == each[:-1]
            # of overlapping occurrences (aaa) the leftmost count: every second one of a run of neighbours
            where = np.flatnonzero(hit)
            start = np.append(True, np.diff(where) != 1)
            run = where - where[start][np.cumsum(start) - 1]
            where = where[run % 2 == 0]
            symbols[where] = self.merged[each[where]]
            stay = np.ones(len(symbols), bool)
            stay[where + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        if not done_s:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        symbols, owner = np.concatenate(done_s), np.concatenate(done_o)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.searchsorted(owner[order], np.arange(len(words) + 1))

    def decode(self, ids) -> str:
        """As the library decodes without a decoder: tokens, special ones too, joined by blanks."""
        return " ".join(self.names[np.asarray(ids, np.int64)])


@lru_cache(2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts with a memo of words: token ids as text, their number and the tokens' names."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.memo = vocabulary, {}

    def learn(self, words: set[str]) -> None:
        new = sorted(w for w in words if w not in self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo = {}
            new = sorted(words)
        ids, at = self.vocabulary.encode_words(new)
        names = self.vocabulary.names[ids]
        text = ids.astype(str).astype(object)
        for k, w in enumerate(new):
            a, b = at[k], at[k + 1]
            self.memo[w] = (" ".join(text[a:b]), int(b - a), " ".join(names[a:b])) if a < b else None

    def encode(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """For each text: ids as decimals joined by blanks, their number, the decoded text."""
        v = self.vocabulary
        parts = [[p if k % 2 else v.words(p) for k, p in enumerate(v.parts(t))] for t in texts]
        self.learn({w for ps in parts for p in ps[::2] for w in p})
        out = []
        for ps in parts:
            got = []
            for k, p in enumerate(ps):
                if k % 2:
                    got.append((str(v.special[p]), 1, p))
                else:
                    got += map(self.memo.__getitem__, p)
            got = [g for g in got if g is not None]
            out.append((" ".join([g[0] for g in got]), sum([g[1] for g in got]), " ".join([g[2] for g in got])))
        return out


_encoders: dict[str, Encoder] = {}


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """One row per row of `docs`: the id, n_tokens, and of `outputs`: ids (array<int>), decoded, ids_sha256, decoded_sha256.

    No shuffle: a row's result depends on its text alone. A null text counts as empty: no tokens, decoded to "". Repeated rows
    stay; an empty table gives an empty one; other columns are ignored. Every executor needs the vocabulary at `path`.
    """
    ship(docs.sparkSession)
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(path, Encoder(load(path)))
        for batch in rounds(batches, "_text"):
            got = encoder.encode([t or "" for t in batch["_text"].to_pylist()])
            columns = {
                "ids": lambda: [[int(x) for x in g[0].split()] for g in got],
                "decoded": lambda: [g[2] for g in got],
                "ids_sha256": lambda: [sha(g[0]) for g in got],
                "decoded_sha256": lambda: [sha(g[2]) for g in got],
            }
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], pa.array([g[1] for g in got], pa.int64()), *(pa.array(columns[o](), kinds[o][1]) for o in outputs)],
                ["doc_id", "n_tokens", *outputs],
            )

    named = docs.selectExpr(f"`{id_col}` AS _id", f"`{text_col}` AS _text")
    schema = f"doc_id {dict(named.dtypes)['_id']}, n_tokens bigint" + "".join(f", {o} {kinds[o][0]}" for o in outputs)
    return named.mapInArrow(run, schema)


def decode_ids(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text: what arrays of token ids stand for. A null array is an empty text."""
    ship(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(path)
        for batch in batches:
            texts = [v.decode(x or []) for x in batch["_ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    named = tokens.selectExpr(f"`{id_col}` AS _id", f"`{ids_col}` AS _ids")
    return named.mapInArrow(run, f"doc_id {dict(named.dtypes)['_id']}, text string")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_texts(docs, vocabulary_path(), outputs=("ids_sha256", "decoded_sha256"))
