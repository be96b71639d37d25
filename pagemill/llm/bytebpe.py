"""Byte-level BPE encoding and decoding with a sentencepiece model that is written from a rank file.

A rank file lists byte strings and their ranks. Each becomes a piece of a sentencepiece BPE model: its bytes mapped to letters one to one, its score the
negative rank, so that the pair with the best score is the pair with the lowest rank, the leftmost of several. The model is serialised here, field by field;
its normaliser is the identity, without dummy prefix, and no mapped byte is white space, so the library changes nothing before it merges. Pre-tokens are
encoded by themselves; ids are decoded by the pieces' letters mapped back.

A pre-token that is a token is one token, even if no merges lead to it. Scores are 32-bit floats, exact up to rank 2**24.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pagemill.llm.bpe import LETTERS
from pagemill.llm.common import rounds, ship

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens that a worker remembers, of so many characters at most; beyond that many it starts anew.
MEMO, MEMO_LENGTH = 400_000, 64
#: The piece of an unknown symbol, which a model must have. No text gets it, as every byte has a piece.
UNKNOWN = "�"


# ---- the model's file ------------------------------------------------------------------------------------------------


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _integer(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _float(field: int, x: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", x)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def letters(token: bytes) -> str:
    return "".join([LETTERS[b] for b in token])


_BYTE_OF = {c: b for b, c in enumerate(LETTERS)}


def from_letters(piece: str) -> bytes:
    return bytes([_BYTE_OF[c] for c in piece])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def model_file(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model of the tokens: pieces in order of rank, then the unknown one.

    Fields of the public format. Model: 1 pieces, 2 trainer's settings, 3 normaliser's. Piece: 1 text, 2 score, 3 type (2 unknown). Trainer: 3 kind of
    model (2 BPE), 4 number of pieces, 40 to 43 ids of unknown, begin, end, padding (-1 none). Normaliser: 1 name, 3 dummy prefix, 4 fewer blanks, 5
    blanks escaped.
    """
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out += _bytes(1, _bytes(1, letters(token).encode()) + _float(2, -float(rank)))
    out += _bytes(1, _bytes(1, UNKNOWN.encode()) + _float(2, 0.0) + _integer(3, 2))
    none = (1 << 64) - 1
    out += _bytes(2, _integer(3, 2) + _integer(4, len(ranks) + 1) + _integer(40, len(ranks)) + b"".join(_integer(k, none) for k in (41, 42, 43)))
    out += _bytes(3, _bytes(1, b"identity") + b"".join(_integer(k, 0) for k in (3, 4, 5)))
    return bytes(out)


class Codec:
    """Encodes pre-tokens and decodes ids with one rank file and one pattern."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        ranks = read_ranks(path)
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError(f"{path} has no token for some byte")
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model_file(ranks))
        self.rank_of_piece = np.array(sorted(ranks.values()), np.uint32)
        self.whole = {letters(token): rank for token, rank in ranks.items()}
        self.token_bytes = {int(rank): from_letters(self.processor.id_to_piece(k)) for k, rank in enumerate(self.rank_of_piece)}
        self.pattern = regex.compile(pattern)
        self.memo: dict[str, bytes] = {}

    def encode_pieces(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token, as little-endian 32-bit integers."""
        mapped = [letters(w.encode("utf-8")) for w in words]
        open_ = [k for k, m in enumerate(mapped) if m not in self.whole]
        out = [struct.pack("<I", self.whole[m]) if m in self.whole else b"" for m in mapped]
        for k, ids in zip(open_, self.processor.encode([mapped[k] for k in open_], num_threads=1)):
            out[k] = self.rank_of_piece[ids].astype("<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. New pre-tokens of all texts are encoded at once."""
        parts = [self.pattern.findall(t) for t in texts]
        new = {w for p in parts for w in p if w not in self.memo}
        found = dict(zip(new, self.encode_pieces(list(new))))
        if len(self.memo) + len(new) > MEMO:
            found |= {w: self.memo[w] for p in parts for w in p if w in self.memo}
            self.memo = {}
        self.memo.update(found)
        out = [b"".join([self.memo[w] for w in p]) for p in parts]
        for w in new:
            if len(w) > MEMO_LENGTH:
                del self.memo[w]
        return out

    def decode(self, ids: bytes | list[int]) -> bytes:
        numbers = np.frombuffer(ids, "<u4").tolist() if isinstance(ids, bytes) else ids
        return b"".join([self.token_bytes[i] for i in numbers])


def python_pattern(pattern: str) -> str:
    """White space as Unicode defines it; Python's adds four separators of its own."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


@lru_cache(2)
def load(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def default_pattern() -> str:
    import public_tokenizers

    return python_pattern(public_tokenizers.PATTERN)


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """One row per row of `docs`: the id, n_tokens, and of `outputs`: ids (array<int>), decoded (binary), ids_sha256, decoded_sha256.

    No shuffle: a row's result depends on its text alone. A null text counts as empty: no tokens, decoded to nothing. Repeated rows stay; an empty table
    gives an empty one; other columns are ignored. Every executor needs the rank file at `path`. A worker keeps the model, one batch of
    bounded size or a single longer text, and a memo of bounded size.
    """
    ship(docs.sparkSession)
    pattern = default_pattern() if pattern is None else pattern
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("binary", pa.binary()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path, pattern)
        for batch in rounds(batches, "_text"):
            got = codec.encode([t or "" for t in batch["_text"].to_pylist()])
            columns = {
                "ids": lambda: [np.frombuffer(g, "<u4").astype(np.int32) for g in got],
                "decoded": lambda: [codec.decode(g) for g in got],
                "ids_sha256": lambda: [sha(g) for g in got],
                "decoded_sha256": lambda: [sha(codec.decode(g)) for g in got],
            }
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], pa.array([len(g) // 4 for g in got], pa.int64()), *(pa.array(columns[o](), kinds[o][1]) for o in outputs)],
                ["doc_id", "n_tokens", *outputs],
            )

    named = docs.selectExpr(f"`{id_col}` AS _id", f"`{text_col}` AS _text")
    schema = f"doc_id {dict(named.dtypes)['_id']}, n_tokens bigint" + "".join(f", {o} {kinds[o][0]}" for o in outputs)
    return named.mapInArrow(run, schema)


def decode_ids(tokens: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded (binary): the bytes that arrays of ids stand for. A null array is empty; an id that the file has not is an error."""
    ship(tokens.sparkSession)
    pattern = default_pattern() if pattern is None else pattern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["_id"], pa.array([codec.decode(x or []) for x in batch["_ids"].to_pylist()], pa.binary())], ["doc_id", "decoded"])

    named = tokens.selectExpr(f"`{id_col}` AS _id", f"`{ids_col}` AS _ids")
    return named.mapInArrow(run, f"doc_id {dict(named.dtypes)['_id']}, decoded binary")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_texts(docs, ranks_path(), outputs=("ids_sha256", "decoded_sha256"))
