"""Byte-level BPE, fill-in-middle and hard negatives on small tables: the public library, exact round trips, exhaustive search."""

import hashlib
import math
import os
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import bytebpe, fim, hardneg, registry

TEXTS = [
    None, "", " \n\t ", "one", "Hello, world's  12 things\n\n  x", "é ü 日本 😀 \x0b\x1c\x85 x", "<P> is here", "a" * 50_000, "x\r\ny\r\n" * 300, "z" * 40 + " " * 5_000, "don't  stop 'round 　x",
    "Ελληνικά кириллица עברית العربية हिन्दी ไทย 한국어 ﷽ ﻿​",
]
DOCS = "doc_id bigint, text string, output string, n int, `_id` string, _text string, form int"
ROWS = [(k, t, "o", 1, "i", "t", 2) for k, t in enumerate(TEXTS)] + [(None, "no id", None, None, None, None, None), (4, TEXTS[4], "o", 1, "i", "t", 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


def sha(b):
    return hashlib.sha256(b).hexdigest()


# ---- byte-level BPE ----


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = bytebpe.read_ranks(bytebpe.ranks_path())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library(docs, library):
    got = bytebpe.encode_texts(docs, bytebpe.ranks_path(), outputs=("ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == len(ROWS)
    text = {r[0]: r[1] or "" for r in ROWS}
    for r in got:
        want = library.encode_ordinary(text[r["doc_id"]])
        assert (r["n_tokens"], r["ids"]) == (len(want), want)
        assert r["decoded"] == text[r["doc_id"]].encode()
        assert r["ids_sha256"] == sha(struct.pack(f"<{len(want)}I", *want)) and r["decoded_sha256"] == sha(r["decoded"])


def test_byte_bpe_of_random_texts_equals_the_library(library):
    codec = bytebpe.load(bytebpe.ranks_path(), bytebpe.default_pattern())
    r = random.Random(3)
    blocks = [(0, 0x80), (0, 0x250), (0x370, 0x600), (0x900, 0xE80), (0x2000, 0x2070), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xE000, 0x10FFFF)]
    texts = ["".join(chr(r.randrange(*r.choice(blocks[: r.randrange(1, 9)]))) for _ in range(r.randrange(120))) for _ in range(800)]
    texts += ["".join(r.choice("ab '\n\t12.re") for _ in range(200)) for _ in range(200)]
    for text, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


def test_byte_bpe_without_a_memo(docs, library, monkeypatch):
    monkeypatch.setattr(bytebpe, "MEMO", 3)
    codec = bytebpe.Codec(bytebpe.ranks_path(), bytebpe.default_pattern())
    for _ in range(2):
        for t in TEXTS:
            assert np.frombuffer(codec.encode([t or ""])[0], "<u4").tolist() == library.encode_ordinary(t or "")
        assert len(codec.memo) <= 30 and max(map(len, codec.memo), default=0) <= bytebpe.MEMO_LENGTH


def test_a_token_that_no_merges_reach(tmp_path):
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abcd"]  # bc and cd are missing
    import base64

    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % (k * 2) for k, t in enumerate(tokens)))
    codec = bytebpe.Codec(str(path), r"\S+|\s+")
    read = lambda t: np.frombuffer(codec.encode([t])[0], "<u4").tolist()
    assert read("abcd") == [2 * 257]
    assert read("abcde") == [512, 2 * ord("c"), 2 * ord("d"), 2 * ord("e")]
    assert codec.decode(read("abcd é")) == "abcd é".encode()
    path.write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="no token"):
        bytebpe.Codec(str(path), r".")


def test_byte_bpe_decodes_ids(docs):
    ids = bytebpe.encode_texts(docs, bytebpe.ranks_path()).select("doc_id", "ids").union(docs.sparkSession.createDataFrame([(99, None)], "doc_id bigint, ids array<int>"))
    got = {r["doc_id"]: bytes(r["decoded"]) for r in bytebpe.decode_ids(ids, bytebpe.ranks_path()).collect()}
    assert got == {r[0]: (r[1] or "").encode() for r in ROWS} | {99: b""}


# ---- fill in the middle ----


def plain_fim(i, text):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or h3 % 100 >= 90 or re.search("<[PSM]>", text):
        return n, "plain", None, None, text
    a, b = sorted([h1 % (n + 1), h2 % (n + 1)])
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fim(docs):
    made = fim.transform(docs)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    text = {r[0]: r[1] for r in ROWS}
    assert len(got) == len(ROWS)
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(r["doc_id"], text[r["doc_id"]])
        assert r["back"] == (text[r["doc_id"]] or "")


def test_fim_of_many_ids_restores(spark):
    texts = ["<", "<P", "P>x<", "<S<S", "M><M", "é\n日😀" * 3, "ab<"]
    rows = spark.createDataFrame([(k, texts[k % len(texts)]) for k in range(400)], "doc_id bigint, text string")
    got = fim.transform(rows).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert r["back"] == texts[r["doc_id"] % len(texts)]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(r["doc_id"], r["back"])


def test_fim_of_words(spark):
    text = "  one two\nthree  four "
    rows = spark.createDataFrame([(k, text) for k in range(200)], "doc_id bigint, text string")
    ends = [0, 5, 9, 15, 21]
    for r in fim.transform(rows, unit=r"\S+").collect():
        assert r["n"] == 4
        if r["form"] != "plain":
            a, b = sorted(h % 5 for h in fim.numbers(1, r["doc_id"])[:2])
            assert (r["prefix_chars"], r["middle_chars"]) == (ends[a], ends[b] - ends[a])
    with pytest.raises(ValueError, match="one character"):
        fim.transform(rows, unit=r"\S*")


def test_the_matcher_holds_no_units():
    import tracemalloc

    text = "xy" * 1_000_000
    pattern = re.compile(fim.CODE_POINT)
    tracemalloc.start()
    assert fim.count_units(pattern, text) == 2_000_000
    assert fim.cut_offsets(pattern, text, 500_000, 1_900_000) == (500_000, 1_900_000)
    assert tracemalloc.get_traced_memory()[1] < 50_000
    tracemalloc.stop()


# ---- hard negatives ----


def exhaustive(rows, every, k_pos=5, k_neg=5, percent=80):
    good = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good[(i, label, tuple(v))] = (i, label, [max(-hardneg.LARGEST, min(hardneg.LARGEST, math.floor(256 * x))) for x in v])
    good = list(good.values())
    out = []
    for i, label, q in good:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p)), j, m) for j, m, p in good if j != i)
        for s, j, m in [x for x in scored if x[2] == label][:k_pos]:
            fit = [x for x in scored if x[2] != label and percent * -s <= 100 * -x[0] <= 100 * -s]
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fit[:k_neg])]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
VECTORS = "vec_id bigint, embedding array<float>, label int, q string, h int, share int, score double"


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, "q", 1, 2, 0.5) for i, label, v in rows], VECTORS).repartition(3)
    return sorted(tuple(r[c] for c in COLUMNS) for r in hardneg.mine(hardneg.integer_vectors(df), **options).collect())


def vectors(n, width, labels=3, seed=1):
    r = np.random.default_rng(seed)
    return [(k, int(r.integers(labels)), np.float32(v).tolist()) for k, v in enumerate(r.standard_normal((n, width)) / math.sqrt(width))]


@pytest.mark.parametrize("cells", [1, 4, 64, 256])
def test_hard_negatives_equal_exhaustive_search(spark, cells):
    rows = vectors(600, 12)
    assert mined(spark, rows, every=20, cells=cells) == exhaustive(rows, 20)


def test_hard_negatives_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "ANCHORS", 7)
    monkeypatch.setattr(hardneg, "ROWS", 40)
    monkeypatch.setattr(hardneg, "CHUNK", 5)
    rows = vectors(500, 8, labels=2, seed=2)
    assert mined(spark, rows, every=10, sample=50) == exhaustive(rows, 10)


def test_hard_negatives_of_awkward_rows(spark):
    rows = vectors(60, 4, seed=3)
    rows += [(None, 1, [1.0] * 4), (61, None, [1.0] * 4), (62, 1, None), (63, 1, [1.0, None, 0.0, 0.0]), (64, 1, [float("nan")] * 4), (65, 2, [float("-inf"), 0.0, 0.0, 0.0])]
    rows += [(70, 1, []), (71, 2, [0.5]), (72, 2, [0.1] * 7), (73, 0, [1e30, -1e30, 0.0, 1.0]), (74, 1, [1e30, 0.0, 0.0, 1.0]), (80, -1, [0.0] * 4)]
    rows += [rows[5], rows[10], (10, 2, [0.3] * 4), (15, 1, [0.2] * 4)]  # repeated rows; ids with two vectors
    assert mined(spark, rows, every=5) == exhaustive(rows, 5)
    assert mined(spark, [], every=5) == []
    assert mined(spark, [(5, 1, [])], every=5) == []


def test_hard_negatives_among_copies(spark):
    """A vector that a third of the rows have, under two labels, and ties everywhere."""
    r = np.random.default_rng(4)
    rows = [(k, k % 2, [0.5, 0.5, 0.5, 0.0]) for k in range(0, 300)]
    rows += [(k, int(r.integers(3)), (r.integers(-2, 3, 4) / 4).tolist()) for k in range(300, 900)]
    assert mined(spark, rows, every=15) == exhaustive(rows, 15)


def test_only_candidates_are_scored(spark):
    """The bounds leave few rows of many."""
    rows = vectors(4000, 32, labels=4, seed=5)
    df = hardneg.integer_vectors(spark.createDataFrame([(i, v, label) for i, label, v in rows], "vec_id bigint, embedding array<float>, label int"))
    edges = hardneg.cell_edges(df)
    anchors = df.where("vec_id % 100 = 0").withColumn("windows", F.array(F.struct(F.lit(-(2**62)).alias("low"), F.lit(2**62).alias("high"))))
    found = hardneg.candidates(hardneg.approximations(df, edges), anchors, edges, True, 5, 4000, 40)
    exact = {(r["anchor_id"], r["vec_id"]): r for r in hardneg.first_in_windows(found, df, anchors, 5).collect()}
    assert len(exact) == 200
    assert found.count() < 40 * 60  # of 40 * 1000 rows of the anchors' labels
    assert found.where("lower > upper").isEmpty()


# ---- queries ----

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["op12_fim", "op13_hard_negatives"])
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(registry.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    rows = sorted(tuple(map(str, r)) for r in c.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall())
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(tuple(map(str, r)) for r in df.select(*columns).collect()) == rows and rows


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert bytebpe.encode_texts(empty, bytebpe.ranks_path()).count() == 0
    assert fim.transform(empty).count() == 0
