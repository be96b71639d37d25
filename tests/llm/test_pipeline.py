"""The pipeline on a small corpus, stage by stage, against what plain code keeps."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import bpe

rng = np.random.default_rng(9)
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("n", "st", "r", "l") for c in ("a", "o", "ing", "er")]


def prose(n):
    out = []
    while n > 0:
        k = min(n, int(rng.integers(6, 12)))
        out.append(" ".join(rng.choice(WORDS, k)).capitalize() + ".")
        n -= k
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    good = [(k, prose(90)) for k in range(150)]
    bad = [(1000 + k, " ".join(w + "%%%" for w in prose(60).split())) for k in range(60)]
    item = prose(30)
    passage = prose(60)
    near = good[3][1].split()
    near[50] = "changed"
    rows = good + bad
    rows += [(200, good[5][1]), (201, " ".join(near)), (202, prose(60) + "\n" + passage), (203, prose(70) + "\n" + passage + "\n" + prose(70)), (204, prose(80) + " " + item + " " + prose(80)), (205, good[7][1]), (205, good[7][1])]
    rows += [(None, prose(80)), (300, None), (301, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.withColumnRenamed("lang", "lang").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict((i, t) for i, t in rows), passage


def test_stages(spark, corpus):
    folder, texts, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, folder), name)
        kept[name] = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.select("doc_id").collect())
        if name != "tokens":
            assert docs.columns == before.columns
        if name == "repeated_passages":
            found = {r["doc_id"]: r for r in docs.collect()}
            assert passage in found[202]["text"] and passage not in found[203]["text"] and found[203]["n_chars"] == len(found[203]["text"])
            assert all(found[k]["text"] == texts[k] for k in range(150) if k in found)
    quality = {i for null, i in kept["quality"] if not null}
    assert set(range(150)) | {200, 201, 202, 203, 204, 205} <= quality and not quality & set(range(1000, 1060))
    near = [i for null, i in kept["near_duplicates"] if not null]
    assert len(near) == len(set(near)) and set(near) == quality - {200, 201, 205}
    assert kept["repeated_passages"] == kept["near_duplicates"]
    assert {i for null, i in kept["benchmark_leaks"] if not null} == set(near) - {204}
    assert (True, 0) in kept["tokens"] and kept["tokens"] == kept["benchmark_leaks"]
    row = next(r for r in docs.collect() if r["doc_id"] == 0)
    (ids, n, decoded), = bpe.Encoder(bpe.load(bpe.vocabulary_path())).encode([texts[0]])
    assert row["ids"] == [int(x) for x in ids.split()] and row["n_tokens"] == n
    assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_run_is_the_stages(spark, corpus):
    assert corpus_pipeline.run(spark, corpus[0]).columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_empty_corpus(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, corpus[0]), name)
    assert docs.count() == 0


AWKWARD = [
    (None, None), (None, ""), (None, prose(60)), (1, None), (2, ""), (3, " \n\t"), (4, prose(120)), (4, prose(120)), (5, "x" * 300_000), (6, prose(30_000)), (7, "one"), (-8, prose(80)),
]


def test_awkward_rows_of_every_stage(spark, corpus):
    """Nulls in any column, empty and very long texts, repeated rows and further columns with names that the operators use themselves."""
    rows = AWKWARD + AWKWARD[4:8]
    d = spark.createDataFrame([(i, t, None, None if i else "s", None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in ("score", "class_id", "copy_of", "h1", "h2", "gone", "digest", "ids", "_text", "part", "head"):
        d = d.withColumn(c, F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, corpus[0]).collect()
        ids = [r["doc_id"] for r in out]
        if name == "near_duplicates":  # the repeated rows go, other texts of an id stay
            assert sorted(i for i in ids if i is not None) == [-8, 1, 2, 3, 4, 4, 5, 6, 7] and ids.count(None) == 3
        elif name != "quality":
            assert sorted((i is None, i or 0) for i in ids) == sorted((i is None, i or 0) for i, _ in rows)
        if name == "repeated_passages":
            assert {r["text"] for r in out} - {None, ""} == {t for _, t in rows} - {None, ""}
        if name == "tokens":
            assert all(r["n_tokens"] == 0 for r in out if r["doc_id"] in (1, 2, 3))
        elif name == "quality":
            assert set(ids) <= {i for i, _ in rows} and all(ids.count(i) in (0, n) for i, n in ((4, 4), (2, 2), (3, 2)))


def test_ties_stay(spark, corpus):
    """Of equal scores all or none are rejected; of texts exactly as similar as the threshold one stays."""
    w = [f"t{k}" for k in range(94)]  # 90 shingles; 10 of them go with the last 10 words: 80 shared of 100 in all
    a, b = " ".join(w), " ".join([*w[:84], *(f"u{k}" for k in range(10))])
    rows = [(1, a), (2, b)]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, d, corpus[0]).collect()] == [1]
    same = spark.createDataFrame([(k, "equal text.", "en", "s", 1) for k in range(9)], d.schema)
    assert corpus_pipeline.quality(spark, same, corpus[0]).count() in (0, 9)
