"""From documents to tokens: quality, near-duplicates, repeated passages, benchmark leaks, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All stages read the columns of documents by name and
ignore others, bear an empty table, null ids and null, empty and very long texts, and treat rows alike whatever their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import bpe, dartminhash, decontam, preference, substring
from pagemill.llm.common import stored
from pagemill.session import delete, scratch, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject: those with a score of 0.5 or more, a tie with the threshold included. Null and empty texts are
    scored as empty ones. Rows that repeat one another share their fate. Without labels of both classes all stay."""
    ranker = preference.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return preference.keep_good(docs, ranker, COLUMNS)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group. Of rows with the same id and text one stays; texts that differ under one id stay, if the
    id heads its group, and go together if not. Texts without words are in no group. Rows with a null id are compared with none and all stay."""
    docs = docs.select(*COLUMNS)
    classes = stored(dartminhash.near_duplicates(docs), "classes")
    kept = docs.join(classes.where("doc_id <> class_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)
    if classes.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.where("doc_id IS NULL").union(kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]))


def repeated_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have; a text of nothing else becomes empty, a null one stays null or becomes empty. Rows of
    one id do not count as earlier than one another; rows with a null id keep their text and are no source."""
    carried = tuple(c for c in COLUMNS if c not in ("doc_id", "text", "n_chars"))
    clean = substring.remove_repeats(docs, outputs=("clean_text",), carry=carried)
    return clean.select("doc_id", F.col("clean_text").alias("text"), *carried, F.length("clean_text").cast("bigint").alias("n_chars")).select(*COLUMNS)


def benchmark_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; without items all stay."""
    docs = docs.select(*COLUMNS)
    return decontam.keep_clean(docs, decontam.fitted(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number, and the digest of what they decode to, for each row; a null text has no tokens."""
    return bpe.encode_texts(docs, bpe.vocabulary_path(), outputs=("ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: SQL can express neither the classifier, the signatures, the latent search nor the tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The stages one after another. What a stage has written for itself, and its input, go once its output is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name)
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
