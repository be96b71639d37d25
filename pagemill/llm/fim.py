"""Fill-in-middle transformation by a two-pass streaming matcher.

A text is a sequence of units, the matches of a pattern from left to right: code points, words, lines. Two ranks cut it into prefix, middle and
suffix. The first pass counts the units; the second advances one lazy match iterator to the smaller rank and on to the larger, and keeps the two
offsets. No array of units or of their offsets exists at any time, so the memory of a text of any length is the text's.

Both ranks, the form and whether a text is changed at all are hashed from the document's id, so a row's result depends on that row alone and a
lost task comes out the same when it runs again. There is no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import rounds, ship

#: Sentinels before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit; any code point, line ends too.
CODE_POINT = r"(?s:.)"


def count_units(pattern: re.Pattern, text: str) -> int:
    """The first pass: how many matches there are."""
    counter = count()
    deque(zip(pattern.finditer(text), counter), maxlen=0)
    return next(counter)


def cut_offsets(pattern: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """The second pass: where the unit of rank `low` ends, and that of rank `high` (from 1; 0 is the text's start)."""
    matches = pattern.finditer(text)
    first = next(islice(matches, low - 1, None)).end() if low else 0
    second = next(islice(matches, high - low - 1, None)).end() if high > low else first
    return first, second


def numbers(seed: int, doc_id) -> tuple[int, int, int, int]:
    """Four 32-bit integers of a seed and an id; a null id is an empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def split(pattern: re.Pattern, text: str, doc_id, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None]:
    """Units, form, and the offsets of both cuts."""
    n = count_units(pattern, text)
    h1, h2, h3, h4 = numbers(seed, doc_id)
    if not n or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, "spm" if h4 % 100 < spm else "psm", *cut_offsets(pattern, text, low, high)


def transform(docs: DataFrame, unit: str = CODE_POINT, seed: int = 1, rate: int = 90, spm: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output for each row of `docs`.

    unit: pattern of a unit, with no empty match. What stands between two units goes with the later one, what follows the last with the suffix. rate: per cent of
    texts that are changed; spm: per cent of those whose suffix comes first. Plain texts stay as they are: those without a unit, those that hold a sentinel, and
    the others by rate. prefix_chars and middle_chars count code points and are null for plain texts. A null text counts as empty, a null id as
    an empty string; repeated rows give repeated rows; an empty table gives an empty one; other columns are ignored.
    """
    ship(docs.sparkSession)
    if re.compile(unit).match(""):
        raise ValueError("a unit has at least one character")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit)
        for batch in rounds(batches, "_text"):
            ns, forms, firsts, middles, outputs = [], [], [], [], []
            for i, text in zip(batch["_id"].to_pylist(), batch["_text"].to_pylist()):
                text = text or ""
                n, form, a, b = split(pattern, text, i, seed, rate, spm)
                if form == "psm":
                    out = "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))
                elif form == "spm":
                    out = "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
                else:
                    out = text
                ns.append(n)
                forms.append(form)
                firsts.append(a)
                middles.append(None if a is None else b - a)
                outputs.append(out)
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], pa.array(ns, pa.int64()), pa.array(forms, pa.string()), pa.array(firsts, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    named = docs.selectExpr(f"`{id_col}` AS _id", f"`{text_col}` AS _text")
    return named.mapInArrow(run, f"doc_id {dict(named.dtypes)['_id']}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Changed texts hold no sentinel, so each of the three stands in an output once."""
    after = lambda text, mark: F.substring_index(text, mark, -1)
    middle = after(output, MIDDLE)
    head = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(after(F.substring_index(head, SUFFIX, 1), PREFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, after(F.substring_index(head, PREFIX, 1), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark, sf_dir: str) -> DataFrame:
    made = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (
  SELECT doc_id, text, length(text) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM d),
c AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || substring(text, 1, a) || '<S>' || substring(text, b + 1) || '<M>' || substring(text, a + 1, b - a)
    ELSE '<S>' || substring(text, b + 1) || '<P>' || substring(text, 1, a) || '<M>' || substring(text, a + 1, b - a) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""
