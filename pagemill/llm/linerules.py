"""Quality rules [native]: line-first cleaning.

Every line is judged by itself (punctuation, navigation, boilerplate, symbols, repetition); failing lines go, and a document
that loses too large a share of its words is rejected. All of it is column expressions: one pass over the table, no shuffle,
no Python. The base figures count whole texts.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import NOT_WORD, let

#: Rules of a line. Phrases are matched in lower case.
BOILERPLATE = (
    "lorem ipsum", "javascript is", "enable javascript", "cookie policy", "use of cookies", "uses cookies", "privacy policy",
    "terms of use", "terms of service", "all rights reserved", "click here", "read more", "sign up", "log in", "subscribe to",
    "share this", "back to top", "skip to content",
)
SYMBOLS = r"[#*$%&|<>]"
#: A line may have one symbol per so many words.
SYMBOL_WORDS = 5
#: Separators that make a line navigation, at so many or more.
NAV_SEPARATORS = 3
#: A line without an end mark is navigation below so many words, and a failed sentence from so many on.
NAV_WORDS, OPEN_WORDS = 3, 5
#: A line of so many words or more may repeat them: distinct ones are at least this share.
REPEAT_WORDS, REPEAT_SHARE = 10, 0.3
#: A document that loses more than this share of its words is rejected.
MAX_LOSS = 0.5


SEPARATORS = r"[|»•›·]"
#: What may follow an end mark; space first.
SPACE, CLOSERS, MARKS = " \t\n\x0b\x0c\r", "\"'”’»)]", ".!?:;…。！？"


def _count(line: Column, symbols: str) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, symbols, ""))


def _line(line: Column, odd_space: Column, bars: Column, phrases: Column) -> Column:
    """A struct of a line's words, symbols and the rule that it fails (null: none). The flags tell whether its document has
    other white space than blanks, separators and boilerplate phrases at all: without them the plainer expression does."""
    words = F.when(odd_space, F.array_remove(F.split(line, NOT_WORD), "")).otherwise(F.array_remove(F.split(line, " "), ""))

    def judged(w: Column) -> Column:
        n = F.size(w)
        end = F.substring(F.rtrim(F.rtrim(line, F.lit(SPACE)), F.lit(CLOSERS)), -1, 1)
        closed = F.contains(F.lit(MARKS), end) & (end != "")
        symbols = _count(line, SYMBOLS)
        return let(
            symbols,
            lambda s: F.struct(
                s.alias("symbols"),
                F.when(n == 0, F.lit(None).cast("string"))
                .when(phrases & F.lower(line).rlike("|".join(BOILERPLATE)), "boilerplate")
                .when(bars & (_count(line, SEPARATORS) >= NAV_SEPARATORS), "navigation")
                .when(s * SYMBOL_WORDS > n, "symbols")
                .when((n >= REPEAT_WORDS) & (F.size(F.array_distinct(w)) < n * REPEAT_SHARE), "repetition")
                .when(~closed & (n < NAV_WORDS), "navigation")
                .when(~closed & (n >= OPEN_WORDS), "punctuation")
                .alias("rule"),
                line.alias("line"),
                w.alias("words"),
            ),
        )

    return let(words, judged)


#: Up to so many repeated windows are looked up in a list; more are found by sorting positions.
FEW = 64


def _repeated_words(words: Column) -> Column:
    """Words inside a three-word window that the text has twice or more, the first one's included. Windows are hashed to 64
    bits; equal neighbours in sorted order are the repeated ones, and each of their positions covers three words."""

    def hashes(w: Column) -> Column:
        return F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
        )

    def doubles(h: Column) -> Column:
        return let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))

    def listed(h: Column, d: Column) -> Column:
        at = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())
        return F.transform(at, lambda i: F.array(i, i + 1, i + 2))

    def by_position(h: Column) -> Column:
        def again(s: Column) -> Column:
            same = lambda x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
            return F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))

        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.transform(let(placed, again), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))

    def covered(h: Column) -> Column:
        return let(
            doubles(h),
            lambda d: F.when(F.size(d) == 0, 0).otherwise(
                F.size(F.array_distinct(F.flatten(F.when(F.size(d) <= FEW, listed(h, d)).otherwise(by_position(h)))))
            ),
        )

    return let(let(words, hashes), covered)


def line_clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """One row per row of `docs`: the id, base figures, the cleaned text and the verdict.

    Null and empty texts have no words: they fail the base rule and are not kept. Repeated ids or rows are judged one by one.
    Other columns of `docs` are ignored, whatever their names. An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"))
    low = F.lower("_t")
    flags = F.struct(
        F.col("_t").rlike(r"[\x09\x0B-\x0D]").alias("o"),
        F.col("_t").rlike(SEPARATORS).alias("b"),
        let(low, lambda t: reduce(or_, [F.contains(t, F.lit(p)) for p in BOILERPLATE])).alias("p"),
    )
    # let() and not a column of its own: the optimizer would put the flags' expressions into the lambda, for every line
    lines = base.select(
        "doc_id", let(flags, lambda f: F.transform(F.split("_t", "\n"), lambda x: _line(x, f["o"], f["b"], f["p"]))).alias("_l")
    )
    full = F.filter("_l", lambda x: F.size(x["words"]) > 0)
    words = F.flatten(F.transform("_l", lambda x: x["words"]))
    bad = F.filter("_l", lambda x: x["rule"].isNotNull())
    counted = lines.select(
        "doc_id",
        let(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _repeated_words(w).cast("long").alias("n_repeat_words"),
            ),
        ).alias("_w"),
        F.aggregate("_l", F.lit(0).cast("long"), lambda a, x: a + x["symbols"]).alias("n_symbols"),
        let(full, lambda f: F.size(f) - F.size(F.array_distinct(F.transform(f, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
        F.aggregate(bad, F.lit(0).cast("long"), lambda a, x: a + F.size(x["words"])).alias("words_removed"),
        F.size(bad).cast("long").alias("lines_removed"),
        F.array_join(F.transform(F.filter("_l", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n").alias("clean_text"),
    ).select("doc_id", "_w.*", "n_symbols", "n_dup_lines", "words_removed", "lines_removed", "clean_text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("words_removed") <= F.lit(max_loss) * F.col("n_words"))
    )


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_removed", "lines_removed")


def query(spark, sf_dir: str) -> DataFrame:
    return line_clean(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*COLUMNS)


def _oracle() -> str:
    word = r"[^\x20\x09-\x0D]+"
    end = r"[.!?:;…。！？][\"''”’»)\]]*[\x20\x09-\x0D]*$"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') ws FROM d),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) i, ws FROM w),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] x FROM p),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) n FROM r, (SELECT unnest([0, 1, 2]) k) GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) line FROM d),
l AS (SELECT doc_id, line, len(regexp_extract_all(line, '{word}')) n, len(list_distinct(regexp_extract_all(line, '{word}'))) u,
  regexp_matches(line, '{end}') closed, len(line) - len(regexp_replace(line, '{SYMBOLS}', '', 'g')) s,
  len(line) - len(regexp_replace(line, '[|»•›·]', '', 'g')) bars, regexp_matches(lower(line), '{"|".join(BOILERPLATE)}') b FROM l0),
j AS (SELECT doc_id, line, n, n > 0 AND (b OR bars >= {NAV_SEPARATORS} OR s * {SYMBOL_WORDS} > n
  OR (n >= {REPEAT_WORDS} AND u < n * {REPEAT_SHARE}) OR (NOT closed AND (n < {NAV_WORDS} OR n >= {OPEN_WORDS}))) bad FROM l),
a AS (SELECT doc_id, CAST(sum(n) AS BIGINT) n_words, CAST(count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS BIGINT) n_dup_lines,
  CAST(coalesce(sum(n) FILTER (bad), 0) AS BIGINT) words_removed, count(*) FILTER (bad) lines_removed FROM j GROUP BY doc_id),
f AS (SELECT doc_id, n_words, CAST(len(regexp_replace(t, '{NOT_WORD}', '', 'g')) AS BIGINT) word_chars,
  CAST(len(t) - len(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) n_symbols, n_dup_lines, coalesce(c.n, 0) n_repeat_words, words_removed, lines_removed
  FROM d JOIN a USING (doc_id) LEFT JOIN c USING (doc_id)),
x AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND words_removed <= {MAX_LOSS} * n_words kept, words_removed, lines_removed FROM x"""


ORACLE = _oracle()
