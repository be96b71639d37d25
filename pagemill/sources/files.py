"""Pages from files and HTTP bodies, link lists, and Markdown files out. What cannot be read is a row with an error."""

from __future__ import annotations

import codecs
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from pagemill.functions.text import content_type

MAX_BYTES = 10 << 20
MEDIA_TYPES = ("text/html", "application/xhtml+xml")
#: Byte order marks, the longer ones first.
_BOMS = {codecs.BOM_UTF32_BE: "utf-32", codecs.BOM_UTF32_LE: "utf-32", codecs.BOM_UTF8: "utf-8-sig", codecs.BOM_UTF16_BE: "utf-16", codecs.BOM_UTF16_LE: "utf-16"}
#: Bytes at the beginning of a page that may declare its charset.
DECLARED_WITHIN = 4096
_TAG = re.compile(r"<meta\b([^>]*)", re.I)
_FIELD = re.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>]*))""", re.I)
_LABEL = re.compile(r"[a-z0-9._:+-]+", re.I)


def declared_charset(page: bytes) -> str | None:
    """The charset that the first <meta> with one declares, as an attribute or as a parameter of its content."""
    for tag in _TAG.finditer(page[:DECLARED_WITHIN].decode("latin-1")):
        fields = {m[1].lower(): (m[2] or m[3] or m[4] or "").strip() for m in _FIELD.finditer(tag[1])}
        value = fields.get("charset") or fields.get("content", "").lower().partition("charset")[2].strip().removeprefix("=").strip()
        if label := _LABEL.match(value):
            return label[0]
    return None


def decode_html(body: bytes, declared: str | None = None) -> tuple[str | None, str | None, str | None]:
    """Text, charset and error. The header's charset counts first, then a byte order mark, a <meta> in the first bytes, UTF-8 if
    that is what the bytes are, and Windows-1252."""
    told = declared or next((name for mark, name in _BOMS.items() if body.startswith(mark)), None) or declared_charset(body)
    error = None
    for label in [told] if told else ["utf-8", "cp1252"]:
        try:
            codec = codecs.lookup(label)
            return body.decode(codec.name), codec.name, None
        except LookupError:
            return None, None, f"unknown charset: {label}"
        except UnicodeError as e:
            error = None, codec.name, f"not valid {codec.name}: {e}"
    return error


_DECODED = T.StructType([T.StructField(n, T.StringType()) for n in ("html", "charset", "error")])
_DECODED_ARROW = pa.struct([(n, pa.string()) for n in ("html", "charset", "error")])


@arrow_udf(_DECODED)
def decode_body(body: pa.Array, declared: pa.Array) -> pa.Array:
    rows = [(None, None, "no body") if b is None else decode_html(b, d) for b, d in zip(body.to_pylist(), declared.to_pylist())]
    return pa.array([dict(zip(("html", "charset", "error"), r)) for r in rows], _DECODED_ARROW)


def pages_from_responses(responses: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """requested_url, final_url, status_code, headers, content -> pages with html, media_type, charset, or an error. Other media types
    than HTML are refused unless the header says none; so are large and blank bodies."""
    typed = responses.withColumn("t", content_type(F.col("headers")))
    media = F.col("t.media_type")
    early = (
        F.when(~F.coalesce(F.col("status_code").between(200, 399), F.lit(False)), F.concat(F.lit("HTTP "), F.coalesce(F.col("status_code").cast("string"), F.lit("none"))))
        .when((media != "") & ~media.isin(*MEDIA_TYPES), F.concat(F.lit("expected HTML, received "), media))
        .when(F.octet_length("content") > max_bytes, "the body is too large")
    )
    # refused bodies do not reach Python
    body = F.when(early.isNull(), F.col("content"))
    decoded = typed.withColumn("d", decode_body(body, F.col("t.charset")))
    blank = F.when(F.trim(F.regexp_replace("d.html", r"\s+", " ")) == "", "empty page")
    return decoded.select(
        "requested_url", "final_url", "status_code", "headers", F.when(media == "", MEDIA_TYPES[0]).otherwise(media).alias("media_type"), "d.charset",
        F.when(F.coalesce(early, blank).isNull(), F.col("d.html")).alias("html"), F.coalesce(early, F.col("d.error"), blank).alias("error"),
    )


def local_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """url, html, error of HTML files: strict UTF-8, no other charset is guessed."""
    files = spark.read.format("binaryFile").load(path)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(valid, F.decode("content", "UTF-8"))
    return files.select(
        F.regexp_replace("path", "^file:/+", "file:///").alias("url"),
        F.when(F.trim(F.regexp_replace(text, r"\s+", " ")) != "", text).alias("html"),
        F.when(~valid, "not valid UTF-8").when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", "empty page").alias("error"),
    )


def hadoop(spark: SparkSession, path: str):
    """The store of a path and the path, as Spark's own readers see them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def expand_patterns(spark: SparkSession, patterns: list[str]) -> tuple[list[str], list[str]]:
    """(paths, unmatched): what each pattern matches in its store, in the patterns' order and sorted within each; a path that several
    patterns match comes as often. `~` is the home folder; a wildcard matches no hidden name."""
    found, unmatched = [], []
    for pattern in patterns:
        store, place = hadoop(spark, os.path.expanduser(pattern))
        paths = [hit.getPath() for hit in store.globStatus(place) or ()]
        if not place.getName().startswith("."):
            paths = [p for p in paths if not p.getName().startswith(".")]
        names = sorted(p.toString() if place.toUri().getScheme() else p.toUri().getPath() for p in paths)
        found += names
        if not names:
            unmatched.append(pattern)
    return found, unmatched


def link_lists(spark: SparkSession, path: str | list[str], lenient: bool = False) -> DataFrame:
    """path, text, error of Markdown files with links; lenient: unreadable files are left out."""
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", str(lenient).lower()).load(path)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    rows = files.select("path", F.when(valid, F.decode("content", "UTF-8")).alias("text"), F.when(~valid, "not valid UTF-8").alias("error"))
    return rows.where("error IS NULL") if lenient else rows


def write_markdown(documents: DataFrame, folder: str) -> DataFrame:
    """Writes output_path, markdown below a folder, each file under another name first; returns output_path and error. Paths that would
    leave the folder are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            errors = []
            for path, text in zip(batch["output_path"].to_pylist(), batch["markdown"].to_pylist()):
                parts = (path or "").split("/")
                if not path or text is None or any(p in ("", ".", "..") for p in parts):
                    errors.append("no text, or not a path below the folder")
                    continue
                try:
                    place = f"{base}/{path}"
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    draft = f"{place}.{uuid.uuid4().hex}.tmp"
                    with store.open_output_stream(draft) as out:
                        out.write(text.encode("utf-8"))
                    store.move(draft, place)
                    errors.append(None)
                except OSError as error:
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([batch["output_path"], pa.array(errors, pa.string())], ["output_path", "error"])

    return documents.select("output_path", "markdown").mapInArrow(run, "output_path string, error string")
