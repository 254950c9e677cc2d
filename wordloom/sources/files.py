"""File sources and sinks: novels as binary files, manifests as JSON, page items."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType, StructType

from wordloom.functions.hashing import fnv_hex
from wordloom.functions.text import normalize_novel, trim_all
from wordloom.plans.workers import in_slices

SUPPORTED = "(?i)\\.(txt|pdf)\\z"
PAGE_ITEMS = "array<struct<str:string,eol:boolean>>"


def is_text_file(name: Column) -> Column:
    return F.lower(name).endswith(".txt")


def is_pdf_file(name: Column) -> Column:
    return F.lower(name).endswith(".pdf")


def is_supported_file(name: Column) -> Column:
    return name.rlike(SUPPORTED)


def decode_bytes(raw: bytes | None, lenient: bool = False) -> str | None:
    """Bytes to text: byte order marks of UTF-16 and UTF-8, then UTF-8, then GB18030.

    Strict by default (None where nothing fits); lenient replaces what doesn't
    fit UTF-8 only if GB18030 is no better choice, and composes (NFC).
    """
    if raw is None:
        return None
    if lenient:
        text = raw.decode("utf-8-sig", "replace")
        if "�" in text:
            text = raw.decode("gb18030", "replace")
        return unicodedata.normalize("NFC", text)
    for mark, codec in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[2:].decode(codec, "replace")
    for codec in ("utf-8-sig", "gb18030"):
        try:
            return raw.decode(codec)
        except UnicodeDecodeError:
            continue
    return None


def _decoder(lenient: bool):
    @in_slices
    def decode(content: pa.Array) -> pa.Array:
        return pa.array([decode_bytes(raw.as_py(), lenient) for raw in content], pa.string())

    return arrow_udf(decode, StringType())


#: Column functions: files as text, strictly and leniently.
decode_novel, decode_corpus = _decoder(False), _decoder(True)


def fingerprint(name: Column, size: Column, modified_ms: Column, text: Column) -> Column:
    """``novel-`` and the FNV-1a of name, size, time and both ends of the text."""
    tail = F.when(F.length(text) <= 512, text).otherwise(F.right(text, F.lit(512)))
    return F.concat(F.lit("novel-"), fnv_hex(F.concat_ws("|", name, size.cast("string"), modified_ms.cast("string"), F.left(text, F.lit(512)), tail)))


def finished(raw: DataFrame) -> DataFrame:
    """Rows of read files (path, file_name, file_size, modified_ms, sha256, raw) with text, fingerprint and error."""
    error = F.when(F.col("raw").isNull(), "unknown encoding").when(trim_all(F.col("raw")) == "", "empty file")
    return raw.select("path", "file_name", "file_size", "modified_ms", "sha256", normalize_novel(F.col("raw")).alias("text"), fingerprint(F.col("file_name"), F.col("file_size"), F.col("modified_ms"), F.col("raw")).alias("fingerprint"), error.alias("error"))


def read_novels(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Rows (path, file_name, file_size, modified_ms, sha256, text, fingerprint, error) of the .txt files under a path.

    Files that can't be decoded or are blank keep a row with an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    named = files.withColumn("file_name", F.regexp_extract("path", "[^/]*\\z", 0)).where(is_text_file(F.col("file_name")))
    return finished(named.select("path", "file_name", F.col("length").alias("file_size"), F.unix_millis("modificationTime").alias("modified_ms"), F.sha2("content", 256).alias("sha256"), decode_novel("content").alias("raw")))


def changed_files(files: DataFrame, recorded: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """Files whose bytes are not those that were recorded (key, recorded)."""
    return files.join(recorded.select(key, F.col(digest).alias("recorded")), key).where(F.col(digest) != F.col("recorded"))


def page_text(items: Column) -> Column:
    """The text of one page from its items in order: a space only between ASCII letters or digits, line ends as marked."""
    start = F.lit("")

    def add(text: Column, item: Column) -> Column:
        value = F.coalesce(item["str"], F.lit(""))
        joint = F.when(text.rlike("[A-Za-z0-9]\\z") & value.rlike("\\A[A-Za-z0-9]"), F.lit(" ")).otherwise("")
        grown = F.concat(text, joint, value)
        return F.when(F.coalesce(item["eol"], F.lit(False)) & ~grown.endswith("\n"), F.concat(grown, F.lit("\n"))).otherwise(grown)

    return trim_all(F.aggregate(items, start, add))


def pages_to_documents(pages: DataFrame, key: str, page: str = "page", text: str = "text") -> DataFrame:
    """One text per document, pages in order with an empty line between; blank ones carry an error."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(page, text))), lambda p: p[text])
    joined = pages.groupBy(key).agg(F.array_join(ordered, "\n\n").alias("text"))
    return joined.withColumn("error", F.when(trim_all(F.col("text")) == "", "no text layer"))


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A whole-file JSON array or object, with an explicit schema."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def demo_novel(spark: SparkSession) -> DataFrame:
    """A built-in sample of two short chapters."""
    text = "第一章 雨夜\n雨下了一整夜。他选择留在家里，等待朋友的消息。\n\n第二章 清晨\n清晨的街道很安静。她决定去图书馆看书。"
    return spark.createDataFrame([("demo", "demo.txt", text)], "fingerprint string, file_name string, text string")
