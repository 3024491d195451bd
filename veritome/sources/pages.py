"""Documents from files: a row per page, errors as data, and a cache that only re-reads what changed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritome.operators.cleaning import clean_pages

#: Goes up when cleaning changes, so that cached pages are made anew.
CLEAN_VERSION = "1"

Extractor = Callable[[bytes], list[str]]


def text_pages(content: bytes) -> list[str]:
    """Pages of a text file, parted by form feeds."""
    return content.decode("utf-8").split("\f")


def pdf_pages(content: bytes) -> list[str]:
    """Text blocks of each page of a PDF, in the order of its content stream; needs the optional PyMuPDF."""
    import pymupdf

    with pymupdf.open(stream=content, filetype="pdf") as doc:
        return ["\n\n".join(b[4].strip("\n") for b in page.get_text("blocks", sort=False) if b[6] == 0) for page in doc]


def scan(spark: SparkSession, folder: str, pattern: str = "*.txt", extract: Extractor = text_pages) -> DataFrame:
    """(doc, source_sha256, page, text, error): pages of all files; a file that can't be read is one row with its error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("doc"), F.sha2("content", 256).alias("source_sha256"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, sha, content in zip(*(b.column(i) for i in range(3)), strict=True):
                try:
                    texts, error = extract(content.as_py()), None
                except Exception as e:  # a bad file is a row, not the end of the job
                    texts, error = [None], f"{type(e).__name__}: {e}"
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc.as_py()] * n), pa.array([sha.as_py()] * n), pa.array(range(1, n + 1), pa.int32()), pa.array(texts, pa.string()), pa.array([error] * n, pa.string())],
                    ["doc", "source_sha256", "page", "text", "error"],
                )

    return rows.mapInArrow(run, "doc string, source_sha256 string, page int, text string, error string")


def load_corpus(spark: SparkSession, folder: str, pattern: str = "*.txt", *, extract: Extractor = text_pages, skip_errors: bool = False) -> DataFrame:
    """(doc, page, text); unreadable files are left out, or fail the query."""
    pages = scan(spark, folder, pattern, extract)
    if skip_errors:
        return pages.filter("error is null").select("doc", "page", "text")
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "doc", "error"))).otherwise(F.col("text"))
    return pages.select("doc", "page", checked.alias("text"))


def ingest(spark: SparkSession, folder: str, cache: str, pattern: str = "*.txt", *, extract: Extractor = text_pages, force: bool = False) -> DataFrame:
    """Cleaned pages (doc, page, text), from the cache where source hash and cleaning version agree.

    Only other files are read again; their pages are cleaned and appended under the current version.
    """
    pages = scan(spark, folder, pattern, extract).filter("error is null")
    hashes = pages.select("doc", "source_sha256").distinct()
    known = _cached(spark, cache)
    stale = hashes if known is None or force else hashes.join(known.select("doc", "source_sha256").distinct(), ["doc", "source_sha256"], "left_anti")
    fresh = clean_pages(pages.join(stale, ["doc", "source_sha256"], "left_semi"))
    sealed = fresh.withColumn("text_sha256", F.sha2("text", 256)).withColumn("clean_version", F.lit(CLEAN_VERSION))
    mode = "overwrite" if force or known is None else "append"
    sealed.drop("error").write.mode(mode).partitionBy("clean_version").parquet(cache)
    return load_cached(spark, cache).join(hashes, ["doc", "source_sha256"], "left_semi").select("doc", "page", "text")


def _cached(spark: SparkSession, cache: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(cache).filter(F.col("clean_version") == CLEAN_VERSION)
    except AnalysisException:
        return None


def load_cached(spark: SparkSession, cache: str) -> DataFrame:
    """Cached pages; a page whose text doesn't match its hash fails the query."""
    rows = spark.read.parquet(cache).filter(F.col("clean_version") == CLEAN_VERSION)
    sound = F.when(F.sha2("text", 256) != F.col("text_sha256"), F.raise_error(F.concat(F.lit("damaged cache page of "), "doc"))).otherwise(F.col("text"))
    return rows.withColumn("text", sound)
