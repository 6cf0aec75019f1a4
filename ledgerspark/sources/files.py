"""Files to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .admission import MOST_BYTES, TYPES, extension


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, text) of text files, one row each."""
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name"), F.col("value").alias("text"))
    return rows


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, content_type, length, content, reader) of binary files.

    Files over the limit stay, without content, so that admission can name their fault; their content is
    never read. Spark lists no empty files. reader: what decodes a file, "pdf" or "image", null for other extensions.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("file_name")
    known = [name, F.lit(None).cast("string").alias("content_type"), "length"]
    small = files.where(F.col("length") <= MOST_BYTES).select(*known, "content")
    large = files.where(F.col("length") > MOST_BYTES).select(*known, F.lit(None).cast("binary").alias("content"))
    ext = extension(F.col("file_name"))
    return small.unionByName(large).withColumn("reader", F.when(ext == "pdf", "pdf").when(ext.isin(*TYPES), "image"))


def decode_pdf(files: DataFrame) -> DataFrame:
    """(file_name, page_number, text, error) of PDF files with native text; needs the pypdf package on the executors.

    A page that cannot be read ends its file with a row of its own that has the error; pages before it
    stay. Files without content give no rows.
    """

    def run(batches):
        import io

        import pyarrow as pa
        from pypdf import PdfReader

        for b in batches:
            rows = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = 0
                try:
                    for k, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
                        rows.append((name, k, page.extract_text() or "", None))
                except Exception as e:  # noqa: BLE001  the library raises many kinds on damaged files
                    rows.append((name, k + 1, None, f"{type(e).__name__}: {e}"))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["file_name", "page_number", "text", "error"])

    return files.where("content IS NOT NULL").select("file_name", "content").mapInArrow(run, "file_name string, page_number int, text string, error string")


def best_reading(readings: DataFrame) -> DataFrame:
    """Of several OCR readings(file_name, page_number, ord, text) of a page the best: length plus 250 per financial word, first among equals."""
    # Fixed values.
    words = ["total", "assets", "liabilities", "cash", "operating", "investing", "financing", "profit", "income", "capital"]
    score = F.length("text")
    for w in words:
        score = score + F.when(F.lower("text").contains(w), 250).otherwise(0)
    best = F.max_by("text", F.struct(score.alias("score"), -F.col("ord")))
    return readings.groupBy("file_name", "page_number").agg(best.alias("text"))
