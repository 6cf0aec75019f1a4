"""A landing folder of text documents, read as a stream into the ledger of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.process import envelope, process_documents
from ..sources import ledger


def watch(spark: SparkSession, folder: str, document_type: str, log: str, checkpoint: str, mode: str = "documented") -> StreamingQuery:
    """Start a query that processes each new text file of a folder once and commits its result to the ledger at log.

    Documents need nothing from each other, so there is no state: a batch is one run of the batch plan. A batch that the
    stream runs again, because it was stopped before the stream noted it, is not processed again if its rows were
    committed, and leaves one set of rows if they were not. Files of one name in a batch are numbered by time and path.
    """
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    path = F.col("_metadata.file_path")
    docs = files.select(F.element_at(F.split(path, "/"), -1).alias("doc_id"), F.lit(document_type).alias("document_type"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("updated_at"), path.alias("path"))

    def batch(df: DataFrame, number: int) -> None:
        if ledger.is_committed(df.sparkSession, log, number):
            return
        # a path of its own for each file, so that files of one name have rows of their own
        results = envelope(process_documents(df.select(F.col("path").alias("doc_id"), "document_type", "text"), mode), "document_type", "processing_status", "overall_confidence")
        rows = results.withColumnRenamed("doc_id", "path").join(df.select("path", "doc_id", "updated_at"), "path")
        seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("updated_at", "path"))
        ledger.commit(rows.select(F.col("doc_id").alias("document_name"), "document_type", "processing_status", F.col("overall_confidence").alias("confidence"), "result_json", "updated_at", seq.alias("seq")), log, number)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
