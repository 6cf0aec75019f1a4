"""Results: an append-only log and the latest row per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


COLUMNS = "document_name STRING NOT NULL, document_type STRING, processing_status STRING, confidence DOUBLE, result_json STRING, updated_at TIMESTAMP, seq BIGINT"


def create_log(spark: SparkSession, name: str, path: str | None = None) -> None:
    """The log as a table, if it does not exist yet: rows are appended, latest() makes a name unique and finds created_at."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet" + (f" LOCATION '{path}'" if path else ""))


def append(results: DataFrame, path: str) -> None:
    """Append results(document_name, document_type, processing_status, confidence, result_json, updated_at, seq) to the log."""
    results.write.mode("append").parquet(path)


def latest(log: DataFrame, name: str = "document_name", order: tuple[str, ...] = ("updated_at", "seq")) -> DataFrame:
    """The newest row of each name, with created_at, the time of its first."""
    newest = log.groupBy(name).agg(F.max_by(F.struct(*[c for c in log.columns if c != name]), F.struct(*order)).alias("_r"), F.min(order[0]).alias("created_at"))
    return newest.select(name, "_r.*", "created_at")


def newest(log: DataFrame, document_name: str) -> DataFrame:
    """The newest row of one document; the name is pushed into the scan."""
    return latest(log.where(F.col("document_name") == document_name))


def get_latest(spark: SparkSession, path: str, document_name: str) -> DataFrame:
    """The newest result of one document of the log at path."""
    return newest(spark.read.parquet(path), document_name)


def recent(log: DataFrame, n: int | None = None) -> DataFrame:
    """All documents, newest first, or the n newest, without their results' text."""
    cols = ["document_name", "document_type", "processing_status", "confidence", "updated_at", "seq"]
    out = latest(log.select(*cols)).orderBy(F.desc("updated_at"), F.desc("seq"))
    return out if n is None else out.limit(n)


def list_documents(spark: SparkSession, path: str) -> DataFrame:
    """All documents of the log at path, newest first."""
    return recent(spark.read.parquet(path))


def numbered(log: DataFrame, name: str = "document_name", order: tuple[str, ...] = ("updated_at", "seq")) -> DataFrame:
    """The log with each row's version of its document."""
    return log.withColumn("version", F.row_number().over(Window.partitionBy(name).orderBy(*order)))


def write_json(envelopes: DataFrame, path: str) -> None:
    """Each document's result_json as a line of text files."""
    envelopes.select(F.col("result_json").alias("value")).write.mode("errorifexists").text(path)


def write_csv(field_table: DataFrame, path: str) -> None:
    """A table of fields by periods (matching.period_table()) as CSV files with a header; nulls are empty."""
    field_table.write.mode("errorifexists").option("header", True).option("nullValue", "").csv(path)


def write_csv_per_document(csv: DataFrame, path: str) -> None:
    """One CSV file a document of csv(doc_id, csv), in a folder named by its id (matching.csv_texts()).

    A file costs far more than its bytes, so rows are dealt out by document to as many tasks as a shuffle has: small tables lie
    in one partition, whose task would make all files, and a number that is named is not coalesced by size.
    """
    tasks = int(csv.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    csv.select("doc_id", "csv").repartition(tasks, "doc_id").write.mode("errorifexists").partitionBy("doc_id").text(path)
