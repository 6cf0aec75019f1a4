"""Results as committed batches, and a view of the newest result of each document that is brought up to date by increments.

    data/folder=<folder>/bucket=<b>/    the rows of a batch, dealt out by hash of the document's name
    commits/<batch>.<folder>            an empty file: this batch counts, and these are its files
    view/<folder>/bucket=<b>/           the newest row of each document, for the buckets that a version touched
    views/<version>.json                what the version covers: the last batch, and each bucket's folder

A batch counts from the moment its commit stands, so one that is killed leaves files that nothing reads, and one that runs
again is ignored. A log has one writer. A look at one document reads its bucket only: of the view one folder, of the batches
since then one partition each, and in their files what the name's Bloom filter and statistics leave.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

BUCKETS = 64
RESULT = {"document_name": "string", "document_type": "string", "processing_status": "string", "confidence": "double", "result_json": "string", "updated_at": "timestamp", "seq": "long"}
#: Of a document's rows the newest counts: by time, then batch, then place in the batch, then text, so reruns agree.
ORDER = ("updated_at", "batch", "seq", "result_json")


def bucket(name: Column) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")


def _number(file: str) -> int:
    return int(file.partition(".")[0])


def commits(spark: SparkSession, path: str, after: int = -1) -> dict[int, str]:
    """The folder of each committed batch after a batch."""
    out: dict[int, str] = {}
    for f in shared.names(spark, f"{path}/commits"):
        if _number(f) > after:
            out.setdefault(_number(f), f.partition(".")[2])
    return out


def is_committed(spark: SparkSession, path: str, batch: int) -> bool:
    return any(_number(f) == batch for f in shared.names(spark, f"{path}/commits"))


def _write(rows: DataFrame, path: str) -> None:
    dealt = rows.withColumn("bucket", bucket(F.col("document_name"))).repartition("bucket").sortWithinPartitions("bucket", "document_name")
    dealt.write.partitionBy("bucket").option("parquet.bloom.filter.enabled#document_name", "true").parquet(path)


def commit(results: DataFrame, path: str, batch: int) -> bool:
    """Append results(document_name, document_type, processing_status, confidence, result_json, updated_at, seq) as a batch; False,
    and nothing happens, if a batch of that number was committed before. Rows without a name are left out."""
    spark = results.sparkSession
    if is_committed(spark, path, batch):
        return False
    folder = uuid.uuid4().hex
    rows = results.where("document_name IS NOT NULL").select(*(F.col(c).cast(t).alias(c) for c, t in RESULT.items()), F.lit(batch).cast("long").alias("batch"))
    _write(rows.withColumn("created_at", F.col("updated_at")), f"{path}/data/folder={folder}")
    shared.mark(spark, f"{path}/commits/{batch:020d}.{folder}")
    return True


def view(spark: SparkSession, path: str) -> dict:
    """The newest version of the view: version, through (its last batch) and folders by bucket."""
    files = [f for f in shared.names(spark, f"{path}/views") if f.endswith(".json")]
    if not files:
        return {"version": 0, "through": -1, "folders": {}}
    text = "".join(r.value for r in spark.read.text(f"{path}/views/{files[-1]}").collect())
    return {"version": _number(files[-1]), **json.loads(text)}


def _schema(*more: str) -> str:
    return ", ".join([*(f"{c} {t}" for c, t in RESULT.items()), "batch long", "created_at timestamp", *more])


def _batches(spark: SparkSession, path: str, after: int) -> DataFrame:
    folders = [f"{path}/data/folder={f}" for f in commits(spark, path, after).values()]
    schema = _schema("folder string", "bucket int")
    if not folders:
        return spark.createDataFrame([], schema).drop("folder")
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders).drop("folder")


def _covered(spark: SparkSession, path: str, folders: dict[str, str], buckets: list[int] | None) -> DataFrame:
    wanted = [f"{path}/view/{f}/bucket={b}" for b, f in folders.items() if buckets is None or int(b) in buckets]
    return spark.read.schema(_schema()).parquet(*wanted) if wanted else spark.createDataFrame([], _schema())


def _newest(rows: DataFrame) -> DataFrame:
    rest = [c for c in (*RESULT, "batch") if c != "document_name"]
    best = rows.groupBy("document_name").agg(F.max_by(F.struct(*rest), F.struct(*ORDER)).alias("_r"), F.min("created_at").alias("created_at"))
    return best.select("document_name", *(f"_r.{c}" for c in rest), "created_at")


def latest(spark: SparkSession, path: str, document_name: str | None = None) -> DataFrame:
    """The newest row of each document, or of one: the log's columns, batch, created_at (the time of its first row) and id.

    id names the document whatever happens to the log: the MD5 of its name, in hex.
    """
    at = view(spark, path)
    new = _batches(spark, path, at["through"])
    if document_name is None:
        old = _covered(spark, path, at["folders"], None)
    else:
        b = spark.range(1).select(bucket(F.lit(document_name))).first()[0]
        new = new.where((F.col("bucket") == b) & (F.col("document_name") == document_name))
        old = _covered(spark, path, at["folders"], [b]).where(F.col("document_name") == document_name)
    return _newest(new.drop("bucket").unionByName(old)).withColumn("id", F.md5(F.col("document_name").cast("binary")))


def recent(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """All documents, newest first, or the n newest, without their results' text."""
    out = latest(spark, path).drop("result_json").orderBy(F.desc("updated_at"), F.desc("batch"), F.desc("seq"), "document_name")
    return out if n is None else out.limit(n)


def compact(spark: SparkSession, path: str) -> int:
    """Bring the view up to date with the batches since its version: only buckets that they touch are written. Returns the version.

    Who reads the version before goes on reading its folders; they stay.
    """
    at = view(spark, path)
    found = commits(spark, path, at["through"])
    if not found:
        return at["version"]
    new = _batches(spark, path, at["through"])
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
    folder = uuid.uuid4().hex
    if touched:
        _write(_newest(new.drop("bucket").unionByName(_covered(spark, path, at["folders"], touched))), f"{path}/view/{folder}")
    folders = at["folders"] | {str(b): folder for b in touched}
    shared.put(spark, f"{path}/views/{at['version'] + 1:020d}.json", json.dumps({"through": max(found), "folders": folders}))
    return at["version"] + 1
