"""Helpers that the training-data operators share: shared storage, prefix sums, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    A session of one machine may name none: its own temporary folder serves then. On a cluster that
    would lose data, so it raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder for intermediate tables")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores added as none of the columns (in any case) has."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


#: Bytes of one Arrow batch on its way to a Python worker or back.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of rows be larger than BATCH_BYTES, except for one long row; a smaller bound of the session stays.

    Spark's own bound of 64 MB counts several times for each task: as vectors that double when they grow, as a message, and in
    the worker. It holds for what the session plans from then on.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not re.fullmatch(r"\d+b?", now) or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


_resident: dict = {}


def resident(key: tuple, make: Callable[[], object]):
    """The heavy object that this Python worker keeps between tasks: one only, so an operator's goes when another's comes."""
    if key not in _resident:
        _resident.clear()
        gc.collect()
        _resident[key] = make()
    return _resident[key]


def release() -> None:
    """Let go of a heavy object that is there, in a task that needs none of its own."""
    resident(("none",), object)


class Recent:
    """What is known of words, within `most` bytes: those not met since half of it was filled go.

    Words of over LONG bytes are known for one batch only.
    """

    LONG, SPACE = 200, 200  # SPACE: what an entry takes beside its bytes

    def __init__(self, most: int):
        self.half, self.now, self.before, self.filled, self.long = most // 2, {}, {}, 0, []

    def unknown(self, words: set) -> list:
        """Start a batch of these words: those that put() has to tell; all stand in `now` afterwards."""
        for w in self.long:
            self.now.pop(w, None)
        self.long = []
        if self.filled > self.half:
            self.before, self.now, self.filled = self.now, {}, 0
        out = []
        for w in words.difference(self.now):
            got = self.before.get(w)
            if got is None:
                out.append(w)
            else:
                self.put(w, got)
        return out

    def put(self, word, got) -> None:
        self.now[word] = got
        if len(word) > self.LONG:
            self.long.append(word)
        else:
            self.filled += self.SPACE + len(word) + len(got)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])).parquet(path)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model may see: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def running_totals(df: DataFrame, order: list[Column], values: list[str], label: str) -> DataFrame:
    """Add {v}_before for each integer column v: its sum over all rows that stand before, by order.

    Rows are range-partitioned and sorted, each task sums its own rows as a stream, and the totals of
    the partitions (one row each) shift them. Integers only, so the result does not depend on how the
    rows were cut. Nulls count as zero. The table is materialized.
    """
    schema = T.StructType([*df.schema.fields, *(T.StructField(f"{v}_before", T.LongType()) for v in values), T.StructField("_part", T.IntegerType())])

    def local(batches):
        carry, part = dict.fromkeys(values, 0), TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            extra = []
            for v in values:
                x = b.column(v).fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
                c = np.cumsum(x)
                extra.append(pa.array(carry[v] + c - x, pa.int64()))
                carry[v] += int(c[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, *extra, pa.array(np.full(b.num_rows, part, "int32"))], names=schema.names)

    cut = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(local, schema), label)
    parts = cut.groupBy("_part").agg(*(F.sum(v).alias(f"_t_{v}") for v in values))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *(F.coalesce(F.sum(f"_t_{v}").over(w), F.lit(0)).alias(f"_o_{v}") for v in values))
    # one row per partition of the exchange above: as many as spark.sql.shuffle.partitions at most
    out = cut.join(F.broadcast(parts), "_part")
    return out.select(*df.columns, *((F.col(f"{v}_before") + F.col(f"_o_{v}")).alias(f"{v}_before") for v in values))


def components(links: DataFrame, label: str = "components", max_rounds: int = 50) -> DataFrame:
    """Connected components of (a, b) links of long ids: one row (node, root) per node, root the smallest id.

    Alternating large-star and small-star steps (Kiveris et al., 2014): a step hangs the larger
    neighbours of each node on the smallest one, so a hot node's links become a star and never a set of
    pairs. Both steps are aggregations and joins on node ids; each round's links are written to the
    shared folder, and a round that changes nothing ends the loop.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def star(nb: DataFrame, keep: Column) -> DataFrame:
        # a join, not a window: a hot node's neighbours then need not meet in one task
        low = nb.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        j = nb.join(low, "u").where(keep)
        return j.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")

    e = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), label)
    signature = None
    for _ in range(max_rounds):
        large = star(both(e), F.col("v") > F.col("u"))
        # every v < u of a node u goes to the smallest; u itself too
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        down = materialize(down, label)
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b")
        e = materialize(small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == signature:
            break
        signature = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def integer_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """rows(embedding, ...) whose vector is whole, with v, its components times scale, rounded down; embedding goes.

    Null vectors and those with null or non-finite components drop out.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v")
    return rows.where(F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))).select(*(c for c in rows.columns if c != "embedding"), v)


def components_of(column: pa.Array, length: int) -> np.ndarray:
    """A list column without nulls as a matrix of longs; shorter lists are filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(np.int64, copy=False)
    if (sizes == length).all():
        return flat.reshape(len(column), length)
    out = np.zeros((len(column), length), np.int64)
    out[np.arange(length) < sizes[:, None]] = flat
    return out
