"""Exact search for the largest inner products in buckets of vectors of like length.

Vectors are sorted by length, longest first, cut into groups (one task's share) and these into buckets. A query that
already knows its k-th best score asks a bucket for a cosine of at least that score over the two lengths: over 1, the
bucket goes; from COSINE on, a vector's coordinates must lie near the query's largest ones (coordinate pruning); below,
only shorter vectors at the bucket's end go (length pruning). What is left is verified by whole products.

Queries come in slices. A slice meets each group that holds vectors long enough for it, as one cogrouped task of bounded
size; a query's best of all groups are merged by a window, so nothing of the table passes the driver but the longest few
vectors, from which queries take their first thresholds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components_of, integer_vectors, materialize

SCALE, EVERY, TOP = 64, 20, 20
#: Components (of candidates, of queries) in a group and in a slice, and of the longest vectors that give first thresholds.
GROUP, SLICE, SEED = 1 << 20, 1 << 16, 1 << 17
#: A bucket ends after so many vectors, or where one is shorter than this share of its first.
BUCKET, SHORTER = 2048, 0.9
#: From this local cosine on, coordinates prune; so many of a query's largest.
COSINE, FOCUS = 0.75, 4
#: Marks of groups' lengths that queries are sent by, at most.
MARKS = 1024
SLACK = 1e-9


def local_cosine(least: np.ndarray, lengths: np.ndarray, longest: float) -> np.ndarray:
    """What cosine a bucket must offer each query for a score of `least`; no bound (-1) where that is not above zero."""
    reach = lengths * longest
    return np.where(least <= 0, -1.0, least / np.where(reach > 0, reach, SLACK))


def near_coordinates(unit_columns: np.ndarray, query: np.ndarray, cosine: float) -> np.ndarray:
    """Which unit vectors (columns of coordinates) may have that cosine with the unit query, by its largest coordinates.

    A coordinate is the cosine of the angle with its axis. Where the query stands at the angle a to an axis, a vector at
    most s away from the query stands between a - s and a + s.
    """
    alive = np.ones(unit_columns.shape[1], bool)
    c = min(1.0, cosine)
    for f in np.argsort(-np.abs(query), kind="stable")[:FOCUS]:
        q = min(1.0, abs(float(query[f])))
        around, spread = np.arccos(q), np.arccos(c)
        low, high = np.cos(min(np.pi, around + spread)), np.cos(max(0.0, around - spread))
        x = unit_columns[f] if query[f] >= 0 else -unit_columns[f]
        alive &= (x >= low - SLACK) & (x <= high + SLACK)
    return np.flatnonzero(alive)


class Best:
    """Each query's best candidates so far, and the score that a further one has to reach."""

    def __init__(self, least: np.ndarray, top: int):
        self.least, self.top, self.found = least.copy(), top, [(np.zeros(0, np.int64),) * 2 for _ in least]

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of at least least[q]: those that stay are the highest, of equal ones the smallest ids."""
        s, i = (np.concatenate(x) for x in zip(self.found[q], (scores, ids), strict=True))
        by = np.lexsort((i, -s))[: self.top]
        self.found[q] = s[by], i[by]
        if len(by) == self.top:
            self.least[q] = max(self.least[q], s[by[-1]])


def meet(bucket: tuple, queries: tuple, best: Best) -> None:
    """Offer a bucket's vectors (matrix, longest first; their lengths, rows, ids) to the queries (matrix, lengths, rows)."""
    p, p_len, p_row, p_id = bucket
    q, q_len, q_row = queries
    cosine = local_cosine(best.least, q_len, p_len[0])
    able = np.flatnonzero(cosine <= 1 + SLACK)
    by_axis = cosine[able] >= COSINE
    unit = None
    for k in able[by_axis]:
        if unit is None:
            unit = np.ascontiguousarray((p / np.where(p_len > 0, p_len, 1.0)[:, None]).T)
        at = near_coordinates(unit, q[k] / q_len[k], cosine[k] * (1 - SLACK))
        _verify(k, p[at] @ q[k], at, p_row, p_id, q_row, best)
    plain = able[~by_axis]
    if len(plain):
        need = best.least[plain] * (1 - SLACK) / np.where(q_len[plain] > 0, q_len[plain], 1.0)
        ends = np.where(best.least[plain] <= 0, len(p), np.searchsorted(-p_len, -need, side="right"))
        some = p[: ends.max()] @ q[plain].T
        for j, k in enumerate(plain):
            at = np.arange(ends[j])
            _verify(k, some[: ends[j], j], at, p_row, p_id, q_row, best)


def _verify(k: int, scores: np.ndarray, at: np.ndarray, p_row, p_id, q_row, best: Best) -> None:
    keep = (scores >= best.least[k]) & (p_row[at] != q_row[k])
    if keep.any():
        best.offer(k, scores[keep].astype(np.int64), p_id[at[keep]])


#: A candidate without id stands last among equal scores.
NO_ID = np.iinfo(np.int64).max


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def search(embeddings: DataFrame, every: int = EVERY, top: int = TOP, scale: int = SCALE, group: int = GROUP, slice_: int = SLICE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of embeddings(vec_id, embedding) whose id `every` divides, the `top` other rows of highest inner product.

    Ties go to the smaller vec_id, a null id last; no query has a null id. Rows whose vector is null or has null or
    non-finite components take no part. A row is told apart from equal ones: repeated rows are candidates of each other,
    and each is a query of its own. Vectors of unlike lengths are filled up with zeros. Products that could leave the
    range of long raise an error. Empty table: no rows. Further columns are ignored, whatever their names.
    """
    rows = integer_vectors(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), scale).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "norm-vectors")
    n, length, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    length, largest = max(1, length or 0), largest or 0
    if largest * largest * length >= 1 << 62:
        raise ValueError(f"a component is {largest} after scaling; products of {length} such leave the range of long")
    # doubles multiply integers exactly up to 2**53
    kind = np.float64 if largest * largest * length < 1 << 53 else np.int64
    small = np.int16 if largest < 1 << 15 else np.int64
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("norm")
    rows = rows.select("row", "vec_id", "v", norm)
    longest = rows.orderBy(F.desc("norm"), "row").limit(max(top + 1, SEED // length)).collect()
    seed = np.zeros((len(longest), length), np.int64)
    for x, r in zip(seed, longest, strict=True):
        x[: len(r["v"])] = r["v"]
    seed_rows = np.array([r["row"] for r in longest], np.int64)

    def pack_buckets(batches):
        part, kept, first, number = TaskContext.get().partitionId(), [], 0.0, 0

        def out():
            nonlocal number
            x, norms, rows_, ids = (np.concatenate(c) for c in zip(*kept, strict=True))
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([float(norms[0])]), *(pa.array([a.tobytes()], pa.binary()) for a in (x.astype(small), norms, rows_, ids))], names=["grp", "number", "norm", "x", "norms", "rows", "ids"])

        for b in batches:
            x, norms, rows_, ids = components_of(b.column("v"), length), b.column("norm").to_numpy(), b.column("row").to_numpy(), _ids(b.column("vec_id"))
            k = 0
            while k < len(x):
                have = sum(len(c[0]) for c in kept)
                if not have:
                    first = norms[k]
                end = min(k + BUCKET - have, k + int(np.searchsorted(-norms[k:], -first * SHORTER * SHORTER, side="right")))
                if end > k:
                    kept.append((x[k:end], norms[k:end], rows_[k:end], ids[k:end]))
                if end < len(x):
                    yield out()
                    kept = []
                k = end
        if kept:
            yield out()

    groups = max(1, -(-n * length // group))
    # by row too: one length may hold a third of all rows
    ranged = rows.repartitionByRange(groups, F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row")
    buckets = materialize(ranged.mapInArrow(pack_buckets, "grp int, number int, norm double, x binary, norms binary, rows binary, ids binary"), "norm-buckets")

    def pack_queries(batches):
        part, number = TaskContext.get().partitionId(), 0
        for b in batches:
            for k in range(0, b.num_rows, max(1, slice_ // length)):
                s = b.slice(k, max(1, slice_ // length))
                x, rows_ = components_of(s.column("v"), length), s.column("row").to_numpy()
                scores = np.where(seed_rows == rows_[:, None], np.iinfo(np.int64).min, (x.astype(kind) @ seed.T.astype(kind)).astype(np.int64))
                least = np.full(len(x), np.iinfo(np.int64).min)
                if len(seed) > top:
                    least = np.partition(scores, len(seed) - top, axis=1)[:, len(seed) - top]
                lengths = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
                need = np.where(least > 0, least / np.where(lengths > 0, lengths, SLACK), 0.0)
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), pa.array([float(need.min() * (1 - SLACK))]), *(pa.array([a.tobytes()], pa.binary()) for a in (x.astype(small), rows_, _ids(s.column("vec_id")), least))], names=["slice", "need", "qx", "qrows", "qids", "least"])

    asked = rows.where(F.col("vec_id") % every == 0)
    queries = materialize(asked.mapInArrow(pack_queries, "slice long, need double, qx binary, qrows binary, qids binary, least binary"), "norm-queries")
    # groups stand by length, so those long enough for a slice are the first ones; marks bound what is looked up
    heads = buckets.groupBy("grp").agg(F.max("norm").alias("norm"))
    last = heads.agg(F.max("grp")).first()[0]
    step = -(-((last or 0) + 1) // MARKS)
    # by number, as a group may have no rows
    marks = heads.groupBy(F.expr(f"grp div {step}").alias("mark")).agg(F.max("norm").alias("norm")).orderBy("mark").collect()
    held = F.array(*(F.struct(F.lit(r.mark).alias("mark"), F.lit(float(np.sqrt(r.norm))).alias("length")) for r in marks)) if marks else F.array().cast("array<struct<mark:long,length:double>>")
    far = (F.coalesce(F.array_max(F.filter(held, lambda m: m["length"] >= F.col("need")))["mark"], F.lit(0)) + 1) * step - 1
    visits = queries.select("slice", F.explode(F.sequence(F.lit(0), F.least(far, F.lit(last or 0)).cast("int"))).alias("grp"))
    visits = materialize(visits, "norm-visits")
    left = buckets.join(visits.withColumnRenamed("slice", "asked"), "grp")
    right = queries.join(visits.withColumnRenamed("grp", "group"), "slice")
    schema = "qrow long, query_id long, vec_id long, score long"

    def run(b: pa.Table, q: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] for _ in range(4)]
        if b.num_rows and q.num_rows:
            stored = lambda t, c, k, d: np.frombuffer(t.column(c)[k].as_buffer(), d)
            qx = stored(q, "qx", 0, small).reshape(-1, length).astype(kind)
            q_row, q_id = stored(q, "qrows", 0, np.int64), stored(q, "qids", 0, np.int64)
            q_len = np.sqrt((qx.astype(np.float64) ** 2).sum(axis=1))
            best = Best(stored(q, "least", 0, np.int64), top)
            for k in np.argsort(b.column("number").to_numpy()):
                k = int(k)
                bucket = stored(b, "x", k, small).reshape(-1, length).astype(kind), np.sqrt(stored(b, "norms", k, np.float64)), stored(b, "rows", k, np.int64), stored(b, "ids", k, np.int64)
                meet(bucket, (qx, q_len, q_row), best)
            for k, (s, i) in enumerate(best.found):
                for col, x in zip(out, (np.full(len(s), q_row[k]), np.full(len(s), q_id[k]), i, s), strict=True):
                    col.append(x)
        qrow, qid, i, s = map(np.concatenate, out)
        return pa.table({"qrow": qrow, "query_id": qid, "vec_id": pa.array(i, mask=i == NO_ID), "score": s})

    found = left.groupBy("asked", "grp").cogroup(right.groupBy("slice", "group")).applyInArrow(run, schema)
    w = Window.partitionBy("qrow").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
