"""Vector codes: each part of a vector becomes the index of its nearest codebook entry, found by partial distances.

A codebook's dimensions are taken in descending variance. Distances to all entries grow one dimension at a time;
after each, the entry that leads is completed, and a mask drops the entries whose accumulated distance strictly
exceeds the best complete one. All arithmetic is on integers, so no result depends on the order of rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components_of, integer_vectors, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components from here on could leave the range of long in sums of squares.
LARGEST = 1 << 26
#: Rows that one step of the search takes: a table of rows by entries then stays in the cache.
STEP = 4096
#: Labels whose sums are broadcast, at most; more are joined by an exchange on the label.
FEW_LABELS = 100_000


def _segments(row: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, row[1:] != row[:-1]])


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x (n, w) the index of the nearest row of book (m, w) and its squared distance; ties to the lower index."""
    n, w = x.shape
    if not n or not w:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    by = np.argsort(-book.var(axis=0), kind="stable")
    x, book = x[:, by], book[:, by]
    first = (x[:, :1] - book[:, 0]) ** 2
    best = ((x - book[first.argmin(axis=1)]) ** 2).sum(axis=1)
    row, entry = np.nonzero(first <= best[:, None])
    so_far = first[row, entry]
    for d in range(1, w):
        so_far = so_far + (x[row, d] - book[entry, d]) ** 2
        alive = so_far <= best[row]
        row, entry, so_far = row[alive], entry[alive], so_far[alive]
        if d + 1 < w:
            leads = _leaders(row, so_far)
            best = np.minimum(best, ((x - book[entry[leads]]) ** 2).sum(axis=1))
            alive = so_far <= best[row]
            row, entry, so_far = row[alive], entry[alive], so_far[alive]
    at = _leaders(row, so_far)
    return entry[at], so_far[at]


def _leaders(row: np.ndarray, so_far: np.ndarray) -> np.ndarray:
    """Where each row's least distance stands first; every row has an entry left, since the best one is never dropped."""
    starts = _segments(row)
    low = np.repeat(np.minimum.reduceat(so_far, starts), np.diff(np.r_[starts, len(row)]))
    at = np.flatnonzero(so_far == low)
    return at[_segments(row[at])]


def _parts(batch: pa.RecordBatch, column: str, width: int):
    """The batch's vectors in steps, as (first row, rows of PARTS parts of the width)."""
    for k in range(0, batch.num_rows, STEP):
        x = components_of(batch.column(column).slice(k, STEP), PARTS * width)
        yield k, x.reshape(len(x), PARTS, width)


def _sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(slot, n, s): per part and entry, how many parts it is nearest to and their componentwise sum; each task adds up its own first."""
    parts, entries, width = books.shape

    def run(batches):
        n, s = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            for _, x in _parts(b, "v", width):
                for p in range(parts):
                    at, _ = nearest(x[:, p], books[p])
                    n[p] += np.bincount(at, minlength=entries)
                    np.add.at(s[p], at, x[:, p])
        used = np.flatnonzero(n.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n.ravel()[used]), pa.array(list(s.reshape(-1, width)[used]), pa.list_(pa.int64()))], names=["slot", "n", "s"])

    rows = vectors.select("v").mapInArrow(run, "slot int, n long, s array<long>")
    return rows.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("s", F.lit(k))) for k in range(width))).alias("s"))


def train(vectors: DataFrame, width: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of vectors(vec_id, v): parts * entries rows come to the driver each round."""
    first = vectors.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = np.zeros((len(first), PARTS * width), np.int64)
    for row, (_, v) in zip(start, first, strict=True):
        row[: len(v)] = v
    books = start.reshape(len(first), PARTS, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if width and len(first) else 0):
        new = books.reshape(-1, width).copy()
        for slot, n, s in _sums(vectors, books).collect():
            new[slot] = [x // n for x in s]
        books = new.reshape(books.shape)
    return books


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of vectors(vec_id, label, v)."""
    parts, _, width = books.shape

    def run(batches):
        for b in batches:
            codes, errors = [], []
            for _, x in _parts(b, "v", width):
                found = [nearest(x[:, p], books[p]) for p in range(parts)]
                octets = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
                codes += [o.tobytes().hex() for o in octets]
                errors.append(sum(e for _, e in found))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(codes, pa.string()), pa.array(np.concatenate(errors) if errors else np.zeros(0, np.int64))], names=["vec_id", "label", "code", "error"])

    kind = lambda c: vectors.schema[c].dataType.simpleString()
    return vectors.select("vec_id", "label", "v").mapInArrow(run, f"vec_id {kind('vec_id')}, label {kind('label')}, code string, error long")


def compress(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), one row per kept row of embeddings(vec_id, embedding, label).

    Rows whose vector is null or has null or non-finite components drop out. Repeated rows are coded alike and each
    counts; of rows that share an id those with the smaller vector come first among a codebook's first entries, a null
    id stands last, null labels are one label. Fewer kept rows than entries give shorter codebooks. Vectors of unlike
    lengths, or of a length that 16 does not divide, are filled up with zeros. Components of 2**26 or more after scaling
    raise an error. Empty table: no rows. Further columns are ignored, whatever their names.
    """
    vectors = integer_vectors(embeddings.select("vec_id", "embedding", "label"), scale)
    length, largest = vectors.agg(F.max(F.size("v")), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    if (largest or 0) >= LARGEST:
        raise ValueError(f"a component is {largest} after scaling; the limit is {LARGEST}")
    books = train(vectors, -(-(length or 0) // PARTS))
    coded = materialize(encode(vectors, books), "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    by_label = materialize(by_label, "vector-labels")
    if by_label.count() <= FEW_LABELS:
        by_label = F.broadcast(by_label)
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))
