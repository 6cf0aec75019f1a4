"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Features are hashed indicators of character n-grams and of n-grams of the text's shape (classes of
characters, runs collapsed; words equal to the one before). Each indicator is scaled by the log ratio
of its counts in the two classes, and a linear hinge-loss model is fitted by dual coordinate descent.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out
from .linear import fit_hinge, fit_logistic_scale, labelled_sample, probability

#: Buckets, as powers of two, of n-grams of characters and of shapes. Long texts have many different runs of
#: three characters, so these get more.
CHAR_GRAMS, SHAPE_GRAMS = {1: 14, 2: 14, 3: 16}, {2: 14, 3: 14, 4: 14, 5: 14}
CHAR_SIZE, REPEATS = sum(1 << b for b in CHAR_GRAMS.values()), 32
SIZE = CHAR_SIZE + sum(1 << b for b in SHAPE_GRAMS.values()) + REPEATS
#: Labelled rows of each class that the model is fitted on, at most. A row's features reach the driver as
#: indices or as bits, whichever is shorter, so these are at most 20 kB a row, 246 MB in all.
MOST_ROWS = 6000
SMOOTHING = 1.0

_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _shapes() -> np.ndarray:
    """The shape of each code point: 1 lower, 2 upper, 3 other letters, 4 digits, 5 white space, else itself plus 8."""
    out = np.arange(0x110000, dtype=np.uint32) + 8
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            out[c] = 1 if s.islower() else 2 if s.isupper() else 3
        elif s.isdigit():
            out[c] = 4
        elif s.isspace():
            out[c] = 5
    return out


def _grams(a: np.ndarray, sizes: dict[int, int], base: int, seen: np.ndarray) -> None:
    h = a = a.astype(np.uint64)
    for n in range(1, max(sizes) + 1):
        if n > 1:
            if len(a) < n:
                return
            h = h[:-1] * _MIX + a[n - 1 :]
        if n in sizes:
            at = ((h ^ (h >> np.uint64(32))) * _MIX) >> np.uint64(64 - sizes[n])
            seen[at + np.uint64(base)] = True
            base += 1 << sizes[n]


def features(text: bytes | None, seen: np.ndarray) -> np.ndarray:
    """Indices of a UTF-8 text's features; seen is an all-false array of SIZE that is left so."""
    raw = text or b""
    codes = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    if len(codes):
        _grams(codes, CHAR_GRAMS, 0, seen)
        shape = _shapes()[codes]
        keep = np.ones(len(shape), bool)
        keep[1:] = shape[1:] != shape[:-1]
        _grams(shape[keep], SHAPE_GRAMS, CHAR_SIZE, seen)
        words = raw.split()
        if len(words) > 1:
            h = np.fromiter(map(hash, words), np.int64, len(words))
            same = h[1:] == h[:-1]
            share = same.mean()
            base = SIZE - REPEATS
            if same.any():
                seen[base] = True
                seen[base + 1] = bool((same[1:] & same[:-1]).any())  # a word three times in a row
                seen[base + 2 + min(20, int(-np.log2(share)) * 2)] = True
            seen[base + 24 + min(7, int(np.log2(len(words))) // 2)] = True
    at = np.flatnonzero(seen)
    seen[at] = False
    return at.astype(np.int32)


def pack(at: np.ndarray) -> bytes:
    """Indices as they are, or as bits if those are fewer bytes."""
    if 4 * len(at) < SIZE // 8:
        return b"i" + at.tobytes()
    bits = np.zeros(SIZE, bool)
    bits[at] = True
    return b"b" + np.packbits(bits).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    if raw[:1] == b"i":
        return np.frombuffer(raw, np.int32, offset=1) if len(raw) > 1 else np.zeros(0, np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=1), count=SIZE)).astype(np.int32)


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """Of smoothed counts of features in classes 0 and 1 the log of their shares' ratio."""
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


class Rows:
    """Packed rows of features; one is unpacked at a time."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, i: int) -> np.ndarray:
        return unpack(self.packed[i])

    def __iter__(self):
        return map(unpack, self.packed)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, cost: float = 0.1) -> dict:
    """The model, from at most most_rows labelled rows of each class that are not held out.

    Only the sample's feature indices reach the driver. Without rows of both classes the model knows
    nothing and gives every text the share of class 1 in the sample, or 0.5.
    """
    sample = labelled_sample(docs, labels, "quality", most_rows)

    def extract(batches):
        seen = np.zeros(SIZE, bool)
        for b in batches:
            got = [pack(features(t, seen)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("label"), pa.array(got, pa.binary())], names=["key", "label", "at"])

    # ids of any type; the order of rows does not depend on how tables are stored
    key = F.col("doc_id").cast("long") if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else F.xxhash64("doc_id", "text")
    rows = sample.select(key.alias("key"), "label", F.col("text").cast("binary").alias("text")).mapInArrow(extract, "key long, label int, at binary").toArrow()
    rows = rows.sort_by([("key", "ascending"), ("at", "ascending")])
    y = rows["label"].to_numpy()
    at = Rows(rows["at"].to_pylist())
    if not len(y) or y.min() == y.max():
        p = 0.5 if not len(y) else (len(y) * float(y[0]) + 1) / (len(y) + 2)
        return {"w": np.zeros(SIZE, np.float32), "bias": float(np.log(p / (1 - p))), "a": 1.0, "b": 0.0}
    counts = np.full((2, SIZE), SMOOTHING)
    for v in (0, 1):
        for x, u in zip(at, y, strict=True):
            if u == v:
                counts[v][x] += 1  # a row's indices are distinct
    ratio = log_ratio(counts)
    w, bias = fit_hinge(at, y, ratio, cost)
    a, b = fit_logistic_scale(np.array([w[x].sum() + bias for x in at]), y)
    return {"w": w.astype(np.float32), "bias": bias, "a": a, "b": b}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs(doc_id, text). Null text counts as empty."""
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, seen = cast.value, np.zeros(SIZE, bool)
        for b in batches:
            margins = np.array([m["w"][features(t, seen)].sum(dtype=np.float64) + m["bias"] for t in b.column("text").to_pylist()])
            p = probability(margins, m["a"], m["b"])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fit on labels(doc_id, quality), then score all of docs(doc_id, text); see fit() and score().

    Null doc_id: not held out, never learned from. Repeated rows are scored each, ties alike. Empty tables:
    no rows, or scores of a model that knows nothing. doc_id is of any type. Very long texts are read whole.
    Other columns are ignored, whatever their names.
    """
    return score(docs, fit(docs, labels, **options))
