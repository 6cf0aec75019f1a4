"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, then banded alignment.

An occurrence of an item of n characters with at most k edits shares at least n - q + 1 - k q of the
item's q-grams with the document, all on diagonals (document position minus item position) that lie
within k of each other. Shared q-grams are counted in bands of 2 (k + 1) diagonals that overlap by half,
so some band holds every such occurrence; bands that reach the bound are aligned.
"""

from __future__ import annotations

import math
import uuid
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, resident, running_totals

Q = 8
EDIT_RATE = 0.1
#: Benchmark characters that one pass holds in each worker, some 60 bytes each as an index; a larger
#: benchmark takes several passes.
PASS_CHARS = 1_000_000
TABLE_BITS = 22

_M1, _M2, _M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: itself if it is a letter or digit, else 0."""
    return np.array([c if chr(c).isalnum() else 0 for c in range(0x110000)], np.uint32)


def normalize(text: str | None) -> np.ndarray:
    """Code points in lower case; what is neither letter nor digit becomes one 0 between words."""
    if not text:
        return np.empty(0, np.uint32)
    a = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    word = a != 0
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first 0 after a word
    a = a[keep]
    return a[:-1] if len(a) and a[-1] == 0 else a


def grams(a: np.ndarray) -> np.ndarray:
    """64-bit hashes of all q-grams, q = 8."""
    if len(a) < Q:
        return np.empty(0, np.uint64)
    h = a.astype(np.uint64)
    h = h[:-1] * _M1 + h[1:]
    h = h[:-2] * _M2 + h[2:]
    h = h[:-4] * _M4 + h[4:]
    return (h ^ (h >> np.uint64(29))) * _M1


class Items:
    """A benchmark, or a piece of one, as an index of q-grams."""

    def __init__(self, rows: list[tuple[int | None, str | None]], rate: float = EDIT_RATE):
        self.ids, self.codes, budget, least, hashes, where, which = [], [], [], [], [], [], []
        self.short: dict[bytes, list[int | None]] = {}  # items without a q-gram, by their characters
        for item_id, text in rows:
            a = normalize(text)
            if len(a) < Q:
                if len(a):
                    self.short.setdefault(a.tobytes(), []).append(item_id)
                continue
            k = min(math.floor(rate * len(a)), (len(a) - Q) // Q)
            h = grams(a)
            hashes.append(h)
            where.append(np.arange(len(h)))
            which.append(np.full(len(h), len(self.ids)))
            self.ids.append(item_id)
            self.codes.append(a)
            budget.append(k)
            least.append(len(a) - Q + 1 - k * Q)
        self.budget, self.least = np.array(budget, np.int64), np.array(least, np.int64)
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.where, self.which = (np.concatenate(x)[order] if hashes else np.empty(0, np.int64) for x in (where, which))
        self.gram, self.start, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.gram >> np.uint64(64 - TABLE_BITS)] = True

    def find(self, text: str | None) -> list[tuple[int | None, int]]:
        """(item id, edits) for each item that occurs in text within its budget; edits: the fewest of any place."""
        a = normalize(text)
        if len(a) < Q:
            return [(i, 0) for i in self.short.get(a.tobytes(), ())]
        return [(self.ids[i], edits) for i, edits in self._occurrences(a)]

    def _occurrences(self, a: np.ndarray) -> list[tuple[int, int]]:
        h = grams(a)
        at = np.flatnonzero(self.table[h >> np.uint64(64 - TABLE_BITS)])
        if not len(at) or not len(self.ids):
            return []
        g = h[at]
        k = np.searchsorted(self.gram, g)
        k[k == len(self.gram)] = 0
        true = self.gram[k] == g
        at, k = at[true], k[true]
        n = self.count[k]
        total = int(n.sum())
        if not total:
            return []
        entry = np.repeat(self.start[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        item, diagonal = self.which[entry], np.repeat(at, n) - self.where[entry]
        enough = np.bincount(item, minlength=len(self.ids)) >= self.least
        some = enough[item]
        if not some.any():
            return []
        item, diagonal = item[some], diagonal[some]
        width = self.budget[item] + 1
        band = diagonal // width
        key = np.concatenate([item << 40 | band + (1 << 38), item << 40 | band - 1 + (1 << 38)])
        grams_at = np.tile(self.where[entry[some]], 2)
        order = np.argsort(key, kind="stable")
        key, starts, hits = np.unique(key[order], return_index=True, return_counts=True)
        out: dict[int, int] = {}
        for j in np.flatnonzero(hits >= self.least[key >> 40]).tolist():
            i, b = int(key[j] >> 40), int(key[j] & (1 << 40) - 1) - (1 << 38)
            if len(np.unique(grams_at[order[starts[j] : starts[j] + hits[j]]])) < self.least[i]:
                continue  # a repetitive document shares the same few q-grams again and again
            budget = int(self.budget[i])
            if out.get(i) == 0:
                continue
            edits = align(self.codes[i], a, b * (budget + 1), (b + 2) * (budget + 1) - 1, budget)
            if edits is not None and edits < out.get(i, budget + 1):
                out[i] = edits
        return sorted(out.items())


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> int | None:
    """Fewest edits that turn item into a stretch of text, within the diagonals low to high; None beyond budget.

    Row i of the banded table holds cells (i, i + d) for the diagonals d of the band. The stretch may
    start and end anywhere.
    """
    first = max(0, low)
    text = text[first : max(first, high + len(item) + 1)]  # what the band can reach
    low, high = low - first, high - first
    width = high - low + 1
    steps = np.arange(width)
    far = len(item) + len(text) + 1
    column = low + steps  # text positions before row 0
    cell = np.where((column >= 0) & (column <= len(text)), 0, far)
    padded = np.concatenate([text.astype(np.int64), [-1]])
    for i in range(len(item)):
        column = i + low + steps  # the text character that the diagonal step reads
        inside = (column >= 0) & (column < len(text))
        same = padded[np.where(inside, column, -1)] == item[i]
        over = np.where(inside, cell + np.where(same, 0, 1), far)
        over[:-1] = np.minimum(over[:-1], cell[1:] + 1)
        over = np.where((column + 1 >= 0) & (column + 1 <= len(text)), over, far)
        cell = np.minimum.accumulate(over - steps) + steps
        if cell.min() > budget:
            return None
    return int(cell.min())


def scan(docs: DataFrame, benchmark: DataFrame, hits: str, rate: float = EDIT_RATE, pass_chars: int = PASS_CHARS) -> DataFrame:
    """docs with a column hits: array of (item_id, edits) of the benchmark items that the text holds.

    Pieces of the benchmark of about pass_chars characters (a single longer item is a piece) are sent to
    the tasks, one piece a pass, so what a worker holds is bounded and every item is searched. A worker
    makes a piece's index once. With several pieces each pass writes what it found, and one join brings
    all of it to the documents.
    """
    spark = docs.sparkSession
    text_id = isinstance(benchmark.schema["item_id"].dataType, T.StringType)
    items = benchmark.select(F.col("item_id").cast("string" if text_id else "long").alias("item_id"), "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    items = running_totals(items, [F.xxhash64("item_id", "text")], ["n"], "benchmark").withColumn("piece", F.floor(F.col("n_before") / pass_chars))
    pieces = [r.piece for r in items.select("piece").distinct().orderBy("piece").collect()] or [0]
    kind = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType() if text_id else T.LongType()), T.StructField("edits", T.IntegerType())]))
    arrow = pa.list_(pa.struct([("item_id", pa.string() if text_id else pa.int64()), ("edits", pa.int32())]))

    sent = []

    def search(rows: DataFrame, piece: int, keep_all: bool) -> DataFrame:
        cast, label = spark.sparkContext.broadcast([(r.item_id, r.text) for r in items.where(F.col("piece") == piece).select("item_id", "text").collect()]), uuid.uuid4().hex
        sent.append(cast)
        names, at = rows.columns, rows.columns.index("text")
        out = names if keep_all else [c for c in names if c != "text"]

        def run(batches):
            index = resident(("decontam", label), lambda: Items(cast.value, rate))
            for b in batches:
                found = [[{"item_id": i, "edits": e} for i, e in index.find(t)] for t in b.column(at).to_pylist()]
                made = pa.RecordBatch.from_arrays([*(b.column(names.index(c)) for c in out), pa.array(found, arrow)], names=[*out, hits])
                yield made if keep_all else made.filter(pa.array([bool(x) for x in found], pa.bool_()))

        return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in out), T.StructField(hits, kind)]))

    if len(pieces) == 1:
        return search(docs, pieces[0], True)
    row, found = fresh(docs.columns, "row", "found")
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text")
    parts = []
    for k in pieces:
        parts.append(materialize(search(keyed, k, False).withColumn("piece", F.lit(k)), "decontam-pass"))
        sent.pop().destroy()
    every = reduce(DataFrame.union, parts).distinct().groupBy(F.col("row").alias(row)).agg(F.flatten(F.collect_list(hits)).alias(found))
    out = docs.withColumn(row, F.xxhash64("doc_id", "text")).join(every, row, "left")
    return out.select(*docs.columns, F.coalesce(found, F.array().cast(kind)).alias(hits))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, contaminated, item_ids, edits) per row of docs(doc_id, text) against benchmark(item_id, text).

    A document holds an item if some stretch of it, compared as letters and digits in lower case with
    one break between words, is within EDIT_RATE of the item's length in edits (fewer for items under
    about 100 characters, so that the q-gram bound stays positive). Items of fewer than 8 characters have
    no q-gram: a document holds one only if it is all of its text. item_ids is in ascending order, with
    edits beside it. Null or empty text: clean. Null doc_id: a row of its own. Repeated rows and items
    count each. item_id is an integer or text. Very long texts are searched whole. Empty tables: no rows, or all clean. Other columns
    are ignored, whatever their names.
    """
    found = scan(docs.select("doc_id", "text"), benchmark, "_hits", **options)
    hits = F.array_sort("_hits")
    return found.select("doc_id", (F.size(hits) > 0).alias("contaminated"), hits["item_id"].alias("item_ids"), hits["edits"].alias("edits"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no benchmark item, all columns kept."""
    (hits,) = fresh(docs.columns, "hits")
    return scan(docs, benchmark, hits, **options).where(F.size(hits) == 0).drop(hits)
