"""Near-duplicates by word shingles: SimHash groups and MinHash bands name the candidates, exact Jaccard similarity decides.

Texts whose fingerprints op2's operator (simhash) links are compared first. Pairs at 0.8 differ in some 10 of its 64
bits, which no split into blocks reaches, so MinHash finds the others.
A text is the set of its runs of SHINGLE words. BANDS times ROWS minima of the set are hashed band by
band; two sets of similarity s share a band with probability 1 - (1 - s**ROWS)**BANDS, which misses
seven pairs in a million at 0.8 and fewer above. Equal sets are one node from the start; candidates are
verified on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, fresh, materialize, release

SHINGLE, LEAST, SEED = 5, 0.8, 42
BANDS, ROWS = 30, 5
#: A run of words is rare if at most so many sets that may still be linked hold it.
RARE = 8

_MIX = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The set of a UTF-8 text's runs of words as sorted 64-bit hashes; a text with fewer words is one run."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    size = min(shingle, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ each[k : k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def band_keys(found: np.ndarray) -> np.ndarray:
    """A hash for each band of the set's minima; none if the set is empty."""
    if not found.size:
        return np.zeros(0, np.uint64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, found.size, 1024):
        low = np.minimum(low, (found[None, k : k + 1024] * _FACTORS + _TERMS).min(1))
    raw, step = low.tobytes(), 8 * ROWS
    return np.array([xxhash.xxh3_64_intdigest(raw[k * step : (k + 1) * step], k) for k in range(BANDS)], np.uint64)


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether two sets, sorted, have at least that Jaccard similarity."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return both >= least * (a.size + b.size - both) - 1e-9


def _sets(docs: DataFrame) -> DataFrame:
    """(row, doc_id, node, n, keys, fp): node is the hash of a text's set, n its size, keys those of its bands, fp its SimHash."""

    def run(batches):
        release()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                nodes, sizes, keys, prints = [], [], [], []
                for t in part.column(2).to_pylist():
                    found = shingles(t or b"")
                    nodes.append(xxhash.xxh3_64_intdigest(found.tobytes()))
                    sizes.append(found.size)
                    keys.append(band_keys(found).view(np.int64))
                    prints.append(simhash.fingerprint(t or b""))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["row", "doc_id", "node", "n", "keys", "fp"])

    rows = docs.select("row", "doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, n int, keys array<long>, fp long")


def _texts(docs: DataFrame, nodes: DataFrame, need: DataFrame) -> DataFrame:
    """(node, text) of the nodes in need, from nodes(node, row) and docs(row, text)."""
    reps = nodes.join(need, "node", "left_semi").select("row", "node")
    texts = docs.select("row", "text").join(reps, "row").groupBy("node").agg(F.first("text").cast("binary").alias("text"))
    return materialize(texts, "jaccard-texts")


def _verified(texts: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b) of texts(node, text) whose sets have at least that similarity."""

    def verify(batches):
        release()
        for b in batches:
            known: dict[int, np.ndarray] = {}
            for k in range(0, b.num_rows, 64):
                part, keep = b.slice(k, 64), []
                for x, y, t, u in zip(*(part.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
                    if x not in known:
                        known[x] = shingles(t or b"")
                    if y not in known:
                        known[y] = shingles(u or b"")
                    keep.append(similar(known[x], known[y], least))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
                if sum(v.size for v in known.values()) > 1_000_000:
                    known.clear()

    x, y = texts.select(F.col("node").alias("a"), F.col("text").alias("x")), texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "jaccard-pairs")


def _rare(texts: DataFrame, some: DataFrame) -> DataFrame:
    """(node, run, many) of those runs of words of the nodes in some(node) that at most RARE of them hold."""

    def run(batches):
        release()
        for b in batches:
            for node, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = shingles(text.as_py() or b"")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), node, np.int64)), pa.array(found.view(np.int64))], names=["node", "run"])

    runs = materialize(texts.join(some, "node", "left_semi").select("node", "text").mapInArrow(run, "node long, run long"), "jaccard-runs")
    few = runs.groupBy("run").agg(F.count("*").alias("many")).where(F.col("many") <= RARE)
    return materialize(runs.join(few, "run").select("node", "run", "many"), "jaccard-rare")


def _mixed(keyed: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """The rows of keyed(node, key, ..) in bands whose nodes the links do not join, with each node's root."""
    rooted = keyed.join(components(links, f"{label}-links"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return materialize(rooted.join(mixed, "key", "left_semi"), label)


def _nodes(rows: DataFrame) -> DataFrame:
    """(node, low, row, n, keys, fp) of the different sets of rows; fp is one of those that texts of a set have."""
    some = [F.first(c).alias(c) for c in ("n", "keys")]
    return materialize(rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.min("row").alias("row"), *some, F.min("fp").alias("fp")), "jaccard-nodes")


def _close(nodes: DataFrame, sizes) -> DataFrame:
    """Pairs (a, b) to verify: each node with one of its SimHash group, where their sizes allow it."""
    near = nodes.select("node", "n", "fp").join(simhash.grouped(nodes.select("fp").distinct()), "fp").select("node", "n", "root")
    near = materialize(near, "jaccard-close")
    center = near.groupBy("root").agg(F.min(F.struct("node", "n")).alias("low"), F.count("*").alias("many")).where("many > 1").select("root", "low")
    star = near.join(center, "root").where((F.col("node") != F.col("low.node")) & sizes(F.col("n"), F.col("low.n")))
    return materialize(star.select(F.least("low.node", "node").alias("a"), F.greatest("low.node", "node").alias("b")), "jaccard-close")


def _links(docs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of nodes(node, row, n, keys, fp) with the components that all pairs of at least that similarity have.

    Each set is first compared with one of its SimHash group, and with one node of each of its bands, another for every band. Pairs that
    those links already join need no comparison, so a group of near copies makes a few stars and not a
    set of pairs. Of what is left, pairs that share a rare run (one that at most RARE sets hold) are found
    by that run. All other pairs share none of their rare runs, so sets with many of them drop out of their
    bands; each other one is compared with the band's node that has the fewest, and at last the pairs that
    even that has not joined, as far as their rare runs allow, are compared one by one.
    """
    # the smaller set's share of the larger bounds the similarity
    sizes = lambda x, y: F.least(x, y) >= least * F.greatest(x, y) - F.lit(1e-9)
    close = _close(nodes, sizes)
    keyed = materialize(nodes.select("node", "n", F.explode("keys").alias("key")), "jaccard-bands")
    shared = keyed.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key").alias("h"), "node", "n")).alias("low"), F.count("*").alias("many")).where("many > 1").select("key", "low")
    keyed = materialize(keyed.join(shared, "key"), "jaccard-shared")
    texts = _texts(docs, nodes, keyed.select("node").union(close.select("a")).union(close.select("b")).distinct())
    star = keyed.where((F.col("node") != F.col("low.node")) & sizes(F.col("n"), F.col("low.n")))
    star = star.select(F.least("low.node", "node").alias("a"), F.greatest("low.node", "node").alias("b")).union(close).distinct()
    first = _verified(texts, materialize(star, "jaccard-star"), least)

    left = _mixed(keyed.select("node", "n", "key"), first, "jaccard-mixed")
    members = materialize(left.select("node", "n", "root").distinct(), "jaccard-members")
    rare = _rare(texts, members.select("node"))
    i, p = (rare.where("many > 1").select("run", F.col("node").alias(f"node_{side}")).join(members.select(*(F.col(x).alias(f"{x}_{side}") for x in ("node", "n", "root"))), f"node_{side}") for side in "ab")
    by_run = i.join(p, "run").where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & sizes(F.col("n_a"), F.col("n_b")))
    by_run = by_run.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    left = left.join(rare.groupBy("node").agg(F.count("*").alias("own")), "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    # what another set of m runs can share, if none of the rare ones, is n - own at most, and no more than m
    able, low = F.col("n") - F.col("own"), left.groupBy("key").agg(F.min("n").alias("least_n"))
    left = left.join(low, "key").where(able >= least * (F.greatest("least_n", able) + F.col("own")) - F.lit(1e-9))
    left = materialize(left.select("node", "n", "key", "root", "own"), "jaccard-able")
    center = left.groupBy("key").agg(F.min(F.struct("own", "node", "n", "root")).alias("low"))
    star = left.join(center, "key").where((F.col("root") != F.col("low.root")) & sizes(F.col("n"), F.col("low.n")))
    star = star.select(F.least("low.node", "node").alias("a"), F.greatest("low.node", "node").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    first = materialize(first.union(_verified(texts, materialize(star, "jaccard-star"), least)), "jaccard-found")

    left = _mixed(left.select("node", "n", "key", "own"), first, "jaccard-left").join(nodes.select("node", "keys"), "node")
    i, p = (left.select("key", *(F.col(x).alias(f"{x}_{side}") for x in ("node", "n", "own", "root", "keys"))) for side in "ab")
    both = F.least(F.col("n_a") - F.col("own_a"), F.col("n_b") - F.col("own_b"))
    near = both >= least * (F.col("n_a") + F.col("n_b") - both) - F.lit(1e-9)
    rest = i.join(p, "key").where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & near)
    rest = rest.where(F.col("key") == F.array_min(F.array_intersect("keys_a", "keys_b")))  # once, whatever they share
    rest = materialize(rest.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).union(by_run).distinct().join(first, ["a", "b"], "left_anti"), "jaccard-rest")
    return first.union(_verified(texts, rest, least))


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(row, doc_id, component_id) for each row of docs(doc_id, text).

    row: hash of doc_id and text. component_id: the smallest doc_id that links of at least that
    similarity reach. Texts without words are alike. Null doc_id: never names a component; a component
    of nulls has a null id. Repeated rows are repeated. Empty table: no rows. Other columns are ignored.
    """
    source = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    rows = materialize(_sets(source), "jaccard")
    nodes = _nodes(rows)
    roots = components(_links(source, nodes, least), "jaccard-links")
    joined = nodes.select("node", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    member = joined.join(named, "root").select("node", "component_id")
    return rows.select("row", "doc_id", "node").join(member, "node").select("row", "doc_id", "component_id")


def first_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their near-duplicate group, all columns kept.

    Rows without doc_id stay only where their whole group has none. Of rows that share both doc_id and
    text, one stays.
    """
    dup = near_duplicates(docs.select("doc_id", "text"), least)
    row, keep = fresh(docs.columns, "row", "keep")
    kept = dup.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("row").alias(keep)).distinct()
    out = docs.withColumn(row, F.xxhash64("doc_id", "text")).join(kept, F.col(row) == F.col(keep), "left_semi")
    # the join has dealt the texts out by row: no further exchange
    return out.dropDuplicates([row, "doc_id", "text"]).select(*docs.columns)
