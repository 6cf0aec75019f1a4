"""SimHash near-duplicates: fingerprints, pigeonhole blocks, components.

A fingerprint's 64 bits are cut into blocks. Two fingerprints that differ in at most DISTANCE bits agree on
all but DISTANCE of the blocks at least, so they share the key of some choice of that many.
Fingerprints that are equal are one node from the start; nodes are joined on block keys and the pairs
verified by Hamming distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, fresh, materialize

SHINGLE, SEED = 3, 42
DISTANCE = 3
#: (blocks, most nodes): five blocks make 10 keys of about 25 bits, seven make 35 keys of about 36, so that
#: chance meetings stay few beside the nodes. Either finds all pairs.
BLOCKS = ((5, 4_000_000), (7, None))

_OFFSETS = np.arange(8, dtype=np.intp) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned SimHash of a UTF-8 text; zero if it has no words."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), "<u8", n)
    counts = np.zeros((8, 8), np.int64)
    for k in range(0, n, 1 << 16):
        octets = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.einsum("pv,vb->pb", np.bincount((octets + _OFFSETS).ravel(), minlength=2048).reshape(8, 256), _BITS)
    return int(np.packbits(counts.ravel() * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null text counts as empty."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                fp = np.array([fingerprint(t or b"") for t in part.column(1).to_pylist()], "<u8")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view("<i8"))], names=["doc_id", "fp"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _block_keys(fp, blocks: int, distance: int):
    """Array of longs: for each choice of blocks - distance blocks, its number and those blocks' bits."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)) for k in range(blocks)]
    # xxhash64 of the choice and its bits; a collision only adds a candidate that verification drops
    return F.array(*(F.xxhash64(F.lit(n), *(part[k] for k in c)) for n, c in enumerate(combinations(range(blocks), blocks - distance))))


def near_links(nodes: DataFrame, distance: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """Pairs a < b of nodes(fp), distinct fingerprints, that differ in at most distance bits; blocks: by the nodes' number."""
    if blocks is None:
        n = nodes.count()
        blocks = next(k for k, most in BLOCKS if most is None or n <= most)
    keyed = nodes.select("fp", F.explode(_block_keys(F.col("fp"), blocks, distance)).alias("key"))
    a, b = keyed.select("key", F.col("fp").alias("a")), keyed.select("key", F.col("fp").alias("b"))
    near = (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return a.join(b, near).select("a", "b")


def grouped(nodes: DataFrame, distance: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """(.., fp, root) of nodes(.., fp), distinct fingerprints: root is the same for all that links of at most distance bits reach."""
    roots = components(near_links(nodes.select("fp"), distance, blocks), "simhash-links")
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs(doc_id, text).

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id that links of at most
    distance differing bits reach. Null, empty or wordless text: fingerprint zero, linked like any
    other. Null doc_id: a row of its own that never names a component; a component of nulls has a null
    id. Repeated rows are repeated. A very long text is hashed whole. Empty table: no rows. Other columns
    are ignored, whatever their names.
    """
    fps = materialize(fingerprints(docs), "simhash")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    joined = grouped(nodes, distance, blocks)
    named = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    member = joined.join(named, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(member, "fp").select("doc_id", hexed, "component_id")


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their near-duplicate group, all columns kept.

    Rows without doc_id stay only where their whole group has none. Of rows that share both doc_id
    and text, one stays.
    """
    dup = near_duplicates(docs.select("doc_id", "text"), **options)
    (keep,) = fresh(docs.columns, "keep")
    ids = dup.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(keep)).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(keep)), "left_semi").dropDuplicates(["doc_id", "text"])
