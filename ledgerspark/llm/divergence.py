"""Divergence of a language's sources by a rotation of packed term vectors.

A group (language, source) is a vector of smoothed term shares, cut into blocks of terms that all groups of the language
share. Groups sit in seats. The vectors are a table bucketed by language, seat and block: in each round of a round-robin
tournament (in round r, seat i meets seat r - i modulo their number) a seat's vectors stay in their bucket, and those of
its guest, packed, travel there, so a round shuffles half of the vectors at most and a task holds two seats' share of one
block. Each meeting gives the divergence for both sides. Each block keeps a heap of its group's foremost terms.
"""

from __future__ import annotations

import heapq
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_path

LEAST_DOCS, SMOOTHING, SHARES, TOP = 30, 5, 1_000_000_000, 50
#: Rounds of a language's tournament, at most; a seat holds several groups where there are more than seats.
SEATS = 8
#: Terms of a block, and terms of a block times groups of a seat, at most.
BLOCK, HELD = 1 << 14, 1 << 23
#: Terms that a task counts before it passes the counts on; bytes of a text that it cuts into words at once.
COUNTED, PIECE = 400_000, 1 << 20

#: A-Z to a-z, what no term has to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes):
    """Lists of the terms of a UTF-8 text, in pieces: a term is a run of letters A-Z, lower-cased, and of other than ASCII."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and _FOLD[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_FOLD).split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of docs(lang, source, text): occurrences, and documents that hold the term.

    Each group has a row with an empty term too, so that groups without terms are seen. Nulls count as empty.
    """

    def run(batches):
        n, held = defaultdict(Counter), defaultdict(Counter)

        def out():
            for (lang, source), c in n.items():
                d = held[lang, source]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array([source] * len(c), pa.string()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64()), pa.array([d[t] for t in c], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            n.clear()
            held.clear()

        filled = 0
        for b in batches:
            for k in range(0, b.num_rows, 256):
                for lang, source, text in zip(*(c.to_pylist() for c in b.slice(k, 256).columns), strict=True):
                    c, own = n[lang, source], set()
                    before = len(c)
                    c[b""] += 0
                    for w in words(text):
                        c.update(w)
                        own.update(w)
                    held[lang, source].update(own)
                    filled += len(c) - before
                    if filled > COUNTED:
                        yield from out()
                        filled = 0
        yield from out()

    empty = F.lit("")
    rows = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.coalesce("text", empty).cast("binary").alias("text"))
    found = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SHARES (n + 5) / (total + 5 terms)) for each n, exactly."""
    below = total + SMOOTHING * terms
    if len(n) and (int(n.max()) + SMOOTHING) * SHARES >= 1 << 63:
        return np.array([1 + SHARES * (int(x) + SMOOTHING) // below for x in n], np.int64)
    return 1 + SHARES * (n.astype(np.int64) + SMOOTHING) // below if below else np.ones(len(n), np.int64)


def pack(at: np.ndarray, p: np.ndarray) -> bytes:
    """Positions, ascending, and shares as compressed bytes."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(at, prepend=0).astype("<i4").tobytes() + p.astype("<i4").tobytes())


def unpack(packed: bytes, width: int, none: int) -> np.ndarray:
    """The shares of all of a block's terms; none: that of a term that does not occur."""
    got = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<i4")
    out = np.full(width, none, np.int32)
    out[np.cumsum(got[: len(got) // 2])] = got[len(got) // 2 :]
    return out


def _vectors(counted: DataFrame) -> tuple[DataFrame, int]:
    """(lang, seats, seat, block, source, width, none, vec, top): packed shares and foremost terms of each group's blocks; and the most seats."""
    groups = counted.groupBy("lang", "source").agg(F.lit(1).alias("one"))
    w = Window.partitionBy("lang")
    groups = groups.withColumns({"number": F.row_number().over(w.orderBy("source")) - 1, "size": F.count("*").over(w)})
    groups = materialize(groups.select("lang", "source", "number", F.least(F.lit(SEATS), "size").cast("int").alias("seats"), "size"), "divergence-groups")
    seats, size = groups.agg(F.max("seats"), F.max("size")).first()
    kept = counted.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs")
    kept = materialize(kept, "divergence-terms")
    langs = materialize(groups.select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total")), "lang", "left").fillna(0, ["v", "lang_total"]), "divergence-langs")
    most = langs.agg(F.max("v")).first()[0] or 0
    blocks = max(1, -(-most // max(1, min(BLOCK, HELD * SEATS // max(SEATS, size or 0)))))
    kept = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    kept = materialize(kept.withColumn("at", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1), "divergence-places")
    widths = kept.groupBy("lang", "block").agg(F.count("*").cast("int").alias("width"))
    cells = materialize(counted.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "divergence-cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    grid = groups.join(langs, "lang").join(totals, ["lang", "source"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    grid = grid.join(widths, ["lang", "block"], "left")
    lists = cells.groupBy("lang", "source", "block").agg(F.array_sort(F.collect_list(F.struct("at", "n", "lang_n", "term"))).alias("cells"))
    full = grid.join(lists, ["lang", "source", "block"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    part = lambda c: F.coalesce(F.transform("cells", lambda x: x[c]), F.array().cast(f"array<{'string' if c == 'term' else 'long'}>")).alias(c)
    full = full.select("lang", "seats", F.pmod("number", F.col("seats")).cast("int").alias("seat"), "block", "source", zero("width").cast("int").alias("width"), zero("v").alias("v"), zero("total").alias("total"), zero("lang_total").alias("lang_total"), *(part(c) for c in ("at", "n", "lang_n", "term")))

    def run(batches):
        for b in batches:
            nones, vecs, tops = [], [], []
            for k in range(b.num_rows):
                v, total, lang_total = (b.column(c)[k].as_py() for c in ("v", "total", "lang_total"))
                at, n, lang_n = (b.column(c)[k].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "n", "lang_n"))
                p, q = share(n, total, v), share(lang_n, lang_total, v)
                nones.append(int(share(np.zeros(1, np.int64), total, v)[0]))
                vecs.append(pack(at, p))
                over = np.flatnonzero(p > q)
                terms = b.column("term")[k].values.take(pa.array(over)).to_pylist()
                best = heapq.nsmallest(TOP, zip((q - p)[over].tolist(), (t.encode() for t in terms), strict=True))
                tops.append([{"item": t.decode(), "value": -f} for f, t in best])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("lang", "seats", "seat", "block", "source", "width")), pa.array(nones, pa.int32()), pa.array(vecs, pa.binary()), pa.array(tops, pa.list_(pa.struct([("item", pa.string()), ("value", pa.int64())])))], names=["lang", "seats", "seat", "block", "source", "width", "none", "vec", "top"])

    schema = "lang string, seats int, seat int, block int, source string, width int, none int, vec binary, top array<struct<item:string,value:long>>"
    return full.mapInArrow(run, schema), seats or 0


def _meeting(hosts: pa.Table, guests: pa.Table) -> pa.Table:
    """(lang, a, b, value) of one block: each host with each guest; with no guests, each host with those after it by name.

    The rows of a block come in any order, and a pair's blocks are added up by (a, b), so all of them have to name it alike.
    """
    hosts = hosts.sort_by("source")
    dense = lambda t: [unpack(v, w, n) for v, w, n in zip(*(t.column(c).to_pylist() for c in ("vec", "width", "none")), strict=True)]
    a, b, value = [], [], []
    names = hosts.column("source").to_pylist()
    own = dense(hosts)
    inside = guests.num_rows == 0
    others, other_names = (own, names) if inside else (dense(guests), guests.column("source").to_pylist())
    table = np.stack(others) if others else None
    for k, x in enumerate(own):
        far = table[k + 1 :] if inside else table
        a += [names[k]] * len(far)
        b += other_names[k + 1 :] if inside else other_names
        value += np.abs(far - x).sum(axis=1, dtype=np.int64).tolist()
    lang = hosts.column("lang")[0].as_py() if names else ""
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})


def tournament(vectors: DataFrame, seats: int) -> DataFrame:
    """(lang, a, b, value) for each pair of groups of a language, once; vectors: the bucketed table."""
    spark = vectors.sparkSession
    done = spark.createDataFrame([], "lang string, a string, b string, value long")
    for r in range(seats):
        v = vectors.where(F.col("seats") > r).withColumn("across", F.pmod(F.lit(r) - F.col("seat"), F.col("seats")))
        # a guest whose host's seat is its own stays where it is: the seat's groups meet each other
        hosts = v.where("across <= seat").drop("seats", "across")
        guests = v.where("across > seat").withColumn("seat", F.col("across")).drop("seats", "across")
        # a host that waits for a guest has one: both seats of a meeting hold groups
        met = hosts.groupBy("lang", "seat", "block").cogroup(guests.groupBy("lang", "seat", "block")).applyInArrow(lambda h, g: _meeting(h, g), "lang string, a string, b string, value long")
        done = done.unionByName(materialize(met.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "divergence-round"))
    return done


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(lang, source, text).

    Part "pair": each other source of the language and the sum of share differences over all kept terms. Part "term":
    the TOP terms whose share in the group most exceeds that in the language. Kept terms stand in LEAST_DOCS documents
    of the language or more; rows are documents, so repeated rows count each. Null text, lang or source count as empty:
    a group without kept terms still meets the others, a language without any has pairs of value 0, a group alone in
    its language has no pairs. Equal values rank by item in order of UTF-8. A very long text is cut into terms piece by
    piece. Empty table: no rows. Further columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    counted = materialize(term_counts(docs), "divergence-counts")
    packed, seats = _vectors(counted)
    name, n = f"divergence_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ("lang", "seat", "block")
    packed.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).option("path", shared_path(spark, "divergence-vectors")).saveAsTable(name)
    vectors = spark.table(name)
    met = tournament(vectors.drop("top"), seats)
    side = lambda x, y: met.select("lang", F.col(x).alias("source"), F.lit("pair").alias("part"), F.col(y).alias("item"), "value")
    terms = vectors.select("lang", "source", F.lit("term").alias("part"), F.inline("top"))
    every = side("a", "b").unionByName(side("b", "a")).unionByName(terms)
    w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = every.withColumn("rank", F.row_number().over(w)).where((F.col("part") == "pair") | (F.col("rank") <= TOP))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
