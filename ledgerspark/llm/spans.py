"""Substring dedup by sliding sentence spans.

A text is cut into sentences. From every sentence starts a span, and at every sentence ends one: the
shortest run of consecutive sentences that has at least MIN_SENTENCES of them and MIN_WORDS words. A
sentence of LONE_WORDS words or more is a span of its own. Spans are hashed and joined over
the whole corpus; of equal spans the first, by doc_id and position, stays, and the sentences of every
other one are removed.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

MIN_SENTENCES, MIN_WORDS = 2, 16
#: A single sentence of so many words is a span.
LONE_WORDS = 50

#: A sentence ends after closing punctuation that white space follows, or at a line's end; it keeps what
#: follows it. No run of marks is entered twice, so the time is linear in the text.
_MARKS = ".!?…。！？।॥؟۔"
SENTENCE_END = re.compile(rf"(?<![{_MARKS}])[{_MARKS}]++[\"'”’)\]]*+(?=\s|\Z)\s*+|\n\s*+")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text with the white space after each; joined they are the text."""
    if not text:
        return []
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return [text[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]


def span_ends(total: list[int], min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> list[int]:
    """For each sentence, the end (exclusive) of the span that starts there, 0 if the text ends first; total: words
    before each sentence, and in all."""
    out, end, n = [], 0, len(total) - 1
    for j in range(n):
        need = total[j] + min_words
        end = max(end, j + min_sentences)
        while end <= n and total[end] < need:
            end += 1
        out.append(end if end <= n else 0)
    return out


def span_ranges(words: list[int], min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, lone_words: int = LONE_WORDS) -> list[tuple[int, int]]:
    """(start, end) of all spans of a text whose sentences have so many words, each once."""
    n, total = len(words), [0, *accumulate(words)]
    out = {(j, end) for j, end in enumerate(span_ends(total, min_sentences, min_words)) if end}
    # the shortest that ends at a sentence is the shortest that starts there when read backwards
    back = [total[-1] - x for x in reversed(total)]
    out |= {(n - end, n - j) for j, end in enumerate(span_ends(back, min_sentences, min_words)) if end}
    out |= {(j, j + 1) for j, size in enumerate(words) if size >= lone_words}
    return sorted(out)


def spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, doc_id, start, n, key) for each span of docs(row, doc_id, text); key is a 128-bit hash of its words."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                at, start, size, keys = [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    words = [s.encode("utf-8", "surrogatepass").split() for s in sentences(text)]
                    # all words with one blank after each; a span is a slice of it
                    plain = [b" ".join([*w, b""]) for w in words]
                    joined, place = b"".join(plain), [0, *accumulate(map(len, plain))]
                    for j, end in span_ranges([len(w) for w in words], min_sentences, min_words):
                        if words[j]:
                            at.append(i)
                            start.append(j)
                            size.append(end - j)
                            keys.append(xxhash.xxh3_128_digest(joined[place[j] : place[end]]))
                if at:
                    at = pa.array(at)
                    yield pa.RecordBatch.from_arrays([part.column("row").take(at), part.column("doc_id").take(at), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(keys, pa.binary())], names=["row", "doc_id", "start", "n", "key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, start int, n int, key binary")


def dedup(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed, removed) for each row of docs(doc_id, text).

    text: what is left; removed: the numbers of the sentences that went. Null text stays null and has no
    sentences. Spans compare as words, so white space does not matter, and letter case does. A span
    repeated within one text counts like any other. Rows of one doc_id stand in the order of their texts'
    hashes, and rows that repeat both doc_id and text get the same result, as if they were one; rows
    without doc_id come after all others. Empty table: no rows. Other columns are ignored.
    """
    source = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    found = materialize(spans(source, min_sentences, min_words), "spans")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "start", "n")
    # a table of its own: the join then has an exchange on either side, and a hot span's rows can be split
    first = materialize(found.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n_found")).where("n_found > 1").drop("n_found"), "spans-first")
    late = found.join(first, "key").where(order > F.col("first")).select("row", "doc_id", "start", "n")
    gone = late.groupBy("row", "doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"))
    gone = gone.withColumnRenamed("doc_id", "_d")
    joined = source.join(gone, (source["row"] == gone["row"]) & source["doc_id"].eqNullSafe(gone["_d"]), "left").select("doc_id", "text", "spans")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.IntegerType()))])

    def cut(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts, total, removed = [], [], []
                for text, gone in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    parts = sentences(text)
                    out = np.zeros(len(parts), bool)
                    for x in gone or ():
                        out[x["start"] : x["start"] + x["n"]] = True
                    total.append(len(parts))
                    removed.append(np.flatnonzero(out).tolist())
                    texts.append("".join([p for p, o in zip(parts, out.tolist(), strict=True) if not o]) if removed[-1] else text)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array([len(r) for r in removed], pa.int64()), pa.array(removed, pa.list_(pa.int32()))], names=schema.names)

    return joined.mapInArrow(cut, schema)
