"""Token ids in ORC files: run-length encoded ids, row indexes, Bloom filters on document ids.

write_tokens() encodes texts with a public vocabulary and writes (doc_id, before, n_tokens, ids) in
ascending doc_id order. ORC keeps integers in run-length encoding v2, statistics per row group and per
stripe, and a Bloom filter on doc_id, so a reader skips stripes by metadata and takes stripes in parallel.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Recent, release, resident, shared_path, small_batches

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
#: Bytes of encoded words, and again of their parts, that a worker remembers at most.
WORDS_BYTES, PARTS_BYTES = 112 << 20, 40 << 20

ORC_OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "2000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


class WordEncoder:
    """Encodes texts as the tokenizers library does, each word and each part of a word once.

    word_bpe_49k never looks across white space: its normaliser works on characters, its splitter drops
    white space, and its merges stay within a part that the splitter cuts. So a text's ids are those of
    its words in turn. Words of characters below U+0250 are lower-cased and cut here, and the library
    encodes the parts it has not seen, many in one call; any other word goes through the library whole.
    """

    # Fixed values of the vocabulary: its splitter's pattern and the end-of-word mark.
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")
    END = "</w>"
    #: A comma or full stop that white space follows and that belongs to a run of punctuation.
    CLUSTER = re.compile(rb"[,.](?=[ \n])(?<![a-z0-9][,.])(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][,.])(?<!\xc4[\x80-\xaf\xb1-\xbf][,.])(?<![\xc5-\xc9][\x80-\xbf][,.])").search
    #: U+0130 is left out: in lower case it ends in a combining dot, which the splitter joins with punctuation.
    PLAIN = re.compile(r"[\n\x21-\x7e\xa1-\u012f\u0131-\u024f]*").fullmatch

    def __init__(self, path: str, words_bytes: int = WORDS_BYTES, parts_bytes: int = PARTS_BYTES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.parts = Tokenizer(self.whole.model)  # the same merges without normaliser and splitter
        self.parts.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(self.END)]] = True
        # byte-level alphabets show printable bytes as themselves and the others from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.shown = dict(zip(plain, map(chr, plain), strict=True)) | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.words, self.known = Recent(words_bytes), Recent(parts_bytes)

    @classmethod
    def _words(cls, raw: bytes) -> list[bytes]:
        """A text's words, in lower case as far as ASCII goes, a comma or full stop after a letter or digit
        as a word of its own: forms that encode to the same ids and that texts repeat more often."""
        if b"<|" in raw:  # special tokens keep their case
            return raw.split()
        raw = raw.lower()
        if not cls.CLUSTER(raw):
            raw = raw.replace(b", ", b" , ").replace(b". ", b" . ").replace(b",\n", b" ,\n").replace(b".\n", b" .\n")
        return raw.split()

    def _learn_parts(self, parts: list[str], into: Recent, keys: list) -> None:
        for k in range(0, len(parts), 1024):
            some = parts[k : k + 1024]
            shown = " ".join(some).encode().decode("latin-1").translate(self.shown | {32: " "})
            ids = np.array(self.parts.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            raw = ids.tobytes()
            for key, i, j in zip(keys[k : k + 1024], [0, *cuts[:-1]], cuts, strict=True):
                into.put(key, raw[4 * i : 4 * j])

    def _learn(self, words: list[bytes]) -> None:
        plain = [w for w in words if w.isalpha() and w.islower()]  # lower-case letters of ASCII are one part
        self._learn_parts([w.decode() for w in plain], self.words, plain)
        self._learn_mixed([w for w in words if not (w.isalpha() and w.islower())])

    def _learn_mixed(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        joined = "\n".join(texts)
        lower = joined.lower()
        if not self.PLAIN(joined) or not self.PLAIN(lower) or "<|" in joined:
            if len(words) > 1:
                odd = [not self.PLAIN(t) or not self.PLAIN(t.lower()) or "<|" in t for t in texts]
                self._learn_mixed([w for w, o in zip(words, odd, strict=True) if not o])
                words = [w for w, o in zip(words, odd, strict=True) if o]
            for w in words:
                self.words.put(w, np.array(self.whole.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes())
            return
        parts = self.SPLIT.findall(lower)
        new = self.known.unknown(set(parts) - {"\n"})
        self._learn_parts(new, self.known, new)
        ids, k, known = [], 0, self.known.now
        for p in parts:
            if p == "\n":
                self.words.put(words[k], b"".join(ids))
                ids, k = [], k + 1
            else:
                ids.append(known[p])
        if words:
            self.words.put(words[k], b"".join(ids))

    def encode_all(self, texts: list[bytes | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; the texts' new words are encoded together."""
        split = [self._words(t or b"") for t in texts]
        new = self.words.unknown(set().union(*split))
        if new:
            self._learn(new)
        known = self.words.now.__getitem__
        return [b"".join(map(known, words)) for words in split]


def encoder(path: str) -> WordEncoder:
    return resident(("token_orc", path), lambda: WordEncoder(path))


def write_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, files: int | None = None) -> str:
    """Write the ids of docs(doc_id, text) as ORC; returns the path.

    Null or empty text: the end id alone. Null doc_id: first in order. Repeated ids: one row each, in
    order of their texts' hashes. Empty table: files without rows. Other columns are ignored. The ids of
    a document stay in one row, however long it is; so does a very long text or word. before is the number
    of ids in the same file that stand before the row; a task writes one file, whatever the session says
    of records per file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    order = ["doc_id", "_h"]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("_h"))
    rows = (rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)).sortWithinPartitions(*order)

    def encode(batches):
        enc, before, end = encoder(vocabulary), 0, np.array([end_id], "<u4").tobytes()
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                raw = [ids + end for ids in enc.encode_all(part.column(1).to_pylist())]
                n = np.array([len(x) // 4 for x in raw], "int64")
                offsets = np.concatenate([[0], np.cumsum(n)]).astype("int32")
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(before + offsets[:-1].astype("int64")), pa.array(n), ids], names=["doc_id", "before", "n_tokens", "ids"])
                before += int(offsets[-1])

    path = shared_path(spark, "tokens-orc")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows.mapInArrow(encode, f"doc_id {kind}, before long, n_tokens long, ids array<int>").write.options(**ORC_OPTIONS, maxRecordsPerFile="0").orc(path)
    return path


def read_tokens(spark: SparkSession, path: str, schema: str = "doc_id long, before long, n_tokens long, ids array<int>") -> DataFrame:
    """The files' rows with start, the number of ids in all files before the row; stripes are read in parallel.

    The files' totals come from the metadata columns alone; there are as many as files, which
    spark.sql.shuffle.partitions bounds, so they are broadcast.
    """
    # part files carry the number of their partition
    rows = spark.read.schema(schema).orc(path).withColumn("_file", F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int"))
    files = rows.groupBy("_file").agg(F.sum("n_tokens").alias("_n"))
    w = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_o"))
    return rows.join(F.broadcast(files), "_file").withColumn("start", F.col("before") + F.col("_o")).drop("_file", "_o", "before")


def lookup(spark: SparkSession, path: str, doc_ids: list, schema: str = "doc_id long, before long, n_tokens long, ids array<int>") -> DataFrame:
    """(doc_id, n_tokens, ids) of the given documents.

    The condition reaches the ORC reader: statistics leave out files, stripes and row groups whose ids
    lie elsewhere, and Bloom filters those whose range holds an id that they have not.
    """
    return spark.read.schema(schema).orc(path).where(F.col("doc_id").isin(*doc_ids)).select("doc_id", "n_tokens", "ids")


def crc_of_ids(batches):
    """mapInArrow: unsigned crc32 of each row's ids as little-endian unsigned 32-bit integers.

    The encoder goes first: a worker that has just written ids would hold its word memory beside the ids it reads.
    """
    release()
    for b in batches:
        ids = b.column("ids")
        at, flat = np.asarray(ids.offsets), np.asarray(ids.values).astype("<i4", copy=False)
        crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_report(docs: DataFrame, **options) -> DataFrame:
    """Write docs' ids, read the files back: (doc_id, start, n_tokens, ids_crc32), one row per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    path = write_tokens(docs, **options)
    rows = read_tokens(docs.sparkSession, path, f"doc_id {kind}, before long, n_tokens long, ids array<int>")
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(crc_of_ids, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
