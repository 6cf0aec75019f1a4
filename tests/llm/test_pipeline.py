"""The corpus pipeline on a small corpus: what each stage keeps, by plain Python, and its whole result."""

import zlib
from collections import Counter
from random import Random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from ledgerspark.llm import fertility

from test_decontam import brute as contaminated
from test_jaccard import kept as first_of_each

KIND = "doc_id long, text string, lang string, source string, n_chars long, `row` long, keep long, n long, hits string, i long, found long"


def make(spark, rows):
    """Rows of (doc_id, text, source) with further columns whose names the stages use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, 3, "x", 4, 5) for i, t, s in rows], KIND)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) BETWEEN 80 AND 1500").orderBy("doc_id").limit(70).collect()]
    random = Random(6)
    items = [(k, real[k][20:140]) for k in range(4)] + [(9, "tiny"), (10, None)]
    rows = [(10 * k, t, "abc"[k % 3]) for k, t in enumerate(real)]
    for k in range(12):  # near copies: some words changed
        words = real[10 + k].split()
        for _ in range(1 + k // 3):
            words[random.randrange(len(words))] = "changed"
        rows.append((10 * k + 3, " ".join(words), "b"))
    rows += [(2000, None, None), (2001, "", "a"), (2002, " \n\t", "b"), (2003, "too few words", "c"), (2004, "la " * 300, "c"), (2005, real[5], "a"), (2006, real[5], "a"), (2006, real[5], "a"), (None, real[6], None), (None, "lost words of a document without id or source, long enough to stay here and clean", None), (2007, "w" * 100_000, "a"), (2008, "#$% 12 " * 40, "b")]
    folder = tmp_path_factory.mktemp("corpus")
    make(spark, rows).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), items


def naive_quality(text):
    """The fertility verdict, each word encoded by itself."""
    m = fertility.Measure(fertility.BYTE_BPE, fertility.PIECE_BPE)
    words = (text or "").encode().split()
    repeated = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    hit = {k + j for k in range(len(words) - 4) if repeated[tuple(words[k : k + 5])] > 1 for j in range(5)}
    if len(words) < 10 or 100 * len(hit) > 20 * len(words):
        return False
    tokens = sum(len(m.bpe.encode_ordinary(" " + w.decode())) for w in words)
    pieces = [p for w in words for p in m.pieces.encode(w.decode())]
    share = [n / len(pieces) for n in Counter(pieces).values()]
    band = fertility.BANDS[fertility.script_of((text or "").encode())]
    chars = sum(len(w.decode()) for w in words) / tokens
    floor = band.entropy * np.interp(np.log2(len(pieces)), *fertility.ENTROPY_FLOOR)
    return band.chars_per_token[0] <= chars <= band.chars_per_token[1] and np.mean([m.pieces.IsByte(p) for p in pieces]) <= band.byte_share and -sum(p * np.log2(p) for p in share) >= floor - 1e-9


def test_stages(spark, corpus):
    from tokenizers import Tokenizer

    folder, items = corpus
    step = dict(corpus_pipeline.STAGES)
    assert list(step) == ["quality rules", "near dedup", "decontamination", "mixing", "tokens"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    good = step["quality rules"](spark, docs, folder).cache()
    want = Counter(p for p in pairs(docs) if naive_quality(p[1]))
    assert Counter(pairs(good)) == want and 40 < sum(want.values()) < docs.count()

    one = step["near dedup"](spark, good, folder).cache()
    ids = [(i, t) for i, t in pairs(good) if i is not None]
    assert sorted(i for i, _ in pairs(one) if i is not None) == first_of_each(ids)
    assert [t for i, t in pairs(one) if i is None] == [t for i, t in pairs(good) if i is None and "lost words" in t]

    clean = step["decontamination"](spark, one, folder).cache()
    bad = {(i, hit) for i, hit, _, _ in contaminated(pairs(one), items)}
    assert sorted(str(i) for i, _ in pairs(clean)) == sorted(str(i) for i, hit in bad if not hit) and any(hit for _, hit in bad)

    mixed = step["mixing"](spark, clean, folder).cache()
    copies, texts = Counter(pairs(mixed)), dict.fromkeys(pairs(clean))
    assert set(copies) <= set(texts) and max(copies.values()) <= 2
    size = {p: len((p[1] or "").split()) for p in texts}
    assert abs(sum(size[p] * n for p, n in copies.items()) - 1.5 * sum(size.values())) <= 0.05 * sum(size.values())

    for df in (good, one, clean, mixed):
        assert df.columns == docs.columns
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = step["tokens"](spark, mixed, folder)
    want, start = [], 0
    for (i, text), n in sorted(copies.items(), key=lambda x: (x[0][0] is not None, x[0][0] or 0)):
        for _ in range(n):
            tokens = [*t.encode(text or "", add_special_tokens=False).ids, 1]
            want.append((i, start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
            start += len(tokens)
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == Counter(want)


def test_empty_tables(spark, tmp_path):
    make(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
