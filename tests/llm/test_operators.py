"""Each training-data operator against brute force, on small tables with nulls, empty texts and repeats."""

import base64
import hashlib
import zlib
from collections import Counter
from itertools import combinations
from random import Random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from ledgerspark.llm import decontam, fertility, line_edit, mixing, quality, queries, simhash, spans, token_orc, toxicity, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, label int, _h long, fp string, `row` long, n long, i long, keep long, skey string"


def docs_of(spark, rows):
    """Rows of (doc_id, text, source) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, 7, "x", 1, 2, 3, 4, "y") for i, t, s in rows], DOC).repartition(3)


@pytest.fixture(scope="module")
def mixed():
    random = Random(3)
    words = [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(random.choice(words) for _ in range(n))
    rows = [(k, text(random.randint(1, 120)), "abc"[k % 3]) for k in range(60)]
    long = text(4000)
    rows += [(100, rows[3][1], "a"), (101, rows[3][1].upper(), "b"), (102, long, "a"), (103, long + " tail", None), (104, None, None), (105, "", "c"), (106, " \n\t ", "c"), (107, rows[5][1], "a"), (107, rows[5][1], "a"), (None, rows[7][1], "b"), (None, "lost", "b")]
    return rows


@pytest.fixture(scope="module")
def real():
    db = duckdb.connect()
    return db.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ascii_words(text):
    out = text or ""
    for c in "\t\n\x0b\x0c\r":
        out = out.replace(c, " ")
    return [w for w in out.split(" ") if w]


def brute_fingerprint(text):
    words = ascii_words(fold(text))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_simhash(spark, mixed, real):
    rows = mixed + [(1000 + i, t, "z") for i, t in real]
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    root = roots(set(fps), [(a, b) for a, b in combinations(set(fps), 2) if (a ^ b).bit_count() <= 3])
    low = {}
    for (i, _, _), f in zip(rows, fps, strict=True):
        if i is not None:
            low[root[f]] = min(i, low.get(root[f], i))
    want = Counter((i, f"{f:016x}", low.get(root[f])) for (i, _, _), f in zip(rows, fps, strict=True))
    assert Counter(tuple(r) for r in got) == want
    kept = [r.doc_id for r in simhash.first_of_each(docs_of(spark, mixed)).collect()]
    assert 3 in kept and 100 not in kept and 101 not in kept and 107 not in kept


def test_quality_rules(spark, mixed, real):
    rows = mixed + [(2000 + i, t, "z") for i, t in real]
    got = fertility.rate(docs_of(spark, rows)).collect()
    want = Counter()
    for i, t, _ in rows:
        t, words = t or "", ascii_words(t)
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        hit = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if ascii_words(x)]
        want[i, len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words)] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert all(not (r.base_failed and r.kept) for r in got)


def test_bands_keep_clean_prose(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = fertility.rate(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    share = lambda v: np.mean([r.kept for r in rows if r.quality == v])
    assert share(1) > 0.97 and share(0) < share(1)


def test_tokens(spark, mixed, real):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [r for r in mixed if r[0] is not None and r[0] != 107] + [(3000 + i, x, "z") for i, x in real] + [(4000, "İ ﬁ ٣ <|endoftext|> don't… a,b. c.\nÄÖÜ", "z")]
    rows.sort(key=lambda r: r[0])
    want, start = [], 0
    for i, x, _ in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_orc.token_report(docs_of(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == want


def test_spans(spark):
    passage = "The first sentence of a passage has ten words in it. The second one follows with nine more words here. A third closes the whole matter for good."
    rows = [(1, f"Unique opening line number one stands here. {passage} And a tail.", "a"), (2, f"Another way to start. {passage}", "b"), (3, "Nothing shared at all in this little text.", None), (4, None, None), (5, "", "c"), (None, passage, "c")]
    got = {r.doc_id: r for r in spans.dedup(docs_of(spark, rows)).collect()}
    assert got[1].n_removed == 0 and got[1].text == rows[0][1]
    assert got[2].text.strip() == "Another way to start." and got[2].n_removed == 3
    assert got[None].text == "" and got[3].text == rows[2][1] and got[4].text is None and got[5].text == ""


def test_warc(spark):
    rows = [(5, "http://a", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (3, None, None), (4, "http://c", ""), (9, "http://d", "é" * 5000), (7, "u", "own"), (7, "u", "own"), (None, "n", "null id")]
    index = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = warc.read_warc(index).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    assert len(got) == len(rows)
    for r in got:
        h = next(h or "" for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(h.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        assert r.record_type == ("response" if r.refers_to is None else "revisit")
        assert r.refers_to is None or r.refers_to == first[h]
    assert sum(r.record_type == "response" for r in got) == len({h or "" for _, _, h in rows})
    one = next(r for r in index.collect() if r.page_id == 9)
    headers, block = warc.read_record(one.file, one.frame, one.record_offset)
    assert headers["WARC-Type"] == "response" and block.endswith(("é" * 5000).encode())


@pytest.mark.parametrize("module,label,least", [(quality, "quality", 0.75), (toxicity, "toxic", 0.85)])
def test_held_out_accuracy(spark, module, label, least):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in module.classify(docs, labels).collect()}
    known = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None}
    held = [i for i in known if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(got) == docs.count() and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    balanced = np.mean([np.mean([got[i].predicted == v for i in held if known[i] == v]) for v in (0, 1)])
    print(label, len(held), balanced)
    assert balanced >= least


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_edges(spark, module, label, mixed):
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    got = module.classify(docs_of(spark, mixed), none).collect()
    assert len(got) == len(mixed) and all(0 <= r.score <= 1 for r in got)
    some = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (61, None), (4, 0)], f"doc_id long, {label} int")
    assert all(0 <= r.score <= 1 for r in module.classify(docs_of(spark, mixed), some).collect())


def test_mix(spark, mixed):
    got = mixing.mix(docs_of(spark, mixed)).collect()
    sizes, order = Counter(), sorted({s for _, _, s in mixed if s is not None}) + [None]
    for _, t, s in mixed:
        sizes[s] += len(ascii_words(t))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    by = {sizes[s]: target[s] for s in order}
    taken = Counter()
    assert len(got) == len(mixed)
    for r in got:
        assert r.target == pytest.approx(by[r.source_size]) and r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source_size] += r.taken
    for s in order:
        # the null source has one document of 4,001 words: no whole number of copies comes nearer than half of it
        assert abs(taken[sizes[s]] - target[s]) <= (max(30, 0.02 * target[s]) if s is not None else 4001 / 2)
    again = mixing.mix(docs_of(spark, mixed[::-1])).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in got)
    rows = mixing.mixed_rows(docs_of(spark, mixed))
    assert Counter(r.doc_id for r in rows.collect()) == Counter({i: n for i, n in _copies(got).items() if n})


def _copies(got):
    out = Counter()
    for r in got:
        out[r.doc_id] += r.copies
    return out


def test_empty_tables(spark):
    none, labels = docs_of(spark, [(1, "x", "y")]).where("false"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench, pages = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "page_id long, url string, html string")
    made = [quality.classify(none, labels), simhash.near_duplicates(none), fertility.rate(none), spans.dedup(none), token_orc.token_report(none), line_edit.near_lines(none), warc.read_warc(warc.write_warc(pages)), toxicity.classify(none, labels), decontam.contamination(none, bench), mixing.mix(none)]
    assert [df.count() for df in made] == [0] * 10


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]


def test_warc_is_read_in_parallel(spark):
    pages = spark.range(400).selectExpr("CAST(id AS STRING) || 'x:y' AS page_id", "'u' AS url", "repeat(CAST(id AS STRING), 2000) AS html", "1 AS digest", "2 AS first", "3 AS _p").repartition(4)
    index = warc.write_warc(pages, frame_bytes=20_000)
    rows = warc.read_warc(index, task_bytes=100_000)
    assert rows.rdd.getNumPartitions() > 8
    got = rows.collect()
    assert sorted(r.page_id for r in got) == sorted(f"{k}x:y" for k in range(400))
    assert all(r.payload.decode() == r.page_id.removesuffix("x:y") * 2000 for r in got)
    frames = {(r.file, r.frame) for r in index.collect()}
    assert len(frames) > 50


def test_token_files(spark, mixed, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(k, f"BİRİNCİ, iki {k} sözcük. İ, don't {'x' * (k % 50)}") for k in range(300)] + [(300, "w" * 200_000), (301, ". " * 1000)]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        path = token_orc.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), files=4)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    start, want = 0, []
    for i, x in rows:
        ids = [*t.encode(x, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), ids))
        start += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, list(r.ids)) for r in token_orc.read_tokens(spark, path).collect())
    assert got == want
    one = token_orc.lookup(spark, path, [17, 250, 10_000]).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in one) == [(i, want[i][3]) for i in (17, 250)]


def test_lookup_skips_stripes(spark):
    """Ids lie apart by 2: an even id's files go by statistics, an odd one within the range by the Bloom filter."""
    docs = spark.range(40_000).selectExpr("2 * id AS doc_id", "'some words ' || id AS text")
    path = token_orc.write_tokens(docs, files=4)

    def rows_read(ids):
        df = token_orc.lookup(spark, path, ids)
        df._jdf.collectToPython()
        plan = df._jdf.queryExecution().executedPlan()
        while not plan.nodeName().startswith("Scan"):
            plan = plan.children().head()
        return plan.metrics().apply("numOutputRows").value(), df.count()

    assert rows_read([30_000])[1] == 1 and rows_read([30_000])[0] <= 2 * 2000
    assert rows_read([30_001]) == (0, 0)


def test_token_fuzz():
    from tokenizers import Tokenizer

    t, random = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Random(1)
    letters = "abcXYZéÄÖß İıſKÅ ,.!?'\"-—…0123٣½ﬁ Ωжहि中한̇́\xad​ \u0085  \n\t\r\x0b\x0c\x1c<|>_@#ŁłŒœʼnǅ"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(1, 25))) for _ in range(12_000)]
    enc = token_orc.WordEncoder(token_orc.VOCABULARY, 1 << 20, 1 << 19)
    got = [x for k in range(0, len(texts), 100) for x in enc.encode_all([t.encode() for t in texts[k : k + 100]])]
    bad = [x for x, g in zip(texts, got, strict=True) if np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() != g]
    assert not bad
