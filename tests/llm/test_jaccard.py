"""The pipeline's near dedup against groups that plain Python finds by 5-word Jaccard similarity."""

from itertools import combinations
from random import Random

import corpus_pipeline
from ledgerspark.llm import jaccard, simhash
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    """Runs of five words, letters A-Z folded, split at ASCII white space: by hand."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def kept(rows):
    """doc_ids that stay: of each group of links of at least 0.8 the smallest."""
    sets = {}
    for i, t in rows:
        sets.setdefault(grams(t), []).append(i)
    up = {g: g for g in sets}

    def find(g):
        while up[g] is not g:
            g = up[g]
        return g

    for a, b in combinations(sets, 2):
        if a and b and 5 * len(a & b) >= 4 * len(a | b):
            up[find(a)] = find(b)
    groups = {}
    for g, ids in sets.items():
        groups.setdefault(find(g), []).extend(ids)
    return sorted(min(ids) for ids in groups.values())


def test_edited_copies_go(spark):
    random = Random(5)
    words = [f"w{k}" for k in range(2000)]
    rows = []
    for k in range(40):
        text = [random.choice(words) for _ in range(random.randint(30, 400))]
        rows.append((10 * k, " ".join(text)))
        for j in range(1, 6):  # 1 to 5 changed places: similarities on either side of 0.8
            copy = list(text)
            for _ in range(j):
                copy[random.randrange(len(copy))] = "changed"
            rows.append((10 * k + j, " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "Two words"), (904, "two WORDS"), (905, "one two three four")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], KIND).repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == kept(rows)


def test_whole_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == kept(rows)


def test_rows_without_id(spark):
    text = " ".join(f"a{k}" for k in range(50))
    rows = [(None, text), (7, f"{text} tail"), (7, f"{text} tail"), (None, "lost words"), (8, text)]
    got = jaccard.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "lost words"), (7, f"{text} tail")]
    assert jaccard.first_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_simhash_groups_are_compared(spark):
    """Without any band, near copies that op2's fingerprints link are found; each link is verified on the whole sets."""
    random = Random(8)
    texts = [" ".join(f"w{random.randrange(5000)}" for _ in range(400)) for _ in range(30)]
    texts += [f"{t} tail" for t in texts] + ["w1 w2 w3", "w1 w2 w3 w1 w2 w3"]
    source = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    rows = jaccard._sets(source).cache()
    text_of = {r.node: texts[r.doc_id] for r in rows.collect()}
    bare = jaccard._nodes(rows).withColumn("keys", F.array().cast("array<long>"))
    got = {frozenset(text_of[n] for n in r) for r in jaccard._links(source, bare, 0.8).collect()}
    bits = lambda a, b: (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count()
    near = {frozenset((t, f"{t} tail")) for t in texts[:30] if bits(t, f"{t} tail") <= 3}
    assert near and near <= got
    assert all(5 * len(a & b) >= 4 * len(a | b) for a, b in (map(grams, pair) for pair in got))
