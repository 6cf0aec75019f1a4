"""Repeated rows under skew, ids of text, sources that miss their targets, long counted words."""

import numpy as np
import pytest
from ledgerspark.llm import decontam, mixing, toxicity, warc
from pyspark.sql import functions as F


def test_repeated_pages_under_skew(spark):
    """Adaptive execution splits the one large key, and still one of the equal rows is the response."""
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    rows = [(7, "u", "<p>again</p>" * 200)] * 30 + [(7, "v", "<p>again</p>" * 200)] * 10 + [(3, None, "x")] * 2 + [(k, "w", f"<p>{k}</p>" * 100) for k in range(100, 160)] + [(None, "n", "<p>again</p>" * 200)] * 3
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        index = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(16))
        got = warc.read_warc(index).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    kinds = lambda i: sorted((r.record_type, r.refers_to) for r in got if r.page_id == i)
    assert len(got) == len(rows) and kinds(7) == [("response", None)] + [("revisit", 7)] * 39
    assert kinds(3) == [("response", None), ("revisit", 3)] and kinds(None) == [("revisit", 7)] * 3
    places = [(r.file, r.frame, r.record_offset) for r in index.collect()]
    assert len(set(places)) == len(rows)
    ids = {warc.read_record(*p)[0]["WARC-Record-ID"] for p in places}
    assert len(ids) == len(rows)


@pytest.mark.parametrize("pass_chars", [1_000_000, 40])
def test_items_named_by_text(spark, pass_chars):
    benchmark = spark.createDataFrame([("q-1", "What is the tallest mountain on the planet?"), ("q-2", "Name three rivers of the north country."), (None, None)], "item_id string, text string")
    docs = spark.createDataFrame([("d1", "He asked: what is the tallest mountain on the planet? Nobody knew."), ("d2", "plain words"), (None, None)], "doc_id string, text string")
    got = {r.doc_id: r.item_ids for r in decontam.contamination(docs, benchmark, pass_chars=pass_chars).collect()}
    assert got == {"d1": ["q-1"], "d2": [], None: []}


def test_sources_left_open_raise(spark):
    sizes = spark.createDataFrame([("s", "a", k) for k in range(1, 50)], "skey string, source string, size long")
    targets = mixing.source_targets(sizes, share=0.9)
    with pytest.raises(RuntimeError, match="1 sources"):
        mixing.solve(sizes, targets, rounds=1)
    assert mixing.solve(sizes, targets).where("open").isEmpty()


def test_rates_against_bisection(spark):
    """Each source's rates are those of one multiplier that meets its target; a plain bisection finds the same ones."""
    random = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(n)), "abc"[i % 3]) for i, n in enumerate(random.integers(0, 60, 240))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "abc":
        mine = [r for r in got if r.skey == f"s{s}"]
        size, target = np.array([r.size for r in mine], float), mine[0].target
        mean = max(1.0, size.sum() / len(size))
        low, high = -200.0, 200.0
        for _ in range(200):
            mid = (low + high) / 2
            rate = 2 / (1 + np.exp(np.clip(-mid * size / mean, -700, 700)))
            low, high = (mid, high) if (rate * size).sum() < target else (low, mid)
        assert np.allclose([r.rate for r in mine], rate, atol=1e-4) or target >= 2 * size.sum() * (1 - 1e-9)
        assert abs(sum(r.taken for r in mine) - target) <= size.max()


def test_a_long_counted_word_is_looked_up_whole():
    model = toxicity.language_model(np.ones((toxicity.ALPHABET,) * 3).ravel())
    word = "zorgle" + "abcdefghij" * 6
    found = lambda counts: toxicity.Restorer(model, {"^zorgl": 0.9, "zorgle": 0.9}, counts).found(f"so {word} it is")
    (share, name), = found({word: (0, 50)}).values()
    assert name == word and share < 0.7 and max(x[0] for x in found({}).values()) == 0.9
