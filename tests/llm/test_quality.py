"""The quality model's parts against naive versions: counts, ratios, the hinge solution, packed rows."""

from random import Random

import numpy as np
from ledgerspark.llm import quality
from ledgerspark.llm.linear import fit_hinge


def test_packed_rows_come_back():
    random = Random(1)
    for n in (0, 1, 50, 3000, 60_000, quality.SIZE):
        at = np.array(sorted(random.sample(range(quality.SIZE), n)), np.int32)
        raw = quality.pack(at)
        assert (quality.unpack(raw) == at).all() and len(raw) <= quality.SIZE // 8 + 2


def test_features_are_indicators():
    seen = np.zeros(quality.SIZE, bool)
    a = quality.features(b"aaab aaab", seen)
    assert len(set(a.tolist())) == len(a) and not seen.any()
    # runs of characters: a b blank; aa ab b_ _a; aaa aab ab_ b_a _aa
    assert [int(((a >= lo) & (a < hi)).sum()) for lo, hi in ((0, 1 << 14), (1 << 14, 2 << 14), (2 << 14, quality.CHAR_SIZE))] == [3, 4, 5]
    assert len(quality.features(None, seen)) == 0 and len(quality.features(b"", seen)) == 0
    long = quality.features(("x" * 2_000_000).encode(), seen)
    assert len(long) < 10


def test_log_ratios_by_hand():
    counts = np.array([[1.0, 3.0], [2.0, 2.0]])
    want = [np.log((2 / 4) / (1 / 4)), np.log((2 / 4) / (3 / 4))]
    assert np.allclose(quality.log_ratio(counts), want)


def test_hinge_against_subgradient_descent():
    """The dual solution's objective is that of plain, slow subgradient descent on the primal, or lower."""
    random = np.random.default_rng(3)
    size, cost = 12, 0.5
    rows = [np.flatnonzero(random.random(size) < 0.4) for _ in range(80)]
    scale = random.normal(size=size)
    y = np.array([int(scale[r].sum() + random.normal() > 0) for r in rows])
    sign = np.where(y == 1, 1.0, -1.0)
    weight = np.where(y == 1, cost * len(y) / (2 * (y == 1).sum()), cost * len(y) / (2 * (y == 0).sum()))
    x = np.zeros((len(rows), size + 1))
    for i, r in enumerate(rows):
        x[i, r] = scale[r]
    x[:, -1] = 1.0

    def objective(v):
        return 0.5 * v @ v + (weight * np.maximum(0, 1 - sign * (x @ v))).sum()

    got_w, bias = fit_hinge(rows, y, scale, cost, epochs=2000)
    got = objective(np.append(np.divide(got_w, scale), bias))
    v, best = np.zeros(size + 1), np.inf
    for t in range(1, 40_000):
        inside = sign * (x @ v) < 1
        v = v - (v - (x[inside].T * (weight * sign)[inside]).sum(1)) / (t + 50)
        best = min(best, objective(v))
    assert got <= best + 1e-3 * abs(best)


def test_any_type_of_id(spark):
    docs = spark.createDataFrame([(f"id-{k}", "good words in a row here" if k % 2 else "#### 1234 !!!! ####") for k in range(60)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"id-{k}", k % 2) for k in range(60)], "doc_id string, quality int")
    got = quality.classify(docs, labels).collect()
    assert all(r.predicted == int(r.doc_id[3:]) % 2 for r in got)
