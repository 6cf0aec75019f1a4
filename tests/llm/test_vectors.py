"""Vector codes and inner-product search against plain versions, with ties, hot copies, nulls and odd lengths."""

import hashlib
import math
from random import Random

import numpy as np
import pytest
from ledgerspark.llm import norm_search, vector_codes

VEC = "vec_id long, embedding array<double>, label int, v array<int>, `row` long, norm string, error long, _label int, code string"


def vectors_of(spark, rows):
    """Rows of (vec_id, embedding, label) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, e, c, [1], 2, "x", 3, 4, "y") for i, e, c in rows], VEC).repartition(3)


def whole(e):
    return e is not None and all(x is not None and math.isfinite(x) for x in e)


@pytest.fixture(scope="module")
def mixed():
    random = Random(11)
    vector = lambda scale=1.0: [random.gauss(0, scale) for _ in range(32)]
    rows = [(k, vector(random.choice([0.01, 0.1, 0.3, 1.0])), k % 4) for k in range(300)]
    hot = vector()
    rows += [(400 + k, list(hot), None if k % 2 else 9) for k in range(150)]  # a third of all rows are copies
    rows += [(600, None, 1), (601, [float("nan")] + vector()[1:], 1), (602, [None] + vector()[1:], 2), (603, [float("inf")] + vector()[1:], 2), (620, vector()[:20], None), (640, [], 3), (660, [0.0] * 32, 3)]
    rows += [(20, list(rows[20][1]), 0), (40, vector(), 1), (None, vector(), 1), (None, None, None), (-40, vector(5.0), None)]
    return rows


def plain_codes(rows, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in e], c) for i, e, c in rows if whole(e)]
    width = -(-max(len(v) for _, v, _ in kept) // 16)
    kept = [(i, v + [0] * (16 * width - len(v)), c, len(v)) for i, v, c in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1][: r[3]]))[:entries]
    books = [[cut(v, p) for _, v, _, _ in first] for p in range(16)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(16):
            groups = {}
            for _, v, _, _ in kept:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(col) // len(groups[e]) for col in zip(*groups[e], strict=True)] if e in groups else c for e, c in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    out = []
    for i, v, c, _ in kept:
        found = [near(cut(v, p), books[p]) for p in range(16)]
        out.append((i, c, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    by = {}
    for _, c, _, error in out:
        by[c] = by.get(c, 0) + error
    return sorted(((i if i is not None else 10**9, code, error, by[c], digest) for i, c, code, error in out))


def test_codes(spark, mixed):
    got = vector_codes.compress(vectors_of(spark, mixed))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((10**9 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == plain_codes(mixed)


def test_codes_of_many_labels(spark, mixed, monkeypatch):
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 2)  # labels are joined by an exchange
    got = vector_codes.compress(vectors_of(spark, mixed))
    assert sorted((10**9 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == plain_codes(mixed)


def test_codes_of_few_rows(spark, mixed):
    few = [(3, [0.5] * 17, 1), (1, [0.25] * 17, 1), (3, [0.5] * 17, None)]
    assert sorted(tuple(r) for r in vector_codes.compress(vectors_of(spark, few)).collect()) == plain_codes(few)
    assert vector_codes.compress(vectors_of(spark, few).where("false")).count() == 0
    assert vector_codes.compress(vectors_of(spark, [(1, None, 1)])).count() == 0
    assert [r.error for r in vector_codes.compress(vectors_of(spark, [(1, [], 1)])).collect()] == [0]
    with pytest.raises(ValueError, match="limit"):
        vector_codes.compress(vectors_of(spark, [(1, [1e30], 1)]))


@pytest.mark.parametrize("width,spread", [(1, 2), (2, 3), (4, 400), (7, 5)])
def test_nearest_of_all(width, spread):
    random = np.random.default_rng(width)
    x, book = random.integers(-spread, spread, (500, width)), random.integers(-spread, spread, (40, width))
    book[7] = book[3]  # ties go to the lower index
    d = ((x[:, None] - book) ** 2).sum(axis=2)
    at, error = vector_codes.nearest(x, book)
    assert (at == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()


def test_nearest_drops_entries(monkeypatch):
    """After the first dimension only entries within the leader's whole distance are looked at."""
    book = np.array([[k * 1000, k] for k in range(64)], np.int64)
    x = book[[5, 9]] + 1
    seen, plain = [], vector_codes._leaders
    monkeypatch.setattr(vector_codes, "_leaders", lambda row, so_far: seen.append(len(row)) or plain(row, so_far))
    assert vector_codes.nearest(x, book)[0].tolist() == [5, 9] and seen == [2]


def plain_search(rows, every=20, top=20, scale=64):
    kept = [(n, i, [math.floor(scale * x) for x in e]) for n, (i, e, _) in enumerate(rows) if whole(e)]
    out = []
    for n, i, q in kept:
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j is None, j or 0) for m, j, v in kept if m != n)
        out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(scored[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("group,slice_", [(1 << 20, 1 << 16), (900, 100), (33, 33)])
def test_search(spark, mixed, group, slice_):
    got = norm_search.search(vectors_of(spark, mixed), group=group, slice_=slice_)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search(mixed)


@pytest.mark.parametrize("marks", [1024, 3])
def test_search_with_empty_groups(spark, monkeypatch, marks):
    """More groups than lengths: some hold no rows, and the last that a query needs is found by number."""
    monkeypatch.setattr(norm_search, "MARKS", marks)
    monkeypatch.setattr(norm_search, "SEED", 0)
    random = Random(3)
    rows = [(k, [random.choice([-1.0, 1.0]) * random.choice([0.5, 0.5, 4.0]) for _ in range(6)], 0) for k in range(140)] + [(200 + k, [8.0] * 6, 0) for k in range(60)]
    got = norm_search.search(vectors_of(spark, rows), group=12, slice_=24)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search(rows)


def test_search_of_few_and_of_large(spark, mixed):
    few = [(20, [1.0, 2.0], 1), (21, [0.5], 1), (40, [-1.0, -1.0], 1)]
    run = lambda rows, **k: sorted((tuple(r) for r in norm_search.search(vectors_of(spark, rows), **k).collect()), key=repr)
    assert run(few) == plain_search(few) and run([]) == [] and run([(20, [1.0], 1)]) == []
    large = [(i, [x * 5e5 for x in e] if whole(e) else e, c) for i, e, c in mixed[::3]]  # beyond what doubles multiply exactly
    assert run(large, group=2000) == plain_search(large)
    with pytest.raises(ValueError, match="range of long"):
        norm_search.search(vectors_of(spark, [(20, [1e30], 1)]))


def test_search_prunes_only_what_cannot_win():
    random = np.random.default_rng(5)
    centres = random.normal(size=(12, 24))
    p = np.repeat(centres, 40, axis=0) + random.normal(size=(480, 24)) * 0.05
    p = np.floor(p * 64)
    lengths = np.sqrt((p**2).sum(axis=1))
    unit = (p / lengths[:, None]).T
    for k in range(0, 480, 17):
        q = p[k] / lengths[k]
        cosines = unit.T @ q
        for bound in (0.3, 0.8, 0.95, 1.0):
            at = norm_search.near_coordinates(unit, q, bound)
            assert set(np.flatnonzero(cosines >= bound)) <= set(at)
            assert bound < 0.9 or len(at) < 240  # coordinates of other clusters are dropped


def test_search_by_either_rule(monkeypatch):
    """Buckets of near directions are pruned by coordinates, others by length, and long thresholds drop a bucket whole."""
    seen, by_axis = [], norm_search.near_coordinates
    monkeypatch.setattr(norm_search, "near_coordinates", lambda *a: seen.append(a[2]) or by_axis(*a))
    p = np.array([[64.0, 0], [63, 3], [0, 64], [1, 2]])
    bucket = (p, np.sqrt((p**2).sum(axis=1)), np.arange(4), np.arange(4) * 10)
    q = np.array([[64.0, 0], [64, 0], [64, 0]])
    best = norm_search.Best(np.array([4000, 10, 5000]), 2)
    norm_search.meet(bucket, (q, np.full(3, 64.0), np.full(3, -1)), best)
    assert [list(map(int, i)) for _, i in best.found] == [[0, 10], [0, 10], []] and len(seen) == 1
    assert best.least.tolist() == [4032, 4032, 5000]
