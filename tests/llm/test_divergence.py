"""The divergence audit against a plain version: hot groups, groups without terms, nulls, repeats, many blocks and seats."""

from collections import Counter
from random import Random

import pytest
from ledgerspark.llm import divergence

DOC = "doc_id long, text string, lang string, source string, term string, n long, docs long, seat int, block int, value long, number int, top string"


def docs_of(spark, rows):
    """Rows of (text, lang, source) with further columns whose names the operator uses inside."""
    return spark.createDataFrame([(k, *r, "t", 1, 2, 3, 4, 5, 6, "x") for k, r in enumerate(rows)], DOC).repartition(3)


@pytest.fixture(scope="module")
def mixed():
    random = Random(2)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["Éte", "été", "ÉTÉ", "日本", "don't", "x9y", "ABC", "abc"]
    text = lambda lean: " ".join(random.choice(words[lean::3] if random.random() < 0.6 else words) for _ in range(random.randint(0, 80)))
    rows = [(text(k % 3), "en", f"s{k % 11}" if k % 3 else "hot") for k in range(500)]
    rows += [(text(1), "fr", "abc"[k % 3]) for k in range(90)] + [(text(0), "de", "only") for _ in range(40)]
    rows += [("rare words", "it", "a"), ("others", "it", "b"), ("", "it", "c"), (None, "en", "empty"), ("", "en", "void"), ("1 2 3 ,;", "en", "digits"), (None, None, None), (text(2), None, "s1"), (text(2), "", "s1"), (text(2), "en", None), ("a" * 30000 + " " + "wab " * 20000, "en", "long")]
    rows += [rows[7]] * 40
    return rows


def terms_of(text):
    out, now = [], ""
    for c in (text or "") + " ":
        if "A" <= c <= "Z":
            now += chr(ord(c) + 32)
        elif "a" <= c <= "z" or ord(c) > 127:
            now += c
        elif now:
            out.append(now)
            now = ""
    return out


def plain(rows):
    docs = [(terms_of(t), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {d[1] for d in docs}:
        mine = [d for d in docs if d[1] == lang]
        seen = Counter(t for d in mine for t in set(d[0]))
        kept = sorted(t for t, n in seen.items() if n >= 30)
        counts = {s: Counter(t for d in mine if d[2] == s for t in d[0] if seen[t] >= 30) for s in {d[2] for d in mine}}
        total = Counter(t for d in mine for t in d[0] if seen[t] >= 30)

        def share(c):
            n = sum(c.values()) + 5 * len(kept)
            return {t: 1 + 1000000000 * (c[t] + 5) // n for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(total)
        for s in counts:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:50]
            out += [(lang, s, part, item.decode(), -v, r) for part, some in (("pair", pairs), ("term", terms)) for r, (v, item) in enumerate(some, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,seats", [(1 << 14, 8), (7, 3), (40, 1), (1, 2)])
def test_audit(spark, mixed, monkeypatch, block, seats):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "SEATS", seats)
    got = divergence.audit(docs_of(spark, mixed))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain(mixed)


def test_audit_of_little(spark, mixed):
    docs = docs_of(spark, mixed)
    assert divergence.audit(docs.where("false")).count() == 0
    one = divergence.audit(docs.where("lang = 'it'")).collect()
    assert sorted(tuple(r) for r in one) == plain([r for r in mixed if r[1] == "it"]) and {r.value for r in one} == {0}


def test_terms_in_pieces(monkeypatch):
    text = ("Ab cé,日本 x1y" * 50 + " " + "z" * 400 + ".").encode()
    whole = [w for ws in divergence.words(text) for w in ws]
    assert [w.decode() for w in whole] == terms_of(text.decode())
    for piece in (1, 2, 7, 64):
        monkeypatch.setattr(divergence, "PIECE", piece)
        assert [w for ws in divergence.words(text) for w in ws] == whole


def test_shares_of_huge_counts():
    import numpy as np

    n = np.array([0, 3, 10**13], np.int64)
    assert divergence.share(n, 10**13 + 3, 3).tolist() == [1 + 10**9 * (x + 5) // (10**13 + 18) for x in (0, 3, 10**13)]


def test_hosts_stay_in_their_buckets(spark, mixed):
    """A round exchanges the guests' vectors only."""
    docs = docs_of(spark, mixed)
    packed, _ = divergence._vectors(divergence.term_counts(docs))
    packed.repartition(4, "lang", "seat", "block").write.format("parquet").bucketBy(4, "lang", "seat", "block").saveAsTable("vectors_of_test")
    v = spark.table("vectors_of_test").where("seats > 1")
    met = v.where("seat = 1").groupBy("lang", "seat", "block").cogroup(v.where("seat = 0").withColumn("seat", v["seat"] + 1).groupBy("lang", "seat", "block")).applyInArrow(divergence._meeting, "lang string, a string, b string, value long")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    spark.sql("DROP TABLE vectors_of_test")


def test_a_pair_has_one_name_in_all_blocks():
    """Groups that share a seat may stand in another order in each block; a pair's parts are added up all the same."""
    import numpy as np
    import pyarrow as pa

    def block(order, shares):
        vec = [divergence.pack(np.arange(2), np.array(shares[s])) for s in order]
        return pa.table({"lang": ["en"] * len(order), "source": order, "width": pa.array([2] * len(order), pa.int32()), "none": pa.array([1] * len(order), pa.int32()), "vec": vec})

    shares = {"a": [5, 7], "b": [9, 9], "c": [1, 2]}
    want = {("a", "b"): 6, ("a", "c"): 9, ("b", "c"): 15}
    for order in (["a", "b", "c"], ["c", "a", "b"], ["b", "c", "a"]):
        hosts = block(order, shares)
        got = divergence._meeting(hosts, hosts.slice(0, 0)).to_pylist()
        assert {(r["a"], r["b"]): r["value"] for r in got} == want


def test_many_blocks_without_coalescing(spark, mixed, monkeypatch):
    """Shuffles that are not put together again bring the groups of a seat in another order in each block."""
    monkeypatch.setattr(divergence, "BLOCK", 7)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert sorted(tuple(r) for r in divergence.audit(docs_of(spark, mixed)).collect()) == plain(mixed)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
