"""The ledger: batches count once, ids and first times survive, a lookup skips files; the landing stream, also when it runs a batch again."""

import os
from random import Random

import pytest
from ledgerspark.sources import ledger, shared
from ledgerspark.streaming.landing import watch
from pyspark.sql import functions as F

ROW = "document_name string, document_type string, processing_status string, confidence double, result_json string, t long, seq long"


def results(spark, rows):
    """Rows of (name, time, seq, text)."""
    x = spark.createDataFrame([(n, "Invoice", "PASS", 0.5, text, t, seq) for n, t, seq, text in rows], ROW)
    return x.withColumn("updated_at", F.timestamp_seconds("t")).drop("t")


def state(df):
    return {r.document_name: (r.result_json, r.batch, int(r.updated_at.timestamp()), int(r.created_at.timestamp()), r.id) for r in df.collect()}


@pytest.fixture()
def path(spark):
    return shared.shared_path(spark, "ledger-test")


def test_a_batch_counts_once(spark, path, monkeypatch):
    one, two = results(spark, [("a", 10, 0, "a1"), ("b", 11, 1, "b1"), (None, 1, 2, "x")]), results(spark, [("a", 20, 0, "a2"), ("c", 21, 1, "c1")])
    assert state(ledger.latest(spark, path)) == {} and ledger.compact(spark, path) == 0
    assert ledger.commit(one, path, 0) and not ledger.commit(two, path, 0)
    before = state(ledger.latest(spark, path))
    assert {k: v[0] for k, v in before.items()} == {"a": "a1", "b": "b1"}

    def killed(*_):
        raise InterruptedError

    with monkeypatch.context() as m:  # stopped between its files and its commit
        m.setattr(shared, "mark", killed)
        with pytest.raises(InterruptedError):
            ledger.commit(two, path, 1)
    assert state(ledger.latest(spark, path)) == before
    assert ledger.commit(two, path, 1) and not ledger.commit(two, path, 1)
    after = state(ledger.latest(spark, path))
    assert {k: v[:4] for k, v in after.items()} == {"a": ("a2", 1, 20, 10), "b": ("b1", 0, 11, 11), "c": ("c1", 1, 21, 21)}
    assert after["a"][4] == before["a"][4] and len({v[4] for v in after.values()}) == 3
    assert ledger.compact(spark, path) == 1 and ledger.compact(spark, path) == 1
    assert state(ledger.latest(spark, path)) == after
    assert ledger.commit(results(spark, [("a", 5, 0, "late"), ("b", 30, 0, "b2"), ("b", 30, 1, "b3")]), path, 2)
    assert {k: v[:4] for k, v in state(ledger.latest(spark, path)).items()} == {"a": ("a2", 1, 20, 5), "b": ("b3", 2, 30, 11), "c": ("c1", 1, 21, 21)}


def test_a_view_that_is_cut_short(spark, path, monkeypatch):
    ledger.commit(results(spark, [("a", 1, 0, "a1")]), path, 0)
    ledger.compact(spark, path)
    ledger.commit(results(spark, [("a", 2, 0, "a2")]), path, 1)
    with monkeypatch.context() as m:
        m.setattr(shared, "put", lambda *_: (_ for _ in ()).throw(InterruptedError))
        with pytest.raises(InterruptedError):
            ledger.compact(spark, path)
    assert state(ledger.latest(spark, path))["a"][0] == "a2" and ledger.view(spark, path)["version"] == 1
    assert ledger.compact(spark, path) == 2 and state(ledger.latest(spark, path))["a"][0] == "a2"
    with pytest.raises(FileExistsError):
        shared.put(spark, f"{path}/views/{2:020d}.json", "another")


def test_many_batches_against_a_dictionary(spark, path):
    random, want = Random(1), {}
    for batch in range(6):
        rows = [(f"d{random.randint(0, 40)}", random.randint(0, 50), k, f"{batch}-{k}") for k in range(30)]
        ledger.commit(results(spark, rows), path, batch)
        for n, t, seq, text in rows:
            key, first = want.get(n, ((-1,), t))
            want[n] = max(key, (t, batch, seq, text)), min(first, t)
        if batch % 2:
            ledger.compact(spark, path)
            assert len(ledger.view(spark, path)["folders"]) <= ledger.BUCKETS
        assert {k: (v[2], v[1], v[0], v[3]) for k, v in state(ledger.latest(spark, path)).items()} == {n: (k[0], k[1], k[3], first) for n, (k, first) in want.items()}
    assert [r.document_name for r in ledger.recent(spark, path, 3).collect()] == [n for n, _ in sorted(want.items(), key=lambda x: [-v for v in x[1][0][:3]] + [x[0]])[:3]]


def test_a_lookup_skips_files(spark, path):
    n = 500
    ledger.commit(results(spark, [(f"doc {k}", k, 0, "x" * 50) for k in range(n)]), path, 0)
    ledger.compact(spark, path)
    ledger.commit(results(spark, [(f"doc {k}", n + k, 0, "y") for k in range(100)]), path, 1)
    whole, one = ledger.latest(spark, path), ledger.latest(spark, path, "doc 7")
    assert state(one) == {"doc 7": state(whole)["doc 7"]}
    read = lambda df: sum(int(x) for x in _files_read(df))
    assert read(one) <= 2 < 40 < read(whole)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(document_name,doc 7)" in plan and "PartitionFilters: [isnotnull(bucket" in plan
    assert ledger.latest(spark, path, "nobody").count() == 0


def _files_read(df):
    """The files of all scans of a plan that ran."""
    df.collect()
    nodes, out = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            nodes.append(node.plan())
            continue
        if kind == "FileSourceScanExec":
            out.append(node.metrics().apply("numFiles").value())
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
    return out


def test_landing_stream(spark, tmp_path):
    sheet = "Balance sheet\nTotal Assets 933.75\nTotal Liabilities 433.50\nTotal Equity 500.25"
    (tmp_path / "in").mkdir()
    log = f"file://{tmp_path}/log"
    run = lambda: watch(spark, f"file://{tmp_path}/in", "Balance Sheet", log, f"file://{tmp_path}/state").awaitTermination()
    (tmp_path / "in/a.txt").write_text(sheet)
    run()
    (tmp_path / "in/b.txt").write_text("no figures here")
    run()
    run()  # nothing new
    got = lambda: sorted((r.document_name, r.processing_status, r.batch, r.seq) for r in ledger.latest(spark, log).collect())
    assert got() == [("a.txt", "PASS", 0, 1), ("b.txt", "FAILED", 1, 1)]
    assert '"total_assets"' in ledger.latest(spark, log, "a.txt").first().result_json
    # stopped after the rows were committed and before the stream noted it: the batch runs again and changes nothing
    files = set(os.listdir(tmp_path / "log/data"))
    for f in ("1", ".1.crc"):
        (tmp_path / "state/commits" / f).unlink(missing_ok=True)
    run()
    assert got() == [("a.txt", "PASS", 0, 1), ("b.txt", "FAILED", 1, 1)] and set(os.listdir(tmp_path / "log/data")) == files
    # stopped before the rows were committed: they are written now
    for f in ("1", ".1.crc"):
        (tmp_path / "state/commits" / f).unlink(missing_ok=True)
    for f in os.listdir(tmp_path / "log/commits"):
        if f.lstrip(".").startswith(f"{1:020d}"):
            (tmp_path / "log/commits" / f).unlink()
    assert got() == [("a.txt", "PASS", 0, 1)]
    run()
    assert got() == [("a.txt", "PASS", 0, 1), ("b.txt", "FAILED", 1, 1)]
