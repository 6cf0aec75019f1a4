"""What the token stage holds beside its ids: small Arrow batches, and no encoder while ids are read back."""

import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from ledgerspark.llm import common, token_orc

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def bound(spark):
    spark.conf.unset(KEY)
    yield
    spark.conf.unset(KEY)


def largest(spark):
    """Bytes of the largest batch of ids that a worker gets."""
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())}) for b in batches)
    return max(r.n for r in spark.range(0, 8000, 1, 1).selectExpr("id", "sequence(1, 500) AS ids").mapInArrow(sizes, "n long").collect())


def test_batches_of_the_token_stage_are_small(spark, bound):
    assert largest(spark) > 15 << 20
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    assert token_orc.token_report(docs).count() == 2
    assert largest(spark) < common.BATCH_BYTES * 1.1


def test_all_stages_have_small_batches(spark, bound):
    corpus_pipeline.quality_rules(spark, spark.createDataFrame([(1, "some words")], "doc_id long, text string"), "")
    assert largest(spark) < common.BATCH_BYTES * 1.1


def test_a_smaller_bound_of_the_session_stays(spark, bound):
    for given, want in (("1048576", "1048576"), ("1048576b", "1048576b"), ("1g", str(common.BATCH_BYTES))):
        spark.conf.set(KEY, given)
        common.small_batches(spark)
        assert spark.conf.get(KEY) == want


def test_the_encoder_goes_before_ids_are_read():
    token_orc.encoder(token_orc.VOCABULARY)
    ids = pa.ListArray.from_arrays(pa.array([0, 2, 2, 3], "int32"), pa.array([5, 70_000, 1], "int32"))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "start": [0, 2, 2], "n_tokens": [2, 0, 1], "ids": ids})
    (out,) = token_orc.crc_of_ids(iter([batch]))
    assert not any("token_orc" in str(k) for k in common._resident)
    assert out["ids_crc32"].to_pylist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ([5, 70_000], [], [1])]
    sliced = next(token_orc.crc_of_ids(iter([batch.slice(2)])))
    assert sliced["ids_crc32"].to_pylist() == [zlib.crc32(np.array([1], "<u4").tobytes())]
