"""Cases with known results: checks, fragmented statements, invoices, admission, numbers, the queue."""

from collections import deque
from random import Random

import pytest
from ledgerspark.functions.numbers import amount, number_text
from ledgerspark.operators import checks, rows
from ledgerspark.plans.process import process_documents
from ledgerspark.sources.admission import admit
from ledgerspark.sources.files import best_reading
from ledgerspark.sources.store import latest
from pyspark.sql import functions as F

DOC = "doc_id string, document_type string, text string"
#: Labels and values on lines of their own, as scans of two columns often give them.
CASH = ["Net cash flow from / (used in) operating activities", "61,204,118", "Net cash flow from / (used in) investing activities", "(9,480,300)", "Net cash flow from / (used in) financing activities", "(20,115,006)", "Effect of exchange rate movements on cash held", "(702,919)", "Net increase / (decrease) in cash and cash equivalents", "30,905,893", "Cash and cash equivalents as at April 1st", "12,000,107", "Cash and cash equivalents as at March 31st", "42,906,000"]
BILL = ["Invoice#: 40-17", "Subtotal $210.00", "Sales Tax 5% $10.50", "Shipping and Handling $8.25", "Total Due", "$228.75"]


def numbers(row):
    return {f.name: f.number for f in row.fields}


def test_whole_flow(spark):
    docs = spark.createDataFrame([("cash", "Cash Flow", "\n".join(CASH)), ("bill", "Invoice", "\n".join(BILL)), ("none", "Invoice", None), ("blank", "Balance Sheet", " \n "), ("memo", None, "just words")], DOC)
    got = {r.doc_id: r for r in process_documents(docs).collect()}
    assert len(got) == 5
    cash, bill = got["cash"], got["bill"]
    assert numbers(cash)["operating_cash_flow"] == 61204118.0 and numbers(cash)["closing_cash"] == 42906000.0
    assert not [c for c in cash.checks if c.status == "FAIL"]
    assert (numbers(bill)["tax_amount"], numbers(bill)["shipping_and_handling"], numbers(bill)["total_amount"]) == (10.5, 8.25, 228.75)
    assert bill.overall_status == "PASS" and bill.processing_status == "PASS"
    assert got["none"].error_code == got["blank"].error_code == "EXTRACTION_FAILED"
    assert 0 < bill.overall_confidence <= 1


@pytest.mark.parametrize("values,status,variance", [((700.0, 84.0, 0.0, 20.0, 764.0), "PASS", 0.0), ((700.0, 84.0, 0.0, 20.0, 765.5), "FAIL", 1.5), ((310.0, 24.8, 15.0, 0.0, 350.4), "PASS_WITH_TOLERANCE", 0.6), ((None, 1.0, 0.0, 0.0, 5.0), "NOT_APPLICABLE", None)])
def test_invoice_total(spark, values, status, variance):
    c = spark.range(1).select(checks.invoice_total(*(F.lit(v).cast("double") for v in values)).alias("c")).first().c
    assert (c.status, c.variance) == (status, variance)


def test_matching_adjustment(spark):
    x = spark.createDataFrame([(10.0, 17.0, [4.0, 5.0, 2.0]), (10.0, 10.0, [4.0]), (10.0, 99.0, [4.0]), (1.0, 2.0, [])], "b double, n double, a array<double>")
    got = [r[0] for r in x.select(checks.matching_adjustment(F.col("b"), F.col("n"), F.col("a"))).collect()]
    assert got == [7.0, 0.0, 0.0, 0.0]


def test_numbers(spark):
    cases = [("(1,234.50)", -1234.5, "-1234.50"), ("₹1,234", 1234.0, "1234"), ("$ 500.00", 500.0, "500.00"), ("15.5%", None, "15.5"), ("5 Cr", 5.0, "5"), ("-", None, None), ("N/A", None, None), ("1,23,456", 123456.0, "123456"), ("(-500)", -500.0, None), ("", None, None), (None, None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, t string").select("i", amount(F.col("t")), number_text(F.col("t"))).orderBy("i")
    assert [tuple(r)[1:] for r in df.collect()] == [c[1:] for c in cases]
    assert spark.range(1).select(amount(F.lit("(-500)"), "compat")).first()[0] == 500.0


def test_queue_against_a_deque(spark):
    random, events, want = Random(5), [], set()
    for key in range(40):
        queue = deque()
        for at in range(30):
            kind = random.choice(["push", "pop", "pop", "none"])
            events.append((key, at, kind))
            if kind == "push":
                queue.append(at)
            elif kind == "pop" and queue:
                want.add((key, queue.popleft(), at))
    got = rows.fifo_pairs(spark.createDataFrame(events, "k int, o int, kind string"), "k", "o", "kind")
    assert {tuple(r) for r in got.collect()} == want


def test_admission(spark):
    files = [("malware.exe", "application/octet-stream", 5, 1), ("empty.pdf", "application/pdf", 0, 1), ("a.pdf", None, 9, 2), ("big.png", "image/png", 11 << 20, 1), ("long.pdf", "application/pdf", 9, 4), ("x.png", "image/jpeg", 9, 1)]
    got = admit(spark.createDataFrame(files, "file_name string, content_type string, length long, page_count int")).collect()
    assert [r.error_code for r in got] == ["UNSUPPORTED_FILE_TYPE", "INVALID_FILE_ERROR", None, "INVALID_FILE_ERROR", "INVALID_FILE_ERROR", "INVALID_FILE_ERROR"]


def test_readings_and_log(spark):
    readings = spark.createDataFrame([("f", 1, 0, "total"), ("f", 1, 1, "x" * 100), ("f", 1, 2, "Total")], "file_name string, page_number int, ord int, text string")
    assert best_reading(readings).first().text == "total"
    log = spark.createDataFrame([("a", 1, 1, "old"), ("a", 1, 2, "new"), ("b", 0, 3, "b")], "document_name string, updated_at int, seq int, v string")
    assert {(r.document_name, r.v, r.created_at) for r in latest(log).collect()} == {("a", "new", 1), ("b", "b", 0)}
