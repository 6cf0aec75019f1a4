"""CSV texts by document, the JSON of results, and what the readings differ in."""

import csv
import io
import json
import os

import pytest
from ledgerspark.functions.numbers import amount, number_text
from ledgerspark.functions.text import route, similarity
from ledgerspark.operators import invoice, lines, matching, rows
from ledgerspark.plans.process import envelope, extract_text, process_documents
from ledgerspark.sources import store
from pyspark.sql import functions as F

CELL = "doc_id string, period_ord int, period string, field_ord int, field string, value string"
DOC = "doc_id string, document_type string, text string"


def test_csv_of_each_document(spark, tmp_path):
    cells = [("a", 1, "March, 2024", 2, "x", "1"), ("a", 2, 'the "last"', 2, "x", None), ("a", 1, "March, 2024", 1, "y", "two\nlines"), ("b", 1, "Current", 1, "only", "7"), ("c", 1, "P", 1, None, None)]
    df = spark.createDataFrame(cells, CELL)
    got = {r.doc_id: r.csv for r in matching.csv_texts(df).collect()}
    assert list(csv.reader(io.StringIO(got["a"]))) == [["Field", "March, 2024", 'the "last"'], ["y", "two\nlines", ""], ["x", "1", ""]]
    assert got["b"] == "Field,Current\nonly,7"
    assert {r.doc_id: r.csv for r in matching.csv_texts(df.where("doc_id = 'a'"), "compat").collect()} == {"a": 'Field,March, 2024,the "last"\ny,two\nlines,\nx,1,'}
    store.write_csv_per_document(matching.csv_texts(df.where("field IS NOT NULL")), f"file://{tmp_path}/csv")
    made = {d: [f for f in os.listdir(tmp_path / "csv" / d) if f.endswith(".txt")] for d in os.listdir(tmp_path / "csv") if d.startswith("doc_id=")}
    assert {d: len(f) for d, f in made.items()} == {"doc_id=a": 1, "doc_id=b": 1}
    assert (tmp_path / "csv/doc_id=b" / made["doc_id=b"][0]).read_text() == "Field,Current\nonly,7\n"
    assert matching.csv_texts(df.where("false")).count() == 0


def test_json_of_results(spark):
    docs = spark.createDataFrame([("bill", "Invoice", "Invoice #: A-7\nCable box 2 3.00 6.00\nSubtotal: $ 6.00\nTotal Amount: $ 9.00"), ("none", "Invoice", "")], DOC)
    got = {r.doc_id: json.loads(r.result_json) for r in envelope(process_documents(docs)).collect()}
    bill, none = got["bill"], got["none"]
    assert set(bill) == {"document_name", "document_type", "processing_status", "overall_confidence", "extracted_data", "line_items", "rows", "comparative_periods", "validation"} == set(none)
    assert bill["extracted_data"]["invoice_number"]["text"] == "A-7" and bill["extracted_data"]["total_amount"]["number"] == 9.0 and bill["extracted_data"]["vendor_name"]["text"] is None
    assert bill["line_items"] == [{"description": "Cable box", "quantity": 2.0, "unit_price": 3.0, "amount": 6.0}]
    assert bill["validation"]["overall_status"] == "FAIL" and bill["processing_status"] == "FAILED" and len(bill["validation"]["issues"]) == 1
    assert none["extracted_data"] is None and none["processing_status"] == "FAILED" and none["validation"]["checks"] is None


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


@pytest.mark.parametrize("mode", ["documented", "compat"])
class TestReadings:
    """What is meant, and what the original conventions literally give."""

    def values(self, spark, text, mode):
        x = rows.with_values(lines.page_lines(spark.createDataFrame([(1, text)], "doc_id int, text string")), mode)
        return x.first()

    def test_columns_of_plain_years(self, spark, mode):
        text = "2024  2023\nTotal Assets  5.00  4.00"
        got = {r.period: r.value for r in extract_text(spark.createDataFrame([("d", "Balance Sheet", text)], DOC), ["total assets"], mode).collect()}
        assert got == ({"2024": "5.00", "2023": "4.00"} if mode == "documented" else {"2023": "5.00", "2024": "4.00"})  # whole numbers come first, ascending

    def test_income_statement_route(self, one, mode):
        assert one.select(route(F.lit("Income Statement"), mode)).first()[0] == ("profit_and_loss" if mode == "documented" else "invoice")

    def test_defaults_and_their_evidence(self, spark, mode):
        d = invoice.extract(lines.page_lines(spark.createDataFrame([(1, "Total Amount: $ 9.00")], "doc_id int, text string")), mode).first()
        assert d.tax_amount.value == 0.0 and d.tax_amount.is_default and d.tax_amount.source_text == (None if mode == "documented" else "0.0")

    def test_text_fields(self, spark, mode):
        got = extract_text(spark.createDataFrame([("d", "Invoice", "Invoice Number  INV-99\nTotal  5.00")], DOC), ["invoice number"], mode).first()
        assert got.value == ("INV-99" if mode == "documented" else None)

    def test_repeated_pairs_count_each_time(self, one, mode):
        assert one.select(similarity(F.lit("aa"), F.lit("aaaa"))).first()[0] == 3.0

    def test_lakh_grouping(self, spark, one, mode):
        want = [123456.0] if mode == "documented" else [1.0, 23456.0]
        assert self.values(spark, "Reserves 1,23,456", mode)["values"] == want
        assert one.select(amount(F.lit("1,23,456"), mode), number_text(F.lit("1,23,456"), mode)).first()[:] == (123456.0, "123456" if mode == "documented" else None)

    def test_minus_in_parentheses(self, one, mode):
        assert one.select(amount(F.lit("(-500)"), mode)).first()[0] == (-500.0 if mode == "documented" else 500.0)

    def test_line_of_dates(self, spark, mode):
        x = rows.rows(lines.page_lines(spark.createDataFrame([(1, "Particulars 31-Mar-24 31-Mar-23")], "doc_id int, text string")), mode)
        assert x.count() == (0 if mode == "documented" else 1)

    def test_odd_numbers(self, one, mode):
        got = one.select(*(amount(F.lit(t), mode) for t in ("1.0d", "5f", "Infinity", "1e5")), *(number_text(F.lit(t), mode) for t in ("Infinity", "0x1F", "1e5"))).first()
        assert got[:4] == (1.0, 5.0, None, 15.0)  # letters go first
        assert got[4:] == ((None, None, "1e5") if mode == "documented" else ("Infinity", "0x1F", "1e5"))

    def test_missing_operating_total(self, spark, mode):
        text = "Net cash used in investing activities (20.00)\nNet cash used in financing activities (10.00)\nNet increase in cash 31.00"
        got = process_documents(spark.createDataFrame([("d", "Cash Flow", text)], DOC), mode).first()
        assert {c.name: c.status for c in got.checks}["cash_reconciliation_check"] == "NOT_APPLICABLE"

    def test_names_inside_longer_labels(self, spark, mode):
        x = rows.rows(lines.page_lines(spark.createDataFrame([(1, "Total liabilities and equity 9.00\nTotal liabilities 4.00")], "doc_id int, text string")), mode)
        assert rows.find_row(x, {"total_liabilities": ["total liabilities"]}).first().total_liabilities.value == 9.0

    def test_unbalanced_parenthesis(self, spark, mode):
        assert self.values(spark, "Loss on sale (500", mode)["label"] == "Loss on sale"
