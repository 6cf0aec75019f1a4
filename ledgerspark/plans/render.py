"""Financial documents rendered from the relational tables, so that reading them back can be checked.

Amounts are whole cents until they are printed. Each document is one group of a bounded key (an order, a
nation, a year, a user), so rendering is one aggregation.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("long")


def money(c: Column) -> Column:
    """Cents as text, negative amounts in parentheses."""
    a = F.abs(c)
    text = F.concat(F.floor(a / 100).cast("string"), F.lit("."), F.lpad((a % 100).cast("string"), 2, "0"))
    return F.when(c < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


def line(label: str, c: Column) -> Column:
    return F.concat(F.lit(f"{label} "), money(c))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, document_type, text): an invoice per order with lines; every third states the order's own total."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), cents(F.col("l_extendedprice")).alias("c"), cents(F.col("l_discount")).alias("d"), cents(F.col("l_tax")).alias("t"))
    item = item.join(part, item["l_partkey"] == part["p_partkey"])
    text = F.concat_ws(" ", "p_name", F.col("q").cast("string"), money(F.expr("c div q")), money(F.col("c")))
    per = item.withColumn("line", text).groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "c", "q", "line")))["line"].alias("items"),
        F.sum("c").alias("sub"), F.expr("(sum(c * d) + 50) div 100").alias("disc"), F.expr("(sum(c * (100 - d) * t) + 5000) div 10000").alias("tax"),
    )
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").join(per, F.col("o_orderkey") == F.col("l_orderkey"))
    total = F.when(F.col("o_orderkey") % 3 == 0, cents(F.col("o_totalprice"))).otherwise(F.col("sub") + F.col("tax") - F.col("disc"))
    head = [F.concat(F.lit("Invoice #: INV-"), F.col("o_orderkey").cast("string")), F.concat(F.lit("Date: "), F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit("Vendor: Ledger Supplies"), F.concat(F.lit("Bill To: Customer "), F.col("o_custkey").cast("string"))]
    foot = [line("Subtotal: $", F.col("sub")), line("Tax Amount: $", F.col("tax")), line("Discount: $", F.col("disc")), line("Total Amount: $", total)]
    return d.select(F.col("o_orderkey").alias("doc_id"), F.lit("Invoice").alias("document_type"), F.array_join(F.concat(F.array(*head), F.col("items"), F.array(*foot)), "\n").alias("text"))


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short bill per supplier, for the labelled-line reader."""
    c = cents(F.col("s_acctbal"))
    rows = [F.concat(F.lit("Invoice Number  B-"), F.col("s_suppkey").cast("string")), F.concat(F.lit("Subtotal  "), money(c)), F.concat(F.lit("Tax Amount  "), money(F.expr("floor(abs(s_acctbal))").cast("long"))), F.concat(F.lit("Total Due  "), money(c * 2))]
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit("Invoice").alias("document_type"), F.concat_ws("\n", *rows).alias("text"))


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, assets, liabilities, equity) in cents per nation; every fifth is out of balance by ten units."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum(cents(F.col("c_acctbal"))).alias("own"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum(cents(F.col("s_acctbal"))).alias("owed"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).join(c, "k", "left").join(s, "k", "left").fillna(0, ["own", "owed"])
    return n.select(F.col("k").alias("doc_id"), (F.col("own") + F.col("owed")).alias("assets"), F.col("owed").alias("liabilities"), (F.col("own") + F.when(F.col("k") % 5 == 0, 1000).otherwise(0)).alias("equity"))


def balance_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = balances(spark, sf_dir)
    rows = [F.lit("Balance sheet"), line("Total Assets", F.col("assets")), line("Total Liabilities", F.col("liabilities")), line("Total Equity", F.col("equity"))]
    return b.select("doc_id", F.lit("Balance Sheet").alias("document_type"), F.concat_ws("\n", *rows).alias("text"))


def two_period_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance sheets of two columns for the labelled-line reader; the older column is one unit less."""
    b = balances(spark, sf_dir)
    wide = lambda label, c: F.concat(F.lit(f"{label}  "), money(F.col(c)), F.lit("  "), money(F.col(c) - 100))
    rows = [F.lit("Particulars  31-Mar-24  31-Mar-23"), wide("Total Assets", "assets"), wide("Total Liabilities", "liabilities"), wide("Shareholders Equity", "equity")]
    return b.select("doc_id", F.lit("Balance Sheet").alias("document_type"), F.concat_ws("\n", *rows).alias("text"))


def income_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profit-and-loss statement per ship year; odd years overstate the operating profit by one unit."""
    x = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("y"), cents(F.col("l_extendedprice")).alias("c"), cents(F.col("l_discount")).alias("d"), cents(F.col("l_tax")).alias("t"))
    s = x.groupBy("y").agg(F.sum("c").alias("rev"), F.expr("(sum(c * d) + 50) div 100").alias("cos"), F.expr("(sum(c * t) + 50) div 100").alias("opex"))
    profit = F.col("rev") - F.col("cos") - F.col("opex") + F.when(F.col("y") % 2 == 1, 100).otherwise(0)
    rows = [line("Revenue from operations", F.col("rev")), line("Cost of sales", F.col("cos")), line("Gross profit", F.col("rev") - F.col("cos")), line("Operating expenses", F.col("opex")), line("Operating profit", profit)]
    return s.select(F.col("y").alias("doc_id"), F.lit("Profit and Loss").alias("document_type"), F.concat_ws("\n", *rows).alias("text"))


def cash_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cash-flow statement per user of events: even users report the exchange effect in the net change, every fifth does not add up."""
    value = cents(F.col("value"))
    sums = {"op": "purchase", "inv": "view", "fin": "click", "adj": "error"}
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(*(F.coalesce(F.sum(F.when(F.col("event_type") == k, value)), F.lit(0)).alias(n) for n, k in sums.items()))
    u, start = F.col("user_id"), F.lit(100_000) + F.col("user_id")
    net = F.col("op") - F.col("inv") + F.col("fin") + F.when(u % 2 == 0, F.col("adj")).otherwise(0) + F.when(u % 5 == 0, 77_777).otherwise(0)
    rows = [line("Net cash from operating activities", F.col("op")), line("Net cash used in investing activities", -F.col("inv")), line("Net cash from financing activities", F.col("fin")), line("Effect of exchange rate changes", F.col("adj")), line("Net increase in cash", net), line("Opening cash", start), line("Closing cash", start + net)]
    return s.select(u.alias("doc_id"), F.lit("Cash Flow").alias("document_type"), F.concat_ws("\n", *rows).alias("text"))


def pdf(texts: list[str], packed: bool = False) -> bytes:
    """A PDF of a page a text; packed: its objects in an object stream, found by a cross-reference stream."""
    n = len(texts)
    kids = " ".join(f"{3 + 2 * k} 0 R" for k in range(n))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Count {n} /Kids [{kids}] >>".encode()}
    streams = {}
    for k, text in enumerate(texts):
        body = zlib.compress(f"BT (page {k + 1}) Tj ET % {text}".encode())
        objects[3 + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * k} 0 R /MediaBox [0 0 595 842] >>".encode()
        streams[4 + 2 * k] = f"<< /Length {len(body)} /Filter /FlateDecode >>\nstream\n".encode() + body + b"\nendstream"
    out, places = bytearray(b"%PDF-1.5\n"), {}

    def add(number: int, body: bytes) -> None:
        places[number] = (1, len(out), 0)
        out.extend(b"%d 0 obj\n" % number + body + b"\nendobj\n")

    for number, body in streams.items():
        add(number, body)
    last = 3 + 2 * n
    if not packed:
        for number, body in objects.items():
            add(number, body)
        start = len(out)
        rows = "".join(f"{places[k][1]:010d} 00000 n \n" for k in range(1, last))
        out.extend(f"xref\n0 {last}\n0000000000 65535 f \n{rows}trailer\n<< /Size {last} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode())
        return bytes(out)
    head, bodies = "", b""
    for k, (number, body) in enumerate(objects.items()):
        head += f"{number} {len(bodies)} "
        bodies += body + b" "
        places[number] = (2, last, k)
    body = zlib.compress(head.encode() + bodies)
    add(last, f"<< /Type /ObjStm /N {len(objects)} /First {len(head)} /Length {len(body)} /Filter /FlateDecode >>\nstream\n".encode() + body + b"\nendstream")
    start = len(out)
    places[last + 1] = (1, start, 0)
    table, above = b"", bytes(7)
    for k in range(last + 2):
        kind, at, nth = places.get(k, (0, 0, 0))
        row = bytes([kind]) + at.to_bytes(4, "big") + nth.to_bytes(2, "big")
        table += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True))
        above = row
    body = zlib.compress(table)
    out.extend(f"{last + 1} 0 obj\n<< /Type /XRef /Size {last + 2} /W [1 4 2] /Root 1 0 R /Length {len(body)} /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >> >>\nstream\n".encode() + body + f"\nendstream\nendobj\nstartxref\n{start}\n%%EOF\n".encode())
    return bytes(out)


def png(text: str) -> bytes:
    """A grey PNG of one row, its pixels the text's bytes."""
    row = text.encode() or b"\x00"
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(row), 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\x00" + row)) + chunk(b"IEND", b"")


def jpeg(text: str) -> bytes:
    """The segments of a JPEG: a comment, a frame, and a scan of the text's bytes with stuffed bytes and restarts."""
    part = lambda mark, body: bytes([255, mark]) + struct.pack(">H", 2 + len(body)) + body
    scan = text.encode()[:100_000].replace(b"e", b"\xff\x00").replace(b"o", b"\xff\xd3")
    return b"\xff\xd8" + part(0xFE, text.encode()[:1000]) + part(0xC0, b"\x08\x00\x01\x00\x01\x01\x01\x11\x00") + part(0xDA, b"\x01\x01\x00\x00\x3f\x00") + scan + b"\xff\xd9"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file_name, content_type, length, content): each document as a PDF of none to four pages, packed or plain, a PNG or a
    JPEG; of every seventh the second half is gone, and in every fifth PNG a byte is changed."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            ids, names, made = b.column(0).to_pylist(), [], []
            for i, text in zip(ids, b.column(1).to_pylist(), strict=True):
                kind = ("pdf", "pdf", "png", "jpg")[i % 4]
                names.append(f"scan {i}.{kind}")
                data = png(text) if kind == "png" else jpeg(text) if kind == "jpg" else pdf([text] * (i // 4 % 5), i % 4 == 1)
                if i % 7 == 0:
                    data = data[: len(data) // 2]
                elif kind == "png" and i % 5 == 0:
                    k = len(data) - 20
                    data = data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :]
                made.append(data)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array([None] * len(ids), pa.string()), pa.array([len(x) for x in made], pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "file_name", "content_type", "length", "content"])

    return rows.mapInArrow(run, "doc_id long, file_name string, content_type string, length long, content binary")
