"""Registered queries of how labels, values and fields are read, each with its twin in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import drop_percent, looks_like_number
from ..operators import checks, invoice, lines, matching, rows, statements
from ..sources import folder, shared, store
from . import render
from .process import envelope, extract_text, process_documents
from .registry import query
from .render import money, table


def _paged(docs, *parts):
    """(doc_id, line_no, page, text) of a text of these lines."""
    return lines.page_lines(docs.select("doc_id", F.concat_ws("\n", *parts).alias("text")))


def _money_sql(c: str) -> str:
    return f"((({c}) // 100)::VARCHAR || '.' || lpad((({c}) % 100)::VARCHAR, 2, '0'))"


_PART = "SELECT p_partkey AS k, round(p_retailprice * 100)::BIGINT AS c, p_size AS s FROM part"


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), render.cents(F.col("p_retailprice")).alias("c"), F.col("p_size").alias("s"))


@query(f"""WITH p AS ({_PART}) SELECT k AS doc_id, r AS row_no, label AS label_norm, v AS value, n AS values_seen FROM (
SELECT k, 6 AS r, 'trade receivables' AS label, c / 100.0::DOUBLE AS v, 1 AS n FROM p UNION ALL SELECT k, 7, 'inventories on hand', c * 2 / 100.0::DOUBLE, 2 FROM p UNION ALL SELECT k, 8, 'cash and cash equivalents as at 31 march', c * 3 / 100.0::DOUBLE, 1 FROM p
UNION ALL SELECT k, 10, 'reserves 7', 20.0::DOUBLE, 3 FROM p UNION ALL SELECT k, 11, 'share capital', s::DOUBLE, 2 FROM p)""")
def waiting_labels(spark, sf_dir):
    """Labels wait in a queue for the lines of values below: headings and page numbers are passed over, a date is no value, a value
    that nothing waits for is dropped, and of three values a small first one is not the field's."""
    d, c = _parts(spark, sf_dir), F.col("c")
    text = [
        F.lit("For the year ended 1,234.00"), F.lit("Trade receivables"), F.lit("12"), F.lit("Inventories on hand"), F.lit("Cash and cash equivalents as at 31 March"),
        money(c), F.concat(money(c * 2), F.lit("  "), money(c)), money(c * 3), money(c * 4),
        F.lit("Reserves 7 55.50 20.00 10.00"), F.concat(F.lit("Share capital "), F.col("s").cast("string"), F.lit(" "), money(c + 100_000)),
    ]
    got = rows.rows(_paged(d, *text))
    return got.select("doc_id", "row_no", "label_norm", rows.field_value(F.col("values")).alias("value"), F.size("values").alias("values_seen"))


_MARKS = ["₹", "EUR", "£", "$"]


@query(f"""WITH o AS (SELECT o_orderkey AS k, round(o_totalprice * 100)::BIGINT AS c, [{", ".join(f"'{m}'" for m in _MARKS)}][o_orderkey % 4 + 1] AS m, ['INR', 'EUR', 'GBP', NULL][o_orderkey % 4 + 1] AS code FROM orders)
SELECT k AS doc_id, c / 100.0::DOUBLE AS total_amount, m || ' ' || {_money_sql('c')} AS source_text, code AS currency, 'Currency: ' || code AS currency_text FROM o""")
def total_on_next_line(spark, sf_dir):
    """A total that stands below its label; the currency by its marks, which a dollar sign is none of."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), render.cents(F.col("o_totalprice")).alias("c"))
    mark = F.element_at(F.array(*map(F.lit, _MARKS)), (F.col("doc_id") % 4 + 1).cast("int"))
    x = _paged(o, F.concat(F.lit("Invoice No: N-"), F.col("doc_id").cast("string")), F.lit("Total Due"), F.concat(mark, F.lit(" "), money(F.col("c"))))
    return invoice.extract(x).select("doc_id", F.col("total_amount.value").alias("total_amount"), F.col("total_amount.source_text").alias("source_text"), F.col("currency.value").alias("currency"), F.col("currency.source_text").alias("currency_text"))


@query(f"""WITH p AS ({_PART}), v AS (SELECT k, i, c + i AS v FROM p, range(1, 10) r(i) WHERE i <> 5 AND NOT (i = 3 AND k % 2 = 0))
SELECT k AS doc_id, 'operating_cash_flow' AS kind, row_number() OVER (PARTITION BY k ORDER BY i)::INTEGER AS ord, v / 100.0::DOUBLE AS value, {_money_sql('v')} AS source_text FROM v""")
def nearby_candidates(spark, sf_dir):
    """All values within four lines of a line about a kind, in order; near a line that names March a year is none."""
    d, c = _parts(spark, sf_dir), F.col("c")
    even = F.col("doc_id") % 2 == 0
    text = [F.when(even, F.lit("Net cash from operating activities March")).otherwise(F.lit("Net cash from operating activities")) if i == 5 else F.when(even, F.lit("2024")).otherwise(money(c + i)) if i == 3 else money(c + i) for i in range(1, 12)]
    got = statements.candidates(_paged(d, *text), {"operating_cash_flow": [["operating activities"]]})
    return got.select("doc_id", "kind", "ord", "value", "source_text")


@query(f"""WITH p AS ({_PART}), e AS (SELECT k, c, k % 2 = 0 AS patched FROM p)
SELECT k AS doc_id, pos, label, value, source_text FROM (SELECT k, 1 AS pos, 'Net Effect' AS label, (CASE WHEN patched THEN c + 9 ELSE c END) / 100.0::DOUBLE AS value, CASE WHEN patched THEN 'near' ELSE 'a' END AS source_text FROM e
UNION ALL SELECT k, 2, 'Effect of exchange', (c + 1) / 100.0::DOUBLE, 'b' FROM e UNION ALL SELECT k, 3, 'Other', (c + 2) / 100.0::DOUBLE, 'c' FROM e UNION ALL SELECT k, 4, 'Cash on amalgamation', (c + 3) / 100.0::DOUBLE, 'd' FROM e)""")
def adjustment_items(spark, sf_dir):
    """A statement's rows: the first that names an effect takes the patch, and adjustments that no row has are added."""
    v = lambda k: ((F.col("c") + k) / F.lit(100.0)).alias("value")
    row = lambda label, k, text: F.struct(F.lit(label).alias("label"), F.array(v(k)).alias("values"), F.lit(text).alias("source_text"), F.lit(1).alias("page"))
    adj = lambda label, k, text: F.struct(F.lit(label).alias("label"), v(k), F.lit(text).alias("source_text"), F.lit(1).alias("page"))
    own, found = F.array(row("Net Effect", 0, "a"), row("Effect of exchange", 1, "b"), row("Other", 2, "c")), F.array(adj("effect of EXCHANGE", 1, "b"), adj("Cash on amalgamation", 3, "d"))
    patch = F.when(F.col("doc_id") % 2 == 0, F.struct(v(9), F.lit("near").alias("source_text"), F.lit(2).alias("page")))
    d = _parts(spark, sf_dir).select("doc_id", own.alias("r"), found.alias("a"), patch.alias("p"))
    x = d.select("doc_id", F.posexplode(statements.line_items(statements.patch_rows(F.col("r"), F.col("p")), F.col("a"))).alias("i", "x"))
    return x.select("doc_id", (F.col("i") + 1).alias("pos"), "x.label", F.get("x.values", F.lit(0)).alias("value"), "x.source_text")


@query(f"WITH s AS (SELECT s_suppkey AS k, abs(round(s_acctbal * 100)::BIGINT) % 90000 AS c FROM supplier) SELECT k AS doc_id, 'Current' AS period, 'provisions' AS field, {_money_sql('c')} AS value FROM s")
def first_item_of_a_field(spark, sf_dir):
    """A field is filled by its first item; a text that names no period has one, Current; only the field asked for comes, by any of its names."""
    c = F.abs(render.cents(F.col("s_acctbal"))) % 90_000  # four figures in a row could be a year
    text = F.concat_ws("\n", F.lit("Statement of affairs"), F.concat(F.lit("Provisions  "), money(c)), F.concat(F.lit("Provisions  "), money(c + 1)), F.concat(F.lit("Borrowings  "), money(c)))
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit("Balance Sheet").alias("document_type"), text.alias("text"))
    return extract_text(docs, ["PROVISIONS"]).select("doc_id", "period", "field", "value")


@query("""WITH c AS (SELECT o_custkey AS k, quarter(o_orderdate) AS q, 'Q' || quarter(o_orderdate) || ', all years' AS period, o_orderpriority AS field, count(*) AS n FROM orders GROUP BY ALL),
p AS (SELECT DISTINCT k, q, period FROM c), f AS (SELECT DISTINCT k, field FROM c),
h AS (SELECT k, 'Field,' || string_agg('"' || period || '"', ',' ORDER BY q) AS head FROM p GROUP BY 1),
g AS (SELECT f.k, f.field, f.field || ',' || string_agg(coalesce(c.n::VARCHAR, ''), ',' ORDER BY p.q) AS line FROM f JOIN p ON f.k = p.k LEFT JOIN c ON c.k = f.k AND c.field = f.field AND c.q = p.q GROUP BY 1, 2)
SELECT h.k AS doc_id, head || chr(10) || string_agg(line, chr(10) ORDER BY field) AS csv FROM h JOIN g ON h.k = g.k GROUP BY h.k, head""")
def document_csv(spark, sf_dir):
    """Each customer's orders by priority down and its own quarters across, as the text of a CSV file."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id"), F.quarter("o_orderdate").alias("period_ord"), F.col("o_orderpriority").alias("field")).agg(F.count("*").cast("string").alias("value"))
    return matching.csv_texts(o.select("doc_id", "period_ord", F.concat(F.lit("Q"), F.col("period_ord").cast("string"), F.lit(", all years")).alias("period"), F.lit(0).alias("field_ord"), "field", "value"))


_RAW = ["{0}%", "{0} abc", "({0})", "{0},000", "{0} %  ", "Q{0}"]


@query(f"""WITH p AS (SELECT p_partkey AS k, p_size::VARCHAR AS s FROM part)
SELECT k AS p_partkey, [{", ".join("'" + r.replace("{0}", "' || s || '") + "'" for r in (x.replace("%", "").rstrip() for x in _RAW))}][k % 6 + 1] AS no_percent, k % 6 IN (0, 2, 3, 4) AS is_number FROM p""")
def number_marks(spark, sf_dir):
    """Percent signs at the end go; parentheses, thousands and percents are numbers, words and quarters are none."""
    s = F.col("p_size").cast("string")
    made = [F.concat(F.lit(a), s, F.lit(b)) for a, b in (r.split("{0}") for r in _RAW)]
    raw = F.element_at(F.array(*made), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", drop_percent(raw).alias("no_percent"), looks_like_number(raw).alias("is_number"))


@query("""WITH b AS (SELECT n_nationkey AS k, coalesce((SELECT sum(round(c_acctbal * 100)::BIGINT)::BIGINT FROM customer WHERE c_nationkey = n_nationkey), 0) AS own, coalesce((SELECT sum(round(s_acctbal * 100)::BIGINT)::BIGINT FROM supplier WHERE s_nationkey = n_nationkey), 0) AS owed FROM nation)
SELECT k AS doc_id, k::VARCHAR AS document_name, 'Balance Sheet' AS document_type, CASE WHEN k % 5 = 0 THEN 'FAILED' ELSE 'PASS' END AS processing_status, (own + owed) / 100.0::DOUBLE AS total_assets, 'balance_sheet_reconciliation' AS check_name, CASE WHEN k % 5 = 0 THEN 'FAIL' ELSE 'PASS' END AS check_status, 3 AS n_rows, k % 5 = 0 AS has_issue FROM b""")
def envelope_values(spark, sf_dir):
    """The JSON of balance sheets, taken apart again."""
    j = lambda p: F.get_json_object("result_json", p)
    e = envelope(process_documents(render.balance_sheets(spark, sf_dir)))
    return e.select(
        "doc_id", j("$.document_name").alias("document_name"), j("$.document_type").alias("document_type"), j("$.processing_status").alias("processing_status"), j("$.extracted_data.total_assets.number").cast("double").alias("total_assets"),
        j("$.validation.checks[0].name").alias("check_name"), j("$.validation.checks[0].status").alias("check_status"), F.json_array_length(j("$.rows")).alias("n_rows"), (F.json_array_length(j("$.validation.issues")) > 0).alias("has_issue"),
    )


@query(f"WITH p AS ({_PART}) SELECT k AS doc_id, (c + 7) / 100.0::DOUBLE AS total_assets, 'Grand total ' || {_money_sql('(c + 7)')} AS source_text FROM p")
def last_total_stands_in(spark, sf_dir):
    """Without a row of total assets the last row about a total counts."""
    d, c = _parts(spark, sf_dir), F.col("c")
    x = _paged(d, F.concat(F.lit("Total of loans "), money(c)), F.concat(F.lit("Deposits "), money(c + 1)), F.concat(F.lit("Grand total "), money(c + 7)), F.concat(F.lit("Cash "), money(c + 2)))
    return statements.balance_sheet(rows.rows(x)).select("doc_id", F.col("total_assets.value").alias("total_assets"), F.col("total_assets.source_text").alias("source_text"))


_ADJUSTED = """l AS (SELECT strftime(l_shipdate, '%Y-%m') AS k, row_number() OVER (PARTITION BY strftime(l_shipdate, '%Y-%m') ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, round(l_extendedprice * 100)::BIGINT * CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE -1 END AS c FROM lineitem),
v AS (SELECT k, list(c ORDER BY i) AS v, sum(CASE WHEN i IN (1, 2, 9, 17, 20) THEN c ELSE 0 END)::BIGINT AS goal FROM l WHERE i < 22 GROUP BY 1)"""


@query(f"""WITH {_ADJUSTED}, m AS (SELECT range AS m FROM range(0, 2048)), h AS (SELECT k, goal, list_slice(v, 1, len(v) // 2) AS lo, list_slice(v, len(v) // 2 + 1, len(v)) AS hi FROM v),
a AS (SELECT k, m AS lm, coalesce(list_sum(list_transform(lo, lambda x, i: CASE WHEN (m >> (i - 1)::BIGINT) & 1 = 1 THEN x ELSE 0 END)), 0)::BIGINT AS s FROM h, m WHERE m < (1 << len(lo))),
b AS (SELECT k, m AS hm, goal - coalesce(list_sum(list_transform(hi, lambda x, i: CASE WHEN (m >> (i - 1)::BIGINT) & 1 = 1 THEN x ELSE 0 END)), 0)::BIGINT AS need, goal FROM h, m WHERE m < (1 << len(hi))),
t AS (SELECT a.k, arg_min(a.s + b.goal - b.need, b.hm * 4096 + a.lm) AS used FROM a JOIN (SELECT k, hm, goal, need, need + d AS s FROM b, range(-5, 6) r(d)) b ON a.k = b.k AND a.s = b.s GROUP BY 1)
SELECT v.k AS doc_id, coalesce(used, 0) / 100.0::DOUBLE AS used FROM v LEFT JOIN t ON v.k = t.k""")
def subset_at_length(spark, sf_dir):
    """Twenty-two adjustments a document, the first subset in counting order that closes the gap: the lines of a month, every other part's taken off."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    c = F.round("l_extendedprice", 2) * F.when(F.col("l_partkey") % 2 == 0, 1).otherwise(-1)
    x = table(spark, sf_dir, "lineitem").withColumn("doc_id", F.date_format("l_shipdate", "yyyy-MM")).withColumn("i", F.row_number().over(w) - 1).where("i < 22").select("doc_id", "i", c.alias("v"))
    some = F.round(F.sum(F.when(F.col("i").isin(1, 2, 9, 17, 20), F.col("v")).otherwise(0.0)), 2)
    cases = x.groupBy("doc_id").agg(F.lit(0.0).alias("base"), some.alias("net"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda a: a["v"]).alias("adjustments"))
    return checks.first_subset(cases)


@query("SELECT s_suppkey AS doc_id, (strlen(s_name) + strlen(CAST(s_acctbal AS DECIMAL(18,2))::VARCHAR) + 2)::BIGINT AS length, s_name || chr(10) || CAST(s_acctbal AS DECIMAL(18,2))::VARCHAR || chr(10) AS text FROM supplier")
def folder_files(spark, sf_dir):
    """One file a supplier, written by write_csv_per_document() and read back by the folder source: rows of a whole folder tree."""
    path = shared.shared_path(spark, "folder")
    lines_ = F.concat_ws("\n", "s_name", F.col("s_acctbal").cast("decimal(18,2)").cast("string"))
    store.write_csv_per_document(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), lines_.alias("csv")), path)
    files = folder.read_folder(spark, path, recursive="true").where("file_name LIKE '%.txt'")
    return files.select(F.regexp_extract("path", "doc_id=([0-9]+)/", 1).cast("long").alias("doc_id"), "length", F.decode("content", "UTF-8").alias("text"))
