"""Registered queries of single steps of extraction and checking, each with its twin in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import indian_format
from ..operators import checks as C
from ..operators import invoice, lines, rows, statements
from ..sources import admission, ledger, pages, shared, store
from . import render
from .process import extract_text, process_documents, read_documents, summary
from .registry import query
from .render import line, money, table
from .schema import TYPES

_NUMBERED = """WITH v AS (SELECT o_orderkey AS k, round(o_totalprice * 100)::BIGINT AS c, o_custkey AS u, o_orderdate AS d FROM orders) """


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), render.cents(F.col("o_totalprice")).alias("c"), F.col("o_custkey").alias("u"), F.col("o_orderdate").alias("d"))


def _paged(docs, *parts):
    """(doc_id, line_no, page, text) of a text of these lines; null ones are left out."""
    return lines.page_lines(docs.select("doc_id", F.concat_ws("\n", *parts).alias("text")))


def _money_sql(c: str) -> str:
    return f"((abs({c}) // 100)::VARCHAR || '.' || lpad((abs({c}) % 100)::VARCHAR, 2, '0'))"


@query(_NUMBERED + """SELECT k AS doc_id, CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END AS pattern, CASE WHEN k % 2 = 0 THEN 4 ELSE 1 END AS line_no, strftime(CASE WHEN k % 2 = 0 THEN d + INTERVAL 1 DAY ELSE d END, '%Y-%m-%d') AS invoice_date, 'C-' || u AS invoice_number, c / 100.0::DOUBLE AS total FROM v""")
def first_match_per_field(spark, sf_dir):
    """A pattern higher in order wins over an earlier line; among lines of one pattern the first wins."""
    d = _orders(spark, sf_dir)
    later = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Invoice date: "), F.date_format(F.date_add(F.col("d").cast("date"), 1), "yyyy-MM-dd")))
    x = _paged(d, F.concat(F.lit("Date: "), F.date_format("d", "yyyy-MM-dd")), F.concat(F.lit("Invoice No: C-"), F.col("u").cast("string")), line("Total Due: $", F.col("c")), later, F.lit("Invoice No: other"), F.lit("Total Due: $ 1.00"))
    text = invoice.first_matches(x, {"invoice_date": invoice.TEXT_FIELDS["invoice_date"], "invoice_number": invoice.TEXT_FIELDS["invoice_number"]}, False)
    total = invoice.first_matches(x, {"total": invoice.MONEY_FIELDS["total_amount"]}, True)
    return text.join(total, "doc_id").select("doc_id", "invoice_date.pattern", "invoice_date.line_no", F.col("invoice_date.value").alias("invoice_date"), F.col("invoice_number.value").alias("invoice_number"), F.col("total.value").alias("total"))


@query(_NUMBERED + """SELECT k AS doc_id, (c - c // 10) / 100.0::DOUBLE AS tax_amount, 'GST calculated from inclusive total' AS source_text, 'PASS' AS status FROM v""")
def inclusive_tax(spark, sf_dir):
    """Where no tax is stated and the total includes GST, the tax is what the total has over the subtotal."""
    x = _paged(_orders(spark, sf_dir), line("Subtotal: $", F.expr("c div 10")), F.lit("Prices inclusive GST"), line("Total Amount: $", F.col("c")))
    v = lambda n: F.col(f"{n}.value")
    total = C.invoice_total(v("subtotal"), v("tax_amount"), v("shipping_and_handling"), v("discount"), v("total_amount"))
    return invoice.extract(x).select("doc_id", v("tax_amount").alias("tax_amount"), F.col("tax_amount.source_text"), total["status"].alias("status"))


#: Label and cents of each line of a full profit-and-loss statement, by sums of a ship year; both engines compute these.
_PNL = {
    "revenue": ("Revenue from operations", "rev"),
    "cost_of_sales": ("Cost of sales", "cos"),
    "gross_profit": ("Gross profit", "rev - cos"),
    "interest_earned": ("Interest earned", "n * 700"),
    "other_income": ("Other income", "q * 11"),
    "total_income": ("Total income", "n * 700 + q * 11 + CASE WHEN y % 3 = 0 THEN 6 ELSE 5 END"),
    "interest_expended": ("Interest expended", "n * 90"),
    "operating_expenses": ("Operating expenses", "opex"),
    "operating_profit": ("Operating profit", "rev - cos - opex - CASE WHEN y % 2 = 0 THEN 100 ELSE 0 END"),
    "provisions": ("Provisions", "n * 13"),
    "contingencies": ("Contingencies", "n + q"),
    "total_expenses": ("Total expenses", "n * 90 + opex + n * 13 + n + q"),
    "profit_before_tax": ("Profit before tax", "rev - q"),
    "tax": ("Total tax expense", "n * 250"),
    "net_profit": ("Net profit for the year", "rev - q - n * 250"),
    "minority_interest": ("Minority interest", "q * 3"),
    "group_net_profit": ("Consolidated net profit attributable to the group", "rev - q - q * 3 + 4"),
    "current_profit": ("Current profit", "n * 17"),
    "brought_forward_profit": ("Brought forward profit", "n * 19"),
    "total_available_for_appropriation": ("Total available for appropriation", "n * 36 - CASE WHEN y % 2 = 1 THEN 900 ELSE 0 END"),
}
_PNL_SQL = """WITH s AS (SELECT year(l_shipdate) AS y, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS rev, sum(round(l_discount * 10000)::BIGINT)::BIGINT AS cos, sum(round(l_tax * 10000)::BIGINT)::BIGINT AS opex, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS q FROM lineitem GROUP BY 1)"""


def _statements(spark, sf_dir):
    cents = lambda c, by: F.sum(F.round(F.col(c) * by).cast("long"))
    s = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("y")).agg(cents("l_extendedprice", 100).alias("rev"), cents("l_discount", 10000).alias("cos"), cents("l_tax", 10000).alias("opex"), F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    text = F.concat_ws("\n", *(line(label, F.expr(f"CAST({e} AS BIGINT)")) for label, e in _PNL.values()))
    return lines.page_lines(s.select(F.col("y").alias("doc_id"), text.alias("text")))


@query(f"{_PNL_SQL} " + " UNION ALL ".join(f"SELECT y AS doc_id, '{f}' AS field, ({e}) / 100.0::DOUBLE AS value FROM s" for f, (_, e) in _PNL.items()))
def pnl_fields(spark, sf_dir):
    """All twenty fields of a profit-and-loss statement."""
    d = statements.profit_and_loss(rows.rows(_statements(spark, sf_dir)))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}.value").alias("value")) for f in _PNL))
    return d.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", "x.field", "x.value")


def _check_sql(name: str, terms: list[str], reported: str) -> str:
    calc = " ".join(f"{t[0]} ({_PNL[t[1:]][1]})" for t in terms)
    rep = f"({_PNL[reported][1]})"
    return f"SELECT y AS doc_id, '{name}' AS name, ({calc}) / 100.0::DOUBLE AS calculated_value, {rep} / 100.0::DOUBLE AS reported_value, abs({calc} - {rep}) / 100.0::DOUBLE AS variance, CASE WHEN abs({calc} - {rep}) <= 5 THEN 'PASS' ELSE 'FAIL' END AS status FROM s"


@query(f"{_PNL_SQL} " + " UNION ALL ".join(_check_sql(*c) for c in C.PROFIT_AND_LOSS))
def pnl_all_checks(spark, sf_dir):
    """All eight checks of a profit-and-loss statement, each applicable."""
    d = statements.profit_and_loss(rows.rows(_statements(spark, sf_dir)))
    x = d.select("doc_id", F.explode(F.array(*C.profit_and_loss(lambda n: F.col(f"{n}.value")))).alias("c"))
    return x.select("doc_id", *(F.col(f"c.{k}") for k in ("name", "calculated_value", "reported_value", "variance", "status")))


_FLOWS = """WITH s AS (SELECT user_id AS u, coalesce(sum(round(value * 100)::BIGINT) FILTER (event_type = 'purchase'), 0)::BIGINT + 1000000 AS op, -coalesce(sum(round(value * 100)::BIGINT) FILTER (event_type = 'view'), 0)::BIGINT - 2000000 AS inv, coalesce(sum(round(value * 100)::BIGINT) FILTER (event_type = 'click'), 0)::BIGINT + 3000000 AS fin, coalesce(sum(round(value * 100)::BIGINT) FILTER (event_type = 'error'), 0)::BIGINT + 400000 AS adj FROM events GROUP BY 1),
f AS (SELECT *, op + inv + fin + adj AS net, 90000000 + u * 100 AS opening FROM s) """


def _flows(spark, sf_dir):
    value = render.cents(F.col("value"))
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("event_type") == kind, value)), F.lit(0))
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg((total("purchase") + 1000000).alias("op"), (-total("view") - 2000000).alias("inv"), (total("click") + 3000000).alias("fin"), (total("error") + 400000).alias("adj"))
    return s.withColumns({"net": F.col("op") + F.col("inv") + F.col("fin") + F.col("adj"), "opening": F.lit(90000000) + F.col("doc_id") * 100})


_FIELDS = ["operating_cash_flow", "investing_cash_flow", "financing_cash_flow", "net_change_in_cash", "opening_cash", "closing_cash"]


@query(_FLOWS + """SELECT u AS doc_id, op / 100.0::DOUBLE AS operating_cash_flow, inv / 100.0::DOUBLE AS investing_cash_flow, fin / 100.0::DOUBLE AS financing_cash_flow, net / 100.0::DOUBLE AS net_change_in_cash, opening / 100.0::DOUBLE AS opening_cash, (opening + net) / 100.0::DOUBLE AS closing_cash, adj / 100.0::DOUBLE AS adjustment, 'Effect of exchange differences' AS adjustment_label, 'PASS' AS overall_status FROM f""")
def cash_flow_fragmented(spark, sf_dir):
    """Labels and values on lines of their own; the exchange effect counts from the line items."""
    parts = [("Net cash flow from operating activities", "op"), ("Net cash flow used in investing activities", "inv"), ("Net cash flow from financing activities", "fin"), ("Effect of exchange differences", "adj"), ("Net increase in cash and cash equivalents", "net"), ("Cash and cash equivalents at beginning of the period", "opening")]
    d = _flows(spark, sf_dir)
    text = [x for label, c in parts for x in (F.lit(label), money(F.col(c)))] + [F.lit("Cash and cash equivalents at end of the period"), money(F.col("opening") + F.col("net"))]
    made = C.cash_flow(*(F.col(f"{n}.value") for n in _FIELDS), F.transform("adjustments", lambda a: a["value"]))
    got = statements.cash_flow(_paged(d, *text)).withColumn("checks", F.array(*made))
    adjustment = F.get("adjustments", F.lit(0))
    return got.select("doc_id", *(F.col(f"{f}.value").alias(f) for f in _FIELDS), adjustment["value"].alias("adjustment"), adjustment["label"].alias("adjustment_label"), C.overall(F.col("checks")).alias("overall_status"))


@query(_FLOWS + """SELECT u AS doc_id, op / 100.0::DOUBLE AS operating_cash_flow, opening / 100.0::DOUBLE AS opening_cash, (opening + net - adj) / 100.0::DOUBLE AS closing_cash FROM f""")
def cash_flow_repaired(spark, sf_dir):
    """Opening and closing stand in each other's place, and the operating total above its label: both are put right."""
    d = _flows(spark, sf_dir).withColumn("net", F.col("net") - F.col("adj"))
    x = _paged(d, F.concat(F.lit("Particulars of operations "), money(F.col("op"))), line("Net cash from operating activities", F.lit(12345)), line("Net cash used in investing activities", F.col("inv")), line("Net cash from financing activities", F.col("fin")), line("Net increase in cash", F.col("net")), line("Opening cash", F.col("opening") + F.col("net")), line("Closing cash", F.col("opening")))
    return statements.cash_flow(x).select("doc_id", *(F.col(f"{f}.value").alias(f) for f in ("operating_cash_flow", "opening_cash", "closing_cash")))


@query("""SELECT p_partkey AS doc_id, 3 * i AS line_no, i AS section_no, 'Section of ' || p_brand || ' part' AS header, p_name AS label, (p_size * i)::VARCHAR AS first_value FROM part, (VALUES (1), (2)) v(i)
UNION ALL SELECT p_partkey, 1, 0, 'General', p_name, '7' FROM part""")
def section_headers(spark, sf_dir):
    """Lines above any header belong to General; a header with a colon opens a section."""
    head = F.concat(F.lit("Section of "), F.col("p_brand"), F.lit(" part:"))
    row = lambda k: F.concat(F.col("p_name"), F.lit("  "), (F.col("p_size") * k).cast("string"))
    text = F.concat_ws("\n", F.concat(F.col("p_name"), F.lit("\t7")), head, row(1), F.lit(" \t "), head, row(2))
    n = lines.numbered_lines(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")))
    got = lines.sections(lines.carry_pages(n), lines.periods(n))
    return got.select("doc_id", "line_no", F.col("section_no").cast("int").alias("section_no"), "header", "label", F.get("values", F.lit(0)).alias("first_value"))


_SHEETS = """WITH b AS (SELECT n_nationkey AS k, coalesce((SELECT sum(round(c_acctbal * 100)::BIGINT)::BIGINT FROM customer WHERE c_nationkey = n_nationkey), 0) AS own, coalesce((SELECT sum(round(s_acctbal * 100)::BIGINT)::BIGINT FROM supplier WHERE s_nationkey = n_nationkey), 0) AS owed FROM nation),
v AS (SELECT k, own + owed AS assets, owed AS liabilities, own + CASE WHEN k % 5 = 0 THEN 1000 ELSE 0 END AS equity FROM b) """
_PRINT = "CASE WHEN {0} < 0 THEN '(' ELSE '' END || {1} || CASE WHEN {0} < 0 THEN ')' ELSE '' END"
_LINE = lambda label, c: f"'{label} ' || " + _PRINT.format(c, _money_sql(c))


@query(_SHEETS + f""", t AS (SELECT k, assets, liabilities, equity, {_LINE('Total Assets', 'assets')} AS a, {_LINE('Total Liabilities', 'liabilities')} AS l, {_LINE('Total Equity', 'equity')} AS e FROM v),
q AS (SELECT *, length(regexp_replace('Balancesheet' || a || l || e, '[^A-Za-z0-9]', '', 'g')) AS alnum, length(replace('Balancesheet' || a || l || e, ' ', '')) AS solid, abs(liabilities + equity - assets) <= 5 AS good FROM t),
w AS (SELECT *, round((1.0::DOUBLE + alnum::DOUBLE / solid) / 2, 4) AS q FROM q),
c AS (SELECT *, round(q * 0.35::DOUBLE + 0.45::DOUBLE + length(a) / 80.0::DOUBLE * 0.2::DOUBLE, 4) AS ca, round(q * 0.35::DOUBLE + 0.45::DOUBLE + length(l) / 80.0::DOUBLE * 0.2::DOUBLE, 4) AS cl, round(q * 0.35::DOUBLE + 0.45::DOUBLE + length(e) / 80.0::DOUBLE * 0.2::DOUBLE, 4) AS ce FROM w)
SELECT k AS doc_id, CASE WHEN good THEN 'PASS' ELSE 'FAILED' END AS processing_status, CASE WHEN good THEN 'PASS' ELSE 'FAIL' END AS overall_status, ca AS assets_confidence, cl AS liabilities_confidence, ce AS equity_confidence, round((ca + cl + ce) / 3 * CASE WHEN good THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END, 4) AS overall_confidence, '3 of 3, 100%' AS counted FROM c""")
def confidence_report(spark, sf_dir):
    """Scores of fields and documents, from the text's quality, the evidence and the checks; and the fields counted again."""
    got = process_documents(render.balance_sheets(spark, sf_dir))
    score = lambda n: F.get(F.filter("fields", lambda f: f["name"] == n), F.lit(0))["confidence"]
    again = summary(got).select("doc_id", F.format_string("%d of %d, %s", "fields_matched", "fields_total", "extraction_rate").alias("counted"))
    return got.select("doc_id", "processing_status", "overall_status", score("total_assets").alias("assets_confidence"), score("total_liabilities").alias("liabilities_confidence"), score("total_equity").alias("equity_confidence"), "overall_confidence").join(again, "doc_id")


_BALANCE_FIELDS = "(VALUES " + ", ".join(f"('{f}', {str(r).lower()})" for f, _, _, r, _ in TYPES["Balance Sheet"]) + ") x(field, required)"


@query(_SHEETS + f""", c AS (SELECT k, 'total_assets' AS field, assets AS v, 'Total Assets' AS l FROM v UNION ALL SELECT k, 'total_liabilities', liabilities, 'Total Liabilities' FROM v UNION ALL SELECT k, 'shareholders_equity', equity, 'Shareholders Equity' FROM v),
p AS (SELECT k, period_ord, period, less, field FROM v, (VALUES (1, '31-Mar-24', 0), (2, '31-Mar-23', 100)) y(period_ord, period, less), {_BALANCE_FIELDS})
SELECT p.k AS doc_id, p.period_ord, p.period, p.field, CASE WHEN v - less < 0 THEN '-' ELSE '' END || {_money_sql('(v - less)')} AS value, {_PRINT.format('(v - less)', _money_sql('(v - less)'))} AS raw_value, l || '  ' || {_PRINT.format('v', _money_sql('v'))} || '  ' || {_PRINT.format('(v - 100)', _money_sql('(v - 100)'))} AS source_text, CASE WHEN v IS NOT NULL THEN 1 END AS page
FROM p LEFT JOIN c ON p.k = c.k AND p.field = c.field""")
def labelled_cells(spark, sf_dir):
    """Every field in every period: value, text as printed, line and page, or nulls where nothing was found."""
    got = extract_text(render.two_period_sheets(spark, sf_dir))
    return got.select("doc_id", "period_ord", "period", "field", "value", "raw_value", "source_text", "page")


@query(_SHEETS + """SELECT k AS doc_id, CASE WHEN k % 3 = 0 THEN 'Memo' ELSE 'Balance Sheet' END AS document_type, k % 3 = 0 AS refused, CASE WHEN k % 3 > 0 THEN '31-Mar-24|31-Mar-23' ELSE '' END AS periods, CASE WHEN k % 3 > 0 THEN 4 END AS total_lines, CASE WHEN k % 3 > 0 THEN 3 END AS fields_matched, CASE WHEN k % 3 > 0 THEN """ + str(len(TYPES["Balance Sheet"])) + """ END AS fields_total, CASE WHEN k % 3 > 0 THEN '""" + f"{300 / len(TYPES['Balance Sheet']):.1f}%" + """' END AS extraction_rate, CASE WHEN k % 3 > 0 THEN true END AS valid FROM v""")
def reader_envelope(spark, sf_dir):
    """Documents as the labelled-line reader sees them; a type without a schema keeps its row, with an error."""
    d = render.two_period_sheets(spark, sf_dir).withColumn("document_type", F.when(F.col("doc_id") % 3 == 0, "Memo").otherwise(F.col("document_type")))
    m = lambda n: F.col(f"metadata.{n}").cast("int").alias(n)
    return read_documents(d).select("doc_id", "document_type", F.col("error").isNotNull().alias("refused"), F.array_join("periods_detected", "|").alias("periods"), m("total_lines"), m("fields_matched"), m("fields_total"), "metadata.extraction_rate", "validation.valid")


@query("SELECT user_id::VARCHAR AS document_name, event_type AS document_type, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 ORDER BY ts DESC, event_id DESC LIMIT 50")
def list_recent(spark, sf_dir):
    """The fifty documents that changed last."""
    return store.recent(_log(spark, sf_dir), 50).select("document_name", "document_type", "seq")


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("document_name"), F.col("event_type").alias("document_type"), F.lit("PASS").alias("processing_status"), F.col("value").alias("confidence"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))


@query("SELECT user_id::VARCHAR AS document_name, event_type AS document_type, event_id AS seq FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 1")
def get_by_name(spark, sf_dir):
    """One document's newest result."""
    return store.newest(_log(spark, sf_dir), "7").select("document_name", "document_type", "seq")


@query("""WITH v AS (SELECT o_orderkey AS k, (round(o_totalprice * 100)::BIGINT * (o_orderkey % 5 + 1) * CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END) AS c FROM orders),
p AS (SELECT k, c, (abs(c) // 100)::VARCHAR AS w, abs(c) % 100 AS f FROM v)
SELECT k AS doc_id, CASE WHEN c < 0 THEN '-' ELSE '' END || CASE WHEN length(w) <= 3 THEN w ELSE reverse(regexp_replace(regexp_replace(reverse(left(w, length(w) - 3)), '(..)', '\\1,', 'g'), ',$', '')) || ',' || right(w, 3) END || CASE WHEN f = 0 THEN '' WHEN f % 10 = 0 THEN '.' || (f // 10) ELSE '.' || lpad(f::VARCHAR, 2, '0') END AS shown FROM p""")
def indian_numbers(spark, sf_dir):
    """Amounts as dashboards print them, in groups of lakh and crore."""
    sign = F.when(F.col("doc_id") % 2 == 0, -1).otherwise(1)
    return _orders(spark, sf_dir).select("doc_id", indian_format(F.col("c") * (F.col("doc_id") % 5 + 1) * sign / F.lit(100.0)).alias("shown"))


def _ledger(spark, sf_dir) -> str:
    """The events as results in four batches: one runs twice, and the view is brought up to date after the second and the third."""
    path, e = shared.shared_path(spark, "ledger"), _log(spark, sf_dir).withColumn("result_json", F.concat(F.lit("{"), F.col("seq").cast("string"), F.lit("}")))
    for batch in range(4):
        part = e.where(F.floor(F.col("seq") / 10) % 4 == batch)
        ledger.commit(part, path, batch)
        if batch in (1, 2):
            ledger.commit(part, path, batch)
            ledger.compact(spark, path)
    return path


_EVENTS_LOG = """SELECT user_id::VARCHAR AS document_name, md5(user_id::VARCHAR) AS id, event_type AS document_type, event_id AS seq, b AS batch, first AS created_at FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, b DESC, event_id DESC) AS r, min(ts) OVER (PARTITION BY user_id) AS first FROM (SELECT *, (event_id // 10) % 4 AS b FROM events)) WHERE r = 1"""


@query(_EVENTS_LOG)
def upsert_latest(spark, sf_dir):
    """Results upserted by name in committed batches: one row a document, its id and the time of its first row kept."""
    return ledger.latest(spark, _ledger(spark, sf_dir)).select("document_name", "id", "document_type", "seq", "batch", "created_at")


@query(f"SELECT document_name, document_type, seq, batch, created_at FROM ({_EVENTS_LOG}) WHERE document_name = '7'")
def ledger_lookup(spark, sf_dir):
    """One document of the ledger: its bucket of the view, and of the batches since then."""
    return ledger.latest(spark, _ledger(spark, sf_dir), "7").select("document_name", "document_type", "seq", "batch", "created_at")


@query("""WITH f AS (SELECT doc_id, ['pdf', 'pdf', 'png', 'jpg'][doc_id % 4 + 1] AS e, (doc_id // 4) % 5 AS n, doc_id % 7 = 0 OR doc_id % 4 = 2 AND doc_id % 5 = 0 AS broken FROM documents)
SELECT doc_id, NOT broken AS is_readable, CASE WHEN NOT broken THEN CASE WHEN e = 'pdf' THEN n ELSE 1 END END::INTEGER AS page_count, CASE WHEN broken OR e = 'pdf' AND n NOT BETWEEN 1 AND 3 THEN 'FAILED' ELSE 'PASS' END AS status,
CASE WHEN broken OR e = 'pdf' AND n NOT BETWEEN 1 AND 3 THEN 'INVALID_FILE_ERROR' END AS error_code FROM f""")
def file_readability(spark, sf_dir):
    """The documents as files: those that are cut or changed are refused, and those with no page or with four."""
    got = admission.admit(pages.inspect(render.files(spark, sf_dir)))
    return got.select("doc_id", "is_readable", "page_count", "status", "error_code")
