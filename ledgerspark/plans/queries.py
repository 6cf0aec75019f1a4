"""The registered queries of the document engine, each with its twin in DuckDB SQL where SQL can express it.

Most render documents from the relational tables and read them back; the twin computes the same figures
from the tables alone, so it checks the whole way from text to result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import amount, currency, number_text, unit
from ..functions.text import check_route, field_label, quality_ratios, route, schema_route, similarity
from ..operators import checks as C
from ..operators import invoice, lines, matching, rows, statements
from ..sources import admission, shared, store
from . import render
from .process import envelope, extract_text, process_documents, quick_read
from .registry import ORACLES, QUERIES, query
from .render import table
from .schema import TYPES, field_aliases, template

def _check(c) -> list:
    return [c["name"].alias("name"), c["calculated_value"].alias("calculated_value"), c["reported_value"].alias("reported_value"), c["variance"].alias("variance"), c["status"].alias("status")]


_BLANK = r"[\t\n\v\f\r \x{85}\p{Z}]"
_LINES = f"""SELECT doc_id, p, l, regexp_replace(raw, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS text FROM (
    SELECT doc_id, p, unnest(string_split(page, chr(10))) AS raw, generate_subscripts(string_split(page, chr(10)), 1) AS l FROM (
        SELECT doc_id, unnest(string_split(text, chr(12))) AS page, generate_subscripts(string_split(text, chr(12)), 1) AS p FROM documents))"""


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, l) AS line_no, p AS page, text FROM ({_LINES}) WHERE text <> ''")
def line_split(spark, sf_dir):
    return lines.page_lines(table(spark, sf_dir, "documents"))


@query(f"""SELECT doc_id, i + (i - 1) // 5 AS line_no, (i - 1) // 5 + 1 AS page FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(raw, '[^' || substr('{_BLANK}', 2))""")
def page_carry_forward(spark, sf_dir):
    """A page mark is put below every fifth line."""
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 4, F.concat(x, F.lit("\nPage "), (F.floor(i / 5) + 2).cast("string"))).otherwise(x))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(marked, "\n").alias("text"))
    return lines.carry_pages(lines.numbered_lines(docs)).select("doc_id", "line_no", "page")


@query()
def section_group(spark, sf_dir):
    kept = lines.carry_pages(lines.numbered_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return lines.sections(kept, lines.periods(kept))


@query("""SELECT o_orderkey AS doc_id, unnest([1, 2]) AS period_ord, unnest([strftime(o_orderdate, '%d-%b-%y'), strftime(o_orderdate - INTERVAL 1 YEAR, '%d-%b-%y')]) AS period FROM orders""")
def period_detect(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    text = F.concat_ws("  ", F.lit("Particulars"), F.date_format(day, "dd-MMM-yy"), F.date_format(F.add_months(day, -12), "dd-MMM-yy"))
    return lines.periods(lines.numbered_lines(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))))


@query("SELECT p_partkey AS doc_id, p_name AS label, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS label_norm, p_retailprice AS first_value, p_size::DOUBLE AS second_value FROM part")
def label_value_rows(spark, sf_dir):
    text = F.concat_ws(" ", "p_name", render.money(render.cents(F.col("p_retailprice"))), F.col("p_size").cast("string"))
    x = rows.rows(lines.page_lines(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))))
    return x.select("doc_id", "label", "label_norm", F.get("values", F.lit(0)).alias("first_value"), F.get("values", F.lit(1)).alias("second_value"))


@query("""WITH e AS (SELECT user_id, event_id, event_type IN ('view', 'click') AS push FROM events),
s AS (SELECT *, coalesce(sum(CASE WHEN push THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM e),
m AS (SELECT *, NOT push AND s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY event_id)) > 0 AS served FROM s),
n AS (SELECT *, sum(push::INT) OVER w AS a, sum(served::INT) OVER w AS b FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT x.user_id, y.event_id AS push, x.event_id AS pop FROM n x JOIN n y ON x.user_id = y.user_id AND x.b = y.a WHERE x.served AND y.push""")
def fifo_pairing(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("view", "click"), "push").otherwise("pop")
    return rows.fifo_pairs(table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("kind")), "user_id", "event_id", "kind")


@query("""WITH e AS (SELECT event_id, event_type IN ('view', 'click') AS push FROM events),
s AS (SELECT *, coalesce(sum(CASE WHEN push THEN 1 ELSE -1 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM e),
m AS (SELECT *, NOT push AND s - least(0, min(s) OVER (ORDER BY event_id)) > 0 AS served FROM s),
n AS (SELECT *, sum(push::INT) OVER w AS a, sum(served::INT) OVER w AS b FROM m WINDOW w AS (ORDER BY event_id))
SELECT y.event_id AS push, x.event_id AS pop FROM n x JOIN n y ON x.b = y.a WHERE x.served AND y.push""")
def fifo_pairing_one_queue(spark, sf_dir):
    """All events in one queue: its chunks are scanned side by side, so the one key is no task of its own."""
    kind = F.when(F.col("event_type").isin("view", "click"), "push").otherwise("pop")
    e = table(spark, sf_dir, "events").select(F.lit("all").alias("queue"), "event_id", kind.alias("kind"))
    return rows.fifo_pairs(e, "queue", "event_id", "kind", rows.chunk_width(e, "queue", "event_id")).select("push", "pop")


@query("SELECT c_custkey, ['USD', 'INR', 'EUR', 'GBP'][c_custkey % 4 + 1] AS currency, c_acctbal AS value FROM customer")
def clean_currency(spark, sf_dir):
    sign = F.element_at(F.array(*map(F.lit, "$₹€£")), (F.col("c_custkey") % 4 + 1).cast("int"))
    digits = F.concat(sign, F.format_number(F.abs("c_acctbal"), 2))
    raw = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("("), digits, F.lit(")"))).otherwise(digits)
    return table(spark, sf_dir, "customer").select("c_custkey", currency(raw).alias("currency"), amount(raw).alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '' END || printf('%.2f', o_totalprice) AS value FROM orders")
def normalize_number(spark, sf_dir):
    digits = F.format_number("o_totalprice", 2)
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("("), digits, F.lit(")"))).otherwise(F.concat(F.lit("₹ "), digits))
    return table(spark, sf_dir, "orders").select("o_orderkey", number_text(raw).alias("value"))


_UNITS = ["", " Cr", " Lakhs", " Mn", " Billion", "K"]


@query("SELECT p_partkey, [NULL, 'Cr', 'Lakh', 'Mn', 'Bn', 'K'][p_partkey % 6 + 1] AS unit, p_size::VARCHAR AS value FROM part")
def unit_suffix(spark, sf_dir):
    raw = F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, _UNITS)), (F.col("p_partkey") % 6 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", unit(raw).alias("unit"), number_text(raw).alias("value"))


def _dice(a: str, b: str) -> str:
    pairs = lambda x: f"CASE WHEN length({x}) < 2 THEN [] ELSE list_transform(range(1, length({x})), lambda i: substr({x}, i, 2)) END"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN length({a}) < 2 OR length({b}) < 2 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_filter({pairs(b)}, lambda g: list_contains({pairs(a)}, g))) / (len(list_distinct({pairs(a)})) + len(list_distinct({pairs(b)}))) END"


@query(f"SELECT p_name, p_type, round({_dice('lower(p_name)', 'lower(p_type)')}, 6) AS score FROM (SELECT DISTINCT p_name, p_type FROM part)")
def dice_similarity(spark, sf_dir):
    x = table(spark, sf_dir, "part").select("p_name", "p_type").distinct()
    return x.select("p_name", "p_type", F.round(similarity(F.lower("p_name"), F.lower("p_type")), 6).alias("score"))


_ALIASES = [(t, i, name, j, alias, kind, required, category) for t, fields in TYPES.items() for i, (name, aliases, kind, required, category) in enumerate(fields) for j, alias in enumerate(aliases)]
_quote = lambda s: "'" + s.replace("'", "''") + "'"
_VALUES = "(VALUES " + ", ".join(f"({n}, {_quote(t)}, {i}, {_quote(f)}, {j}, {_quote(a)}, {_quote(k)}, {str(r).lower()}, {_quote(c)})" for n, (t, i, f, j, a, k, r, c) in enumerate(_ALIASES)) + ") v(n, schema_type, field_ord, field, alias_ord, alias, type, required, category)"
_label = lambda c: f"regexp_replace(regexp_replace(trim(lower({c})), '[^a-z0-9\\s&/()''-]', '', 'g'), '\\s+', ' ', 'g')"


@query(f"""WITH a AS (SELECT *, {_label('alias')} AS k FROM {_VALUES}),
x AS (SELECT DISTINCT schema_type, alias || ['', ' (net)', ' of the year'][p_size % 3 + 1] AS label FROM part JOIN a ON p_partkey % {len(_ALIASES)} = n),
l AS (SELECT *, {_label('label')} AS l FROM x),
j AS (SELECT l.schema_type, label, field, alias, field_ord, alias_ord, l = k AS exact, contains(l, k) OR contains(k, l) AS inside, {_dice('l', 'k')} AS score FROM l JOIN a ON l.schema_type = a.schema_type),
r AS (SELECT *, row_number() OVER (PARTITION BY schema_type, label ORDER BY exact DESC, score DESC, field_ord, alias_ord) AS r FROM j WHERE exact OR inside AND score > 0.6 OR score > 0.75)
SELECT schema_type, label, field, alias, round(score, 6) AS score FROM r WHERE r = 1""")
def label_match_best(spark, sf_dir):
    """Names of fields with a word more or less, matched back to their fields."""
    numbered = spark.createDataFrame([(n, t, a) for n, (t, _, _, _, a, *_) in enumerate(_ALIASES)], "n int, schema_type string, alias string")
    part = table(spark, sf_dir, "part").select((F.col("p_partkey") % len(_ALIASES)).cast("int").alias("n"), F.element_at(F.array(F.lit(""), F.lit(" (net)"), F.lit(" of the year")), (F.col("p_size") % 3 + 1).cast("int")).alias("more")).distinct()
    labels = part.join(F.broadcast(numbered), "n").select("schema_type", F.concat("alias", "more").alias("label")).distinct()
    best = matching.best_match(labels, field_aliases(spark), ["schema_type"])
    return best.select("schema_type", "label", "field", "alias", F.round("score", 6).alias("score"))


_SOME = ["Total Assets", "subtotal", "Revenue", "cash_from_operations", "opening balance"]
_KINDS = {"Invoice": "SELECT s_suppkey AS k FROM supplier", "Balance Sheet": "SELECT n_nationkey FROM nation", "Income Statement": "SELECT DISTINCT year(l_shipdate) FROM lineitem", "Cash Flow Statement": "SELECT DISTINCT user_id FROM events"}


@query(f"""WITH a AS (SELECT * FROM {_VALUES}), d AS ({" UNION ALL ".join(f"SELECT '{t}' AS schema_type, k FROM ({q.replace(' FROM', ' AS k FROM', 1) if ' AS k' not in q else q})" for t, q in _KINDS.items())}),
w AS (SELECT DISTINCT schema_type, field FROM a WHERE lower(field) IN ({", ".join(_quote(n.lower()) for n in _SOME)}) OR lower(alias) IN ({", ".join(_quote(n.lower()) for n in _SOME)})),
r AS (SELECT DISTINCT schema_type, field FROM a WHERE required), m AS (SELECT * FROM r WHERE (schema_type, field) NOT IN (SELECT (schema_type, field) FROM w))
SELECT k::BIGINT AS doc_id, d.schema_type, field, 'missing_required_field' AS problem FROM d JOIN m ON d.schema_type = m.schema_type""")
def mixed_batch_validation(spark, sf_dir):
    """All four kinds of document in one batch, a few fields asked for: each lacks what else its own schema requires, and nothing of the others'."""
    kinds = {"Invoice": render.bills, "Balance Sheet": render.balance_sheets, "Income Statement": render.income_statements, "Cash Flow": render.cash_flows}
    docs = None
    for name, made in kinds.items():
        d = made(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(name).alias("document_type"), "text")
        docs = d if docs is None else docs.unionByName(d)
    got = quick_read(shared.stored(docs, "mixed-batch"), _SOME)
    x = got.select("doc_id", schema_route(F.col("document_type")).alias("schema_type"), F.explode("validation.errors").alias("e"))
    return x.select("doc_id", "schema_type", "e.field", "e.problem").distinct()


_NAMES = ["Invoice", "Balance Sheet", "Profit-and-Loss", "Income Statement", "Cash Flow", "BS", "memo", "GST bill"]
_T = "replace(replace(lower(t), '-', '_'), ' ', '_')"
_has = lambda c, *names: "(" + " OR ".join(f"contains({c}, '{n}')" for n in names) + ")"
_SCHEMA = f"CASE WHEN {_has('lower(t)', 'balance', 'bs')} THEN 'Balance Sheet' WHEN {_has('lower(t)', 'income', 'p&l', 'profit', 'pnl', 'p & l')} THEN 'Income Statement' WHEN {_has('lower(t)', 'cash flow', 'cashflow', 'cf')} THEN 'Cash Flow Statement' WHEN {_has('lower(t)', 'invoice', 'bill')} THEN 'Invoice' END"


def _typed(spark, sf_dir) -> DataFrame:
    t = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % len(_NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("document_type"))


@query(f"""WITH d AS (SELECT t, {_SCHEMA} AS schema_type FROM (SELECT [{', '.join(map(_quote, _NAMES))}][doc_id % {len(_NAMES)} + 1] AS t FROM documents)), n AS (SELECT schema_type, count(*) AS documents FROM d WHERE schema_type IS NOT NULL GROUP BY 1)
SELECT n.schema_type, documents, count(DISTINCT field) AS total_fields, count(DISTINCT CASE WHEN required THEN field END) AS required_fields, string_agg(DISTINCT category, '|' ORDER BY category) AS categories FROM n JOIN {_VALUES} ON n.schema_type = v.schema_type GROUP BY 1, 2""")
def schema_template(spark, sf_dir):
    """The templates of the schemas that a corpus calls for, and how many of its documents each serves."""
    served = _typed(spark, sf_dir).groupBy(schema_route(F.col("document_type")).alias("schema_type")).agg(F.count("*").alias("documents"))
    return served.join(F.broadcast(template(field_aliases(spark))), "schema_type").select("schema_type", "documents", "total_fields", "required_fields", F.array_join("categories", "|").alias("categories"))


_INVOICE = """WITH l AS (SELECT l_orderkey AS k, round(l_extendedprice * 100)::BIGINT AS c, l_quantity::BIGINT AS q, round(l_discount * 100)::BIGINT AS d, round(l_tax * 100)::BIGINT AS t FROM lineitem JOIN part ON p_partkey = l_partkey),
s AS (SELECT k, sum(c)::BIGINT AS sub, (sum(c * d)::BIGINT + 50) // 100 AS disc, (sum(c * (100 - d) * t)::BIGINT + 5000) // 10000 AS tax, count(*) AS n, count(*) FILTER (NOT (q > 1 AND c // q = c)) AS able, count(*) FILTER (NOT (q > 1 AND c // q = c) AND abs(q * (c // q) - c) > 5) AS bad FROM l GROUP BY k),
i AS (SELECT *, sub + tax - disc AS calc, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice * 100)::BIGINT ELSE sub + tax - disc END AS total FROM orders JOIN s ON k = o_orderkey) """


@query(_INVOICE + """SELECT o_orderkey AS doc_id, 'INV-' || o_orderkey AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, 'Ledger Supplies' AS vendor_name, 'Customer ' || o_custkey AS customer_name,
sub / 100.0::DOUBLE AS subtotal, tax / 100.0::DOUBLE AS tax_amount, disc / 100.0::DOUBLE AS discount, total / 100.0::DOUBLE AS total_amount, n AS n_items, sub / 100.0::DOUBLE AS items_amount FROM i""")
def invoice_extract(spark, sf_dir):
    d = invoice.extract(lines.page_lines(render.invoices(spark, sf_dir), ahead=True))
    amounts = F.aggregate("line_items", F.lit(0.0), lambda a, x: a + x["amount"])
    fields = [F.col(f"{f}.value").alias(f) for f in ("invoice_number", "invoice_date", "vendor_name", "customer_name", "subtotal", "tax_amount", "discount", "total_amount")]
    return d.select("doc_id", *fields, F.size("line_items").cast("long").alias("n_items"), F.round(amounts, 2).alias("items_amount"))


def _invoice_checks(spark, sf_dir) -> DataFrame:
    d = invoice.extract(lines.page_lines(render.invoices(spark, sf_dir), ahead=True))
    v = lambda n: F.col(f"{n}.value")
    total = C.invoice_total(v("subtotal"), v("tax_amount"), v("shipping_and_handling"), v("discount"), v("total_amount"))
    return d.select("doc_id", total.alias("total"), C.invoice_items(F.col("line_items")).alias("items"))


@query(_INVOICE + """SELECT o_orderkey AS doc_id, calc / 100.0::DOUBLE AS calculated_value, total / 100.0::DOUBLE AS reported_value, abs(calc - total) / 100.0::DOUBLE AS variance, CASE WHEN abs(calc - total) <= 5 THEN 'PASS' ELSE 'FAIL' END AS status,
CASE WHEN abs(calc - total) > 5 OR bad > 0 THEN 'FAIL' ELSE 'PASS' END AS overall_status FROM i""")
def invoice_total_check(spark, sf_dir):
    """Flagship: invoices as text, fields and items read back, totals reconciled."""
    d = _invoice_checks(spark, sf_dir)
    return d.select("doc_id", *_check(F.col("total"))[1:], C.overall(F.array("total", "items")).alias("overall_status"))


@query(_INVOICE + """SELECT o_orderkey AS doc_id, CASE WHEN able > 0 THEN (able - bad)::DOUBLE END AS calculated_value, CASE WHEN able > 0 THEN able::DOUBLE END AS reported_value, CASE WHEN able > 0 THEN bad::DOUBLE END AS variance,
CASE WHEN able = 0 THEN 'NOT_APPLICABLE' WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM i""")
def invoice_line_items_check(spark, sf_dir):
    return _invoice_checks(spark, sf_dir).select("doc_id", *_check(F.col("items"))[1:])


_BALANCES = """WITH b AS (SELECT n_nationkey AS k, coalesce((SELECT sum(round(c_acctbal * 100)::BIGINT)::BIGINT FROM customer WHERE c_nationkey = n_nationkey), 0) AS own, coalesce((SELECT sum(round(s_acctbal * 100)::BIGINT)::BIGINT FROM supplier WHERE s_nationkey = n_nationkey), 0) AS owed FROM nation),
v AS (SELECT k, own + owed AS assets, owed AS liabilities, own + CASE WHEN k % 5 = 0 THEN 1000 ELSE 0 END AS equity FROM b) """


@query(_BALANCES + """SELECT k AS doc_id, 'balance_sheet_reconciliation' AS name, (liabilities + equity) / 100.0::DOUBLE AS calculated_value, assets / 100.0::DOUBLE AS reported_value, abs(liabilities + equity - assets) / 100.0::DOUBLE AS variance, CASE WHEN k % 5 = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM v""")
def balance_sheet_check(spark, sf_dir):
    d = statements.balance_sheet(rows.rows(lines.page_lines(render.balance_sheets(spark, sf_dir))))
    return d.withColumn("c", C.balance_sheet(F.col("total_assets.value"), F.col("total_liabilities.value"), F.col("total_equity.value"))).select("doc_id", *_check(F.col("c")))


@query("""WITH s AS (SELECT year(l_shipdate) AS y, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS rev, (sum(round(l_extendedprice * 100)::BIGINT * round(l_discount * 100)::BIGINT)::BIGINT + 50) // 100 AS cos, (sum(round(l_extendedprice * 100)::BIGINT * round(l_tax * 100)::BIGINT)::BIGINT + 50) // 100 AS opex FROM lineitem GROUP BY 1),
g AS (SELECT y AS doc_id, 'gross_profit_check' AS name, rev - cos AS calc, rev - cos AS rep FROM s UNION ALL SELECT y, 'operating_profit_check', rev - cos - opex, rev - cos - opex + CASE WHEN y % 2 = 1 THEN 100 ELSE 0 END FROM s)
SELECT doc_id, name, calc / 100.0::DOUBLE AS calculated_value, rep / 100.0::DOUBLE AS reported_value, abs(calc - rep) / 100.0::DOUBLE AS variance, CASE WHEN abs(calc - rep) <= 5 THEN 'PASS' ELSE 'FAIL' END AS status FROM g""")
def pnl_checks(spark, sf_dir):
    d = statements.profit_and_loss(rows.rows(lines.page_lines(render.income_statements(spark, sf_dir))))
    x = d.select("doc_id", F.explode(F.array(*C.profit_and_loss(lambda n: F.col(f"{n}.value")))).alias("c"))
    return x.where("c.status <> 'NOT_APPLICABLE'").select("doc_id", *_check(F.col("c")))


@query("""WITH s AS (SELECT user_id AS u, coalesce(sum(round(value * 100)::BIGINT) FILTER (event_type = 'purchase'), 0)::BIGINT AS op, -coalesce(sum(round(value * 100)::BIGINT) FILTER (event_type = 'view'), 0)::BIGINT AS inv, coalesce(sum(round(value * 100)::BIGINT) FILTER (event_type = 'click'), 0)::BIGINT AS fin, coalesce(sum(round(value * 100)::BIGINT) FILTER (event_type = 'error'), 0)::BIGINT AS adj FROM events GROUP BY 1),
n AS (SELECT *, op + inv + fin AS base, op + inv + fin + CASE WHEN u % 2 = 0 THEN adj ELSE 0 END + CASE WHEN u % 5 = 0 THEN 77777 ELSE 0 END AS net FROM s),
k AS (SELECT *, base + CASE WHEN abs(base - net) <= 5 THEN 0 WHEN abs(base + adj - net) <= 5 THEN adj ELSE 0 END AS calc FROM n)
SELECT u AS doc_id, 'net_cash_flow_check' AS name, calc / 100.0::DOUBLE AS calculated_value, net / 100.0::DOUBLE AS reported_value, abs(calc - net) / 100.0::DOUBLE AS variance, CASE WHEN abs(calc - net) <= 5 THEN 'PASS' ELSE 'FAIL' END AS status FROM k
UNION ALL SELECT u, 'cash_reconciliation_check', (100000 + u + net) / 100.0::DOUBLE, (100000 + u + net) / 100.0::DOUBLE, 0.0::DOUBLE, 'PASS' FROM k""")
def cash_flow_checks(spark, sf_dir):
    d = statements.cash_flow(lines.page_lines(render.cash_flows(spark, sf_dir)))
    made = C.cash_flow(*(F.col(f"{n}.value") for n in statements.CASH_FLOW), F.transform("adjustments", lambda a: a["value"]))
    return d.select("doc_id", F.explode(F.array(*made)).alias("c")).select("doc_id", *_check(F.col("c")))


@query("""WITH c AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS o FROM events WHERE event_type IN ('purchase', 'view', 'click')),
n AS (SELECT user_id, sum(value) AS net, count(*) AS n FROM c WHERE o = 2 GROUP BY 1),
t AS (SELECT a.user_id, a.value AS operating, b.value AS investing, f.value AS financing, row_number() OVER (PARTITION BY a.user_id ORDER BY a.o, b.o, f.o) AS r FROM c a JOIN c b ON a.user_id = b.user_id AND b.event_type = 'view' JOIN c f ON a.user_id = f.user_id AND f.event_type = 'click' JOIN n ON n.user_id = a.user_id WHERE a.event_type = 'purchase' AND n.n = 3 AND round(abs(a.value + b.value + f.value - net), 4) <= 0.05)
SELECT user_id AS doc_id, operating, investing, financing FROM t WHERE r = 1""")
def cash_flow_triple_search(spark, sf_dir):
    """The second values of three kinds add up to the net change; the first triple of all values that meets it is found."""
    from pyspark.sql import Window

    kind = F.create_map(*(F.lit(x) for kv in {"purchase": "operating_cash_flow", "view": "investing_cash_flow", "click": "financing_cash_flow"}.items() for x in kv))
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "view", "click"))
    c = e.withColumn("ord", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")))
    groups = c.select(F.col("user_id").alias("doc_id"), kind[F.col("event_type")].alias("kind"), "ord", "value", F.lit("").alias("source_text"), F.lit(1).alias("page"))
    net = groups.where("ord = 2").groupBy("doc_id").agg(F.sum("value").alias("net"), F.count("*").alias("n")).where("n = 3").select("doc_id", "net")
    none = net.select("doc_id", F.lit(0).alias("ord"), F.lit(0.0).alias("value"))
    return statements.first_triple(groups, none, net).select("doc_id", *(F.col(f"triple.{k}.value").alias(k) for k in ("operating", "investing", "financing")))


_LEGS = """l AS (SELECT strftime(l_shipdate, '%Y-%m') AS k, l_linenumber AS leg, row_number() OVER (PARTITION BY strftime(l_shipdate, '%Y-%m'), l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice) AS o, round(l_extendedprice * 100)::BIGINT AS c FROM lineitem WHERE l_linenumber <= 3),
n AS (SELECT k, sum(c)::BIGINT AS net, max(o) AS n FROM l WHERE leg = 1 AND o = 9 OR leg = 2 AND o = 7 OR leg = 3 AND o = 5 GROUP BY 1 HAVING count(*) = 3)"""


@query(f"""WITH {_LEGS}, f AS (SELECT k, leg, c, min(o) AS o FROM l GROUP BY 1, 2, 3),
ab AS (SELECT a.k, a.c + b.c AS c, min((a.o, b.o, a.c, b.c)) AS x FROM f a JOIN f b ON a.k = b.k AND a.leg = 1 AND b.leg = 2 GROUP BY 1, 2),
w AS (SELECT f.k, o, c, n.net - c + d AS need FROM f JOIN n ON f.k = n.k, range(-5, 6) r(d) WHERE leg = 3),
r AS (SELECT ab.k, min((x, w.o, w.c)) AS t FROM ab JOIN w ON ab.k = w.k AND ab.c = w.need GROUP BY 1)
SELECT k AS doc_id, t[1][3] / 100.0::DOUBLE AS operating, t[1][4] / 100.0::DOUBLE AS investing, t[2 + 1] / 100.0::DOUBLE AS financing FROM r""")
def triple_search_at_length(spark, sf_dir):
    """Hundreds of values a leg: the lines of a month by their number, one known combination as the net change, the first that meets it found."""
    from pyspark.sql import Window

    kind = F.element_at(F.array(*map(F.lit, ("operating_cash_flow", "investing_cash_flow", "financing_cash_flow"))), F.col("l_linenumber").cast("int"))
    x = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").select(F.date_format("l_shipdate", "yyyy-MM").alias("doc_id"), kind.alias("kind"), "l_orderkey", "l_partkey", "l_suppkey", F.round("l_extendedprice", 2).alias("value"))
    groups = x.select("doc_id", "kind", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("l_orderkey", "l_partkey", "l_suppkey", "value")).alias("ord"), "value", F.lit("").alias("source_text"), F.lit(1).alias("page"))
    known = ((F.col("kind") == "operating_cash_flow") & (F.col("ord") == 9)) | ((F.col("kind") == "investing_cash_flow") & (F.col("ord") == 7)) | ((F.col("kind") == "financing_cash_flow") & (F.col("ord") == 5))
    net = groups.where(known).groupBy("doc_id").agg(F.round(F.sum("value"), 2).alias("net"), F.count("*").alias("n")).where("n = 3").select("doc_id", "net")
    none = net.select("doc_id", F.lit(0).alias("ord"), F.lit(0.0).alias("value"))
    return statements.first_triple_at_length(groups, none, net).select("doc_id", *(F.col(f"triple.{k}.value").alias(k) for k in ("operating", "investing", "financing")))


@query("SELECT p_brand AS doc_id, p_type AS label, sum(round(p_retailprice * 100)::BIGINT)::BIGINT / 100.0::DOUBLE AS current, sum(p_size)::DOUBLE AS comparative FROM part GROUP BY 1, 2")
def comparative_periods(spark, sf_dir):
    x = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.sum(render.cents(F.col("p_retailprice"))).alias("c"), F.sum("p_size").alias("n"))
    row = F.concat_ws(" ", "p_type", render.money(F.col("c")), F.col("n").cast("string"))
    docs = x.groupBy(F.col("p_brand").alias("doc_id")).agg(F.array_join(F.sort_array(F.collect_list(row)), "\n").alias("text"))
    return rows.comparative_periods(rows.rows(lines.page_lines(docs))).select("doc_id", "label", "current", "comparative")


@query("""SELECT o_orderpriority AS field, 'orders' AS doc_id, (count(*) FILTER (quarter(o_orderdate) = 1))::VARCHAR AS Q1, (count(*) FILTER (quarter(o_orderdate) = 2))::VARCHAR AS Q2, (count(*) FILTER (quarter(o_orderdate) = 3))::VARCHAR AS Q3, (count(*) FILTER (quarter(o_orderdate) = 4))::VARCHAR AS Q4 FROM orders GROUP BY 1""")
def field_period_pivot(spark, sf_dir):
    period = F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    fields = table(spark, sf_dir, "orders").groupBy(F.lit("orders").alias("doc_id"), F.col("o_orderpriority").alias("field"), period.alias("period")).agg(F.count("*").cast("string").alias("value"))
    return matching.period_table(fields, ["Q1", "Q2", "Q3", "Q4"])


_CELLS = "SELECT o_orderkey AS doc_id, year(o_orderdate)::VARCHAR AS period, o_orderpriority AS field, CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'P' THEN 'n' || o_custkey ELSE o_custkey::VARCHAR END AS value, CASE WHEN o_custkey % 7 = 0 THEN '' ELSE 'seen' END AS source FROM orders"


def _cells(spark, sf_dir) -> DataFrame:
    value = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("n"), F.col("o_custkey").cast("string"))).when(F.col("o_orderstatus") != "F", F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").cast("string").alias("period"), F.col("o_orderpriority").alias("field"), F.lit("number").alias("type"), value.alias("value"), F.when(F.col("o_custkey") % 7 == 0, "").otherwise("seen").alias("source_text"))


@query(f"""WITH c AS ({_CELLS}) SELECT doc_id, period, need AS field, 'missing_required_field' AS problem FROM c, (VALUES ('1-URGENT'), ('5-LOW')) r(need) WHERE field <> need
UNION ALL SELECT doc_id, period, field, 'missing_source_text' FROM c WHERE value IS NOT NULL AND source = ''
UNION ALL SELECT doc_id, period, field, 'not_a_number' FROM c WHERE value LIKE 'n%'""")
def structural_validation(spark, sf_dir):
    need = spark.createDataFrame([("1-URGENT",), ("5-LOW",)], "field string")
    return matching.structural_problems(_cells(spark, sf_dir), need).select("doc_id", "period", "field", "problem")


@query(f"SELECT period AS doc_id, count(*) AS total_fields, count(value) AS extracted_fields, count(*) - count(value) AS null_fields FROM ({_CELLS}) GROUP BY 1")
def validation_stats(spark, sf_dir):
    return matching.validation_stats(_cells(spark, sf_dir).withColumn("doc_id", F.col("period"))).drop("extraction_rate")


@query(_BALANCES + """, c AS (SELECT k, 'total_assets' AS field, assets AS v FROM v UNION ALL SELECT k, 'total_liabilities', liabilities FROM v UNION ALL SELECT k, 'shareholders_equity', equity FROM v),
p AS (SELECT k, field, period, v - less AS v FROM c, (VALUES ('31-Mar-24', 0), ('31-Mar-23', 100)) x(period, less))
SELECT k AS doc_id, period, field, CASE WHEN v < 0 THEN '-' ELSE '' END || (abs(v) // 100) || '.' || lpad((abs(v) % 100)::VARCHAR, 2, '0') AS value FROM p""")
def labelled_line_reader(spark, sf_dir):
    return extract_text(render.two_period_sheets(spark, sf_dir)).where("value IS NOT NULL").select("doc_id", "period", "field", "value")


@query(r"""WITH n AS (SELECT doc_id, length(regexp_replace(t, '[\t\n\v\f\r \x{85}\p{Z}]', '', 'g')) AS solid, length(regexp_replace(t, '[\p{C}\p{Z}]', '', 'g')) AS shown, length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) AS alnum FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
SELECT doc_id, CASE WHEN solid > 0 THEN round(shown / solid, 6) ELSE 0.0 END AS printable_ratio, CASE WHEN solid > 0 THEN round(alnum / solid, 6) ELSE 0.0 END AS alphanumeric_ratio FROM n""")
def text_quality(spark, sf_dir):
    q = quality_ratios(F.coalesce(F.col("text"), F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", *(F.round(q[k], 6).alias(k) for k in ("printable_ratio", "alphanumeric_ratio")))


@query()
def json_envelope(spark, sf_dir):
    """All four kinds of document at once; ids repeat across them."""
    docs = render.invoices(spark, sf_dir).unionByName(render.balance_sheets(spark, sf_dir)).unionByName(render.income_statements(spark, sf_dir)).unionByName(render.cash_flows(spark, sf_dir))
    return envelope(process_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "document_type", "text")))


@query("""WITH f AS (SELECT doc_id, ['pdf', 'jpg', 'png', 'exe', 'JPEG'][doc_id % 5 + 1] AS e, ['application/pdf', 'image/jpeg', '', 'text/plain', 'image/png', NULL, 'image/jpg'][doc_id % 7 + 1] AS m, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE n_chars * 1000 END AS n, doc_id % 5 AS p FROM documents),
k AS (SELECT *, lower(e) AS x, coalesce(m, '') AS c FROM f),
r AS (SELECT *, CASE WHEN x NOT IN ('pdf', 'jpg', 'jpeg', 'png') THEN 1 WHEN c NOT IN ('', 'application/pdf', 'image/jpeg', 'image/jpg', 'image/png') THEN 2 WHEN c <> '' AND NOT (x = 'pdf' AND c = 'application/pdf' OR x IN ('jpg', 'jpeg') AND c IN ('image/jpeg', 'image/jpg') OR x = 'png' AND c = 'image/png') THEN 3 WHEN n = 0 THEN 4 WHEN n > 10485760 THEN 5 WHEN p NOT BETWEEN 1 AND 3 THEN 6 ELSE 0 END AS rule FROM k)
SELECT doc_id, CASE WHEN c <> '' THEN m ELSE 'application/' || x END AS file_type, x IN ('pdf', 'jpg', 'jpeg', 'png') AS is_supported, CASE rule WHEN 0 THEN 'PASS' ELSE 'FAILED' END AS status, CASE rule WHEN 0 THEN NULL WHEN 1 THEN 'UNSUPPORTED_FILE_TYPE' ELSE 'INVALID_FILE_ERROR' END AS error_code FROM r""")
def file_admission(spark, sf_dir):
    pick = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("doc_id") % n + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("scan."), pick(["pdf", "jpg", "png", "exe", "JPEG"], 5)).alias("file_name"), pick(["application/pdf", "image/jpeg", "", "text/plain", "image/png", None, "image/jpg"], 7).alias("content_type"),
        F.when(F.col("doc_id") % 11 == 0, 0).otherwise(F.col("n_chars") * 1000).alias("length"), (F.col("doc_id") % 5).cast("int").alias("page_count"))
    return admission.admit(files).select("doc_id", "file_type", "is_supported", "status", "error_code")


_ROUTE = f"CASE WHEN {_has(_T, 'invoice')} THEN 'invoice' WHEN {_has(_T, 'balance')} THEN 'balance_sheet' WHEN {_has(_T, 'profit', 'pnl', 'loss', 'income')} THEN 'profit_and_loss' WHEN {_has(_T, 'cash')} THEN 'cash_flow' END"


@query(f"""WITH d AS (SELECT doc_id, [{', '.join(map(_quote, _NAMES))}][doc_id % {len(_NAMES)} + 1] AS t FROM documents)
SELECT doc_id, coalesce({_ROUTE}, 'invoice') AS extractor, {_ROUTE} AS checks, {_SCHEMA} AS schema_type FROM d""")
def type_routing(spark, sf_dir):
    t = F.col("document_type")
    return _typed(spark, sf_dir).select("doc_id", route(t).alias("extractor"), check_route(t).alias("checks"), schema_route(t).alias("schema_type"))


def _log(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("document_name"), F.col("event_type").alias("document_type"), F.lit("PASS").alias("processing_status"), F.col("value").alias("confidence"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))


@query("SELECT user_id::VARCHAR AS document_name, event_type AS document_type, value AS confidence, event_id AS seq, n AS versions FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r = 1")
def latest_by_name(spark, sf_dir):
    log = _log(spark, sf_dir)
    counts = log.groupBy("document_name").agg(F.count("*").alias("versions"))
    return store.latest(log).join(counts, "document_name").select("document_name", "document_type", "confidence", "seq", "versions")


@query("SELECT user_id::VARCHAR AS document_name, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events")
def list_versions(spark, sf_dir):
    return store.numbered(_log(spark, sf_dir)).select("document_name", "seq", F.col("version").cast("long").alias("version"))


@query(f"SELECT p_partkey, {_label('p_name || chr(9) || p_brand')} AS label FROM part")
def label_normalise(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", field_label(F.concat("p_name", F.lit("\t"), "p_brand")).alias("label"))


from . import reading_queries, statement_queries  # noqa: E402, F401  register their own
