"""Sections and JSON results against plain Python that goes through a document line by line."""

import json
import re
from random import Random

import duckdb
from ledgerspark.functions.numbers import BLANKS
from ledgerspark.operators import lines
from ledgerspark.plans import queries, render

SF = "/root/testdata/sf0.001"


def number(text):
    return re.fullmatch(r"[-(]?\d+(\.\d+)?\)?", re.sub(r"[,%$₹\s]", "", text)) is not None


def parse(raw):
    clean = lambda parts: [p for p in (x.strip(BLANKS) for x in parts) if p]
    tabs = clean(raw.split("\t"))
    if "\t" in raw and len(tabs) > 1:
        return tabs[0], tabs[1:]
    wide, end = clean(re.split(r"[ \t\x0b\f\r]{2,}", raw)), 0
    for k, x in enumerate(wide, 1):
        if not number(x):
            end = k
    if 0 < end < len(wide):
        return " ".join(wide[:end]), wide[end:]
    m = re.fullmatch(r"(.*)[ \t]([\d,.()-]+)[ \t]*", raw)
    if m and m[1]:
        return m[1].strip(BLANKS), [m[2]]
    return raw.strip(BLANKS), []


def sections(text, periods):
    page, count, head, out = 1, 0, "General", []
    for i, raw in enumerate(re.split(r"\r?\n", text or ""), 1):
        line = raw.strip(BLANKS)
        mark = re.search(r"(?i)page\s*(\d+)", line) if len(line) < 20 else None
        if not line:
            continue
        if mark:
            page = int(mark[1])
            continue
        label, values = parse(raw)
        if any(p in line for p in periods) and (not values or len(label) < 3):
            continue
        capitals = line == line.upper() and len(line) > 3 and not re.search(r"\d", line)
        if capitals or line.endswith(":") or (not number(line) and len(line) < 60 and "\t" not in line and not values):
            count, head = count + 1, line.removesuffix(":")
        else:
            out.append((i, page, count, head, label, tuple(values), line))
    return out


def compare(spark, docs):
    kept = lines.carry_pages(lines.numbered_lines(docs))
    named = lines.periods(kept)
    periods, got = {}, {}
    for r in named.collect():
        periods.setdefault(r.doc_id, []).append(r.period)
    for r in lines.sections(kept, named).orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.page, r.section_no, r.header, r.label, tuple(r["values"]), r.source_text))
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {k: s for k, t in texts.items() if (s := sections(t, periods.get(k, [])))}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k], texts[k]
    return sum(map(len, want.values())), periods


def test_sections_of_all_documents(spark):
    docs = render.table(spark, SF, "documents").select("doc_id", "text")
    assert compare(spark, docs)[0] > 0
    assert queries.QUERIES["section_group"](spark, SF).count() == compare(spark, docs)[0]


def test_sections_of_mixed_layouts(spark):
    random = Random(12)
    figure = lambda: random.choice(["1,234.50", "(500)", "12", "7.25", "-3", "45%", "0"])
    words = lambda n: " ".join(random.choice("cash assets held by the trust total for sale other net".split()) for _ in range(n))
    kinds = [
        lambda: words(3).upper(), lambda: words(3) + ":", lambda: words(2), lambda: words(14), lambda: f"{words(2)}  {figure()}", lambda: f"{words(2)}   {words(1)}  {figure()}  {figure()}",
        lambda: f"{words(2)}\t{figure()}\t{figure()}", lambda: f"\t{words(1)}", lambda: f"{words(2)} {figure()}", lambda: f"  {words(2)} {figure()} ", lambda: f"Page {random.randint(2, 9)}", lambda: f"--- page {random.randint(2, 9)} ---",
        lambda: figure(), lambda: f"  {figure()}", lambda: "", lambda: " \t ", lambda: "2024  2023", lambda: f"as at 31 March 2024 {words(2)}", lambda: f"{words(1)}  2024", lambda: "NOTE 4", lambda: "été: ",
    ]
    rows = [(k, random.choice(["\n", "\r\n"]).join(random.choice(kinds)() for _ in range(random.randint(0, 30)))) for k in range(300)] + [(900, None), (901, "")]
    n, periods = compare(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert n > 1000 and len(periods) > 50


def test_json_of_all_documents(spark):
    """Every field that has a number shows it in the line it names; invoices and balance sheets have the tables' figures."""
    got = {}
    for r in queries.QUERIES["json_envelope"](spark, SF).collect():
        d = json.loads(r.result_json)
        assert d["document_name"] == str(r.doc_id) or d["document_name"] == r.doc_id
        got[d["document_type"], r.doc_id] = d
    texts = {}
    for f in (render.invoices, render.balance_sheets, render.income_statements, render.cash_flows):
        for r in f(spark, SF).select("doc_id", "document_type", "text").collect():
            texts[r.document_type, r.doc_id] = r.text
    assert got.keys() == texts.keys()
    shown = 0
    for k, d in got.items():
        for name, f in (d["extracted_data"] or {}).items():
            if f["number"] is not None and not f["is_default"] and f["source_text"] is not None and f["source_text"] in texts[k]:
                assert f"{abs(f['number']):.2f}" in f["source_text"].replace(",", ""), (k, name, f)
                shown += 1
    assert shown > 3 * len(got) / 2
    db = duckdb.connect()
    for t in ("orders", "lineitem", "nation", "customer", "supplier", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    bills = db.execute("""WITH i AS (SELECT l_orderkey AS k, round(l_extendedprice * 100)::BIGINT AS c, round(l_discount * 100)::BIGINT AS d, round(l_tax * 100)::BIGINT AS t FROM lineitem JOIN part ON l_partkey = p_partkey),
        s AS (SELECT k, count(*) AS n, sum(c)::BIGINT AS sub, (sum(c * d)::BIGINT + 50) // 100 AS disc, (sum(c * (100 - d) * t)::BIGINT + 5000) // 10000 AS tax FROM i GROUP BY k)
        SELECT k, n, sub, tax, disc, CASE WHEN k % 3 = 0 THEN round(o_totalprice * 100)::BIGINT ELSE sub + tax - disc END FROM s JOIN orders ON o_orderkey = k""").fetchall()
    assert len(bills) == sum(k[0] == "Invoice" for k in got)
    cents = lambda d, f: round(d["extracted_data"][f]["number"] * 100)
    for k, n, *want in bills:
        d = got["Invoice", k]
        assert [cents(d, f) for f in ("subtotal", "tax_amount", "discount", "total_amount")] == want and len(d["line_items"]) == n
    sheets = db.execute("SELECT n_nationkey, (SELECT coalesce(sum(round(c_acctbal * 100)), 0)::BIGINT FROM customer WHERE c_nationkey = n_nationkey) AS own, (SELECT coalesce(sum(round(s_acctbal * 100)), 0)::BIGINT FROM supplier WHERE s_nationkey = n_nationkey) AS owed FROM nation").fetchall()
    for k, own, owed in sheets:
        d = got["Balance Sheet", k]
        assert cents(d, "total_assets") == own + owed and cents(d, "total_liabilities") == owed
