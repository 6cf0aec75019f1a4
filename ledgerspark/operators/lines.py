"""Text to lines: pages, running page numbers, sections, periods.

Everything that carries state down a document is one window over (doc_id, line number), so a document's
lines are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import looks_like_number, strip
from ..functions.text import dealt, let, once

# What marks a page, and what a reporting period looks like, in order of precedence.
PAGE_MARK = r"(?:---\s*)?[Pp]age\s+(\d+)\s*(?:---)?"
SHORT_PAGE_MARK = {"documented": r"(?i)page\s*(\d+)", "compat": r"[Pp]age\s*(\d+)"}
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
PERIODS = [
    r"\d{1,2}[-/]\w{3}[-/]\d{2,4}",
    r"(?i)FY\s*\d{2,4}",
    rf"(?i)(?:{MONTHS})[a-z]*[\s,]+\d{{4}}",
    r"\d{4}[-/]\d{2,4}",
    r"(?<!\d)\d{4}(?!\d)",
    r"(?i)Q[1-4]\s*(?:FY)?\s*\d{2,4}",
    r"(?i)H[12]\s*(?:FY)?\s*\d{2,4}",
]
HEADER_LINES = 15


def page_lines(docs: DataFrame, ahead: bool = False) -> DataFrame:
    """(doc_id, line_no, page, text): lines of docs(doc_id, text), stripped, blank ones dropped.

    Form feeds separate pages. Null text has no lines; line_no counts kept lines over all pages. ahead: with _next and
    _next_page, the line below, from the same sort.
    """
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\f")).alias("p", "page_text"))
    lines = pages.select("doc_id", "p", F.posexplode(F.split("page_text", "\n")).alias("l", "raw")).withColumn("text", strip(F.col("raw"))).where("text <> ''")
    w = Window.partitionBy("doc_id").orderBy("p", "l")
    below = [F.lead("text").over(w).alias("_next"), F.lead(F.col("p") + 1).over(w).alias("_next_page")] if ahead else []
    return lines.select("doc_id", F.row_number().over(w).alias("line_no"), (F.col("p") + 1).alias("page"), "text", *below)


def line_array(text: Column) -> Column:
    """The lines of page_lines() as an array of struct(page, text), empty for null text: a document's lines in its own row."""
    of_page = lambda page, i: F.transform(F.split(page, "\n"), lambda raw: F.struct((i + 1).alias("page"), strip(raw).alias("text")))
    return F.filter(F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\f"), of_page)), lambda x: x["text"] != "")


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, text): non-blank lines of docs(doc_id, text) with their numbers in the text, from 1."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("i", "raw"))
    return lines.select("doc_id", (F.col("i") + 1).alias("line_no"), "raw", strip(F.col("raw")).alias("text")).where("text <> ''")


def page_mark(text: Column, mode: str = "documented") -> Column:
    """The page number that a line announces, null if it is none.

    In compat mode any line that mentions a page is a mark; in documented mode a short one.
    """
    long, short = F.regexp_extract(text, PAGE_MARK, 1), F.regexp_extract(text, SHORT_PAGE_MARK[mode], 1)
    brief = F.length(text) < 20
    found = F.when((long != "") & (brief if mode == "documented" else F.lit(True)), long).when(brief & (short != ""), short)
    return found.cast("int")


def carry_pages(lines: DataFrame, mode: str = "documented") -> DataFrame:
    """lines(doc_id, line_no, text) with the page that the last mark above announced, from 1; marks are dropped."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("_mark", page_mark(F.col("text"), mode))
    return marked.withColumn("page", F.coalesce(F.last("_mark", ignorenulls=True).over(w), F.lit(1))).where("_mark IS NULL").drop("_mark")


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines(raw, ..) with _p, struct(label, values) of each: tab columns, columns two spaces apart, or one number at the end."""
    raw = F.col("raw")
    parts = lambda by: F.filter(F.transform(F.split(raw, by), strip), lambda x: x != "")
    single = r"^(.*\S|\s)\s++([\d,.()\-]++)\s*+$"
    x = once(lines, _tabs=parts("\t"), _wide=parts(r"\s{2,}"), _label=F.regexp_extract(raw, single, 1), _value=F.regexp_extract(raw, single, 2))
    # the numbers at the end start after the last part that is none
    x = once(x, _last=F.array_max(F.transform("_wide", lambda c, i: F.when(~looks_like_number(c), i + 1).otherwise(0))))
    tabs, wide, last = F.col("_tabs"), F.col("_wide"), F.col("_last")
    pair = lambda label, values: F.struct(label.alias("label"), values.alias("values"))
    parsed = (
        F.when(raw.contains("\t") & (F.size(tabs) >= 2), pair(F.get(tabs, F.lit(0)), F.slice(tabs, 2, F.greatest(F.size(tabs), F.lit(1)))))
        .when((F.size(wide) >= 2) & (last >= 1) & (last < F.size(wide)), pair(F.array_join(F.slice(wide, 1, F.greatest(last, F.lit(1))), " "), F.slice(wide, last + 1, F.greatest(F.size(wide), F.lit(1)))))
        .when(F.col("_value") != "", pair(strip(F.col("_label")), F.array(strip(F.col("_value")))))
        .otherwise(pair(strip(raw), F.array().cast("array<string>")))
    )
    return once(x, _p=parsed).drop("_tabs", "_wide", "_label", "_value", "_last")


def is_header(text: Column, parsed: Column) -> Column:
    """Whether a line heads a section: capitals without digits, a colon at the end, or a short label without values."""
    capitals = (text == F.upper(text)) & (F.length(text) > 3) & ~text.rlike(r"\d")
    short = ~looks_like_number(text) & (F.length(text) < 60) & ~text.contains("\t") & (F.size(parsed["values"]) == 0)
    return capitals | text.endswith(":") | short


def periods(lines: DataFrame, mode: str = "documented") -> DataFrame:
    """(doc_id, period_ord, period): periods named in the first lines of each document, each once.

    Compat order: by line, pattern, place. In documented mode only the line with the most periods counts
    (the first of them), so a date in the title is no column.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    head = lines.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= HEADER_LINES)
    named = lambda k: lambda x, i: F.struct(F.lit(k).alias("pattern"), i.alias("at"), F.trim(x).alias("period"))
    found = F.flatten(F.array(*(F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), named(k)) for k, p in enumerate(PERIODS))))
    if mode == "documented":
        # a shorter match inside a longer one of the same line is no period of its own
        found = let(found, lambda f: F.filter(f, lambda x: ~F.exists(f, lambda y: (y["period"] != x["period"]) & y["period"].contains(x["period"]))))
    hits = head.select("doc_id", "line_no", F.explode(found).alias("x")).select("doc_id", "line_no", "x.pattern", "x.at", "x.period")
    if mode == "documented":
        count = hits.groupBy("doc_id", "line_no").agg(F.countDistinct("period").alias("n"))
        best = count.groupBy("doc_id").agg(F.max_by("line_no", F.struct("n", -F.col("line_no"))).alias("line_no"))
        hits = hits.join(dealt(best), ["doc_id", "line_no"])
    distinct = hits.groupBy("doc_id", "period").agg(F.min(F.struct("line_no", "pattern", "at")).alias("first"))
    return distinct.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).alias("period_ord"), "period")


def sections(lines: DataFrame, named: DataFrame) -> DataFrame:
    """(doc_id, line_no, page, section_no, header, label, values): data lines under the header above them.

    named is periods(lines): lines that hold a period and little else are dropped. Lines above any header
    belong to "General"; headers without data lines vanish.
    """
    parsed = parse_lines(lines)
    names = named.groupBy("doc_id").agg(F.collect_list("period").alias("_periods"))
    parsed = parsed.join(dealt(names), "doc_id", "left")
    dated = F.exists(F.coalesce("_periods", F.array().cast("array<string>")), lambda p: F.col("text").contains(p))
    thin = (F.size(F.col("_p.values")) == 0) | (F.length(F.col("_p.label")) < 3)
    parsed = once(parsed.where(~(dated & thin)), _h=is_header(F.col("text"), F.col("_p")))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    title = F.regexp_replace("text", ":$", "")
    with_header = parsed.withColumn("section_no", F.sum(F.col("_h").cast("int")).over(w)).withColumn("header", F.coalesce(F.last(F.when(F.col("_h"), title), ignorenulls=True).over(w), F.lit("General")))
    return with_header.where(~F.col("_h")).select("doc_id", "line_no", "page", "section_no", "header", F.col("_p.label").alias("label"), F.col("_p.values").alias("values"), F.col("text").alias("source_text"))
