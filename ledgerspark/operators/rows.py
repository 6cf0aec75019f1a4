"""Statement rows: labels with their values, also where labels come first and the values later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import amount, number_pattern
from ..functions.text import dealt, once, statement_label

# Beginnings of normalised labels.
DATED_CASH = ["cash and cash equivalents as at", "cash and cash equivalents on amalgamation"]
NOT_ROWS = ["for the year ended", "hdfc bank", "31 mar", "schedule 31 mar", "in ", "z in ", "mumbai", "membership no"]
NOT_PENDING = ["hdfc bank", "we understand", "for deloitte", "consolidated balance sheet", "consolidated cash flow statement", "consolidated statement of profit and loss", "as at", "for the year ended", "year ended", "schedule", "in ", "cash flows from", "adjustments for", "capital and liabilities"]


def starts_with(label: Column, beginnings: list[str]) -> Column:
    return label.rlike("^(?:" + "|".join(beginnings) + ")")


def is_whole(x: Column) -> Column:
    return x == F.floor(x)


def with_values(lines: DataFrame, mode: str = "documented") -> DataFrame:
    """lines(text, ...) with label and values.

    Of three or more numbers a whole one under 100 in front is a schedule number and goes. Numbers that
    do not parse leave the values but still bound the label. Lines that bring both are left as they are.
    """
    if {"label", "values"} <= set(lines.columns):
        return lines
    rx = number_pattern(mode)
    parsed = F.transform(F.regexp_extract_all("text", F.lit(f"({rx})"), F.lit(1)), lambda x: amount(x, mode))
    x = once(lines, _found=F.filter(parsed, lambda v: v.isNotNull()))
    first = F.get("_found", F.lit(0))
    schedule = F.coalesce((F.size("_found") >= 3) & is_whole(first) & (F.abs(first) < 100), F.lit(False))
    values = F.when(schedule, F.slice("_found", 2, F.greatest(F.size("_found"), F.lit(1)))).otherwise(F.col("_found"))
    before = F.regexp_extract("text", f"^(.*?)(?>{rx})", 1)
    before_second = F.regexp_extract("text", f"^(.*?(?>{rx}).*?)(?>{rx})", 1)
    label = F.when(~F.col("text").rlike(rx), F.col("text")).when(schedule, before_second).otherwise(before)
    return once(x, label=F.regexp_replace(label, r"^[ :\-\t]+|(?<![ :\-\t])[ :\-\t]++$", ""), values=values).drop("_found")


#: Events of a queue that one chunk of a scan holds, about.
CHUNK = 100_000


def chunk_width(events: DataFrame, key: str, order: str, size: int = CHUNK) -> int | None:
    """How many numbers of the order a chunk spans, so that the longest queue's hold about size events each; None if no queue is that long."""
    most = events.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("low"), F.max(order).alias("high")).agg(F.max(F.struct("n", "low", "high"))).first()[0]
    return None if most is None or most["n"] <= size else max(1, (most["high"] - most["low"] + 1) * size // most["n"])


def fifo_pairs(events: DataFrame, key: str, order: str, kind: str, chunk: int | None = None) -> DataFrame:
    """Pair pushes and pops of a queue: (key, push order, pop order) for each pop that finds something.

    events(key, order, kind): kind is "push", "pop" or anything else. The queue's length before a row is the running sum
    of pushes and pops less the lowest sum so far, if below zero; a pop that finds a queue takes the push whose number is
    that of the pushes so far less the length that remains.

    chunk: the order is a whole number, and a queue is cut into chunks of so many numbers that need not meet in one task.
    A chunk is summed up by its sum, its lowest prefix and its pushes; such sums combine associatively, so a window over a
    queue's chunks, of which there are few, gives what stands before each, and the rows take it by a join.
    """
    e = events.where(F.col(kind).isin("push", "pop")).select(key, order, kind)
    push = (F.col(kind) == "push").cast("long")
    e = e.withColumns({"_d": 2 * push - 1, "_chunk": F.lit(0).cast("long") if chunk is None else F.floor(F.col(order) / chunk)})
    w = Window.partitionBy(key, "_chunk").orderBy(order)
    here, before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("_sum", F.sum("_d").over(here)).withColumn("_pushes", F.sum(push).over(here))
    # the lowest sum before the row, zero at most
    e = e.withColumn("_low", F.least(F.lit(0), F.coalesce(F.min("_sum").over(before), F.lit(0))))
    if chunk is not None:
        parts = e.groupBy(key, "_chunk").agg(F.sum("_d").alias("_s"), F.least(F.lit(0), F.min("_sum")).alias("_l"), F.sum(push).alias("_p"))
        past = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        zero = lambda c: F.coalesce(c, F.lit(0))
        parts = parts.withColumn("_sum_before", zero(F.sum("_s").over(past)))
        parts = parts.select(key, "_chunk", "_sum_before", zero(F.sum("_p").over(past)).alias("_pushes_before"), zero(F.min(F.col("_sum_before") + F.col("_l")).over(past)).alias("_low_before"))
        e = e.join(parts, [key, "_chunk"])
        e = e.withColumns({"_sum": F.col("_sum") + F.col("_sum_before"), "_pushes": F.col("_pushes") + F.col("_pushes_before"), "_low": F.least("_low_before", F.col("_sum_before") + F.col("_low"))})
    pushes = e.where(F.col(kind) == "push").select(key, F.col("_pushes").alias("_n"), F.col(order).alias("push"))
    # a pop that does not make a new lowest sum is served
    pops = e.where((F.col(kind) == "pop") & (F.col("_sum") >= F.col("_low")))
    pops = pops.select(key, (F.col("_pushes") - F.col("_sum") + F.col("_low")).alias("_n"), F.col(order).alias("pop"))
    return pops.join(dealt(pushes), [key, "_n"]).select(key, "push", "pop")


def rows(lines: DataFrame, mode: str = "documented") -> DataFrame:
    """(doc_id, row_no, label, label_norm, values, source_text, page) from lines(doc_id, line_no, page, text).

    A line with a label and values is a row. A line with values alone takes the oldest label that still
    waits, and its own place; lines with a label alone wait.
    """
    x = once(with_values(lines, mode).withColumnRenamed("values", "_v"), label_norm=statement_label(F.col("label")), whole=statement_label(F.col("text")))
    ordinal = starts_with(F.col("label_norm"), DATED_CASH) & (F.size("_v") > 0) & F.forall("_v", lambda v: F.abs(v) <= 31)
    x = once(x, values=F.when(ordinal, F.array().cast("array<double>")).otherwise(F.col("_v"))).drop("_v")
    if mode == "documented":  # a line of dates is no row
        dates = F.regexp_replace("text", r"\d{1,2}[-/]\w{3}[-/]\d{2,4}", "")
        x = x.where(~((F.col("text") != dates) & ~dates.rlike(r"\d") & (F.size("values") > 0)))
    whole = F.col("whole")
    has = F.size("values") > 0
    single = (F.size("values") == 1) & is_whole(F.get("values", F.lit(0))) & (F.abs(F.get("values", F.lit(0))) <= 300) & F.regexp_replace("text", "[ ,]", "").rlike(r"^\d+$")
    kind = F.when(has & (F.col("label") != ""), "row").when(~has & (F.length(whole) >= 3) & whole.rlike("[a-z]") & ~starts_with(whole, NOT_PENDING), "push").when(has & ~single, "pop")
    x = once(x, kind=kind).where("kind IS NOT NULL")
    whole_rows = x.where(F.col("kind") == "row").where(~starts_with(F.col("label_norm"), NOT_ROWS))
    pairs = fifo_pairs(x.select("doc_id", "line_no", "kind"), "doc_id", "line_no", "kind")
    pushed = x.where(F.col("kind") == "push").select("doc_id", F.col("line_no").alias("push"), F.col("text").alias("_label"), F.col("page").alias("_page"))
    popped = x.where(F.col("kind") == "pop").select("doc_id", F.col("line_no").alias("pop"), "values", F.col("text").alias("_line"))
    late = pairs.join(dealt(pushed), ["doc_id", "push"]).join(dealt(popped), ["doc_id", "pop"])
    late = late.select("doc_id", F.col("pop").alias("line_no"), F.col("_label").alias("label"), statement_label(F.col("_label")).alias("label_norm"), "values", F.concat_ws(" ", "_label", "_line").alias("source_text"), F.col("_page").alias("page"))
    early = whole_rows.select("doc_id", "line_no", "label", "label_norm", "values", F.col("text").alias("source_text"), "page")
    return early.unionByName(late).withColumnRenamed("line_no", "row_no")


def field_value(values: Column) -> Column:
    """The value that stands for a row: the second of three or more if the first is under 100, else the first."""
    first = F.get(values, F.lit(0))
    return F.when((F.size(values) >= 3) & (F.abs(first) < 100), F.get(values, F.lit(1))).otherwise(first)


def find_row(row_table: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """One row per document with a struct(value, source_text, page) per field: of its first row whose label holds one of its names."""
    aggs = []
    for field, names in fields.items():
        hit = F.lit(False)
        for n in names:
            hit = hit | F.col("label_norm").contains(n)
        aggs.append(F.min_by(F.struct(field_value(F.col("values")).alias("value"), "source_text", "page"), F.when(hit, F.col("row_no"))).alias(field))
    return row_table.groupBy("doc_id").agg(*aggs)


def two_periods(values: Column) -> tuple[Column, Column]:
    """The current and the comparative value of a row with two or more, nulls for other rows; a schedule number in front goes."""
    first = F.get(values, F.lit(0))
    at = F.when((F.size(values) >= 3) & is_whole(first) & (F.abs(first) < 100), 1).otherwise(0)
    some = F.size(values) >= at + 2
    return F.when(some, F.get(values, at)), F.when(some, F.get(values, at + 1))


def comparative_periods(row_table: DataFrame) -> DataFrame:
    """(doc_id, row_no, label, current, comparative, source_text, page) of rows with two periods."""
    current, comparative = two_periods(F.col("values"))
    x = row_table.select("doc_id", "row_no", "label", current.alias("current"), comparative.alias("comparative"), "source_text", "page")
    return x.where("comparative IS NOT NULL")
