"""Label normalisation, similarity and text quality as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each computed once per row.

    A generator of one row stands between them and their uses, so the optimizer does not copy long
    expressions into every filter and column that reads them.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def dealt(df: DataFrame) -> DataFrame:
    """df for a join of lines or rows with others of theirs: both sides are dealt out by key and never sent whole.

    Lines come out of generators, whose rows the planner does not count: it takes millions of lines for the few bytes of
    the columns they were made of, and would send them through the driver to every executor.
    """
    return df.hint("merge")


def statement_label(c: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def field_label(c: Column) -> Column:
    """Lower case, without characters that labels do not have, white space as single spaces."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), r"[^a-z0-9\s&/()'-]", ""), r"\s+", " ")


def bigrams(c: Column) -> Column:
    """All neighbouring character pairs, repeats included; none for texts under two characters."""
    n = F.length(c)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: c.substr(i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def similarity(a: Column, b: Column) -> Column:
    """Twice the pairs of b that a has over the distinct pairs of both; pairs that b repeats count each time.

    1 for equal texts, 0 where either is shorter than two characters. Repeats in b can lift it above 1.
    """
    x, y = F.array_distinct(bigrams(a)), bigrams(b)
    shared = F.size(F.filter(y, lambda g: F.array_contains(x, g)))
    return F.when(a == b, F.lit(1.0)).when((F.length(a) < 2) | (F.length(b) < 2), F.lit(0.0)).otherwise(2.0 * shared / (F.size(x) + F.size(F.array_distinct(y))))


def quality_ratios(text: Column) -> dict[str, Column]:
    """Shares of printable and alphanumeric characters among those that are not white space, and their mean."""
    # what is left of the text, as a length: counting matches would build an array of them; white space is neither printable nor alphanumeric
    left = lambda t, without: F.length(F.regexp_replace(t, without, ""))
    kept = {"printable_ratio": r"[\p{C}\p{Z}]+", "alphanumeric_ratio": r"[^\p{L}\p{N}]+"}

    def ratio(*names: str) -> Column:
        shares = lambda t: let(F.length(t), lambda n: sum((F.when(n > 0, left(t, kept[k]) / n).otherwise(0.0) for k in names), F.lit(0.0)))
        return let(F.regexp_replace(text, r"(?U)\s+", ""), shares)

    return {k: ratio(k) for k in kept} | {"source_quality": F.round(ratio(*kept) / 2, 4)}


def route(document_type: Column, mode: str = "documented") -> Column:
    """Which statement extractor reads a type; what nothing names is read as an invoice."""
    t = F.translate(F.lower(F.coalesce(document_type, F.lit(""))), "- ", "__")
    pnl = t.contains("profit") | t.contains("pnl") | t.contains("loss")
    if mode == "documented":
        pnl = pnl | t.contains("income")
    return F.when(t.contains("invoice"), "invoice").when(t.contains("balance"), "balance_sheet").when(pnl, "profit_and_loss").when(t.contains("cash"), "cash_flow").otherwise("invoice")


def check_route(document_type: Column, mode: str = "documented") -> Column:
    """Which checks a type gets; null for types that nothing names."""
    t = F.translate(F.lower(F.coalesce(document_type, F.lit(""))), "- ", "__")
    named = t.contains("invoice") | t.contains("balance") | t.contains("profit") | t.contains("pnl") | t.contains("loss") | t.contains("cash")
    if mode == "documented":
        named = named | t.contains("income")
    return F.when(named, route(document_type, mode))


def schema_route(document_type: Column) -> Column:
    """Which field schema a type gets in the labelled-line reader; null if none."""
    t = F.trim(F.lower(F.coalesce(document_type, F.lit(""))))

    def has(*names: str) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | t.contains(n)
        return out

    return F.when(has("balance", "bs"), "Balance Sheet").when(has("income", "p&l", "profit", "pnl", "p & l"), "Income Statement").when(has("cash flow", "cashflow", "cf"), "Cash Flow Statement").when(has("invoice", "bill"), "Invoice")
