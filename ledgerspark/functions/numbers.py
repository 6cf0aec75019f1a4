"""Number parsing as Column expressions, in the two conventions that documents are read with.

amount() follows the statement reader: a double with two decimals. number_text() follows the labelled-line
reader: the digits as text, or null if they are no number. mode="documented" reads what is meant,
mode="compat" what the original conventions literally give.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Fixed values.
EMPTY_AMOUNTS = ["", "-", "—", "N/A", "n/a", "null", "None"]
#: One number in a line: optional parenthesis and sign, thousands groups, decimals.
NUMBER = {
    "compat": r"\(?-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\)?",
    "documented": r"\(?-?(?:\d{1,3}(?:,\d{2})*(?:,\d{3})+|\d+)(?:\.\d+)?\)?",
}
FLOAT = r"^[+-]?(?:\d++\.?+\d*+|\.\d++)$"
#: A number with nothing to take away, as most are.
DIGITS = r"^\d++(?:\.\d*+)?+\z"
#: A short number of two decimals at most, as most are, a currency sign before it or none: two decimals are left as they are.
QUICK = r"^[ \t]*+[₹$€£]?+[ \t]*+(\d{1,13}+(?:\.\d{0,2}+)?+)[ \t]*+\z"
UNITS = [
    ("Cr", ["Crore", "Crores", r"Cr\.?"]),
    ("Lakh", ["Lakh", "Lakhs", "Lac", "Lacs"]),
    ("Mn", ["Million", "Millions", r"Mn\.?", "MM"]),
    ("Bn", ["Billion", "Billions", r"Bn\.?"]),
    ("K", ["Thousand", "Thousands", "K"]),
]
#: White space of any script.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def at_end(pattern: str) -> str:
    """A pattern at the end of a text, with the blanks around it. A match can start at the first of a run of blanks only, so
    a text that holds long runs is looked through once."""
    return rf"(?<!\s)\s*+(?:{pattern})\s*+$"


def strip(c: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.trim(c, F.lit(BLANKS))


def currency(text: Column) -> Column:
    """The currency that a number names: dollar before rupee before euro before pound."""
    def has(*marks: str) -> Column:
        out = F.lit(False)
        for m in marks:
            out = out | text.contains(m)
        return out

    return F.when(has("$", "USD"), "USD").when(has("₹", "INR", "Rs"), "INR").when(has("€", "EUR"), "EUR").when(has("£", "GBP"), "GBP")


def amount(raw: Column, mode: str = "documented") -> Column:
    """A number in text as a double of two decimals; parentheses or a leading minus make it negative.

    Null for the empty marks and for anything that is no number once currency signs, commas, letters and
    white space are gone. "(-500)" is -500; in compat mode the two signs cancel.
    """
    def signed(text: Column) -> Column:
        paren = text.rlike(r"^\([^)]+\)$")
        minus = text.startswith("-")
        body = F.when(paren, F.substring(text, 2, F.length(text) - 2)).when(minus, F.substring(text, 2, 1 << 30)).otherwise(text)
        value = let(F.regexp_replace(body, r"(?U)[₹$€£\s,A-Za-z]", ""), lambda d: F.when(d.rlike(FLOAT), d.try_cast("double")))
        negative = (lambda v: -v) if mode == "compat" else (lambda v: F.when(paren, -F.abs(v)).otherwise(-v))
        return F.when(~text.isin(EMPTY_AMOUNTS), F.round(let(value, lambda v: F.when(paren | minus, negative(v)).otherwise(v)), 2))

    plain = lambda text: F.when(text.rlike(DIGITS), F.round(text.try_cast("double"), 2)).otherwise(signed(text))
    return let(F.regexp_extract(raw, QUICK, 1), lambda d: F.when(d != "", d.try_cast("double")).otherwise(let(strip(raw), plain)))


def number_pattern(mode: str = "documented") -> str:
    return NUMBER[mode]


def drop_thousands(c: Column) -> Column:
    """Without the commas that three digits and then a separator or the end follow."""
    return F.regexp_replace(c, r",(?=\d{3}(?:[,.\s)]|$))", "")


def parens_to_minus(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s*\(([^)]+)\)\s*$", "-$1")


def drop_currency(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[₹$€£¥]\s*", ""))


def drop_percent(c: Column) -> Column:
    return F.regexp_replace(c, at_end("%"), "")


def _unit(words: list[str]) -> str:
    return "(?i)" + at_end("|".join(words))


def unit(c: Column) -> Column:
    """The scale word that ends a number, if any; values are never scaled by it."""
    out = F.lit(None).cast("string")
    for name, words in reversed(UNITS):
        out = F.when(c.rlike(_unit(words)), name).otherwise(out)
    return out


def drop_unit(c: Column) -> Column:
    out = c
    for _, words in reversed(UNITS):
        out = F.when(c.rlike(_unit(words)), F.trim(F.regexp_replace(c, _unit(words), ""))).otherwise(out)
    return out


#: What counts as a number for the labelled-line reader, once cleaned, and what compat mode takes besides.
PLAIN_NUMBER = r"^[+-]?(?:\d++\.?+\d*+|\.\d++)(?:[eE][+-]?\d++)?+$"
ODD_NUMBER = r"^(?:[+-]?Infinity|0[xX][0-9a-fA-F]+)$"
INDIAN = r"^-?\d{1,2}(?:,\d{2})*,\d{3}(?:\.\d+)?$"


def number_text(raw: Column, mode: str = "documented") -> Column:
    """The cleaned digits of a number as text; null if they are none.

    Indian grouping ("1,23,456") counts as a number in documented mode and as none in compat mode, which
    takes "Infinity" and hexadecimal digits for numbers.
    """
    cleaned = F.trim(drop_percent(drop_unit(parens_to_minus(drop_currency(F.trim(raw))))))
    plain = drop_thousands(cleaned)
    if mode == "documented":
        plain = F.when(cleaned.rlike(INDIAN), F.regexp_replace(cleaned, ",", "")).otherwise(plain)
    plain = F.regexp_replace(plain, r"\s+", "")
    number = plain.rlike(PLAIN_NUMBER)
    if mode == "compat":
        number = number | plain.rlike(ODD_NUMBER)
    return F.when(~raw.isin("", "-", "—", "N/A", "n/a") & number, plain)


def looks_like_number(raw: Column) -> Column:
    cleaned = F.regexp_replace(drop_percent(drop_thousands(drop_currency(parens_to_minus(F.trim(raw))))), r"\s+", "")
    return F.coalesce(cleaned.rlike(PLAIN_NUMBER), F.lit(False))


def indian_format(value: Column) -> Column:
    """Digits grouped in lakh and crore style, two decimals at most, as dashboards print them."""
    whole = F.regexp_replace(F.format_string("%.0f", F.floor(F.abs(value)).cast("double")), r"(?<=\d)(?=(?:\d{2})*\d{3}$)(?!\d{3}$)|(?<=\d)(?=\d{3}$)", ",")
    cents = F.round((F.abs(value) - F.floor(F.abs(value))) * 100).cast("int")
    fraction = F.when(cents > 0, F.concat(F.lit("."), F.regexp_replace(F.lpad(cents.cast("string"), 2, "0"), "0$", ""))).otherwise("")
    return F.concat(F.when(value < 0, "-").otherwise(""), whole, fraction)
