"""Dates and amounts out of text, as column expressions; what can't be parsed is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-digit years from here on belong to the last century.
PIVOT = 69
# The names of months; the first three letters stand for them too.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: What is cut off: white space on both sides, then commas behind.
ENDS = r"(?U)^\s+|(?:,+|,*\s+)$"
#: Years of two digits, in full.
CENTURIES = ((r"^(\d{1,2}/\d{1,2}/)((?:%d|[7-9]\d))$" % PIVOT, "$119$2"), (r"^(\d{1,2}/\d{1,2}/)(\d{2})$", "$120$2"))
#: Formats of digits to year-month-day; each group belongs to one of them. Day before month, unless that can't be.
DIGITS = r"^(?:(\d{1,2})/(1[3-9]|[2-9]\d)/(\d{4})|(\d{1,2})([-./])(\d{1,2})\5(\d{4})|(\d{4})/(\d{1,2})/(\d{1,2}))$"
ORDERED = "$3$7$8-$1$6$9-$2$4$10"
OTHER = r"^(?!(?!0000)\d{4}-\d{1,2}-\d{1,2}$)[\s\S]*$"
#: Formats with a month's name to day, month's first letters, year behind a mark.
NAME_FIRST = r"(?U)^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})$"
NAMED = r"(?iU)^(\d{1,2})\s+(?:" + "|".join(f"({m[:3]})(?:{m[3:]})?" for m in MONTHS) + r")\s+((?!0000)\d{4})$"
MARKED, FORMAT = "#$1 " + "".join(f"${k}" for k in range(2, 14)) + " $14", "'#'d MMM yyyy"


def parse_date(c: Column) -> Column:
    """A date out of any accepted format. Texts with letters take one way, all others another, each a short chain."""
    text = F.regexp_replace(c, ENDS, "")
    named = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, NAME_FIRST, "$2 $1 $3"), NAMED, MARKED), F.lit(FORMAT)).cast("date")
    for shape, order in CENTURIES:
        text = F.regexp_replace(text, shape, order)
    digits = F.regexp_replace(F.regexp_replace(text, DIGITS, ORDERED), OTHER, "").try_cast("date")
    return F.when(c.rlike("[A-Za-z]"), named).otherwise(digits)


def parse_amount(c: Column) -> Column:
    """Digits and the last dot; signs and all else are dropped."""
    kept = F.regexp_replace(c, "[^0-9.]", "")
    return F.regexp_replace(kept, r"\.(?=.*\.)", "").try_cast("double")
