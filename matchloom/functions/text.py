"""String normalizers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.config import VENDOR_STOPWORDS

#: Unicode white space, as the normalizers understand it.
BLANKS = r"(?U)\s+"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_string(c: Column) -> Column:
    """Lower case, letters a-z, digits and single blanks; null becomes empty."""
    kept = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, BLANKS, " "))


def normalize_reference(c: Column) -> Column:
    """Upper case, letters A-Z and digits only; null becomes empty."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")


def normalize_vendor(c: Column, stopwords: tuple[str, ...] = VENDOR_STOPWORDS) -> Column:
    """The normalized string without company words; repeated words stay."""
    words = F.split(normalize_string(c), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*stopwords)), " ")
