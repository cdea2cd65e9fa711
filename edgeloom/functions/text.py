"""Normalising identifiers and other short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Placeholder words that stand for a missing value, in lower case.
PLACEHOLDERS = ("", "none", "nan", "-", "n/a")

#: White space and marks without width that may surround a value.
BLANKS = r"[\s\u00a0\u00ad\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]"


def stripped(c: Column | str) -> Column:
    """Without outer blanks of any kind, tabs and zero-width marks included; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, rf"^{BLANKS}+|{BLANKS}+$", "")


def folded(c: Column | str) -> Column:
    """An identifier regardless of letter case and outer blanks; null stays null."""
    return F.lower(stripped(c))


def alnum_key(c: Column | str) -> Column:
    """Letters and digits in order, in lower case; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def given(c: Column | str) -> Column:
    """Neither null nor blank."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (stripped(c) != "")


def real_value(c: Column | str) -> Column:
    """The trimmed value, or null for null, blank and placeholder words in any case."""
    s = stripped(c)
    return F.when(~F.lower(s).isin(*PLACEHOLDERS), s)


def ensg_number(c: Column | str) -> Column:
    """The number of an ENSG identifier without leading zeros, null where there is none.

    Case, padding, a version after a dot, a prefix, separators and marks
    without width don't matter: ``ensembl:ensg-00000 744505.3`` gives 744505.
    """
    c = F.col(c) if isinstance(c, str) else c
    # The usual spelling needs no pattern.
    usual = F.when((F.length(c) == 15) & c.startswith("ENSG"), F.substring(c, 5, 11).try_cast("bigint"))
    packed = F.regexp_replace(F.lower(c), r"[^a-z0-9.]+", "")
    return F.when(usual >= 0, usual.cast("string")).otherwise(F.nullif(F.regexp_extract(packed, r"ensg\.?0*([0-9]+)", 1), F.lit("")))


def ensg(c: Column | str) -> Column:
    """An ENSG identifier as ``ENSG`` and the number in 11 digits."""
    n = ensg_number(c)
    return F.concat(F.lit("ENSG"), F.lpad(n, F.greatest(F.length(n), F.lit(11)), F.lit("0")))
