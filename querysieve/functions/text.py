"""Normalising query strings: column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_empty(raw: Column) -> Column:
    return F.coalesce(raw, F.lit(""))


def url_decoded(raw: Column) -> Column:
    """Percent and plus decoding, all or nothing: one malformed escape leaves the whole string as it was."""
    return F.coalesce(F.try_url_decode(raw), raw)


def blanks_collapsed(text: Column) -> Column:
    """Runs of ASCII white space (tab to carriage return, and space) become one space."""
    return F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")


def trimmed(text: Column) -> Column:
    """Strips all characters up to U+0020 at both ends; wider blanks stay."""
    return F.regexp_replace(F.regexp_replace(text, r"^[\x00-\x20]+", ""), r"[\x00-\x20]+$", "")


def normalized(raw: Column) -> Column:
    """Null guard, URL decoding, upper case, blanks collapsed, ends trimmed; in this order."""
    return trimmed(blanks_collapsed(F.upper(url_decoded(or_empty(raw)))))
