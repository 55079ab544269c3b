"""Feature vectors as text and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_to_text(vector: Column) -> Column:
    """``[34.0, 1.0]``."""
    return F.concat(F.lit("["), F.array_join(vector.cast("array<string>"), ", "), F.lit("]"))


def text_to_vector(text: Column) -> Column:
    """Reads what ``vector_to_text`` writes; the empty text is a vector that was never computed (null)."""
    inner = F.regexp_replace(text, r"^\[|\]$", "")
    return F.when(F.length(F.trim(inner)) > 0, F.transform(F.split(inner, ",\\s*"), lambda x: x.cast("double")))
