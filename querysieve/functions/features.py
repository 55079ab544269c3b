"""The eight features of a query string.

``f0`` length, ``f1`` equal signs, ``f2`` WHERE, ``f3`` SELECT, ``f4`` UNION, ``f5`` single quotes, ``f6`` comment
signs, ``f7`` share of OR among the words.  All are column expressions over the normalised string, so any number of
them runs in one pass over the rows.

Word limits are ASCII (``[A-Za-z0-9_]``) and written as look-arounds, because what ``\\b`` means depends on the JVM.
Signs (quote, ``--``, ``#``) are counted in one of two ways: ``compat`` counts a sign between two word characters,
which is what a word limit on both sides of it asks for; ``literal`` counts every sign.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querysieve.functions.text import normalized

WORD = "[A-Za-z0-9_]"
SLOTS = [f"f{k}" for k in range(8)]
SIGNS = {"quote": "'", "comment": ("--", "#")}


def count_text(text: Column, part: str) -> Column:
    """Occurrences of a fixed string; none in null."""
    return F.coalesce((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part), F.lit(0.0)).cast("double")


def count_where(text: Column, part: str, pattern: str) -> Column:
    """Matches of a pattern that takes the fixed string ``part``: most strings don't hold it, which is seen without the pattern."""
    return F.when(~F.contains(text, F.lit(part)), F.lit(0.0)).otherwise(F.regexp_count(text, F.lit(pattern)).cast("double"))


def count_word(text: Column, word: str) -> Column:
    return count_where(text, word, f"(?<!{WORD}){word}(?!{WORD})")


def count_sign(text: Column, sign: str, boundary: str = "compat") -> Column:
    if boundary not in ("compat", "literal"):
        raise ValueError(f"boundary is compat or literal, not {boundary!r}")
    return count_where(text, sign, f"(?<={WORD}){sign}(?={WORD})" if boundary == "compat" else sign)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("double")


def or_share(text: Column) -> Column:
    """OR words per word; an empty string has one (empty) word."""
    return count_word(text, "OR") / F.size(F.split(text, r"[ \t\n\x0B\f\r]+"))


def has_text(text: Column, part: str) -> Column:
    return F.contains(text, F.lit(part)).cast("double")


def features(p: Column, parsed: Column | None = None, boundary: str = "compat") -> dict[str, Column]:
    """All slots of a normalised string ``p``.

    ``parsed`` is the canonical text of a statement that was recognised, null where it wasn't (or None: nobody tried).
    Recognised statements count ``=`` and SELECT in the canonical text and only ask whether it has WHERE and UNION;
    others count words in the string itself.
    """
    lexical = {"f1": count_text(p, "="), "f2": count_word(p, "WHERE"), "f3": count_word(p, "SELECT"), "f4": count_word(p, "UNION")}
    if parsed is not None:
        known = {"f1": count_text(parsed, "="), "f2": has_text(parsed, "WHERE"), "f3": count_word(parsed, "SELECT"), "f4": has_text(parsed, "UNION")}
        lexical = {slot: F.when(parsed.isNotNull(), known[slot]).otherwise(lexical[slot]) for slot in lexical}
    return {
        "f0": utf16_length(p),
        **lexical,
        "f5": count_sign(p, "'", boundary),
        "f6": count_sign(p, "--", boundary) + count_sign(p, "#", boundary),
        "f7": or_share(p),
    }


def with_features(df: DataFrame, raw: str = "raw_sql", boundary: str = "compat") -> DataFrame:
    """Adds ``p`` (the normalised string) and the eight slots."""
    df = df.withColumn("p", normalized(F.col(raw)))
    return df.withColumns(features(F.col("p"), boundary=boundary))


def vector() -> Column:
    """The slots as one array."""
    return F.array(*[F.col(s).cast("double") for s in SLOTS])
