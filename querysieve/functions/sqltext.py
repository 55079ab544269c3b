"""Whether a string looks like one SQL statement, and its canonical text: column expressions only.

No parser is rebuilt here.  A statement is recognised by how it opens and closes: a known opening, quotes and brackets
in pairs, no second statement after a semicolon, no operator or clause left open, and no more WHERE than
SELECT.  What a full multi-dialect parser accepts can't be reproduced so; both branches of the features are therefore
usable with any accept flag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querysieve.functions.text import blanks_collapsed, trimmed

# What a comment is (texts in quotes are kept), how statements open, and operators and clauses that nothing follows.
COMMENTS = r"(?s)('[^']*')|--.*|/\*.*?\*/"
TEXTS = "'[^']*'"
OPENINGS = r"(?s)^(SELECT .|INSERT INTO .|UPDATE .+ SET .|DELETE FROM .|CREATE .|DROP .|ALTER .)"
LEFT_OPEN = r"([=<>,+/]|\b(FROM|WHERE|AND|OR|BY|SET|SELECT|UNION|ALL|HAVING|LIKE|IN|JOIN|ON|INTO|VALUES)) ?($|\)|\b(FROM|WHERE|GROUP|ORDER|HAVING|UNION|AND|OR)\b)"


def canonical(p: Column) -> Column:
    """The string without comments and without a semicolon at its end, in single spaces."""
    return F.regexp_replace(trimmed(blanks_collapsed(F.regexp_replace(p, COMMENTS, "$1"))), " ?;$", "")


def recognised(p: Column) -> Column:
    """Canonical text of normalised strings, null where none is recognised."""
    text = canonical(p)
    bare = F.regexp_replace(text, TEXTS, "?")
    count = lambda what: F.regexp_count(bare, F.lit(what))
    closed = ~F.contains(bare, F.lit("'")) & (count(r"\(") == count(r"\)")) & ~F.contains(bare, F.lit(";"))
    ends = ~bare.rlike(LEFT_OPEN) & (count(r"\bWHERE\b") <= F.greatest(count(r"\bSELECT\b"), F.lit(1)))
    return F.when(bare.rlike(OPENINGS) & closed & ends, text)
