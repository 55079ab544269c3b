"""From feature slots to transaction items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The item numbers, and the slots and limits they stand for.
LONG, MANY_EQUALS, WHERE_ONCE, WHERE_MORE, SELECT_ONCE, SELECT_MORE = 1, 2, 3, 33, 4, 44
UNION_ONCE, UNION_MORE, MANY_QUOTES, COMMENT, MANY_ORS = 5, 55, 6, 7, 8
BENIGN, MALICIOUS = 100, 101
LIMITS = {"f0": 100, "f1": 3, "f5": 2, "f6": 0, "f7": 0.2}


def _once_or_more(slot: str, once: int, more: int) -> Column:
    return F.when(F.col(slot) == 1, once).when(F.col(slot) > 1, more)


def items() -> Column:
    """The items of a row with slots ``f0``..``f7``, in order of the slots; limits are strict."""
    over = lambda slot, item: F.when(F.col(slot) > LIMITS[slot], item)
    found = F.array(
        over("f0", LONG),
        over("f1", MANY_EQUALS),
        _once_or_more("f2", WHERE_ONCE, WHERE_MORE),
        _once_or_more("f3", SELECT_ONCE, SELECT_MORE),
        _once_or_more("f4", UNION_ONCE, UNION_MORE),
        over("f5", MANY_QUOTES),
        over("f6", COMMENT),
        over("f7", MANY_ORS),
    )
    return F.array_compact(found)


def with_label_item(own: Column, label: Column, stage: int) -> Column:
    """Stage 3 mines the label along; later stages must not see it."""
    if stage != 3:
        return own
    return F.concat(own, F.array(F.when(label == 1, MALICIOUS).otherwise(BENIGN)))
