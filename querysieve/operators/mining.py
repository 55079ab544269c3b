"""Frequent itemsets of transactions (``items array<int>``, distinct items, any number of them).

Support counts non-empty transactions only, and an itemset is frequent from ``ceil(min_support x count)`` on.  Equal
transactions are one weighted row from the start.

Three miners give the same result.  ``itemsets`` is the one to use: where transactions are short (a query log has at most
a few hundred kinds) it lists their subsets, else it mines projected tables.  ``eclat`` intersects bitmaps of transactions,
level by level; ``fp_growth`` is Spark's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querysieve.operators.held import held

SUBSETS_UP_TO = 12  # items of a transaction whose subsets are listed: at most 4,095
IN_ONE_TASK = 1_000_000  # items of a projected table that one task mines
BROADCAST = 100_000  # candidate or frequent itemsets
WORDS = 16  # 64-bit words of a bitmap: a chunk is 1,024 transactions


def nonempty(transactions: DataFrame) -> DataFrame:
    return transactions.where(F.size("items") > 0)


def least_count(min_support: float, n: int) -> int:
    """A hair is taken off before rounding up: 0.1 x 30 is a bit over 3 in binary."""
    return max(1, -(-int(round(min_support * n * 1e9)) // 10**9))


def measured(rows: DataFrame, min_support: float) -> tuple[int, int]:
    """Of compressed transactions the least count of a frequent itemset, and the size of the longest one."""
    sizes = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max(F.size("items")), F.lit(0)).alias("longest")).first()
    return least_count(min_support, sizes["n"]), sizes["longest"]


def compressed(transactions: DataFrame) -> DataFrame:
    """Distinct non-empty transactions (items ascending) with their number: one scan and shuffle, combined before it.

    Rows with a ``weight`` stand for as many transactions.
    Held, as all miners read it several times.  Empty ones go by their aggregated size: a filter on the items themselves
    would be pushed down to the scan, with the whole chain that computes them.
    """
    weight = F.col("weight") if "weight" in transactions.columns else F.lit(1)
    rows = transactions.select(F.array_sort("items").alias("items"), weight.cast("long").alias("n")).groupBy("items").agg(F.sum("n").alias("n"), F.max(F.size("items")).alias("size"))
    return held(rows.where("size > 0").select("items", "n"))


def sent(few: DataFrame) -> DataFrame:
    """Held rows, an itemset each, to be joined by items: broadcast up to ``BROADCAST``, else all rows with an item would meet in one task."""
    return F.broadcast(few) if few.count() <= BROADCAST else few


def subsets(items: Column) -> Column:
    """All non-empty subsets of an ascending array, ascending."""
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size(items)) - 1).cast("int"))
    return F.transform(masks, lambda m: F.filter(items, lambda x, k: F.getbit(m, k) == 1))


def item_support(transactions: DataFrame) -> DataFrame:
    """item, freq."""
    return compressed(transactions).select(F.explode("items").alias("item"), "n").groupBy("item").agg(F.sum("n").alias("freq"))


def itemsets(transactions: DataFrame, min_support: float, subsets_up_to: int = SUBSETS_UP_TO, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """items, freq of all frequent itemsets.

    Transactions of up to ``subsets_up_to`` items list all their subsets; of longer ones the items that aren't frequent
    go first, and if any is still longer, projected tables are mined.
    """
    rows = compressed(transactions)
    least, longest = measured(rows, min_support)
    if longest <= subsets_up_to:
        return _listed(rows, least)
    rows = held(_by_frequency(rows, least))
    longest = rows.agg(F.coalesce(F.max(F.size("items")), F.lit(0))).first()[0]
    return _listed(rows.select(F.array_sort("items").alias("items"), "n"), least) if longest <= subsets_up_to else projected(rows, least, in_one_task)


def _listed(rows: DataFrame, least: int) -> DataFrame:
    return rows.select(F.explode(subsets(F.col("items"))).alias("items"), "n").groupBy("items").agg(F.sum("n").alias("freq")).where(F.col("freq") >= least)


def _by_frequency(rows: DataFrame, least: int) -> DataFrame:
    """Transactions of frequent items alone, the most frequent first (of equally frequent ones the smaller); equal ones are one row."""
    numbered = rows.withColumn("tid", F.monotonically_increasing_id())
    single = numbered.select("tid", "n", F.explode("items").alias("item"))
    frequent = single.groupBy("item").agg(F.sum("n").alias("freq")).where(F.col("freq") >= least)
    placed = single.join(sent(held(frequent)), "item").groupBy("tid").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("place"), "item"))).alias("items"))
    return placed.select(F.col("items.item").alias("items"), "n").groupBy("items").agg(F.sum("n").alias("n"))


def projected(rows: DataFrame, least: int, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """Itemsets of transactions in one common order of items, by projected tables.

    The table projected on an itemset holds, of every transaction with it, the items before it in the order.  A table of up
    to ``in_one_task`` items is mined by one task; a larger one gives the itemsets that are longer by one, and is projected
    on each of these.  So work is split by suffix until it fits, and no table is held whole that doesn't.
    """

    def mine(table: pa.Table) -> pa.Table:
        return _mine(table, least)

    tables, found = rows.select(F.array().cast("array<int>").alias("suffix"), "items", "n"), None
    while True:
        single = tables.select("suffix", F.explode("items").alias("item"), "n").groupBy("suffix", "item").agg(F.sum("n").alias("freq")).where(F.col("freq") >= least)
        single = held(single.select("suffix", "item", "freq"))
        grown = single.select(F.array_append("suffix", F.col("item")).alias("items"), "freq")
        found = grown if found is None else found.unionByName(grown)
        if single.isEmpty():
            break
        at = tables.select("suffix", "n", "items", F.posexplode("items").alias("at", "item")).where("at > 0")
        ahead = at.join(sent(single.select("suffix", "item")), ["suffix", "item"], "left_semi")
        deeper = ahead.select(F.array_append("suffix", F.col("item")).alias("suffix"), F.expr("slice(items, 1, at)").alias("items"), "n").groupBy("suffix", "items").agg(F.sum("n").alias("n"))
        deeper = held(deeper)
        sizes = held(deeper.groupBy("suffix").agg((F.sum(F.size("items")) <= in_one_task).alias("fits")))
        fitting = deeper.join(sent(sizes.where("fits").select("suffix")), "suffix", "left_semi")
        found = found.unionByName(fitting.groupBy("suffix").applyInArrow(mine, "items array<int>, freq long"))
        tables = deeper.join(sent(sizes.where("not fits").select("suffix")), "suffix", "left_semi")
    return found.select(F.array_sort("items").alias("items"), "freq")


def _mine(table: pa.Table, least: int) -> pa.Table:
    """One projected table: all frequent itemsets that extend its suffix, depth first over columns of transactions."""
    suffix, lists, n = table["suffix"][0].as_py(), table["items"].combine_chunks(), table["n"].to_numpy()
    items, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    names, which = np.unique(items, return_inverse=True)
    kept = np.flatnonzero(np.bincount(which, weights=n[row], minlength=len(names)) >= least)
    columns = []
    for k in kept:
        own = np.zeros(len(lists), bool)
        own[row[which == k]] = True
        columns.append((int(names[k]), own))
    sets: list[list[int]] = []
    counts: list[int] = []

    def extend(prefix: list[int], among: list[tuple[int, np.ndarray]]) -> None:
        for k, (item, own) in enumerate(among):
            sets.append([*prefix, item])
            counts.append(int(n[own].sum()))
            further = [(other, both) for other, theirs in among[k + 1 :] if n[both := own & theirs].sum() >= least]
            if further:
                extend([*prefix, item], further)

    extend(suffix, columns)
    return pa.table({"items": pa.array(sets, pa.list_(pa.int32())), "freq": pa.array(counts, pa.int64())})


def vertical(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compressed transactions as bitmaps, in chunks of 64 x ``WORDS``: (items, chunk, bits) of single items, and the weights.

    A transaction has a chunk, a word in it and a bit in that.  The weights are bitmaps too: plane ``b`` of a chunk has the
    transactions whose number has bit ``b``, so that any bitmap is counted by ``bit_count`` alone.
    """
    place = F.monotonically_increasing_id()
    rows = held(rows.select("items", "n", place.alias("place")))
    rows = rows.select("items", "n", F.expr(f"place div {64 * WORDS}").alias("chunk"), F.expr(f"cast(place % {64 * WORDS} div 64 as int)").alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit"))
    bits = F.array(*[F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bit"))), F.lit(0).cast("long")) for w in range(WORDS)]).alias("bits")
    single = rows.select("chunk", "word", "bit", F.explode("items").alias("item")).groupBy("item", "chunk").agg(bits)
    digits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda b: F.getbit(F.col("n"), b) == 1)
    planes = rows.select("chunk", "word", "bit", F.explode(digits).alias("plane")).groupBy("chunk", "plane").agg(bits)
    weights = planes.groupBy("chunk").agg(F.collect_list(F.struct("plane", "bits")).alias("planes"))
    return held(single.select(F.array("item").alias("items"), "chunk", "bits")), held(weights)


def weight(bits: Column, planes: Column) -> Column:
    """How many transactions a chunk's bitmap stands for."""
    one = lambda p: F.aggregate(F.zip_with(bits, p["bits"], lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, c: s + c)
    return F.aggregate(planes, F.lit(0).cast("long"), lambda s, p: s + F.call_function("shiftleft", one(p).cast("long"), p["plane"]))


def eclat(transactions: DataFrame, min_support: float) -> DataFrame:
    """The same by vertical bitmaps: an itemset is as many words as there are transactions, in chunks.

    Two itemsets that differ in their last item give one that is longer by one; its bitmap is theirs, word by word and
    chunk by chunk, and its support the bits that are left.  A chunk in which nothing is left isn't kept.
    """
    rows = compressed(transactions)
    least, longest = measured(rows, min_support)
    level, weights = vertical(rows)
    found = rows.select("items", F.col("n").alias("freq")).limit(0)
    for _ in range(longest):
        counted = held(level.join(weights, "chunk").groupBy("items").agg(F.sum(weight(F.col("bits"), F.col("planes"))).alias("freq")).where(F.col("freq") >= least))
        found = found.unionByName(counted)
        known = counted.select("items", F.expr("slice(items, 1, size(items) - 1)").alias("head"), F.element_at("items", -1).alias("tail"))
        left, right = (known.select("head", *[F.col(c).alias(f"{side}_{c}") for c in ("items", "tail")]) for side in ("left", "right"))
        longer = held(left.join(right, "head").where("left_tail < right_tail").select("left_items", "right_items", F.array_append("left_items", F.col("right_tail")).alias("items")))
        if not (n := longer.count()):
            break
        longer = F.broadcast(longer) if n <= BROADCAST else longer  # as in ``sent``
        one, other = (level.select(F.col("items").alias(f"{side}_items"), "chunk", F.col("bits").alias(f"{side}_bits")) for side in ("left", "right"))
        both = longer.join(one, "left_items").join(other, ["right_items", "chunk"])
        bits = F.zip_with("left_bits", "right_bits", lambda x, y: x.bitwiseAND(y))
        level = held(both.select("items", "chunk", bits.alias("bits")).where(F.exists("bits", lambda x: x != 0)))
    return found


def fp_growth(transactions: DataFrame, min_support: float) -> DataFrame:
    """The same by Spark's FP-Growth, whose own support counts every row: so only non-empty ones go in."""
    found = FPGrowth(itemsCol="items", minSupport=min_support).fit(nonempty(held(transactions.select("items")))).freqItemsets
    return found.select(F.array_sort("items").alias("items"), "freq")


def patterns(transactions: DataFrame, min_support: float) -> DataFrame:
    """The itemsets alone, single items included, in order of size and items."""
    return itemsets(transactions, min_support).select("items").orderBy(F.size("items"), "items")
