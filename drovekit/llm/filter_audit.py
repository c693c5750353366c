"""Audit of how filters interact: failure masks, their histogram per part, and every order of the filters.

Each document gets a mask with a bit for each filter that it fails. What any order of the filters keeps, removes
or finds removed already depends on how many documents have each mask only, so a part is 32 cells, and the
120 orders are enumerated from these. Everything is native expressions; no text leaves the stage that reads it
but as its SHA-256, by which equal texts are grouped.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")


def text_mask(text: Column) -> Column:
    """The bits of the filters A to D, which see a text alone: too short, repetitive, capitals, symbols."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # the words are made once: a lambda's argument is a value, where an alias would be expanded again
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    short = F.when(sizes["n"] < 200, 1).otherwise(0)
    same = F.when(100 * sizes["d"].cast("long") < 50 * sizes["n"].cast("long"), 2).otherwise(0)
    capitals = F.when(100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"), 4).otherwise(0)
    symbols = F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)
    return short.bitwiseOR(same).bitwiseOR(capitals).bitwiseOR(symbols)


def masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, sha, mask) of each row, with the bits A to D; a null text or part is empty."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.encode("_text", "utf-8"), 256)).alias("sha"), text_mask(F.col("_text")).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): how many rows of a part have a mask, and how many of these a label 1.

    A row has the bit E if a row with a smaller doc_id has the same text, in whatever part and whatever else it fails.
    Rows with a null doc_id have no order: they never have it and give it to none. Rows that repeat a doc_id with
    one text have it alike. A document is good or toxic if any row of labels for its doc_id says 1; other
    values, missing labels and null ids count as not.
    """
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = masks(docs, part).join(marks, "doc_id", "left")
    one = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    # equal rows first: what follows is at most one row for each text, doc_id, part and label, however often they repeat
    rows = cut(rows.groupBy("sha", "doc_id", "part", "mask", one("good"), one("toxic")).agg(F.count("*").alias("n")), "masks")
    # of each text, part and label: all rows, and those of the least doc_id. These combine before the shuffle, so a text
    # that a third of all rows have leaves a task as one row a part and label.
    sides = rows.groupBy("sha", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unordered")
    )
    sides = cut(sides, "texts")
    first = cut(sides.groupBy("sha").agg(F.min("least").alias("first")), "first")
    joined = sides.join(first, "sha")
    fresh = F.coalesce(F.when(F.col("least") == F.col("first"), F.col("at")), F.lit(0)) + F.col("unordered")
    both = F.explode(F.array(F.struct(F.col("mask"), fresh.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(REPEAT)).alias("mask"), (F.col("n") - fresh).alias("n"))))
    out = joined.select("part", "good", "toxic", both.alias("c")).filter("c.n > 0")
    n = F.col("c.n")
    return out.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def orders(cells: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included, from the parts' cells.

    kept: after the step; removed: by it; redundant: failing its filter, but removed before; unique_fails: failing its
    filter alone; good_lost and toxic_lost: removed by it with that label; shapley: removed by its filter over all orders.
    No cells give no rows.
    """
    k, all_ = len(FILTERS), factorial(len(FILTERS))
    packed = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic").alias("c")))).alias("by_mask"))  # at most 32
    every = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    column = lambda c: F.transform(every, lambda m: F.coalesce(F.try_element_at("by_mask", m)[c], F.lit(0))).alias(c)
    arrays = packed.select("part", *(column(c) for c in ("n", "good", "toxic")))
    bits = {f: 1 << i for i, f in enumerate(FILTERS)}
    steps = [(o, i + 1, bits[f], sum(bits[x] for x in o[:i])) for o in permutations(FILTERS) for i, f in enumerate(o)]
    named = [F.struct(F.lit("".join(o)).alias("filter_order"), F.lit(i).alias("step"), F.lit(b).alias("bit"), F.lit(p).alias("prior")) for o, i, b, p in steps]
    rows = arrays.select("*", F.inline(F.array(*named)))
    fails, gone = (lambda m: m.bitwiseAND(F.col("bit")) != 0), (lambda m: m.bitwiseAND(F.col("prior")) != 0)
    over = lambda c, take, weight=lambda x, m: x: F.aggregate(F.transform(c, lambda x, m: F.when(take(m), weight(x, m)).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
    # of the orders, a mask's filter comes first among those that the mask fails in one of as many as it fails
    share = lambda x, m: x * F.floor(F.lit(all_) / F.bit_count(m))
    return rows.select(
        "part",
        "filter_order",
        "step",
        over("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        over("n", lambda m: fails(m) & ~gone(m)).alias("removed"),
        over("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        F.get("n", F.col("bit")).cast("long").alias("unique_fails"),
        over("good", lambda m: fails(m) & ~gone(m)).alias("good_lost"),
        over("toxic", lambda m: fails(m) & ~gone(m)).alias("toxic_lost"),
        over("n", fails, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of all rows of docs (doc_id, text and the part's column) with labels (doc_id, quality, toxic).

    Null texts are empty and fail A; texts of any length are seen whole; other columns don't matter, whatever
    their names. Empty tables of documents give no rows, as they have no part. See ``cells`` and ``orders``.
    """
    return orders(cells(docs, labels, part))
