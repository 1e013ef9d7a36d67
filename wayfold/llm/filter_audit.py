"""Audit of five filters in every order, by a Walsh-Hadamard transform.

Each document fails some of five filters, which makes a mask of five bits:

* A: under 200 words (maximal runs of anything but white space);
* B: 100 * distinct words < 50 * words;
* C: 100 * capital letters A-Z > 3 * code points;
* D: holds one of ``#$%&*|``;
* E: its text is that of a document with a smaller id, anywhere in the table.

1. *Masks.* A to D come from the text alone. For E, rows are counted by digest
   of the text (SHA-256), part and label; these counts combine before they
   move, so a text with very many copies arrives as a few rows. All but the
   least id of a text fail E.
2. *Sums.* Each part and label (quality 1, toxic 1, both, neither) gets 32
   signed sums: for each set of filters the documents that fail an even number
   of them less those that fail an odd number.
3. *Inverse.* The transform is its own inverse up to 1/32, in whole numbers, so
   the sums give the number of documents of each mask exactly.
4. *Orders.* All 120 orders are evaluated from the masks. A document that fails
   k filters is removed by each of them in 120/k orders, which gives the sum
   over all orders (the Shapley value) in closed form.

What reaches a single task is 32 sums for each part, label and input task.

A null text counts as empty, a null part as the empty string. A null id is
smaller or larger than no other: such a row never fails E and makes none fail
it. Rows that repeat an id count each; of equal texts all rows that hold the
least id pass E. Labels that repeat an id count once: quality or toxic is 1 if
any of them says so. Parts without documents have no rows; an empty table gives
an empty result. Other columns are ignored. Texts of any length are taken whole.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = 120
SPACE = "[\\x20\\x09-\\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LABELS = ("good", "toxic")


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D."""
    sizes = lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct"))
    # Lambdas, so that the words of a text are made once.
    counted = F.transform(F.array(F.array_remove(F.split(text, SPACE), "")), sizes)
    by_words = lambda n: F.when(n["words"] < 200, 1).otherwise(0) + F.when(n["distinct"].cast("long") * 100 < n["words"].cast("long") * 50, 2).otherwise(0)
    letters = F.length(text).cast("long")
    capitals = letters - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    by_letters = F.when(capitals * 100 > letters * 3, 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
    return F.transform(counted, by_words)[0] + by_letters


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows (part, good, toxic, mask, n): documents of a part and label that fail exactly the filters of a mask; partly summed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text_failures(text).alias("mask"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
    marks = marks.agg(*(F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(n) for c, n in zip(("quality", "toxic"), LABELS)))
    rows = rows.join(marks, "id", "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in LABELS})
    # One row for each id first, where the join has put it; then one for each text, part and label.
    alike = ["digest", "mask", "part", *LABELS]
    each = rows.groupBy("id", *alike).agg(F.count("*").alias("n"))
    of_text = each.groupBy(*alike).agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless")
    )
    first = F.min("least").over(Window.partitionBy("digest"))  # a row for each part and label that has the text
    passing = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), passing.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passing).alias("n")))
    return of_text.withColumn("first", first).select("part", *LABELS, F.inline(both)).where("n > 0")


def signed_sums(counts: DataFrame, by: list[str]) -> DataFrame:
    """For each group an array of 32 sums: the documents that fail an even number of a set's filters less the others."""
    sign = lambda s: F.lit(1) - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2)
    sums = counts.groupBy(*by).agg(*(F.sum(F.col("n") * sign(s)).alias(f"w{s}") for s in range(MASKS)))
    return sums.select(*by, F.array(*(F.col(f"w{s}") for s in range(MASKS))).alias("sums"))


def inverse(sums: str) -> Column:
    """The number of documents of each mask, from the signed sums."""
    term = f"{sums}[CAST(s AS INT)] * (1 - 2 * (bit_count(s & m) % 2))"
    return F.expr(f"transform(sequence(0, {MASKS - 1}), m -> aggregate(sequence(0, {MASKS - 1}), 0L, (a, s) -> a + {term}) div {MASKS})")


def _orders() -> Column:
    """A row for each order."""
    return F.explode(F.array(*(F.lit("".join(p)) for p in permutations(FILTERS))))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    sums = signed_sums(failure_counts(docs, labels, id_col, text_col, part_col), ["part", *LABELS])
    of_label = {"cells": F.lit(True), "good_cells": F.col("good"), "toxic_cells": F.col("toxic")}
    total = lambda of: F.array(*(F.sum(F.when(of, F.col("sums")[s]).otherwise(0)) for s in range(MASKS)))
    parts = sums.groupBy("part").agg(*(total(of).alias(name) for name, of in of_label.items()))
    parts = parts.select("part", *(inverse(name).alias(name) for name in of_label))
    steps = parts.withColumn("filter_order", _orders()).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda k: f"CAST(shiftleft(1, instr('{FILTERS}', substr(filter_order, {k}, 1)) - 1) AS INT)"
    earlier = " + ".join(f"IF(step > {k}, {bit(k)}, 0)" for k in range(1, len(FILTERS)))
    steps = steps.withColumns({"own": F.expr(bit("step")), "before": F.expr(earlier)})
    over = lambda of, test: F.expr(f"aggregate(sequence(0, {MASKS - 1}), 0L, (a, m) -> a + IF({test}, {of}, 0L))")
    first = "(m & own) != 0 AND (m & before) = 0"
    return steps.select(
        "part", "filter_order", "step",
        over("cells[m]", "(m & (own | before)) = 0").alias("kept"),
        over("cells[m]", first).alias("removed"),
        over("cells[m]", "(m & own) != 0 AND (m & before) != 0").alias("redundant"),
        F.expr("cells[own]").alias("unique_fails"),
        over("good_cells[m]", first).alias("good_lost"),
        over("toxic_cells[m]", first).alias("toxic_lost"),
        over(f"cells[m] * ({ORDERS} div greatest(bit_count(m), 1))", "(m & own) != 0").alias("shapley"),
    )
