"""Packing by optimal length buckets.

1. Rows are written once with their length (words of the whole text) and a number of their own.  The
   global histogram of lengths is one aggregation over that table; it has a row for each
   length that occurs, and comes to the driver as two columns of numbers.
2. A dynamic program over the lengths picks at most `buckets` boundaries that minimise the
   padding (sum of boundary minus length).  Its cost satisfies the quadrangle inequality, so
   each layer is solved by divide and conquer, level by level, in O(n log n).
3. A document goes to the bucket of the least boundary that holds it; a batch of a bucket with
   boundary b holds floor(budget / b) documents (one at least).  Places in a bucket come from
   two-level numbering: rows are dealt to cells by a hash of their number (there are as many cells
   as the row count asks for, and rows of equal content spread like any others), numbered inside
   their cell, and shifted by the running sum of the cell counts.  A bucket that holds most rows
   is still many cells.  Batches are filled to the last.

Nulls and edge cases: a null or wordless text has length 0 and packs into the first bucket
(an all-empty table has one bucket of boundary 0).  A document longer than the budget is a batch
of its own.  Repeated rows are packed as often as they occur.  An empty table gives an empty
result.  Other columns are kept; columns named like a result column are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import word_count
from .scratch import materialize

BUCKETS, BUDGET, CELL_ROWS = 16, 65_536, 50_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """At most `buckets` of the ascending lengths, the last included, that minimise sum(count * (boundary - length))."""
    n = len(lengths)
    if n == 0:
        return []
    number = np.concatenate(([0], np.cumsum(counts))).astype(np.float64)
    tokens = np.concatenate(([0], np.cumsum(np.asarray(counts, dtype=np.float64) * lengths)))
    top = np.asarray(lengths, dtype=np.float64)

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Padding of classes i..j-1 in one bucket."""
        return top[j - 1] * (number[j] - number[i]) - (tokens[j] - tokens[i])

    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    choice: list[np.ndarray] = []
    for _ in range(min(buckets, n)):
        new, arg = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        lo, hi, a, b = (np.array([x]) for x in (1, n, 0, n - 1))  # classes lo..hi take their best split from a..b
        while len(lo):
            j = (lo + hi) // 2
            many = np.minimum(b, j - 1) - a + 1
            heads = np.cumsum(many) - many
            i = np.arange(many.sum()) - np.repeat(heads - a, many)
            value = best[i] + cost(i, np.repeat(j, many))
            least = np.minimum.reduceat(value, heads)
            first = np.flatnonzero(value == np.repeat(least, many))
            owner = np.searchsorted(heads, first, side="right") - 1
            at = i[first[np.searchsorted(owner, np.arange(len(j)))]]
            new[j], arg[j] = least, at
            lo, hi, a, b = np.concatenate((lo, j + 1)), np.concatenate((j - 1, hi)), np.concatenate((a, at)), np.concatenate((at, b))
            some = lo <= hi
            lo, hi, a, b = lo[some], hi[some], a[some], b[some]
        choice.append(arg)
        if new[n] >= best[n]:
            choice.pop()
            break
        best = new
    out, j = [], n
    for arg in reversed(choice):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(arg[j])
    return sorted(out)


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, cell_rows: int = CELL_ROWS, length: Column | None = None) -> DataFrame:
    """docs with length, bucket (from 0), bucket_length, batch (from 0 in each bucket) and place (from 0 in each batch).

    length is the number of words of `text` unless a column of docs holds it already.
    """
    made = ("length", "bucket", "bucket_length", "batch", "place")
    kept = [c for c in docs.columns if c.lower() not in made]
    counted = word_count(F.col("text").cast("string")) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    # numbered names: no column of docs clashes with a helper
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(kept)], counted.cast("long").alias("length"), F.xxhash64(F.monotonically_increasing_id()).alias("row"))
    measured = materialize(rows, "lengths")
    histogram = measured.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").toArrow()
    lengths, counts = (histogram.column(c).to_numpy() for c in (0, 1))
    bounds = boundaries(lengths, counts, buckets)
    cells = max(1, -(-int(counts.sum()) // cell_rows))

    bucket = F.coalesce(*[F.when(F.col("length") <= b, i) for i, b in enumerate(bounds)], F.lit(max(len(bounds) - 1, 0)))
    bound = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds or [0]]), F.col("bucket") + 1)
    dealt = measured.withColumn("bucket", bucket).withColumn("bucket_length", bound).withColumn("cell", F.pmod(F.col("row"), F.lit(cells)))
    sums = dealt.groupBy("bucket", "cell").agg(F.count("*").alias("n"))
    shift = sums.select("bucket", "cell", (F.sum("n").over(Window.partitionBy("bucket").orderBy("cell")) - F.col("n")).alias("shift"))
    numbered = dealt.withColumn("at", F.row_number().over(Window.partitionBy("bucket", "cell").orderBy("row")) - 1)
    placed = numbered.join(shift, ["bucket", "cell"]).withColumn("at", F.col("at") + F.col("shift"))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("long")
    return placed.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(kept)], "length", "bucket", "bucket_length", F.floor(F.col("at") / room).alias("batch"), (F.col("at") % room).alias("place"))
