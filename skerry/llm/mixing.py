"""Mixing sources to target weights, in DataFrame functions only.

Words are counted per document, summed per source (map-side combined, so a source with a
third of all rows is a few partial sums), and each source's repetition rate is its target
over its size.  A document is emitted floor(rate) times, and once more if a hash of the seed
and the document falls below the fraction.

Targets fill up like water: every source gets a share of the total by weight, none more than
`max_repeats` times its size, and what a full source cannot take is shared again by weight.
With caps c and weights w the result is min(c, level * w).  The level comes from running sums
over the sources in order of c / w: one window over one row a source, in exact integers.

Nulls and edge cases: a null text has size 0, as an empty one; a null source is a source of its
own and comes last; a null doc_id hashes as the empty string.  A source of size 0 has target 0
and takes no words.  Repeated rows are decided alike.  An empty table gives an empty result.
Other columns are kept; columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MAX_REPEATS, SEED = (5, 2, 1), 3, "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) of sizes(source, source_size): weights repeat over the sources in order of code points, null last."""
    if not weights or min(weights) <= 0 or max_repeats < 1:
        raise ValueError("weights must be positive and max_repeats at least 1")
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    known = sizes.withColumn("_w", weight).withColumn("_c", F.col("source_size") * max_repeats)
    # source a fills before b if c_a / w_a < c_b / w_b, compared as doubles and then by source: ties fill alike
    order = Window.orderBy(F.col("_c") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    known = known.withColumn("_total", F.sum("source_size").over(whole)).withColumn("_weights", F.sum("_w").over(whole))
    known = known.withColumn("_left", F.col("_total") - F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn("_open", F.col("_weights") - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    wide = lambda c: F.col(c).cast("double")
    level = F.when(wide("_c") * wide("_open") > wide("_left") * wide("_w"), wide("_left") / wide("_open"))
    # The first source that does not fill, the one with most weight still open, sets the level.
    first = F.min(F.when(level.isNotNull(), F.struct((-F.col("_open")).alias("o"), level.alias("level")))).over(whole)
    known = known.withColumn("_level", first["level"])
    cap = F.col("_c").cast("double")
    return known.select("source", "source_size", F.when(F.col("_level").isNull(), cap).otherwise(F.least(cap, F.col("_level") * F.col("_w").cast("double"))).alias("target"))


def chance(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to below 1 that depends on the seed and the document only."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED, size: Column | None = None) -> DataFrame:
    """docs with size, source_size, target and copies: how often each document is emitted, 0 included.

    size is the number of words of `text` unless a column of docs holds it already.
    """
    made = ("size", "source_size", "target", "copies")
    kept = [c for c in docs.columns if c.lower() not in made]
    words = word_count(F.col("text").cast("string")) if size is None else size.cast("long")
    # numbered names: no column of docs clashes with what is joined to it
    held = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(kept)], F.col("doc_id").alias("__doc"), F.col("source").alias("__of"), words.alias("__size"))
    sizes = held.groupBy(F.col("__of").alias("source")).agg(F.sum("__size").alias("source_size"))
    rates = targets(sizes, weights, max_repeats).select(F.col("source").alias("__source"), F.col("source_size").alias("__total"), F.col("target").alias("__target"))
    # written, so that its size is known when the join is planned: a few sources are broadcast, as many as hosts are not
    rates = materialize(rates, "rates")
    rate = F.when(F.col("__total") > 0, F.col("__target") / F.col("__total").cast("double")).otherwise(F.lit(0.0))
    extra = F.when(chance(F.col("__doc"), seed) < rate - F.floor(rate), 1).otherwise(0)
    joined = held.join(rates, F.col("__of").eqNullSafe(F.col("__source")))
    out = [F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"), (F.floor(rate) + extra).cast("long").alias("copies")]
    return joined.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(kept)], *out)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs `copies` times, with the columns of docs, whatever their names."""
    packed = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    planned = mix_plan(packed, **how).filter("copies > 0")
    return planned.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")
