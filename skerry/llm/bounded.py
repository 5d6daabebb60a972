"""Thresholds that keep what travels below a stated size, whatever the corpus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 16  # steps of the threshold for each doubling of the weight


def threshold(rows: DataFrame, weight: Column, size: Column, least: float, most: int) -> float:
    """The lowest of the thresholds least * 2^(i / STEPS) at which rows of that weight or more have sizes of `most` at most in sum.

    One aggregation to a histogram of the steps; i is 0 wherever everything fits.
    """
    step = F.floor(F.log2(weight / F.lit(float(least))) * STEPS).cast("int")
    found = rows.filter(weight >= least).groupBy(step.alias("step")).agg(F.sum(size).alias("n")).orderBy(F.col("step").desc()).collect()
    total = np.cumsum([r.n for r in found])
    if not len(total) or total[-1] <= most:
        return float(least)
    fits = int((total <= most).sum())
    return float(least) * 2 ** ((found[fits].step + 1) / STEPS)
