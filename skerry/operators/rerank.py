"""Rank fusion of result sets, as joins and aggregates over row ids.

A result set has _rowid and _distance (vector) or _score (text).  Every reranker returns the
rows with _relevance_score, best first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_ID, RELEVANCE = "_rowid", "_relevance_score"


def ranked(frame: DataFrame, column: str, descending: bool, base: int = 1, name: str = "_rank") -> DataFrame:
    """Ordinal ranks; ties go to the smaller row id.  Result sets are limited, so one window over one is small."""
    by = F.col(column).desc() if descending else F.col(column)
    return frame.withColumn(name, F.row_number().over(Window.orderBy(by, ROW_ID)) - 1 + base)


def normalized(frame: DataFrame, column: str) -> DataFrame:
    """Min-max to 0..1; when all are equal only the least is taken off."""
    whole = Window.partitionBy()
    low, high = F.min(column).over(whole), F.max(column).over(whole)
    return frame.withColumn(column, (F.col(column) - low) / F.when(high - low == 0, F.lit(1.0)).otherwise(high - low))


def as_rank(frame: DataFrame, column: str) -> DataFrame:
    """The column replaced by its ascending rank, from 1."""
    return ranked(frame, column, False, name="_r").withColumn(column, F.col("_r").cast("double")).drop("_r")


def merged(vector: DataFrame, text: DataFrame) -> DataFrame:
    """Both sets by row id: payload of the vector row first, _distance and _score null where a set lacks the row."""
    payload = [c for c in dict.fromkeys([*vector.columns, *text.columns]) if c not in (ROW_ID, "_distance", "_score")]
    pack = lambda df, side: df.select(ROW_ID, *[c for c in ("_distance", "_score") if c in df.columns], *[F.col(f"`{c}`").alias(f"__{side}{i}") for i, c in enumerate(payload) if c in df.columns])
    both = pack(vector, "a").join(pack(text, "b"), ROW_ID, "full_outer")

    def one(i: int, c: str) -> Column:
        sides = [f"__{s}{i}" for s in "ab" if f"__{s}{i}" in both.columns]
        return F.coalesce(*sides).alias(c)

    return both.select(ROW_ID, *[one(i, c) for i, c in enumerate(payload)], "_distance", "_score")


class Reranker:
    """return_score "relevance" drops _distance and _score, "all" keeps them."""

    def __init__(self, return_score: str = "relevance") -> None:
        if return_score not in ("relevance", "all"):
            raise ValueError("return_score is relevance or all")
        self.return_score = return_score

    def rerank_hybrid(self, query: str, vector: DataFrame, text: DataFrame) -> DataFrame:
        raise NotImplementedError

    def rerank_vector(self, query: str, vector: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} needs a vector and a text result")

    def rerank_text(self, query: str, text: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} needs a vector and a text result")

    def rerank_multivector(self, results: Sequence[DataFrame], query: str | None = None, deduplicate: bool = True) -> DataFrame:
        """Rerank several vector results as one: concatenated, the first of a row's appearances stays."""
        whole = None
        for i, r in enumerate(results):
            part = ranked(r, "_distance", False, name="_at").withColumn("_list", F.lit(i))
            whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
        if deduplicate:
            first = Window.partitionBy(ROW_ID).orderBy("_list", "_at")
            whole = whole.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
        return self.rerank_vector(query or "", whole.drop("_at", "_list"))

    def _finish(self, frame: DataFrame, score: Column) -> DataFrame:
        out = frame.withColumn(RELEVANCE, score)
        if self.return_score == "relevance":
            out = out.drop("_distance", "_score")
        return out.orderBy(F.col(RELEVANCE).desc(), ROW_ID)


def fused(results: Sequence[tuple[DataFrame, str, bool]], part: Callable[[int, Column], Column], base: int = 1) -> DataFrame:
    """(_rowid, _relevance_score): part(list number, rank) of every list, summed by row."""
    out = None
    for i, (frame, column, descending) in enumerate(results):
        one = ranked(frame.select(ROW_ID, column), column, descending, base).select(ROW_ID, part(i, F.col("_rank")).alias("_part"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(ROW_ID).agg(F.sum("_part").alias(RELEVANCE))


class RRF(Reranker):
    """Reciprocal rank fusion: the sum of 1 / (rank + k), ranks from rank_base."""

    def __init__(self, k: int = 60, rank_base: int = 1, return_score: str = "relevance") -> None:
        if k <= 0:
            raise ValueError("k must be positive")
        super().__init__(return_score)
        self.k, self.rank_base = k, rank_base

    def _part(self, i: int, rank: Column) -> Column:
        return 1.0 / (rank + F.lit(float(self.k)))

    def rerank_hybrid(self, query: str, vector: DataFrame, text: DataFrame) -> DataFrame:
        scores = fused([(vector, "_distance", False), (text, "_score", True)], self._part, self.rank_base)
        return self._finish(merged(vector, text).join(scores.withColumnRenamed(RELEVANCE, "_sum"), ROW_ID), F.col("_sum")).drop("_sum")

    def rerank_vector(self, query: str, vector: DataFrame) -> DataFrame:
        return self._finish(ranked(vector, "_distance", False, self.rank_base), self._part(0, F.col("_rank"))).drop("_rank")

    def rerank_text(self, query: str, text: DataFrame) -> DataFrame:
        return self._finish(ranked(text, "_score", True, self.rank_base), self._part(0, F.col("_rank"))).drop("_rank")

    def rerank_multivector(self, results: Sequence[DataFrame], query: str | None = None, deduplicate: bool = True) -> DataFrame:
        """The lists fused, each with ranks of its own."""
        return self._multi(results, self._part)

    def _multi(self, results: Sequence[DataFrame], part) -> DataFrame:
        scores = fused([(r, "_distance", False) for r in results], part, self.rank_base).withColumnRenamed(RELEVANCE, "_sum")
        whole = None
        for r in results:
            whole = r if whole is None else whole.unionByName(r, allowMissingColumns=True)
        first = Window.partitionBy(ROW_ID).orderBy("_distance")
        rows = whole.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
        return self._finish(rows.join(scores, ROW_ID), F.col("_sum")).drop("_sum")


class MRR(RRF):
    """Weighted reciprocal ranks: weight_vector / rank + weight_text / rank; of several vector results their mean."""

    def __init__(self, weight_vector: float = 0.5, weight_text: float = 0.5, return_score: str = "relevance") -> None:
        if abs(weight_vector + weight_text - 1) > 1e-6 or min(weight_vector, weight_text) < 0:
            raise ValueError("weights must be positive and sum to 1")
        super().__init__(return_score=return_score)
        self.weights = (weight_vector, weight_text)

    def _part(self, i: int, rank: Column) -> Column:
        return F.lit(float(self.weights[i])) / rank

    def rerank_vector(self, query: str, vector: DataFrame) -> DataFrame:
        return self._finish(ranked(vector, "_distance", False), 1.0 / F.col("_rank")).drop("_rank")

    def rerank_text(self, query: str, text: DataFrame) -> DataFrame:
        return self._finish(ranked(text, "_score", True), 1.0 / F.col("_rank")).drop("_rank")

    def rerank_multivector(self, results: Sequence[DataFrame], query: str | None = None, deduplicate: bool = True) -> DataFrame:
        return self._multi(results, lambda i, rank: F.lit(1.0 / len(results)) / rank)


class LinearCombination(Reranker):
    """weight * (1 - distance) + (1 - weight) * score; a row that one set lacks gets 1 - fill there."""

    def __init__(self, weight: float = 0.7, fill: float = 1.0, return_score: str = "relevance") -> None:
        if not 0 <= weight <= 1:
            raise ValueError("weight must be from 0 to 1")
        super().__init__(return_score)
        self.weight, self.fill = weight, fill

    def rerank_hybrid(self, query: str, vector: DataFrame, text: DataFrame) -> DataFrame:
        absent = F.lit(1.0 - self.fill)
        near = F.coalesce(1.0 - F.col("_distance"), absent)
        return self._finish(merged(vector, text), F.lit(self.weight) * near + F.lit(1.0 - self.weight) * F.coalesce("_score", absent))


class ModelReranker(Reranker):
    """Scores (query, text of a column) by a given function over a Series of texts; no model comes with this package."""

    def __init__(self, score: Callable[[str, pd.Series], pd.Series], column: str = "text", return_score: str = "relevance") -> None:
        super().__init__(return_score)
        self.score, self.column = score, column

    def _scored(self, query: str, frame: DataFrame) -> DataFrame:
        run = self.score

        @F.pandas_udf("double")
        def by_model(texts: pd.Series) -> pd.Series:
            return run(query, texts).astype(float)

        return self._finish(frame, by_model(F.col(self.column)))

    def rerank_hybrid(self, query: str, vector: DataFrame, text: DataFrame) -> DataFrame:
        return self._scored(query, merged(vector, text))

    def rerank_vector(self, query: str, vector: DataFrame) -> DataFrame:
        return self._scored(query, vector)

    def rerank_text(self, query: str, text: DataFrame) -> DataFrame:
        return self._scored(query, text)


def checked(frame: DataFrame) -> DataFrame:
    if RELEVANCE not in frame.columns:
        raise ValueError(f"a reranker must return {RELEVANCE}")
    return frame
