"""Exact top-k by inner product: the three-phase uniform threshold algorithm.

A score is the sum of `lists` partial scores.  For each query the components are taken in the order
of its own magnitudes and dealt to the lists in that order, so the first lists hold most of
a score.  Vectors are rows in blocks, so the other partial scores of a reported vector are
at hand.

1. In every block only the first list is formed.  The k vectors that lead it for a query are
   completed; the k-th best of all these exact scores is a safe cutoff, since k vectors reach it.
2. The cutoff returns to the blocks with its query (it rides on the query blocks; a query set
   has no size bound, so it isn't one broadcast).  A vector of the result has a partial score
   of cutoff / lists or more in some list.  Lists are formed one after the other: a list that by
   the norms of both sides reports nothing at that uniform threshold is passed over, and a vector
   goes as soon as what it has, and the norms of what it lacks, cannot reach the cutoff.  A block
   whose norms cannot reach it is never multiplied.
3. What is left after half of the lists has its remaining scores resolved exactly; each block
   keeps k, and the k best of all blocks are the result, ties to the smaller vec_id.

Scores are integers: component x counts as floor(64 * x).  Products are exact in float64 while
every sum stays below 2^53; otherwise blocks are multiplied whole in 64-bit integers (which wrap
beyond 2^63).

Nulls and edge cases: vectors that are null, empty or hold null or non-finite components, and
rows with a null vec_id, take no part.  Every other row is a candidate of its own, also if it
repeats a vec_id; a query leaves out its own row only, and each query row gets its own ranks.
Vectors of other dimensions than the query's are no candidates.  With fewer candidates than k all
are returned.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as bl

LOWEST = -(1 << 63)


def _scaled(rows: np.ndarray) -> np.ndarray:
    return np.floor(64.0 * rows)


def _safe(q: np.ndarray, c: np.ndarray) -> bool:
    return bool(np.abs(q).max(initial=0.0) * np.abs(c).max(initial=0.0) * q.shape[1] < 2.0**52)


def _whole(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores of numbers too large for float64."""
    q, c = (np.clip(x, -(2.0**62), 2.0**62).astype(np.int64) for x in (q, c))
    return q @ c.T


class Block:
    """Candidates by component, for queries that take components in their own order."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows, self.parts = rows, np.ascontiguousarray(rows.T)
        self.squares = self.parts**2
        self.norm = np.sqrt(self.squares.sum(axis=0))

    def first(self, q: np.ndarray, lists: int) -> np.ndarray:
        """Partial scores of q's first list."""
        mine = dealt(q, lists)[0]
        return q[mine] @ self.parts[mine]

    def reach(self, q: np.ndarray, cutoff: float, lists: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows that reach the cutoff, their exact scores, partial scores that were formed)."""
        n, size = len(self.norm), float(np.sqrt((q**2).sum()))
        slack = 1e-9 * (abs(cutoff) + size * float(self.norm.max(initial=0.0))) if cutoff > -np.inf else 0.0
        if cutoff == -np.inf:
            return np.arange(n), self.rows @ q, n * lists
        if size * self.norm.max(initial=0.0) < cutoff - slack:
            return np.zeros(0, dtype=np.int64), np.zeros(0), 0
        groups = dealt(q, lists)
        threshold = cutoff / len(groups) - slack
        head = max(1, (len(groups) + 1) // 2)
        total, held, formed = np.zeros(n), np.zeros(n), 0
        collected = np.zeros(n, dtype=bool)
        for mine in groups[:head]:
            part = q[mine] @ self.parts[mine]
            formed += n
            total += part
            held += self.squares[mine].sum(axis=0)
            collected |= part >= threshold
        rest = np.sqrt(np.maximum(self.norm**2 - held, 0.0))
        left = float(np.sqrt(max(0.0, size**2 - sum((q[g] ** 2).sum() for g in groups[:head]))))
        # a list not formed can still report a vector at the uniform threshold if its norms allow it
        later = max((float(np.sqrt((q[g] ** 2).sum())) for g in groups[head:]), default=0.0)
        keep = np.flatnonzero((total + left * rest >= cutoff - slack) & (collected | (later * rest >= threshold)))
        formed += len(keep) * (len(groups) - head)
        score = self.rows[keep] @ q
        good = score >= cutoff
        return keep[good], score[good], formed


def dealt(q: np.ndarray, lists: int) -> list[np.ndarray]:
    """The components of each list: the largest of q first."""
    return np.array_split(np.argsort(-np.abs(q), kind="stable"), min(lists, len(q)))


def _local_lists(batches: Iterator[pa.RecordBatch], k: int, lists: int) -> Iterator[pa.RecordBatch]:
    """Phase 1: for each query of a block pair the exact scores of the k vectors that lead its first list."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            (q_nodes, _, q), (c_nodes, _, c) = (bl.arrays(row, side, row["dim"]) for side in "qc")
            q, c = _scaled(q), _scaled(c)
            safe, block, out = _safe(q, c), Block(c), []
            for j, node in enumerate(q_nodes):
                part = block.first(q[j], lists)
                take = min(k + 1, len(part))  # one more, in case the query itself is among them
                best = np.argpartition(part, len(part) - take)[-take:]
                best = best[c_nodes[best] != node]
                score = c[best] @ q[j] if safe else _whole(q[j : j + 1], c[best])[0]
                out.append((np.full(len(best), node), score.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["node", "score"])


def _resolved(batches: Iterator[pa.RecordBatch], k: int, lists: int) -> Iterator[pa.RecordBatch]:
    """Phases 2 and 3: the vectors that reach the cutoff, resolved, at most k of a block."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            (q_nodes, q_ids, q), (c_nodes, c_ids, c) = (bl.arrays(row, side, row["dim"]) for side in "qc")
            cutoffs = np.frombuffer(row["q_more"], dtype=np.int64)
            q, c = _scaled(q), _scaled(c)
            safe, block, out = _safe(q, c), Block(c), []
            for j, node in enumerate(q_nodes):
                if safe:
                    at, score, _ = block.reach(q[j], -np.inf if cutoffs[j] == LOWEST else float(cutoffs[j]), lists)
                else:
                    score = _whole(q[j : j + 1], c)[0]
                    at = np.flatnonzero(score >= cutoffs[j])
                    score = score[at]
                other = c_nodes[at] != node
                at, score = at[other], score[other].astype(np.int64)
                best = np.lexsort((c_ids[at], -score))[:k]
                out.append((np.full(len(best), node), np.full(len(best), q_ids[j]), c_ids[at[best]], score[best]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["node", "query_id", "vec_id", "score"])


def top_k(table: DataFrame, is_query: Column, k: int = 20, lists: int = 4, candidates: int = bl.CANDIDATES, queries: int = bl.QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of table(vec_id, embedding): for the rows that is_query marks, the k best others."""
    vectors = bl.known_vectors(table, keep_zero=True)
    asked = vectors.filter(is_query)
    packed = bl.blocks(vectors, candidates, "candidates")
    one = bl.paired(packed, bl.blocks(asked.repartition("node"), queries, "queries"))
    reported = one.mapInArrow(lambda it: _local_lists(it, k, lists), "node long, score long")
    best = Window.partitionBy("node").orderBy(F.col("score").desc())
    cut = reported.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).groupBy("node").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    cutoff = cut.select("node", F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(LOWEST)).alias("cutoff"))
    again = asked.join(cutoff, "node", "left").select("node", "vec_id", "v", F.coalesce("cutoff", F.lit(LOWEST)).alias("cutoff"))
    found = bl.paired(packed, bl.blocks(again.repartition("node"), queries, "cutoffs")).mapInArrow(lambda it: _resolved(it, k, lists), "node long, query_id long, vec_id long, score long")
    ranked = Window.partitionBy("node").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
