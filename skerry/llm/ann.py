"""Approximate nearest neighbours by a hash-prefix forest (LSH Forest), Euclidean distance.

Rows are packed in blocks.  Each block's forest is built once and stored with it: for each of
`trees` trees every vector gets a string of `bits` sign bits of random projections (of the
vector less the block's mean), and the strings are kept as one sorted array with the rows they
belong to.  A query descends in all trees to its longest matching prefix, then ascends
synchronously, one bit in all trees at a time, until its prefix ranges hold `share` entries for
each row of the block.  The rows under more of its prefixes are the likelier neighbours: those of
the highest counts get exact distances: `examined` of the block (LEAST for each neighbour wanted, if
that is more) and all that tie with the last.  Each block keeps k, and the k nearest of all blocks are the result, ties to the smaller vec_id.

Every row is indexed; only the projections (a fixed seed) are data-independent.  Because a
forest covers one block of bounded size and every query visits every block, recall depends on
`trees`, `share` and `examined` but not on the number of rows, and work for a stated query set
grows with the rows.  Unit vectors of independent directions are a hard case; the
defaults are set on such data.

Nulls and edge cases: vectors that are null, empty, zero or hold null or non-finite components,
and rows with a null vec_id, take no part.  Every other row is a candidate of its own, also if it
repeats a vec_id; a query leaves out its own row only, and each query row gets its own ranks.
Vectors of other dimensions are no candidates.  With fewer candidates than k all are returned
(prefixes ascend to the root).  Squares beyond the largest double make a distance infinite, which
comes last.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as bl
from .scratch import materialize

TREES, BITS, SHARE, EXAMINED, LEAST, SEED = 192, 20, 4.0, 0.06, 24, 7


class Forest:
    """Sorted prefix arrays over the rows of one block."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> None:
        self.trees, self.bits, self.seed = trees, bits, seed
        with np.errstate(over="ignore", invalid="ignore"):
            self.center = np.nan_to_num(rows.mean(axis=0))
        codes = self.codes(rows)
        order = np.argsort(codes, axis=1, kind="stable")
        self.order, self.sorted = order.astype(np.int32), np.take_along_axis(codes, order, axis=1)

    @classmethod
    def of(cls, row: dict, trees: int, bits: int, seed: int = SEED) -> Forest:
        """The stored forest of a candidate block."""
        self = cls.__new__(cls)
        self.trees, self.bits, self.seed = trees, bits, seed
        self.center = np.frombuffer(row["c_center"], dtype=np.float64)
        self.order, self.sorted = (np.frombuffer(row[c], dtype=np.int32).reshape(trees, -1) for c in ("c_order", "c_sorted"))
        return self

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """(trees x rows) strings of `bits` bits as integers, the first bit on top."""
        planes = np.random.default_rng(self.seed).standard_normal((rows.shape[1], self.trees, self.bits))
        out = np.zeros((self.trees, len(rows)), dtype=np.int32)
        with np.errstate(over="ignore", invalid="ignore"):
            for b in range(self.bits):
                out = (out << 1) | ((rows - self.center) @ planes[:, :, b] > 0).T
        return out

    def candidates(self, queries: np.ndarray, share: float, examined: float, least: int) -> Iterator[np.ndarray]:
        """For each query the rows to examine, `least` or more (all, if there are fewer)."""
        codes, n, size = self.codes(queries), len(queries), self.sorted.shape[1]
        low, high = np.zeros((n, self.trees), dtype=np.int64), np.full((n, self.trees), size, dtype=np.int64)
        waiting = np.arange(n)
        for depth in range(self.bits, 0, -1):
            unit = 1 << (self.bits - depth)
            start = codes[:, waiting] // unit * unit
            lo = np.stack([np.searchsorted(self.sorted[t], start[t]) for t in range(self.trees)], axis=1)
            hi = np.stack([np.searchsorted(self.sorted[t], start[t] + unit) for t in range(self.trees)], axis=1)
            done = (hi - lo).sum(axis=1) >= max(share * size, self.trees * least)
            low[waiting[done]], high[waiting[done]] = lo[done], hi[done]
            waiting = waiting[~done]
            if not len(waiting):
                break
        wanted = min(size, max(LEAST * least, int(np.ceil(examined * size))))
        for q in range(n):
            met = np.bincount(np.concatenate([self.order[t, low[q, t] : high[q, t]] for t in range(self.trees)]), minlength=size)
            last = np.partition(met, size - wanted)[size - wanted]
            yield np.flatnonzero(met >= max(last, 1))


def _planted(batches: Iterator[pa.RecordBatch], trees: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Blocks with their forests."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            rows = np.frombuffer(one.column(4)[0].as_py(), dtype=np.float64).reshape(-1, one.column(0)[0].as_py())
            forest = Forest(rows, trees, bits)
            made = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (forest.center, forest.order, forest.sorted)]
            yield pa.RecordBatch.from_arrays([*one.columns, *made], names=[*one.schema.names, "center", "order", "sorted"])


def _nearest(batches: Iterator[pa.RecordBatch], k: int, trees: int, bits: int, share: float, examined: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            (q_nodes, q_ids, q), (c_nodes, c_ids, c) = (bl.arrays(row, side, row["dim"]) for side in "qc")
            out: list[tuple[np.ndarray, ...]] = []
            for j, at in enumerate(Forest.of(row, trees, bits).candidates(q, share, examined, k + 1)):
                at = at[c_nodes[at] != q_nodes[j]]
                with np.errstate(over="ignore"):
                    distance = np.sqrt(((c[at] - q[j]) ** 2).sum(axis=1))
                best = np.lexsort((c_ids[at], distance))[:k]
                out.append((np.full(len(best), q_nodes[j]), np.full(len(best), q_ids[j]), c_ids[at[best]], distance[best]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["node", "query_id", "vec_id", "score"])


def nearest(table: DataFrame, is_query: Column, k: int = 10, trees: int = TREES, bits: int = BITS, share: float = SHARE, examined: float = EXAMINED, candidates: int = bl.CANDIDATES, queries: int = bl.QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of table(vec_id, embedding): for the rows that is_query marks, the k nearest others found."""
    vectors = bl.known_vectors(table, keep_zero=False)
    packed = bl.blocks(vectors, candidates, "candidates")
    # one block a row, so that each forest is a piece of work of its own
    kind = ", ".join(f"{c} {t}" for c, t in packed.dtypes) + ", center binary, `order` binary, sorted binary"
    forests = materialize(packed.repartition(max(1, packed.count()), F.xxhash64("nodes")).mapInArrow(lambda it: _planted(it, trees, bits), kind), "forests")
    pairs = bl.paired(forests, bl.blocks(vectors.filter(is_query).repartition("node"), queries, "queries"))
    found = pairs.mapInArrow(lambda it: _nearest(it, k, trees, bits, share, examined), "node long, query_id long, vec_id long, score double")
    ranked = Window.partitionBy("node").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
