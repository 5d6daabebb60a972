"""Vectors packed in blocks, so that a stated query set meets all rows block by block.

A block is one row: node numbers, ids and a float64 matrix as binaries, of at most `size` vectors.
A node is a row of the table: rows that repeat a vec_id are nodes of their own, and none is dropped.
Which rows share a block follows the scan, never their values: copies of one vector spread like
any other rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

CANDIDATES, QUERIES, SPREAD, CELL_BLOCKS = 4096, 4096, 64, 16


def known_vectors(table: DataFrame, keep_zero: bool) -> DataFrame:
    """(node, vec_id, v array<double>) of each row of table(vec_id, embedding), written, without vectors that are null, empty, or hold null or non-finite components.

    node numbers the rows that stay; a null vec_id takes no part.
    """
    v = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(sound)
    if not keep_zero:
        found = found.filter(F.exists("v", lambda x: x != 0))
    return materialize(found.select(F.monotonically_increasing_id().alias("node"), "vec_id", "v"), "vectors")


def _pack(batches: Iterator[pa.RecordBatch], size: int, extra: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (node, vec_id, v, extra long columns...) to blocks of one dimension each."""
    held: dict[int, list] = {}

    def block(dim: int, parts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        values = [pa.array([dim], pa.int32()), pa.array([len(parts[0])], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]]
        return pa.RecordBatch.from_arrays(values, names=["dim", "n", "nodes", "ids", "rows", "more"])

    for batch in batches:
        lists = batch.column(2)
        dims = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        at = np.concatenate(([0], np.cumsum(dims)))[:-1]
        nodes, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        more = np.stack([batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(len(extra))], axis=1) if extra else np.zeros((len(ids), 0), dtype=np.int64)
        for dim in np.unique(dims):
            mine = np.flatnonzero(dims == dim)
            parts = held.setdefault(int(dim), [])
            parts.append((nodes[mine], ids[mine], flat[at[mine][:, None] + np.arange(dim)], more[mine]))
            if sum(len(p[0]) for p in parts) >= size:
                whole = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
                full = len(whole[0]) // size * size
                for k in range(0, full, size):
                    yield block(int(dim), tuple(x[k : k + size] for x in whole))
                held[int(dim)] = [tuple(x[full:] for x in whole)]
    for dim, parts in held.items():
        whole = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        if len(whole[0]):
            yield block(dim, whole)


def blocks(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks (dim, n, nodes, ids, rows, more) of vectors(node, vec_id, v, further long columns), written."""
    extra = vectors.columns[3:]
    return materialize(vectors.mapInArrow(lambda it: _pack(it, size, extra), "dim int, n int, nodes binary, ids binary, rows binary, more binary"), name)


def paired(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Each candidate block once with each query block of its dimension: q_* and c_* columns.

    The grid has a column for each query block, and so many lines that a cell holds CELL_BLOCKS
    candidate blocks or fewer.  A candidate block goes to every column of one line, a query
    block to every line of one column; a join on line and column brings each pair together in
    one place, and no cell holds a whole side.
    """
    columns, n = max(1, queries.count()), candidates.count()
    lines = max(1, min(n, max(SPREAD, -(-n // CELL_BLOCKS))))
    deal = lambda salt, many: F.pmod(F.xxhash64("nodes", F.lit(salt)), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    side = lambda frame, mark: [F.col(c).alias(f"{mark}_{c}") for c in frame.columns if c != "dim"]
    left = candidates.select("dim", every(columns).alias("column"), deal(1, lines).alias("line"), *side(candidates, "c"))
    right = queries.select("dim", deal(2, columns).alias("column"), every(lines).alias("line"), *side(queries, "q"))
    return left.join(right, ["dim", "column", "line"])


def arrays(row: dict, side: str, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, ids, rows) of one side of a pair of blocks."""
    nodes, ids = (np.frombuffer(row[f"{side}_{c}"], dtype=np.int64) for c in ("nodes", "ids"))
    return nodes, ids, np.frombuffer(row[f"{side}_rows"], dtype=np.float64).reshape(len(ids), dim)
