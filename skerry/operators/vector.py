"""Exact nearest rows by Arrow kernels: one query as a column and TakeOrdered, many in one pass that keeps k each.

Distances: l2 is squared; cosine is 1 - cos and rows or queries of length zero have none; dot is
1 - dot product; hamming counts the differing bits of packed bytes.  Rows without a distance
(null, NaN or other dimension) are no results.  Ties go to the smaller row id unless other columns are named.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distance as D

K = 10


def coerce(query) -> list:
    """A query vector, or list of them, of lists, numpy, Arrow or bytes as plain numbers."""
    if isinstance(query, (pa.Array, pa.ChunkedArray, pa.Scalar)):
        query = query.to_pylist() if not isinstance(query, pa.Scalar) else query.as_py()
    if isinstance(query, (bytes, bytearray)):
        return list(query)
    array = np.asarray(query)
    if array.dtype.kind not in "fiub" or array.ndim not in (1, 2) or not array.size:
        raise ValueError("a query vector is a list of numbers")
    return array.astype(float).tolist() if array.dtype.kind == "f" else array.tolist()


def is_many(query: list) -> bool:
    return bool(query) and isinstance(query[0], list)


def vector_column(schema: T.StructType, dim: int | None, name: str | None = None, depth: int = 3) -> str:
    """The named column, or the only vector column (in structs too) that could hold the query."""
    found: list[tuple[str, T.StructField]] = []

    def walk(struct: T.StructType, prefix: str, left: int) -> None:
        for f in struct:
            kind, path = f.dataType, prefix + f.name
            inner = kind.elementType.elementType if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType) else kind.elementType if isinstance(kind, T.ArrayType) else None
            if isinstance(inner, (T.FloatType, T.DoubleType)) or ("dim" in f.metadata and isinstance(kind, (T.BinaryType, T.ArrayType))):
                found.append((path, f))
            elif isinstance(kind, T.StructType) and left:
                walk(kind, path + ".", left - 1)

    walk(schema, "", depth)
    if name is not None:
        same = [p for p, _ in found if p == name] or [p for p, _ in found if p.lower() == name.lower()]
        if not same:
            raise ValueError(f"no vector column {name}")
        return same[0]
    fits = [p for p, f in found if dim is None or f.metadata.get("dim", dim) == dim]
    if len(fits) != 1:
        raise ValueError(f"{'no' if not fits else 'more than one'} vector column fits the query: {fits or [p for p, _ in found]}")
    return fits[0]


def field_of(schema: T.StructType, path: str) -> T.StructField:
    f: T.StructField | None = None
    for part in path.replace("`", "").split("."):
        f = (f.dataType if f is not None else schema)[part]
    return f


def with_distance(frame: DataFrame, column: str, query: list, metric: str, low: float | None = None, high: float | None = None, name: str = "_distance") -> DataFrame:
    """frame with the distance of each row; null where there is none or it isn't in low <= distance < high.

    Only the vector column goes through Arrow, once: what has no distance is null here rather than
    filtered, since a filter would be pushed down with a second evaluation.
    """
    kind = field_of(frame.schema, column).dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        d = D.late_interaction(F.col(column), query if is_many(query) else [query], metric)
        ok = F.col(name).isNotNull() & ~F.isnan(name)
        ok = ok if low is None else ok & (F.col(name) >= F.lit(float(low)))
        ok = ok if high is None else ok & (F.col(name) < F.lit(float(high)))
        return frame.withColumn(name, d).withColumn(name, F.when(ok, F.col(name)))
    if metric not in D.METRICS:
        raise ValueError(f"metric is one of {D.METRICS}")
    wanted = np.asarray([query], dtype=np.float64)

    @F.arrow_udf("double")
    def distance(v: pa.Array) -> pa.Array:
        at, rows = matrix(v, wanted.shape[1])
        out = np.full(len(v), np.nan)
        out[at] = distances(metric, rows, wanted)[0]
        if low is not None:
            out[out < low] = np.nan
        if high is not None:
            out[out >= high] = np.nan
        return pa.array(out, mask=np.isnan(out))

    return frame.withColumn(name, distance(F.col(column)))


def in_range(frame: DataFrame, low: float | None, high: float | None) -> DataFrame:
    if low is not None:
        frame = frame.filter(F.col("_distance") >= F.lit(float(low)))
    return frame if high is None else frame.filter(F.col("_distance") < F.lit(float(high)))


def nearest(frame: DataFrame, column: str, query: list, metric: str = "l2", k: int = K, offset: int = 0, low: float | None = None, high: float | None = None, tie: str | Sequence = "_rowid") -> DataFrame:
    """The k rows after the first `offset` nearest ones, with _distance, nearest first."""
    found = with_distance(frame, column, query, metric, low, high).orderBy(F.col("_distance").asc_nulls_last(), *([tie] if isinstance(tie, str) else tie))
    found = found.limit(k + offset).filter(F.col("_distance").isNotNull())
    return found.offset(offset) if offset else found


def distances(metric: str, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """(queries x rows) distances in float64; NaN where there is none."""
    if metric == "l2":
        # summed differences, not |a|^2 - 2ab + |b|^2, which loses digits for near rows
        return np.stack([((rows - q) ** 2).sum(axis=1) for q in queries])
    if metric == "hamming":
        a, b = rows.astype(np.uint8), queries.astype(np.uint8)
        return np.stack([np.unpackbits(a ^ q, axis=1).sum(axis=1) for q in b]).astype(float)
    product = queries @ rows.T
    if metric == "dot":
        return 1 - product
    size = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(size > 0, 1 - product / size, np.nan)


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows) of the vectors of a list column that have `dim` components, none null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        held = [(i, v.as_py()) for i, v in enumerate(column) if v.is_valid and len(v.as_py()) == dim]
        return np.array([i for i, _ in held], dtype=np.int64), np.array([np.frombuffer(v, np.uint8) for _, v in held], dtype=float).reshape(-1, dim)
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return at, flat.reshape(len(at), dim)


def nearest_of_many(frame: DataFrame, column: str, queries: Sequence[Sequence[float]], metric: str = "l2", k: int = K, low: float | None = None, high: float | None = None, id_column: str = "_rowid") -> DataFrame:
    """(query_index, id, _distance): each query's k nearest.  Every batch keeps k a query before anything moves."""
    wanted = np.asarray(queries, dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(wanted)
        for batch in batches:
            at, rows = matrix(batch.column(1), wanted.shape[1])
            ids = batch.column(0).to_numpy(zero_copy_only=False)[at]
            if not len(at):
                continue
            for i, d in enumerate(distances(metric, rows, wanted)):
                ok = ~np.isnan(d)
                if low is not None:
                    ok &= d >= low
                if high is not None:
                    ok &= d < high
                d, held = np.concatenate((best[i][0], d[ok])), np.concatenate((best[i][1], ids[ok]))
                keep = np.lexsort((held, d))[:k]
                best[i] = (d[keep], held[keep])
        for i, (d, held) in enumerate(best):
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), i, dtype=np.int32)), pa.array(held), pa.array(d)], names=["query_index", id_column, "_distance"])

    source = frame.select(F.col(id_column).cast("long"), F.col(column))
    found = source.mapInArrow(run, f"query_index int, {id_column} long, _distance double")
    order = Window.partitionBy("query_index").orderBy("_distance", id_column)
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")
