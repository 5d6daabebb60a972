"""Anything tabular to a DataFrame, schema casts, and what to do with bad vectors."""

from __future__ import annotations

import typing
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PYTHON = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType(), bytes: T.BinaryType()}


def model_schema(model: type) -> T.StructType:
    """The schema of an annotated class (a pydantic model, a dataclass): Optional fields are nullable, lists arrays, classes structs."""

    def kind(hint) -> tuple[T.DataType, bool]:
        origin, args = typing.get_origin(hint), typing.get_args(hint)
        if type(None) in args:
            return kind(next(a for a in args if a is not type(None)))[0], True
        if origin in (list, tuple, set):
            return T.ArrayType(kind(args[0])[0] if args else T.StringType()), False
        if origin is dict:
            return T.MapType(kind(args[0])[0], kind(args[1])[0]), False
        if hint in _PYTHON:
            return _PYTHON[hint], False
        import datetime
        import decimal

        special = {datetime.date: T.DateType(), datetime.datetime: T.TimestampType(), decimal.Decimal: T.DecimalType(38, 18)}
        if hint in special:
            return special[hint], False
        if isinstance(hint, T.DataType):
            return hint, False
        if hasattr(hint, "__annotations__"):
            return model_schema(hint), False
        raise TypeError(f"no column type for {hint!r}")

    return T.StructType([T.StructField(name, *kind(hint)) for name, hint in typing.get_type_hints(model).items()])


def _dump(row) -> dict:
    return row.model_dump() if hasattr(row, "model_dump") else dict(row) if isinstance(row, Mapping) else {k: getattr(row, k) for k in row.__annotations__}


def to_frame(spark: SparkSession, data, schema: T.StructType | None = None) -> DataFrame:
    """A DataFrame of: DataFrame, list of dicts or models, pandas, Arrow table/batch/reader/dataset/scanner, polars, dict of tables (adds `split`), or an iterator of any of these."""
    if data is None:
        if schema is None:
            raise ValueError("an empty table needs a schema")
        return spark.createDataFrame([], schema)
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, pa.RecordBatch):
        data = pa.Table.from_batches([data])
    elif isinstance(data, pa.RecordBatchReader):
        data = data.read_all()
    elif isinstance(data, Mapping) and data and all(hasattr(v, "schema") or isinstance(v, DataFrame) or hasattr(v, "columns") for v in data.values()):
        parts = [to_frame(spark, v, schema).withColumn("split", F.lit(k)) for k, v in data.items()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out
    elif isinstance(data, Mapping):
        raise ValueError("a single row is not a table: use a list")
    elif hasattr(data, "collect") and type(data).__module__.startswith("polars"):
        data = data.collect().to_arrow()
    elif hasattr(data, "to_arrow") and not isinstance(data, pa.Table):
        data = data.to_arrow()
    elif hasattr(data, "to_table"):
        data = data.to_table()
    if isinstance(data, pa.Table):
        frame = spark.createDataFrame(data)
        return cast_to(frame, schema) if schema is not None else frame
    if hasattr(data, "iloc"):
        frame = spark.createDataFrame(data.reset_index(drop=True))
        return cast_to(frame, schema) if schema is not None else frame
    if hasattr(data, "model_dump"):
        raise ValueError("a single row is not a table: use a list")
    if isinstance(data, list):
        if not data and schema is None:
            raise ValueError("an empty list needs a schema")
        rows = [_dump(r) for r in data]
        if schema is None and data and not isinstance(data[0], Mapping) and hasattr(type(data[0]), "__annotations__"):
            schema = model_schema(type(data[0]))
        if schema is None:
            return spark.createDataFrame(pa.Table.from_pylist(rows))
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
    if isinstance(data, (Iterator, Iterable)):
        out = None
        for chunk in data:
            part = to_frame(spark, chunk, schema)
            out = part if out is None else out.unionByName(cast_to(part, out.schema))
        if out is None:
            raise ValueError("an empty iterator needs a schema")
        return out
    raise TypeError(f"cannot read rows from {type(data).__name__}")


def _cast(value: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return value
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        inner = {f.name: f.dataType for f in have}
        fields = [(_cast(value.getField(f.name), inner[f.name], f.dataType) if f.name in inner else F.lit(None).cast(f.dataType)).alias(f.name) for f in want]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value.cast(want)


def cast_to(frame: DataFrame, schema: T.StructType) -> DataFrame:
    """frame in the schema's order and types, structs by field; missing columns are null, unknown ones an error."""
    have = {f.name: f.dataType for f in frame.schema}
    unknown = set(have) - {f.name for f in schema}
    if unknown:
        raise ValueError(f"columns that the table doesn't have: {sorted(unknown)}")
    missing = [f.name for f in schema if f.name not in have and not f.nullable]
    if missing:
        raise ValueError(f"columns without a value that may not be null: {missing}")
    return frame.select(*[(_cast(F.col(f"`{f.name}`"), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def is_vector(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))


def vector_columns(schema: T.StructType) -> list[str]:
    """Columns named vector, or that say their dimension in their metadata."""
    return [f.name for f in schema if is_vector(f.dataType) and (f.name == "vector" or "dim" in f.metadata)]


def bad_vectors(frame: DataFrame, column: str, dim: int, policy: str = "error", fill_value: float = 0.0) -> DataFrame:
    """Vectors that are null, of another dimension or hold null or NaN: error, drop, fill (cut or padded to dim) or null."""
    v = F.col(f"`{column}`")
    hole = lambda x: x.isNull() | F.isnan(x)
    bad = v.isNull() | (F.size(v) != dim) | F.coalesce(F.exists(v, hole), F.lit(False))
    if policy == "error":
        checked = F.when(bad, F.raise_error(F.lit(f"bad vector in column {column}"))).otherwise(v)
    elif policy == "drop":
        return frame.filter(~bad)
    elif policy == "null":
        checked = F.when(~bad, v)
    elif policy == "fill":
        kind = frame.schema[column].dataType
        fill = F.lit(fill_value).cast(kind.elementType)
        whole = F.concat(F.coalesce(v, F.array().cast(kind)), F.array_repeat(fill, dim))
        checked = F.when(bad, F.transform(F.slice(whole, 1, dim), lambda x: F.when(hole(x), fill).otherwise(x))).otherwise(v)
    else:
        raise ValueError("policy is error, drop, fill or null")
    return frame.withColumn(column, checked.cast(frame.schema[column].dataType))


def flatten(frame: DataFrame, depth: int | None = None) -> DataFrame:
    """Structs as columns named a.b, down to `depth` levels (all if None)."""
    while depth is None or depth > 0:
        if not any(isinstance(f.dataType, T.StructType) for f in frame.schema):
            return frame
        columns: list[Column] = []
        for f in frame.schema:
            if isinstance(f.dataType, T.StructType):
                columns += [F.col(f"`{f.name}`").getField(g.name).alias(f"{f.name}.{g.name}") for g in f.dataType]
            else:
                columns.append(F.col(f"`{f.name}`"))
        frame = frame.select(*columns)
        depth = None if depth is None else depth - 1
    return frame


def to_ipc(frame: DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = frame.toArrow()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_ipc(spark: SparkSession, data: bytes) -> DataFrame:
    return spark.createDataFrame(pa.ipc.open_stream(data).read_all())


def held_partitions(data, cores: int) -> int | None:
    """How many files data held by the driver should be written as; None for what Spark holds."""
    if isinstance(data, (pa.Table, pa.RecordBatch)):
        return write_partitions(data.num_rows, data.nbytes, cores)
    if isinstance(data, pd.DataFrame):
        return write_partitions(len(data), int(data.memory_usage(deep=True).sum()), cores)
    return write_partitions(len(data), 0, cores) if isinstance(data, list) else None


def write_partitions(rows: int, size: int, cores: int) -> int:
    """How many files a write should have: a million rows or 2 GiB each, and no more than cores when that is more."""
    return max(1, min(max(-(-rows // 1_000_000), -(-size // (2 << 30))), max(cores, 1)))
