"""Python functions as columns, and embedding functions by name."""

from __future__ import annotations

import datetime
import decimal
import inspect
import typing
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python types and the column types they stand for.
PYTHON_TYPES = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(), datetime.date: T.DateType(), datetime.datetime: T.TimestampType(), decimal.Decimal: T.DecimalType(38, 18)}


def column_type(hint) -> T.DataType:
    if isinstance(hint, T.DataType):
        return hint
    if isinstance(hint, str):
        return T._parse_datatype_string(hint)
    if typing.get_origin(hint) in (list, Sequence):
        return T.ArrayType(column_type(typing.get_args(hint)[0]))
    if hint in PYTHON_TYPES:
        return PYTHON_TYPES[hint]
    if isinstance(hint, type) and hasattr(hint, "__annotations__"):
        return T.StructType([T.StructField(n, column_type(h)) for n, h in typing.get_type_hints(hint).items()])
    raise TypeError(f"no column type for {hint!r}")


@dataclass(frozen=True)
class Function:
    """A registered function; calling it with columns (names or Columns) gives a Column."""

    name: str
    version: int
    call: Callable
    inputs: tuple[str, ...]
    output: T.DataType
    vectorized: bool
    names: dict | None = None  # new names of the fields of a struct output

    def rename(self, **names: str) -> Function:
        if not isinstance(self.output, T.StructType) or set(names) - set(self.output.fieldNames()):
            raise ValueError("only fields of a struct output can be renamed")
        return replace(self, names=names, output=T.StructType([T.StructField(names.get(f.name, f.name), f.dataType) for f in self.output]))

    def __call__(self, *columns: str | Column, **named: str | Column) -> Column:
        args = [*columns, *[named[i] for i in self.inputs[len(columns) :]]]
        if len(args) != len(self.inputs):
            raise TypeError(f"{self.name} takes {len(self.inputs)} columns")
        run, fields, single, names = self.call, isinstance(self.output, T.StructType), not self.vectorized, self.names

        def over(*series):
            if not single:
                out = run(*series)
            else:
                rows = [None if any(v is None for v in row) else run(*row) for row in zip(*[s.tolist() for s in series], strict=True)]
                out = pd.DataFrame([r if r is not None else {} for r in rows]) if fields else pd.Series(rows, dtype=object)
            return out.rename(columns=names) if names else out

        hint = pd.DataFrame if fields else pd.Series
        parameters = [inspect.Parameter(f"a{i}", inspect.Parameter.POSITIONAL_ONLY, annotation=pd.Series) for i in range(len(args))]
        over.__signature__ = inspect.Signature(parameters, return_annotation=hint)
        over.__annotations__ = {p.name: pd.Series for p in parameters} | {"return": hint}
        return F.pandas_udf(over, returnType=self.output)(*[F.col(a) if isinstance(a, str) else a for a in args])


FUNCTIONS: dict[str, list[Function]] = {}


def udf(function: Callable | None = None, *, name: str | None = None, returns=None, vectorized: bool = False):
    """Register a Python function with typed arguments as a column function; a name registered again gets a new version.

    A null in any argument gives null unless the function is vectorized (Series in, Series out).
    """

    def make(f: Callable) -> Function:
        hints = typing.get_type_hints(f)
        output = returns if returns is not None else hints.get("return")
        if output is None or output is type(None):
            raise TypeError(f"{f.__name__} needs a return type")
        if type(None) in typing.get_args(output):
            raise TypeError("the output may not be optional")
        held = FUNCTIONS.setdefault(name or f.__name__, [])
        made = Function(name or f.__name__, len(held) + 1, f, tuple(inspect.signature(f).parameters), column_type(output), vectorized)
        held.append(made)
        return made

    return make if function is None else make(function)


def get_function(name: str, version: int | None = None) -> Function:
    held = FUNCTIONS.get(name)
    if not held:
        raise ValueError(f"no function {name}")
    return held[-1 if version is None else version - 1]


# -- embeddings ------------------------------------------------------------------------------


class EmbeddingFunction:
    """embed_source over a batch of values and embed_query over one give vectors of `dim` floats."""

    dim: int

    def embed_source(self, values: Sequence) -> list[list[float] | None]:
        raise NotImplementedError

    def embed_query(self, value) -> list[float]:
        return self.embed_source([value])[0]


class HashingEmbedding(EmbeddingFunction):
    """Signed hashed counts of word trigrams' bytes, unit length: deterministic, local, no model."""

    def __init__(self, dim: int = 64, size: int = 3) -> None:
        self.dim, self.size = dim, size

    def embed_source(self, values: Sequence) -> list[list[float] | None]:
        import xxhash

        out: list[list[float] | None] = []
        for value in values:
            if value is None:
                out.append(None)
                continue
            v = np.zeros(self.dim)
            for word in str(value).lower().split():
                padded = f"^{word}$"
                for i in range(max(1, len(padded) - self.size + 1)):
                    h = xxhash.xxh64_intdigest(padded[i : i + self.size])
                    v[h % self.dim] += 1.0 if h >> 63 else -1.0
            out.append((v / (np.linalg.norm(v) or 1.0)).astype(np.float32).tolist())
        return out


EMBEDDINGS: dict[str, Callable[..., EmbeddingFunction]] = {"hashing": HashingEmbedding}


def register_embedding(name: str, make: Callable[..., EmbeddingFunction]) -> None:
    EMBEDDINGS[name] = make


def embedding(name: str, **options) -> EmbeddingFunction:
    if name not in EMBEDDINGS:
        raise ValueError(f"no embedding function {name}")
    return EMBEDDINGS[name](**options)


def embedding_spec(function: str, source: str, target: str = "vector", **options) -> dict:
    """What a table keeps about an embedding column."""
    return {"function": function, "source": source, "target": target, "options": options, "dim": embedding(function, **options).dim}


def embed(frame: DataFrame, spec: dict) -> DataFrame:
    """frame with the target column computed from the source column, batch by batch."""
    name, options, make = spec["function"], spec["options"], EMBEDDINGS.get(spec["function"])
    if make is None:
        raise ValueError(f"no embedding function {name}")

    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(make(**options).embed_source(values.tolist()))

    return frame.withColumn(spec["target"], run(F.col(spec["source"])))
