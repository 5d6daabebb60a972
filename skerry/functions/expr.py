"""Typed expressions that are both SQL text and a Spark Column."""

from __future__ import annotations

import datetime
import decimal
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: name in an expression -> Spark SQL template
FUNCTIONS = {
    "lower": "lower({})", "upper": "upper({})", "contains": "contains({})", "btrim": "btrim({})", "ltrim": "ltrim({})", "rtrim": "rtrim({})",
    "concat": "concat({})", "octet_length": "octet_length({})", "json_extract": "get_json_object({})",
    "array_has": "array_contains({})", "array_contains": "array_contains({})", "array_contains_any": "arrays_overlap({})", "array_has_any": "arrays_overlap({})",
    "named_struct": "named_struct({})", "array": "array({})", "length": "length({})", "abs": "abs({})", "coalesce": "coalesce({})",
}
TYPES = {"bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int": "bigint", "int64": "bigint", "float": "double", "float32": "float", "float64": "double", "str": "string", "string": "string", "utf8": "string", "bytes": "binary", "binary": "binary", "date": "date", "date32": "date", "timestamp": "timestamp"}
_PYTHON = {bool: "boolean", int: "bigint", float: "double", str: "string", bytes: "binary", datetime.date: "date", datetime.datetime: "timestamp"}


def literal(value) -> str:
    """A Python value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return str(value) if -(1 << 31) <= value < 1 << 31 else f"{value}L"
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"double('{value}')"
    if isinstance(value, decimal.Decimal):
        return f"{value:f}BD"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex().upper()}'"
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, dict):
        return "named_struct(" + ", ".join(f"{literal(k)}, {literal(v)}" for k, v in value.items()) + ")"
    if hasattr(value, "tolist"):
        return literal(value.tolist())
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(map(literal, value)) + ")"
    raise TypeError(f"no SQL literal for {type(value).__name__}")


def name(path: str) -> str:
    """A column path as SQL: plain parts as they are, others in backticks."""
    if "`" in path:
        return path
    return ".".join(p if p.isidentifier() and p == p.lower() else f"`{p}`" for p in path.split("."))


class Expr:
    def __init__(self, sql: str) -> None:
        self._sql = sql

    def to_sql(self) -> str:
        return self._sql

    def to_column(self) -> Column:
        return F.expr(self._sql)

    def __repr__(self) -> str:
        return f"Expr({self._sql})"

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; use & | ~")

    __hash__ = object.__hash__

    @staticmethod
    def of(value) -> Expr:
        return value if isinstance(value, Expr) else Expr(literal(value))

    def _two(self, other, sign: str, flip: bool = False) -> Expr:
        a, b = (Expr.of(other), self) if flip else (self, Expr.of(other))
        return Expr(f"({a._sql} {sign} {b._sql})")

    def __eq__(self, o): return self._two(o, "=")  # noqa: E704
    def __ne__(self, o): return self._two(o, "!=")  # noqa: E704
    def __lt__(self, o): return self._two(o, "<")  # noqa: E704
    def __le__(self, o): return self._two(o, "<=")  # noqa: E704
    def __gt__(self, o): return self._two(o, ">")  # noqa: E704
    def __ge__(self, o): return self._two(o, ">=")  # noqa: E704
    def __and__(self, o): return self._two(o, "AND")  # noqa: E704
    def __rand__(self, o): return self._two(o, "AND", True)  # noqa: E704
    def __or__(self, o): return self._two(o, "OR")  # noqa: E704
    def __ror__(self, o): return self._two(o, "OR", True)  # noqa: E704
    def __add__(self, o): return self._two(o, "+")  # noqa: E704
    def __radd__(self, o): return self._two(o, "+", True)  # noqa: E704
    def __sub__(self, o): return self._two(o, "-")  # noqa: E704
    def __rsub__(self, o): return self._two(o, "-", True)  # noqa: E704
    def __mul__(self, o): return self._two(o, "*")  # noqa: E704
    def __rmul__(self, o): return self._two(o, "*", True)  # noqa: E704
    def __truediv__(self, o): return self._two(o, "/")  # noqa: E704
    def __rtruediv__(self, o): return self._two(o, "/", True)  # noqa: E704
    def __floordiv__(self, o): return self._two(o, "div")  # noqa: E704

    def __invert__(self) -> Expr:
        return Expr(f"(NOT {self._sql})")

    def lower(self) -> Expr:
        return func("lower", self)

    def upper(self) -> Expr:
        return func("upper", self)

    def contains(self, part) -> Expr:
        return func("contains", self, part)

    def like(self, pattern: str) -> Expr:
        return Expr(f"({self._sql} LIKE {literal(pattern)})")

    def between(self, low, high) -> Expr:
        return Expr(f"({self._sql} BETWEEN {Expr.of(low)._sql} AND {Expr.of(high)._sql})")

    def isin(self, values) -> Expr:
        values = list(values)
        return Expr(f"({self._sql} IN ({', '.join(Expr.of(v)._sql for v in values)}))") if values else Expr("FALSE")

    def is_null(self) -> Expr:
        return Expr(f"({self._sql} IS NULL)")

    def is_not_null(self) -> Expr:
        return Expr(f"({self._sql} IS NOT NULL)")

    def cast(self, kind) -> Expr:
        kind = _PYTHON[kind] if isinstance(kind, type) else TYPES.get(kind, kind)
        return Expr(f"CAST({self._sql} AS {kind})")

    def field(self, part: str) -> Expr:
        return Expr(f"{self._sql}.`{part}`")


def col(path: str) -> Expr:
    return Expr(name(path))


def lit(value) -> Expr:
    return Expr(literal(value))


def func(which: str, *args) -> Expr:
    """A function of the allow-list; others are an error."""
    key = which.lower()
    parts = [Expr.of(a)._sql for a in args]
    if key in ("array_contains_all", "array_has_all"):
        return Expr(f"forall({parts[1]}, x -> array_contains({parts[0]}, x))")
    if key == "get_field":
        return Expr(f"{parts[0]}.{args[1]}")
    if key == "arrow_cast":
        return Expr.of(args[0]).cast(args[1].lower() if isinstance(args[1], str) else args[1])
    if key not in FUNCTIONS:
        raise ValueError(f"unknown function {which}")
    return Expr(FUNCTIONS[key].format(", ".join(parts)))


def to_column(condition) -> Column:
    """A Column of SQL text, an expression or a Column."""
    return condition if isinstance(condition, Column) else condition.to_column() if isinstance(condition, Expr) else F.expr(condition)
