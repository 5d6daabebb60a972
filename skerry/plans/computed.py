"""Columns computed by deterministic expressions: declared with nulls, filled by refresh()."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.snapshot import CREATED, ROW_ID, UPDATED, Manifest

# Functions that Catalyst folds, so that they look deterministic, but that change over time or session.
VOLATILE = ("now", "current_timestamp", "current_date", "current_time", "localtimestamp", "curdate", "current_user", "user", "session_user", "current_catalog", "current_database", "current_schema", "current_timezone", "version")


def analyzed(frame, expression: str):
    """(type, columns it reads) of an expression over frame; volatile ones are an error."""
    import re

    names = {n.lower() for n in re.findall(r"([A-Za-z_]\w*)\s*(?:\(|$|[^\w.(])", re.sub(r"'(?:[^'\\]|\\.)*'", "", expression))}
    columns = {c.lower() for c in frame.columns}
    if hit := (names & set(VOLATILE)) - columns:
        raise ValueError(f"expressions must be deterministic: {sorted(hit)}")
    out = frame.select(F.expr(expression).alias("_value"))
    plan = out._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        raise ValueError(f"expressions must be deterministic: {expression}")
    refs = plan.expressions().apply(0).references().toSeq()
    return out.schema[0].dataType, [refs.apply(i).name() for i in range(refs.size())]


def declare(table, name: str, expression: str) -> int:
    """Add a column of nulls that refresh() fills with the expression."""
    kind, inputs = analyzed(table.scan().limit(0).select(*[F.col(f"`{c}`") for c in table.columns]), expression)
    computed = {c["name"] for c in table.manifest().properties.get("computed", [])}
    if hit := computed & set(inputs):
        raise ValueError(f"computed columns can't read computed columns: {sorted(hit)}")
    entry = {"name": name, "expression": expression, "inputs": inputs}
    return table._widen([T.StructField(name, kind, True)], None, "computed_column", lambda p: p | {"computed": [*p.get("computed", []), entry]})


def declare_function(table, function, inputs: Sequence[str], outputs: Sequence[str]) -> int:
    """Add columns that a registered function fills: one, or one for each field of its struct."""
    fields = function.output.fields if isinstance(function.output, T.StructType) else [T.StructField(outputs[0] if outputs else "", function.output)]
    if len(fields) != len(outputs):
        raise ValueError(f"{function.name} has {len(fields)} outputs")
    m = table.manifest()
    if missing := set(inputs) - set(m.schema.fieldNames()):
        raise ValueError(f"no columns {sorted(missing)}")
    if hit := {c["name"] for c in m.properties.get("computed", [])} & set(inputs):
        raise ValueError(f"computed columns can't read computed columns: {sorted(hit)}")
    struct = isinstance(function.output, T.StructType)
    made = [{"name": o, "function": function.name, "function_version": function.version, "names": function.names, "field": f.name if struct else None, "inputs": list(inputs)} for o, f in zip(outputs, fields, strict=True)]
    return table._widen([T.StructField(o, f.dataType, True) for o, f in zip(outputs, fields, strict=True)], None, "computed_column", lambda p: p | {"computed": [*p.get("computed", []), *made]})


def value_of(entry: dict):
    """The Column of a computed column's declaration."""
    if "expression" in entry:
        return F.expr(entry["expression"])
    from ..functions.registry import get_function

    function = get_function(entry["function"], entry["function_version"])
    if entry["names"]:
        function = function.rename(**entry["names"])
    out = function(*entry["inputs"])
    return out if entry["field"] is None else out[entry["field"]]


def refresh(table, columns: Sequence[str] | None = None):
    """Fill what is null, in the files that hold a null only; rows already computed stay, so it is idempotent.

    A row whose expression is null itself stays null (and is tried again next time).
    """
    from ..sources.table import Change, file_name

    held = {c["name"]: c for c in table.manifest().properties.get("computed", [])}
    if unknown := set(columns or ()) - set(held):
        raise ValueError(f"no computed columns {sorted(unknown)}")
    todo = [held[c] for c in (columns or held)]
    count = 0

    def change(m: Manifest) -> Manifest:
        nonlocal count
        fills = {c["name"]: value_of(c) for c in todo}
        open_ = F.lit(False)
        for name, value in fills.items():
            open_ = open_ | (F.col(f"`{name}`").isNull() & value.isNotNull())
        hits = {r._file: r.n for r in table._scan(m, named=True).filter(open_).groupBy("_file").agg(F.count("*").alias("n")).collect()}
        count = sum(hits.values())
        if not hits:
            return m
        old = [f for f in m.files if file_name(f.path) in hits]
        rows = table._scan(m, old).withColumn("_open", open_)
        values = [F.coalesce(F.col(f"`{f.name}`"), fills[f.name].cast(f.dataType)).alias(f.name) if f.name in fills else F.col(f"`{f.name}`") for f in m.schema]
        stamp = F.when(F.col("_open"), F.lit(m.version + 1).cast("long")).otherwise(F.col(UPDATED)).alias(UPDATED)
        files = table._write(m, rows.select(*values, ROW_ID, CREATED, stamp))
        return replace(m, files=(*[f for f in m.files if file_name(f.path) not in hits], *files))

    return Change(table._commit(change, "refresh").version, updated=count) if todo else Change(table.version)


