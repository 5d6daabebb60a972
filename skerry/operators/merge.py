"""Keyed upserts: one full outer join of target and source on the keys.

Each row gets an action.  A first pass over the keys (and the columns that conditions read; the
scan is pruned to those) counts the actions of every data file; a second rewrites only files
that hold an updated or deleted row, and writes the inserted rows.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Expr
from ..sources import ingest
from ..sources.snapshot import CREATED, ROW_ID, SYSTEM, UPDATED, Manifest


class MergeInsert:
    """when_* choose the actions; conditions are SQL over `target.column` and `source.column`."""

    def __init__(self, table, on: Sequence[str]) -> None:
        if not on:
            raise ValueError("a merge needs a key")
        self._table, self._on = table, list(on)
        self._update: str | None = None
        self._insert = False
        self._delete: str | None = None
        self._timeout = 30.0

    def when_matched_update_all(self, where: str | Expr | None = None) -> MergeInsert:
        self._update = "TRUE" if where is None else where.to_sql() if isinstance(where, Expr) else where
        return self

    def when_not_matched_insert_all(self) -> MergeInsert:
        self._insert = True
        return self

    def when_not_matched_by_source_delete(self, where: str | Expr | None = None) -> MergeInsert:
        self._delete = "TRUE" if where is None else where.to_sql() if isinstance(where, Expr) else where
        return self

    def use_index(self, on: bool = True) -> MergeInsert:
        """Kept for callers that choose; the join is planned by Catalyst either way."""
        return self

    def timeout(self, seconds: float) -> MergeInsert:
        """Give up (TimeoutError) rather than try again after so many seconds of lost races."""
        self._timeout = seconds
        return self

    def _actions(self, m: Manifest, source: DataFrame, files=None) -> DataFrame:
        """(target, source, _file, _action) of every row of either side."""
        rows = self._table._scan(m, files, named=True)
        names = m.schema.fieldNames()
        target = rows.select(*[F.col(f"`{k}`").alias(f"__t{i}") for i, k in enumerate(self._on)], F.struct(*names, *SYSTEM).alias("target"), "_file")
        incoming = source.select(*[F.col(f"`{k}`").alias(f"__s{i}") for i, k in enumerate(self._on)], F.struct(*[F.col(f"`{c}`") for c in source.columns]).alias("source"))
        keys = [F.col(f"__t{i}") == F.col(f"__s{i}") for i in range(len(self._on))]
        both = target.join(incoming, keys, "full_outer")
        met, alone = F.col("target").isNotNull() & F.col("source").isNotNull(), F.col("source").isNull()
        action = F.lit(None).cast("string")
        if self._delete is not None:
            action = F.when(alone & F.coalesce(F.expr(self._delete), F.lit(False)), "delete").otherwise(action)
        if self._insert:
            action = F.when(F.col("target").isNull(), "insert").otherwise(action)
        if self._update is not None:
            action = F.when(met & F.coalesce(F.expr(self._update), F.lit(False)), "update").otherwise(action)
        return both.withColumn("_action", action)

    def execute(self, data):
        """Merge rows in; the source's keys must be unique (null keys match nothing and are inserted)."""
        from ..sources.table import Change, file_name, next_row_id

        table = self._table
        if self._update is None and not self._insert and self._delete is None:
            raise ValueError("a merge needs at least one when_ clause")
        source = ingest.to_frame(table.spark, data)
        if missing := set(self._on) - set(source.columns):
            raise ValueError(f"keys that the source doesn't have: {sorted(missing)}")
        known = source.na.drop(subset=self._on)
        if not known.groupBy(*[F.col(f"`{k}`") for k in self._on]).count().filter("count > 1").isEmpty():
            raise ValueError("rows of the source that share a key: which one stays is undefined")
        counts: dict[str, int] = {}
        attempts, began = 0, time.monotonic()

        def change(m: Manifest) -> Manifest:
            nonlocal attempts
            if attempts and time.monotonic() - began > self._timeout:
                raise TimeoutError(f"other writers were first {attempts} times")
            attempts += 1
            held = {f.name: f for f in m.schema}
            if unknown := set(source.columns) - set(held):
                raise ValueError(f"columns that the table doesn't have: {sorted(unknown)}")
            typed = source.select(*[F.col(f"`{c}`").cast(held[c].dataType).alias(c) for c in source.columns])
            found = self._actions(m, typed).filter("_action is not null").groupBy("_file", "_action").count().collect()
            counts.clear()
            for r in found:
                counts[r["_action"]] = counts.get(r["_action"], 0) + r["count"]
            touched = {r["_file"] for r in found if r["_action"] in ("update", "delete")}
            old = [f for f in m.files if file_name(f.path) in touched]
            stay = tuple(f for f in m.files if file_name(f.path) not in touched)
            if not found:
                return m
            version, first = F.lit(m.version + 1).cast("long"), F.lit(m.next_row_id).cast("long")
            given, parts = set(source.columns), []
            if old:
                rows = self._actions(m, typed, old).filter(F.col("target").isNotNull() & ~F.coalesce(F.col("_action") == "delete", F.lit(False)))
                write = F.coalesce(F.col("_action") == "update", F.lit(False))
                columns = [(F.when(write, F.col(f"source.`{c}`")).otherwise(F.col(f"target.`{c}`")) if c in given else F.col(f"target.`{c}`")).alias(c) for c in held]
                parts.append(rows.select(*columns, F.col(f"target.{ROW_ID}").alias(ROW_ID), F.col(f"target.{CREATED}").alias(CREATED), F.when(write, version).otherwise(F.col(f"target.{UPDATED}")).alias(UPDATED)))
            if counts.get("insert"):  # of the table only the keys are read
                there = table._scan(m).select(*[F.col(f"`{k}`").alias(f"__t{i}") for i, k in enumerate(self._on)])
                new = typed.join(there, [typed[k] == there[f"__t{i}"] for i, k in enumerate(self._on)], "left_anti")
                columns = [F.col(f"`{c}`") if c in given else F.lit(None).cast(f.dataType).alias(c) for c, f in held.items()]
                parts.append(new.select(*columns, F.lit(-1).cast("long").alias(ROW_ID), version.alias(CREATED), version.alias(UPDATED)))
            whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            # numbered in the writing task, as every append is
            whole = whole.withColumn(ROW_ID, F.when(F.col(ROW_ID) < 0, first + F.monotonically_increasing_id()).otherwise(F.col(ROW_ID)))
            files = table._write(m, whole)
            return replace(m, files=(*stay, *files), next_row_id=next_row_id(m.next_row_id, files))

        version = table._commit(change, "merge").version
        return Change(version, counts.get("insert", 0), counts.get("update", 0), counts.get("delete", 0), attempts)
