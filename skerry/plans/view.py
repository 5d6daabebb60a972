"""Materialized views: projections and a filter of one table, kept up to date by row ids and versions.

A view starts empty.  refresh() compares the source's version with the one folded in last: equal
is nothing to do; after changes that row versions describe, rows that vanished or changed are
evicted (an anti join on the source's row ids) and rows written since are computed and appended, in
one commit; otherwise (forced, schema changed, versions pruned, going back, or rows removed
from a capped view) the view is computed anew.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import Expr
from ..sources.snapshot import ROW_ID, SYSTEM, Manifest
from ..sources.table import Table, file_name, next_row_id, stamped
from .computed import analyzed

SOURCE_ROW = "__source_row_id"
MAX_WALK = 512
REBUILD, INCREMENTAL, NOTHING = "rebuild", "incremental", "no_op"


@dataclass(frozen=True)
class Refreshed:
    mode: str
    version: int
    source_version: int
    rows_added: int = 0
    rows_removed: int = 0


def _text(e: str | Expr) -> str:
    return e.to_sql() if isinstance(e, Expr) else e


class MaterializedView:
    def __init__(self, database, table: Table) -> None:
        if "view" not in table.manifest().properties:
            raise ValueError(f"{table.name} is not a view")
        self.database, self.table = database, table

    @classmethod
    def create(cls, database, name: str, source: Table, select: Sequence[str] | Mapping[str, str] | None, where: str | Expr | None, limit: int | None, namespace: Sequence[str]) -> MaterializedView:
        columns = [c for c in source.columns if c != SOURCE_ROW]
        pairs = [(c, f"`{c}`") for c in columns] if not select else list(select.items()) if isinstance(select, Mapping) else [(c, f"`{c}`") if isinstance(c, str) else tuple(c) for c in select]
        pairs = [(a, _text(e)) for a, e in pairs]
        names = [a for a, _ in pairs]
        if len({n.lower() for n in names}) < len(names):
            raise ValueError("a column of the view is declared twice")
        if bad := [n for n in names if n.lower() in (*SYSTEM, SOURCE_ROW)]:
            raise ValueError(f"reserved column names: {bad}")
        if limit is not None and limit < 0:
            raise ValueError("limit must not be negative")
        empty = source.scan().limit(0).select(*[F.col(f"`{c}`") for c in source.columns])
        fields, inputs = [], set()
        for alias, e in pairs:
            kind, refs = analyzed(empty, e)
            fields.append(T.StructField(alias, kind, True))
            inputs |= set(refs)
        condition = None if where is None else _text(where)
        if condition is not None:
            kind, refs = analyzed(empty, condition)
            if not isinstance(kind, T.BooleanType):
                raise ValueError("the filter of a view must be boolean")
            inputs |= set(refs)
        table = database.create_empty_table(name, T.StructType([*fields, T.StructField(SOURCE_ROW, T.LongType(), True)]), namespace=namespace)
        definition = {"source": source.uri, "branch": source.branch, "select": pairs, "where": condition, "limit": limit, "inputs": sorted(inputs), "watermark": None}
        table._commit(lambda m: replace(m, properties=m.properties | {"view": definition}), "view")
        return cls(database, table)

    @property
    def name(self) -> str:
        return self.table.name

    @property
    def definition(self) -> dict:
        return self.table.manifest().properties["view"]

    @property
    def watermark(self) -> int | None:
        """The source's version that was folded in last."""
        return self.definition["watermark"]

    def to_df(self) -> DataFrame:
        return self.table.to_df().drop(SOURCE_ROW)

    def count_rows(self) -> int:
        return self.table.count_rows()

    def query(self):
        return self.table.query().select([c for c, _ in self.definition["select"]])

    def _computed(self, rows: DataFrame, d: dict) -> DataFrame:
        kept = rows if d["where"] is None else rows.filter(F.expr(d["where"]))
        fields = {f.name: f.dataType for f in self.table.schema}
        return kept.select(*[F.expr(e).cast(fields[a]).alias(a) for a, e in d["select"]], F.col(ROW_ID).alias(SOURCE_ROW))

    def _plan(self, source: Table, d: dict, to: int) -> tuple[str, bool]:
        """(mode, whether rows may have vanished or changed)."""
        since = d["watermark"]
        if since is None or to < since:
            return REBUILD, True
        if to == since:
            return NOTHING, False
        held = [v for v in source.log.versions() if since <= v <= to]
        if len(held) != to - since + 1 or to - since > MAX_WALK:
            return REBUILD, True
        before = source.log.read(since)
        manifests = [source.log.read(v) for v in held[1:]]
        shape = lambda m: [(f.name, f.dataType) for f in m.schema if f.name in d["inputs"]]
        ops = {m.op for m in manifests}
        if any(shape(m) != shape(before) for m in manifests) or ops & {"overwrite", "restore", "cherry_pick", "alter_columns"}:
            return REBUILD, True
        removing = bool(ops & {"delete", "update", "merge", "refresh", "lsm"})
        if removing and d["limit"] is not None:
            return REBUILD, True
        return INCREMENTAL, removing

    def refresh(self, full: bool = False, source_version: int | None = None) -> Refreshed:
        """Bring the view to the source's newest version, or to one given."""
        d = self.definition
        source = Table(self.table.spark, d["source"], d["branch"])
        m = source.log.read(source_version)
        if missing := set(d["inputs"]) - set(m.schema.fieldNames()):
            raise ValueError(f"the source lost columns that the view reads: {sorted(missing)}")
        mode, removing = self._plan(source, d, m.version)
        if full:
            mode = REBUILD
        if mode == NOTHING:
            return Refreshed(NOTHING, self.table.version, m.version)
        rows = source._scan(m)
        added = removed = 0

        def change(view: Manifest) -> Manifest:
            nonlocal added, removed
            if view.properties["view"]["watermark"] != d["watermark"]:
                raise RuntimeError("another refresh of the view came first")
            stay: tuple = ()
            if mode == REBUILD:
                removed = view.rows
                new = self._computed(rows, d)
                if d["limit"] is not None:
                    new = new.orderBy(SOURCE_ROW).limit(d["limit"])
            else:
                fresh = source.written_since(source.log.read(d["watermark"]), m)
                new = self._computed(fresh, d)
                stay = view.files
                if removing:
                    gone = source.vanished(source.log.read(d["watermark"]), m).select(F.col(ROW_ID).alias(SOURCE_ROW))
                    named = self.table._scan(view, named=True)
                    hits = {r._file for r in named.join(gone, SOURCE_ROW, "left_semi").select("_file").distinct().collect()}
                    touched = [f for f in view.files if file_name(f.path) in hits]
                    kept = self.table._scan(view, touched).join(gone, SOURCE_ROW, "left_anti") if touched else None
                    stay = (*[f for f in view.files if file_name(f.path) not in hits], *(self.table._write(view, kept) if touched else ()))
                    removed = view.rows - sum(f.rows for f in stay)
                if d["limit"] is not None:
                    new = new.orderBy(SOURCE_ROW).limit(max(0, d["limit"] - sum(f.rows for f in stay)))
            files = self.table._write(view, stamped(new, view.next_row_id, view.version + 1))
            added = sum(f.rows for f in files)
            properties = view.properties | {"view": d | {"watermark": m.version}}
            return replace(view, files=(*stay, *files), next_row_id=next_row_id(view.next_row_id, files), properties=properties)

        version = self.table._commit(change, "refresh_view").version
        return Refreshed(mode, version, m.version, added, removed)


