"""Versioned tables: immutable Parquet files named by manifests, changed copy-on-write.

Every row carries a row id that survives rewrites and the versions that created and last
updated it.  Row ids are unique and ascending in the order of writing, not dense (they come from
the writing task's number and its row's place, so assigning them costs no shuffle).  A change
first finds the files it touches (one row a file comes to the driver) and rewrites those only.
"""

from __future__ import annotations

import contextlib
import re
import threading
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import Expr, literal, to_column
from . import ingest
from .fs import Store
from .snapshot import CREATED, MAIN, ROW_ID, SYSTEM, SYSTEM_FIELDS, UPDATED, DataFile, Log, Manifest, physical, read_json, write_files

SMALL_FILE_ROWS = 100_000
TARGET_FILE_ROWS = 1_000_000
KEY_TYPES = (T.IntegerType, T.LongType, T.StringType, T.BinaryType)


@dataclass(frozen=True)
class Change:
    """What a write did."""

    version: int
    inserted: int = 0
    updated: int = 0
    deleted: int = 0
    attempts: int = 1

    @property
    def rows(self) -> int:
        return self.inserted + self.updated


def next_row_id(base: int, files: Sequence[DataFile]) -> int:
    """The least id above those that tasks of these files could assign from base on."""
    held: dict[int, int] = {}
    for f in files:
        task = int(re.search(r"part-(\d+)", f.path.rsplit("/", 1)[1]).group(1))
        held[task] = held.get(task, 0) + f.rows
    return max((base + (task << 33) + rows for task, rows in held.items()), default=base)


def stamped(frame: DataFrame, base: int, version: int) -> DataFrame:
    return frame.withColumns({ROW_ID: F.lit(base).cast("long") + F.monotonically_increasing_id(), CREATED: F.lit(version).cast("long"), UPDATED: F.lit(version).cast("long")})


@contextlib.contextmanager
def watched(spark: SparkSession, progress, began: float, every: float = 0.2):
    """Call progress with the counts of the tasks that this thread's jobs run, again and again; gives the last counts."""
    last = {"active_tasks": 0, "done_tasks": 0, "total_tasks": 0}
    if progress is None:
        yield last
        return
    context, group, over = spark.sparkContext, f"write-{uuid.uuid4().hex}", threading.Event()
    context.setJobGroup(group, "write of a table")

    def look() -> None:
        tracker = context.statusTracker()
        while not over.wait(every):
            jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
            stages = [tracker.getStageInfo(s) for j in jobs if j is not None for s in j.stageIds]
            for name, of in (("active_tasks", "numActiveTasks"), ("done_tasks", "numCompletedTasks"), ("total_tasks", "numTasks")):
                last[name] = max(last["total_tasks"] if name == "total_tasks" else 0, sum(getattr(s, of) for s in stages if s is not None))
            progress({"rows": 0, "bytes": 0, "files": 0, **last, "seconds": time.monotonic() - began, "done": False})

    thread = threading.Thread(target=look, daemon=True)
    thread.start()
    try:
        yield last
    finally:
        over.set()
        thread.join()
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)


def file_name(path: str) -> str:
    return path.rsplit("/", 1)[1]


def with_dims(schema: T.StructType, frame: DataFrame, arrow: pa.Schema | None) -> T.StructType:
    """schema with the dimension of every vector column in its metadata: fixed-size lists, and columns named vector by their first row."""
    fields = []
    for f in schema:
        dim = None
        if arrow is not None and f.name in arrow.names and pa.types.is_fixed_size_list(arrow.field(f.name).type):
            dim = arrow.field(f.name).type.list_size
        if "dim" not in f.metadata and ingest.is_vector(f.dataType) and (dim or f.name == "vector"):
            if dim is None:
                first = frame.filter(F.col(f"`{f.name}`").isNotNull()).select(F.size(f"`{f.name}`").alias("n")).first()
                dim = first.n if first else None
            if dim is not None:
                f = T.StructField(f.name, f.dataType, f.nullable, f.metadata | {"dim": dim})
        fields.append(f)
    return T.StructType(fields)


def _with_properties(m: Manifest, more: dict) -> Manifest:
    return replace(m, properties=m.properties | more)


class Table:
    def __init__(self, spark: SparkSession, root: str, branch: str = MAIN, version: int | str | None = None, freshness: float | None = 0.0) -> None:
        """freshness: seconds a read may lag behind other writers (0: none; None: until this handle writes or refreshes)."""
        self.spark, self.uri, self.branch, self.freshness = spark, root.rstrip("/"), branch, freshness
        self.store = Store(spark, self.uri)
        self.log = Log(self.store, branch)
        self._held: tuple[Manifest, float] | None = None
        self._pinned: int | None = None
        self.stamp: dict = {}  # properties that every commit of this handle sets
        if version is not None:
            self.checkout(version)

    @property
    def name(self) -> str:
        return file_name(self.uri).removesuffix(".tbl")

    # -- creation ------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, root: str, data=None, schema: T.StructType | type | None = None, embeddings: Sequence[dict] = (), **policy) -> Table:
        if isinstance(schema, type):
            schema = ingest.model_schema(schema)
        given = ingest.to_frame(spark, data, schema)
        arrow = data.schema if isinstance(data, (pa.Table, pa.RecordBatch)) else None
        held = schema if schema is not None else given.schema
        if bad := [f.name for f in held if f.name.lower() in SYSTEM]:
            raise ValueError(f"reserved column names: {bad}")
        if len({f.name.lower() for f in held}) < len(held):
            raise ValueError("column names that differ only in case")
        held = with_dims(held, given, arrow)
        for e in embeddings:
            if e["target"] not in held.fieldNames():
                held = T.StructType([*held.fields, T.StructField(e["target"], T.ArrayType(T.FloatType()), True, {"dim": e["dim"]})])
        table = cls(spark, root)
        table.log.create(Manifest(1, held, used_names=tuple(f.name for f in held), properties={"embeddings": list(embeddings)} if embeddings else {}))
        if data is not None:
            table.add(given, **policy)
        return table

    # -- versions ------------------------------------------------------------------------------

    def manifest(self) -> Manifest:
        if self._pinned is not None:
            if self._held is None:
                self._held = (self.log.read(self._pinned), time.monotonic())
            return self._held[0]
        lag = None if self._held is None else time.monotonic() - self._held[1]
        if lag is None or (self.freshness is not None and lag >= self.freshness):
            self._held = (self.log.read(), time.monotonic())
        return self._held[0]

    @property
    def version(self) -> int:
        return self.manifest().version

    @property
    def schema(self) -> T.StructType:
        return self.manifest().schema

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    def list_versions(self) -> list[dict]:
        return [{"version": m.version, "at": m.at, "op": m.op, "rows": m.rows} for m in map(self.log.read, self.log.versions())]

    def checkout(self, version: int | str) -> Table:
        """Read a version or tag; the handle is read-only until checkout_latest()."""
        if isinstance(version, str):
            tag = self.tags().get(version)
            if tag is None:
                raise ValueError(f"no tag {version}")
            if tag["branch"] != self.branch:
                raise ValueError(f"tag {version} is on branch {tag['branch']}")
            version = tag["version"]
        held = self.log.read(version)
        self._pinned, self._held = version, (held, time.monotonic())
        return self

    def checkout_latest(self) -> Table:
        self._pinned = self._held = None
        return self

    refresh_handle = checkout_latest

    def restore(self, version: int | str | None = None) -> int:
        """A new version with the content of the one given or checked out."""
        if version is not None:
            self.checkout(version)
        old = self.manifest()
        self.checkout_latest()
        return self._commit(lambda m: replace(old, next_row_id=max(m.next_row_id, old.next_row_id), used_names=m.used_names, properties=m.properties, origin=m.origin), "restore").version

    def _commit(self, change, op: str) -> Manifest:
        if self._pinned is not None:
            raise ValueError("a checked-out version is read-only; checkout_latest() first")
        made = self.log.commit(change if not self.stamp else lambda m: _with_properties(change(m), self.stamp), op)
        self._held = (made, time.monotonic())
        return made

    def tags(self) -> dict[str, dict]:
        return read_json(self.store, "_refs/tags.json")

    def create_tag(self, tag: str, version: int | None = None) -> None:
        held = self.tags()
        if tag in held:
            raise ValueError(f"tag {tag} exists")
        self._set_tag(held, tag, version)

    def update_tag(self, tag: str, version: int | None = None) -> None:
        held = self.tags()
        if tag not in held:
            raise ValueError(f"no tag {tag}")
        self._set_tag(held, tag, version)

    def _set_tag(self, held: dict, tag: str, version: int | None) -> None:
        version = self.log.read(version if version is not None else self.version).version
        self.store.replace("_refs/tags.json", held | {tag: {"version": version, "branch": self.branch}})

    def delete_tag(self, tag: str) -> None:
        held = self.tags()
        if tag not in held:
            raise ValueError(f"no tag {tag}")
        self.store.replace("_refs/tags.json", {k: v for k, v in held.items() if k != tag})

    def branches(self) -> list[str]:
        return [MAIN, *self.store.names("_branches")]

    def create_branch(self, branch: str, version: int | None = None) -> Table:
        if branch in self.branches():
            raise ValueError(f"branch {branch} exists")
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", branch) or branch.startswith("."):
            raise ValueError(f"not a branch name: {branch}")
        start = self.log.read(version if version is not None else self.version)
        Log(self.store, branch).create(replace(start, op="branch", origin=self.branch, parent=start.version))
        return self.checkout_branch(branch)

    def checkout_branch(self, branch: str) -> Table:
        if branch not in self.branches():
            raise ValueError(f"no branch {branch}")
        return Table(self.spark, self.uri, branch, freshness=self.freshness)

    def delete_branch(self, branch: str) -> None:
        if branch == MAIN or branch not in self.branches():
            raise ValueError(f"cannot delete branch {branch}")
        self.store.drop(f"_branches/{branch}")

    def diff(self, branch: str) -> DataFrame:
        """Rows that differ between this branch and another, with `_change`: only_here, only_there or changed (the other's row)."""
        here, there = self.scan(), self.checkout_branch(branch).scan()
        both = here.select(ROW_ID, F.col(UPDATED).alias("_a"), F.struct(*self.columns).alias("_here")).join(there.select(ROW_ID, F.col(UPDATED).alias("_b"), F.struct(*there.columns[: -len(SYSTEM)]).alias("_there")), ROW_ID, "full_outer")
        change = F.when(F.col("_b").isNull(), "only_here").when(F.col("_a").isNull(), "only_there").when(~F.col("_here").eqNullSafe(F.col("_there")), "changed")
        return both.withColumn("_change", change).filter("_change is not null").select(ROW_ID, "_change", F.when(F.col("_change") == "only_here", F.col("_here")).otherwise(F.col("_there")).alias("row"))

    def cherry_pick(self, branch: str, version: int) -> Change:
        """Apply what one version of another branch changed against its parent: rows it wrote, and rows it removed."""
        other = self.checkout_branch(branch)
        now = other.log.read(version)
        before = other.log.read(now.parent) if now.parent in other.log.versions() else None
        if before is None:
            raise ValueError("the first version of a branch changes nothing")
        wrote = other._scan(now).filter(F.col(UPDATED) == now.version)
        gone = other._scan(before).select(ROW_ID).join(other._scan(now).select(ROW_ID), ROW_ID, "left_anti")
        counts: dict[str, int] = {}

        def change(m: Manifest) -> Manifest:
            mine = self._scan(m)
            stay = mine.join(gone, ROW_ID, "left_anti").join(wrote.select(ROW_ID), ROW_ID, "left_anti")
            counts.update(inserted=wrote.join(mine.select(ROW_ID), ROW_ID, "left_anti").count(), updated=wrote.join(mine.select(ROW_ID), ROW_ID, "left_semi").count(), deleted=mine.join(gone, ROW_ID, "left_semi").count())
            files = self._write(m, stay.unionByName(wrote.withColumn(UPDATED, F.lit(m.version + 1).cast("long"))))
            return replace(m, files=files, next_row_id=max(m.next_row_id, now.next_row_id))

        return Change(self._commit(change, "cherry_pick").version, **counts)

    def changes(self, since: int, to: int | None = None) -> DataFrame:
        """Rows that differ between two versions: their columns, row id and `_change` (inserted, updated, or deleted with the old row)."""
        old, new = self.log.read(since), self.log.read(to)
        names = [c for c in new.schema.fieldNames() if c in old.schema.fieldNames()]
        now = self._scan(new).select(*[F.col(f"`{c}`") for c in names], *SYSTEM)
        before = self._scan(old).select(*[F.col(f"`{c}`") for c in names], ROW_ID)
        wrote = now.filter(F.col(UPDATED) > since).withColumn("_change", F.when(F.col(CREATED) > since, "inserted").otherwise("updated"))
        gone = before.join(now.select(ROW_ID), ROW_ID, "left_anti").withColumn("_change", F.lit("deleted"))
        out = [*[F.col(f"`{c}`") for c in names], ROW_ID, "_change"]
        return wrote.select(*out).unionByName(gone.select(*out))

    def vanished(self, old: Manifest, new: Manifest) -> DataFrame:
        """Row ids of old's rows that new no longer holds as they were.  Reads only files that one of the two lacks."""
        both = {f.path for f in old.files} & {f.path for f in new.files}
        before = self._scan(old, [f for f in old.files if f.path not in both]).select(ROW_ID)
        after = self._scan(new, [f for f in new.files if f.path not in both]).filter(F.col(UPDATED) <= old.version).select(ROW_ID)
        return before.join(after, ROW_ID, "left_anti")

    def written_since(self, old: Manifest, new: Manifest) -> DataFrame:
        """New's rows that were written or changed after old, with their system columns."""
        held = {f.path for f in old.files}
        return self._scan(new, [f for f in new.files if f.path not in held]).filter(F.col(UPDATED) > old.version)

    # -- reading -------------------------------------------------------------------------------

    def _scan(self, m: Manifest, files: Sequence[DataFile] | None = None, named: bool = False) -> DataFrame:
        """The rows of a manifest with their system columns, and `_file` if named."""
        files = m.files if files is None else files
        stored = T.StructType([T.StructField(physical(f), f.dataType) for f in m.schema] + SYSTEM_FIELDS)
        if files:
            frame = self.spark.read.schema(stored).parquet(*[f.path for f in files])
            extra = [F.col("_metadata.file_name").alias("_file")] if named else []
        else:
            frame = self.spark.createDataFrame([], stored)
            extra = [F.lit("").alias("_file")] if named else []
        return frame.select(*[F.col(f"`{physical(f)}`").alias(f.name) for f in m.schema], *SYSTEM, *extra)

    def scan(self, version: int | None = None) -> DataFrame:
        """All rows with their system columns."""
        return self._scan(self.manifest() if version is None else self.log.read(version))

    def to_df(self, row_ids: bool = False) -> DataFrame:
        frame = self.scan()
        return frame.select(*[F.col(f"`{c}`") for c in self.columns], *([ROW_ID] if row_ids else []))

    def to_arrow(self) -> pa.Table:
        return self.to_df().toArrow()

    def to_arrow_dataset(self):
        """The rows as a pyarrow Dataset, for engines that read those (with their filters and projections).

        It reads the data files of this version where they lie.  Files whose columns were renamed since are
        read by Spark instead, and the dataset holds their rows in memory.
        """
        import pyarrow.dataset as ds

        m = self.manifest()
        if not m.files or any(physical(f) != f.name for f in m.schema):
            return ds.dataset(self.to_arrow())
        from pyspark.sql.pandas.types import to_arrow_schema

        import pyarrow.fs

        places = [pyarrow.fs.FileSystem.from_uri(self.store.uri(f.path)) for f in m.files]
        return ds.dataset([p for _, p in places], schema=to_arrow_schema(m.schema), filesystem=places[0][0], format="parquet")

    def to_pandas(self, flatten: bool | int = False):
        return (ingest.flatten(self.to_df(), None if flatten is True else int(flatten)) if flatten else self.to_df()).toPandas()

    def head(self, n: int = 5) -> DataFrame:
        return self.scan().orderBy(ROW_ID).limit(n).select(*[F.col(f"`{c}`") for c in self.columns])

    def count_rows(self, where: str | Expr | Column | None = None) -> int:
        """Without a filter the answer is in the manifest."""
        return self.manifest().rows if where is None else self.scan().filter(to_column(where)).count()

    def query(self):
        from ..operators.query import Query

        return Query(self)

    def search(self, what=None, column: str | None = None, **how):
        from ..operators.query import search

        return search(self, what, column, **how)

    def view(self, name: str) -> str:
        """Register the table as a temp view, for Spark SQL."""
        self.to_df().createOrReplaceTempView(name)
        return name

    def stats(self) -> dict:
        """Rows, bytes, and percentiles of the rows of the data files (the value at place n * q / 100)."""
        files = self.manifest().files
        lengths = sorted(f.rows for f in files)
        at = lambda q: lengths[min(len(lengths) * q // 100, len(lengths) - 1)] if lengths else 0
        return {
            "num_rows": sum(lengths), "total_bytes": sum(f.bytes for f in files), "num_fragments": len(files), "num_small_fragments": sum(n < SMALL_FILE_ROWS for n in lengths),
            "lengths": {"min": at(0), "max": lengths[-1] if lengths else 0, "mean": sum(lengths) // len(lengths) if lengths else 0} | {f"p{q}": at(q) for q in (25, 50, 75, 99)},
            "num_indices": len(self.indices()),
        }

    # -- writing -------------------------------------------------------------------------------

    def _write(self, m: Manifest, frame: DataFrame) -> tuple[DataFile, ...]:
        """Write rows in the manifest's columns (and system columns) as data files."""
        return write_files(frame.select(*[F.col(f"`{f.name}`").alias(physical(f)) for f in m.schema], *SYSTEM), self.store)

    def _admit(self, data, m: Manifest, on_bad_vectors: str, fill_value: float) -> DataFrame:
        from ..functions.registry import embed

        frame = ingest.to_frame(self.spark, data)
        given = frame.columns
        for spec in m.properties.get("embeddings", []):
            if spec["target"] not in frame.columns:
                frame = embed(frame, spec)
        computed = {c["name"] for c in m.properties.get("computed", [])}
        if hit := computed & set(given):
            raise ValueError(f"computed columns are filled by refresh(): {sorted(hit)}")
        schema = T.StructType([f if f.name not in computed else T.StructField(f.name, f.dataType) for f in m.schema])
        frame = ingest.cast_to(frame, schema)
        for f in m.schema:
            if "dim" in f.metadata and f.name in given and on_bad_vectors != "keep":
                frame = ingest.bad_vectors(frame, f.name, f.metadata["dim"], on_bad_vectors, fill_value)
        return frame

    def add(self, data, mode: str = "append", on_bad_vectors: str = "error", fill_value: float = 0.0, progress=None) -> Change:
        """Append or overwrite.

        progress, if given, is called with {rows, bytes, files, active_tasks, total_tasks, done_tasks, seconds, done}: while the
        write runs by its tasks, and once at the end by what was written.
        """
        if mode not in ("append", "overwrite"):
            raise ValueError("mode is append or overwrite")
        began, count = time.monotonic(), 0

        def change(m: Manifest) -> Manifest:
            nonlocal count
            frame = self._admit(data, m, on_bad_vectors, fill_value)
            if (parts := ingest.held_partitions(data, self.spark.sparkContext.defaultParallelism)) is not None:
                frame = frame.coalesce(parts)
            with watched(self.spark, progress, began) as tasks:
                files = self._write(m, stamped(frame, m.next_row_id, m.version + 1))
            count = sum(f.rows for f in files)
            if progress is not None:
                progress({"rows": count, "bytes": sum(f.bytes for f in files), "files": len(files), **tasks, "active_tasks": 0, "done_tasks": tasks["total_tasks"], "seconds": time.monotonic() - began, "done": True})
            return replace(m, files=(m.files if mode == "append" else ()) + files, next_row_id=next_row_id(m.next_row_id, files))

        return Change(self._commit(change, mode).version, inserted=count)

    def _split(self, m: Manifest, where: Column) -> tuple[dict[str, int], list[DataFile], list[DataFile]]:
        """Matches by file, the files without a match, and those with one."""
        hits = {r._file: r.n for r in self._scan(m, named=True).filter(where).groupBy("_file").agg(F.count("*").alias("n")).collect()}
        return hits, [f for f in m.files if file_name(f.path) not in hits], [f for f in m.files if file_name(f.path) in hits]

    def delete(self, where: str | Expr | Column) -> Change:
        """Delete matching rows; null conditions don't match.  A version is made even if none does."""
        match = F.coalesce(to_column(where), F.lit(False))
        count = 0

        def change(m: Manifest) -> Manifest:
            nonlocal count
            hits, clean, touched = self._split(m, match)
            count = sum(hits.values())
            partial = [f for f in touched if hits[file_name(f.path)] < f.rows]  # files without a survivor are dropped unread
            kept = self._write(m, self._scan(m, partial).filter(~match)) if partial else ()
            return replace(m, files=(*clean, *kept))

        return Change(self._commit(change, "delete").version, deleted=count)

    def update(self, values: Mapping[str, object] | None = None, where: str | Expr | Column | None = None, values_sql: Mapping[str, str] | None = None) -> Change:
        """Set columns to values or SQL expressions over the old row."""
        new = {k: v.to_sql() if isinstance(v, Expr) else literal(v) for k, v in (values or {}).items()} | dict(values_sql or {})
        if not new:
            raise ValueError("no column to update")
        match = F.coalesce(to_column(where), F.lit(False)) if where is not None else F.lit(True)
        count = 0

        def change(m: Manifest) -> Manifest:
            nonlocal count
            if unknown := set(new) - set(m.schema.fieldNames()):
                raise ValueError(f"no columns {sorted(unknown)}")
            self._guard(m, new)
            hits, clean, touched = self._split(m, match)
            count = sum(hits.values())
            rows = self._scan(m, touched).withColumn("_hit", match)
            changed = [F.when(F.col("_hit"), F.expr(new[f.name]).cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in new else F.col(f"`{f.name}`") for f in m.schema]
            stamp = F.when(F.col("_hit"), F.lit(m.version + 1).cast("long")).otherwise(F.col(UPDATED)).alias(UPDATED)
            written = self._write(m, rows.select(*changed, ROW_ID, CREATED, stamp)) if touched else ()
            return replace(m, files=(*clean, *written))

        return Change(self._commit(change, "update").version, updated=count)

    def merge_insert(self, on: str | Sequence[str]):
        from ..operators.merge import MergeInsert

        return MergeInsert(self, [on] if isinstance(on, str) else list(on))

    def merge(self, other, left_on: str, right_on: str | None = None) -> int:
        """Add the other table's columns by key (left join); keys of it must be unique."""
        right_on = right_on or left_on
        frame = ingest.to_frame(self.spark, other.to_df() if isinstance(other, Table) else other)
        if not frame.groupBy(F.col(f"`{right_on}`")).count().filter("count > 1").isEmpty():
            raise ValueError(f"{right_on} is not unique in the right side")
        added = [f for f in frame.schema if f.name != right_on]
        if clash := {f.name for f in added} & set(self.columns):
            raise ValueError(f"columns that the table has already: {sorted(clash)}")
        right = frame.withColumnRenamed(right_on, "__key")
        return self._widen([T.StructField(f.name, f.dataType, True, f.metadata) for f in added], lambda rows: rows.join(right, rows[left_on] == right["__key"], "left").drop("__key"), "add_columns")

    def _widen(self, fields: Sequence[T.StructField], fill, op: str, properties=None) -> int:
        """Add columns whose values fill(rows) computes for all rows; only nulls (fill is None) cost no rewrite."""

        def change(m: Manifest) -> Manifest:
            held = {n.lower() for n in m.schema.fieldNames()}
            if clash := [f.name for f in fields if f.name.lower() in held or f.name.lower() in SYSTEM]:
                raise ValueError(f"columns exist or are reserved: {clash}")
            fresh, used = [], list(m.used_names)
            for f in fields:
                name = f.name
                while name in used:
                    name += "_"
                used.append(name)
                fresh.append(T.StructField(f.name, f.dataType, f.nullable, f.metadata | ({"physical": name} if name != f.name else {})))
            new = replace(m, schema=T.StructType([*m.schema.fields, *fresh]), used_names=tuple(used), properties=properties(m.properties) if properties else m.properties)
            return new if fill is None or not m.files else replace(new, files=self._write(new, fill(self._scan(m))))

        return self._commit(change, op).version

    def _guard(self, m: Manifest, names) -> None:
        """Refuse to write computed columns, or to change what they are computed from in shape."""
        computed = {c["name"] for c in m.properties.get("computed", [])}
        if hit := computed & set(names):
            raise ValueError(f"computed columns are filled by refresh(): {sorted(hit)}")

    # -- schema --------------------------------------------------------------------------------

    def add_columns(self, columns) -> int:
        """A mapping name -> SQL, a field or list of fields (all null), or (function over Arrow batches, schema)."""
        if isinstance(columns, Mapping):
            exprs = {k: to_column(v) for k, v in columns.items()}
            kinds = self.scan().select(*[e.alias(k) for k, e in exprs.items()]).schema
            return self._widen(kinds.fields, lambda rows: rows.withColumns(exprs), "add_columns")
        if isinstance(columns, tuple) and callable(columns[0]):
            function, schema = columns
            schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)

            def computed(rows: DataFrame) -> DataFrame:
                def run(batches):
                    for b in batches:
                        new = function(b)
                        yield pa.RecordBatch.from_arrays([*b.columns, *new.columns], names=[*b.schema.names, *new.schema.names])

                return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *schema.fields]))

            return self._widen(schema.fields, computed, "add_columns")
        fields = [columns] if isinstance(columns, T.StructField) else list(columns)
        return self._widen([T.StructField(f.name, f.dataType, True, f.metadata) for f in fields], None, "add_columns")

    def alter_columns(self, *changes: Mapping) -> int:
        """Each {path, rename?, nullable?, data_type?}: names and nullability are metadata, a new type rewrites its column (bad casts fail)."""

        def change(m: Manifest) -> Manifest:
            fields = {f.name: f for f in m.schema}
            casts: dict[str, T.DataType] = {}
            for c in changes:
                if c["path"] not in fields:
                    raise ValueError(f"no column {c['path']}")
                f = fields[c["path"]]
                self._inputs(m, f.name)
                kind, nullable, name = f.dataType, f.nullable, c.get("rename") or f.name
                if c.get("data_type") is not None:
                    kind = c["data_type"] if isinstance(c["data_type"], T.DataType) else T._parse_datatype_string(c["data_type"])
                    casts[f.name] = kind
                if c.get("nullable") is not None:
                    if f.nullable and not c["nullable"] and not self._scan(m).filter(F.col(f"`{f.name}`").isNull()).isEmpty():
                        raise ValueError(f"{f.name} holds nulls")
                    nullable = c["nullable"]
                if name != f.name and any(g.name.lower() == name.lower() for g in fields.values()):
                    raise ValueError(f"column {name} exists")
                meta = f.metadata | ({"physical": physical(f)} if name != physical(f) else {})
                fields[c["path"]] = T.StructField(name, kind, nullable, meta)
            new = replace(m, schema=T.StructType([fields[f.name] for f in m.schema]), used_names=tuple(dict.fromkeys([*m.used_names, *[f.name for f in fields.values()]])))
            if not casts or not m.files:
                return new
            rows = self._scan(m)
            rows = rows.select(*[(F.col(f"`{old}`").cast(casts[old]) if old in casts else F.col(f"`{old}`")).alias(f.name) for old, f in fields.items()], *SYSTEM)
            return replace(new, files=self._write(new, rows))

        return self._commit(change, "alter_columns").version

    def _inputs(self, m: Manifest, name: str) -> None:
        for c in m.properties.get("computed", []):
            if name == c["name"] or name in c["inputs"]:
                raise ValueError(f"{name} belongs to computed column {c['name']}")

    def drop_columns(self, names: Sequence[str]) -> int:
        def change(m: Manifest) -> Manifest:
            if unknown := set(names) - set(m.schema.fieldNames()):
                raise ValueError(f"no columns {sorted(unknown)}")
            computed = [c for c in m.properties.get("computed", []) if c["name"] not in names]
            for n in names:
                for c in computed:
                    if n in c["inputs"]:
                        raise ValueError(f"{n} is an input of computed column {c['name']}")
            left = [f for f in m.schema if f.name not in names]
            if not left:
                raise ValueError("a table needs a column")
            return replace(m, schema=T.StructType(left), properties=m.properties | {"computed": computed})

        return self._commit(change, "drop_columns").version

    def update_field_metadata(self, column: str, metadata: Mapping, mode: str = "merge") -> int:
        """merge into, replace, or remove keys (values None) of a column's metadata."""
        own = ("dim", "physical")

        def change(m: Manifest) -> Manifest:
            if column not in m.schema.fieldNames():
                raise ValueError(f"no column {column}")
            f = m.schema[column]
            fixed = {k: v for k, v in f.metadata.items() if k in own}
            new = dict(metadata) if mode == "replace" else f.metadata | dict(metadata)
            new = {k: v for k, v in new.items() if v is not None} | fixed
            return replace(m, schema=T.StructType([T.StructField(g.name, g.dataType, g.nullable, new) if g.name == column else g for g in m.schema]))

        return self._commit(change, "field_metadata").version

    def set_primary_key(self, columns: str | Sequence[str]) -> int:
        """One column, once; it is not enforced."""
        columns = [columns] if isinstance(columns, str) else list(columns)

        def change(m: Manifest) -> Manifest:
            if len(columns) != 1:
                raise ValueError("a primary key has exactly one column")
            if "primary_key" in m.properties:
                raise ValueError("the primary key is set already")
            if columns[0] not in m.schema.fieldNames() or not isinstance(m.schema[columns[0]].dataType, KEY_TYPES):
                raise ValueError(f"{columns[0]} cannot be a primary key")
            return replace(m, properties=m.properties | {"primary_key": columns[0]})

        return self._commit(change, "primary_key").version

    @property
    def primary_key(self) -> str | None:
        return self.manifest().properties.get("primary_key")

    # -- computed columns ----------------------------------------------------------------------

    def add_computed_column(self, name: str, expression: str) -> int:
        """Declare a column computed by a deterministic expression; refresh() fills it."""
        from ..plans.computed import declare

        return declare(self, name, expression)

    def add_function_columns(self, function, inputs: Sequence[str], outputs: Sequence[str]) -> int:
        """Declare columns that a registered Python function computes from others; a struct output fills one column a field."""
        from ..plans.computed import declare_function

        return declare_function(self, function, inputs, outputs)

    def refresh(self, columns: Sequence[str] | None = None) -> Change:
        """Fill the nulls of computed columns."""
        from ..plans.computed import refresh

        return refresh(self, columns)

    # -- rows by place -------------------------------------------------------------------------

    def take_row_ids(self, ids: Sequence[int]) -> DataFrame:
        """Rows by id, in the order of ids; unknown ids are left out."""
        return self._take(ids, self.scan())

    def take_offsets(self, offsets: Sequence[int]) -> DataFrame:
        """Rows by place in the order of row ids."""
        wanted = sorted(set(offsets))
        if wanted and wanted[0] < 0:
            raise ValueError("offsets start at 0")
        found = self.spark.createDataFrame([(i, o) for i, o in enumerate(offsets)], "_at long, _offset long")
        return self._by_offset(wanted).join(F.broadcast(found), "_offset").orderBy("_at").select(*[F.col(f"`{c}`") for c in self.columns])

    def _by_offset(self, wanted: Sequence[int]) -> DataFrame:
        """(_offset, columns) of the rows at the wanted places, without sorting the table: counts by range of row ids place them."""
        m = self.manifest()
        rows = self._scan(m)
        cells = rows.select(F.shiftright(F.col(ROW_ID), 16).alias("_cell")).groupBy("_cell").count()
        from pyspark.sql import Window

        # one row for every 65,536 ids: a running sum over them is a few megabytes for a billion rows
        shift = cells.withColumn("_before", F.sum("count").over(Window.orderBy("_cell")) - F.col("count"))
        near = F.lit(False)
        for o in wanted:
            near = near | ((F.col("_before") <= o) & (F.col("_before") + F.col("count") > o))
        mine = rows.withColumn("_cell", F.shiftright(F.col(ROW_ID), 16)).join(shift.filter(near).drop("count"), "_cell")
        placed = mine.withColumn("_offset", F.row_number().over(Window.partitionBy("_cell").orderBy(ROW_ID)) - 1 + F.col("_before"))
        return placed.filter(F.col("_offset").isin([int(o) for o in wanted])) if wanted else placed.limit(0)

    def _take(self, ids: Sequence[int], rows: DataFrame) -> DataFrame:
        asked = self.spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], f"_at long, {ROW_ID} long")
        picked = rows.filter(F.col(ROW_ID).isin([int(x) for x in ids])) if len(ids) <= 10_000 else rows
        return picked.join(asked, ROW_ID).orderBy("_at").select(*[F.col(f"`{c}`") for c in self.columns])

    def __getitem__(self, at: int | slice | Sequence[int]) -> DataFrame:
        if isinstance(at, int):
            at = [at if at >= 0 else self.count_rows() + at]
        elif isinstance(at, slice):
            at = range(*at.indices(self.count_rows()))
        return self.take_offsets(list(at))

    def __len__(self) -> int:
        return self.count_rows()

    # -- binary payloads -----------------------------------------------------------------------

    def fetch_blobs(self, column: str, ids: Sequence[int], ranges: Sequence[tuple[int, int]] | None = None) -> list[bytes | None]:
        """Payloads of rows by id, aligned with ids (None where the row or payload is missing); ranges are (offset, length)."""
        asked = [(i, int(x), *(ranges[i] if ranges else (0, 1 << 30))) for i, x in enumerate(ids)]
        wanted = self.spark.createDataFrame(asked, f"_at long, {ROW_ID} long, _from long, _n long")
        rows = self.scan().select(ROW_ID, F.col(f"`{column}`").alias("_blob")).filter(F.col(ROW_ID).isin([int(x) for x in ids]))
        part = wanted.join(rows, ROW_ID, "left").select("_at", F.expr("substring(_blob, cast(_from + 1 as int), cast(_n as int))").alias("_part"))
        found = {r["_at"]: r["_part"] for r in part.collect()}
        return [None if found.get(i) is None else bytes(found[i]) for i in range(len(asked))]

    def open_blob(self, column: str, row_id: int):
        """A seekable file over one payload that reads ranges when asked."""
        from .blob import BlobFile

        return BlobFile(self, column, row_id)

    # -- indices -------------------------------------------------------------------------------

    def create_index(self, column: str | None = None, kind: str = "auto", name: str | None = None, replace: bool = True, wait: bool = True, **params):
        from ..operators.index import create

        return create(self, column, kind, name, replace, wait, **params)

    def indices(self) -> dict[str, dict]:
        return read_json(self.store, self._index_file())

    def _index_file(self) -> str:
        return "_indices/catalog.json" if self.branch == MAIN else f"_branches/{self.branch}/indices.json"

    def list_indices(self) -> list[dict]:
        return [{"name": e["name"], "kind": e["kind"], "columns": [e["column"]]} for e in self.indices().values()]

    def tokenize(self, text: str, column: str | None = None, index: str | None = None, **how) -> list[str]:
        """The tokens of a text by the index of a name or column, or by the tokenizer described."""
        from ..functions.text import Tokenizer

        if not how:
            fits = [e for e in self.indices().values() if e["kind"] == "fts" and (index in (None, e["name"])) and (column in (None, e["column"]))]
            if len(fits) != 1:
                raise ValueError(f"{len(fits)} inverted indices fit")
            how = fits[0]["params"]
        return Tokenizer(**how).of(self.spark, text)

    def index_stats(self, name: str) -> dict | None:
        from ..operators.index import stats

        return stats(self, name)

    def drop_index(self, name: str) -> None:
        held = self.indices()
        if name not in held:
            raise ValueError(f"no index {name}")
        self.store.replace(self._index_file(), {k: v for k, v in held.items() if k != name})

    def wait_for_index(self, names: Sequence[str], timeout: float = 60.0) -> None:
        from ..operators.index import wait

        wait(self, names, timeout)

    def prewarm(self) -> DataFrame:
        return self.scan().cache()

    def prewarm_index(self, name: str) -> int:
        """Hold an index's tables in the executors' storage; the number of their rows."""
        held = self.indices()
        if name not in held:
            raise ValueError(f"no index {name}")
        return sum(self.spark.read.parquet(path).cache().count() for path in [*held[name].get("paths", []), *held[name].get("terms", [])])

    # -- maintenance ---------------------------------------------------------------------------

    def compact(self, target_rows: int = TARGET_FILE_ROWS) -> int:
        """Join files of less than the target into files of about target_rows (no shuffle)."""

        def change(m: Manifest) -> Manifest:
            small = [f for f in m.files if f.rows < target_rows]
            if len(small) < 2:
                return m
            n = max(1, -(-sum(f.rows for f in small) // target_rows))
            if n >= len(small):
                return m
            return replace(m, files=(*[f for f in m.files if f.rows >= target_rows], *self._write(m, self._scan(m, small).coalesce(n))))

        return self._commit(change, "compact").version

    def cleanup_old_versions(self, older_than: float = 7 * 86400.0) -> dict:
        """Drop versions older than so many seconds (never the newest or a tagged one), then files that no version of any branch names."""
        now, kept = time.time(), {(t["branch"], t["version"]) for t in self.tags().values()}
        dropped = 0
        for v in self.log.versions()[:-1]:
            if (self.branch, v) not in kept and now - self.log.read(v).at > older_than:
                self.log.drop(v)
                dropped += 1
        named = {f.path for b in self.branches() for log in [Log(self.store, b)] for v in log.versions() for f in log.read(v).files}
        freed = 0
        for folder in self.store.names("data"):
            sizes = self.store.sizes(f"data/{folder}")
            live = {n for n in sizes if f"{self.uri}/data/{folder}/{n}" in named}
            if not live and self.store.age(f"data/{folder}") > min(older_than, 3600.0):  # a younger one may be a write under way
                freed += sum(sizes.values())
                self.store.drop(f"data/{folder}")
        return {"versions": dropped, "bytes": freed}

    def optimize(self, older_than: float = 7 * 86400.0) -> dict:
        """Compact, fold new rows into the indices, prune old versions."""
        from ..operators.index import fold

        self.compact()
        for name in self.indices():
            fold(self, name)
        return self.cleanup_old_versions(older_than)

    # -- keyed upserts by deltas ---------------------------------------------------------------

    def lsm(self, spec=None):
        from ..streaming.lsm import LsmTier

        return LsmTier(self, spec)
