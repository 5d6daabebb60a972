"""Permutations of a table for training: which rows, in which splits, in which order.

A permutation is a small table (row_id, split_id, position).  Rows are numbered in two levels: they
are dealt to cells by the high bits of their key (a seeded hash, or the row id), numbered inside
their cell, and shifted by the running sum of the cells' counts.  So exact split sizes and global
orders need no sort of everything in one task.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.expr import Expr, to_column
from ..sources.snapshot import ROW_ID

CELL_ROWS = 1 << 16


def numbered(frame: DataFrame, key: str, rows: int, *ties: str, name: str = "position", dense_ids: bool = False) -> DataFrame:
    """frame with each row's place (from 0) in the order of a long column and ties."""
    if dense_ids:
        shift = 16  # row ids ascend within their task's range
    else:
        shift = 64 - max(1, math.ceil(math.log2(max(2, rows / CELL_ROWS))))
    cell = F.shiftright(F.col(key), shift)
    dealt = frame.withColumn("__cell", cell)
    counts = dealt.groupBy("__cell").agg(F.count("*").alias("__n"))
    before = counts.select("__cell", (F.sum("__n").over(Window.orderBy("__cell")) - F.col("__n")).alias("__before"))
    inside = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__cell").orderBy(key, *ties)) - 1)
    return inside.join(before, "__cell").withColumn(name, F.col("__at") + F.col("__before")).drop("__cell", "__at", "__before")


def ordered_rows(frame: DataFrame) -> Iterator:
    """Rows by position: one sort, then partition after partition comes to the driver, the next one ahead of its turn."""
    return frame.orderBy("position").toLocalIterator(prefetchPartitions=True)


def counts_of(rows: int, ratios: Sequence[float] | None = None, counts: Sequence[int] | None = None, fixed: int | None = None) -> list[int]:
    """Rows of each split.  Ratios are rounded to the nearest; if they sum to one, all rows are dealt, one off or one on from the first split on."""
    if sum(x is not None for x in (ratios, counts, fixed)) != 1:
        raise ValueError("give ratios, counts or fixed")
    if fixed is not None:
        if fixed < 1 or fixed > rows:
            raise ValueError(f"{fixed} splits of {rows} rows")
        return [rows // fixed] * fixed
    if counts is not None:
        if min(counts) < 1 or sum(counts) > rows:
            raise ValueError(f"counts {list(counts)} of {rows} rows")
        return list(counts)
    if any(not 0 <= r <= 1 for r in ratios) or sum(ratios) > 1 + 1e-9:
        raise ValueError("ratios are from 0 to 1 and sum to 1 or less")
    if any(r * rows < 1 for r in ratios):
        raise ValueError(f"a split of {rows} rows would be empty")
    out = [math.floor(r * rows + 0.5) for r in ratios]
    whole = abs(rows - sum(ratios) * rows) < 0.5
    left = rows - sum(out)
    if left < 0 or whole:
        step, i = (1 if left > 0 else -1), 0
        while left:
            if step > 0 or out[i]:
                out[i] += step
                left -= step
            i = (i + 1) % len(out)
    return out


class PermutationBuilder:
    def __init__(self, table) -> None:
        self._table = table
        self._filter = None
        self._split: tuple[str, dict] = ("none", {})
        self._shuffle: tuple[int, int] | None = None
        self._names: list[str] | None = None

    def filter(self, condition: str | Expr) -> PermutationBuilder:
        self._filter = to_column(condition)
        return self

    def split_random(self, ratios=None, counts=None, fixed=None, seed: int = 0, clump_size: int = 1, names: Sequence[str] | None = None) -> PermutationBuilder:
        return self._set("random", {"sizes": (ratios, counts, fixed), "seed": seed, "clump": clump_size}, names)

    def split_sequential(self, ratios=None, counts=None, fixed=None, names: Sequence[str] | None = None) -> PermutationBuilder:
        return self._set("sequential", {"sizes": (ratios, counts, fixed)}, names)

    def split_hash(self, columns: Sequence[str], weights: Sequence[int], discard_weight: int = 0, names: Sequence[str] | None = None) -> PermutationBuilder:
        if not columns or not weights or min(weights) < 1 or discard_weight < 0:
            raise ValueError("split_hash needs columns and positive weights")
        return self._set("hash", {"columns": list(columns), "weights": list(weights), "discard": discard_weight}, names)

    def split_calculated(self, expression: str | Expr, names: Sequence[str] | None = None) -> PermutationBuilder:
        return self._set("calculated", {"expression": expression}, names)

    def _set(self, kind: str, how: dict, names: Sequence[str] | None) -> PermutationBuilder:
        self._split, self._names = (kind, how), list(names) if names else None
        return self

    def shuffle(self, seed: int = 0, clump_size: int = 1) -> PermutationBuilder:
        if clump_size < 1:
            raise ValueError("clump_size must be positive")
        self._shuffle = (seed, clump_size)
        return self

    def _shuffled(self, rows: DataFrame, n: int, seed: int, clump: int, name: str) -> DataFrame:
        """rows(row_id, ...) with a place in seeded order; a clump's rows stay together, in order."""
        if clump > 1:
            rows = numbered(rows, "row_id", n, name="__seq", dense_ids=True).withColumn("__seq", F.floor(F.col("__seq") / clump))
            hashed = rows.withColumn("__h", F.xxhash64("__seq", F.lit(seed)))
            return numbered(hashed, "__h", n, "__seq", "row_id", name=name).drop("__h", "__seq")
        return numbered(rows.withColumn("__h", F.xxhash64("row_id", F.lit(seed))), "__h", n, "row_id", name=name).drop("__h")

    def build(self, path: str | None = None) -> Permutation:
        """Compute and store the permutation (under path, else in the table's folder)."""
        from ..sources.fs import Store

        table, (kind, how) = self._table, self._split
        version = table.version
        rows = table.scan()
        if self._filter is not None:
            rows = rows.filter(self._filter)
        split = None
        if kind == "hash":
            total = sum(how["weights"]) + how["discard"]
            h = F.pmod(F.xxhash64(*[F.col(c) for c in how["columns"]]), F.lit(total))
            split, edge = F.lit(None).cast("int"), sum(how["weights"])
            for i in reversed(range(len(how["weights"]))):
                split = F.when(h < edge, i).otherwise(split)
                edge -= how["weights"][i]
        elif kind == "calculated":
            split = to_column(how["expression"]).cast("int")
        rows = rows.select(F.col(ROW_ID).alias("row_id"), (F.lit(0) if split is None else split).alias("split_id"))
        rows = rows.filter("split_id is not null")
        n = rows.count()
        if kind in ("random", "sequential"):
            sizes = counts_of(n, *how["sizes"])
            if kind == "random":
                rows = self._shuffled(rows.drop("split_id"), n, how["seed"], how["clump"], "__place")
            else:
                rows = numbered(rows.drop("split_id"), "row_id", n, name="__place", dense_ids=True)
            split, edge = F.lit(None).cast("int"), sum(sizes)
            for i in reversed(range(len(sizes))):
                split = F.when(F.col("__place") < edge, i).otherwise(split)
                edge -= sizes[i]
            rows = rows.withColumn("split_id", split).filter("split_id is not null")
        if self._shuffle is not None:
            rows = self._shuffled(rows.select("row_id", "split_id"), n, *self._shuffle, "__order")
        elif "__place" in rows.columns and kind == "random":
            rows = rows.withColumnRenamed("__place", "__order")
        else:
            rows = rows.withColumn("__order", F.col("row_id"))
        # positions count within each split, so a reader can seek
        inside = self._within(rows, n)
        path = path or f"{table.uri}/_permutations/{uuid.uuid4().hex}"
        inside.repartitionByRange("split_id", "position").sortWithinPartitions("split_id", "position").write.parquet(path)
        Store(table.spark, path).replace("_split_names.json", {"names": self._names, "version": version, "branch": table.branch})
        return Permutation.open(table, path)

    def _within(self, rows: DataFrame, n: int) -> DataFrame:
        """Places within each split in the order of __order, by cells as in numbered()."""
        shift = 16
        dealt = rows.withColumn("__cell", F.shiftright("__order", shift))
        counts = dealt.groupBy("split_id", "__cell").agg(F.count("*").alias("__n"))
        before = counts.select("split_id", "__cell", (F.sum("__n").over(Window.partitionBy("split_id").orderBy("__cell")) - F.col("__n")).alias("__before"))
        inside = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("split_id", "__cell").orderBy("__order", "row_id")) - 1)
        return inside.join(before, ["split_id", "__cell"]).select("row_id", "split_id", (F.col("__at") + F.col("__before")).alias("position"))


class Permutation:
    """One split of a permutation, read in order; every method gives a changed copy."""

    def __init__(self, table, rows: DataFrame, names: Sequence[str] | None, split: int = 0) -> None:
        self._table, self._rows, self._names, self._split = table, rows, list(names) if names else None, split
        self._columns: list[tuple[str, str]] = [(c, c) for c in table.columns]
        self._skip, self._take = 0, None
        self._transform: Callable | None = None
        self._format = "python"

    @classmethod
    def open(cls, table, path: str, split: int | str = 0) -> Permutation:
        from ..sources.fs import Store

        held = Store(table.spark, path).read("_split_names.json")
        pinned = type(table)(table.spark, table.uri, held["branch"], held["version"]) if held["version"] in table.log.versions() else table
        out = cls(pinned, table.spark.read.schema("row_id long, split_id int, position long").parquet(path), held["names"])
        return out.split(split)

    @classmethod
    def identity(cls, table) -> Permutation:
        """All rows in the order of their ids, as one split."""
        n = table.count_rows()
        rows = numbered(table.scan().select(F.col(ROW_ID).alias("row_id"), F.lit(0).alias("split_id")), "row_id", n, dense_ids=True)
        return cls(table, rows, None)

    def _with(self, **changes) -> Permutation:
        out = object.__new__(Permutation)
        out.__dict__ = self.__dict__ | changes
        return out

    @property
    def split_names(self) -> list[str] | None:
        return self._names

    @property
    def splits(self) -> list[int]:
        return sorted(r.split_id for r in self._rows.select("split_id").distinct().collect())

    def split(self, which: int | str) -> Permutation:
        if isinstance(which, str):
            if not self._names or which not in self._names:
                raise ValueError(f"no split {which}")
            which = self._names.index(which)
        return self._with(_split=which)

    def row_ids(self) -> DataFrame:
        """(row_id, position) of this split after skip and take."""
        mine = self._rows.filter(F.col("split_id") == self._split)
        if self._skip:
            mine = mine.filter(F.col("position") >= self._skip)
        if self._take is not None:
            mine = mine.filter(F.col("position") < self._skip + self._take)
        return mine.select("row_id", (F.col("position") - self._skip).alias("position"))

    def _frame(self, places: DataFrame | None = None) -> DataFrame:
        rows = self._table.scan()
        columns = [F.col(f"`{source}`").alias(alias) for source, alias in self._columns]
        return (self.row_ids() if places is None else places).join(rows, F.col("row_id") == F.col(ROW_ID)).select("position", *columns)

    def to_df(self, ordered: bool = True) -> DataFrame:
        frame = self._frame()
        return (frame.orderBy("position") if ordered else frame).drop("position")

    def count(self) -> int:
        return self.row_ids().count()

    __len__ = count

    @property
    def columns(self) -> list[str]:
        return [a for _, a in self._columns]

    def select_columns(self, columns: Sequence[str]) -> Permutation:
        held = {a: s for s, a in self._columns}
        if missing := [c for c in columns if c not in held]:
            raise ValueError(f"no columns {missing}")
        return self._with(_columns=[(held[c], c) for c in columns])

    def remove_columns(self, columns: Sequence[str]) -> Permutation:
        left = [a for a in self.columns if a not in columns]
        if not left:
            raise ValueError("no column is left")
        return self.select_columns(left)

    def rename_columns(self, names: Mapping[str, str]) -> Permutation:
        if missing := set(names) - set(self.columns):
            raise ValueError(f"no columns {sorted(missing)}")
        return self._with(_columns=[(s, names.get(a, a)) for s, a in self._columns])

    def rename_column(self, old: str, new: str) -> Permutation:
        return self.rename_columns({old: new})

    def with_skip(self, n: int) -> Permutation:
        return self._with(_skip=self._skip + n, _take=None if self._take is None else max(0, self._take - n))

    def with_take(self, n: int) -> Permutation:
        return self._with(_take=n if self._take is None else min(n, self._take))

    def with_transform(self, transform: Callable[[pa.RecordBatch], object]) -> Permutation:
        return self._with(_transform=transform)

    def with_format(self, kind: str) -> Permutation:
        if kind not in ("python", "arrow", "pandas", "numpy", "polars"):
            raise ValueError("format is python, arrow, pandas, numpy or polars")
        return self._with(_format=kind, _transform=None)

    def map(self, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """A function over Arrow batches on the executors, in no order."""
        return self.to_df(ordered=False).mapInArrow(function, schema)

    def unique(self, column: str) -> list:
        return sorted((r[0] for r in self.select_columns([column]).to_df(ordered=False).distinct().collect()), key=lambda v: (v is None, v))

    def take_offsets(self, offsets: Sequence[int]) -> DataFrame:
        """Rows at places of this split, in the order asked."""
        spark: SparkSession = self._table.spark
        asked = spark.createDataFrame([(i, int(o)) for i, o in enumerate(offsets)], "_at long, position long")
        places = self.row_ids().filter(F.col("position").isin([int(o) for o in offsets])).join(F.broadcast(asked), "position")
        rows = self._table.scan()
        ids = [r.row_id for r in places.select("row_id").collect()]
        columns = [F.col(f"`{source}`").alias(alias) for source, alias in self._columns]
        return places.join(rows.filter(F.col(ROW_ID).isin(ids)), F.col("row_id") == F.col(ROW_ID)).orderBy("_at").select(*columns)

    def __getitem__(self, at: int | Sequence[int]):
        return self.take_offsets([at] if isinstance(at, int) else at).collect()

    def _shaped(self, batch: pa.RecordBatch):
        if self._transform is not None:
            return self._transform(batch)
        if self._format == "arrow":
            return batch
        if self._format == "pandas":
            return batch.to_pandas()
        if self._format == "numpy":
            return {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        if self._format == "polars":
            import polars

            return polars.from_arrow(batch)
        return batch.to_pylist()

    def iter(self, batch_size: int = 1024, skip_last_batch: bool = True) -> Iterator:
        """Batches in order; a last one that isn't full is skipped unless told otherwise."""
        schema, held = to_arrow_schema(self.to_df().schema), []
        for row in ordered_rows(self._frame()):
            held.append(row.asDict(recursive=True))
            del held[-1]["position"]
            if len(held) == batch_size:
                yield self._shaped(pa.RecordBatch.from_pylist(held, schema=schema))
                held = []
        if held and not skip_last_batch:
            yield self._shaped(pa.RecordBatch.from_pylist(held, schema=schema))

    def state(self) -> str:
        return json.dumps({"split": self._split, "skip": self._skip, "take": self._take, "columns": self._columns})


def permutation(table) -> PermutationBuilder:
    return PermutationBuilder(table)
