"""Keyed upserts of low latency: each is an append of a generation beside the table, merged on read.

A shard is a folder of generations.  Rows go to shards by bucket of the key, by a column's value
(identity), or to one shard.  Reads take, for each key, the row of the newest generation, or the table's
own if there is none; checkpoint() folds the generations into the table by a keyed merge.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import bucket
from ..sources import ingest
from ..sources.fs import Taken
from ..sources.snapshot import ROW_ID

MAX_BUCKETS, OVERFETCH = 1024, 2


@dataclass(frozen=True)
class LsmSpec:
    """kind bucket (column, n from 1 to 1024), identity (column) or unsharded."""

    kind: str = "unsharded"
    column: str | None = None
    buckets: int = 1

    def __post_init__(self) -> None:
        if self.kind not in ("bucket", "identity", "unsharded"):
            raise ValueError("kind is bucket, identity or unsharded")
        if self.kind != "unsharded" and self.column is None:
            raise ValueError(f"{self.kind} needs a column")
        if self.kind == "bucket" and not 1 <= self.buckets <= MAX_BUCKETS:
            raise ValueError(f"buckets are from 1 to {MAX_BUCKETS}")

    def shard(self, schema: T.StructType):
        """The shard of a row of this schema; a null goes to one of its own."""
        if self.kind == "bucket":
            return F.coalesce(bucket(F.col(self.column), schema[self.column].dataType, self.buckets).cast("string"), F.lit("__null__"))
        return F.coalesce(F.col(self.column).cast("string"), F.lit("__null__")) if self.kind == "identity" else F.lit("0")


class LsmTier:
    def __init__(self, table, spec: LsmSpec | None = None) -> None:
        key = table.primary_key
        if key is None:
            raise ValueError("keyed upserts need a primary key")
        self.table, self.key = table, key
        held = table.store.read("_lsm/spec.json") if table.store.exists("_lsm/spec.json") else None
        if held is None:
            spec = spec or LsmSpec()
            if spec.column is not None and spec.column not in table.columns:
                raise ValueError(f"no column {spec.column}")
            table.store.replace("_lsm/spec.json", vars(spec))
        elif spec is not None and vars(spec) != held:
            raise ValueError("the table has another sharding")
        else:
            spec = LsmSpec(**held)
        self.spec = spec

    def _generations(self) -> list[dict]:
        names = [n for n in self.table.store.names("_lsm/generations") if n.endswith(".json") and not n.startswith(".")]
        folded = self._folded()
        return [g for g in (self.table.store.read(f"_lsm/generations/{n}") for n in names) if g["generation"] > folded]

    def _folded(self) -> int:
        return self.table.store.read("_lsm/folded.json")["generation"] if self.table.store.exists("_lsm/folded.json") else 0

    def upsert(self, data) -> int:
        """Append rows as the next generation (keys may not repeat within one call); its number."""
        rows = ingest.cast_to(ingest.to_frame(self.table.spark, data), self.table.schema)
        if not rows.filter(F.col(self.key).isNull()).isEmpty():
            raise ValueError("a primary key may not be null")
        if not rows.groupBy(self.key).count().filter("count > 1").isEmpty():
            raise ValueError("a key twice in one upsert")
        path = f"{self.table.uri}/_lsm/data/{uuid.uuid4().hex}"
        rows.withColumn("__shard", self.spec.shard(self.table.schema)).write.partitionBy("__shard").parquet(path)
        while True:
            names = [n for n in self.table.store.names("_lsm/generations") if n.endswith(".json") and not n.startswith(".")]
            generation = max([self._folded(), *[int(n[:-5]) for n in names]]) + 1
            try:
                self.table.store.create(f"_lsm/generations/{generation:020d}.json", {"generation": generation, "path": path, "at": time.time()})
                return generation
            except Taken:
                continue

    def deltas(self, shards: Sequence[str] | None = None) -> DataFrame | None:
        """The newest row of every key that a generation holds."""
        out = None
        for g in self._generations():
            schema = T.StructType([*self.table.schema.fields, T.StructField("__shard", T.StringType())])
            part = self.table.spark.read.schema(schema).parquet(g["path"])
            if shards is not None:
                part = part.filter(F.col("__shard").isin(list(shards)))
            part = part.drop("__shard").withColumn("_generation", F.lit(g["generation"]).cast("long"))
            out = part if out is None else out.unionByName(part)
        if out is None:
            return None
        newest = Window.partitionBy(self.key).orderBy(F.col("_generation").desc())
        return out.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")

    def to_df(self) -> DataFrame:
        """The table with the newest generation of every key; null keys of the table stay."""
        base = self.table.scan()
        new = self.deltas()
        columns = [F.col(f"`{c}`") for c in self.table.columns]
        if new is None:
            return base.select(*columns)
        return base.join(new.select(self.key), self.key, "left_anti").select(*columns).unionByName(new.select(*columns))

    def nearest(self, query, k: int = 10, column: str | None = None, metric: str = "l2") -> DataFrame:
        """The k nearest rows of base and generations.

        A base with a vector index of that metric is probed for OVERFETCH * k rows, more while too few of them are
        still the newest of their keys; the generations are searched exactly.
        """
        from ..operators import index, vector

        q = vector.coerce(query)
        column = vector.vector_column(self.table.schema, len(q), column)
        held = index.vector_index(self.table, column)
        if held is None or held[1]["params"]["metric"] != metric:
            return vector.nearest(self.to_df(), column, q, metric, k, tie=self.key)
        new, want, rows = self.deltas(), OVERFETCH * k, self.table.count_rows()
        while True:
            near = self.table.search(q, column).limit(want).to_df()
            if new is not None:
                near = near.join(new.select(self.key), self.key, "left_anti")
            if want >= rows or near.count() >= k:
                break
            want *= 4
        names = [*self.table.columns, "_distance"]
        if new is not None:
            near = near.select(*names).unionByName(vector.nearest(new.select(*self.table.columns), column, q, metric, k, tie=self.key).select(*names))
        return near.select(*names).orderBy("_distance", self.key).limit(k)

    def search_text(self, query, column: str, k: int = 10, tokenizer=None) -> DataFrame:
        from ..operators import fts

        frame = self.to_df().withColumn(ROW_ID, F.xxhash64(self.key))
        hits = fts.search_texts(frame, query, [column], tokenizer)
        return frame.join(hits, ROW_ID).orderBy(F.col("_score").desc(), self.key).limit(k).drop(ROW_ID)

    def checkpoint(self) -> int:
        """Fold all generations into the table; the table's version."""
        held = self._generations()
        if not held:
            return self.table.version
        new = self.deltas().drop("_generation")
        done = self.table.merge_insert(self.key).when_matched_update_all().when_not_matched_insert_all().execute(new)
        self.table.store.replace("_lsm/folded.json", {"generation": max(g["generation"] for g in held)})
        for g in held:
            self.table.store.drop(f"_lsm/generations/{g['generation']:020d}.json")
            self.table.store.drop(g["path"][len(self.table.uri) + 1 :])
        return done.version

    compact = checkpoint

    def stats(self) -> dict:
        held = self._generations()
        new = self.deltas()
        return {"generations": len(held), "keys": 0 if new is None else new.count(), "folded": self._folded(), "spec": vars(self.spec)}
