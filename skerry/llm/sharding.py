"""Sharding by size-tiered compaction, in DataFrame functions only.

A store is a folder: `data/<arrival>/part-*.parquet` are immutable shards and
`_manifests/<version>.json` say which shards a version added and removed; every FULL_EVERY versions
the whole list is written beside it (`<version>.full`), so a commit writes what it changes and a
read follows a short chain.  append() writes an arrival as it is
partitioned (no shuffle) and commits.  compact() sorts the live shards by size, finds runs of
similar size (each within `spread` of the run's mean, or all below the floor) and merges a run
of `min_run` or more into files of about `target_bytes` (coalesce: no shuffle), until no run is
left; the runs of a pass are merged side by side, and every merge commits one version that swaps the
run for the merged files.

A commit writes its manifest beside its place and renames it there without overwriting,
so a version appears complete or not at all; who loses the race reads the winner's manifest and
tries again (a merge whose inputs are gone is given up).  Readers take the newest version, or
any earlier one that vacuum() has kept.  A job that dies leaves files that no manifest names;
vacuum() removes those.

Nulls and edge cases: rows are stored as they are, nulls, empty and very long texts and
repeated rows included, under any column names Parquet holds.  An empty arrival commits a
version with no new rows (its schema is kept, so an empty store reads as an empty table).
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES, MIN_RUN, SPREAD, FLOOR_BYTES = 128 << 20, 4, 0.5, 4 << 20
#: Versions between two whole lists of shards, and merges that run side by side.
FULL_EVERY, MERGES = 16, 8


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's folder
    bytes: int
    rows: int


def similar_runs(sizes: list[int], target: int, min_run: int = MIN_RUN, spread: float = SPREAD, floor: int = FLOOR_BYTES) -> list[list[int]]:
    """Indices of shards to merge, run by run.  Shards of target * (1 - spread) or more are done."""
    order = sorted((i for i, s in enumerate(sizes) if s < target * (1 - spread)), key=lambda i: (sizes[i], i))
    runs: list[list[int]] = []
    total = 0
    for i in order:
        small = sizes[i] <= floor
        if runs and (small or (mean := total / len(runs[-1])) * (1 + spread) >= sizes[i] and mean > floor * (1 - spread)):
            runs[-1].append(i)
            total += sizes[i]
        else:
            runs.append([i])
            total = sizes[i]
    return [r for r in runs if len(r) >= min_run]


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, min_run: int = MIN_RUN, spread: float = SPREAD, floor_bytes: int = FLOOR_BYTES, codec: str = "zstd") -> None:
        self.spark, self.path, self.target_bytes, self.min_run, self.spread, self.floor_bytes, self.codec = spark, path.rstrip("/"), target_bytes, min_run, spread, floor_bytes, codec
        self._hadoop = spark._jvm.org.apache.hadoop
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        folder = self._at("_manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._at(f"_manifests/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> dict:
        """A version's number, schema and shards."""
        if version is None:
            held = self.versions()
            version = held[-1] if held else 0
        later: list[dict] = []
        at, shards, schema = version, {}, None
        while at:
            if self._fs.exists(self._at(f"_manifests/{at:020d}.full")):
                whole = self._load(f"{at:020d}.full")
                shards, schema = {s["path"]: s for s in whole["shards"]}, whole["schema"]
                break
            later.append(self._load(f"{at:020d}.json"))
            at -= 1
        for step in reversed(later):
            schema = step["schema"]
            for path in step["removed"]:
                del shards[path]
            shards |= {s["path"]: s for s in step["added"]}
        return {"version": version, "schema": schema, "shards": list(shards.values())}

    def _store_full(self, version: int) -> None:
        """The whole list of a version, for shorter reads; it says what the versions up to it say."""
        name = self._at(f"_manifests/{version:020d}.full")
        if not self._fs.exists(name):
            draft = self._draft(self.manifest(version))
            if not self._fs.rename(draft, name):
                self._fs.delete(draft, False)

    def _draft(self, body: dict):
        draft = self._at(f"_manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        return draft

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    def _commit(self, change, what: str) -> int | None:
        """change(manifest) gives the new (schema, shards), or None to give up; tried again until its version is free."""
        while True:
            held = self.manifest()
            new = change(held)
            if new is None:
                return None
            schema, shards = new
            version = held["version"] + 1
            before, after = {s["path"] for s in held["shards"]}, {s.path for s in shards}
            draft, final = self._draft({"version": version, "parent": held["version"], "what": what, "at": time.time(), "schema": schema, "added": [vars(s) for s in shards if s.path not in before], "removed": sorted(before - after)}), self._at(f"_manifests/{version:020d}.json")
            context = self._hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
            none = self.spark._sc._gateway.new_array(self._hadoop.fs.Options.Rename, 0)
            try:
                context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), none)
                if version % FULL_EVERY == 0:
                    self._store_full(version)
                return version
            except Exception as lost:  # py4j wraps Java's FileAlreadyExistsException
                self._fs.delete(draft, False)
                if "FileAlreadyExists" not in str(lost):
                    raise

    def _write(self, df: DataFrame) -> list[Shard]:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", self.codec).parquet(f"{self.path}/{folder}")
        sizes = {f.getPath().getName(): f.getLen() for f in self._fs.listStatus(self._at(folder)) if f.getPath().getName().startswith("part-")}
        if not sizes:
            return []
        counted = self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}").groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
        rows = {r.name: r.n for r in counted.collect()}
        return [Shard(f"{folder}/{name}", size, rows[name]) for name, size in sorted(sizes.items()) if rows.get(name)]

    def append(self, arrival: DataFrame) -> int:
        """Write the arrival's partitions as shards and commit them; the version."""
        schema = arrival.schema.json()
        new = self._write(arrival)

        def change(held: dict):
            if held["schema"] not in (None, schema):
                raise ValueError("the arrival's schema is not the store's")
            return schema, [Shard(**s) for s in held["shards"]] + new

        return self._commit(change, "append")

    def _merge(self, old: list[Shard], schema: str) -> int | None:
        """Swap shards for files of the target's size; the version, None if that would not make fewer or another merge took them."""
        files = max(1, round(sum(s.bytes for s in old) / self.target_bytes))
        if files >= len(old):
            return None
        new = self._write(self._read(old, schema).coalesce(files))
        gone = {s.path for s in old}

        def change(held: dict):
            if not gone <= {s["path"] for s in held["shards"]}:
                return None
            return held["schema"], [Shard(**s) for s in held["shards"] if s["path"] not in gone] + new

        return self._commit(change, "compact")

    def compact(self) -> list[int]:
        """Merge runs of similar size until none is left; the versions committed."""
        done: list[int] = []
        while True:
            held = self.manifest()
            live = [Shard(**s) for s in held["shards"]]
            runs = similar_runs([s.bytes for s in live], self.target_bytes, self.min_run, self.spread, self.floor_bytes)
            with ThreadPoolExecutor(MERGES) as pool:
                made = [v for v in pool.map(lambda run: self._merge([live[i] for i in run], held["schema"]), runs) if v is not None]
            if not made:
                return done
            done += sorted(made)

    def _read(self, shards: list[Shard], schema: str | None) -> DataFrame:
        if schema is None:
            raise ValueError("the store has no version yet")
        kind = T.StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{s.path}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        held = self.manifest(version)
        return self._read([Shard(**s) for s in held["shards"]], held["schema"])

    def vacuum(self, keep: int = 1) -> None:
        """Drop all but the newest `keep` versions and every shard they do not name.  Not while an append or merge runs."""
        held = self.versions()
        stay = held[-keep:]
        named = {s.path for v in stay for s in self.shards(v)}
        if stay:
            self._store_full(stay[0])
        for v in held[:-keep]:
            for kind in ("json", "full"):
                self._fs.delete(self._at(f"_manifests/{v:020d}.{kind}"), False)
        folder = self._at("data")
        if not self._fs.exists(folder):
            return
        for arrival in self._fs.listStatus(folder):
            name = f"data/{arrival.getPath().getName()}"
            files = [f.getPath() for f in self._fs.listStatus(arrival.getPath())]
            live = [f for f in files if f"{name}/{f.getName()}" in named]
            if not live:
                self._fs.delete(arrival.getPath(), True)
            else:
                for f in files:
                    if f not in live:
                        self._fs.delete(f, False)


def shard_table(table: DataFrame, path: str, arrivals: int = 4, **how) -> ShardStore:
    """A store at path that took the table's files in `arrivals` groups, compacting after each."""
    spark, store = table.sparkSession, ShardStore(table.sparkSession, path, **how)
    files = sorted(table.inputFiles())
    if not files:
        store.append(table)
    size = -(-len(files) // max(1, min(arrivals, len(files) or 1))) if files else 1
    for at in range(0, len(files), size):
        store.append(spark.read.schema(table.schema).parquet(*files[at : at + size]))
        store.compact()
    return store
