"""Indices: derived Parquet beside the table, and the catalogue entry that says what they cover.

Vector indices are inverted files: k-means centroids over a bounded sample, every row assigned to
its nearest centroid and written under that partition, so a probe is partition pruning.  Rows are
kept whole (flat) or as codes: sq (one byte a dimension), pq (a codeword a subspace) or rq (sign
bits of the residual).  Graph kinds (hnsw) are the same files without the graph.  Inverted text
indices are postings by chunks of texts, each in the order of terms.  Scalar kinds are postings too: (key, row id) sorted by key, a key being the value
(btree, bitmap), each element (label_list) or each three characters in a row (fm).  A query's condition
on such a column is looked up in them, and where few rows fit, their ids go into the scan's filter, so
that other row groups are skipped.  A btree may also cluster the table by its column.  An inverted index keeps its vocabulary (terms
and the number of their texts) as a table of its own, which is what fuzzy terms are looked up in.

An index covers the rows as they were at its version: rows written later are searched directly
and joined in, rows deleted or updated since are left out.
"""

from __future__ import annotations

import math
import re
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import replace as changed

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import Tokenizer
from ..sources.snapshot import ROW_ID, UPDATED
from . import fts, vector

VECTOR_KINDS = {"ivf_flat": "flat", "ivf_sq": "sq", "ivf_pq": "pq", "ivf_rq": "rq", "ivf_hnsw_flat": "flat", "ivf_hnsw_sq": "sq", "ivf_hnsw_pq": "pq"}
SCALAR_KINDS = ("btree", "bitmap", "label_list", "fm")
PROBES, SAMPLE_RATE, ITERATIONS, MAX_SAMPLE, SPREAD_START = 20, 256, 50, 1 << 20, 256
#: Distances that a step of k-means holds at once, and those of a whole step from which the executors take the steps.
STEP_CELLS, DRIVER_CELLS = 1 << 22, 1 << 30
#: Rows of the sample that fit codes (the centres are fitted on all of it).
CODE_SAMPLE = 1 << 16
#: The part of the partitions that a search probes by default, PROBES at least: recall falls with the share, not with the number.
PROBE_SHARE = 0.75
#: Characters of an fm index's keys, and the rows up to which a scalar index's answer goes into the scan's filter.
GRAM, MOST_IDS, KEY = 3, 10_000, "__key"
#: Commits after which every row that an index covers still is as it was.
_APPENDS = ("append", "compact", "primary_key", "field_metadata", "add_columns", "drop_columns", "computed_column", "view", "stream")
_POOL = ThreadPoolExecutor(4)


def _resolve(schema: T.StructType, path: str) -> str:
    """A column path as the schema writes it: exact, else regardless of case."""
    out, struct = [], schema
    for part in path.replace("`", "").split("."):
        names = [f.name for f in struct if f.name == part] or [f.name for f in struct if f.name.lower() == part.lower()]
        if len(names) != 1:
            raise ValueError(f"no column {path}")
        out.append(names[0])
        kind = struct[names[0]].dataType
        struct = kind if isinstance(kind, T.StructType) else T.StructType()
    return ".".join(out)


def _check_kind(kind: str, f: T.StructField) -> str:
    t = f.dataType
    vectorial = isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.FloatType, T.DoubleType))
    if kind == "auto":
        kind = "ivf_pq" if vectorial else "btree"
    plain = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)
    fits = {
        "btree": isinstance(t, plain), "bitmap": isinstance(t, plain), "label_list": isinstance(t, T.ArrayType), "fm": isinstance(t, (T.StringType, T.BinaryType)),
        "fts": isinstance(t, T.StringType) or (isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType)),
    }
    if kind not in fits and kind not in VECTOR_KINDS:
        raise ValueError(f"unknown index kind {kind}")
    if not fits.get(kind, vectorial):
        raise ValueError(f"a {kind} index does not fit column {f.name}: {t.simpleString()}")
    return kind


def create(table, column: str, kind: str = "auto", name: str | None = None, replace: bool = True, wait: bool = True, **params) -> dict | Future:
    """Build an index of one column; its catalogue entry, or a Future of it if wait is false."""
    if not isinstance(column, str):
        raise ValueError("an index covers one column")
    m = table.manifest()
    column = _resolve(m.schema, column)
    kind = _check_kind(kind.lower(), vector.field_of(m.schema, column))
    name = name or f"{column}_idx"
    if name in table.indices() and not replace:
        raise ValueError(f"index {name} exists")

    def build() -> dict:
        entry = {"name": name, "column": column, "kind": kind, "version": m.version, "at": time.time(), "params": params}
        if kind == "fts":
            entry |= _build_fts(table, column, m, params)
        elif kind in VECTOR_KINDS:
            entry |= _build_vector(table, column, m, kind, params)
        else:
            if kind == "btree" and params.get("cluster"):
                entry["version"] = _cluster(table, column)
            entry["paths"] = _build_keys(table._scan(table.log.read(entry["version"])), column, kind, _folder(table))
        held = {n: e for n, e in table.indices().items() if n != name}
        table.store.replace(table._index_file(), held | {name: entry})
        return entry

    return build() if wait else _POOL.submit(build)


def _cluster(table, column: str) -> int:
    def change(m):
        parts = max(1, -(-m.rows // 1_000_000))
        rows = table._scan(m).repartitionByRange(parts, F.col(column), ROW_ID).sortWithinPartitions(column, ROW_ID)
        return changed(m, files=table._write(m, rows)) if m.files else m

    return table._commit(change, "compact").version


def _folder(table) -> str:
    return f"{table.uri}/_indices/{uuid.uuid4().hex}"


# -- text ------------------------------------------------------------------------------------

#: Files of an inverted index hold a term's postings by chunks; those without this mark held them one a row.
_LAYOUT = "blocks"
#: Rows of a page of those files: what a term's lookup reads of each chunk.
_PAGE_ROWS = 1000


def _build_fts(table, column: str, m, params: dict, rows: DataFrame | None = None) -> dict:
    tokenizer = Tokenizer(**params)
    rows = table._scan(m) if rows is None else rows
    path = _folder(table)
    # every task writes the postings of its own texts: a frequent term lies in all files, and nothing is shuffled
    fts.blocks(fts.tokenized(rows, column, tokenizer)).write.options(**{"compression": "zstd", "parquet.page.row.count.limit": _PAGE_ROWS}).parquet(path)
    held = table.spark.read.parquet(path)
    size = held.filter("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("s")).first()
    terms = f"{path}-terms"
    held.filter("term is not null").groupBy("term").agg(F.sum("n").alias("df")).write.parquet(terms)
    return {"paths": [path], "terms": [terms], "texts": size.n, "tokens": size.s, "layout": _LAYOUT}


def fts_sources(table, indexed_only: bool = False) -> dict[str, fts.Source]:
    """A source for each column with an inverted index."""
    out: dict[str, fts.Source] = {}
    m = table.manifest()
    for entry in table.indices().values():
        if entry["kind"] != "fts":
            continue
        tokenizer = Tokenizer(**entry["params"])
        if entry["version"] > m.version or entry.get("layout") != _LAYOUT:  # an older version was checked out, or files of another layout
            out[entry["column"]] = fts.TextSource(table._scan(m), entry["column"], tokenizer)
            continue
        live, fresh = _since(table, entry)
        rest = None if fresh is None or indexed_only else fts.TextSource(fresh, entry["column"], tokenizer)
        out[entry["column"]] = fts.IndexSource(table.spark.read.parquet(*entry["paths"]), table.spark.read.parquet(*entry["terms"]), entry["texts"], entry["tokens"], tokenizer, live, rest)
    return out


def _since(table, entry: dict) -> tuple[Callable[[DataFrame], DataFrame] | None, DataFrame | None]:
    """(what leaves out rows that are not as indexed any more, None if all are; rows written since, None if there are none).

    Only files that came or went since are read, as long as the version that was indexed is kept.
    """
    m, built = table.manifest(), entry["version"]
    if m.version == built:
        return None, None
    held = table.log.versions()
    later = [v for v in held if built < v <= m.version]
    ops = [table.log.read(v).op for v in later]
    complete = len(later) == m.version - built  # pruned versions may have changed anything
    old = table.log.read(built) if built in held else None
    fresh = table._scan(m).filter(F.col(UPDATED) > built) if old is None else table.written_since(old, m)
    if complete and all(op in _APPENDS for op in ops):
        return None, fresh if "append" in ops else None
    if old is None:
        live = table._scan(m).filter(F.col(UPDATED) <= built).select(ROW_ID)
        return lambda rows: rows.join(live, ROW_ID, "left_semi"), fresh
    gone = table.vanished(old, m)
    return lambda rows: rows.join(gone, ROW_ID, "left_anti"), fresh


# -- scalars ---------------------------------------------------------------------------------


def _build_keys(rows: DataFrame, column: str, kind: str, path: str) -> list[str]:
    """Write (key, _rowid) of a scalar index; a null value has a null key in btree and bitmap, and none in the others."""
    value = F.col(column)
    if kind == "label_list":
        keys = F.explode(F.array_distinct(value))
    elif kind == "fm":
        text = value.cast("string")
        grams = F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda i: F.substring(text, i, GRAM))
        keys = F.explode(F.array_distinct(F.when(F.length(text) >= GRAM, grams)))
    else:
        keys = value
    # ranges over (key, row): a key of a third of all rows is split over many tasks and files
    rows.select(keys.alias(KEY), ROW_ID).repartitionByRange(KEY, ROW_ID).sortWithinPartitions(KEY, ROW_ID).write.option("compression", "zstd").parquet(path)
    return [path]


_CALL = re.compile(r"\(*\s*(array_contains|contains)\(`?([^`,()]+)`?,\s*(.+?)\)+\s*$", re.S)


def _fitting(table, entry: dict, condition: str) -> DataFrame | None:
    """Ids of the indexed rows that can meet a condition, None if the index can't tell."""
    column, keys = entry["column"], table.spark.read.parquet(*entry["paths"])
    if entry["kind"] in ("btree", "bitmap"):
        if "." in column:
            return None
        try:  # a condition on other columns does not resolve here
            return keys.withColumnRenamed(KEY, column).filter(F.expr(condition)).select(ROW_ID)
        except AnalysisException:
            return None
    call = _CALL.match(condition)
    if call is None or call[2].strip().lower() != column.lower() or (call[1] == "contains") != (entry["kind"] == "fm"):
        return None
    try:
        wanted = table.spark.range(1).select(F.expr(call[3])).first()[0]
    except AnalysisException:
        return None
    if wanted is None or (entry["kind"] == "fm" and (not isinstance(wanted, str) or len(wanted) < GRAM)):
        return None
    if entry["kind"] == "label_list":
        return keys.filter(F.col(KEY) == F.lit(wanted)).select(ROW_ID)
    grams = {wanted[i : i + GRAM] for i in range(len(wanted) - GRAM + 1)}
    return keys.filter(F.col(KEY).isin(sorted(grams))).groupBy(ROW_ID).agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select(ROW_ID)


def narrowed(table, rows: DataFrame, conditions: list[str]) -> DataFrame:
    """rows less those that an index shows to fail a condition: the conditions are still to be applied.

    An index answers for the rows that are as it saw them; rows written or changed since all stay.
    """
    held = [e for e in table.indices().values() if e["kind"] in SCALAR_KINDS and e.get("paths") and e["version"] <= table.version]
    for condition in conditions if held else ():
        for entry in held:
            fitting = _fitting(table, entry, condition)
            if fitting is None:
                continue
            ids = [r[0] for r in fitting.limit(MOST_IDS + 1).collect()]
            if len(ids) <= MOST_IDS:
                rows = rows.filter(F.col(ROW_ID).isin(ids) | (F.col(UPDATED) > entry["version"]))
            break
    return rows


# -- vectors ---------------------------------------------------------------------------------


def kmeans(rows: np.ndarray, k: int, iterations: int = ITERATIONS, seed: int = 1) -> np.ndarray:
    """k centroids (fewer if there are fewer rows) of a sample by Lloyd's iterations; empty ones restart at the farthest row.

    Up to SPREAD_START of them start far from each other (by squared distance), more start at random rows.
    """
    rng = np.random.default_rng(seed)
    rows = np.asarray(rows)
    k = min(k, len(rows))
    if k <= SPREAD_START:
        picked = [int(rng.integers(len(rows)))]
        gap = ((rows - rows[picked[0]]) ** 2).sum(axis=1, dtype=np.float64)
        for _ in range(k - 1):
            total = gap.sum()
            picked.append(int(rng.choice(len(rows), p=gap / total)) if total > 0 else int(rng.integers(len(rows))))
            gap = np.minimum(gap, ((rows - rows[picked[-1]]) ** 2).sum(axis=1, dtype=np.float64))
        centers = rows[picked].astype(np.float64)
    else:
        centers = rows[rng.choice(len(rows), k, replace=False)].astype(np.float64)
    at, step = np.full(len(rows), -1), max(1, STEP_CELLS // max(k, rows.shape[1]))
    for _ in range(iterations):
        new, gap, sums = np.empty(len(rows), dtype=np.int64), np.empty(len(rows)), np.zeros_like(centers)
        norms = (centers**2).sum(axis=1)
        for low in range(0, len(rows), step):
            some = rows[low : low + step].astype(np.float64)
            far = norms[None, :] - 2 * some @ centers.T
            near = far.argmin(axis=1)
            new[low : low + step], gap[low : low + step] = near, far[np.arange(len(some)), near] + (some**2).sum(axis=1)
            np.add.at(sums, near, some)
        if (new == at).all():
            break
        at = new
        counts = np.bincount(at, minlength=k)
        full = counts > 0
        centers[full] = sums[full] / counts[full][:, None]
        if not full.all():
            centers[~full] = rows[np.argsort(-gap)[: (~full).sum()]]
    return centers


def kmeans_frame(sample: DataFrame, k: int, dim: int, iterations: int = ITERATIONS, seed: int = 1) -> np.ndarray:
    """kmeans over a written sample(v array<float>): each step is one Arrow pass over it and one exchange of sums by centre.

    Starts at k rows picked by hash; a centre without rows stays where it is.  Only centres reach the driver.
    Steps end when the summed distance falls by less than a thousandth.
    """
    first = sample.orderBy(F.xxhash64("v", F.lit(seed))).limit(k).toArrow().column(0)
    centers = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in first.chunks]).reshape(-1, dim).astype(np.float64)
    names, kind, before = ["center", "n", "gap", "sum"], "center int, n long, gap double, sum binary", np.inf
    tasks = max(1, min(len(centers), sample.sparkSession.sparkContext.defaultParallelism * 4))

    def rows(sums: np.ndarray, counts: np.ndarray, gaps: np.ndarray) -> pa.RecordBatch:
        full = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(counts[full].astype(np.int64)), pa.array(gaps[full]), pa.array([s.tobytes() for s in sums[full]], pa.binary())], names=names)

    for _ in range(iterations):
        held = centers

        def assigned(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sums, counts, gaps, norms = np.zeros_like(held), np.zeros(len(held)), np.zeros(len(held)), (held**2).sum(axis=1)
            step = max(1, STEP_CELLS // max(held.shape))
            for batch in batches:
                _, v = vector.matrix(batch.column(0), dim)
                for low in range(0, len(v), step):
                    some = v[low : low + step].astype(np.float64)
                    far = norms[None, :] - 2 * some @ held.T
                    near = far.argmin(axis=1)
                    np.add.at(sums, near, some)
                    np.add.at(gaps, near, far[np.arange(len(some)), near] + (some**2).sum(axis=1))
                    counts += np.bincount(near, minlength=len(held))
            yield rows(sums, counts, gaps)

        def joined(batches: Iterator[pa.RecordBatch], shape=held.shape) -> Iterator[pa.RecordBatch]:
            sums, counts, gaps = np.zeros(shape), np.zeros(shape[0]), np.zeros(shape[0])
            for batch in batches:
                at = batch.column(0).to_numpy(zero_copy_only=False)
                np.add.at(counts, at, batch.column(1).to_numpy(zero_copy_only=False))
                np.add.at(gaps, at, batch.column(2).to_numpy(zero_copy_only=False))
                np.add.at(sums, at, np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.float64).reshape(-1, shape[1]))
            yield rows(sums, counts, gaps)

        made = sample.mapInArrow(assigned, kind).repartition(tasks, "center").mapInArrow(joined, kind).toArrow()
        at, n = (made.column(c).to_numpy() for c in ("center", "n"))
        centers = held.copy()
        centers[at] = np.frombuffer(b"".join(made.column("sum").to_pylist()), dtype=np.float64).reshape(-1, dim) / n[:, None]
        now = float(made.column("gap").to_numpy().sum())
        if before - now <= 1e-3 * now:
            break
        before = now
    return centers


class Coder:
    """Vectors to bytes and back, for one partitioning."""

    def __init__(self, kind: str, centers: np.ndarray, low: np.ndarray | None = None, step: np.ndarray | None = None, books: np.ndarray | None = None) -> None:
        self.kind, self.centers, self.low, self.step, self.books = kind, centers, low, step, books
        self.dim = centers.shape[1]

    @staticmethod
    def fit(kind: str, sample: np.ndarray, centers: np.ndarray, sub_vectors: int, bits: int) -> Coder:
        if kind == "sq":
            low, high = sample.min(axis=0), sample.max(axis=0)
            return Coder(kind, centers, low, np.where(high > low, (high - low) / 255, 1.0))
        if kind == "pq":
            width = sample.shape[1] // sub_vectors
            books = [kmeans(sample[:, i * width : (i + 1) * width], 1 << bits, 20, seed=i) for i in range(sub_vectors)]
            least = max(len(b) for b in books)
            return Coder(kind, centers, books=np.stack([np.concatenate((b, np.repeat(b[-1:], least - len(b), axis=0))) for b in books]))
        return Coder(kind, centers)

    def encode(self, rows: np.ndarray, part: np.ndarray) -> np.ndarray:
        """(rows x bytes)"""
        if self.kind == "flat":
            return np.ascontiguousarray(rows.astype("<f4")).view(np.uint8).reshape(len(rows), -1)
        if self.kind == "sq":
            return np.clip(np.rint((rows - self.low) / self.step), 0, 255).astype(np.uint8)
        if self.kind == "pq":
            width = self.books.shape[2]
            return np.stack([((rows[:, None, i * width : (i + 1) * width] - b[None]) ** 2).sum(axis=2).argmin(axis=1) for i, b in enumerate(self.books)], axis=1).astype(np.uint8)
        rest = rows - self.centers[part]
        scale = np.abs(rest).mean(axis=1).astype("<f4")
        return np.concatenate((np.packbits(rest > 0, axis=1), scale.view(np.uint8).reshape(-1, 4)), axis=1)

    def decode(self, codes: np.ndarray, part: np.ndarray) -> np.ndarray:
        if self.kind == "flat":
            return np.ascontiguousarray(codes).view("<f4").reshape(len(codes), -1).astype(np.float64)
        if self.kind == "sq":
            return self.low + codes * self.step
        if self.kind == "pq":
            return np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)
        signs = np.unpackbits(codes[:, :-4], axis=1)[:, : self.dim].astype(np.float64) * 2 - 1
        return self.centers[part] + signs * np.ascontiguousarray(codes[:, -4:]).view("<f4").astype(np.float64)

    def to_row(self) -> dict:
        pack = lambda a: None if a is None else (np.asarray(a, dtype="<f8").tobytes(), list(np.shape(a)))
        return {"kind": self.kind} | {k: pack(getattr(self, k)) for k in ("centers", "low", "step", "books")}

    @staticmethod
    def from_row(row: dict) -> Coder:
        load = lambda v: None if v is None else np.frombuffer(bytes(v[0]), dtype="<f8").reshape(v[1])
        return Coder(row["kind"], *(load(row[k]) for k in ("centers", "low", "step", "books")))


_CODER = "kind string, " + ", ".join(f"{k} struct<data binary, shape array<int>>" for k in ("centers", "low", "step", "books"))


def default_sub_vectors(dim: int) -> int:
    return dim // 16 if dim % 16 == 0 else dim // 8 if dim % 8 == 0 else 1


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def _build_vector(table, column: str, m, kind: str, params: dict) -> dict:
    f = vector.field_of(m.schema, column)
    rows = table._scan(m).select(ROW_ID, F.col(column).cast("array<float>").alias("v")).filter("v is not null")
    first = rows.select(F.size("v").alias("n")).first()
    dim = f.metadata.get("dim") or (first.n if first else 0)
    if not dim or not m.rows:
        raise ValueError("a vector index needs rows to train on")
    metric = params.get("metric", "l2")
    if metric not in ("l2", "cosine", "dot"):
        raise ValueError("metric is l2, cosine or dot")
    parts = params.get("num_partitions") or (m.rows // params["target_partition_size"] if params.get("target_partition_size") else round(m.rows**0.5))
    parts = max(1, int(parts))
    if parts > MAX_SAMPLE:
        raise ValueError(f"more than {MAX_SAMPLE} partitions: k-means trains on a sample of as many rows at most")
    wanted = min(MAX_SAMPLE, max(parts * params.get("sample_rate", SAMPLE_RATE), 1 << 12))
    share = min(1.0, 1.2 * wanted / m.rows)  # a bounded sample, picked by hash of the row id
    picked = rows if share == 1.0 else rows.filter(F.pmod(F.xxhash64(ROW_ID), F.lit(1 << 20)) < int(share * (1 << 20)))
    picked = picked.filter((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))).limit(wanted).select("v")
    path, far = _folder(table), min(parts, wanted) * min(wanted, m.rows) > DRIVER_CELLS
    if far:
        if metric == "cosine":
            size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
            picked = picked.select(F.transform("v", lambda x: F.when(size > 0, x / size).otherwise(x).cast("float")).alias("v"))
        picked.repartition(table.spark.sparkContext.defaultParallelism * 4).write.parquet(f"{path}/sample")
        picked = table.spark.read.parquet(f"{path}/sample")
    column_of = (picked.limit(CODE_SAMPLE) if far else picked).toArrow().column(0)
    sample = np.concatenate([np.zeros(0, dtype=np.float32), *[c.flatten().to_numpy(zero_copy_only=False) for c in column_of.chunks]]).reshape(-1, dim)
    if not len(sample):
        raise ValueError("a vector index needs rows to train on")
    sample = _unit(sample) if metric == "cosine" else sample
    if far:
        centers = kmeans_frame(picked, parts, dim, params.get("max_iterations", ITERATIONS))
        centers = _unit(centers) if metric == "cosine" else centers
    else:
        centers = kmeans(sample, parts, params.get("max_iterations", ITERATIONS))
    sub = params.get("num_sub_vectors") or default_sub_vectors(dim)
    if dim % sub:
        raise ValueError("num_sub_vectors must divide the dimension")
    coder = Coder.fit(VECTOR_KINDS[kind], sample[:CODE_SAMPLE], centers, sub, params.get("num_bits", 8))
    table.spark.createDataFrame([coder.to_row()], _CODER).coalesce(1).write.parquet(f"{path}/coder")
    n = _write_codes(rows, coder, metric, dim, f"{path}/codes-{m.version}")
    return {"paths": [f"{path}/codes-{m.version}"], "coder": f"{path}/coder", "texts": n, "params": params | {"metric": metric, "num_partitions": len(centers), "num_sub_vectors": sub, "dim": dim}}


def _write_codes(rows: DataFrame, coder: Coder, metric: str, dim: int, path: str) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held = vector.matrix(batch.column(1), dim)
            sound = np.isfinite(held).all(axis=1)
            at, held = at[sound], held[sound]
            if not len(at):
                continue
            held = _unit(held) if metric == "cosine" else held
            part = np.concatenate([((x**2).sum(axis=1)[:, None] - 2 * x @ coder.centers.T + (coder.centers**2).sum(axis=1)).argmin(axis=1) for x in np.array_split(held, max(1, len(held) // 4096))])
            codes = coder.encode(held, part)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(part.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=[ROW_ID, "ivf_part", "code"])

    coded = rows.mapInArrow(run, f"{ROW_ID} long, ivf_part int, code binary")
    # a partition of a third of all rows is still many files: ranges are over (partition, row)
    coded.repartitionByRange("ivf_part", ROW_ID).write.option("compression", "zstd").partitionBy("ivf_part").parquet(path)
    return rows.sparkSession.read.parquet(path).count()


def vector_index(table, column: str) -> tuple[str, dict] | None:
    for name, entry in table.indices().items():
        if entry["kind"] in VECTOR_KINDS and entry["column"] == column and entry["version"] <= table.version:
            return name, entry
    return None


def probe(table, held: tuple[str, dict], queries: list, keep: int, probes: tuple[int, int | None] | None, refine: int, bounds: tuple[float | None, float | None], allowed: DataFrame | None, indexed_only: bool) -> DataFrame:
    """(query_index, _rowid, _distance): each query's `keep` nearest in the probed partitions and among rows that the index lacks."""
    entry = held[1]
    metric, column = entry["params"]["metric"], entry["column"]
    coder = Coder.from_row(table.spark.read.schema(_CODER).parquet(entry["coder"]).first().asDict(recursive=False))
    asked = np.asarray(queries, dtype=np.float64)
    scaled = _unit(asked) if metric == "cosine" else asked
    ranked = np.argsort(vector.distances("l2" if metric != "dot" else "dot", coder.centers, scaled), axis=1, kind="stable")
    usual = max(PROBES, math.ceil(PROBE_SHARE * len(coder.centers)))
    least, most = probes or (usual, usual)
    live, fresh = _since(table, entry)
    wide = keep * refine
    inner = bounds if coder.kind == "flat" and refine == 1 else (None, None)

    def search(n_probes: int) -> DataFrame:
        lists = [set(r[:n_probes].tolist()) for r in ranked]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, part = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
                for p in np.unique(part):
                    mine = [i for i, s in enumerate(lists) if int(p) in s]
                    if not mine:
                        continue
                    at = part == p
                    rows = coder.decode(codes[at], part[at])
                    for i, d in zip(mine, vector.distances(metric, rows, scaled[mine]), strict=True):
                        ok = ~np.isnan(d)
                        if inner[0] is not None:
                            ok &= d >= inner[0]
                        if inner[1] is not None:
                            ok &= d < inner[1]
                        some, near = ids[at][ok], d[ok]
                        best = np.lexsort((some, near))[:wide]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), i, dtype=np.int32)), pa.array(some[best]), pa.array(near[best])], names=["query_index", ROW_ID, "_distance"])

        codes = _codes(table, entry).filter(F.col("ivf_part").isin(sorted(set().union(*lists)))).select(ROW_ID, "ivf_part", "code")
        if live is not None:
            codes = live(codes)
        if allowed is not None:
            codes = codes.join(allowed, ROW_ID, "left_semi")
        found = codes.mapInArrow(run, f"query_index int, {ROW_ID} long, _distance double")
        return _best(found, wide)

    found = search(least)
    if most is None or most > least:
        counts = {r.query_index: r["count"] for r in found.groupBy("query_index").count().collect()}
        if any(counts.get(i, 0) < keep for i in range(len(asked))):
            found = search(most or len(coder.centers))
    if refine > 1:
        found = _refined(table, found, column, asked, metric)
    if fresh is not None and not indexed_only:
        rest = fresh if allowed is None else fresh.join(allowed, ROW_ID, "left_semi")
        found = found.unionByName(vector.nearest_of_many(rest, column, queries, metric, keep))
    return _best(vector.in_range(found, *bounds), keep)


def _codes(table, entry: dict) -> DataFrame:
    out = None
    for path in entry["paths"]:
        part = table.spark.read.parquet(path)
        out = part if out is None else out.unionByName(part)
    return out


def _best(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("query_index").orderBy("_distance", ROW_ID)
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= keep).drop("_r")


def _refined(table, found: DataFrame, column: str, queries: np.ndarray, metric: str) -> DataFrame:
    """found with exact distances of the rows' own vectors."""
    hits = found.select("query_index", ROW_ID)
    ids = [r[0] for r in hits.select(ROW_ID).distinct().limit(10_001).collect()]
    rows = table.scan().select(ROW_ID, F.col(column).alias("_v"))
    if len(ids) <= 10_000:
        rows = rows.filter(F.col(ROW_ID).isin(ids))
    dim = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held = vector.matrix(batch.column(2), dim)
            which = batch.column(0).to_numpy(zero_copy_only=False)[at]
            out = np.full(len(at), np.nan)
            for q in np.unique(which):
                out[which == q] = vector.distances(metric, held[which == q], queries[q : q + 1])[0]
            sound = ~np.isnan(out)
            at, out = pa.array(at[sound]), out[sound]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(out)], names=["query_index", ROW_ID, "_distance"])

    return hits.join(rows, ROW_ID).select("query_index", ROW_ID, "_v").mapInArrow(run, f"query_index int, {ROW_ID} long, _distance double")


# -- the catalogue ---------------------------------------------------------------------------


def stats(table, name: str) -> dict | None:
    entry = table.indices().get(name)
    if entry is None:
        return None
    live, fresh = _since(table, entry)
    new = 0 if fresh is None else fresh.count()
    covered = table.count_rows() - new
    if entry["kind"] in VECTOR_KINDS or entry["kind"] == "fts":  # null texts, and null or non-finite vectors, are in no index
        if live is None:
            covered = entry["texts"]
        elif entry["kind"] == "fts":
            covered = table.scan().filter((F.col(UPDATED) <= entry["version"]) & F.col(entry["column"]).isNotNull()).count()
        else:
            covered = live(_codes(table, entry).select(ROW_ID)).count()
    return {"index_type": entry["kind"], "column": entry["column"], "metric": entry["params"].get("metric"), "num_indexed_rows": covered, "num_unindexed_rows": new, "version": entry["version"]}


def wait(table, names, timeout: float) -> None:
    """Until the named indices exist and cover every row."""
    end = time.monotonic() + timeout
    while True:
        found = [stats(table, n) for n in names]
        if all(s is not None and s["num_unindexed_rows"] == 0 for s in found):
            return
        if time.monotonic() >= end:
            raise TimeoutError(f"indices not ready: {list(names)}")
        time.sleep(0.2)


def fold(table, name: str) -> dict:
    """Bring an index up to the newest version: appended rows are added to it; after other changes it is built anew."""
    entry = table.indices()[name]
    m = table.manifest()
    if entry["version"] == m.version:
        return entry
    live, fresh = _since(table, entry)
    if live is not None or (entry["kind"] == "fts" and entry.get("layout") != _LAYOUT):
        return create(table, entry["column"], entry["kind"], name, **{k: v for k, v in entry["params"].items() if k != "dim"})
    new = dict(entry) | {"version": m.version}
    if fresh is not None and entry["kind"] == "fts":
        more = _build_fts(table, entry["column"], m, entry["params"], fresh)
        new |= {"paths": entry["paths"] + more["paths"], "terms": entry["terms"] + more["terms"], "texts": entry["texts"] + more["texts"], "tokens": entry["tokens"] + more["tokens"]}
    elif fresh is not None and entry["kind"] in VECTOR_KINDS:
        coder = Coder.from_row(table.spark.read.schema(_CODER).parquet(entry["coder"]).first().asDict(recursive=False))
        path = f"{entry['coder'].removesuffix('/coder')}/codes-{m.version}"
        rows = fresh.select(ROW_ID, F.col(entry["column"]).cast("array<float>").alias("v")).filter("v is not null")
        n = _write_codes(rows, coder, entry["params"]["metric"], entry["params"]["dim"], path)
        new |= {"paths": [*entry["paths"], path], "texts": entry["texts"] + n}
    elif fresh is not None and entry.get("paths"):
        new["paths"] = entry["paths"] + _build_keys(fresh, entry["column"], entry["kind"], _folder(table))
    table.store.replace(table._index_file(), table.indices() | {name: new})
    return new
