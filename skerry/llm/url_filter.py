"""URL filters: rules first, then a character language-model ratio.

Rules name a host and a path; a rule fits its host and all subdomains if the URL's path starts
with the rule's path, and the longest fitting rule decides.  URLs without a rule are judged by two
smoothed variable-order Markov models over the bytes of host and path, one of accepted URLs (an
allow rule fits) and one of rejected URLs (a block rule fits): orders 0 to `order` are blended by
Witten and Bell's rule, each order backing off to the next shorter context.  The difference of
the two log-likelihoods per byte is compared with a threshold from a logistic calibration on a
quarter of the ruled URLs that was kept out of the counts.  Where that quarter or the rest lacks
a class, all ruled URLs are counted and the threshold is 0.

Every ruled URL is counted, into a table by 64-bit hashes of context and of context and byte, and
every context and byte counts.  A model of `most` rows (class, context, byte) or fewer travels, in
64 MB at most.  A larger one stays a table, and what the URLs ask of it is joined: each different
context and byte that occurs in them is looked up once, the orders are blended one after the other
(a context has 256 bytes at most, so no key of these joins is hot), and each chunk of URLs gets
the values of its own.  Both ways give the same differences, up to rounding.

Nulls and edge cases: a URL that is null or has no `://` has an empty host and path, fits no rule
and has difference 0.  Without ruled URLs of both classes every other URL is allowed.  Repeated
rows are judged alike.  An empty table gives an empty result; other columns are kept, and
columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .scratch import materialize

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER, MOST = 5, 1 << 20
BIN, BINS, ORIGIN = 0.02, 1000, -10.0
LOWEST = 1e-300  # the least probability a logarithm is taken of
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def contexts(buf: np.ndarray, doc_bytes: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For k = 0..order the hash of every byte's context, and of context and byte; contexts end at the URL's start, which they mark."""
    n = len(buf)
    at = np.arange(n)
    start = np.repeat(doc_bytes[:-1], np.diff(doc_bytes))
    prefix = tx.sums(tx._BYTE_CODE[buf], tx._BYTE_POWERS)
    for k in range(order + 1):
        low = np.maximum(at - k, start)
        context = tx.mix(tx.span_hash(prefix, low, at, tx._BYTE_POWERS) + np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) + (at - k < start).astype(np.uint64))
        yield context, tx.mix(context + (buf.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))


def _none(kind: type) -> np.ndarray:
    return np.zeros(0 if kind is np.uint64 else (2, 0), dtype=kind)


@dataclass
class Calibrated:
    slope: float = field(default=1.0, kw_only=True)
    offset: float = field(default=0.0, kw_only=True)

    def threshold(self) -> float:
        return -self.offset / self.slope


@dataclass
class Model(Calibrated):
    """Counts by class (rejected, accepted) beside ascending hashes."""

    order: int
    joints: np.ndarray = field(default_factory=lambda: _none(np.uint64))
    joint: np.ndarray = field(default_factory=lambda: _none(np.float64))
    contexts: np.ndarray = field(default_factory=lambda: _none(np.uint64))
    total: np.ndarray = field(default_factory=lambda: _none(np.float64))
    kinds: np.ndarray = field(default_factory=lambda: _none(np.float64))  # different bytes seen after each context

    @classmethod
    def of(cls, order: int, kind: np.ndarray, context: np.ndarray, joint: np.ndarray, n: np.ndarray) -> Model:
        """Of rows (class, context, context and byte, count), each once."""
        model = cls(order)
        for name, keys, tables in (("joints", joint, {"joint": n}), ("contexts", context, {"total": n, "kinds": np.ones(len(n))})):
            held, at = np.unique(keys, return_inverse=True)
            setattr(model, name, held)
            for table, values in tables.items():
                setattr(model, table, np.stack([np.bincount(at[kind == k], weights=values[kind == k], minlength=len(held)) for k in (0, 1)]))
        return model

    def difference(self, buf: np.ndarray, doc_bytes: np.ndarray) -> np.ndarray:
        """Log-likelihood per byte as accepted minus as rejected, for each URL."""
        p = np.full((2, len(buf)), 1 / 256)
        for context, joint in contexts(buf, doc_bytes, self.order):
            at, known = _found(self.contexts, context)
            pair, held = _found(self.joints, joint)
            for k in (0, 1):
                total, kinds = (np.where(known, x[k][at], 0.0) if len(self.contexts) else np.zeros(len(buf)) for x in (self.total, self.kinds))
                seen = np.where(held, self.joint[k][pair], 0.0) if len(self.joints) else np.zeros(len(buf))
                mass = total + kinds
                p[k] = np.where(mass > 0, (seen + kinds * p[k]) / np.maximum(mass, 1), p[k])
        return _per_byte(np.log(np.maximum(p[1], LOWEST)) - np.log(np.maximum(p[0], LOWEST)), doc_bytes)

    def has_both(self) -> bool:
        return bool(self.total.shape[1] and self.total.sum(axis=1).all())


@dataclass
class Stored(Calibrated):
    """The counts as the table pairs(kind, context, joint, n), where they are too many to travel."""

    order: int
    pairs: DataFrame
    classes: int

    def has_both(self) -> bool:
        return self.classes == 2

    def blended(self, asked: DataFrame) -> DataFrame:
        """(joint, gain) of the longest contexts of asked(level, context, joint, shorter), each once."""
        none = F.lit(None)
        counts = [F.when(F.col("kind") == k, F.col("n")).otherwise(0).alias(f"seen{k}") for k in (0, 1)]
        pairs = self.pairs.select("context", "joint", none.cast("int").alias("level"), none.cast("long").alias("shorter"), *counts)
        wanted = asked.select("context", "joint", "level", "shorter", *[F.lit(0).cast("long").alias(f"seen{k}") for k in (0, 1)])
        summed = [f(c).alias(c) for f, c in ((F.max, "level"), (F.max, "shorter"), (F.sum, "seen0"), (F.sum, "seen1"))]
        after = Window.partitionBy("context")
        of_context = {f"{name}{k}": F.sum(x).over(after) for k in (0, 1) for name, x in (("total", F.col(f"seen{k}")), ("kinds", (F.col(f"seen{k}") > 0).cast("long")))}
        held = pairs.union(wanted).groupBy("context", "joint").agg(*summed).withColumns(of_context).filter("level is not null")
        held = materialize(held.drop("context"), "asked")
        found = None
        for level in range(self.order + 1):
            here = held.filter(F.col("level") == level)
            if found is None:
                here = here.withColumns({f"p{k}": F.lit(1 / 256) for k in (0, 1)})
            else:
                here = here.join(found.withColumnRenamed("joint", "shorter"), "shorter")
            blend = lambda k: F.when(F.col(f"total{k}") > 0, (F.col(f"seen{k}") + F.col(f"kinds{k}") * F.col(f"p{k}")) / (F.col(f"total{k}") + F.col(f"kinds{k}"))).otherwise(F.col(f"p{k}"))
            found = here.select("joint", *[blend(k).alias(f"p{k}") for k in (0, 1)])
        log = lambda k: F.log(F.greatest(F.col(f"p{k}"), F.lit(LOWEST)))
        return found.select("joint", (log(1) - log(0)).alias("gain"))

    def differences(self, rows: DataFrame) -> DataFrame:
        """rows with __llr, chunk by chunk; no row is moved by its URL, so copies of one spread."""
        order, schema = self.order, T.StructType([*rows.schema.fields, T.StructField("__llr", T.DoubleType())])
        rows = materialize(rows.mapInArrow(_chunked, T.StructType([*rows.schema.fields, T.StructField("__chunk", T.LongType())])), "chunks")
        urls = rows.select("__chunk", "__url")
        gains = self.blended(urls.mapInArrow(lambda it: _asked(it, order), "level int, context long, joint long, shorter long"))
        own = urls.mapInArrow(lambda it: _longest(it, order), "__chunk long, joint long").join(gains, "joint")
        return own.groupBy("__chunk").cogroup(rows.groupBy("__chunk")).applyInArrow(lambda held, chunk: _looked_up(held, chunk, order), schema)


def _per_byte(gains: np.ndarray, doc_bytes: np.ndarray) -> np.ndarray:
    """The mean of each URL's gains, 0 where it has none."""
    upto = np.concatenate(([0.0], np.cumsum(gains)))
    return (upto[doc_bytes[1:]] - upto[doc_bytes[:-1]]) / np.maximum(np.diff(doc_bytes), 1)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted in ascending keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(kind, context, joint, n) of each chunk of URLs, each once."""
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for row, stop, buf, doc_bytes in tx.chunks(tx.column(batch, "__url")):
            kind = np.repeat(label[row:stop], np.diff(doc_bytes)).astype(np.uint64)
            context, joint = (np.concatenate(x) for x in zip(*contexts(buf, doc_bytes, order), strict=True))
            kind = np.tile(kind, order + 1)
            key, first, counts = np.unique(tx.mix(joint + kind), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind[first].astype(np.int64)), pa.array(context[first].view(np.int64)), pa.array(joint[first].view(np.int64)), pa.array(counts)], names=["kind", "context", "joint", "n"])


def _differences(batches: Iterator[pa.RecordBatch], model: Model, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, stop, buf, doc_bytes in tx.chunks(tx.column(batch, "__url")):
            made = pa.array(model.difference(buf, doc_bytes))
            yield pa.RecordBatch.from_arrays([made if c == "__llr" else tx.column(batch, c).slice(row, stop - row) for c in names], names=names)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of their chunk."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        for row, stop, _, _ in tx.chunks(tx.column(batch, "__url")):
            yield batch.slice(row, stop - row).append_column("__chunk", pa.array(np.full(stop - row, number)))
            number += 1


def _asked(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(level, context, joint, joint of the level before) of each chunk's bytes, each once."""
    for batch in batches:
        for _, _, buf, doc_bytes in tx.chunks(tx.column(batch, "__url")):
            shorter = np.zeros(len(buf), dtype=np.uint64)
            for level, (context, joint) in enumerate(contexts(buf, doc_bytes, order)):
                held, first = np.unique(joint, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), level, dtype=np.int32)), *(pa.array(x.view(np.int64)) for x in (context[first], held, shorter[first]))], names=["level", "context", "joint", "shorter"])
                shorter = joint


def _longest(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(__chunk, joint) of the longest contexts of each chunk's bytes, once in a batch."""
    for batch in batches:
        numbers = tx.column(batch, "__chunk").to_numpy()
        for row, stop, buf, doc_bytes in tx.chunks(tx.column(batch, "__url")):
            *_, (_, joint) = contexts(buf, doc_bytes, order)
            chunk = np.repeat(numbers[row:stop], np.diff(doc_bytes))
            at = np.lexsort((joint, chunk))
            chunk, joint = chunk[at], joint[at]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (chunk[1:] != chunk[:-1]) | (joint[1:] != joint[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(chunk[new]), pa.array(joint[new].view(np.int64))], names=["__chunk", "joint"])


def _looked_up(held: pa.Table, chunk: pa.Table, order: int) -> pa.Table:
    """The rows of a chunk with __llr, by the gains of all its bytes in held(joint, gain)."""
    keys, first = np.unique(tx.column(held, "joint").to_numpy().view(np.uint64), return_index=True)
    gains = tx.column(held, "gain").to_numpy()[first]
    out = np.zeros(chunk.num_rows)
    for row, stop, buf, doc_bytes in tx.chunks(tx.column(chunk, "__url")):
        *_, (_, joint) = contexts(buf, doc_bytes, order)
        out[row:stop] = _per_byte(gains[np.searchsorted(keys, joint)], doc_bytes)
    return chunk.drop_columns(["__chunk"]).append_column("__llr", pa.array(out))


def differences(rows: DataFrame, model: Model | Stored) -> DataFrame:
    """rows(__url, ...) with __llr."""
    if isinstance(model, Stored):
        return model.differences(rows)
    names = [*rows.columns, "__llr"]
    return rows.mapInArrow(lambda it: _differences(it, model, names), T.StructType([*rows.schema.fields, T.StructField("__llr", T.DoubleType())]))


def counted(ruled: DataFrame, order: int, most: int = MOST) -> Model | Stored:
    rows = ruled.mapInArrow(lambda it: _count(it, order), "kind long, context long, joint long, n long")
    pairs = materialize(rows.groupBy("kind", "context", "joint").agg(F.sum("n").alias("n")), "characters")
    sizes = [r.n for r in pairs.groupBy("kind").agg(F.count("*").alias("n")).collect()]
    if sum(sizes) > most:
        return Stored(order, pairs, len(sizes))
    table = pairs.toArrow()
    kind, context, joint, n = (c.to_numpy().astype(np.int64) for c in table.columns)
    return Model.of(order, kind, context.view(np.uint64), joint.view(np.uint64), n.astype(np.float64))


def fit(ruled: DataFrame, order: int = ORDER, most: int = MOST) -> Model | Stored:
    """Learn from ruled(__url, kind): kind 1 accepted, 0 rejected."""
    from .toxicity import logistic

    fold = F.pmod(F.xxhash64("__url"), F.lit(4))
    model = counted(ruled.filter(fold > 0), order, most)
    held = differences(ruled.filter(fold == 0), model)
    place = F.least(F.greatest(F.floor((F.col("__llr") - ORIGIN) / BIN), F.lit(0)), F.lit(BINS - 1))
    found = held.groupBy(place.alias("bin")).agg(F.sum("kind").alias("p"), F.sum(1 - F.col("kind")).alias("q")).toPandas()
    p, q = found["p"].to_numpy(dtype=float), found["q"].to_numpy(dtype=float)
    if not p.sum() or not q.sum() or not model.has_both():
        model = counted(ruled, order, most)  # one part lacks a class: nothing to place the threshold by, so it is 0
        return model if model.has_both() else Model(order)
    x = ORIGIN + (found["bin"].to_numpy(dtype=float) + 0.5) * BIN
    slope, offset = logistic(-x, p / p.sum() * 100, q / q.sum() * 100)  # both classes weigh alike
    model.slope, model.offset = max(slope, 1e-6), offset
    return model


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, order: int = ORDER, most: int = MOST) -> DataFrame:
    """pages with host, path, rule, llr (the difference) and verdict."""
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "llr", "verdict")]
    source = pages.select(F.col("url").cast("string").alias("__u"), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(kept)])
    host, path = host_and_path(F.col("__u"))
    split = source.withColumns({"__host": host, "__path": path}).withColumn("__url", F.concat("__host", "__path"))
    rule, action = fitting_rule(F.col("__host"), F.col("__path"), rules)
    split = split.withColumns({"__rule": rule, "__action": action})
    ruled = split.filter("__action is not null").select("__url", (F.col("__action") == "allow").cast("int").alias("kind"))
    model = fit(ruled, order, most)
    found = differences(split.select(*[f"__{i}" for i in range(len(kept))], "__host", "__path", "__rule", "__action", "__url"), model)
    verdict = F.coalesce("__action", F.when(F.col("__llr") >= model.threshold(), "allow").otherwise("block"))
    return found.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(kept)], F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__llr").alias("llr"), verdict.alias("verdict"))
