"""Toxic passages by maximum-scoring segments of token log-odds.

Fit.  Tokens are runs of letters and digits, lower-cased (A-Z), and told apart by 64-bit hashes.  Every
token of the toxic and clean labelled texts is counted in a table.  A token's score is its
log-odds between the classes under a Dirichlet prior that is centred on the log-odds of its first
bytes (which have a prior of their own): seen tokens go by their counts, unseen ones by their
stem.  The model that travels holds the tokens whose score differs from their stem's by `evidence`
or more, and the stems whose score differs from 0 by as much; the rest says nothing that its
default does not.  It holds `most` of each at most: where more differ, those with the greatest
difference times log2(1 + count) stay, and the model is 32 MB at any size.  A drift is taken off, so clean text scores below 0.

Score.  The scores of a text are scanned once for all maximal-scoring segments (Ruzzo and Tompa).
Segment scores of clean text have an exponential tail, which is fitted on labelled clean texts that
were kept out of the counts: a text of n tokens has E = K n exp(-lambda S) segments of score S or
more by chance.  Segments with E below `e_value` are the toxic passages.  A text's evidence is that of
its r best segments for the r that says most: the chance that a Poisson number of mean E, at the
r-th best score, is r or more (so many scattered slurs count as much as one long tirade).
-log10 of it is mapped to a probability by a logistic curve fitted on the texts kept out of the
counts.  Tail and curve come from histograms of fixed size.

Every labelled row that `usable` admits is used; nothing is sampled.

Nulls and edge cases: a null, empty or wordless text has no segment and gets the curve's value
for score 0.  Labels that are null or have a null doc_id are ignored; if a doc_id is labelled
more than once, toxic wins.  With no labels, or only one class, every score is that class's
share (0 without labels).  Repeated rows score alike.  Empty tables give empty results; other
columns are kept, and columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .bounded import threshold
from .scratch import materialize

STEM_BYTES, EVIDENCE, MOST, HELD_TOKENS = 4, 0.5, 1 << 20, 1 << 20
STRENGTH, DRIFT, LOWEST, HIGHEST = 4.0, 1.5, -4.0, 8.0
BIN, BINS, ORIGIN = 0.25, 320, -60.0
#: Segments of clean text in the fitted tail (one in so many tokens, so many at least), and the bins of their scores.
TAIL_TOKENS, TAIL_LEAST, SCORE_BIN, SCORE_BINS = 500, 20, 1 / 64, 1 << 14


def hashed(buf: np.ndarray, doc_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, tx.Words]:
    """Hash and stem hash of every token of a chunk."""
    words = tx.Words(buf, doc_bytes, lower=True, space=tx.NOT_LETTERS)
    return words.hashes, words.prefix_hashes(STEM_BYTES), words


@dataclass
class Scores:
    """Scores by hash: ascending hashes and their scores."""

    keys: np.ndarray
    values: np.ndarray

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """The scores, NaN where there is none."""
        if not len(self.keys):
            return np.full(len(wanted), np.nan)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], np.nan)

    @classmethod
    def none(cls) -> Scores:
        return cls(np.zeros(0, dtype=np.uint64), np.zeros(0))

    @classmethod
    def collected(cls, frame: DataFrame) -> Scores:
        """Of frame(hash long, score double)."""
        table = frame.toArrow()
        keys = table.column(0).to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        return cls(keys[order], table.column(1).to_numpy()[order].astype(np.float64))


def maximal_segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of values, by Ruzzo and Tompa in linear time."""
    if not len(values) or values.max() <= 0:
        return []
    # neighbours of one sign act as one value: a maximal segment starts and ends with a whole positive run
    up = values > 0
    heads = np.flatnonzero(np.append(True, up[1:] != up[:-1]))
    runs = np.add.reduceat(values, heads)
    ends = np.append(heads[1:], len(values))
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, last entry with a lesser sum before
    total = 0.0
    for i in range(len(runs)):
        before, total = total, total + float(runs[i])
        if runs[i] <= 0:
            continue
        start, left = int(heads[i]), before
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((start, int(ends[i]), left, total, j))
    return [(a, b, high - low) for a, b, low, high, _ in stack]


@dataclass
class Model:
    tokens: Scores
    stems: Scores
    decay: float  # lambda
    factor: float  # K
    floor: float  # the least score of the fitted tail
    slope: float
    offset: float
    e_value: float = 1e-3

    def values(self, token: np.ndarray, stem: np.ndarray) -> np.ndarray:
        _, first, back = np.unique(token, return_index=True, return_inverse=True)  # a stem goes with its token
        own, usual = self.tokens.of(token[first]), self.stems.of(stem[first])
        return np.where(np.isnan(own), np.nan_to_num(usual), own)[back] - DRIFT

    def segments(self, values: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, float]]]:
        """Each document's maximal segments."""
        return [maximal_segments(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """-log10 of the chance of a document's segments, by the number of best ones that says most."""
        held = np.array([s[2] for s in segments if s[2] >= self.floor])
        if not len(held):
            return 0.0
        held = -np.sort(-held)
        return max(0.0, float(-poisson_tail(self.log_e(held, np.full(len(held), n)) * np.log(10)).min() / np.log(10)))

    def log_e(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 of the expected number of such segments in clean text."""
        return np.log10(self.factor * np.maximum(n, 1)) - self.decay * best / np.log(10)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of x = minus the evidence."""
        return 1 / (1 + np.exp(-np.clip(self.offset - self.slope * x, -40, 40)))


def poisson_tail(log_mean: np.ndarray) -> np.ndarray:
    """Log of P(N >= r) for a Poisson N of mean exp(log_mean[r - 1]), r = 1, 2, ...; 0 where the mean is above r."""
    r = np.arange(1, len(log_mean) + 1, dtype=np.float64)
    mean = np.exp(np.minimum(log_mean, 50.0))
    low = mean <= r
    small = np.where(low, mean, 0.0)
    term, series = np.ones(len(r)), np.ones(len(r))
    for j in range(1, 1000):
        term = term * small / (r + j)
        series += term
        if (term < 1e-12 * series).all():
            break
    out = r * log_mean - np.cumsum(np.log(r)) - small + np.log(series)
    return np.where(low, np.minimum(out, 0.0), 0.0)


def tail(counts: np.ndarray, tokens: int) -> tuple[float, float, float]:
    """(lambda, K, floor) of clean segments' scores, counted in bins of SCORE_BIN, in so many tokens."""
    above = np.cumsum(counts[::-1])[::-1]
    if above[0] < 2 or not tokens:
        return 1.0, 1.0, 0.0
    wanted = min(above[0], max(TAIL_LEAST, tokens // TAIL_TOKENS))
    at = int(np.flatnonzero(above >= wanted)[-1])  # the highest floor that leaves enough
    middle = (np.arange(at, len(counts)) - at + 0.5) * SCORE_BIN
    decay = float(above[at] / (counts[at:] * middle).sum())
    return decay, float(above[at] / tokens * np.exp(min(decay * at * SCORE_BIN, 500.0))), at * SCORE_BIN


def log_odds(toxic: Column, clean: Column, share: float, center: Column) -> Column:
    """Log of (toxic rate / clean rate) under a Dirichlet prior of STRENGTH tokens, split by class size and tilted by center."""
    tilt = F.exp(clipped(center) / 2)
    return F.log(toxic + STRENGTH * share * tilt) - F.log(clean + STRENGTH * (1 - share) / tilt) - F.lit(float(np.log(share / (1 - share))))


def clipped(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(LOWEST)), F.lit(HIGHEST))


def logistic(x: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(positive) = 1 / (1 + exp(-(offset - slope * x))) for counts at x, lightly ridged, by Newton's method."""
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), -x], axis=1)
    ridge = np.diag([1e-3, 1e-2])
    n = positive + negative
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        gradient = design.T @ (positive - n * p) - ridge @ beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, gradient)
        beta += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[1]), float(beta[0])


def _summed(parts: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (token, stem, toxic, clean), one of each token."""
    token, stem, toxic, clean = (np.concatenate(x) for x in zip(*parts, strict=True))
    token, at, back = np.unique(token, return_index=True, return_inverse=True)
    return [token, stem[at], *(np.bincount(back, weights=x, minlength=len(token)).astype(np.int64) for x in (toxic, clean))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums (token, stem, toxic, clean) of one partition's tokens, given out whenever HELD_TOKENS are held."""

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1].view(np.int64)), pa.array(held[2]), pa.array(held[3])], names=["token", "stem", "toxic", "clean"])

    parts: list = []
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for row, _, buf, doc_bytes in tx.chunks(tx.column(batch, "text")):
            token, stem, words = hashed(buf, doc_bytes)
            kind = toxic[row + words.doc_of_word()].astype(np.int64)
            parts.append(_summed([(token, stem, kind, 1 - kind)]))
            if len(parts) > 1 and sum(len(p[0]) for p in parts) > HELD_TOKENS:
                parts = [_summed(parts)]
                if len(parts[0][0]) > HELD_TOKENS // 2:
                    yield rows(parts[0])
                    parts = []
    if parts:
        yield rows(_summed(parts))


def _clean_scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(bin, n) of the segments of texts, and their tokens as bin -1."""
    for batch in batches:
        for _, _, buf, doc_bytes in tx.chunks(tx.column(batch, "text")):
            token, stem, words = hashed(buf, doc_bytes)
            scores = np.array([s[2] for found in model.segments(model.values(token, stem), words.first) for s in found])
            bins, n = np.unique(np.minimum(scores / SCORE_BIN, SCORE_BINS - 1).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(bins, -1)), pa.array(np.append(n, len(token)))], names=["bin", "n"])


def _measure(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, stop, buf, doc_bytes in tx.chunks(tx.column(batch, "text")):
            token, stem, words = hashed(buf, doc_bytes)
            found = model.segments(model.values(token, stem), words.first)
            says = np.array([model.evidence(f, n) for f, n in zip(found, np.diff(words.first), strict=True)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(row, stop - row), pa.array(-says)], names=["toxic", "x"])


def labelled(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """(text, toxic, fold) of the labelled documents that `usable` (over doc_id) admits; fold from 0 to 3.

    Both sides grow with the corpus, so neither is broadcast.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).filter(usable)
    texts = docs.filter(usable).select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.join(known.hint("merge"), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(4)).cast("int").alias("fold"))


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, e_value: float = 1e-3, evidence: float = EVIDENCE, most: int = MOST) -> Model:
    """Learn from docs(doc_id, text) and labels(doc_id, toxic): three quarters are counted, one quarter calibrates."""
    rows = materialize(labelled(docs, labels, F.lit(True) if usable is None else usable), "labelled")
    counted = rows.filter("fold > 0").select("text", "toxic").mapInArrow(_count, "token long, stem long, toxic long, clean long")
    tokens = materialize(counted.groupBy("token", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "tokens")
    n = tokens.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.coalesce(F.sum("clean"), F.lit(0)).alias("clean")).first()
    model = Model(Scores.none(), Scores.none(), 1.0, 1.0, 0.0, 0.0, 0.0, e_value)
    if not n.toxic or not n.clean:
        kinds = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
        share = kinds.get(1, 0) / max(1, sum(kinds.values()))
        model.offset = 40.0 * (1 if share > 0.5 else -1)
        return model
    share = n.toxic / (n.toxic + n.clean)
    stems = tokens.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    often = F.log2(1 + F.col("toxic") + F.col("clean"))
    stems = materialize(stems.select("stem", clipped(log_odds(F.col("toxic"), F.col("clean"), share, F.lit(0.0))).alias("usual"), often.alias("often")), "stems")

    def collected(rows: DataFrame, key: str, score: str, difference: Column) -> Scores:
        strong = rows.filter(F.abs(difference) >= evidence)
        weight = F.abs(difference) * F.col("often")
        floor = threshold(strong, weight, F.lit(1), evidence, most)  # often is 1 at least
        return Scores.collected(strong.filter(weight >= floor).select(key, score))

    model.stems = collected(stems, "stem", "usual", F.col("usual"))
    kept = stems.select("stem", "usual", F.when(F.abs("usual") >= evidence, F.col("usual")).otherwise(F.lit(0.0)).alias("default"))
    own = clipped(log_odds(F.col("toxic"), F.col("clean"), share, F.col("usual")))
    scored = materialize(tokens.join(kept.hint("merge"), "stem").select("token", own.alias("own"), "default", often.alias("often")), "scores")
    model.tokens = collected(scored, "token", "own", F.col("own") - F.col("default"))
    held = rows.filter("fold = 0")
    counted = held.filter("toxic = 0").select("text").mapInArrow(lambda it: _clean_scores(it, model), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    scores = np.zeros(SCORE_BINS)
    inside = counted["bin"] >= 0
    scores[counted["bin"][inside]] = counted["n"][inside]
    model.decay, model.factor, model.floor = tail(scores, int(counted["n"][~inside].sum()))
    measured = materialize(held.select("text", "toxic").mapInArrow(lambda it: _measure(it, model), "toxic int, x double"), "calibration")
    bins = measured.select("toxic", F.least(F.greatest(F.floor((F.col("x") - ORIGIN) / BIN), F.lit(0)), F.lit(BINS - 1)).alias("bin"))
    if bins.filter("toxic = 1").isEmpty() or bins.filter("toxic = 0").isEmpty():
        model.slope, model.offset = 1.0, -3.0
        return model
    found = bins.groupBy("bin").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q")).toPandas()
    x = ORIGIN + (found["bin"].to_numpy(dtype=float) + 0.5) * BIN
    model.slope, model.offset = logistic(x, found["p"].to_numpy(dtype=float), found["q"].to_numpy(dtype=float))
    return model


def _scored(batches: Iterator[pa.RecordBatch], model: Model, names: list[str], passage: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, stop, buf, doc_bytes in tx.chunks(tx.column(batch, "__text")):
            token, stem, words = hashed(buf, doc_bytes)
            segments = model.segments(model.values(token, stem), words.first)
            n = np.diff(words.first)
            p = model.probability(np.array([-model.evidence(found, k) for found, k in zip(segments, n, strict=True)], dtype=np.float64))
            passages = []
            for i, found in enumerate(segments):
                rows = []
                if found:
                    log_e = model.log_e(np.array([s[2] for s in found]), np.full(len(found), n[i]))
                    rows = [{"start": int(words.starts[words.first[i] + a] - doc_bytes[i]), "end": int(words.ends[words.first[i] + b - 1] - doc_bytes[i]), "score": float(s), "log10_e": float(e)} for (a, b, s), e in zip(found, log_e, strict=True) if e < np.log10(model.e_value)]
                passages.append(rows)
            made = {"__score": pa.array(p), "__passages": pa.array(passages, passage)}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else tx.column(batch, c).slice(row, stop - row) for c in names], names=names)


PASSAGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("log10_e", T.DoubleType())]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with toxic_score (0 to 1) and toxic_passages (byte places of every significant segment)."""
    kept = [c for c in docs.columns if c.lower() not in ("toxic_score", "toxic_passages")]
    source = docs.select(F.col("text").cast("string").alias("__text"), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(kept)])
    names = [*[f"__{i}" for i in range(len(kept))], "__score", "__passages"]
    fields = {f.name: f for f in source.schema.fields} | {"__score": T.StructField("__score", T.DoubleType()), "__passages": T.StructField("__passages", PASSAGES)}
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("log10_e", pa.float64())]))
    out = source.mapInArrow(lambda it: _scored(it, model, names, kind), T.StructType([fields[c] for c in names]))
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(kept)], F.col("__score").alias("toxic_score"), F.col("__passages").alias("toxic_passages"))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 0 modulo 5; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
