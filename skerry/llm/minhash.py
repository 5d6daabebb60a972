"""MinHash near-duplicates with sequential Bayesian verification.

1. One Arrow pass makes each document's set of distinct word shingles (64-bit hashes), a
   commutative 128-bit print of the whole set, and a MinHash signature.
2. Documents with equal sets form classes (similarity 1); only one member of a class goes on,
   so thousands of copies cost one row each and never a pair.
3. Signatures are cut into bands; classes that agree in a band are candidates.  In each band
   bucket every class is first paired with one pivot, the class that stands in the fullest
   buckets (a star, so as many pairs as rows).
4. Candidates are compared in signature batches.  After each batch the posterior of the
   similarity (Beta prior, binomial matches) prunes the pair once the probability that it
   reaches the threshold falls below `miss`.
5. Survivors are verified exactly on the full shingle sets of whole texts.
6. Buckets that then still hold more than one component are cut into blocks of bounded size, and
   every two blocks of a bucket meet in one row.  There the pairs of different components go
   through the same sequential comparison and exact verification, and of the links found only
   those that join two components are emitted: a block of a thousand near copies gives at most
   a thousand rows, however many of its pairs are links, and no connection is lost.

Bands: 24 of 4 rows lose a pair of similarity 0.8 with probability 3e-6 (less above it); a
document in a group has many such pairs, and one verified path is enough.

Nulls and edge cases: a null or wordless text has no set, links with nothing and is its own
component; fewer words than a shingle form one shingle.  A null doc_id is never linked: its
component is null and it is kept.  Rows that repeat a doc_id are one node.  An empty table gives
an empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .components import components
from .scratch import materialize

BANDS, ROWS, BATCH = 24, 4, 16
BLOCK_SHINGLES, STRIP = 1 << 17, 64
N_HASHES = BANDS * ROWS
_RNG = np.random.default_rng(20240229)
_MUL = (_RNG.integers(0, 1 << 32, N_HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, N_HASHES, dtype=np.uint64).astype(np.uint32)
_U = np.uint64


def shingle_sets(buf: np.ndarray, doc_bytes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all documents one after the other, first index of each document)."""
    words = tx.Words(buf, doc_bytes, lower=True)
    counts = np.diff(words.first)
    n_docs = len(counts)
    spans = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    lengths = np.repeat(np.minimum(counts, size), spans)
    owner = np.repeat(np.arange(n_docs), spans)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(spans) - spans, spans) + words.first[:-1][owner]
    hashes = tx.span_hash(tx.sums(words.hashes), begin, begin + lengths)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return hashes, np.searchsorted(owner, np.arange(n_docs + 1))


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of N_HASHES 32-bit minima for each document; documents without shingles have rows of ones."""
    out = np.full((len(first) - 1, N_HASHES), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        low = (hashes >> _U(32)).astype(np.uint32)
        at = first[:-1][full]
        rows = np.empty((N_HASHES, len(full)), dtype=np.uint32)
        held = np.empty_like(low)
        for i in range(N_HASHES):
            np.multiply(low, _MUL[i], out=held)
            held += _ADD[i]
            rows[i] = np.minimum.reduceat(held, at)
        out[full] = rows.T
    return out


def _prints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = tx.column(batch, "doc_id"), tx.column(batch, "text")
        for row, stop, buf, doc_bytes in tx.chunks(texts):
            hashes, first = shingle_sets(buf, doc_bytes, size)
            counts = np.diff(first)
            prefix = np.zeros((2, len(hashes) + 1), dtype=np.uint64)
            for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                np.cumsum(tx.mix(hashes ^ _U(salt)), out=prefix[k, 1:])
            fp = prefix[:, first[1:]] - prefix[:, first[:-1]]
            sig = signatures(hashes, first)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(row, stop - row), pa.array(counts.astype(np.int64)), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), tx.binary_rows(sig.view(np.uint8).reshape(-1), np.arange(1, len(counts) + 1) * (4 * N_HASHES))],
                names=["doc_id", "n_shingles", "fp1", "fp2", "sig"],
            )


def least_matches(threshold: float, miss: float) -> np.ndarray:
    """For n = 0..N_HASHES compared minima, the fewest matches m at which P(similarity >= threshold | m of n) is miss or more.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and P(x >= t) is the
    probability of at most m successes in n + 1 draws of chance t.
    """
    out = np.zeros(N_HASHES + 1, dtype=np.int64)
    for n in range(1, N_HASHES + 1):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def bayes_filter(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which rows of signatures a, b survive the batch-by-batch comparison."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for at in range(0, N_HASHES, BATCH):
        stop = min(at + BATCH, N_HASHES)
        matches[alive] += (a[alive, at:stop] == b[alive, at:stop]).sum(axis=1)
        alive = alive[matches[alive] >= least[stop]]
        if not len(alive):
            break
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def _survivors(batches: Iterator[pa.RecordBatch], least: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint32).reshape(-1, N_HASHES) for i in (2, 3))
            keep = pa.array(bayes_filter(a, b, least))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["x", "y"])


def _exact(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        xs, ys, found = batch.column(0), batch.column(1), np.zeros(batch.num_rows, dtype=bool)
        texts = pa.concat_arrays([tx.column(batch, "text_x"), tx.column(batch, "text_y")])
        sets: list[np.ndarray] = []
        for _, _, buf, doc_bytes in tx.chunks(texts):
            hashes, first = shingle_sets(buf, doc_bytes, size)
            sets += np.split(hashes, first[1:-1])
        n = batch.num_rows
        for i in range(n):
            a, b = sets[i], sets[n + i]
            shared = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
            found[i] = shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared)
        keep = pa.array(found)
        yield pa.RecordBatch.from_arrays([xs.filter(keep), ys.filter(keep)], names=["u", "v"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, stop, buf, doc_bytes in tx.chunks(tx.column(batch, "text")):
            hashes, first = shingle_sets(buf, doc_bytes, size)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), tx.binary_rows(hashes.view(np.uint8), first[1:] * 8)], names=["rep", "shingles"])


class _Block:
    """Members of a bucket: ids, components, sets one after the other, and signatures."""

    def __init__(self, members: list[dict]) -> None:
        self.rep = np.array([m["rep"] for m in members], dtype=np.int64)
        self.component = np.array([m["component"] for m in members], dtype=np.int64)
        sizes = np.array([len(m["shingles"]) // 8 for m in members], dtype=np.int64)
        self.size, self.first = sizes, np.append(0, np.cumsum(sizes))
        self.hashes = np.frombuffer(b"".join(m["shingles"] for m in members), dtype=np.uint64)
        self.sig = signatures(self.hashes, self.first)

    def incidence(self, members: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
        """(members x vocabulary) ones where a member's set holds the shingle."""
        at = np.concatenate([np.arange(self.first[m], self.first[m + 1]) for m in members])
        owner = np.repeat(np.arange(len(members)), self.size[members])
        place = np.minimum(np.searchsorted(vocabulary, self.hashes[at]), len(vocabulary) - 1)
        held = vocabulary[place] == self.hashes[at]
        out = np.zeros((len(members), len(vocabulary)), dtype=np.float32)
        out[owner[held], place[held]] = 1
        return out

    def shingles(self, members: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([self.hashes[self.first[m] : self.first[m + 1]] for m in members]))


def block_links(a: _Block, b: _Block | None, percent: int, least: np.ndarray) -> list[tuple[int, int]]:
    """Links between members of a and of b (or within a) that together join every two components that a link joins."""
    inside, b = b is None, a if b is None else b
    above: dict[int, int] = {}

    def top(c: int) -> int:
        while (up := above.get(c, c)) != c:
            above[c] = above.get(up, up)
            c = up
        return c

    out: list[tuple[int, int]] = []
    for low in range(0, len(a.rep), STRIP):
        strip = np.arange(low, min(low + STRIP, len(a.rep)))
        tops_a, tops_b = (np.array([top(int(c)) for c in x]) for x in (a.component[strip], b.component))
        smaller, larger = np.minimum(a.size[strip][:, None], b.size[None, :]), np.maximum(a.size[strip][:, None], b.size[None, :])
        pairs = (tops_a[:, None] != tops_b[None, :]) & (100 * smaller >= percent * larger)
        if inside:
            pairs &= strip[:, None] < np.arange(len(b.rep))[None, :]
        x, y = np.nonzero(pairs)
        if not len(x):
            continue
        keep = np.concatenate([bayes_filter(a.sig[strip[x[k : k + 65536]]], b.sig[y[k : k + 65536]], least) for k in range(0, len(x), 65536)])
        x, y = x[keep], y[keep]
        if not len(x):
            continue
        mine, theirs = np.unique(x), np.unique(y)
        vocabulary = np.intersect1d(a.shingles(strip[mine]), b.shingles(theirs), assume_unique=True)
        if not len(vocabulary):
            continue
        shared = a.incidence(strip[mine], vocabulary) @ b.incidence(theirs, vocabulary).T
        x_at, y_at = np.searchsorted(mine, x), np.searchsorted(theirs, y)
        both = np.rint(shared[x_at, y_at]).astype(np.int64)
        found = 100 * both >= percent * (a.size[strip[x]] + b.size[y] - both)
        for i, j in zip(strip[x[found]].tolist(), y[found].tolist(), strict=True):
            p, q = top(int(a.component[i])), top(int(b.component[j]))
            if p != q:
                above[max(p, q)] = min(p, q)
                out.append((int(a.rep[i]), int(b.rep[j])))
    return out


def _block_links(batches: Iterator[pa.RecordBatch], percent: int, least: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            a, b = (batch.column(k)[i].as_py() for k in (0, 1))
            found = block_links(_Block(a), None if b is None else _Block(b), percent, least)
            if found:
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _verify(pairs: DataFrame, reps: DataFrame, held: DataFrame, size: int, percent: int, miss: float) -> DataFrame:
    """The pairs (x, y) of representatives that are links."""
    sig_x = reps.select(F.col("rep").alias("x"), F.col("sig").alias("sig_x"))
    sig_y = reps.select(F.col("rep").alias("y"), F.col("sig").alias("sig_y"))
    least = least_matches(percent / 100, miss)
    near = pairs.join(sig_x, "x").join(sig_y, "y").select("x", "y", "sig_x", "sig_y").mapInArrow(lambda it: _survivors(it, least), "x long, y long")
    near = materialize(near, "survivors")
    text_x, text_y = held.select(F.col("rep").alias("x"), F.col("text").alias("text_x")), held.select(F.col("rep").alias("y"), F.col("text").alias("text_y"))
    both = near.join(text_x, "x").join(text_y, "y").select("x", "y", "text_x", "text_y")
    return materialize(both.mapInArrow(lambda it: _exact(it, size, percent), "u long, v long"), "links")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = 1e-6, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    Links are pairs with 100 * |A & B| >= percent * |A | B| on sets of `shingle`-word shingles.
    component_id is the least doc_id reachable over links; kept marks that document.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = materialize(source.mapInArrow(lambda it: _prints(it, shingle), "doc_id long, n_shingles long, fp1 long, fp2 long, sig binary"), "prints")
    ruled = prints.filter("n_shingles > 0 and doc_id is not null")
    # written first, so that the joins with it are plain joins, which Spark can split at a class of many copies
    classes = materialize(ruled.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    # A doc_id on several rows with different texts may stand for several classes: they meet in one node.
    one = ruled.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "fp1", "fp2", "n_shingles"], "left_semi")
    reps = materialize(one.groupBy(F.col("doc_id").alias("rep"), "fp1", "fp2", "n_shingles").agg(F.min("sig").alias("sig")).select("rep", "n_shingles", "sig"), "members")
    texts = source.filter("doc_id is not null").select(F.col("doc_id").alias("rep"), "text")

    band = F.explode(F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(sig, {i * 4 * ROWS + 1}, {4 * ROWS})")) for i in range(BANDS)])).alias("bucket")
    banded = reps.select("rep", "n_shingles", band)
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    member = materialize(banded.join(shared, "bucket"), "buckets")
    # The centre of a group of copies agrees with most of them, so it stands in the fullest buckets: the best pivot.
    fame = member.groupBy("rep").agg(F.sum("n").alias("fame"))
    pivots = member.join(fame, "rep").groupBy("bucket").agg(F.max(F.struct("fame", (-F.col("rep")).alias("r"))).alias("p")).select("bucket", (-F.col("p.r")).alias("pivot"))
    member = materialize(member.join(pivots, "bucket").select("bucket", "rep", "n_shingles", "pivot"), "pivots")
    # Texts of all candidates, once; the candidates grow with the corpus, so they aren't broadcast at any size.
    held = materialize(texts.join(member.select("rep").distinct().hint("merge"), "rep", "left_semi").dropDuplicates(["rep", "text"]), "texts")
    stars = member.filter("rep != pivot").select(F.greatest("rep", "pivot").alias("x"), F.least("rep", "pivot").alias("y")).distinct()
    links = _verify(stars, reps, held, shingle, percent, miss)
    found = materialize(components(links), "components")

    # What a star cannot show: buckets that still hold several components.
    labelled = member.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "n_shingles", F.coalesce("component", "rep").alias("component"))
    of_members = (F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("_p1"), F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("_p2"), F.count("*").alias("_n"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.ceil(F.sum("n_shingles") / block_shingles).cast("int").alias("parts"), *of_members).filter("_lo < _hi")
    # buckets of the same members say the same: one of them stays
    mixed = mixed.groupBy("_p1", "_p2", "_n").agg(F.min(F.struct("bucket", "parts")).alias("one")).select("one.*")
    rest = materialize(labelled.join(mixed.select("bucket", "parts"), "bucket").select("bucket", "rep", "component", "parts", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part")), "mixed")
    sets = held.join(rest.select("rep").distinct(), "rep", "left_semi").select("rep", "text").mapInArrow(lambda it: _sets(it, shingle), "rep long, shingles binary")
    blocks = rest.join(sets, "rep").groupBy("bucket", "parts", "part").agg(F.collect_list(F.struct("rep", "component", "shingles")).alias("a"))
    blocks = materialize(blocks, "blocks")
    left = blocks.select("bucket", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"), "a")
    right = blocks.filter("part > 0").select("bucket", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("i"), F.col("part").alias("j"), F.col("a").alias("b"))
    facing = left.join(right, ["bucket", "i", "j"], "left").select("a", "b")
    least = least_matches(percent / 100, miss)
    more = materialize(facing.mapInArrow(lambda it: _block_links(it, percent, least), "u long, v long"), "more")
    final = components(links.union(more))

    member_of = prints.join(classes, ["fp1", "fp2", "n_shingles"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.least("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep"))
    joined = member_of.join(final.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("component_id").isNull() | (F.col("component_id") == F.col("doc_id")))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each group, the one of the least doc_id; columns as they were.

    A row that repeats both doc_id and text of another goes; rows that share a doc_id but not the text stay,
    and so do all rows of a null doc_id.
    """
    gone = near_duplicates(docs.select("doc_id", "text"), **how).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    packed = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__print"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    kept = packed.filter("__id is not null").join(gone.hint("merge"), F.col("__id").cast("long") == F.col("__gone"), "left_anti").dropDuplicates(["__id", "__print"])
    return kept.unionByName(packed.filter("__id is null"), allowMissingColumns=True).select("__row.*")
