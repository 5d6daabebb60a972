"""Language-model scores by stupid backoff: corpus counts joined back to every document's n-grams.

A document is scored by the other documents: c(g) is how often all rows but its own hold the n-gram
g.  A word has c(n-gram) / c(its context) for the longest n-gram up to `order` that some other row
holds, times `alpha` for each order given up; a single word has c(word), 1 at least, over the number
of the others' words.  The logarithms are summed per document.  No count is cut off: an n-gram
counts from its first occurrence elsewhere on, and leaving the own row out is what makes a text of
its own back off.

The relations are exploded n-grams (batch, n-gram, count) and the count table (n-gram, count), both
dealt by hash; they are kept in columns of many n-grams a row, since one row an n-gram costs several
times the limits of a cluster that holds the text.

1. Documents are packed into batches of about `batch_bytes` of whole texts, written once.
2. Orders are counted in rounds: 1 and 2, then 3, then the rest.  An n-gram that another row holds
   has a prefix and a suffix that it holds too, so a round explodes only n-grams whose parts of the
   round before were found; none that could count is left out.
3. Each batch's distinct n-grams (64-bit hashes, with their counts in the batch) go to hash
   partitions.  A frequent n-gram is one entry a batch, whatever its share of the corpus, and
   the number of partitions follows the corpus, so each stays small.
4. A partition sums the entries to its part of the count table and joins the table to them: each
   batch gets back what all others hold of its n-grams, in its own order.
5. The counts are joined to the batch's texts (bucketed tables, so only counts travel).  Words that no longer n-gram can improve are
   scored and summed per document; what the next round needs of the rest is written.

Everything gathered covers all documents: no sample, no cap on the vocabulary.

Nulls and edge cases: a null, empty or wordless text has n_words 0, score 0 and no per_word
(null); its doc_id may be null.  Repeated rows count, and are returned, as often as they occur, and
each is another document to the other.  An empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .scratch import drop, new_folder, release, written

ORDER, ALPHA, BATCH_BYTES, PARTITION_BYTES, TASK_BYTES, RUN_BYTES = 5, 0.4, 2 << 20, 8 << 20, 48 << 20, 1 << 19
_ZSTD = pa.Codec("zstd", compression_level=3)


def squeezed(data: bytes | np.ndarray) -> bytes:
    """Compressed, after the length."""
    data = bytes(data)
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return _ZSTD.decompress(data[8:], size, asbytes=True) if size else b""


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers as compressed byte planes: the zero bytes of small numbers lie together and pack to almost nothing."""
    return squeezed(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unsqueezed(data), dtype=np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their steps."""
    return packed(np.diff(keys, prepend=np.zeros(1, dtype=np.uint64)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def rounds(order: int) -> list[list[int]]:
    """Orders that are counted together."""
    return [some for r in ([1, 2], [3], range(4, order + 1)) if (some := [k for k in r if k <= order])]


def _pack(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    ids: list[int | None] = []
    sizes: list[int] = []
    parts: list[bytes] = []
    n_words = held = made = 0
    context = TaskContext.get()
    task = context.partitionId() if context else 0

    def batch_row() -> pa.RecordBatch:
        values = [pa.array([task << 32 | made]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([squeezed(b"".join(parts))], pa.binary()), pa.array([n_words], pa.int64()), pa.array([held], pa.int64())]
        return pa.RecordBatch.from_arrays(values, names=["batch", "ids", "sizes", "text", "n_words", "n_bytes"])

    for batch in batches:
        column = tx.column(batch, "doc_id").to_pylist()
        for row, stop, buf, doc_bytes in tx.chunks(tx.column(batch, "text"), limit // 4):
            ids += column[row:stop]
            sizes += np.diff(doc_bytes).tolist()
            parts.append(buf.tobytes())
            n_words += len(tx.Words(buf, doc_bytes, hashed=False).starts)
            held += len(buf)
            if held >= limit:
                yield batch_row()
                ids, sizes, parts, n_words, held, made = [], [], [], 0, 0, made + 1
    if ids:
        yield batch_row()


def following(seen: np.ndarray, place: np.ndarray, low: int, k: int) -> np.ndarray:
    """Ends of the k-grams that may be held elsewhere, given the ends of those of order `low` that are."""
    end = np.flatnonzero(seen & (place >= k - 1))
    for back in range(1, k - low + 1):
        end = end[seen[end - back]]
    return end


class _Grams:
    """The n-grams of a batch that a round counts: each document's first word, for each order the words they end at, and their hashes.

    Texts are hashed by runs of whole documents, so that only the hashes of a batch are held at once.
    """

    def __init__(self, text: bytes, sizes: list[int], orders: list[int], state: dict | None) -> None:
        buf = np.frombuffer(unsqueezed(text), dtype=np.uint8)
        doc_bytes = np.concatenate(([0], np.cumsum(np.asarray(sizes, dtype=np.int64))))
        firsts, places = [np.zeros(1, dtype=np.int64)], []
        ends: list[list[np.ndarray]] = [[] for _ in orders]
        hashes: list[list[np.ndarray]] = [[] for _ in orders]
        seen = None if state is None else np.unpackbits(np.frombuffer(unsqueezed(state["seen"]), dtype=np.uint8)).astype(bool)
        row = n = 0
        while row < len(sizes):
            stop = max(row + 1, int(np.searchsorted(doc_bytes, doc_bytes[row] + RUN_BYTES, side="right")) - 1)
            words = tx.Words(buf[doc_bytes[row] : doc_bytes[stop]], doc_bytes[row : stop + 1] - doc_bytes[row])
            place = np.arange(len(words.starts)) - words.first[:-1][words.doc_of_word()]
            prefix = tx.sums(words.hashes)
            for i, k in enumerate(orders):
                end = np.flatnonzero(place >= k - 1) if seen is None else following(seen[n : n + len(place)], place, orders[0] - 1, k)
                ends[i].append(end + n)
                hashes[i].append(tx.span_hash(prefix, end - k + 1, end + 1))
            firsts.append(words.first[1:] + n)
            places.append(place)
            row, n = stop, n + len(place)
        whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        self.first, self.place, self.ends = whole(firsts), whole(places), [whole(e) for e in ends]
        self.seen = None if seen is None else seen[:n]
        self.keys, self.at, self.counts = np.unique(np.concatenate([whole(h).astype(np.uint64) for h in hashes]), return_inverse=True, return_counts=True)

    def dealt(self, partitions: int) -> np.ndarray:
        """Each partition's first place in the keys: a partition is a range of hashes."""
        bounds = np.array([(p << 64) // partitions for p in range(1, partitions)], dtype=np.uint64)
        return np.concatenate(([0], np.searchsorted(self.keys, bounds), [len(self.keys)]))

    def elsewhere(self, others: np.ndarray) -> list[np.ndarray]:
        """For each order and n-gram what all other rows hold of it; others: what other batches hold of the keys."""
        stops = np.cumsum([len(e) for e in self.ends])
        rest = (others + self.counts)[self.at].astype(np.int64) - 1
        several = np.flatnonzero(self.counts[self.at] > 1)  # elsewhere an n-gram of the batch is its document's only one
        if len(several):
            doc = np.searchsorted(self.first, np.concatenate(self.ends)[several], side="right") - 1
            order = np.lexsort((doc, self.at[several]))
            pair = np.stack((self.at[several], doc))[:, order]
            head = np.flatnonzero(np.append(True, (pair[:, 1:] != pair[:, :-1]).any(axis=0)))
            own = np.diff(np.append(head, len(order)))
            rest[several[order]] += 1 - np.repeat(own, own)
        return np.split(rest, stops[:-1])


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}


def _entries(batches: Iterator[pa.RecordBatch], orders: list[int], partitions: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in _rows(batch):
            grams = _Grams(row["text"], row["sizes"], orders, row.get("state"))
            first = grams.dealt(partitions)
            full = np.flatnonzero(np.diff(first))
            for at in range(0, len(full), 64):
                some = full[at : at + 64]
                cut = lambda values, pack: pa.array([pack(values[first[p] : first[p + 1]]) for p in some], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([row["batch"]] * len(some), pa.int64()), cut(grams.keys, packed_keys), cut(grams.counts, packed)], names=["part", "batch", "keys", "counts"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of whole partitions: sum a partition's entries to its part of the count table and join the table to them."""
    parts: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in _rows(batch):
            parts.setdefault(row["part"], []).append((row["batch"], row["keys"], row["counts"]))
    for part in list(parts):
        held = parts.pop(part)
        entries = [unpacked_keys(k) for _, k, _ in held]
        stops = np.cumsum([len(k) for k in entries])
        _, at = np.unique(np.concatenate(entries), return_inverse=True)
        del entries
        counts = np.concatenate([unpacked(c) for _, _, c in held]).astype(np.int64)
        table = np.zeros(int(at.max(initial=-1)) + 1, dtype=np.int64)
        np.add.at(table, at, counts)
        others = np.split(table[at] - counts, stops[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in held], pa.int64()), pa.array([part] * len(held), pa.int64()), pa.array([packed(t) if t.any() else None for t in others], pa.binary()), pa.array([len(t) for t in others], pa.int64())], names=["batch", "part", "others", "n"])


def _scores(batches: Iterator[pa.RecordBatch], orders: list[int], order: int, alpha: float, total: int) -> Iterator[pa.RecordBatch]:
    """One round for whole batches: (batch, sums, state) with state null when no word is left."""
    for batch in batches:
        for row in _rows(batch):
            state = row.get("state")
            grams = _Grams(row["text"], row["sizes"], orders, state)
            answers = sorted(row["answers"] or [], key=lambda a: a["part"])
            others = np.concatenate([np.zeros(0, dtype=np.int64), *[np.zeros(a["n"], dtype=np.int64) if a["others"] is None else unpacked(a["others"]).astype(np.int64) for a in answers]])
            found = grams.elsewhere(others)
            n, place, low = len(grams.place), grams.place, orders[0] - 1
            n_words = np.diff(grams.first)
            doc = np.repeat(np.arange(len(n_words)), n_words)
            count, score, level = np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64)
            if state is None:
                sums, is_open = np.zeros(len(n_words)), np.ones(n, dtype=bool)
                rest = np.maximum(total - n_words, 1)[doc]
            else:
                sums = np.frombuffer(state["sums"], dtype=np.float64).copy()
                count[grams.seen] = unpacked(state["counts"])
                left = following(grams.seen, place, low, orders[0])
                is_open = np.zeros(n, dtype=bool)
                is_open[left] = True
                score[left], level[left] = np.log(count[left] / unpacked(state["contexts"]).astype(np.float64)), low
            context = np.zeros(0)
            for k, end, c in zip(orders, grams.ends, found, strict=True):
                context, count = count, np.zeros(n)
                count[end] = c
                if k == 1:
                    score, level = np.log(np.maximum(count, 1) / rest), np.ones(n, dtype=np.int64)
                else:
                    hit = end[c > 0]
                    score[hit], level[hit] = np.log(count[hit] / context[hit - 1]), k
            top = orders[-1]
            seen = count > 0
            left = following(seen, place, top, top + 1) if top < order else np.zeros(0, dtype=np.int64)
            closed = is_open.copy()
            closed[left] = False
            score += np.log(alpha) * (np.minimum(order, place + 1) - level)
            sums += np.bincount(doc[closed], weights=score[closed], minlength=len(n_words))
            new = {"words": packed(n_words), "sums": sums.tobytes(), "seen": squeezed(np.packbits(seen).tobytes()), "counts": packed(count[seen]), "contexts": packed(context[left - 1] if len(left) else np.zeros(0))}
            yield pa.RecordBatch.from_arrays([pa.array([row["batch"]], pa.int64()), pa.array([new], STATE)], names=["batch", "state"])


STATE = pa.struct([("words", pa.binary()), ("sums", pa.binary()), ("seen", pa.binary()), ("counts", pa.binary()), ("contexts", pa.binary())])
_STATE = "struct<words: binary, sums: binary, seen: binary, counts: binary, contexts: binary>"


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in _rows(batch):
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(unpacked(row["words"]).astype(np.int64)), pa.array(np.frombuffer(row["sums"], dtype=np.float64))], names=["doc_id", "n_words", "score"])


class _Bucketed:
    """A table in the shared folder, bucketed by batch, so that joins by batch move no text."""

    def __init__(self, df: DataFrame, name: str, buckets: int) -> None:
        self.spark = df.sparkSession
        self.path = new_folder(self.spark, name)
        self.table = self.path.rsplit("/", 1)[1].replace("-", "_")
        df.write.bucketBy(buckets, "batch").option("path", self.path).format("parquet").saveAsTable(self.table)

    def frame(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.table}")
        drop(self.spark, self.path)


@dataclass(frozen=True)
class _Plan:
    order: int
    alpha: float
    total: int
    partitions: int
    tasks: int

    def round(self, texts: DataFrame, state: DataFrame | None, orders: list[int]) -> _Bucketed:
        """The state after the round of these orders, of the texts and the state before it."""
        known = texts.select("batch", "sizes", "text")
        if state is not None:
            known = known.join(state.hint("merge"), "batch")
        entries = known.mapInArrow(lambda it: _entries(it, orders, self.partitions), "part long, batch long, keys binary, counts binary")
        answers = entries.repartitionById(self.partitions, F.col("part").cast("int")).mapInArrow(lambda it: _joined(it), "batch long, part long, others binary, n long")
        back = answers.repartition(self.tasks, "batch").groupBy("batch").agg(F.collect_list(F.struct("part", "others", "n")).alias("answers"))
        whole = known.join(back.hint("merge"), "batch", "left")
        return _Bucketed(whole.mapInArrow(lambda it: _scores(it, orders, self.order, self.alpha, self.total), f"batch long, state {_STATE}"), "states", self.tasks)


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, batch_bytes: int = BATCH_BYTES, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(doc_id, n_words, score, per_word) for each row of docs(doc_id, text), by all other rows."""
    if order < 1:
        raise ValueError("order must be at least 1")
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts, path = written(source.mapInArrow(lambda it: _pack(it, batch_bytes), "batch long, ids array<long>, sizes array<long>, text binary, n_words long, n_bytes long"), "batches")
    size = texts.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")).first()
    plan = _Plan(order, alpha, size["words"], max(8, -(-size["bytes"] // partition_bytes)), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["bytes"] // TASK_BYTES)))
    texts = _Bucketed(texts.select("batch", "ids", "sizes", "text").repartition(plan.tasks, "batch"), "texts", plan.tasks)
    drop(spark, path)
    state = None
    for orders in rounds(order):
        before, state = state, plan.round(texts.frame(), None if state is None else state.frame(), orders)
        if before is not None:
            before.drop()
        release(spark)
    sums = state.frame().select("batch", "state.words", "state.sums")
    scored = texts.frame().select("batch", "ids").join(sums.hint("merge"), "batch").mapInArrow(lambda it: _per_document(it), "doc_id long, n_words long, score double")
    return scored.withColumn("per_word", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))
