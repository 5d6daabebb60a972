"""Removal of passages that an earlier document holds: suffix automata of reference shards.

A window is `window` consecutive words of one document.  A word goes if a window that covers
it also starts in a document with a smaller doc_id, judged on the input.

An automaton of a whole corpus has no size bound, so it is neither built nor broadcast.  The
reference is cut into shards that are bounded and that only the spans which can match visit:

1. One Arrow pass picks in each window the least-hashed `gram`-word gram (its anchor).  Equal
   windows have equal anchors, so a window can only repeat where its anchor repeats.  Runs of
   windows with one anchor are one row: (anchor, hash of the run's words, place).
2. Anchors of one document only are dropped.  Equal runs under an anchor fold into one context
   that keeps its least document (map-side combined: thousands of copies are one context).
3. The contexts of an anchor are a reference shard.  In order of doc_id each context is
   streamed through the suffix automaton of the earlier ones; its matching statistics give the
   maximal spans of `window` words or more, and then the context is added to the automaton.
4. A shard of more than `shard_contexts` contexts (a very common line in ever new
   surroundings) is cut finer, as often as it takes: its windows are dealt anew by their 2, 4, 8, ...
   least grams together, and at last by all their words.  Equal windows agree in every one of
   these keys, so none is parted from its like; equal pieces fold as in 2., and the pieces go
   through automata as in 3.  Every shard is one of bounded size in the end.
5. Spans are joined back to every place of their context and cut out of the whole texts.

Contexts are told apart by 64 bits over all their words beside the 64 bits of their anchor.

Nulls and edge cases: a null text has no words (n_words 0, kept text empty) and a null doc_id
is neither a reference nor cut.  Rows that repeat a doc_id are no references for each other.
Repeats inside one document stay.  Empty tables give empty results; extra columns are kept,
and columns named n_words or n_removed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .scratch import materialize

SHARD_CONTEXTS = 256


def _window_least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value of each run of `width` values and its leftmost index."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        right = values[step:] < values[:-step]
        values, at = np.where(right, values[step:], values[:-step]), np.where(right, at[step:], at[:-step])
        size += step
    return values, at


def runs(words: tx.Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor hash, context hash) of each run; places are word indices in the chunk."""
    n, counts = len(words.starts), np.diff(words.first)
    if not (counts >= window).any():
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    prefix = tx.sums(words.hashes)
    begin = np.arange(n - gram + 1)
    grams = tx.span_hash(prefix, begin, begin + gram)
    least, at = _window_least(grams, window - gram + 1)
    doc = words.doc_of_word()
    valid = np.flatnonzero(words.first[1:][doc[: len(least)]] - np.arange(len(least)) >= window)
    anchor = at[valid]
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(valid) != 1)
    head = np.flatnonzero(new)
    a, b, anchor = valid[head], valid[np.append(head[1:], len(valid)) - 1], anchor[head]
    context = tx.mix(tx.span_hash(prefix, a, b + window) + (anchor - a).astype(np.uint64))
    return doc[a], a, b, grams[anchor], context


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = tx.column(batch, "__id"), tx.column(batch, "__key")
        for row, _, buf, doc_bytes in tx.chunks(tx.column(batch, "__text")):
            words = tx.Words(buf, doc_bytes)
            doc, a, b, anchor, context = runs(words, window, gram)
            at = pa.array(doc + row)
            first = words.first[doc]
            yield pa.RecordBatch.from_arrays(
                [ids.take(at), keys.take(at), pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), pa.array((a - first).astype(np.int32)), pa.array((b - first + window).astype(np.int32))],
                names=["id", "key", "anchor", "context", "lo", "hi"],
            )


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the contexts' words, joined by one space, out of their documents."""
    for batch in batches:
        ids, spans = tx.column(batch, "__id"), tx.column(batch, "spans")
        for row, stop, buf, doc_bytes in tx.chunks(tx.column(batch, "__text")):
            words = tx.Words(buf, doc_bytes, hashed=False)
            out = []
            for i in range(stop - row):
                first, doc_id = words.first[i], ids[row + i].as_py()
                for s in spans[row + i].as_py():
                    lo, hi = first + s["lo"], first + s["hi"]
                    whole = buf[words.starts[lo] : words.ends[hi - 1]].tobytes()
                    out.append((s["anchor"], s["context"], doc_id, b" ".join(whole.split())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["anchor", "context", "id", "words"])


class SuffixAutomaton:
    """A suffix automaton over several word sequences; states 0.. with 0 the empty one."""

    __slots__ = ("follow", "length", "link")

    def __init__(self) -> None:
        self.link, self.length, self.follow = [-1], [0], [{}]

    def _state(self, length: int, link: int, follow: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.follow.append(follow)
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """The state of p's longest sequence and word, which q holds among longer ones."""
        follow, link = self.follow, self.link
        copy = self._state(self.length[p] + 1, link[q], follow[q].copy())
        while p >= 0 and follow[p].get(word) == q:
            follow[p][word] = copy
            p = link[p]
        link[q] = copy
        return copy

    def add(self, words: list[bytes]) -> None:
        follow, link, length, last = self.follow, self.link, self.length, 0
        for word in words:
            p, q = last, follow[last].get(word)
            if q is not None:
                last = q if length[q] == length[p] + 1 else self._split(p, q, word)
                continue
            last = self._state(length[p] + 1, 0, {})
            while p >= 0 and word not in follow[p]:
                follow[p][word] = last
                p = link[p]
            if p >= 0:
                q = follow[p][word]
                link[last] = q if length[q] == length[p] + 1 else self._split(p, q, word)

    def matches(self, words: list[bytes]) -> Iterator[int]:
        """For each word the length of the longest sequence ending there that the automaton holds."""
        follow, link, length, at, size = self.follow, self.link, self.length, 0, 0
        for word in words:
            to = follow[at].get(word)
            while to is None and at:
                at = link[at]
                size = length[at]
                to = follow[at].get(word)
            if to is not None:
                at, size = to, size + 1
            yield size


def repeated_spans(words: list[bytes], automaton: SuffixAutomaton, window: int) -> list[tuple[int, int]]:
    """Maximal spans of words covered by matches of `window` words or more."""
    out: list[tuple[int, int]] = []
    for end, size in enumerate(automaton.matches(words), 1):
        if size >= window:
            if out and end - size <= out[-1][1]:
                out[-1] = (min(out[-1][0], end - size), end)
            else:
                out.append((end - size, end))
    return out


def _shard_spans(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor and doc_id; a shard may cross batches."""
    anchor, automaton, waiting, waiting_id = None, SuffixAutomaton(), [], None
    for batch in batches:
        out = []
        for key, context, doc_id, passage in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            words = passage.split(b" ")
            if key != anchor:
                anchor, automaton, waiting, waiting_id = key, SuffixAutomaton(), [], doc_id
            elif doc_id != waiting_id:  # contexts of one document are no references for each other
                for held in waiting:
                    automaton.add(held)
                waiting, waiting_id = [], doc_id
            out += [(key, context, lo, hi) for lo, hi in repeated_spans(words, automaton, window)]
            waiting.append(words)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["anchor", "context", "lo", "hi"])


def piece_keys(words: tx.Words, window: int, gram: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, key) of every window: the hash of its `depth` least grams, or of all its words if it has no more grams."""
    doc = words.doc_of_word()
    at = np.flatnonzero(words.first[1:][doc] - np.arange(len(doc)) >= window)
    prefix = tx.sums(words.hashes)
    many = window - gram + 1
    if not len(at) or depth >= many:
        return at, tx.span_hash(prefix, at, at + window)
    begin = np.arange(len(doc) - gram + 1)
    grams = tx.span_hash(prefix, begin, begin + gram)
    keys = [np.sort(np.partition(np.lib.stride_tricks.sliding_window_view(grams, many)[at[k : k + 8192]], depth - 1, axis=1)[:, :depth], axis=1) for k in range(0, len(at), 8192)]
    key = np.zeros(len(at), dtype=np.uint64)
    for column in np.concatenate(keys).T:
        key = tx.mix(key + column)
    return at, key


def _pieces(batches: Iterator[pa.RecordBatch], window: int, gram: int, depth: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows with one key, as contexts of their own, with the places they have in theirs."""
    for batch in batches:
        for row, _, buf, doc_bytes in tx.chunks(tx.column(batch, "words"), 1 << 18):
            words = tx.Words(buf, doc_bytes)
            at, key = piece_keys(words, window, gram, depth)
            if not len(at):
                continue
            doc = words.doc_of_word()[at]
            head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (np.diff(at) != 1) | (doc[1:] != doc[:-1])))
            a, b, doc = at[head], at[np.append(head[1:], len(at)) - 1] + window, doc[head]
            context = tx.span_hash(tx.sums(words.hashes), a, b)
            take, first = pa.array(doc + row), words.first[doc]
            cut = [buf[words.starts[x] : words.ends[y - 1]].tobytes() for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [tx.column(batch, "anchor").take(take), tx.column(batch, "context").take(take), tx.column(batch, "id").take(take), pa.array(key[head].view(np.int64)), pa.array(context.view(np.int64)), pa.array((a - first).astype(np.int32)), pa.array((b - first).astype(np.int32)), pa.array(cut, pa.binary())],
                names=["of_anchor", "of_context", "id", "anchor", "context", "lo", "hi", "words"],
            )


def _cut(batches: Iterator[pa.RecordBatch], names: list[str], single_spaces: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, texts = tx.column(batch, "__spans"), tx.column(batch, "__text")
        for row, stop, buf, doc_bytes in tx.chunks(texts):
            words = tx.Words(buf, doc_bytes, hashed=False)
            n, n_docs = len(words.starts), stop - row
            held = spans.slice(row, n_docs)
            flat = held.flatten().flatten()
            lengths = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.repeat(words.first[:-1], lengths)
            delta = np.zeros(n + 1, dtype=np.int64)
            np.add.at(delta, first + flat[0].to_numpy(zero_copy_only=False), 1)
            np.add.at(delta, first + flat[1].to_numpy(zero_copy_only=False), -1)
            gone = np.cumsum(delta[:-1]) > 0
            doc = words.doc_of_word()
            removed = np.bincount(doc[gone], minlength=n_docs)
            if single_spaces:
                keep = np.flatnonzero(~gone)
                lead = np.ones(len(keep), dtype=np.int64)
                if len(keep):
                    lead[0] = 0
                    lead[1:] = doc[keep[1:]] == doc[keep[:-1]]
                size = words.ends[keep] - words.starts[keep] + lead
                stops = np.cumsum(size)
                source = np.arange(stops[-1] if len(keep) else 0) + np.repeat(words.starts[keep] - lead - (stops - size), size)
                data = buf[source]  # the byte before a word that is not its document's first is white space
                data[(stops - size)[lead == 1]] = 32
                ends = np.append(0, stops)[np.searchsorted(doc[keep], np.arange(n_docs), side="right")]
            else:
                after = np.append(words.starts[1:], len(buf))[gone]
                np.minimum(after, doc_bytes[doc[gone] + 1], out=after)
                change = np.zeros(len(buf) + 1, dtype=np.int64)
                np.add.at(change, words.starts[gone], 1)
                np.add.at(change, after, -1)
                stay = np.cumsum(change[:-1]) == 0
                data = buf[stay]
                ends = np.append(0, np.cumsum(stay))[doc_bytes[1:]]
            offsets = np.append(0, ends).astype(np.int32)
            text = pa.StringArray.from_buffers(n_docs, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
            extra = {"__text": text, "__n_words": pa.array(np.diff(words.first)), "__n_removed": pa.array(removed.astype(np.int64)), "__spans": held}
            yield pa.RecordBatch.from_arrays([extra[c] if c in extra else tx.column(batch, c).slice(row, n_docs) for c in names], names=names)


def _placed(places: DataFrame, contexts: DataFrame, found: DataFrame, keys: tuple[str, str]) -> DataFrame:
    """Spans (keys, lo, hi) in what holds the places(keys, id, anchor, context, lo, hi), by what was found in contexts(anchor, context, id).

    A place of a later document than its context's least one goes whole; in that one go the found spans.
    """
    lists = found.groupBy("anchor", "context").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    verdict = materialize(contexts.select("anchor", "context", F.col("id").alias("owner")).join(lists, ["anchor", "context"], "left"), "verdicts")
    whole = F.array(F.struct("lo", "hi"))
    inner = F.transform("found", lambda s: F.struct((s.lo + F.col("lo")).alias("lo"), (s.hi + F.col("lo")).alias("hi")))
    spans = places.join(verdict, ["anchor", "context"]).select(*keys, F.explode(F.when(F.col("id") > F.col("owner"), whole).otherwise(inner)).alias("s"))
    return spans.select(*keys, F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))


def resolved(passages: DataFrame, window: int, gram: int, shard_contexts: int, depth: int = 1) -> DataFrame:
    """(anchor, context, lo, hi) of repeated spans in passages(anchor, context, id, words), one row a context."""
    sizes = passages.groupBy("anchor").agg(F.count("*").alias("n"))
    last = depth > window - gram + 1  # keyed by all words: each shard is one context, and nothing is left to find
    small = passages.join(sizes.filter(F.lit(last) | (F.col("n") <= shard_contexts)).select("anchor"), "anchor", "left_semi")
    dealt = small.select("anchor", "context", "id", "words").repartition("anchor").sortWithinPartitions("anchor", "id")
    found = dealt.mapInArrow(lambda it: _shard_spans(it, window), "anchor long, context long, lo int, hi int")
    if last or sizes.filter(F.col("n") > shard_contexts).isEmpty():
        return found
    large = passages.join(sizes.filter(F.col("n") > shard_contexts).select("anchor"), "anchor", "left_semi")
    pieces = large.mapInArrow(lambda it: _pieces(it, window, gram, 2 * depth), "of_anchor long, of_context long, id long, anchor long, context long, lo int, hi int, words binary")
    pieces = materialize(pieces, "pieces")
    several = pieces.groupBy("anchor").agg(F.min("id").alias("_a"), F.max("id").alias("_b")).filter("_a < _b").select("anchor")
    pieces = materialize(pieces.join(several, "anchor", "left_semi"), "pieces")
    contexts = materialize(pieces.groupBy("anchor", "context").agg(F.min(F.struct("id", "words")).alias("r")).select("anchor", "context", "r.*"), "pieces")
    inner = resolved(contexts, window, gram, shard_contexts, 2 * depth)
    spans = _placed(pieces, contexts, inner, ("of_anchor", "of_context"))
    return found.unionByName(spans.select(F.col("of_anchor").alias("anchor"), F.col("of_context").alias("context"), "lo", "hi"))


def repeated_passages(docs: DataFrame, window: int = 50, gram: int = 16, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """The spans to cut: (__id, __key, __spans array<struct<lo, hi>>) of docs(__id, __key, __text); places count words, hi is excluded."""
    if not 1 <= gram <= window:
        raise ValueError("gram must be from 1 to window")
    known = docs.filter("__id is not null and __text is not null")
    places = known.mapInArrow(lambda it: _anchor_rows(it, window, gram), "id long, key long, anchor long, context long, lo int, hi int")
    places = materialize(places, "anchors")
    # written first, so that the join with it is a plain one, which Spark can split at a very common anchor
    shared = materialize(places.groupBy("anchor").agg(F.min("id").alias("_a"), F.max("id").alias("_b")).filter("_a < _b").select("anchor"), "anchors")
    places = materialize(places.join(shared, "anchor", "left_semi"), "shared")
    contexts = materialize(places.groupBy("anchor", "context").agg(F.min(F.struct("id", "key", "lo", "hi")).alias("r")).select("anchor", "context", "r.*"), "contexts")

    shards = contexts.groupBy("anchor").agg(F.count("*").alias("n"), F.min("id").alias("_a"), F.max("id").alias("_b")).filter("n > 1 and _a < _b")
    wanted = contexts.join(shards.select("anchor"), "anchor", "left_semi").groupBy(F.col("id").alias("__id"), F.col("key").alias("__key"))
    wanted = wanted.agg(F.collect_list(F.struct("anchor", "context", "lo", "hi")).alias("spans"))
    one = known.join(wanted, ["__id", "__key"]).select("__id", "__key", "__text", "spans")
    passages = one.mapInArrow(_passages, "anchor long, context long, id long, words binary")
    passages = materialize(passages.dropDuplicates(["anchor", "context"]), "passages")
    found = resolved(passages, window, gram, shard_contexts)
    spans = _placed(places, contexts, found, ("id", "key"))
    return spans.groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(F.collect_set(F.struct("lo", "hi")).alias("__spans"))


def remove_repeats(docs: DataFrame, window: int = 50, *, single_spaces: bool = False, **how) -> DataFrame:
    """docs with `text` cut, and n_words (before), n_removed added.

    single_spaces joins the kept words by one space; otherwise the rest of the text stays as it
    is and documents without a repeat are unchanged.
    """
    columns = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed")]
    other = [c for c in columns if c not in ("doc_id", "text")]
    source = docs.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__key"), F.col("text").cast("string").alias("__text"), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(other)])
    spans = repeated_passages(source.select("__id", "__key", "__text"), window, **how)
    joined = source.join(spans, ["__id", "__key"], "left")
    names = ["__id", "__text", *[f"__{i}" for i in range(len(other))], "__n_words", "__n_removed"]
    fields = {f.name: f for f in source.schema.fields}
    schema = T.StructType([fields.get(c) or T.StructField(c, T.LongType()) for c in names])
    out = joined.mapInArrow(lambda it: _cut(it, names, single_spaces), schema)
    named = {"__id": "doc_id", "__text": "text", "__n_words": "n_words", "__n_removed": "n_removed"} | {f"__{i}": c for i, c in enumerate(other)}
    back = {v: k for k, v in named.items()}
    return out.select(*[F.col(back[c]).alias(c) for c in [*columns, "n_words", "n_removed"]])
