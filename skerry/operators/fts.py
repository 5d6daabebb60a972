"""Full-text search: query trees scored by BM25 over postings.

Postings are rows (_rowid, term, tf, dl, positions).  They come from an inverted index or, for rows
that no index covers, from the texts themselves: only the query's terms are kept, before anything
is shuffled.  The index is Parquet whose rows are a term's postings in a chunk of about CHUNK tokens,
in the terms' order within each chunk.  Pages are small, so that a term filter skips nearly all of
them, and building it neither shuffles nor sorts more than a chunk.

score = boost * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)), with k1 = 1.2, b = 0.75 and
idf = ln(1 + (n - df + 0.5) / (df + 0.5)).  Several columns of a multi-match give their best score; a
boost query takes negative_boost times the negative score off.  A phrase's tf is the number of
its occurrences (terms in order, at most `slop` other words between) and its idf the sum of its terms'.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Tokenizer

K1, B = 1.2, 0.75
MUST, SHOULD, MUST_NOT = "MUST", "SHOULD", "MUST_NOT"
#: Tokens that a Python worker sorts at once, whatever the size of an Arrow batch.
CHUNK = 1 << 20


class FtsQuery:
    def __and__(self, other: FtsQuery) -> BooleanQuery:
        return BooleanQuery([(MUST, self), (MUST, other)])

    def __or__(self, other: FtsQuery) -> BooleanQuery:
        return BooleanQuery([(SHOULD, self), (SHOULD, other)])

    def to_json(self) -> str:
        return json.dumps(self.to_dict())

    def to_dict(self) -> dict:
        raise NotImplementedError


@dataclass(frozen=True)
class MatchQuery(FtsQuery):
    """fuzziness None: 0, 1 or 2 edits for terms of up to 2, up to 5, or more letters."""

    query: str
    column: str | None = None
    boost: float = 1.0
    fuzziness: int | None = 0
    max_expansions: int = 50
    operator: str = "OR"
    prefix_length: int = 0

    def __post_init__(self) -> None:
        if self.operator.upper() not in ("OR", "AND"):
            raise ValueError("operator is OR or AND")

    def to_dict(self) -> dict:
        return {"match": {"column": self.column, "terms": self.query, "boost": self.boost, "fuzziness": self.fuzziness, "max_expansions": self.max_expansions, "operator": self.operator, "prefix_length": self.prefix_length}}


@dataclass(frozen=True)
class PhraseQuery(FtsQuery):
    query: str
    column: str | None = None
    slop: int = 0

    def to_dict(self) -> dict:
        return {"match_phrase": {"column": self.column, "terms": self.query, "slop": self.slop}}


@dataclass(frozen=True)
class BoostQuery(FtsQuery):
    positive: FtsQuery
    negative: FtsQuery
    negative_boost: float = 0.5

    def to_dict(self) -> dict:
        return {"boost": {"positive": self.positive.to_dict(), "negative": self.negative.to_dict(), "negative_boost": self.negative_boost}}


@dataclass(frozen=True)
class MultiMatchQuery(FtsQuery):
    query: str
    columns: Sequence[str]
    boosts: Sequence[float] | None = None
    operator: str = "OR"

    def __post_init__(self) -> None:
        if self.boosts is not None and len(self.boosts) != len(self.columns):
            raise ValueError("a boost for each column")

    def to_dict(self) -> dict:
        return {"multi_match": {"query": self.query, "columns": list(self.columns), "boost": list(self.boosts or [1.0] * len(self.columns)), "operator": self.operator}}


@dataclass(frozen=True)
class BooleanQuery(FtsQuery):
    queries: Sequence[tuple[str, FtsQuery]] = field(default_factory=list)

    def to_dict(self) -> dict:
        kinds = {k: [q.to_dict() for o, q in self.queries if o.upper() == k] for k in (MUST, SHOULD, MUST_NOT)}
        return {"boolean": {k.lower(): v for k, v in kinds.items()}}


def from_dict(body: dict | str) -> FtsQuery:
    body = json.loads(body) if isinstance(body, str) else body
    (kind, q), = body.items()
    if kind == "match":
        return MatchQuery(q["terms"], q.get("column"), q.get("boost", 1.0), q.get("fuzziness", 0), q.get("max_expansions", 50), (q.get("operator") or "OR").upper(), q.get("prefix_length", 0))
    if kind in ("match_phrase", "phrase"):
        return PhraseQuery(q["terms"], q.get("column"), q.get("slop", 0))
    if kind == "boost":
        return BoostQuery(from_dict(q["positive"]), from_dict(q["negative"]), q.get("negative_boost", 0.5))
    if kind == "multi_match":
        return MultiMatchQuery(q["query"], q["columns"], q.get("boost"), (q.get("operator") or "OR").upper())
    if kind == "boolean":
        return BooleanQuery([(k.upper(), from_dict(x)) for k in ("must", "should", "must_not") for x in q.get(k, [])])
    raise ValueError(f"unknown query {kind}")


# -- postings --------------------------------------------------------------------------------


def texts_of(column: Column, kind) -> Column:
    """One text of a column; the elements of a list follow one another."""
    from pyspark.sql import types as T

    return F.array_join(column, " ") if isinstance(kind, T.ArrayType) else column


def tokenized(rows: DataFrame, column: str, tokenizer: Tokenizer) -> DataFrame:
    """(_rowid, tokens) of the rows whose text is not null."""
    from .vector import field_of

    text = texts_of(F.col(column), field_of(rows.schema, column).dataType)
    return rows.select("_rowid", tokenizer.tokens(text).alias("tokens")).filter("tokens is not null")


def _pieces(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(row ids, lists of tokens) of CHUNK tokens or little more: large batches are cut between rows, small ones put together."""
    held: list[tuple[pa.Array, pa.Array]] = []
    count = 0
    for batch in batches:
        ends = np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            stop = min(int(np.searchsorted(ends, before + chunk - count)) + 1, len(ends))
            held.append((batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start)))
            count += int(ends[stop - 1]) - before
            start = stop
            if count >= chunk:
                yield _together(held)
                held, count = [], 0
    if held:
        yield _together(held)


def _together(held: list[tuple[pa.Array, pa.Array]]) -> tuple[pa.Array, pa.Array]:
    return tuple(pa.concat_arrays(column) for column in zip(*held, strict=True))


def _grouped(batches: Iterator[pa.RecordBatch], terms: Sequence[str] | None = None, chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Group each row's tokens (those among the terms, if given) by term: one sort of a chunk's tokens, whatever their number in a row."""
    for ids, lists in _pieces(batches, chunk):
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        if terms is not None:
            some = np.flatnonzero(pa.compute.is_in(coded.dictionary, value_set=pa.array(terms, coded.dictionary.type)).to_numpy(zero_copy_only=False)[codes]) if len(codes) else np.zeros(0, dtype=np.int64)
            codes, row, place = codes[some], row[some], place[some]
        order = np.lexsort((codes, row))
        codes, row, place = codes[order], row[order], place[order]
        heads, stops = _runs((codes[1:] != codes[:-1]) | (row[1:] != row[:-1]), len(codes))
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(row[heads])), coded.dictionary.take(pa.array(codes[heads])), pa.array(np.diff(stops).astype(np.int32)), pa.array(lengths[row[heads]].astype(np.int32)), pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(place.astype(np.int32)))],
            names=["_rowid", "term", "tf", "dl", "positions"],
        )


def _runs(differs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, starts and the end) of the runs of n values; differs says which of the second and later ones are not as the one before."""
    heads = np.concatenate(([0], np.flatnonzero(differs) + 1)) if n else np.zeros(0, dtype=np.int64)
    return heads, np.append(heads, n)


_BLOCK = "term string, n long, tokens long, rows array<long>, tfs array<int>, dls array<int>, positions array<array<int>>"


def _blocked(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """A row for each term of a chunk, in the terms' order, and one without a term that counts the chunk's texts and tokens."""
    for ids, lists in _pieces(batches, chunk):
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
        coded = lists.flatten().dictionary_encode()
        at = pa.compute.sort_indices(coded.dictionary)
        rank = np.empty(len(at), dtype=np.int32)
        rank[at.to_numpy(zero_copy_only=False)] = np.arange(len(at), dtype=np.int32)
        codes = rank[coded.indices.to_numpy(zero_copy_only=False)]
        row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        place = (np.arange(len(codes)) - np.repeat(np.cumsum(lengths, dtype=np.int64) - lengths, lengths)).astype(np.int32)
        order = np.argsort(codes, kind="stable")  # rows and places of a term stay in order
        codes, row, place = codes[order], row[order], place[order]
        heads, stops = _runs((codes[1:] != codes[:-1]) | (row[1:] != row[:-1]), len(codes))
        codes, row, tf = codes[heads], row[heads], np.diff(stops).astype(np.int32)
        _, ends = _runs(codes[1:] != codes[:-1], len(codes))
        of_terms = lambda values, ends=pa.array(ends.astype(np.int32)): pa.ListArray.from_arrays(ends, values)
        columns = [
            pa.concat_arrays([coded.dictionary.take(at), pa.nulls(1, coded.dictionary.type)]),
            pa.array(np.append(np.diff(ends), len(lengths))),
            pa.array(np.append(np.diff(stops[ends]), len(order))),
            of_terms(ids.take(pa.array(row))),
            of_terms(pa.array(tf)),
            of_terms(pa.array(lengths[row])),
            of_terms(pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(place))),
        ]
        yield pa.RecordBatch.from_arrays([c if len(c) > len(at) else pa.concat_arrays([c, pa.nulls(1, c.type)]) for c in columns], names=["term", "n", "tokens", "rows", "tfs", "dls", "positions"])


def blocks(tokens: DataFrame) -> DataFrame:
    """The rows of an index of (_rowid, tokens): each task's own texts, chunk by chunk; nothing is shuffled."""
    return tokens.select("_rowid", "tokens").mapInArrow(_blocked, _BLOCK)


def postings(tokens: DataFrame, terms: Sequence[str] | None = None) -> DataFrame:
    """The postings of (_rowid, tokens), all or of given terms, with positions from 0: grouped within each row, nothing is shuffled."""
    return tokens.select("_rowid", "tokens").mapInArrow(lambda it: _grouped(it, terms), "_rowid long, term string, tf int, dl int, positions array<int>")


class Source:
    """What a query over one column reads: postings of given terms, corpus counts, and the vocabulary."""

    tokenizer: Tokenizer

    def of_terms(self, terms: Sequence[str], positions: bool = False) -> DataFrame:
        """(_rowid, term, tf, dl), and positions if wanted."""
        raise NotImplementedError

    def frequencies(self, terms: Sequence[str]) -> DataFrame:
        """(term, df): in how many texts each term is."""
        return self.of_terms(terms).groupBy("term").agg(F.count("*").cast("double").alias("df"))

    def corpus(self) -> tuple[int, float]:
        """(texts, mean length)."""
        raise NotImplementedError

    def similar(self, term: str, edits: int, prefix: int, limit: int) -> list[str]:
        """Terms of the vocabulary within so many edits that share a prefix: nearest first, at most limit."""
        raise NotImplementedError


def _nearest_terms(vocabulary: DataFrame, term: str, edits: int, prefix: int, limit: int) -> list[str]:
    close = vocabulary.select("term").filter(F.col("term").startswith(term[:prefix])).filter(F.length("term").between(len(term) - edits, len(term) + edits))
    d = F.levenshtein(F.col("term"), F.lit(term), edits)
    return [r.term for r in close.withColumn("d", d).filter(F.col("d").between(0, edits)).distinct().orderBy("d", "term").limit(limit).collect()]


class TextSource(Source):
    """Postings straight from the texts."""

    def __init__(self, rows: DataFrame, column: str, tokenizer: Tokenizer) -> None:
        self.tokenizer, self._tokens = tokenizer, tokenized(rows, column, tokenizer)
        self._corpus: tuple[int, float] | None = None

    def of_terms(self, terms: Sequence[str], positions: bool = False) -> DataFrame:
        found = postings(self._tokens, list(terms))
        return found if positions else found.drop("positions")

    def corpus(self) -> tuple[int, float]:
        if self._corpus is None:
            r = self._tokens.agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("s")).first()
            self._corpus = (r.n, (r.s or 0) / r.n if r.n else 0.0)
        return self._corpus

    def similar(self, term, edits, prefix, limit):
        return _nearest_terms(self._tokens.select(F.explode("tokens").alias("term")), term, edits, prefix, limit)


class IndexSource(Source):
    """Postings of an index, and of the rows it doesn't cover from their texts."""

    def __init__(self, index: DataFrame, terms: DataFrame, n: int, tokens: int, tokenizer: Tokenizer, live: Callable[[DataFrame], DataFrame] | None = None, rest: TextSource | None = None) -> None:
        """terms: the vocabulary (a term may come more than once); live leaves out rows that are not as indexed any more, if there are any."""
        self.tokenizer, self._index, self._terms, self._n, self._sum, self._live, self._rest = tokenizer, index, terms, n, tokens, live, rest

    def _blocks(self, terms: Sequence[str]) -> DataFrame:
        return self._index.filter(F.col("term").isin(list(terms)))

    def of_terms(self, terms: Sequence[str], positions: bool = False) -> DataFrame:
        more = ["positions"] if positions else []
        found = self._blocks(terms).select("term", F.inline(F.arrays_zip("rows", "tfs", "dls", *more)))
        found = found.select(F.col("rows").alias("_rowid"), "term", F.col("tfs").alias("tf"), F.col("dls").alias("dl"), *more)
        if self._live is not None:
            found = self._live(found)
        return found if self._rest is None else found.unionByName(self._rest.of_terms(terms, positions))

    def frequencies(self, terms: Sequence[str]) -> DataFrame:
        if self._live is not None:
            return super().frequencies(terms)
        counts = self._blocks(terms).select("term", F.col("n").cast("double").alias("df"))
        counts = counts if self._rest is None else counts.unionByName(self._rest.frequencies(terms))
        return counts.groupBy("term").agg(F.sum("df").alias("df"))

    def corpus(self) -> tuple[int, float]:
        n, s = self._n, float(self._sum)
        if self._rest is not None:
            more, mean = self._rest.corpus()
            n, s = n + more, s + more * mean
        return n, s / n if n else 0.0

    def similar(self, term, edits, prefix, limit):
        vocabulary = self._terms.select("term")
        if self._rest is not None:
            vocabulary = vocabulary.union(self._rest._tokens.select(F.explode("tokens").alias("term")))
        return _nearest_terms(vocabulary, term, edits, prefix, limit)


def auto_fuzziness(term: str) -> int:
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def _idf(n: int, df: Column) -> Column:
    return F.log(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5))


def _saturation(tf: Column, dl: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(mean or 1.0)))


class Search:
    """Evaluates a query tree to (_rowid, _score)."""

    def __init__(self, spark, sources: dict[str, Source]) -> None:
        if not sources:
            raise ValueError("full-text search needs an inverted index on a string column")
        self.spark, self.sources = spark, sources

    def _source(self, column: str | None) -> Source:
        if column not in self.sources:
            raise ValueError(f"no inverted index on column {column}")
        return self.sources[column]

    def nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], "_rowid long, _score double")

    def run(self, q: FtsQuery) -> DataFrame:
        if isinstance(q, MatchQuery):
            if q.column is None:
                columns = list(self.sources)
                return self.best([self._match(MatchQuery(**vars(q) | {"column": c})) for c in columns])
            return self._match(q)
        if isinstance(q, PhraseQuery):
            return self.best([self._phrase(q, c) for c in ([q.column] if q.column else list(self.sources))])
        if isinstance(q, MultiMatchQuery):
            boosts = q.boosts or [1.0] * len(q.columns)
            return self.best([self._match(MatchQuery(q.query, c, b, operator=q.operator)) for c, b in zip(q.columns, boosts, strict=True)])
        if isinstance(q, BoostQuery):
            bad = self.run(q.negative).select("_rowid", F.col("_score").alias("_bad"))
            return self.run(q.positive).join(bad, "_rowid", "left").select("_rowid", (F.col("_score") - q.negative_boost * F.coalesce("_bad", F.lit(0.0))).alias("_score"))
        if isinstance(q, BooleanQuery):
            return self._boolean(q)
        raise TypeError(f"not a query: {q!r}")

    def best(self, parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out if len(parts) == 1 else out.groupBy("_rowid").agg(F.max("_score").alias("_score"))

    def _match(self, q: MatchQuery) -> DataFrame:
        source = self._source(q.column)
        terms = list(dict.fromkeys(source.tokenizer.of(self.spark, q.query)))
        if not terms:
            return self.nothing()
        group: dict[str, list[int]] = {}  # a term of the corpus and the query terms it stands for
        for i, t in enumerate(terms):
            edits = auto_fuzziness(t) if q.fuzziness is None else q.fuzziness
            for found in source.similar(t, edits, q.prefix_length, q.max_expansions) if edits else [t]:
                group.setdefault(found, []).append(i)
        if not group:
            return self.nothing()
        n, mean = source.corpus()
        hits = source.of_terms(list(group))
        df = source.frequencies(list(group))  # as many rows as the query has terms
        part = F.lit(q.boost) * _idf(n, F.col("df")) * _saturation(F.col("tf").cast("double"), F.col("dl").cast("double"), mean)
        scored = hits.join(F.broadcast(df), "term").select("_rowid", "term", part.alias("_part"))
        if q.operator.upper() == "AND":
            of = F.create_map(*[x for t, g in group.items() for x in (F.lit(t), F.array(*map(F.lit, g)))])
            both = scored.groupBy("_rowid").agg(F.sum("_part").alias("_score"), F.size(F.array_distinct(F.flatten(F.collect_list(of[F.col("term")])))).alias("_n"))
            return both.filter(F.col("_n") == len(terms)).select("_rowid", "_score")
        return scored.groupBy("_rowid").agg(F.sum("_part").alias("_score"))

    def _phrase(self, q: PhraseQuery, column: str) -> DataFrame:
        source = self._source(column)
        if not source.tokenizer.with_position:
            raise ValueError(f"the index on {column} holds no positions")
        terms = source.tokenizer.of(self.spark, q.query)
        if not terms:
            return self.nothing()
        n, mean = source.corpus()
        hits = source.of_terms(list(dict.fromkeys(terms)), positions=True)
        df = source.frequencies(list(dict.fromkeys(terms)))
        idf = df.select(_idf(n, F.col("df")).alias("i"), "term").groupBy().agg(F.sum("i").alias("_idf"))
        found = hits.groupBy("_rowid").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.first("dl").alias("dl"))
        found = found.filter(F.size("at") == len(set(terms)))

        def first_after(term: str, before: Column) -> Column:
            return F.array_min(F.filter(F.col("at")[F.lit(term)], lambda x: x > before))

        def ends_well(p: Column) -> Column:
            """Whether the phrase starts at p: each next term at its first place after the last one."""
            last = p
            for t in terms[1:]:
                last = first_after(t, last)
            return F.coalesce(last - p - (len(terms) - 1) <= q.slop, F.lit(False))

        tf = F.size(F.filter(F.col("at")[F.lit(terms[0])], ends_well)).cast("double")
        counted = found.select("_rowid", "dl", tf.alias("tf")).filter("tf > 0")
        return counted.crossJoin(F.broadcast(idf)).select("_rowid", (F.col("_idf") * _saturation(F.col("tf"), F.col("dl").cast("double"), mean)).alias("_score"))

    def _boolean(self, q: BooleanQuery) -> DataFrame:
        kinds = {k: [self.run(x) for o, x in q.queries if o.upper() == k] for k in (MUST, SHOULD, MUST_NOT)}
        if not kinds[MUST] and not kinds[SHOULD]:
            raise ValueError("a boolean query needs a MUST or SHOULD part")
        out = None
        for p in kinds[MUST]:
            out = p if out is None else out.join(p.withColumnRenamed("_score", "_more"), "_rowid").select("_rowid", (F.col("_score") + F.col("_more")).alias("_score"))
        if kinds[SHOULD]:
            should = kinds[SHOULD][0]
            for p in kinds[SHOULD][1:]:
                should = should.unionByName(p)
            should = should.groupBy("_rowid").agg(F.sum("_score").alias("_score"))
            out = should if out is None else out.join(should.withColumnRenamed("_score", "_more"), "_rowid", "left").select("_rowid", (F.col("_score") + F.coalesce("_more", F.lit(0.0))).alias("_score"))
        for p in kinds[MUST_NOT]:
            out = out.join(p.select("_rowid"), "_rowid", "left_anti")
        return out


def of_string(query: str | FtsQuery | dict, columns: Sequence[str] | str | None = None, phrase: bool = False) -> FtsQuery:
    """A query of a string over the columns given (None: all that are indexed)."""
    if isinstance(query, FtsQuery):
        return query
    if isinstance(query, dict):
        return from_dict(query)
    columns = [columns] if isinstance(columns, str) else list(columns or [])
    if phrase:
        return PhraseQuery(query, columns[0] if columns else None)
    return MatchQuery(query, columns[0] if columns else None) if len(columns) < 2 else MultiMatchQuery(query, columns)


def search_texts(frame: DataFrame, query: str | FtsQuery, columns: Sequence[str], tokenizer: Tokenizer | None = None) -> DataFrame:
    """(_rowid, _score) of a DataFrame with _rowid, without an index."""
    tokenizer = tokenizer or Tokenizer(with_position=True)
    return Search(frame.sparkSession, {c: TextSource(frame, c, tokenizer) for c in columns}).run(of_string(query, list(columns) if isinstance(query, str) else None))
