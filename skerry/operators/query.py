"""The query builder: filters, projections, vector, text and hybrid search over one table, as one DataFrame.

Filters of repeated where() calls are joined by AND.  A prefilter (the default) applies before
top-k, a postfilter after it (and may leave less than the limit).  Vector and text searches give
10 rows unless limited; a plain scan gives all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import Expr, name, to_column
from ..sources import ingest
from ..sources.snapshot import ROW_ID
from . import fts, rerank, vector
from .vector import K


class Query:
    def __init__(self, table) -> None:
        self._table = table
        self._filters: list[Column] = []
        self._conditions: list[str] = []  # those of the filters that are text
        self._postfilter = False
        self._columns: list[Column] | None = None
        self._named: set[str] = set()
        self._limit: int | None = None
        self._all = False
        self._offset = 0
        self._order: list[Column] = []
        self._ties: list[Column] = []
        self._row_id = self._row_address = False
        self._scores = True
        self._vector: list | None = None
        self._vector_column: str | None = None
        self._metric: str | None = None
        self._range: tuple[float | None, float | None] = (None, None)
        self._probes: tuple[int, int | None] | None = None
        self._refine: int | None = None
        self._bypass = self._indexed_only = False
        self._fts: fts.FtsQuery | None = None
        self._text: str | None = None
        self._reranker: rerank.Reranker | None = None
        self._norm = "score"
        self._files: list[str] | None = None

    # -- building ------------------------------------------------------------------------------

    def where(self, condition: str | Expr | Column | bytes, prefilter: bool | None = None) -> Query:
        if isinstance(condition, bytes):
            raise NotImplementedError("Substrait filters: give SQL or an expression")
        self._filters.append(to_column(condition))
        if not isinstance(condition, Column):
            self._conditions.append(condition.to_sql() if isinstance(condition, Expr) else condition)
        if prefilter is not None:
            self._postfilter = not prefilter
        return self

    only_if = where

    def postfilter(self) -> Query:
        self._postfilter = True
        return self

    def select(self, columns: Sequence[str] | Mapping[str, str | Expr] | Sequence[tuple[str, str | Expr]]) -> Query:
        """Column names (dotted paths too), or aliases with SQL or expressions."""
        pairs = list(columns.items()) if isinstance(columns, Mapping) else list(columns)
        self._columns, self._named = [], set()
        for c in pairs:
            if isinstance(c, str):
                self._columns.append(F.col(name(c) if "`" not in c and "." in c else f"`{c.strip('`')}`"))
                self._named.add(c)
            else:
                alias, expression = c
                self._columns.append(to_column(expression).alias(alias))
                self._named.add(alias)
        return self

    def limit(self, n: int | None) -> Query:
        if n is not None and n < 0:
            raise ValueError("limit must not be negative")
        self._limit, self._all = n, False
        return self

    def all_matches(self) -> Query:
        """Every match of a text search, best first."""
        self._limit, self._all = None, True
        return self

    def offset(self, n: int) -> Query:
        if n < 0:
            raise ValueError("offset must not be negative")
        self._offset = n
        return self

    def order_by(self, *keys: str | tuple) -> Query:
        """Each a column, or (column, ascending, nulls_first)."""
        for k in keys:
            c, up, first = (k, True, False) if isinstance(k, str) else (*k, *(True, False)[len(k) - 1 :])
            column = F.col(name(c))
            self._order.append((column.asc_nulls_first() if first else column.asc_nulls_last()) if up else (column.desc_nulls_first() if first else column.desc_nulls_last()))
        return self

    def ties(self, *columns: str) -> Query:
        """Rows of equal score or distance go by these columns before their row ids, also where the limit cuts.

        Searches by a vector index and those of several vectors have row ids only.
        """
        self._ties = [F.col(f"`{c}`") for c in columns]
        return self

    def with_row_id(self, on: bool = True) -> Query:
        self._row_id = on
        return self

    def with_row_address(self, on: bool = True) -> Query:
        """`_rowaddr`: the data file and place of each row now."""
        self._row_address = on
        return self

    def without_scores(self) -> Query:
        """Don't append _distance, _score or _relevance_score unless selected."""
        self._scores = False
        return self

    def fragments(self, files: Sequence[str]) -> Query:
        """Read only these data files."""
        self._files = list(files)
        return self

    def nearest_to(self, query, column: str | None = None) -> Query:
        self._vector, self._vector_column = vector.coerce(query), column or self._vector_column
        return self

    def add_query_vector(self, query) -> Query:
        more = vector.coerce(query)
        held = self._vector or []
        self._vector = (held if vector.is_many(held) else [held] if held else []) + (more if vector.is_many(more) else [more])
        return self

    def column(self, column: str) -> Query:
        self._vector_column = column
        return self

    def metric(self, metric: str) -> Query:
        metric = metric.lower()
        if metric not in ("l2", "cosine", "dot", "hamming"):
            raise ValueError("metric is l2, cosine, dot or hamming")
        self._metric = metric
        return self

    distance_type = metric

    def distance_range(self, low: float | None = None, high: float | None = None) -> Query:
        """low <= distance < high."""
        self._range = (low, high)
        return self

    def nprobes(self, n: int) -> Query:
        return self.probes(n, n)

    def probes(self, least: int, most: int | None = None) -> Query:
        """Partitions to probe; up to `most` (None: all) if `least` give less than the limit."""
        if least < 1 or (most is not None and most < least):
            raise ValueError("probes: 1 <= least <= most")
        self._probes = (least, most)
        return self

    def refine_factor(self, factor: int) -> Query:
        if factor < 1:
            raise ValueError("refine_factor must be positive")
        self._refine = factor
        return self

    def ef(self, n: int) -> Query:
        """Candidates of a graph index; here as many more are kept for refinement."""
        self._refine = max(self._refine or 1, -(-n // max(self._limit or K, 1)))
        return self

    def approx_mode(self, mode: str) -> Query:
        if mode not in ("fast", "normal", "accurate"):
            raise ValueError("approx_mode is fast, normal or accurate")
        if mode == "accurate":
            self._refine = max(self._refine or 1, 4)
        return self

    def bypass_vector_index(self) -> Query:
        self._bypass = True
        return self

    def fast_search(self) -> Query:
        """Only rows that an index covers."""
        self._indexed_only = True
        return self

    def nearest_to_text(self, query: str | fts.FtsQuery | dict, columns: Sequence[str] | str | None = None) -> Query:
        self._fts = fts.of_string(query, columns)
        self._text = query if isinstance(query, str) else None
        return self

    full_text_search = nearest_to_text

    def phrase_query(self, on: bool = True) -> Query:
        if self._text is None:
            raise ValueError("phrase_query needs a string")
        held = getattr(self._fts, "column", None)
        self._fts = fts.of_string(self._text, held, phrase=on)
        return self

    def rerank(self, reranker: rerank.Reranker | None = None, normalize: str = "score", query: str | None = None) -> Query:
        if normalize not in ("rank", "score"):
            raise ValueError("normalize is rank or score")
        self._reranker, self._norm = reranker or rerank.RRF(), normalize
        self._text = query if query is not None else self._text
        return self

    # -- running -------------------------------------------------------------------------------

    def _rows(self) -> DataFrame:
        m = self._table.manifest()
        if not self._row_address:
            files = None if self._files is None else [f for f in m.files if f.path in self._files or f.path.rsplit("/", 1)[1] in self._files]
            rows = self._table._scan(m, files)
        else:
            rows = self._table._scan(m, None, named=True).withColumnRenamed("_file", "_rowaddr")
            rows = rows.withColumn("_rowaddr", F.concat_ws(":", "_rowaddr", F.col(ROW_ID).cast("string")))
            if self._files is not None:
                rows = rows.filter(F.substring_index("_rowaddr", ":", 1).isin([f.rsplit("/", 1)[-1] for f in self._files]))
        return rows

    def _filtered(self, rows: DataFrame) -> DataFrame:
        for c in self._filters:
            rows = rows.filter(c)
        return rows

    @property
    def _want(self) -> int:
        return K if self._limit is None else self._limit

    def _by_vector(self, keep: int) -> DataFrame:
        """The nearest `keep` rows with _distance (and query_index for several queries)."""
        from . import index

        query, low, high = self._vector, *self._range
        many = vector.is_many(query)
        schema = self._table.schema
        column = vector.vector_column(schema, len(query[0]) if many else len(query), self._vector_column)
        f = vector.field_of(schema, column)
        nested = isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.ArrayType)
        dim = f.metadata.get("dim")
        if dim is not None and not nested and any(len(q) != dim for q in (query if many else [query])):
            raise ValueError(f"{column} has {dim} dimensions")
        held = None if self._bypass else index.vector_index(self._table, column)
        metric = self._metric or (held[1]["params"]["metric"] if held else "cosine" if nested else "hamming" if isinstance(f.dataType, T.BinaryType) else "l2")
        rows = self._rows()
        source = rows if self._postfilter else self._filtered(rows)
        if nested:
            return vector.nearest(source, column, query if many else [query], metric, keep, 0, low, high, [*self._ties, ROW_ID])
        if held and held[1]["params"]["metric"] == metric and not nested:
            found = index.probe(self._table, held, query if many else [query], keep, self._probes, self._refine or 1, (low, high), None if self._postfilter or not self._filters else source.select(ROW_ID), self._indexed_only)
            out = found.join(source, ROW_ID) if many else self._lookup(source, found)
            return out if many else out.drop("query_index").orderBy("_distance", ROW_ID)
        if many:
            found = vector.nearest_of_many(source, column, query, metric, keep, low, high)
            return found.join(source, ROW_ID)
        return vector.nearest(source, column, query, metric, keep, 0, low, high, [*self._ties, ROW_ID])

    def _lookup(self, rows: DataFrame, hits: DataFrame) -> DataFrame:
        """Rows of a limited set of hits: their ids go into the scan's filter, so other row groups are skipped."""
        held = hits.collect() if self._want + self._offset <= 10_000 else None
        if held is None:
            return rows.join(hits, ROW_ID)
        small = self._table.spark.createDataFrame(held, hits.schema)
        return rows.filter(F.col(ROW_ID).isin([r[ROW_ID] for r in held])).join(F.broadcast(small), ROW_ID)

    def _by_text(self, keep: int | None) -> DataFrame:
        from . import index

        rows = self._rows()
        hits = fts.Search(self._table.spark, index.fts_sources(self._table, self._indexed_only)).run(self._fts)
        if self._filters and not self._postfilter:
            found = self._filtered(rows).join(hits, ROW_ID)
            return found if keep is None else found.orderBy(*self._best("_score")).limit(keep)
        if keep is None:
            return rows.join(hits, ROW_ID)
        if self._ties:  # the limit can't be applied before they are known
            hits = rows.select(ROW_ID, *self._ties).join(hits, ROW_ID)
        top = hits.orderBy(*self._best("_score")).limit(keep).select(ROW_ID, "_score")
        return self._lookup(rows, top).orderBy(*self._best("_score"))

    def _best(self, score: str) -> list[Column]:
        return [F.col(score).desc(), *self._ties, F.col(ROW_ID)]

    def _hybrid(self) -> DataFrame:
        keep = self._want + self._offset
        near, text = self._by_vector(keep), self._by_text(keep)
        near, text = (self._filtered(x) if self._postfilter else x for x in (near, text))
        raw = near.select(ROW_ID, F.col("_distance").alias("_d")).join(text.select(ROW_ID, F.col("_score").alias("_s")), ROW_ID, "full_outer")
        if self._norm == "rank":
            near, text = rerank.as_rank(near, "_distance"), rerank.as_rank(text, "_score")
        near, text = rerank.normalized(near, "_distance"), rerank.normalized(text, "_score")
        reranker = self._reranker or rerank.RRF()
        out = rerank.checked(reranker.rerank_hybrid(self._text or "", near, text)).drop("_distance", "_score")
        if reranker.return_score == "all":
            out = out.join(raw, ROW_ID, "left").withColumnsRenamed({"_d": "_distance", "_s": "_score"})
        return out.orderBy(*self._best(rerank.RELEVANCE))

    def to_df(self) -> DataFrame:
        many = self._vector is not None and vector.is_many(self._vector) and not self._is_nested()
        keep = self._want + self._offset
        if self._all and (self._vector is not None or self._fts is None):
            raise ValueError("all_matches is for text searches")
        if self._vector is not None and self._fts is not None:
            if many:
                raise ValueError("hybrid search takes one vector")
            found = self._hybrid()
        elif self._vector is not None:
            found = self._by_vector(keep)
            if self._postfilter:
                found = self._filtered(found)
            if self._reranker:
                found = rerank.checked(self._reranker.rerank_vector(self._text or "", found))
                found = found.orderBy(*self._best(rerank.RELEVANCE)) if self._ties else found
        elif self._fts is not None:
            found = self._by_text(None).orderBy(*self._best("_score")) if self._all else self._by_text(keep)
            if self._postfilter:
                found = self._filtered(found)
            if self._reranker:
                found = rerank.checked(self._reranker.rerank_text(self._text or "", found))
                found = found.orderBy(*self._best(rerank.RELEVANCE)) if self._ties else found
        else:
            from . import index

            found = self._filtered(index.narrowed(self._table, self._rows(), [] if self._bypass else self._conditions))
        if self._order:
            found = found.orderBy(*self._order, ROW_ID)
        elif self._vector is None and self._fts is None and (self._limit is not None or self._offset):
            found = found.orderBy(ROW_ID)
        if many:
            order = Window.partitionBy("query_index").orderBy("_distance", ROW_ID)
            found = found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r").between(self._offset + 1, keep)).orderBy("query_index", "_r").drop("_r")
        else:
            searched = self._vector is not None or self._fts is not None
            if not self._all and (searched or self._limit is not None):
                found = found.limit(keep if searched else self._limit + self._offset)
            if self._offset:
                found = found.offset(self._offset)
        return self._projected(found, many)

    def _is_nested(self) -> bool:
        many = vector.is_many(self._vector)
        path = vector.vector_column(self._table.schema, len(self._vector[0]) if many else len(self._vector), self._vector_column)
        kind = vector.field_of(self._table.schema, path).dataType
        return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)

    def _projected(self, found: DataFrame, many: bool) -> DataFrame:
        base = [F.col(f"`{c}`") for c in self._table.columns if c in found.columns] if self._columns is None else list(self._columns)
        scores = [c for c in ("_distance", "_score", rerank.RELEVANCE) if c in found.columns and c not in self._named] if self._scores else []
        extra = ([ROW_ID] if self._row_id and ROW_ID not in self._named else []) + (["_rowaddr"] if self._row_address else [])
        first = ["query_index"] if many and "query_index" not in self._named else []
        return found.select(*first, *base, *scores, *extra)

    @property
    def output_schema(self) -> T.StructType:
        return self.to_df().schema

    def to_arrow(self):
        return self.to_df().toArrow()

    def to_pandas(self, flatten: bool | int = False):
        frame = self.to_df()
        return (ingest.flatten(frame, None if flatten is True else int(flatten)) if flatten else frame).toPandas()

    def to_list(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.to_df().collect()]

    def to_batches(self, size: int = 10_000):
        """Arrow batches, partition by partition."""
        import pyarrow as pa

        held: list = []
        schema = None
        frame = self.to_df()
        for row in frame.toLocalIterator(prefetchPartitions=True):
            held.append(row.asDict(recursive=True))
            if len(held) >= size:
                batch = pa.RecordBatch.from_pylist(held, schema=schema)
                schema = batch.schema
                yield batch
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    def to_polars(self):
        import polars

        return polars.from_arrow(self.to_arrow())

    def to_models(self, model: type) -> list:
        return [model(**r) for r in self.to_list()]

    def explain(self, verbose: bool = False) -> str:
        return self.to_df()._jdf.queryExecution().explainString(self._table.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended" if verbose else "formatted"))

    def analyze(self) -> str:
        """Run the query; the executed plan."""
        frame = self.to_df()
        frame.write.format("noop").mode("overwrite").save()
        frame.collect()
        return frame._jdf.queryExecution().executedPlan().toString()

    def timeout(self, seconds: float) -> list[dict]:
        """to_list(), cancelled after so many seconds."""
        import threading
        import uuid

        spark, group = self._table.spark, f"query-{uuid.uuid4().hex}"
        out: dict = {}

        def work() -> None:
            spark.sparkContext.setJobGroup(group, "query", True)
            try:
                out["rows"] = self.to_list()
            except Exception as failed:
                out["error"] = failed

        worker = threading.Thread(target=work, daemon=True)
        worker.start()
        worker.join(seconds)
        if worker.is_alive():
            spark.sparkContext.cancelJobGroup(group)
            raise TimeoutError(f"query took more than {seconds} s")
        if "error" in out:
            raise out["error"]
        return out["rows"]


def search(table, what=None, column: str | None = None, query_type: str = "auto", fts_columns: Sequence[str] | str | None = None) -> Query:
    """A vector, a string (embedded if the table has an embedding function for it, else full text), a query tree, or nothing (all rows)."""
    q = Query(table)
    if what is None:
        return q
    if isinstance(what, (fts.FtsQuery, dict)):
        return q.nearest_to_text(what)
    if isinstance(what, str):
        spec = next((e for e in table.manifest().properties.get("embeddings", []) if column in (None, e["target"])), None)
        if query_type == "fts" or (query_type == "auto" and spec is None):
            return q.nearest_to_text(what, fts_columns)
        if spec is None:
            raise ValueError("no embedding function to make a vector of the text")
        from ..functions.registry import embedding

        q.nearest_to(embedding(spec["function"], **spec["options"]).embed_query(what), spec["target"])
        q._text = what
        return q.nearest_to_text(what, fts_columns) if query_type == "hybrid" else q
    if query_type == "fts":
        raise ValueError("full-text search takes a string")
    return q.nearest_to(what, column)


