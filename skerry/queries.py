"""One query for each operator of the engine, over the whole test tables, and its SQL.

Each takes (spark, sf_dir).  Distances and scores are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.expr import col, func, lit
from .functions.text import Tokenizer
from .operators import fts, rerank, vector
from .sources.scratch import cloned, database, imported

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: A query vector of 64 components, and the same in SQL.
VECTOR = [((i * 7) % 13 - 6) / 6 for i in range(64)]
_Q = "list_transform(range(64), lambda i: ((i * 7) % 13 - 6) / 6.0::DOUBLE)"
#: Plain tokens, so that SQL can make them too.
PLAIN = {"stem": False, "remove_stop_words": False, "ascii_folding": False, "max_token_length": None, "with_position": True}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str):
    """embeddings as a table with a vector column of 64 dimensions."""
    schema_of = lambda df: df.select("vec_id", F.col("embedding").alias("vector"), "label")
    return imported(spark, sf_dir, "embeddings", "vectors", schema_of)


def _documents(spark: SparkSession, sf_dir: str):
    """documents with an inverted index of plain tokens on text."""
    table = imported(spark, sf_dir, "documents", "indexed")
    if "text_idx" not in table.indices():
        table.create_index("text", "fts", **PLAIN)
    return table


# -- vector search -----------------------------------------------------------------------------

_L2 = f"list_sum(list_transform(range(1, 65), lambda i: power(embedding[i]::DOUBLE - ({_Q})[i], 2)))"
_DOT = f"list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ({_Q})[i]))"
_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_QNORM = f"sqrt(list_sum(list_transform({_Q}, lambda x: x * x)))"


def _rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, 6) for c in columns if c in frame.columns})


@query(f"SELECT vec_id, label, round(d, 6) AS _distance FROM (SELECT vec_id, label, {_L2} AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10")
def knn_l2(spark, sf_dir):
    return _rounded(_vectors(spark, sf_dir).search(VECTOR).ties("vec_id").select(["vec_id", "label"]).limit(10).to_df(), "_distance")


@query(f"SELECT vec_id, round(d, 6) AS _distance FROM (SELECT vec_id, 1 - {_DOT} / ({_NORM} * {_QNORM}) AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10")
def knn_cosine(spark, sf_dir):
    return _rounded(_vectors(spark, sf_dir).search(VECTOR).ties("vec_id").metric("cosine").select(["vec_id"]).to_df(), "_distance")


@query(f"SELECT vec_id, round(d, 6) AS _distance FROM (SELECT vec_id, 1 - {_DOT} AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10")
def knn_dot(spark, sf_dir):
    return _rounded(_vectors(spark, sf_dir).search(VECTOR).ties("vec_id").metric("dot").select(["vec_id"]).to_df(), "_distance")


@query(f"SELECT vec_id, d::DOUBLE AS _distance FROM (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (embedding[i] > 0) <> (({_Q})[i] > 0) THEN 1 ELSE 0 END)) AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10")
def knn_hamming(spark, sf_dir):
    """On sign bits, packed eight to a byte."""
    pack = lambda values: [sum((values[8 * b + i] > 0) << i for i in range(8)) for b in range(8)]
    bits = lambda b: F.concat(*[F.lpad(F.hex(sum((F.when(F.get("embedding", F.lit(8 * k + i)) > 0, 1 << i).otherwise(0) for i in range(8)), F.lit(0))), 2, "0") for k in range(b)])
    table = imported(spark, sf_dir, "embeddings", "bits", lambda df: df.select("vec_id", F.unhex(bits(8)).alias("bits")))
    return vector.nearest(table.scan(), "bits", pack(VECTOR), "hamming", tie="vec_id").select("vec_id", "_distance")


@query(f"SELECT vec_id, round(d, 6) AS _distance FROM (SELECT vec_id, {_L2} AS d FROM embeddings) WHERE d >= 20 AND d < 26 ORDER BY d, vec_id LIMIT 50")
def knn_distance_range(spark, sf_dir):
    return _rounded(_vectors(spark, sf_dir).search(VECTOR).ties("vec_id").distance_range(20.0, 26.0).select(["vec_id"]).limit(50).to_df(), "_distance")


@query(f"SELECT vec_id, label, round(d, 6) AS _distance FROM (SELECT vec_id, label, {_L2} AS d FROM embeddings WHERE label = 3 AND vec_id > 10) ORDER BY d, vec_id LIMIT 10")
def knn_prefilter(spark, sf_dir):
    return _rounded(_vectors(spark, sf_dir).search(VECTOR).ties("vec_id").where("label = 3").where(col("vec_id") > 10).select(["vec_id", "label"]).to_df(), "_distance")


@query(f"SELECT vec_id, label, round(d, 6) AS _distance FROM (SELECT vec_id, label, {_L2} AS d FROM embeddings ORDER BY d, vec_id LIMIT 100) WHERE label = 3")
def knn_postfilter(spark, sf_dir):
    return _rounded(_vectors(spark, sf_dir).search(VECTOR).ties("vec_id").where("label = 3", prefilter=False).select(["vec_id", "label"]).limit(100).to_df(), "_distance")


@query(f"SELECT vec_id, round(d, 6) AS _distance FROM (SELECT vec_id, {_L2} AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10 OFFSET 15")
def knn_paging(spark, sf_dir):
    return _rounded(_vectors(spark, sf_dir).search(VECTOR).ties("vec_id").select(["vec_id"]).limit(10).offset(15).to_df(), "_distance")


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS q, (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS query_index FROM embeddings WHERE vec_id < 8),
d AS (SELECT query_index, vec_id, list_sum(list_transform(range(1, 65), lambda i: power(embedding[i]::DOUBLE - q[i]::DOUBLE, 2))) AS d FROM embeddings, q)
SELECT query_index, vec_id, round(d, 6) AS _distance FROM d QUALIFY row_number() OVER (PARTITION BY query_index ORDER BY d, vec_id) <= 5
""")
def knn_multi_query(spark, sf_dir):
    """Eight query vectors at once; query_index comes first."""
    table = _vectors(spark, sf_dir)
    asked = [list(r.vector) for r in table.query().where("vec_id < 8").order_by("vec_id").select(["vector"]).to_df().collect()]
    return _rounded(table.search(asked).select(["vec_id"]).limit(5).to_df(), "_distance")


@query(f"""
WITH c AS (SELECT *, {_DOT} AS p, {_NORM} AS n, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ({_Q})[65 - i])) AS r FROM embeddings),
one AS (SELECT vec_id // 2 AS group_id, min(1 - p / (n * {_QNORM})) AS a, min(1 - r / (n * {_QNORM})) AS b FROM c GROUP BY 1)
SELECT group_id, round(a + b, 6) AS _distance FROM one ORDER BY a + b, group_id LIMIT 10
""")
def knn_multivector(spark, sf_dir):
    """Two vectors a row, two query vectors: the nearest of each, summed."""
    pairs = lambda df: df.groupBy(F.expr("vec_id div 2").alias("group_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"]).alias("vectors"))
    frame = pairs(_read(spark, sf_dir, "embeddings"))
    return _rounded(vector.nearest(frame, "vectors", [VECTOR, VECTOR[::-1]], "cosine", tie="group_id").select("group_id", "_distance"), "_distance")


@query(ORACLE_SQL["knn_l2"])
def ivf_flat_all_partitions(spark, sf_dir):
    """Every partition probed: the exact result through the index."""
    table = cloned(_vectors(spark, sf_dir))
    table.create_index("vector", "ivf_flat", num_partitions=8)
    return _rounded(table.search(VECTOR).nprobes(8).select(["vec_id", "label"]).to_df(), "_distance")


@query(ORACLE_SQL["knn_l2"])
def ivf_pq_refined(spark, sf_dir):
    """Codes pick candidates, their own vectors rank them."""
    table = cloned(_vectors(spark, sf_dir))
    table.create_index("vector", "ivf_pq", num_partitions=4, num_sub_vectors=16)
    return _rounded(table.search(VECTOR).nprobes(4).refine_factor(50).select(["vec_id", "label"]).to_df(), "_distance")


@query(ORACLE_SQL["knn_l2"])
def ivf_sq_refined(spark, sf_dir):
    table = cloned(_vectors(spark, sf_dir))
    table.create_index("vector", "ivf_sq", num_partitions=4)
    return _rounded(table.search(VECTOR).nprobes(4).refine_factor(10).select(["vec_id", "label"]).to_df(), "_distance")


@query(ORACLE_SQL["knn_l2"])
def ivf_hnsw_sq_refined(spark, sf_dir):
    table = cloned(_vectors(spark, sf_dir))
    table.create_index("vector", "ivf_hnsw_sq", num_partitions=4)
    return _rounded(table.search(VECTOR).nprobes(4).refine_factor(10).select(["vec_id", "label"]).to_df(), "_distance")


@query()
def ivf_rq_default(spark, sf_dir):
    table = cloned(_vectors(spark, sf_dir))
    table.create_index("vector", "ivf_rq")
    return table.search(VECTOR).refine_factor(20).select(["vec_id", "label"]).to_df()


@query(f"SELECT vec_id, round(d, 6) AS _distance FROM (SELECT vec_id, {_L2} AS d FROM embeddings WHERE vec_id % 5 <> 0 UNION ALL SELECT vec_id + 1000000, {_L2} FROM embeddings WHERE vec_id % 3 = 0) ORDER BY d, vec_id LIMIT 10")
def ivf_with_unindexed_rows(spark, sf_dir):
    """Rows deleted and added after the index was built."""
    table = cloned(_vectors(spark, sf_dir))
    table.create_index("vector", "ivf_flat", num_partitions=8)
    table.delete("vec_id % 5 = 0")
    table.add(_vectors(spark, sf_dir).to_df().filter("vec_id % 3 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000))
    return _rounded(table.search(VECTOR).nprobes(8).select(["vec_id"]).to_df(), "_distance")


# -- scans, projections, filters ---------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity BETWEEN 10 AND 20 AND l_returnflag <> 'N'")
def scan_filter_project(spark, sf_dir):
    table = imported(spark, sf_dir, "lineitem")
    return table.query().where("l_shipdate < TIMESTAMP '1996-01-01'").where(col("l_quantity").between(10.0, 20.0) & (col("l_returnflag") != "N")).select(["l_orderkey", "l_linenumber", "l_extendedprice"]).to_df()


@query("SELECT o_orderkey AS id, round(o_totalprice * 1.1, 4) AS gross, upper(o_orderpriority) AS priority FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
def project_sort_page(spark, sf_dir):
    table = imported(spark, sf_dir, "orders")
    return table.query().order_by(("o_totalprice", False, False), "o_orderkey").select({"id": "o_orderkey", "gross": "round(o_totalprice * 1.1D, 4)", "priority": func("upper", col("o_orderpriority"))}).limit(25).offset(5).to_df()


@query("""
SELECT c_custkey, lower(c_mktsegment) AS lo, upper(c_name) AS up, contains(c_name, '99') AS has, trim(concat('  ', c_mktsegment, ' ')) AS bt, octet_length(encode(c_name))::INTEGER AS bytes,
  c_acctbal::BIGINT::VARCHAR AS kind, c_custkey % 7 IN (1, 3) AS listed, c_nationkey + 2 * c_custkey AS sum, c_acctbal IS NULL AS gone, c_name LIKE '%1_' AS fits, trunc(c_acctbal)::BIGINT AS whole
FROM customer WHERE NOT (c_acctbal < 0)
""")
def expression_functions(spark, sf_dir):
    table = imported(spark, sf_dir, "customer")
    return table.query().where(~(col("c_acctbal") < 0)).select({
        "c_custkey": "c_custkey", "lo": col("c_mktsegment").lower(), "up": col("c_name").upper(), "has": col("c_name").contains("99"), "bt": func("btrim", func("concat", lit("  "), col("c_mktsegment"), lit(" "))),
        "bytes": func("octet_length", col("c_name")), "kind": "CAST(CAST(bround(c_acctbal) AS BIGINT) AS STRING)", "listed": "c_custkey % 7 IN (1, 3)", "sum": col("c_nationkey") + 2 * col("c_custkey"),
        "gone": col("c_acctbal").is_null(), "fits": col("c_name").like("%1_"), "whole": col("c_acctbal").cast(int),
    }).to_df()


@query("SELECT event_id, CAST(props::JSON->>'$.k' AS BIGINT) AS k FROM events WHERE (props::JSON->>'$.k') = '42'")
def json_filter(spark, sf_dir):
    table = imported(spark, sf_dir, "events")
    return table.query().where(func("json_extract", col("props"), "$.k") == "42").select({"event_id": "event_id", "k": "CAST(get_json_object(props, '$.k') AS BIGINT)"}).to_df()


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 5 OFFSET 100")
def take_offsets(spark, sf_dir):
    return imported(spark, sf_dir, "part", "part_sorted", lambda df: df.coalesce(1).sortWithinPartitions("p_partkey")).take_offsets([100, 101, 102, 103, 104]).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE p_partkey % 97 = 0")
def take_row_ids(spark, sf_dir):
    table = imported(spark, sf_dir, "part")
    ids = [r._rowid for r in table.query().where("p_partkey % 97 = 0").with_row_id().select(["p_partkey"]).to_df().collect()]
    return table.take_row_ids(ids).select("p_partkey")


@query("SELECT count(*) AS n, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n_f FROM orders")
def count_rows(spark, sf_dir):
    table = imported(spark, sf_dir, "orders")
    return spark.createDataFrame([(table.count_rows(), table.count_rows("o_orderstatus = 'F'"))], "n long, n_f long")


@query("SELECT label, count(*) AS n FROM embeddings WHERE list_has_any([label, label + 1], [2, 5]) AND list_contains([label, 1], label) GROUP BY label")
def array_predicates(spark, sf_dir):
    table = imported(spark, sf_dir, "embeddings", "tagged", lambda df: df.select("vec_id", "label", F.array("label", F.col("label") + 1).alias("tags")))
    return table.query().where(func("array_contains_any", col("tags"), lit([2, 5])) & func("array_contains", col("tags"), col("label"))).to_df().groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source FROM documents)")
def nested_fields(spark, sf_dir):
    table = imported(spark, sf_dir, "documents", "nested", lambda df: df.select("doc_id", F.struct("lang", F.struct("source").alias("from")).alias("meta")))
    return table.query().select({"doc_id": "doc_id", "lang": "meta.lang", "source": "meta.`from`.source"}).to_df()


@query("SELECT doc_id, octet_length(encode(text))::INTEGER AS size, hex(encode(substr(text, 1, 1)))[1:2] AS head FROM documents WHERE text <> ''")
def blob_ranges(spark, sf_dir):
    table = imported(spark, sf_dir, "documents", "blobs", lambda df: df.select("doc_id", F.col("text").cast("binary").alias("payload")))
    return table.query().where("octet_length(payload) > 0").select({"doc_id": "doc_id", "size": "octet_length(payload)", "head": "hex(substring(payload, 1, 1))"}).to_df()


# -- full text ---------------------------------------------------------------------------------

_TOKENS = r"tokens AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\pL\pM\pN]+'), lambda t: t <> '') AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM tokens)"


_BM25_TOKENS = _TOKENS


def _bm25(*terms: str) -> str:
    """SQL of (doc_id, term, s): the part of each term in each document's score."""
    rows = " UNION ALL ".join(f"SELECT doc_id, '{t}' AS term, len(list_filter(w, lambda x: x = '{t}'))::DOUBLE AS tf, len(w)::DOUBLE AS dl FROM tokens" for t in terms)
    return f"{_TOKENS}, hits AS (SELECT * FROM ({rows}) WHERE tf > 0), df AS (SELECT term, count(*)::DOUBLE AS df FROM hits GROUP BY term), parts AS (SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean)) AS s FROM hits JOIN df USING (term), n)"


def _scored(frame: DataFrame) -> DataFrame:
    return frame.select("doc_id", F.round("_score", 6).alias("_score"))


@query(f"WITH {_bm25('blees', 'thention')} SELECT doc_id, round(sum(s), 6) AS _score FROM parts GROUP BY doc_id ORDER BY sum(s) DESC, doc_id LIMIT 20")
def fts_match_any(spark, sf_dir):
    return _scored(_documents(spark, sf_dir).search("blees thention").ties("doc_id").limit(20).to_df())


@query(f"WITH {_bm25('the', 'and', 'with')} SELECT doc_id, round(sum(s), 6) AS _score FROM parts GROUP BY doc_id HAVING count(*) = 3")
def fts_match_all(spark, sf_dir):
    q = fts.MatchQuery("the and with", "text", operator="AND")
    return _scored(_documents(spark, sf_dir).search(q).all_matches().to_df())


@query(f"WITH {_bm25('the', 'with', 'that')}, t AS (SELECT doc_id, sum(s) FILTER (term = 'the') AS a, sum(s) FILTER (term = 'with') AS b, sum(s) FILTER (term = 'that') AS c FROM parts GROUP BY doc_id) SELECT doc_id, round(a + coalesce(b, 0), 6) AS _score FROM t WHERE a IS NOT NULL AND c IS NULL")
def fts_boolean(spark, sf_dir):
    q = fts.BooleanQuery([(fts.MUST, fts.MatchQuery("the", "text")), (fts.SHOULD, fts.MatchQuery("with", "text")), (fts.MUST_NOT, fts.MatchQuery("that", "text"))])
    return _scored(_documents(spark, sf_dir).search(q).all_matches().to_df())


@query(f"WITH {_bm25('the', 'with')}, t AS (SELECT doc_id, sum(s) FILTER (term = 'the') AS a, sum(s) FILTER (term = 'with') AS b FROM parts GROUP BY doc_id) SELECT doc_id, round(a - 0.5 * coalesce(b, 0), 6) AS _score FROM t WHERE a IS NOT NULL")
def fts_boost(spark, sf_dir):
    q = fts.BoostQuery(fts.MatchQuery("the", "text"), fts.MatchQuery("with", "text"), 0.5)
    return _scored(_documents(spark, sf_dir).search(q).all_matches().to_df())


@query(f"""
WITH {_bm25('in', 'the')}, idf AS (SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf FROM df, n),
found AS (SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'in' AND w[i + 1] = 'the'))::DOUBLE AS tf, len(w)::DOUBLE AS dl FROM tokens)
SELECT doc_id, round(idf * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS _score FROM found, idf, n WHERE tf > 0
""")
def fts_phrase(spark, sf_dir):
    return _scored(_documents(spark, sf_dir).search(fts.PhraseQuery("in the", "text")).all_matches().to_df())


@query(f"""
WITH tokens0 AS (SELECT 1), {_TOKENS}, vocabulary AS (SELECT DISTINCT unnest(w) AS term FROM tokens),
close AS (SELECT term FROM vocabulary WHERE levenshtein(term, 'thentoin') <= 2 ORDER BY levenshtein(term, 'thentoin'), term LIMIT 50),
hits AS (SELECT doc_id, term, len(list_filter(w, lambda x: x = term))::DOUBLE AS tf, len(w)::DOUBLE AS dl FROM (SELECT doc_id, w, unnest(list_intersect(w, (SELECT list(term) FROM close))) AS term FROM tokens)),
df AS (SELECT term, count(*)::DOUBLE AS df FROM hits GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS _score FROM hits JOIN df USING (term), n GROUP BY doc_id
""")
def fts_fuzzy(spark, sf_dir):
    return _scored(_documents(spark, sf_dir).search(fts.MatchQuery("thentoin", "text", fuzziness=None)).all_matches().to_df())


@query(f"WITH {_bm25('the')} SELECT doc_id, round(sum(s), 6) AS _score FROM parts JOIN documents USING (doc_id) WHERE lang = 'en' GROUP BY doc_id ORDER BY sum(s) DESC, doc_id LIMIT 15")
def fts_prefilter(spark, sf_dir):
    return _scored(_documents(spark, sf_dir).search("the").ties("doc_id").where("lang = 'en'").limit(15).to_df())


@query(f"WITH {_bm25('the', 'with')} SELECT lang, count(*) AS n, round(max(t.s), 6) AS best FROM (SELECT doc_id, sum(s) AS s FROM parts GROUP BY doc_id) t JOIN documents USING (doc_id) GROUP BY lang")
def fts_sql_function(spark, sf_dir):
    """The search as a table function inside SQL."""
    _documents(spark, sf_dir)
    text = "SELECT lang, count(*) AS n, round(max(_score), 6) AS best FROM fts('docs', '{\"match\": {\"column\": \"text\", \"terms\": \"the with\"}}') GROUP BY lang"
    return database(spark).sql(text, docs=_documents(spark, sf_dir))


@query(r"""
WITH u AS (SELECT conv_id * 1000 + turn AS id, list_filter(regexp_split_to_array(lower(text), '[^\pL\pM\pN]+'), lambda t: t <> '') AS w, list_filter(regexp_split_to_array(lower(role), '[^\pL\pM\pN]+'), lambda t: t <> '') AS r FROM conversations),
one AS (SELECT id, len(list_filter(w, lambda x: x = 'user'))::DOUBLE AS tf, len(w)::DOUBLE AS dl, count(*) OVER ()::DOUBLE AS n, avg(len(w)) OVER () AS mean, 1.0 AS boost FROM u WHERE w IS NOT NULL
UNION ALL SELECT id, len(list_filter(r, lambda x: x = 'user'))::DOUBLE, len(r)::DOUBLE, count(*) OVER ()::DOUBLE, avg(len(r)) OVER (), 2.0 FROM u WHERE r IS NOT NULL),
d AS (SELECT *, count(*) FILTER (tf > 0) OVER (PARTITION BY boost)::DOUBLE AS df FROM one)
SELECT id, round(max(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS _score FROM d WHERE tf > 0 GROUP BY id
""")
def fts_multi_match(spark, sf_dir):
    frame = _read(spark, sf_dir, "conversations").withColumn("_rowid", F.col("conv_id") * 1000 + F.col("turn"))
    tokenizer = Tokenizer(**PLAIN)
    hits = fts.Search(spark, {c: fts.TextSource(frame, c, tokenizer) for c in ("text", "role")}).run(fts.MultiMatchQuery("user", ["text", "role"], [1.0, 2.0]))
    return hits.select(F.col("_rowid").alias("id"), F.round("_score", 6).alias("_score"))


# -- hybrid ------------------------------------------------------------------------------------


def _near(spark, sf_dir) -> DataFrame:
    """A vector result of up to 50 rows, with vec_id as row id."""
    return vector.nearest(_read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "_rowid"), "embedding", VECTOR, k=50).select("_rowid", "_distance")


def _arms(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A vector and a text result of up to 50 rows each, with vec_id = doc_id as row id."""
    near = _near(spark, sf_dir)
    text = _documents(spark, sf_dir).search("the with").ties("doc_id").limit(50).select(["doc_id"]).to_df()
    return near, text.withColumnRenamed("doc_id", "_rowid")


_ARMS = f"""
WITH near AS (SELECT vec_id AS id, {_L2} AS d, row_number() OVER (ORDER BY d, vec_id) AS r FROM embeddings QUALIFY r <= 50),
{_bm25('the', 'with')}, text AS (SELECT doc_id AS id, sum(s) AS s, row_number() OVER (ORDER BY sum(s) DESC, doc_id) AS r FROM parts GROUP BY doc_id QUALIFY r <= 50)
"""


def _fused(frame: DataFrame) -> DataFrame:
    return frame.select(F.col("_rowid").alias("id"), F.round("_relevance_score", 6).alias("_relevance_score"))


@query(f"{_ARMS} SELECT id, round(sum(p), 6) AS _relevance_score FROM (SELECT id, 1 / (60.0 + r) AS p FROM near UNION ALL SELECT id, 1 / (60.0 + r) FROM text) GROUP BY id")
def hybrid_rrf(spark, sf_dir):
    return _fused(rerank.RRF().rerank_hybrid("", *_arms(spark, sf_dir)))


@query(f"{_ARMS} SELECT id, round(sum(p), 6) AS _relevance_score FROM (SELECT id, 0.3 / r AS p FROM near UNION ALL SELECT id, 0.7 / r FROM text) GROUP BY id")
def hybrid_mrr(spark, sf_dir):
    return _fused(rerank.MRR(0.3, 0.7).rerank_hybrid("", *_arms(spark, sf_dir)))


@query(f"""
{_ARMS}, a AS (SELECT id, (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()) AS d FROM near), b AS (SELECT id, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS s FROM text)
SELECT id, round(0.7 * coalesce(1 - d, 0) + 0.3 * coalesce(s, 0), 6) AS _relevance_score FROM a FULL JOIN b USING (id)
""")
def hybrid_linear(spark, sf_dir):
    near, text = _arms(spark, sf_dir)
    return _fused(rerank.LinearCombination(0.7).rerank_hybrid("", rerank.normalized(near, "_distance"), rerank.normalized(text, "_score")))


# -- changes -----------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def dml_update(spark, sf_dir):
    table = cloned(imported(spark, sf_dir, "orders"))
    table.update({"o_orderstatus": "X"}, where="o_orderstatus = 'P'", values_sql={"o_totalprice": "o_totalprice + 1"})
    return table.to_df().select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_totalprice > 250000 OR o_custkey % 10 = 3)")
def dml_delete(spark, sf_dir):
    table = cloned(imported(spark, sf_dir, "orders"))
    table.delete("o_totalprice > 250000")
    table.delete("o_custkey % 10 = 3")
    return table.to_df().select("o_orderkey", "o_custkey")


@query("""
WITH s AS (SELECT c_custkey + 700 AS c_custkey, c_name || '*' AS c_name, c_nationkey, -c_acctbal AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 2 = 0)
SELECT t.c_custkey, CASE WHEN s.c_custkey IS NOT NULL AND t.c_acctbal > s.c_acctbal THEN s.c_name ELSE t.c_name END AS c_name, CASE WHEN s.c_custkey IS NOT NULL AND t.c_acctbal > s.c_acctbal THEN s.c_acctbal ELSE t.c_acctbal END AS c_acctbal
FROM customer t LEFT JOIN s USING (c_custkey) WHERE NOT (s.c_custkey IS NULL AND t.c_mktsegment = 'MACHINERY')
UNION ALL SELECT c_custkey, c_name, c_acctbal FROM s WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)
""")
def dml_merge_insert(spark, sf_dir):
    table = cloned(imported(spark, sf_dir, "customer"))
    source = table.to_df().filter("c_custkey % 2 = 0").select((F.col("c_custkey") + 700).alias("c_custkey"), F.concat("c_name", F.lit("*")).alias("c_name"), "c_nationkey", (-F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment")
    merge = table.merge_insert("c_custkey").when_matched_update_all("target.c_acctbal > source.c_acctbal").when_not_matched_insert_all()
    merge.when_not_matched_by_source_delete("target.c_mktsegment = 'MACHINERY'").execute(source)
    return table.to_df().select("c_custkey", "c_name", "c_acctbal")


@query("SELECT p_partkey AS id, p_name || '!' AS shout, p_size::BIGINT AS size, NULL::VARCHAR AS note, b.n AS n FROM part LEFT JOIN (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) b USING (p_brand)")
def schema_evolution(spark, sf_dir):
    """Columns added by expression, as nulls and by a keyed left join; renamed, cast and dropped."""
    table = cloned(imported(spark, sf_dir, "part"))
    brands = table.to_df().groupBy("p_brand").agg(F.count("*").alias("n"))
    table.add_columns({"shout": "concat(p_name, '!')"})
    table.add_columns(T.StructField("note", T.StringType()))
    table.merge(brands, "p_brand")
    table.alter_columns({"path": "p_partkey", "rename": "id"}, {"path": "p_size", "rename": "size", "data_type": "bigint"})
    table.drop_columns(["p_type", "p_retailprice", "p_name", "p_brand"])
    return table.to_df().select("id", "shout", "size", "note", "n")


@query("SELECT s_suppkey, s_acctbal, round(s_acctbal * 2, 4) AS twice FROM supplier UNION ALL SELECT s_suppkey + 100000, s_acctbal, round(s_acctbal * 2, 4) FROM supplier")
def computed_column(spark, sf_dir):
    table = cloned(imported(spark, sf_dir, "supplier"))
    table.add_computed_column("twice", "round(s_acctbal * 2, 4)")
    table.refresh()
    table.add(imported(spark, sf_dir, "supplier").to_df().withColumn("s_suppkey", F.col("s_suppkey") + 100_000))
    table.refresh()
    return table.to_df().select("s_suppkey", "s_acctbal", "twice")


@query("""
SELECT c_custkey, c_acctbal, 'deleted' AS _change FROM customer WHERE c_nationkey = 4
UNION ALL SELECT c_custkey, c_acctbal + 1, 'updated' FROM customer WHERE c_nationkey = 7
UNION ALL SELECT c_custkey + 1000000, c_acctbal, 'inserted' FROM customer WHERE c_nationkey = 9
""")
def change_feed(spark, sf_dir):
    """What happened since a version, from the versions that rows carry."""
    table = cloned(imported(spark, sf_dir, "customer"))
    start = table.version
    table.delete("c_nationkey = 4")
    table.update(values_sql={"c_acctbal": "c_acctbal + 1"}, where="c_nationkey = 7")
    table.add(table.to_df().filter("c_nationkey = 9").withColumn("c_custkey", F.col("c_custkey") + 1_000_000))
    return table.changes(start).select("c_custkey", "c_acctbal", "_change")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 2")
def sql_insert(spark, sf_dir):
    table = cloned(imported(spark, sf_dir, "region"))
    database(spark).sql("INSERT INTO target SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 2", target=table, nation=imported(spark, sf_dir, "nation"))
    return table.checkout_latest().to_df()


@query("SELECT s_suppkey, upper(s_name) AS loud, length(s_name)::BIGINT AS size FROM supplier")
def function_columns(spark, sf_dir):
    """Two columns that one registered function fills."""
    from .functions.registry import udf

    @udf(returns="loud string, size long", name="describe_name")
    def describe(name: str):
        return {"loud": name.upper(), "size": len(name)}

    table = cloned(imported(spark, sf_dir, "supplier"))
    table.add_function_columns(describe, ["s_name"], ["loud", "size"])
    table.refresh()
    return table.to_df().select("s_suppkey", "loud", "size")


@query("SELECT 'v1' AS which, count(*) AS n FROM nation UNION ALL SELECT 'gone', count(*) FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'tag', count(*) FROM nation UNION ALL SELECT 'back', count(*) FROM nation UNION ALL SELECT 'branch', count(*) + 1 FROM nation UNION ALL SELECT 'diff', count(*) + 1 FROM nation WHERE n_regionkey = 1")
def versions_tags_branches(spark, sf_dir):
    table = cloned(imported(spark, sf_dir, "nation"))
    first = table.version
    table.create_tag("start")
    branch = table.create_branch("try")
    table.delete("n_regionkey = 1")
    branch.add(branch.to_df().limit(1).withColumn("n_nationkey", F.lit(999)))
    out = [("v1", table.scan(first).count()), ("gone", table.count_rows()), ("diff", table.diff("try").count()), ("branch", branch.count_rows())]
    out.append(("tag", database(spark).open_table(table.name, "start").count_rows()))
    table.restore(first)
    out.append(("back", table.count_rows()))
    return spark.createDataFrame(out, "which string, n long")


@query("SELECT event_id, user_id, value FROM events")
def compaction(spark, sf_dir):
    table = database(spark).create_table(f"parts-{abs(hash(sf_dir)):x}", _read(spark, sf_dir, "events").repartition(8), mode="overwrite")
    table.optimize()
    return table.to_df().select("event_id", "user_id", "value")


@query("""
WITH up AS (SELECT event_id, user_id + 1 AS user_id, value FROM events WHERE event_id % 10 = 0 UNION ALL SELECT event_id + 10000000, user_id, value FROM events WHERE event_id % 50 = 0)
SELECT event_id, user_id, value FROM up UNION ALL SELECT event_id, user_id, value FROM events WHERE event_id % 10 <> 0
""")
def lsm_upsert(spark, sf_dir):
    """Three generations over a base, read merged."""
    from .streaming.lsm import LsmSpec

    table = cloned(imported(spark, sf_dir, "events", "events_keyed", lambda df: df.select("event_id", "user_id", "value")))
    table.set_primary_key("event_id")
    tier, rows = table.lsm(LsmSpec("bucket", "event_id", 4)), table.to_df()
    tier.upsert(rows.filter("event_id % 10 = 0").withColumn("user_id", F.lit(-1).cast("long")))
    tier.upsert(rows.filter("event_id % 10 = 0").withColumn("user_id", F.col("user_id") + 1))
    tier.upsert(rows.filter("event_id % 50 = 0").withColumn("event_id", F.col("event_id") + 10_000_000))
    return tier.to_df().select("event_id", "user_id", "value")


# -- views -------------------------------------------------------------------------------------

_VIEW = "SELECT o_orderkey AS id, round(o_totalprice / 2, 4) AS half FROM orders WHERE o_orderstatus = 'F'"


@query(f"{_VIEW} AND o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey + 10000000, round(o_totalprice / 2, 4) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0")
def view_incremental(spark, sf_dir):
    """Built, then brought up to date after a delete, an update that leaves the filter, and an append."""
    db, table = database(spark), cloned(imported(spark, sf_dir, "orders"))
    view = db.create_view(f"half-{table.name}", table, {"id": "o_orderkey", "half": "round(o_totalprice / 2, 4)"}, where="o_orderstatus = 'F'")
    view.refresh()
    table.delete("o_orderkey % 14 = 0")
    table.update({"o_orderstatus": "gone"}, where="o_orderkey % 14 = 7")
    table.add(imported(spark, sf_dir, "orders").to_df().filter("o_orderkey % 3 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))
    assert view.refresh().mode == "incremental"
    return view.to_df()


# -- training order ----------------------------------------------------------------------------


@query("SELECT split_id, count(*) AS n FROM (SELECT CASE WHEN r <= round(0.7 * c) THEN 0 WHEN r <= round(0.7 * c) + round(0.2 * c) THEN 1 ELSE 2 END::INTEGER AS split_id FROM (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS r, count(*) OVER () AS c FROM lineitem)) GROUP BY split_id")
def permutation_random(spark, sf_dir):
    """Exact sizes of a seeded random split, shuffled."""
    from .plans.permutation import permutation

    made = permutation(imported(spark, sf_dir, "lineitem")).split_random([0.7, 0.2, 0.1], seed=5, names=["train", "dev", "test"]).shuffle(seed=9, clump_size=4).build()
    return made._rows.groupBy("split_id").agg(F.countDistinct("row_id").alias("n"))


@query("SELECT p_partkey, (CASE WHEN p_partkey < 100 THEN 0 ELSE 1 END)::INTEGER AS split_id, (CASE WHEN p_partkey < 100 THEN p_partkey ELSE p_partkey - 100 END) AS position FROM part WHERE p_partkey < 150")
def permutation_sequential(spark, sf_dir):
    from .plans.permutation import permutation

    table = imported(spark, sf_dir, "part", "part_sorted", lambda df: df.coalesce(1).sortWithinPartitions("p_partkey"))
    made = permutation(table).split_sequential(counts=[100, 50]).build()
    return made._rows.join(table.scan().select(F.col("_rowid").alias("row_id"), "p_partkey"), "row_id").select("p_partkey", "split_id", "position")


@query("SELECT o_orderkey, (o_custkey % 3)::INTEGER AS split_id FROM orders WHERE o_orderstatus <> 'P'")
def permutation_calculated(spark, sf_dir):
    from .plans.permutation import permutation

    table = imported(spark, sf_dir, "orders")
    made = permutation(table).filter("o_orderstatus <> 'P'").split_calculated("o_custkey % 3").build()
    return made._rows.join(table.scan().select(F.col("_rowid").alias("row_id"), "o_orderkey"), "row_id").select("o_orderkey", "split_id")


@query()
def permutation_hash(spark, sf_dir):
    from .plans.permutation import permutation

    made = permutation(imported(spark, sf_dir, "orders")).split_hash(["o_custkey"], [8, 1], discard_weight=1).shuffle(seed=3).build()
    return made.split(0).select_columns(["o_orderkey", "o_custkey"]).to_df()


@query("""
WITH w AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, count(*) OVER ahead AS n, string_agg(text, ' ') OVER ahead AS text FROM conversations WINDOW ahead AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT conv_id, turn, role, md5(text) AS text FROM w WHERE place % 2 = 0 AND n >= 2
""")
def context_windows(spark, sf_dir):
    from .plans.context import contextualize

    out = contextualize(_read(spark, sf_dir, "conversations"), "turn").window(4).stride(2).group_by("conv_id").text_column("text").to_df()
    return out.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text"))


# -- SQL over tables ---------------------------------------------------------------------------


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    tables = [t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels") if t in text]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return database(spark).sql(text, **{t: imported(spark, sf_dir, t) for t in tables})

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or text


_sql("sql_pricing_summary", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus
""")
_sql("sql_join_group", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_regionkey < 3 AND o_orderdate >= TIMESTAMP '1994-01-01' GROUP BY n_name
""")
_sql("sql_semi_anti", """
SELECT c_mktsegment, count(*) AS n FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY c_mktsegment
""")
_sql("sql_rollup_cube", """
SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
UNION ALL SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
""")
_sql("sql_windows", """
SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running, lag(o_orderkey) OVER w AS before
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
_sql("sql_set_operations", """
(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer)
""")
_sql("sql_outer_join", """
SELECT p_brand, count(l_orderkey) AS sold, count(*) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 45 GROUP BY p_brand
""")


@query("""
SELECT o_orderkey, event_id FROM (SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 9500 DAY AS due FROM orders)
ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS r FROM events) WHERE r = 1) e ON o_custkey = e.user_id AND due >= e.ts
""")
def join_as_of(spark, sf_dir):
    """For each row the last event of its key up to its time: one union and one window, no pairs."""
    from .operators.joins import as_of

    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderdate") + F.expr("INTERVAL 9500 DAY")).alias("at"))
    events = _read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return as_of(orders, events, left_on="at", right_on="ts", left_by="o_custkey", right_by="user_id", order="event_id").select("o_orderkey", "event_id")


@query("SELECT o_orderkey, l_linenumber, l_orderkey FROM orders JOIN lineitem ON l_partkey = o_custkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 3 DAY")
def join_range(spark, sf_dir):
    from .operators.joins import within

    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_orderdate") + F.expr("INTERVAL 3 DAY")).alias("until"))
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return within(orders, lines, "o_orderdate", "until", "l_shipdate", width=3 * 86400, left_by="o_custkey", right_by="l_partkey").select("o_orderkey", "l_linenumber", "l_orderkey")


# -- functions, statistics, streams ------------------------------------------------------------


@query("SELECT p_partkey, (length(p_name) * 10 + p_size)::BIGINT AS mark FROM part")
def python_function(spark, sf_dir):
    from .functions.registry import udf

    @udf
    def mark(name: str, size: int) -> int:
        return len(name) * 10 + size

    return _read(spark, sf_dir, "part").select("p_partkey", mark("p_name", "p_size").alias("mark"))


@query("SELECT count(*) AS n FROM part WHERE p_name IS NOT NULL")
def embedded_on_ingest(spark, sf_dir):
    """A table that embeds a column as it is written; its vectors find their own texts."""
    from .functions.registry import embedding_spec

    spec = embedding_spec("hashing", "p_name", "vector", dim=32)
    frame = _read(spark, sf_dir, "part").select("p_partkey", "p_name")
    table = database(spark).create_table(f"embedded-{abs(hash(sf_dir)):x}", frame, mode="overwrite", embeddings=[spec])
    assert table.search("red widget").limit(1).to_list()[0]["p_name"] == "red widget"
    return table.query().where("size(vector) = 32").to_df().agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM lineitem)::BIGINT AS num_rows, 0::BIGINT AS num_indices")
def table_stats(spark, sf_dir):
    s = imported(spark, sf_dir, "lineitem").stats()
    return spark.createDataFrame([(s["num_rows"], s["num_indices"])], "num_rows long, num_indices long")


@query("SELECT event_id, user_id, value FROM events")
def stream_append(spark, sf_dir):
    """events through Structured Streaming into a table, twice with one checkpoint: each row once."""
    import uuid

    from .sources.scratch import shared_dir
    from .streaming.sink import write_stream

    frame = _read(spark, sf_dir, "events")
    table = database(spark).create_empty_table(f"streamed-{uuid.uuid4().hex}", T.StructType([f for f in frame.schema if f.name in ("event_id", "user_id", "value")]))
    checkpoint = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for _ in range(2):
        stream = spark.readStream.schema(frame.schema).parquet(f"{sf_dir}/events.parquet*")
        write_stream(stream, table, checkpoint).awaitTermination()
    return table.checkout_latest().to_df()


from . import further_queries  # noqa: E402, F401  (adds its queries to QUERIES)
