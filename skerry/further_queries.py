"""More queries with their SQL: the operators whose effect is a count, a catalogue or a variant of another query."""

from __future__ import annotations

import datetime
import decimal
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.expr import col, func, lit
from .functions.text import STOP_WORDS, Tokenizer
from .operators import fts, rerank, vector
from .queries import _BM25_TOKENS, ORACLE_SQL, PLAIN, VECTOR, _bm25, _documents, _fused, _L2, _near, _read, _rounded, _scored, _vectors, query
from .sources.scratch import cloned, database, imported


def _fresh(name: str) -> str:
    return f"{name}-{uuid.uuid4().hex}"


def _counted(spark, **counts: int):
    """(what, n) of named numbers."""
    return spark.createDataFrame([(k, int(v)) for k, v in counts.items()], "what string, n long")


# -- sources and catalogue ---------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, source FROM nation, (SELECT unnest(['arrow', 'batches', 'list', 'pandas', 'reader']) AS source)")
def ingest_sources(spark, sf_dir):
    """The same rows as an Arrow table, a reader, batches, a list of dicts and a pandas frame."""
    arrow = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name").toArrow()
    given = {"arrow": arrow, "reader": arrow.to_reader(), "batches": iter(arrow.to_batches()), "list": arrow.to_pylist(), "pandas": arrow.to_pandas()}
    out = None
    for name, data in given.items():
        frame = database(spark).create_table(_fresh(name), data).to_df().select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.lit(name).alias("source"))
        out = frame if out is None else out.unionByName(frame)
    return out


@query("SELECT 'arrow' AS what, count(*) AS n FROM part UNION ALL SELECT 'pandas', count(*) FROM part UNION ALL SELECT 'list', count(*) FROM part UNION ALL SELECT 'batches', count(*) FROM part UNION ALL SELECT 'first', 7")
def collectors(spark, sf_dir):
    q = imported(spark, sf_dir, "part").query().select(["p_partkey"])
    return _counted(spark, arrow=q.to_arrow().num_rows, pandas=len(q.to_pandas()), list=len(q.to_list()), batches=sum(b.num_rows for b in q.to_batches(100)), first=imported(spark, sf_dir, "part").head(7).count())


@query("SELECT 'b' AS name, 1 AS place UNION ALL SELECT 'c', 2 UNION ALL SELECT 'd', 3 UNION ALL SELECT 'inner', 4 UNION ALL SELECT 'page', 5")
def catalog_names(spark, sf_dir):
    """Tables created empty, renamed, dropped and listed by pages, in a namespace."""
    db, space = database(spark), [_fresh("space")]
    db.create_namespace(space)
    for name in "abx":
        db.create_empty_table(name, T.StructType([T.StructField("k", T.LongType())]), namespace=space)
    db.rename_table("x", "c", namespace=space)
    db.drop_table("a", namespace=space)
    db.create_empty_table("d", T.StructType([T.StructField("k", T.LongType())]), namespace=space)
    db.create_namespace([*space, "inner"])
    found = [*db.table_names(limit=None, namespace=space), *db.list_namespaces(space), "page" if db.table_names(start_after="b", limit=1, namespace=space) == ["c"] else "wrong"]
    return spark.createDataFrame([(n, i) for i, n in enumerate(found, 1)], "name string, place int")


@query("SELECT vec_id, vec_id % 3 = 0 AS bad FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id + 1000000, TRUE FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id + 2000000, TRUE FROM embeddings WHERE vec_id % 3 = 0")
def bad_vectors(spark, sf_dir):
    """Vectors of a wrong length or with NaN: dropped, filled and turned into nulls."""
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 6 == 0, F.slice("embedding", 1, 3)).when(F.col("vec_id") % 6 == 3, F.transform("embedding", lambda x: x * float("nan"))).otherwise(F.col("embedding")).alias("vector"))
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType()), True, {"dim": 64})])
    tables = {}
    for policy in ("drop", "fill", "null"):
        tables[policy] = database(spark).create_empty_table(_fresh(policy), schema)
        tables[policy].add(rows, on_bad_vectors=policy, fill_value=-1.0)
    filled = tables["fill"].query().where("vector[63] = -1").select({"vec_id": "vec_id + 1000000", "bad": "true"}).to_df()
    nulls = tables["null"].query().where("vector IS NULL").select({"vec_id": "vec_id + 2000000", "bad": "true"}).to_df()
    return tables["drop"].query().select({"vec_id": "vec_id", "bad": "vec_id % 3 = 0"}).to_df().unionByName(filled).unionByName(nulls)


@query("SELECT s_suppkey AS id, NULL::VARCHAR AS note, s_name AS name, s_nationkey::BIGINT AS key FROM supplier")
def subset_and_cast(spark, sf_dir):
    """Columns in another order, some missing, an inner field cast to the table's type."""
    table = database(spark).create_empty_table(_fresh("cast"), T.StructType.fromDDL("id long, note string, meta struct<name string, key long>"))
    table.add(_read(spark, sf_dir, "supplier").select(F.struct(F.col("s_nationkey").cast("int").alias("key"), F.col("s_name").alias("name")).alias("meta"), F.col("s_suppkey").alias("id")))
    return table.query().select({"id": "id", "note": "note", "name": "meta.name", "key": "meta.key"}).to_df()


# -- projections and filters -------------------------------------------------------------------


@query("""
SELECT o_orderkey, TRUE AS yes, 'it''s' AS s, DATE '2024-02-29' AS d, 12.34 AS dec, -7::BIGINT AS i, NULL::VARCHAR AS nothing FROM orders
WHERE o_orderdate >= DATE '1995-03-01' AND o_orderdate < TIMESTAMP '1996-05-04 03:02:01' AND o_totalprice > 1000.5 AND o_orderstatus IN ('F', 'O')
""")
def typed_literals(spark, sf_dir):
    """Python values as SQL literals of their types, in filters and in projections."""
    day, at = datetime.date(1995, 3, 1), datetime.datetime(1996, 5, 4, 3, 2, 1)
    q = imported(spark, sf_dir, "orders").query().where((col("o_orderdate") >= lit(day)) & (col("o_orderdate") < lit(at)) & (col("o_totalprice") > lit(1000.5)) & col("o_orderstatus").isin(["F", "O"]))
    return q.select({"o_orderkey": "o_orderkey", "yes": lit(True), "s": lit("it's"), "d": lit(datetime.date(2024, 2, 29)), "dec": lit(decimal.Decimal("12.34")), "i": lit(-7), "nothing": lit(None).cast(str)}).to_df()


@query("SELECT c_custkey, (c_acctbal < 0 OR NOT c_mktsegment = 'BUILDING') AS a, c_custkey - 2 * c_nationkey AS b, c_acctbal / 4 AS c, trunc(c_acctbal)::BIGINT AS d, c_name LIKE 'Customer%7' AS e FROM customer WHERE c_nationkey IN (1, 5, 7) AND c_name IS NOT NULL AND contains(c_name, '1')")
def expression_operators(spark, sf_dir):
    q = imported(spark, sf_dir, "customer").query().where(col("c_nationkey").isin([1, 5, 7]) & col("c_name").is_not_null() & col("c_name").contains("1"))
    return q.select({"c_custkey": "c_custkey", "a": (col("c_acctbal") < 0) | ~(col("c_mktsegment") == "BUILDING"), "b": col("c_custkey") - 2 * col("c_nationkey"), "c": col("c_acctbal") / 4, "d": func("arrow_cast", col("c_acctbal"), "int64"), "e": col("c_name").like("Customer%7")}).to_df()


@query("SELECT 'o_orderkey' AS name, 'bigint' AS kind UNION ALL SELECT 'gross', 'double' UNION ALL SELECT 'flag', 'boolean' UNION ALL SELECT '_rowid', 'bigint'")
def output_schema(spark, sf_dir):
    """The columns of a query, known without running it."""
    q = imported(spark, sf_dir, "orders").query().select({"o_orderkey": "o_orderkey", "gross": "o_totalprice * 2", "flag": col("o_orderstatus") == "F"}).with_row_id()
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in q.output_schema], "name string, kind string")


@query("SELECT count(*) AS n, count(*) AS n_addresses FROM supplier")
def row_addresses(spark, sf_dir):
    return imported(spark, sf_dir, "supplier").query().with_row_id().with_row_address().select(["s_suppkey"]).to_df().agg(F.countDistinct("_rowid").alias("n"), F.countDistinct("_rowaddr").alias("n_addresses"))


@query("SELECT s_suppkey, s_name FROM supplier")
def fragment_scans(spark, sf_dir):
    """Each data file scanned by itself: together they are the table."""
    table = imported(spark, sf_dir, "supplier")
    out = None
    for f in table.manifest().files:
        part = table.query().fragments([f.path]).select(["s_suppkey", "s_name"]).to_df()
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 40")
def order_by_nulls(spark, sf_dir):
    return imported(spark, sf_dir, "events").query().order_by(("value", False, False), ("event_id", True, False)).select(["event_id", "value"]).limit(40).to_df()


# -- vector search -----------------------------------------------------------------------------


@query(ORACLE_SQL["knn_l2"])
def knn_inferred_column(spark, sf_dir):
    """A numpy query of single precision; the only vector column that fits is found."""
    table = imported(spark, sf_dir, "embeddings", "two_vectors", lambda df: df.select("vec_id", "label", F.col("embedding").alias("vector"), F.slice("embedding", 1, 2).alias("short")))
    return _rounded(table.search(np.asarray(VECTOR), "vector").select(["vec_id", "label"]).to_df(), "_distance")


@query(ORACLE_SQL["knn_l2"])
def ivf_probes_min_max(spark, sf_dir):
    """One partition at least, all at most: as many as the result needs."""
    table = cloned(_vectors(spark, sf_dir))
    table.create_index("vector", "ivf_flat", num_partitions=8)
    return _rounded(table.search(VECTOR).probes(8, None).select(["vec_id", "label"]).to_df(), "_distance")


@query(ORACLE_SQL["knn_l2"])
def ivf_bypassed(spark, sf_dir):
    table = cloned(_vectors(spark, sf_dir))
    table.create_index("vector", "ivf_rq", num_partitions=4)
    return _rounded(table.search(VECTOR).bypass_vector_index().select(["vec_id", "label"]).to_df(), "_distance")


@query(f"SELECT vec_id, round(d, 6) AS _distance FROM (SELECT vec_id, {_L2} AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10")
def ivf_fast_search(spark, sf_dir):
    """Only rows that the index covers: those added later stay out."""
    table = cloned(_vectors(spark, sf_dir))
    table.create_index("vector", "ivf_flat", num_partitions=4)
    table.add(_vectors(spark, sf_dir).to_df().withColumn("vec_id", F.col("vec_id") + 1_000_000))
    return _rounded(table.search(VECTOR).nprobes(4).fast_search().select(["vec_id"]).to_df(), "_distance")


@query("SELECT 'btree' AS what, count(*) AS n FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'bitmap', count(*) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'fm', count(*) FROM orders WHERE contains(o_orderpriority, 'URG') UNION ALL SELECT 'label_list', count(*) FROM orders WHERE o_custkey % 5 = 2 UNION ALL SELECT 'indices', 4 UNION ALL SELECT 'left', 3")
def scalar_indices(spark, sf_dir):
    """Filters on indexed columns, the catalogue of the indices, and one dropped."""
    table = cloned(imported(spark, sf_dir, "orders", "tagged_orders", lambda df: df.withColumn("tags", F.array((F.col("o_custkey") % 5).cast("string"), F.lit("all")))))
    for column, kind in (("o_custkey", "btree"), ("o_orderstatus", "bitmap"), ("o_orderpriority", "fm"), ("tags", "label_list")):
        table.create_index(column, kind)
    counts = {"btree": table.count_rows("o_custkey = 7"), "bitmap": table.count_rows("o_orderstatus = 'P'"), "fm": table.count_rows(col("o_orderpriority").contains("URG")), "label_list": table.count_rows(func("array_has", col("tags"), "2"))}
    counts["indices"] = len(table.list_indices())
    table.drop_index("tags_idx")
    return _counted(spark, **counts, left=len(table.list_indices()))


@query("SELECT 'vectors' AS what, count(*) AS n FROM embeddings UNION ALL SELECT 'later', count(*) FROM embeddings WHERE vec_id % 4 = 1 UNION ALL SELECT 'folded', count(*) + count(*) FILTER (vec_id % 4 = 1) FROM embeddings")
def index_counts(spark, sf_dir):
    """Rows that an index covers and lacks, before and after it is brought up to date."""
    table = cloned(_vectors(spark, sf_dir))
    table.create_index("vector", "ivf_flat", num_partitions=4)
    covered = table.index_stats("vector_idx")["num_indexed_rows"]
    table.add(_vectors(spark, sf_dir).to_df().filter("vec_id % 4 = 1"))
    later = table.index_stats("vector_idx")["num_unindexed_rows"]
    table.optimize()
    return _counted(spark, vectors=covered, later=later, folded=table.index_stats("vector_idx")["num_indexed_rows"])


# -- text --------------------------------------------------------------------------------------


@query(ORACLE_SQL["fts_match_all"])
def fts_query_operators(spark, sf_dir):
    """Queries joined by &: each must match."""
    the, and_, with_ = (fts.MatchQuery(w, "text") for w in ("the", "and", "with"))
    return _scored(_documents(spark, sf_dir).search(the & and_ & with_).all_matches().to_df())


@query(ORACLE_SQL["fts_phrase"])
def fts_phrase_flag(spark, sf_dir):
    return _scored(_documents(spark, sf_dir).search("in the").phrase_query().all_matches().to_df())


@query(f"WITH {_BM25_TOKENS}, hits AS (SELECT doc_id, len(list_filter(w, lambda x: x = 'the'))::DOUBLE AS tf, len(w)::DOUBLE AS dl FROM tokens), df AS (SELECT count(*)::DOUBLE AS df FROM hits WHERE tf > 0) SELECT doc_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS _score FROM hits, df, n WHERE tf > 0")
def fts_list_column(spark, sf_dir):
    """A column of lists of strings: their elements follow one another."""
    table = imported(spark, sf_dir, "documents", "lines", lambda df: df.select("doc_id", F.split("text", "\n").alias("lines")))
    if "lines_idx" not in table.indices():
        table.create_index("lines", "fts", **PLAIN)
    return _scored(table.search(fts.MatchQuery("the", "lines")).all_matches().to_df())


@query(r"SELECT term, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(p_name), '\s+'), lambda t: t <> '')) AS term FROM part) GROUP BY term")
def tokens_by_white_space(spark, sf_dir):
    tokens = Tokenizer("whitespace", **{**PLAIN, "with_position": False}).tokens(F.col("p_name"))
    return _read(spark, sf_dir, "part").select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("SELECT term, count(*) AS n FROM (SELECT substr(lower(p_name), i, k) AS term FROM (SELECT p_name, k, unnest(range(1, length(p_name) - k + 2)) AS i FROM part, (SELECT unnest([2, 3]) AS k) WHERE length(p_name) >= k)) GROUP BY term")
def tokens_by_ngram(spark, sf_dir):
    tokens = Tokenizer("ngram", **{**PLAIN, "with_position": False}, ngram_min_length=2, ngram_max_length=3).tokens(F.col("p_name"))
    return _read(spark, sf_dir, "part").select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pM\\pN]+'), lambda t: t <> '' AND length(t) <= 12 AND t NOT IN ({', '.join(repr(w) for w in STOP_WORDS)}))) AS term FROM documents) GROUP BY term")
def tokens_filtered(spark, sf_dir):
    """Stop words and long tokens removed."""
    tokens = Tokenizer(stem=False, ascii_folding=False, max_token_length=12).tokens(F.col("text"))
    return _read(spark, sf_dir, "documents").select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("SELECT place, token FROM (SELECT unnest([1, 2, 3]) AS place, unnest(['quick', 'brown', 'fox']) AS token)")
def tokenize(spark, sf_dir):
    """What the index's tokenizer makes of a text."""
    return spark.createDataFrame(list(enumerate(_documents(spark, sf_dir).tokenize("Quick, BROWN fox!"), 1)), "place int, token string")


@query("SELECT count(*) AS n FROM documents WHERE doc_id % 3 <> 0 AND regexp_matches(lower(text), '(^|[^\\pL\\pM\\pN])the([^\\pL\\pM\\pN]|$)')")
def fts_null_texts(spark, sf_dir):
    """Null texts are in no index and match nothing."""
    table = imported(spark, sf_dir, "documents", "some_texts", lambda df: df.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("text")))
    if "text_idx" not in table.indices():
        table.create_index("text", "fts", **PLAIN)
    assert table.index_stats("text_idx")["num_indexed_rows"] == table.count_rows("text IS NOT NULL")
    return table.search(fts.MatchQuery("the", "text")).all_matches().to_df().agg(F.count("*").alias("n"))


# -- rerankers ---------------------------------------------------------------------------------

_LISTS = f"""
WITH one AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_L2}, vec_id) AS r FROM embeddings QUALIFY r <= 30),
two AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_L2}, vec_id) AS r FROM embeddings WHERE label < 4 QUALIFY r <= 30)
"""


def _lists(spark, sf_dir: str):
    rows = _read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "_rowid")
    return [vector.nearest(f, "embedding", VECTOR, k=30).select("_rowid", "_distance") for f in (rows, rows.filter("label < 4"))]


@query(f"{_LISTS} SELECT id, round(sum(1 / (60.0 + r)), 6) AS _relevance_score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY id")
def rrf_of_vector_lists(spark, sf_dir):
    return _fused(rerank.RRF().rerank_multivector(_lists(spark, sf_dir)))


@query(f"{_LISTS} SELECT id, round(sum(1.0 / r) / 2, 6) AS _relevance_score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY id")
def mrr_of_vector_lists(spark, sf_dir):
    return _fused(rerank.MRR().rerank_multivector(_lists(spark, sf_dir)))


@query(f"WITH one AS (SELECT vec_id AS id, {_L2} AS d, row_number() OVER (ORDER BY d, vec_id) AS r FROM embeddings QUALIFY r <= 50) SELECT id, round(d, 6) AS _distance, round(1 / (60.0 + r), 6) AS _relevance_score FROM one")
def rrf_of_one_arm(spark, sf_dir):
    """One arm alone, with the scores it had."""
    return rerank.RRF(return_score="all").rerank_vector("", _near(spark, sf_dir)).select(F.col("_rowid").alias("id"), F.round("_distance", 6).alias("_distance"), F.round("_relevance_score", 6).alias("_relevance_score"))


# -- changes -----------------------------------------------------------------------------------


@query("""
SELECT 'added' AS what, count(*) AS n FROM customer WHERE c_nationkey = 9 UNION ALL SELECT 'updated', count(*) FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'deleted', count(*) FROM customer WHERE c_nationkey = 4
UNION ALL SELECT 'merged', count(*) FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'inserted', count(*) FROM customer WHERE c_nationkey = 2
""")
def change_counts(spark, sf_dir):
    """What each write says it did."""
    table = cloned(imported(spark, sf_dir, "customer"))
    rows = table.to_df()
    added = table.add(rows.filter("c_nationkey = 9").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)).inserted
    updated = table.update({"c_mktsegment": "NONE"}, where="c_nationkey = 7 AND c_custkey < 1000000").updated
    deleted = table.delete("c_nationkey = 4").deleted
    source = imported(spark, sf_dir, "customer").to_df().filter("c_nationkey = 3").unionByName(imported(spark, sf_dir, "customer").to_df().filter("c_nationkey = 2").withColumn("c_custkey", F.col("c_custkey") + 2_000_000))
    done = table.merge_insert("c_custkey").when_matched_update_all().when_not_matched_insert_all().execute(source)
    return _counted(spark, added=added, updated=updated, deleted=deleted, merged=done.updated, inserted=done.inserted)


@query("SELECT p_partkey, upper(p_name) AS loud, p_size + 1 AS larger FROM part")
def batch_columns(spark, sf_dir):
    """Columns that a function over Arrow batches fills."""
    table = cloned(imported(spark, sf_dir, "part"))
    table.add_columns((lambda b: pa.RecordBatch.from_arrays([pa.compute.utf8_upper(b.column("p_name")), pa.compute.add(b.column("p_size").cast(pa.int64()), 1)], names=["loud", "larger"]), "loud string, larger long"))
    return table.to_df().select("p_partkey", "loud", "larger")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0")
def restored_after_cleanup(spark, sf_dir):
    """Old versions dropped, a tagged one kept and restored."""
    table = cloned(imported(spark, sf_dir, "supplier"))
    table.delete("s_suppkey % 2 = 1")
    table.create_tag("half")
    table.delete("s_suppkey % 4 = 0")
    table.cleanup_old_versions(older_than=0.0)
    table.checkout("half")
    table.restore()
    return table.checkout_latest().to_df().select("s_suppkey", "s_name")


@query("""
WITH up AS (SELECT event_id, user_id + 1 AS user_id, value FROM events WHERE event_id % 7 = 0)
SELECT event_id, user_id, value FROM up UNION ALL SELECT event_id, user_id, value FROM events WHERE event_id % 7 <> 0
""")
def lsm_checkpoint(spark, sf_dir):
    """Generations in buckets folded into the table."""
    from .streaming.lsm import LsmSpec

    table = cloned(imported(spark, sf_dir, "events", "events_keyed", lambda df: df.select("event_id", "user_id", "value")))
    table.set_primary_key("event_id")
    tier = table.lsm(LsmSpec("bucket", "event_id", 8))
    tier.upsert(table.to_df().filter("event_id % 7 = 0").withColumn("user_id", F.col("user_id") + 1))
    tier.checkpoint()
    assert tier.stats()["generations"] == 0
    return table.checkout_latest().to_df().select("event_id", "user_id", "value")


# -- views and training order ------------------------------------------------------------------


@query("SELECT o_orderkey AS id, round(o_totalprice / 2, 4) AS half FROM orders WHERE o_orderstatus = 'F'")
def view_rebuilt(spark, sf_dir):
    """A full refresh, then one to a version before a delete."""
    db, table = database(spark), cloned(imported(spark, sf_dir, "orders"))
    before = table.version
    view = db.create_view(_fresh("full"), table, {"id": "o_orderkey", "half": "round(o_totalprice / 2, 4)"}, where="o_orderstatus = 'F'")
    table.delete("o_orderkey % 2 = 0")
    view.refresh(full=True)
    view.refresh(full=True, source_version=before)
    return view.to_df()


@query("SELECT 0 AS split_id, 'a' AS name, (count(*) // 2)::BIGINT AS n FROM part UNION ALL SELECT 1, 'b', 30 FROM part GROUP BY 1")
def permutation_sizes(spark, sf_dir):
    """Splits by ratio and by count, filtered and named."""
    from .plans.permutation import permutation

    table = imported(spark, sf_dir, "part")
    half = table.count_rows() // 2
    made = permutation(table).split_sequential(counts=[half, 30], names=["a", "b"]).build()
    return spark.createDataFrame([(i, made.split_names[i], made.split(i).count()) for i in made.splits], "split_id int, name string, n long")


@query("SELECT position, s_suppkey FROM (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS position, s_suppkey FROM supplier) WHERE position IN (0, 3, 5)")
def permutation_offsets(spark, sf_dir):
    """Rows at places of an order, and the values of a column."""
    from .plans.permutation import permutation

    table = imported(spark, sf_dir, "supplier", "supplier_sorted", lambda df: df.coalesce(1).sortWithinPartitions("s_suppkey"))
    made = permutation(table).build()
    assert made.unique("s_suppkey") == sorted(r.s_suppkey for r in table.to_df().collect())
    return spark.createDataFrame([(p, r.s_suppkey) for p, r in zip((5, 0, 3), made.take_offsets([5, 0, 3]).collect(), strict=True)], "position long, s_suppkey long")


@query("SELECT p_partkey FROM part")
def streaming_shares(spark, sf_dir):
    """The shares of three readers of a shuffled order are the table."""
    from .plans.permutation import permutation
    from .streaming.loader import StreamingDataset

    made = permutation(imported(spark, sf_dir, "part")).shuffle(seed=4).build()
    out = None
    for rank in range(3):
        part = StreamingDataset(made, rank=rank, world_size=3).frame().select("p_partkey")
        out = part if out is None else out.unionByName(part)
    return out


# -- more of the same --------------------------------------------------------------------------


@query(ORACLE_SQL["knn_l2"])
def index_built_apart(spark, sf_dir):
    """An index of the default kind built beside the caller, waited for, found by its name."""
    table = cloned(_vectors(spark, sf_dir))
    table.create_index("vector", "ivf_flat", name="apart", num_partitions=8, wait=False).result()
    table.wait_for_index(["apart"])
    assert [i["name"] for i in table.list_indices()] == ["apart"]
    return _rounded(table.search(VECTOR).nprobes(8).select(["vec_id", "label"]).to_df(), "_distance")


@query("SELECT doc_id FROM documents WHERE lang = 'de'")
def index_of_nested_column(spark, sf_dir):
    table = cloned(imported(spark, sf_dir, "documents", "nested", lambda df: df.select("doc_id", F.struct("lang", F.struct("source").alias("from")).alias("meta"))))
    assert table.create_index("meta.lang")["kind"] == "btree"
    return table.query().where("meta.lang = 'de'").select(["doc_id"]).to_df()


@query("SELECT 'listed' AS what, 2 AS n UNION ALL SELECT 'left', 1 UNION ALL SELECT 'rows', (SELECT count(*) FROM orders WHERE o_orderstatus = 'P')")
def view_catalogue(spark, sf_dir):
    """Views listed, opened and dropped, in a namespace of their own."""
    db, space = database(spark), [_fresh("views")]
    db.create_namespace(space)
    source = cloned(imported(spark, sf_dir, "orders"))
    for name in ("one", "two"):
        db.create_view(name, source, {"id": "o_orderkey"}, where="o_orderstatus = 'P'", namespace=space).refresh()
    listed = len(db.list_views(space))
    db.drop_view("two", space)
    return _counted(spark, listed=listed, left=len(db.list_views(space)), rows=db.open_view("one", space).to_df().count())


@query("SELECT 'owner' AS key, 'b' AS value UNION ALL SELECT 'unit', 'cent'")
def field_metadata(spark, sf_dir):
    """A column's notes, merged and changed."""
    table = cloned(imported(spark, sf_dir, "part"))
    table.update_field_metadata("p_retailprice", {"unit": "cent", "owner": "a"})
    table.update_field_metadata("p_retailprice", {"owner": "b"})
    notes = {k: v for k, v in table.schema["p_retailprice"].metadata.items() if k in ("unit", "owner")}
    return spark.createDataFrame(sorted(notes.items()), "key string, value string")


@query("SELECT p_partkey * 2 AS twice FROM part WHERE p_size > 10")
def permutation_mapped(spark, sf_dir):
    """A filtered order, a renamed column, a function over its batches."""
    from .plans.permutation import permutation

    made = permutation(imported(spark, sf_dir, "part")).filter("p_size > 10").shuffle(seed=2).build().select_columns(["p_partkey"]).rename_column("p_partkey", "key")
    return made.map(lambda batches: (pa.RecordBatch.from_arrays([pa.compute.multiply(b.column("key"), 2)], names=["twice"]) for b in batches), "twice long")


@query("SELECT r_regionkey, r_name FROM region")
def arrow_ipc(spark, sf_dir):
    """Rows to an Arrow stream of bytes and back."""
    from .sources.ingest import from_ipc, to_ipc

    return from_ipc(spark, to_ipc(_read(spark, sf_dir, "region").select("r_regionkey", "r_name")))


@query("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 4 OFFSET 7")
def rows_by_place(spark, sf_dir):
    """table[a:b]"""
    return imported(spark, sf_dir, "part", "part_sorted", lambda df: df.coalesce(1).sortWithinPartitions("p_partkey"))[7:11].select("p_partkey")


@query(f"WITH {_bm25('blees', 'thention')}, top AS (SELECT doc_id, sum(s) AS s FROM parts GROUP BY doc_id ORDER BY s DESC, doc_id LIMIT 20) SELECT doc_id, length(text)::DOUBLE AS _relevance_score FROM top JOIN documents USING (doc_id) ORDER BY length(text) DESC, doc_id LIMIT 5")
def model_reranked(spark, sf_dir):
    """A text search whose rows are scored anew by a function of their texts."""
    ranker = rerank.ModelReranker(lambda _, texts: texts.str.len(), "text")
    found = _documents(spark, sf_dir).search("blees thention").ties("doc_id").limit(20).rerank(ranker).to_df()
    return found.select("doc_id", "_relevance_score").orderBy(F.col("_relevance_score").desc(), "doc_id").limit(5)


@query(f"WITH d AS (SELECT vec_id, {_L2} AS d FROM embeddings) SELECT vec_id, d < 24 AS near FROM d ORDER BY d, vec_id LIMIT 10")
def search_without_scores(spark, sf_dir):
    """The distance named in an expression, and not added of itself."""
    found = _vectors(spark, sf_dir).search(VECTOR).ties("vec_id").select({"vec_id": "vec_id", "near": "_distance < 24"}).without_scores().to_df()
    assert found.columns == ["vec_id", "near"]
    return found


@query("SELECT 'lazy' AS what, count(*) AS n FROM region UNION ALL SELECT 'strong', count(*) - 1 FROM region UNION ALL SELECT 'refreshed', count(*) - 1 FROM region")
def read_consistency(spark, sf_dir):
    """A handle that may lag behind other writers, and one that may not."""
    from .sources.catalog import connect

    table = cloned(imported(spark, sf_dir, "region"))
    lazy = connect(spark, database(spark).uri, freshness=None).open_table(table.name)
    lazy.count_rows()
    table.delete("r_regionkey = 1")
    behind = lazy.count_rows()
    return _counted(spark, lazy=behind, strong=database(spark).open_table(table.name).count_rows(), refreshed=lazy.checkout_latest().count_rows())


@query(f"{_LISTS} SELECT DISTINCT id FROM (SELECT * FROM one UNION ALL SELECT * FROM two)")
def lists_deduplicated(spark, sf_dir):
    """Several result lists as one, by a reranker that only says how it scores: each row once."""

    class Nearness(rerank.Reranker):
        def rerank_vector(self, query, vector):
            return self._finish(vector, 1 - F.col("_distance"))

    return Nearness().rerank_multivector(_lists(spark, sf_dir)).select(F.col("_rowid").alias("id"))
