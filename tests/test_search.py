"""Queries, vector search, text search, fusion and indices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.functions import distance as D
from skerry.functions.expr import col
from skerry.functions.registry import embedding_spec, get_function, udf
from skerry.functions.text import Tokenizer, porter
from skerry.operators import fts, rerank, vector
from skerry.operators.index import Coder, default_sub_vectors, kmeans
from skerry.operators.joins import as_of, within
from skerry.sources.catalog import connect


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    return connect(spark, str(tmp_path_factory.mktemp("db")))


@pytest.fixture(scope="module")
def points(db, spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), i % 4, f"item {i}") for i in range(400)]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType()), True, {"dim": 8}), T.StructField("kind", T.LongType()), T.StructField("name", T.StringType())])
    table = db.create_table("points", spark.createDataFrame(rows, schema).repartition(3), schema)
    return table, np.array([r[1] for r in rows], dtype=np.float64)


def brute(matrix, q, k, metric="l2", keep=None):
    d = vector.distances(metric, matrix, np.asarray([q], dtype=float))[0]
    ids = np.arange(len(matrix)) if keep is None else np.flatnonzero(keep)
    return ids[np.argsort(d[ids], kind="stable")][:k].tolist()


Q = [0.5, -1.0, 0.25, 0.0, 1.0, 0.1, -0.3, 0.7]


# -- scans -----------------------------------------------------------------------------------


def test_projections(points):
    table, _ = points
    assert table.query().limit(1).to_df().columns == ["id", "vector", "kind", "name"]
    assert table.query().select(["name", "id"]).to_df().columns == ["name", "id"]
    got = table.query().select({"k": "kind + 1", "up": col("name").upper()}).where("id = 5").with_row_id().to_list()
    assert got[0]["k"] == 2 and got[0]["up"] == "ITEM 5" and "_rowid" in got[0]
    assert table.query().select([("x", "id * 2")]).output_schema.fieldNames() == ["x"]
    assert table.query().with_row_address().limit(1).to_list()[0]["_rowaddr"].startswith("part-")


def test_paging_is_a_slice_of_the_whole(points):
    table, _ = points
    whole = [r["id"] for r in table.query().order_by(("kind", False, False), "id").to_list()]
    assert [r["id"] for r in table.query().order_by(("kind", False, False), "id").limit(7).offset(390).to_list()] == whole[390:397]
    assert [r["id"] for r in table.query().order_by(("kind", False, False), "id").offset(398).to_list()] == whole[398:]
    near = [r["id"] for r in table.search(Q).limit(50).to_list()]
    assert [r["id"] for r in table.search(Q).limit(7).offset(20).to_list()] == near[20:27]
    with pytest.raises(ValueError):
        table.query().limit(-1)
    assert table.query().limit(0).to_list() == []


def test_order_of_nulls(db):
    table = db.create_table("nulls", [{"x": 2}, {"x": None}, {"x": 1}])
    assert [r["x"] for r in table.query().order_by(("x", True, True)).to_list()] == [None, 1, 2]
    assert [r["x"] for r in table.query().order_by(("x", False, False)).to_list()] == [2, 1, None]


def test_ways_to_collect(points):
    table, _ = points
    q = table.query().select(["id"]).limit(25)
    assert sum(b.num_rows for b in q.to_batches(10)) == 25 and q.to_arrow().num_rows == 25 and len(q.to_pandas()) == 25 and len(q.timeout(60)) == 25
    assert "Scan parquet" in q.explain() and "Scan" in q.analyze()
    assert table.query().fragments([table.manifest().files[0].path]).to_df().count() == table.manifest().files[0].rows
    with pytest.raises(NotImplementedError):
        table.query().where(b"substrait")


def test_filters_reach_the_scan(points):
    table, _ = points
    plan = table.query().where("kind = 2").select(["id"]).explain()
    assert "PushedFilters: [IsNotNull(kind), EqualTo(kind,2)]" in plan and "ReadSchema: struct<id:bigint,kind:bigint" in plan and "vector" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "TakeOrderedAndProject" in table.search(Q).limit(3).explain()


# -- vectors ---------------------------------------------------------------------------------


def test_squared_l2_golden(spark):
    frame = spark.createDataFrame([(0, [0.5, 3.4, 1.3]), (1, [0.3, 6.2, 2.6])], "_rowid long, vector array<float>")
    got = vector.nearest(frame, "vector", [0.4, 1.4, 2.4]).collect()
    assert [round(r["_distance"], 2) for r in got] == [5.22, 23.09]


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_flat_search(points, metric):
    table, matrix = points
    assert [r["id"] for r in table.search(Q).metric(metric).to_list()] == brute(matrix, Q, 10, metric)
    keep = np.arange(400) % 4 == 1
    assert [r["id"] for r in table.search(Q).metric(metric).where("kind = 1").limit(5).to_list()] == brute(matrix, Q, 5, metric, keep)
    after = table.search(Q).metric(metric).where("kind = 1").postfilter().limit(40).to_list()
    assert [r["id"] for r in after] == [i for i in brute(matrix, Q, 40, metric) if i % 4 == 1]


def test_distance_range_is_half_open(points):
    table, _ = points
    d = [r["_distance"] for r in table.search(Q).limit(30).to_list()]
    got = [r["_distance"] for r in table.search(Q).distance_range(d[3], d[9]).limit(100).to_list()]
    assert got == d[3:9] and [r["_distance"] for r in table.search(Q).distance_range(high=d[2]).to_list()] == d[:2]


def test_several_queries(points):
    table, matrix = points
    frame = table.search([Q, Q[::-1]]).limit(4).offset(1).select(["id"]).to_df()
    assert frame.columns[0] == "query_index"
    rows = frame.collect()
    for i, q in enumerate((Q, Q[::-1])):
        assert [r.id for r in rows if r.query_index == i] == brute(matrix, q, 5)[1:]
    more = table.search(Q).add_query_vector(Q[::-1]).limit(1).to_df().collect()
    assert sorted(r.query_index for r in more) == [0, 1]


def test_zero_and_broken_vectors_have_no_distance(spark):
    frame = spark.createDataFrame([(0, [0.0, 0.0]), (1, None), (2, [float("nan"), 1.0]), (3, [1.0, 1.0]), (4, [1.0])], "_rowid long, v array<float>")
    assert [r["_rowid"] for r in vector.nearest(frame, "v", [1.0, 0.0], "cosine").collect()] == [3]
    assert [r["_rowid"] for r in vector.nearest(frame, "v", [1.0, 0.0]).collect()] == [0, 3] or [r["_rowid"] for r in vector.nearest(frame, "v", [1.0, 0.0]).collect()] == [3, 0]
    many = vector.nearest_of_many(frame, "v", [[1.0, 0.0]], "cosine").collect()
    assert [r["_rowid"] for r in many] == [3]


def test_query_coercion_and_columns(points, db, spark):
    import pyarrow as pa

    table, matrix = points
    for q in (np.array(Q, dtype=np.float32), np.array(Q, dtype=np.float16), pa.array(Q), tuple(Q)):
        assert len(table.search(q).limit(2).to_list()) == 2
    for bad in (["a", "b"], [], [[[1.0]]]):
        with pytest.raises(ValueError):
            vector.coerce(bad)
    with pytest.raises(ValueError):
        table.search([1.0, 2.0]).to_df()
    schema = T.StructType.fromDDL("id long, s struct<emb array<float>>, other array<float>")
    two = db.create_table("two", [{"id": 1, "s": {"emb": [1.0, 0.0]}, "other": [0.0, 1.0]}], schema)
    with pytest.raises(ValueError, match="more than one"):
        two.search([1.0, 0.0]).to_df()
    assert two.search([1.0, 0.0], "s.emb").to_list()[0]["_distance"] == 0.0 and two.search([1.0, 0.0], "S.EMB").to_list()[0]["_distance"] == 0.0


def test_hamming(spark):
    frame = spark.createDataFrame([(0, bytearray([0b1010, 255])), (1, bytearray([0, 0])), (2, None)], "_rowid long, v binary")
    got = {r["_rowid"]: r["_distance"] for r in vector.nearest(frame, "v", [0b1000, 255], "hamming").collect()}
    assert got == {0: 1.0, 1: 9.0}
    assert {r["_rowid"]: r["_distance"] for r in vector.nearest_of_many(frame, "v", [[0b1000, 255]], "hamming").collect()} == got
    ints = spark.createDataFrame([([0b1010, 255],)], "v array<int>")
    assert ints.select(D.hamming(F.col("v"), F.array(F.lit(0), F.lit(255))).alias("d")).first().d == 2.0


def test_multivectors(spark):
    frame = spark.createDataFrame([(0, [[1.0, 0.0], [0.0, 1.0]]), (1, [[1.0, 1.0]])], "_rowid long, v array<array<float>>")
    got = {r["_rowid"]: r["_distance"] for r in vector.nearest(frame, "v", [[1.0, 0.0], [0.0, 2.0]], "cosine").collect()}
    assert got[0] == pytest.approx(0.0) and got[1] == pytest.approx(2 - math.sqrt(2))
    with pytest.raises(ValueError):
        vector.nearest(frame, "v", [1.0, 0.0], "l2")


@pytest.mark.parametrize("kind, refine", [("ivf_flat", 1), ("ivf_sq", 4), ("ivf_pq", 20), ("ivf_rq", 20), ("ivf_hnsw_pq", 20)])
@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_indexed_recall(db, points, kind, refine, metric):
    table, matrix = points
    copy = db.clone_table(f"copy_{kind}_{metric}", table)
    copy.create_index("vector", kind, num_partitions=6, metric=metric, num_sub_vectors=4, num_bits=6)
    hits = 0
    for i in range(5):
        got = [r["id"] for r in copy.search(matrix[i] + 0.1).nprobes(6).refine_factor(refine).limit(10).to_list()]
        hits += len(set(got) & set(brute(matrix, matrix[i] + 0.1, 10, metric)))
    assert hits >= 45


def test_index_life(db, points, spark):
    table, matrix = points
    copy = db.clone_table("life", table)
    future = copy.create_index("vector", "ivf_flat", num_partitions=4, wait=False)
    assert future.result()["kind"] == "ivf_flat"
    copy.wait_for_index(["vector_idx"])
    assert copy.index_stats("vector_idx")["num_unindexed_rows"] == 0 and copy.index_stats("none") is None
    near = brute(matrix, Q, 1)[0]
    copy.delete(f"id = {near}")
    copy.add([{"id": 900, "vector": Q, "kind": 0, "name": "new"}])
    got = [r["id"] for r in copy.search(Q).nprobes(4).limit(3).to_list()]
    assert got[0] == 900 and near not in got
    assert 900 not in [r["id"] for r in copy.search(Q).nprobes(4).fast_search().limit(3).to_list()]
    assert [r["id"] for r in copy.search(Q).bypass_vector_index().limit(3).to_list()] == got
    assert [r["id"] for r in copy.search(Q).where("kind = 2").nprobes(4).limit(3).to_list()] == brute(matrix, Q, 3, keep=np.arange(400) % 4 == 2)
    copy.optimize()
    assert copy.index_stats("vector_idx")["num_unindexed_rows"] == 0 and [r["id"] for r in copy.search(Q).nprobes(4).fast_search().limit(3).to_list()] == got
    with pytest.raises(ValueError):
        copy.create_index("vector", "ivf_flat", replace=False)
    copy.drop_index("vector_idx")
    with pytest.raises(ValueError):
        copy.drop_index("vector_idx")
    many = db.clone_table("life2", table)
    many.create_index("vector", "ivf_flat", num_partitions=50)
    assert len(many.search(Q).probes(1, None).limit(100).to_list()) == 100 and len(many.search(Q).nprobes(1).limit(100).to_list()) < 100


def test_index_kinds_are_checked(db):
    table = db.create_table("kinds", [{"Id": 1, "tags": ["a"], "Meta": {"userId": 5}, "name": "x", "vec": [1.0, 2.0]}])
    assert table.create_index("id")["kind"] == "btree" and table.create_index("meta.userid", "bitmap")["column"] == "Meta.userId"
    assert table.create_index("tags", "label_list") and table.create_index("name", "fm") and table.create_index("vec", num_partitions=1)["kind"] == "ivf_pq"
    for c, k in (("tags", "btree"), ("name", "ivf_flat"), ("Id", "fts"), ("Id", "nothing"), ("nope", "btree")):
        with pytest.raises(ValueError):
            table.create_index(c, k)
    assert set(table.indices()) == {"Id_idx", "Meta.userId_idx", "tags_idx", "name_idx", "vec_idx"}
    assert table.query().where("array_contains(tags, 'a') AND contains(name, 'x')").to_df().count() == 1


def test_clustered_btree_prunes(db, spark):
    table = db.create_table("cluster", spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("v")).repartition(4))
    table.create_index("v", "btree", cluster=True)
    assert table.count_rows("v = 500") == 1 and [r.v for r in table.scan().select("v").collect()] == sorted(r.v for r in table.scan().select("v").collect())


def test_kmeans_and_codes():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(5, 8)) * 10
    rows = np.concatenate([c + rng.normal(size=(40, 8)) * 0.1 for c in centers])
    found = kmeans(rows, 5)
    assert all(np.abs(found - c).sum(axis=1).min() < 2 for c in centers)
    part = ((rows[:, None] - found[None]) ** 2).sum(axis=2).argmin(axis=1)
    for kind, worst in (("flat", 1e-5), ("sq", 0.2), ("pq", 1.0), ("rq", 0.5)):
        coder = Coder.fit(kind, rows, found, 4, 8)
        again = Coder.from_row({k: v for k, v in coder.to_row().items()})
        assert np.abs(again.decode(coder.encode(rows, part), part) - rows).mean() < worst
    assert [default_sub_vectors(d) for d in (64, 24, 10)] == [4, 3, 1]


# -- text ------------------------------------------------------------------------------------


def test_tokenizers(spark):
    assert Tokenizer().of(spark, "The Running dogs' CAFÉS, and größe!") == ["run", "dog", "cafe", "gross"]
    assert Tokenizer(stem=False, remove_stop_words=False, ascii_folding=False).of(spark, "The Café, x2") == ["the", "café", "x2"]
    assert Tokenizer("whitespace", stem=False).of(spark, "a-b  C d.") == ["a-b", "c", "d."]
    assert Tokenizer("raw", stem=False, lower_case=False).of(spark, "New York") == ["New York"]
    assert Tokenizer("ngram", stem=False, remove_stop_words=False, ngram_min_length=2).of(spark, "abcd") == ["ab", "bc", "cd", "abc", "bcd"]
    assert Tokenizer("ngram", stem=False, prefix_only=True, ngram_min_length=2).of(spark, "hello yo") == ["he", "hel", "yo"]
    assert Tokenizer(max_token_length=3, stem=False).of(spark, "abcd abc") == ["abc"]
    assert Tokenizer(custom_stop_words=["foo"], stem=False).of(spark, "foo the bar") == ["the", "bar"]
    german = Tokenizer(language="German", stem=False)
    assert german.of(spark, "Der schnelle Fuchs und die müde Katze für uns") == ["schnelle", "fuchs", "mude", "katze"]
    assert Tokenizer(language="French", stem=False).of(spark, "Le chat avec nous") == ["chat"]
    for bad in ({"base_tokenizer": "jieba"}, {"base_tokenizer": "lindera/ipadic"}, {"language": "French"}, {"language": "Klingon", "stem": False}):
        with pytest.raises(NotImplementedError):
            Tokenizer(**bad)
    with pytest.raises(ValueError):
        Tokenizer("nothing")


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("generalizations", "gener"), ("controlling", "control"), ("rate", "rate"), ("be", "be")])
def test_porter(word, stem):
    assert porter(word) == stem


DOCS = [
    "the quick brown fox jumps over the lazy dog", "a quick dog", "brown bears are lazy", "fox and dog and fox", None, "", "lazy lazy lazy dog sleeps", "the puppy runs quickly", "der schnelle braune fuchs", "quick quick brown",
]


@pytest.fixture(scope="module")
def docs(db):
    table = db.create_table("docs", [{"id": i, "text": t, "kind": i % 2, "tags": (t or "").split()[:2], "title": f"title {i}"} for i, t in enumerate(DOCS)])
    table.create_index("text", "fts", with_position=True, stem=False, remove_stop_words=False)
    return table


def ids(q):
    return [r["id"] for r in q.to_list()]


def test_match(docs):
    assert set(ids(docs.search("fox"))) == {0, 3} and ids(docs.search("fox"))[0] == 3
    assert set(ids(docs.search("FOX bears"))) == {0, 2, 3}
    assert set(ids(docs.search(fts.MatchQuery("quick brown", "text", operator="AND")))) == {0, 9}
    assert ids(docs.search("missing")) == [] and ids(docs.search("...")) == []
    assert set(ids(docs.search(fts.MatchQuery("quik", "text", fuzziness=1)))) == {0, 1, 9}
    assert set(ids(docs.search(fts.MatchQuery("lasy", "text", fuzziness=None, prefix_length=2)))) == {0, 2, 6}
    assert ids(docs.search(fts.MatchQuery("xazy", "text", fuzziness=1, prefix_length=1))) == []
    one, two = (docs.search(fts.MatchQuery("fox", "text", boost=b)).to_list() for b in (1.0, 2.0))
    assert [r["_score"] * 2 for r in one] == pytest.approx([r["_score"] for r in two])


def test_score_golden(docs):
    n, lengths = 9, [len((t or "").split()) for t in DOCS if t is not None]
    mean, df, tf, dl = sum(lengths) / n, 2, 2, 5
    want = math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))
    assert docs.search("fox").to_list()[0]["_score"] == pytest.approx(want)


def test_phrases(docs):
    assert ids(docs.search(fts.PhraseQuery("quick brown", "text"))) == [9, 0]
    assert set(ids(docs.search(fts.PhraseQuery("quick fox", "text", slop=1)))) == {0} and ids(docs.search(fts.PhraseQuery("quick fox", "text"))) == []
    assert ids(docs.search(fts.PhraseQuery("brown quick", "text"))) == []
    assert ids(docs.search("lazy dog").phrase_query()) == [6, 0]
    assert set(ids(docs.search(fts.PhraseQuery("fox and dog and fox", "text")))) == {3}


def test_query_trees(docs):
    fox, dog = fts.MatchQuery("fox", "text"), fts.MatchQuery("dog", "text")
    assert set(ids(docs.search(fox & dog))) == {0, 3} and set(ids(docs.search(fox | dog))) == {0, 1, 3, 6}
    assert set(ids(docs.search(fts.BooleanQuery([("must", dog), ("must_not", fox)])))) == {1, 6}
    plain = {r["id"]: r["_score"] for r in docs.search(dog).to_list()}
    down = {r["id"]: r["_score"] for r in docs.search(fts.BoostQuery(dog, fox, 0.5)).to_list()}
    assert down[1] == plain[1] and down[3] < plain[3]
    with pytest.raises(ValueError):
        docs.search(fts.BooleanQuery([("MUST_NOT", fox)])).to_df()
    for q in (fox, fts.PhraseQuery("a b", "text", 2), fts.BoostQuery(fox, dog, 0.1), fts.MultiMatchQuery("x", ["a", "b"], [1.0, 2.0]), fox & dog):
        assert fts.from_dict(q.to_json()).to_dict() == q.to_dict()


def test_text_with_filters_and_order(docs):
    assert ids(docs.search("dog").where("kind = 0")) == [6, 0] or set(ids(docs.search("dog").where("kind = 0"))) == {0, 6}
    assert set(ids(docs.search("dog").where("kind = 1").postfilter().limit(1))) <= {1, 3}
    assert ids(docs.search("dog").order_by(("id", False, False)).limit(3)) == sorted(ids(docs.search("dog").limit(3)), reverse=True)
    assert ids(docs.search("dog").limit(1).offset(1)) == ids(docs.search("dog"))[1:2]


def test_rows_the_index_lacks(db, docs):
    copy = db.clone_table("docs2", docs)
    copy.create_index("text", "fts", with_position=True, stem=False, remove_stop_words=False)
    copy.add([{"id": 77, "text": "fox fox fox", "kind": 1}])
    copy.update({"text": "nothing"}, where="id = 3")
    assert ids(copy.search("fox")) == [77, 0] and ids(copy.search("fox").fast_search()) == [0]
    copy.optimize()
    assert ids(copy.search("fox").fast_search()) == [77, 0]
    tags = copy.create_index("tags", "fts", stem=False)
    assert tags["texts"] == 10 and 0 in ids(copy.search("quick", fts_columns="tags"))
    multi = {r["id"]: r["_score"] for r in copy.search(fts.MultiMatchQuery("quick", ["text", "tags"], [1.0, 3.0])).to_list()}
    assert set(multi) == {0, 1, 9}
    with pytest.raises(ValueError, match="positions"):
        copy.search(fts.PhraseQuery("a b", "tags")).to_df()


def test_text_needs_an_index(db):
    table = db.create_table("bare", [{"text": "x"}])
    with pytest.raises(ValueError, match="index"):
        table.search("x").to_df()


def test_sql_table_function(db, docs):
    q = '{"match": {"column": "text", "terms": "dog"}}'
    got = db.sql(f"SELECT kind, count(*) AS n FROM fts('docs', '{q}') WHERE id < 6 GROUP BY kind")
    assert {r.kind: r.n for r in got.collect()} == {0: 1, 1: 2}
    joined = db.sql(f"SELECT d.id FROM fts(docs, '{q}') f JOIN docs d ON d.id = f.id ORDER BY f._score DESC LIMIT 1")
    assert joined.collect()[0].id == 6 or joined.count() == 1
    for bad in ("SELECT * FROM fts('nope', '{}')", "SELECT * FROM fts('docs', kind)"):
        with pytest.raises(ValueError):
            db.sql(bad)


# -- fusion ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def arms(spark):
    near = spark.createDataFrame([(1, 0.1, "a"), (2, 0.2, "b"), (3, 0.4, "c")], "_rowid long, _distance double, name string")
    text = spark.createDataFrame([(3, 0.9, "c"), (4, 0.5, "d")], "_rowid long, _score double, name string")
    return near, text


def scores(frame):
    return {r["_rowid"]: r["_relevance_score"] for r in frame.collect()}


def test_normalisation_and_ranks_golden(spark):
    values = lambda vs: spark.createDataFrame(list(enumerate(vs)), "_rowid long, x double")
    assert [r.x for r in rerank.normalized(values([-4.0, 2.0, 0.0, 3.0, 6.0]), "x").orderBy("_rowid").collect()] == pytest.approx([0, 0.6, 0.4, 0.7, 1])
    assert [r.x for r in rerank.normalized(values([5.0, 5.0]), "x").collect()] == [0, 0]
    up, down = (rerank.ranked(values([0.2, 0.4, 0.1, 0.6, 0.45]), "x", d).orderBy("_rowid").collect() for d in (False, True))
    assert [r["_rank"] for r in up] == [2, 3, 1, 5, 4] and [r["_rank"] for r in down] == [4, 3, 5, 1, 2]


def test_rerankers(arms):
    near, text = arms
    assert scores(rerank.RRF().rerank_hybrid("", near, text)) == pytest.approx({1: 1 / 61, 2: 1 / 62, 3: 1 / 63 + 1 / 61, 4: 1 / 62})
    assert scores(rerank.RRF(rank_base=0).rerank_hybrid("", near, text))[1] == pytest.approx(1 / 60)
    assert scores(rerank.MRR(0.5, 0.5).rerank_hybrid("", near, text)) == pytest.approx({1: 0.5, 2: 0.25, 3: 0.5 / 3 + 0.5, 4: 0.25})
    linear = scores(rerank.LinearCombination(0.7).rerank_hybrid("", near, text))
    assert linear == pytest.approx({1: 0.63, 2: 0.56, 3: 0.7 * 0.6 + 0.3 * 0.9, 4: 0.15})
    assert rerank.LinearCombination(0.7, return_score="all").rerank_hybrid("", near, text).columns[-3:] == ["_distance", "_score", "_relevance_score"]
    both = rerank.RRF().rerank_hybrid("", near, text)
    assert {r["_rowid"]: r["name"] for r in both.collect()} == {1: "a", 2: "b", 3: "c", 4: "d"} and both.first()["_rowid"] == 3
    empty = text.limit(0)
    assert scores(rerank.RRF().rerank_hybrid("", near, empty)) == pytest.approx({1: 1 / 61, 2: 1 / 62, 3: 1 / 63})
    for bad in (lambda: rerank.MRR(0.9, 0.9), lambda: rerank.RRF(0), lambda: rerank.LinearCombination(2), lambda: rerank.RRF(return_score="some")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(NotImplementedError):
        rerank.LinearCombination().rerank_vector("", near)
    with pytest.raises(ValueError):
        rerank.checked(near)


def test_rerank_several_vector_results(arms, spark):
    near, _ = arms
    other = spark.createDataFrame([(2, 0.05, "b"), (9, 0.3, "z")], "_rowid long, _distance double, name string")
    assert scores(rerank.RRF().rerank_multivector([near, other])) == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 63, 9: 1 / 62})
    assert scores(rerank.MRR().rerank_multivector([near, other])) == pytest.approx({1: 0.5, 2: 0.25 + 0.5, 3: 1 / 6, 9: 0.25})
    model = rerank.ModelReranker(lambda q, texts: texts.map(lambda t: float(ord(t[0]))), "name")
    assert scores(model.rerank_multivector([near, other]))[9] == ord("z") and len(scores(model.rerank_multivector([near, other]))) == 4
    assert model.rerank_multivector([near, other], deduplicate=False).count() == 5


def test_hybrid_queries(db):
    table = db.create_table("hybrid", [{"id": i, "text": t, "vector": v} for i, (t, v) in enumerate([("a fox", [0.0, 0.0]), ("b", [1.0, 0.0]), ("cat fox", [5.0, 5.0]), ("dog", [0.1, 0.1])])])
    table.create_index("text", "fts", stem=False)
    q = table.search([0.0, 0.0]).nearest_to_text("fox").select(["id"])
    got = q.to_list()
    assert got[0]["id"] == 0 and len(got) == 4 and set(got[0]) == {"id", "_relevance_score"}
    assert [r["id"] for r in q.limit(2).offset(1).to_list()] == [r["id"] for r in got][1:3]
    for norm in ("rank", "score"):
        out = table.search([0.0, 0.0]).nearest_to_text("fox").rerank(rerank.LinearCombination(0.7, return_score="all"), normalize=norm).to_list()
        assert {r["id"]: r["_distance"] for r in out}[2] == 50.0
    vector_only = table.search([0.0, 0.0]).rerank(rerank.RRF()).limit(2).to_list()
    assert [r["id"] for r in vector_only] == [0, 3] and "_relevance_score" in vector_only[0]
    assert table.search("fox").rerank(rerank.MRR()).to_list()[0]["_relevance_score"] == 1.0
    with pytest.raises(ValueError):
        table.search([0.0, 0.0]).rerank(normalize="other")


# -- functions, joins ------------------------------------------------------------------------


def test_functions(spark):
    @udf
    def shout(s: str) -> str:
        return s.upper()

    @udf(name="shout")
    def louder(s: str) -> str:
        return s.upper() + "!"

    @udf(returns="low long, high long")
    def spread(x: int):
        return {"low": x - 1, "high": x + 1}

    frame = spark.createDataFrame([("a", 1), (None, 5)], "s string, x long")
    assert [r[0] for r in frame.select(shout("s")).collect()] == ["A", None] and [r[0] for r in frame.select(louder(s="s")).collect()] == ["A!", None]
    assert get_function("shout").version == 2 and get_function("shout", 1) is shout
    r = frame.select(spread.rename(low="least")("x").alias("r")).first().r
    assert (r.least, r.high) == (0, 2)
    with pytest.raises(TypeError):
        udf(lambda x: x)
    with pytest.raises(ValueError):
        get_function("none")


def test_embeddings(db):
    spec = embedding_spec("hashing", "text", "vec", dim=16)
    table = db.create_table("emb", [{"id": 1, "text": "red apple"}, {"id": 2, "text": "blue whale"}, {"id": 3, "text": None}], embeddings=[spec])
    assert table.columns == ["id", "text", "vec"] and table.search("red apples").limit(1).to_list()[0]["id"] == 1
    table.create_index("text", "fts")
    assert {r["id"] for r in table.search("whale", query_type="hybrid").to_list()} == {1, 2}
    assert ids(table.search("whale", query_type="fts")) == [2]


def test_joins(spark):
    left = spark.createDataFrame([(1, 10), (1, 25), (2, 5), (None, 7)], "k long, t long")
    right = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (1, 20, "c"), (2, 6, "d")], "j long, u long, v string")
    got = as_of(left, right, "t", "u", "k", "j", order="v").collect()
    assert sorted(((r.k or 0, r.t, r.v) for r in got), key=repr) == sorted([(0, 7, None), (1, 10, "a"), (1, 25, "c"), (2, 5, None)], key=repr)
    a = spark.sql("SELECT 1 AS i, TIMESTAMP '2024-01-01 00:00:00' AS lo, TIMESTAMP '2024-01-01 02:00:00' AS hi")
    b = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 00:00:00'), (2, TIMESTAMP '2024-01-01 01:59:59'), (3, TIMESTAMP '2024-01-01 02:00:00') AS t(n, at)")
    assert sorted(r.n for r in within(a, b, "lo", "hi", "at", width=3600).collect()) == [1, 2]


def test_probes_after_changes_read_only_changed_files(db, points):
    table, matrix = points
    copy = db.clone_table("changed", table)
    copy.create_index("vector", "ivf_flat", num_partitions=4)
    copy.create_index("name", "fts")
    copy.update({"name": "other thing"}, where="id = 7")
    copy.delete("id = 8")
    old, new = copy.log.read(copy.indices()["vector_idx"]["version"]), copy.manifest()
    assert {r["_rowid"] for r in copy.vanished(old, new).collect()} == {r["_rowid"] for r in table.scan().filter("id in (7, 8)").collect()}
    assert len(copy.vanished(old, new).inputFiles()) < len(old.files) + len(new.files)
    assert copy.index_stats("vector_idx")["num_indexed_rows"] == 398 and copy.index_stats("vector_idx")["num_unindexed_rows"] == 1
    assert [r["id"] for r in copy.search(matrix[7]).nprobes(4).limit(1).to_list()] == [7] and 8 not in [r["id"] for r in copy.search(matrix[8]).nprobes(4).limit(399).to_list()]
    assert {r["id"] for r in copy.search(fts.MatchQuery("itam", "name", fuzziness=1)).all_matches().to_df().collect()} == set(range(400)) - {7, 8}
    assert [r["id"] for r in copy.search(fts.MatchQuery("thang", "name", fuzziness=1)).all_matches().to_df().collect()] == [7]


def test_index_counts_leave_out_what_it_cannot_hold(db, spark):
    rows = [(0, [1.0, 0.0], "a"), (1, None, None), (2, [float("nan"), 1.0], "b"), (3, [0.0, 1.0], "c")]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("t", T.StringType())])
    table = db.create_table("holes", spark.createDataFrame(rows, schema), schema, on_bad_vectors="keep")
    table.create_index("vector", "ivf_flat", num_partitions=1)
    table.create_index("t", "fts")
    assert table.index_stats("vector_idx")["num_indexed_rows"] == 2 and table.index_stats("t_idx")["num_indexed_rows"] == 3


def test_kmeans_holds_few_distances(monkeypatch):
    from skerry.operators import index

    rng = np.random.default_rng(3)
    rows = rng.normal(size=(3000, 8)).astype(np.float32)
    whole = kmeans(rows, 300, 5)
    monkeypatch.setattr(index, "STEP_CELLS", 20_000)
    assert np.allclose(whole, kmeans(rows, 300, 5), atol=1e-6)


def test_too_many_partitions(db, points):
    with pytest.raises(ValueError):
        db.clone_table("many", points[0]).create_index("vector", "ivf_flat", num_partitions=1 << 21)


def test_cast_of_numbers_to_integers_cuts(spark):
    frame = spark.createDataFrame([(98.5, 98), (97.5, 97), (-0.5, 0), (-1.5, -1), (-2.9, -2), (None, None)], "x double, want long")
    assert frame.filter(~col("x").cast(int).to_column().eqNullSafe(F.col("want"))).count() == 0


def test_kmeans_on_the_executors(db, points, monkeypatch, spark):
    from skerry.operators import index

    rng = np.random.default_rng(6)
    middle = rng.normal(size=(5, 8)) * 20
    rows = [((c + rng.normal(size=8) * 0.1).astype(np.float32).tolist(),) for c in middle for _ in range(60)]
    frame = spark.createDataFrame(rows, "v array<float>").repartition(3)
    found = index.kmeans_frame(frame, 40, 8)
    assert all(np.sqrt(((found - c) ** 2).sum(axis=1)).min() < 1 for c in middle)
    monkeypatch.setattr(index, "DRIVER_CELLS", 0)
    table, matrix = points
    for metric in ("l2", "cosine"):
        copy = db.clone_table(f"far_{metric}", table)
        copy.create_index("vector", "ivf_pq", num_partitions=6, metric=metric, num_sub_vectors=4, num_bits=6)
        got = [r["id"] for r in copy.search(matrix[3] + 0.1).nprobes(6).refine_factor(20).limit(10).to_list()]
        assert len(set(got) & set(brute(matrix, matrix[3] + 0.1, 10, metric))) >= 9


@pytest.mark.parametrize("spans", [1, 4])
def test_as_of_in_spans(spark, spans):
    import datetime

    rng = np.random.default_rng(8)
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=int(n))
    right = [(i, [1, 1, 1, 2, None][i % 5], day(rng.integers(60, 400))) for i in range(200)] + [(900, 3, day(90)), (901, 1, None)]
    left = [(i, [1, 2, 3, 4, None][i % 5], day(rng.integers(0, 500))) for i in range(150)] + [(700, 1, None)]
    l = spark.createDataFrame(left, "lid long, k long, at timestamp").repartition(3)
    r = spark.createDataFrame(right, "rid long, key long, ts timestamp").repartition(3)
    old = datetime.datetime.min
    want = {(i, max(((ts or old, e) for e, key, ts in right if key == k and (ts or old) <= (at or old)), default=(None, None))[1]) for i, k, at in left}
    got = as_of(l, r, "at", "ts", "k", "key", order="rid", spans=spans)
    assert {(x.lid, x.rid) for x in got.collect()} == want


def test_scalar_indices_narrow_the_scan(db, spark):
    rows = spark.range(3000).selectExpr("id", "id % 50 AS k", "CASE WHEN id % 9 = 0 THEN NULL ELSE concat('name ', id) END AS name", "array(concat('t', id % 40), 'all') AS tags")
    table = db.create_table("scalars", rows.repartition(4))
    plain = db.clone_table("scalars_plain", table)
    for column, kind in (("id", "btree"), ("k", "bitmap"), ("tags", "label_list"), ("name", "fm")):
        table.create_index(column, kind)
    asked = ["id = 77", "id BETWEEN 100 AND 130", "k IN (3, 4)", "name IS NULL", col("tags").to_sql() + " IS NOT NULL", "array_contains(tags, 't7')", "contains(name, '123')", "contains(name, 'zz')", "contains(name, '12')", "array_contains(tags, 'all')", "id = 5 OR k = 5", "id < 10 AND k > 3", "id + k = 40"]
    for t in (table, plain):
        t.update({"name": "name 1234567"}, where="id = 2999")
        t.delete("id = 101")
        t.add([{"id": 5000, "k": 3, "name": "new 123", "tags": ["t7"]}])
    both = lambda t, c: sorted(r["id"] for r in t.query().where(c).select(["id"]).to_list())
    assert [(c, both(table, c)) for c in asked] == [(c, both(plain, c)) for c in asked]
    assert both(table, col("name").contains("123")) == both(plain, col("name").contains("123")) != []
    plan = table.query().where("id = 77").to_df()._jdf.queryExecution().optimizedPlan().toString()
    assert "_rowid" in plan and "_updated" in plan.lower()
    table.optimize()
    assert all(both(table, c) == both(plain, c) for c in asked)


def test_prewarm_index(docs):
    assert docs.prewarm_index("text_idx") > 30
    with pytest.raises(ValueError):
        docs.prewarm_index("none")
