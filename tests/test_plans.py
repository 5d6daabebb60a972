"""Views, permutations, context windows, keyed deltas, streams and loaders."""

import datetime
import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.plans.context import contextualize
from skerry.plans.permutation import Permutation, counts_of, numbered, permutation
from skerry.sources.catalog import connect
from skerry.streaming.loader import StreamingDataset
from skerry.streaming.lsm import LsmSpec
from skerry.streaming.sink import write_stream


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    return connect(spark, str(tmp_path_factory.mktemp("db")))


# -- views -----------------------------------------------------------------------------------

STEPS = {
    "append": lambda t: t.add([{"id": 100 + t.version, "score": 10.0 * t.version}, {"id": 200 + t.version, "score": None}]),
    "delete": lambda t: t.delete("id % 3 = 1"),
    "update": lambda t: t.update(values_sql={"score": "score + 7"}, where="id % 2 = 0"),
    "upsert": lambda t: t.merge_insert("id").when_matched_update_all().when_not_matched_insert_all().execute([{"id": 0, "score": 99.0}, {"id": 500, "score": 31.0}]),
    "compact": lambda t: t.compact(),
    "overwrite": lambda t: t.add([{"id": 1, "score": 40.0}], mode="overwrite"),
    "restore": lambda t: t.restore(2),
}
SHAPES = {"plain": ({"id": "id", "twice": "score * 2"}, None), "filtered": ({"id": "id"}, "score > 25"), "all": (None, "id < 300 AND score IS NOT NULL")}


def view_rows(view, table, shape):
    select, where = SHAPES[shape]
    want = table.to_df() if where is None else table.to_df().filter(where)
    want = want.selectExpr(*[f"{e} AS {a}" for a, e in (select or {c: c for c in table.columns}).items()])
    return sorted(map(repr, view.to_df().collect())), sorted(map(repr, want.collect()))


@pytest.mark.parametrize("shape", list(SHAPES))
def test_views_equal_their_query_after_every_change(db, shape):
    """Pairs of changes, a refresh after each: the view is what its query gives."""
    pairs = list(itertools.product(STEPS, STEPS))[{"plain": 0, "filtered": 1, "all": 2}[shape] :: 3]
    for n, (a, b) in enumerate(pairs):
        table = db.create_table(f"s_{shape}_{n}", [{"id": i, "score": 10.0 * i} for i in range(6)])
        view = db.create_view(f"v_{shape}_{n}", table, SHAPES[shape][0], SHAPES[shape][1])
        assert view.count_rows() == 0 and view.refresh().mode == "rebuild"
        for step in (a, b):
            STEPS[step](table)
            mode = view.refresh().mode
            got, want = view_rows(view, table, shape)
            assert got == want, (a, b, step)
            assert mode == ("rebuild" if step in ("overwrite", "restore") else "incremental")
        assert view.refresh().mode == "no_op"


def test_capped_views_and_pins(db):
    table = db.create_table("capped", [{"id": i, "score": 1.0} for i in range(4)])
    view = db.create_view("cap", table, {"id": "id"}, limit=6)
    assert view.refresh().rows_added == 4
    table.add([{"id": i, "score": 1.0} for i in range(4, 9)])
    done = view.refresh()
    assert (done.mode, done.rows_added) == ("incremental", 2)
    table.delete("id = 0")
    assert view.refresh().mode == "rebuild" and view.count_rows() == 6
    assert view.refresh(source_version=2).mode == "rebuild" and view.watermark == 2 and view.count_rows() == 4
    assert view.refresh(full=True).mode == "rebuild" and view.count_rows() == 6


def test_views_are_checked(db):
    table = db.create_table("src", [{"id": 1, "name": "a", "age": 3}])
    bad = [({"x": "id", "X": "age"}, None), ({"x": "rand()"}, None), ({"x": "id"}, "age"), ({"__source_row_id": "id"}, None), ({"x": "id"}, "now() > now()"), ({"x": "nope"}, None)]
    for i, (select, where) in enumerate(bad):
        with pytest.raises(Exception):
            db.create_view(f"bad{i}", table, select, where)
    view = db.create_view("good", "src", ["id", "name"], where="age > 1")
    assert view.definition["inputs"] == ["age", "id", "name"] and "good" in db.list_views() and "src" not in db.list_views()
    assert db.open_view("good").refresh().rows_added == 1
    table.drop_columns(["name"])
    with pytest.raises(ValueError, match="lost"):
        view.refresh()
    with pytest.raises(ValueError):
        db.open_view("src")
    db.drop_view("good")
    assert "good" not in db.list_views()


# -- permutations ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def hundred(db, spark):
    return db.create_table("hundred", spark.range(100).select(F.col("id").alias("x"), (F.col("id") * 2).alias("y")).coalesce(1))


@pytest.mark.parametrize(
    "rows, how, want",
    [(100, {"ratios": [0.7, 0.2, 0.1]}, [70, 20, 10]), (10, {"ratios": [1 / 3, 1 / 3, 1 / 3]}, [4, 3, 3]), (11, {"ratios": [0.5, 0.5]}, [5, 6]), (10, {"ratios": [0.25]}, [3]), (10, {"counts": [4, 5]}, [4, 5]), (10, {"fixed": 3}, [3, 3, 3])],
)
def test_split_sizes(rows, how, want):
    assert counts_of(rows, **how) == want


@pytest.mark.parametrize("how", [{"ratios": [0.7, 0.7]}, {"ratios": [0.001]}, {"ratios": [-0.1]}, {"counts": [11]}, {"counts": [0]}, {"fixed": 11}, {}, {"fixed": 1, "counts": [1]}])
def test_bad_split_sizes(how):
    with pytest.raises(ValueError):
        counts_of(10, **how)


def splits(made):
    out = {}
    for r in made._rows.orderBy("split_id", "position").collect():
        out.setdefault(r.split_id, []).append((r.position, r.row_id))
    return out


def test_random_splits_and_shuffles(hundred):
    build = lambda seed: permutation(hundred).split_random([0.5, 0.3], seed=seed, names=["a", "b"]).build()
    one, again, other = (splits(build(s)) for s in (1, 1, 2))
    assert one == again and one != other and [len(v) for v in one.values()] == [50, 30]
    assert all([p for p, _ in v] == list(range(len(v))) for v in one.values())
    assert len({r for v in one.values() for _, r in v}) == 80
    clumps = [r for _, r in splits(permutation(hundred).shuffle(seed=3, clump_size=10).build())[0]]
    assert sorted(clumps) == list(range(100)) and clumps != list(range(100)) and all(clumps[i] + 9 == clumps[i + 9] for i in range(0, 100, 10))


def test_other_splits(hundred):
    assert {k: [r for _, r in v] for k, v in splits(permutation(hundred).filter("x >= 10").split_sequential(counts=[5, 20]).build()).items()} == {0: list(range(10, 15)), 1: list(range(15, 35))}
    assert [len(v) for v in splits(permutation(hundred).split_calculated("CASE WHEN x < 30 THEN x % 2 END").build()).values()] == [15, 15]
    hashed = splits(permutation(hundred).split_hash(["x"], [3, 1], discard_weight=1).build())
    sizes = [len(v) for v in hashed.values()]
    assert len(sizes) == 2 and 40 < sizes[0] < 80 and sum(sizes) < 100
    assert splits(permutation(hundred).build()) == {0: [(i, i) for i in range(100)]}
    with pytest.raises(ValueError):
        permutation(hundred).split_hash([], [1])


def test_reading_a_permutation(hundred, db, tmp_path):
    path = str(tmp_path / "p")
    permutation(hundred).split_random(counts=[60, 40], seed=4, names=["train", "test"]).build(path)
    p = Permutation.open(hundred, path, "train")
    order = [r.x for r in p.to_df().collect()]
    assert len(p) == 60 and p.split_names == ["train", "test"] and p.splits == [0, 1] and not set(order) & {r.x for r in p.split("test").to_df().collect()}
    assert [r.x for r in p.with_skip(10).with_take(5).to_df().collect()] == order[10:15] and [r.x for r in p.with_take(9).with_skip(4).to_df().collect()] == order[4:9]
    assert [r.x for r in p.take_offsets([3, 0, 3]).collect()] == [order[3], order[0], order[3]] and p[7][0].x == order[7]
    q = p.rename_column("x", "z").remove_columns(["y"])
    assert q.columns == ["z"] and [b["z"] for batch in q.iter(25) for b in batch] == order[:50]
    assert [len(b) for b in q.iter(25, skip_last_batch=False)] == [25, 25, 10]
    assert next(p.with_format("numpy").iter(4))["x"].tolist() == order[:4] and next(p.with_format("pandas").iter(4))["y"].tolist() == [2 * v for v in order[:4]]
    assert next(p.with_transform(lambda b: b.num_rows).iter(30)) == 30 and p.unique("x") == sorted(order)
    assert p.map(lambda it: it, "x long, y long").count() == 60 and [r.x for r in Permutation.identity(hundred).to_df().collect()] == list(range(100))
    hundred_later = db.open_table("hundred")
    hundred_later.delete("x < 50")
    assert len(Permutation.open(hundred_later, path).to_df().collect()) == 60  # pinned to the version it was made from
    hundred_later.restore(2)
    for bad in (lambda: p.split("dev"), lambda: p.select_columns(["q"]), lambda: p.remove_columns(["x", "y"]), lambda: p.with_format("xml"), lambda: p.rename_columns({"q": "r"})):
        with pytest.raises(ValueError):
            bad()


def test_numbering_spans_cells(spark):
    frame = spark.range(300_000).withColumn("h", F.xxhash64("id"))
    got = numbered(frame, "h", 300_000).agg(F.min("position"), F.max("position"), F.countDistinct("position")).first()
    assert tuple(got) == (0, 299_999, 300_000)
    disorder = numbered(frame, "h", 300_000).alias("a").join(numbered(frame, "h", 300_000).alias("b"), F.expr("a.position + 1 = b.position")).filter("a.h > b.h")
    assert disorder.count() == 0


def test_streaming_dataset(hundred):
    p = permutation(hundred).shuffle(seed=1).build()
    order = [r.x for r in p.to_df().collect()]
    shares = [[r["x"] for r in StreamingDataset(p, rank=i, world_size=3, batch_size=7)] for i in range(3)]
    assert shares == [order[i::3] for i in range(3)] and len(StreamingDataset(p, rank=0, world_size=3)) == 34
    first = StreamingDataset(p, batch_size=10)
    seen = list(itertools.islice(iter(first), 25))
    resumed = StreamingDataset(p, batch_size=10)
    resumed.load_state_dict(first.state_dict())
    assert [r["x"] for r in seen + list(resumed)] == order
    two = [StreamingDataset(p, worker=i, workers=2) for i in range(2)]
    for d in two:
        d.load_state_dict(first.state_dict())
    assert Counter(r["x"] for d in two for r in d) == Counter(order[25:]) and [r.x for r in two[1].frame().collect()] == order[26::2]

    def fussy(row):
        if row["x"] % 10 == 0:
            raise ValueError("no")
        return row["x"]

    assert len(list(StreamingDataset(p, transform=fussy, on_error="skip"))) == 90
    with pytest.warns(UserWarning):
        list(StreamingDataset(p, transform=fussy, on_error="warn"))
    with pytest.raises(ValueError):
        list(StreamingDataset(p, transform=fussy))
    with pytest.raises(ValueError):
        StreamingDataset(p, rank=2, world_size=2)


# -- context windows -------------------------------------------------------------------------


def test_context_windows(spark):
    tokens = "The quick brown fox jumped over the lazy dog I love sandwiches".split()
    frame = spark.createDataFrame([(t, 1 if i < 9 else 2, i) for i, t in enumerate(tokens)], "token string, doc long, pos int")
    texts = lambda c: [r.token for r in c.text_column("token").to_df().orderBy("pos").collect()]
    assert texts(contextualize(frame, "pos").window(3).stride(1))[:2] == ["The quick brown", "quick brown fox"] and texts(contextualize(frame, "pos").window(3).stride(1))[-1] == "love sandwiches"
    assert texts(contextualize(frame, "pos").window(7).stride(1).min_window_size(7))[-1] == "over the lazy dog I love sandwiches"
    assert texts(contextualize(frame, "pos").window(6).stride(3).group_by("doc")) == ["The quick brown fox jumped over", "fox jumped over the lazy dog", "the lazy dog", "I love sandwiches"]
    for bad in (lambda: contextualize(frame, "pos").window(3).stride(1).text_column("no").to_df(), lambda: contextualize(frame, "pos").stride(1).text_column("token").to_df(), lambda: contextualize(frame, "pos").window(2).stride(0).text_column("token").to_df()):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("groups", [(), ("doc",)])
@pytest.mark.parametrize("window, stride, least", [(5, 2, 2), (3, 4, 3), (4, 4, 1), (1, 1, 1)])
def test_context_windows_in_cells(spark, groups, window, stride, least):
    rows = [(f"t{i}" if i % 11 else None, None if i % 3 == 2 else i % 3, i) for i in range(157)]
    frame = spark.createDataFrame(rows, "token string, doc long, pos int").repartition(5)
    asked = contextualize(frame, "pos").window(window).stride(stride).group_by(*groups).min_window_size(least).text_column("token")
    plain, cells = (sorted(map(str, asked.to_df(n).collect())) for n in (1000, 20))
    assert plain == cells and len(plain) > 20


# -- keyed deltas and streams ----------------------------------------------------------------


@pytest.mark.parametrize("spec", [LsmSpec(), LsmSpec("bucket", "id", 3), LsmSpec("identity", "region")])
def test_keyed_deltas(db, spec):
    table = db.create_table(f"lsm_{spec.kind}", [{"id": i, "value": i, "region": "ab"[i % 2], "v": [float(i), 0.0], "text": f"word{i}"} for i in range(5)])
    with pytest.raises(ValueError):
        table.lsm(spec)
    table.set_primary_key("id")
    tier = table.lsm(spec)
    row = lambda i, value: {"id": i, "value": value, "region": "a", "v": [float(value), 0.0], "text": f"word{value}"}
    assert (tier.upsert([row(1, 10), row(7, 70)]), tier.upsert([row(1, 11)])) == (1, 2)
    newest = {r.id: r.value for r in tier.to_df().collect()}
    assert newest == {0: 0, 1: 11, 2: 2, 3: 3, 4: 4, 7: 70} and table.count_rows() == 5
    assert [r.id for r in tier.nearest([11.0, 0.0], k=1, column="v").collect()] == [1] and [r.id for r in tier.search_text("word70", "text").collect()] == [7]
    assert tier.stats()["generations"] == 2 and tier.stats()["keys"] == 2
    tier.checkpoint()
    assert {r.id: r.value for r in table.checkout_latest().to_df().collect()} == newest and tier.stats()["generations"] == 0 and tier.upsert([row(9, 9)]) == 3
    for bad in ([row(1, 1), row(1, 2)], [{**row(1, 1), "id": None}]):
        with pytest.raises(ValueError):
            tier.upsert(bad)
    with pytest.raises(ValueError):
        table.lsm(LsmSpec("bucket", "value", 2))


def test_keyed_deltas_over_an_indexed_base(db):
    rows = [{"id": i, "v": [float(i), float(i % 7)]} for i in range(300)]
    table = db.create_table("lsm_indexed", rows)
    table.set_primary_key("id")
    table.create_index("v", "ivf_flat", num_partitions=4)
    tier = table.lsm(LsmSpec())
    found = lambda k: [r.id for r in tier.nearest([50.0, 1.0], k=k, column="v").collect()]
    held = {r["id"]: r["v"] for r in rows}
    brute = lambda k: sorted(held, key=lambda i: ((held[i][0] - 50) ** 2 + (held[i][1] - 1) ** 2, i))[:k]
    assert found(5) == brute(5)
    moved = [{"id": i, "v": [1000.0 + i, 0.0]} for i in range(45, 56)] + [{"id": 900, "v": [50.0, 1.5]}]
    tier.upsert(moved)
    held |= {r["id"]: r["v"] for r in moved}
    assert found(5) == brute(5) and 900 in found(5)


def test_lsm_specs_are_checked():
    for bad in (("bucket", "id", 0), ("bucket", "id", 1025), ("identity", None, 1), ("other", "x", 1)):
        with pytest.raises(ValueError):
            LsmSpec(*bad)


@pytest.mark.parametrize("mode", ["append", "upsert", "lsm"])
def test_streams_write_once(db, spark, tmp_path, mode):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "check")
    schema = T.StructType.fromDDL("id long, value long")
    table = db.create_empty_table(f"stream_{mode}", schema)
    table.set_primary_key("id")
    for batch in range(3):
        spark.range(batch * 5, batch * 5 + 8).select("id", F.lit(batch).cast("long").alias("value")).coalesce(1).write.mode("append").parquet(source)
        write_stream(spark.readStream.schema(schema).parquet(source), table, checkpoint, mode, on="id").awaitTermination()
    table.checkout_latest()
    got = {r.id: r.value for r in (table.lsm().to_df() if mode == "lsm" else table.to_df()).collect()}
    if mode == "append":
        assert table.count_rows() == 24
    else:
        assert got == {i: min(2, i // 5) for i in range(18)}
    with pytest.raises(ValueError):
        write_stream(None, table, checkpoint, "other")


def test_buckets_agree_with_other_writers(spark):
    from skerry.functions.hashing import bucket, murmur3

    assert murmur3((34).to_bytes(8, "little")) == 2017239379 and murmur3(b"iceberg") == 1210000089
    frame = spark.createDataFrame([(34, "iceberg", datetime.date(2017, 11, 16)), (-5, "", None), (None, None, None)], "n long, s string, d date")
    got = [tuple(r) for r in frame.select(bucket(F.col("n"), T.LongType(), 1000), bucket(F.col("s"), T.StringType(), 1000), bucket(F.col("d"), T.DateType(), 1000)).collect()]
    want = lambda b: (murmur3(b) & 0x7FFFFFFF) % 1000
    assert got == [(want((34).to_bytes(8, "little")), want(b"iceberg"), want((17486).to_bytes(8, "little"))), (want((2**64 - 5).to_bytes(8, "little")), want(b""), None), (None, None, None)]
    with pytest.raises(ValueError):
        bucket(F.col("n"), T.DoubleType(), 4)
