"""Tables, versions, writes, schema changes and ingest."""

import datetime
import decimal
import io
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.functions.expr import Expr, col, func, lit
from skerry.sources import ingest
from skerry.sources.catalog import connect
from skerry.sources.table import next_row_id
from skerry.sources.snapshot import DataFile


@pytest.fixture
def db(spark, tmp_path):
    return connect(spark, str(tmp_path / "db"))


def rows(table, *columns):
    return sorted(tuple(r) for r in table.to_df().select(*columns).collect())


def people(db, name="people"):
    return db.create_table(name, [{"id": i, "name": n, "age": a} for i, (n, a) in enumerate([("Ann", 31), ("Bob", 45), ("Cyd", 27), ("Dan", None)])])


# -- ingest ----------------------------------------------------------------------------------


def test_sources(spark, db):
    want = [(1, "a"), (2, "b")]
    arrow = pa.table({"x": [1, 2], "y": ["a", "b"]})

    @dataclass
    class Row:
        x: int
        y: str | None

    sources = [
        [{"x": 1, "y": "a"}, {"x": 2, "y": "b"}], pd.DataFrame({"x": [1, 2], "y": ["a", "b"]}, index=[7, 8]), arrow, arrow.to_batches()[0], arrow.to_reader(), pa.dataset.dataset(arrow),
        spark.createDataFrame(want, "x long, y string"), (b for b in arrow.to_batches(1)), [Row(1, "a"), Row(2, "b")],
    ]
    for i, source in enumerate(sources):
        assert rows(db.create_table(f"t{i}", source), "x", "y") == want
    both = db.create_table("splits", {"train": arrow.slice(0, 1), "test": arrow.slice(1)})
    assert rows(both, "x", "split") == [(1, "train"), (2, "test")]
    for bad in ({"x": 1}, iter([]), []):
        with pytest.raises(ValueError):
            db.create_table("bad", bad)
    with pytest.raises(TypeError):
        ingest.to_frame(spark, 3)


def test_ipc_round_trip(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "x long, v array<float>")
    assert ingest.from_ipc(spark, ingest.to_ipc(frame)).collect() == frame.collect()


def test_schema_of_a_model(spark, db):
    @dataclass
    class Inner:
        a: int

    @dataclass
    class Item:
        id: int
        tags: list[str]
        when: datetime.date
        inner: Inner
        price: float | None = None

    schema = ingest.model_schema(Item)
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in schema] == [("id", "bigint", False), ("tags", "array<string>", False), ("when", "date", False), ("inner", "struct<a:bigint>", False), ("price", "double", True)]
    assert db.create_empty_table("items", Item).count_rows() == 0


def test_subset_and_nested_casts(db):
    table = db.create_table("t", [{"id": 1, "s": {"a": 1, "b": "x"}, "n": 1.5}])
    table.add([{"id": 2, "s": {"a": 7}}])
    assert [tuple(r) for r in table.to_df().orderBy("id").select("id", "s.a", "s.b", "n").collect()] == [(1, 1, "x", 1.5), (2, 7, None, None)]
    with pytest.raises(ValueError, match="doesn't have"):
        table.add([{"id": 3, "other": 1}])


@pytest.mark.parametrize("policy, want", [("drop", [1]), ("null", [1, None, None, None]), ("fill", [1, 2, 3, 4])])
def test_bad_vectors(db, policy, want):
    data = [{"id": 1, "vector": [1.0, 2.0]}, {"id": 2, "vector": [1.0]}, {"id": 3, "vector": [float("nan"), 1.0]}, {"id": 4, "vector": [1.0, 2.0, 3.0]}]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType()), True, {"dim": 2})])
    table = db.create_table("v", data, schema, on_bad_vectors=policy, fill_value=9.0)
    got = {r.id: r.vector for r in table.to_df().collect()}
    if policy == "fill":
        assert got == {1: [1, 2], 2: [1, 9], 3: [9, 1], 4: [1, 2]}
    else:
        assert [i if got.get(i) else None for i in sorted(got)] == want
    with pytest.raises(Exception, match="bad vector"):
        table.add(data)


def test_vector_dimension_is_inferred(db):
    fixed = pa.table({"e": pa.array([[1.0, 2.0, 3.0]], pa.list_(pa.float32(), 3))})
    assert db.create_table("a", fixed).schema["e"].metadata["dim"] == 3
    assert db.create_table("b", [{"vector": [1.0, 2.0]}]).schema["vector"].metadata["dim"] == 2


def test_flatten_and_collectors(db):
    table = db.create_table("f", [{"a": {"legs": 4, "b": {"c": 1}}, "m": 1}])
    assert list(table.to_pandas(flatten=True).columns) == ["a.b.c", "a.legs", "m"] or set(table.to_pandas(flatten=True).columns) == {"a.legs", "a.b.c", "m"}
    assert set(table.to_pandas(flatten=1).columns) == {"a.legs", "a.b", "m"}
    assert table.to_arrow().num_rows == 1 and table.head(1).count() == 1 and len(table) == 1


def test_write_partitions():
    assert ingest.write_partitions(10, 100, 8) == 1 and ingest.write_partitions(3_000_001, 100, 8) == 4 and ingest.write_partitions(10, 5 << 30, 2) == 2


# -- databases -------------------------------------------------------------------------------


def test_names_and_modes(db):
    for n in ("b", "a", "c"):
        people(db, n)
    assert db.table_names() == ["a", "b", "c"] and db.table_names("a", 1) == ["b"]
    with pytest.raises(ValueError):
        people(db, "a")
    assert db.create_table("a", schema=db.open_table("a").schema, exist_ok=True).count_rows() == 4
    assert db.create_table("a", [{"z": 1}], mode="overwrite").columns == ["z"]
    db.rename_table("b", "d")
    assert db.table_names() == ["a", "c", "d"] and db.open_table("d").count_rows("age > 30") == 2
    db.drop_table("d")
    db.drop_table("d", ignore_missing=True)
    with pytest.raises(ValueError):
        db.open_table("d")
    with pytest.raises(ValueError):
        db.create_table("../x", [{"z": 1}])
    db.drop_all_tables()
    assert db.table_names() == []


def test_namespaces(db):
    db.create_namespace(["n"])
    db.create_namespace(["n", "m"])
    db.create_table("t", [{"x": 1}], namespace=["n", "m"])
    assert db.list_namespaces() == ["n"] and db.describe_namespace(["n"])["namespaces"] == ["m"] and db.describe_namespace(["n", "m"])["tables"] == ["t"]
    with pytest.raises(ValueError):
        db.drop_namespace(["n"])
    with pytest.raises(ValueError):
        db.create_namespace(["q", "r"])
    db.drop_namespace(["n"], cascade=True)
    assert db.list_namespaces() == []


def test_clones_share_files_and_diverge(db):
    table = people(db)
    clone = db.clone_table("copy", table)
    clone.delete("id = 0")
    assert (table.count_rows(), clone.count_rows()) == (4, 3)
    with pytest.raises(NotImplementedError):
        db.clone_table("deep", table, is_shallow=False)


# -- writes ----------------------------------------------------------------------------------


def test_row_ids_are_unique_and_stable(db, spark):
    table = db.create_table("t", spark.range(100).repartition(5))
    table.add(spark.range(100, 150).repartition(3))
    before = {r.id: r._rowid for r in table.to_df(row_ids=True).collect()}
    assert len(set(before.values())) == 150
    table.update(values_sql={"id": "id + 1000"}, where="id < 10")
    table.compact()
    after = {r.id: r._rowid for r in table.to_df(row_ids=True).collect()}
    assert all(after[i + 1000 if i < 10 else i] == r for i, r in before.items())
    assert next_row_id(5, [DataFile("x/part-00002-a.parquet", 4, 1), DataFile("x/part-00000-a.parquet", 9, 1)]) == 5 + (2 << 33) + 4


def test_delete_update(db):
    table = people(db)
    assert table.delete("false").deleted == 0 and table.version == 3
    done = table.update({"name": "it's"}, where=col("age") > 30)
    assert done.updated == 2 and rows(table, "id", "name")[0] == (0, "it's")
    table.update(values_sql={"age": "age + 1", "id": "age"}, where="id = 2")  # both read the old row
    assert (27, 28) in rows(table.query().where("age is not null"), "id", "age")
    assert table.delete("age > 40").deleted == 1 and table.count_rows() == 3  # a null age stays
    with pytest.raises(ValueError):
        table.update({})
    with pytest.raises(ValueError):
        table.update({"nothing": 1})


@pytest.mark.parametrize("kind, value", [("int", 7), ("long", 1 << 40), ("string", "o'k\\"), ("float", 1.5), ("double", -2.25), ("boolean", True), ("date", datetime.date(2024, 2, 29)), ("timestamp", datetime.datetime(2024, 2, 29, 1, 2, 3)), ("decimal(10,2)", decimal.Decimal("12.34")), ("binary", b"\x00\xff"), ("array<float>", [1.0, 2.5]), ("string", None)])
def test_update_values_of_every_type(db, spark, kind, value):
    table = db.create_table("t", spark.sql(f"SELECT 1 AS id, CAST(NULL AS {kind}) AS x"))
    table.update({"x": value})
    got = table.to_df().first().x
    assert (bytes(got) if isinstance(got, bytearray) else got) == value


def test_merge_insert_upsert(db):
    table = db.create_table("users", [{"id": 0, "name": "Alice"}, {"id": 1, "name": "Bob"}])
    done = table.merge_insert("id").when_matched_update_all().when_not_matched_insert_all().execute([{"id": 1, "name": "Bobby"}, {"id": 2, "name": "Charlie"}])
    assert (done.inserted, done.updated, done.deleted, done.rows) == (1, 1, 0, 2)
    assert rows(table, "id", "name") == [(0, "Alice"), (1, "Bobby"), (2, "Charlie")]


def test_merge_insert_clauses(db):
    table = db.create_table("t", [{"i": i, "age": 10 * i} for i in range(6)])
    new = [{"i": i, "age": 25} for i in range(3, 9)]
    done = table.merge_insert("i").when_matched_update_all("target.age > source.age").when_not_matched_by_source_delete("target.i < 2").execute(new)
    assert (done.inserted, done.updated, done.deleted) == (0, 3, 2)
    assert rows(table, "i", "age") == [(2, 20), (3, 25), (4, 25), (5, 25)]
    done = table.merge_insert("i").when_not_matched_insert_all().execute([{"i": 2, "age": 0}, {"i": None, "age": 1}, {"i": None, "age": 1}])
    assert done.inserted == 2 and table.count_rows() == 6
    with pytest.raises(ValueError, match="share a key"):
        table.merge_insert("i").when_matched_update_all().execute([{"i": 2, "age": 0}, {"i": 2, "age": 1}])
    with pytest.raises(ValueError, match="when_"):
        table.merge_insert("i").execute(new)
    partial = db.create_table("p", [{"k": 1, "a": 1, "b": 1}])
    partial.merge_insert("k").when_matched_update_all().when_not_matched_insert_all().execute([{"k": 1, "a": 5}, {"k": 2, "a": 6}])
    assert rows(partial, "k", "a") == [(1, 5), (2, 6)] and {r.k: r.b for r in partial.to_df().collect()} == {1: 1, 2: None}


def test_only_touched_files_are_rewritten(db, spark):
    table = db.create_table("t", spark.range(0, 100, 1, 4))
    before = {f.path for f in table.manifest().files}
    table.delete("id = 5")
    table.merge_insert("id").when_matched_update_all().execute(spark.range(99, 100))
    assert len(before & {f.path for f in table.manifest().files}) == 2


def test_concurrent_writers(db, spark):
    table = db.create_table("t", spark.range(3))
    other = db.open_table("t")
    create = table.log.create

    def late(manifest):
        table.log.create = create
        other.add(spark.range(10, 12))  # takes the version this commit wants
        return create(manifest)

    table.log.create = late
    table.add(spark.range(20, 22))
    ids = table.checkout_latest().to_df(row_ids=True).collect()
    assert sorted(r.id for r in ids) == [0, 1, 2, 10, 11, 20, 21] and len({r._rowid for r in ids}) == 7


# -- versions --------------------------------------------------------------------------------


def test_versions_tags_restore(db):
    table = people(db)
    table.add([{"id": 9, "name": "Eve", "age": 1}])
    assert [v["op"] for v in table.list_versions()] == ["create", "append", "append"]
    table.create_tag("now")
    table.delete("id > 0")
    table.checkout("now")
    assert table.count_rows() == 5
    with pytest.raises(ValueError, match="read-only"):
        table.delete("true")
    table.restore()
    assert table.count_rows() == 5 and table.version == 5
    table.update_tag("now", 2)
    assert db.open_table("people", "now").count_rows() == 4
    table.delete_tag("now")
    for bad in (lambda: table.delete_tag("now"), lambda: table.checkout("now"), lambda: table.checkout(99), lambda: table.update_tag("now")):
        with pytest.raises(ValueError):
            bad()


def test_branches(db):
    table = people(db)
    side = table.create_branch("side")
    side.update({"name": "Zed"}, where="id = 1")
    side.add([{"id": 50, "name": "New", "age": 5}])
    side.delete("id = 2")
    assert table.count_rows() == 4 and side.count_rows() == 4 and table.branches() == ["main", "side"]
    changes = {r["_change"]: r["row"]["id"] for r in table.diff("side").collect()}
    assert changes == {"changed": 1, "only_there": 50, "only_here": 2}
    done = table.cherry_pick("side", side.version - 2)
    assert (done.inserted, done.updated, done.deleted) == (0, 1, 0) and (1, "Zed") in rows(table, "id", "name")
    table.delete_branch("side")
    with pytest.raises(ValueError):
        table.checkout_branch("side")


def test_freshness(db):
    people(db)
    lazy, strong = connect(db.spark, db.uri, freshness=None).open_table("people"), db.open_table("people")
    assert lazy.count_rows() == 4
    strong.delete("id = 0")
    assert lazy.count_rows() == 4 and strong.count_rows() == 3 and lazy.checkout_latest().count_rows() == 3


def test_cleanup_keeps_what_is_named(db, spark):
    table = db.create_table("t", spark.range(10))
    table.create_tag("first")
    for i in range(3):
        table.delete(f"id = {i}")
    assert table.cleanup_old_versions(older_than=0.0)["versions"] == 3
    assert table.log.versions() == [2, 5] and db.open_table("t", "first").count_rows() == 10 and table.count_rows() == 7


def test_compaction(db, spark):
    table = db.create_table("t", spark.range(0, 100, 1, 8))
    assert table.stats()["num_fragments"] == 8
    table.compact()
    s = table.stats()
    assert (s["num_fragments"], s["num_rows"], s["lengths"]["p50"]) == (1, 100, 100)


# -- schema ----------------------------------------------------------------------------------


def test_schema_changes(db):
    table = people(db)
    table.add_columns({"twice": "age * 2"})
    table.add_columns([T.StructField("note", T.StringType())])
    table.add_columns((lambda b: pa.RecordBatch.from_arrays([pa.compute.utf8_upper(b.column("name"))], names=["loud"]), "loud string"))
    assert {(r.id, r.twice, r.note, r.loud) for r in table.to_df().collect()} == {(0, 62, None, "ANN"), (1, 90, None, "BOB"), (2, 54, None, "CYD"), (3, None, None, "DAN")}
    table.alter_columns({"path": "name", "rename": "label"}, {"path": "age", "data_type": "string"})
    table.add([{"id": 7, "label": "Gus", "age": "1"}])
    assert (7, "Gus") in rows(table, "id", "label") and (0, "Ann") in rows(table, "id", "label")
    table.drop_columns(["twice"])
    table.add_columns([T.StructField("twice", T.LongType()), T.StructField("name", T.StringType())])  # names used before hold nothing of the past
    assert table.count_rows("twice is not null or name is not null") == 0
    with pytest.raises(ValueError):
        table.alter_columns({"path": "age", "nullable": False})
    for bad in (lambda: table.add_columns({"label": "1"}), lambda: table.drop_columns(["gone"]), lambda: table.alter_columns({"path": "id", "rename": "label"}), lambda: table.add_columns({"_rowid": "1"})):
        with pytest.raises(ValueError):
            bad()


def test_field_metadata_and_primary_key(db):
    table = people(db)
    table.update_field_metadata("name", {"a": "1", "b": "2"})
    table.update_field_metadata("name", {"a": None, "c": "3"})
    assert table.schema["name"].metadata == {"b": "2", "c": "3"}
    table.update_field_metadata("name", {"z": "0"}, mode="replace")
    assert table.schema["name"].metadata == {"z": "0"}
    with pytest.raises(ValueError):
        table.set_primary_key(["id", "name"])
    table.set_primary_key("id")
    assert table.primary_key == "id"
    with pytest.raises(ValueError):
        table.set_primary_key("id")


def test_merge_columns_by_key(db):
    table = people(db)
    table.merge([{"key": 0, "city": "Rome"}, {"key": 2, "city": "Oslo"}], "id", "key")
    assert {r.id: r.city for r in table.to_df().collect()} == {0: "Rome", 1: None, 2: "Oslo", 3: None}
    with pytest.raises(ValueError):
        table.merge([{"id": 0, "q": 1}, {"id": 0, "q": 2}], "id")


def test_computed_columns(db):
    table = people(db)
    table.add_computed_column("next", "age + 1")
    assert table.count_rows("next is not null") == 0
    assert table.refresh().updated == 3 and table.refresh().updated == 0
    table.add([{"id": 8, "name": "H", "age": 1}])
    assert table.refresh(["next"]).updated == 1 and (1, 2) in rows(table.query().where("age is not null"), "age", "next")
    for bad in ("rand()", "current_date()", "now()", "uuid()"):
        with pytest.raises(ValueError):
            table.add_computed_column("bad", bad)
    for bad in (lambda: table.drop_columns(["age"]), lambda: table.update({"next": 1}), lambda: table.add([{"id": 1, "next": 2}]), lambda: table.alter_columns({"path": "age", "rename": "old"}), lambda: table.add_computed_column("more", "next * 2"), lambda: table.refresh(["age"])):
        with pytest.raises(ValueError):
            bad()


# -- rows by place, payloads -----------------------------------------------------------------


def test_take(db, spark):
    table = db.create_table("t", spark.range(0, 50, 1, 3).withColumn("x", F.col("id") * 2))
    ids = [r._rowid for r in table.to_df(row_ids=True).orderBy("_rowid").collect()]
    order = [r.id for r in table.scan().orderBy("_rowid").collect()]
    assert [r.id for r in table.take_row_ids([ids[7], ids[3], ids[7], -5]).collect()] == [order[7], order[3], order[7]]
    assert [r.id for r in table.take_offsets([4, 49, 0, 4, 99]).collect()] == [order[4], order[49], order[0], order[4]]
    assert table[-1].first().id == order[-1] and [r.id for r in table[10:14:2].collect()] == [order[10], order[12]]
    with pytest.raises(ValueError):
        table.take_offsets([-1])


def test_blobs(db):
    table = db.create_table("b", [{"id": 0, "blob": b"hello world"}, {"id": 1, "blob": None}, {"id": 2, "blob": bytes(range(256))}])
    ids = {r.id: r._rowid for r in table.to_df(row_ids=True).collect()}
    assert table.fetch_blobs("blob", [ids[2], ids[1], ids[0], 12345]) == [bytes(range(256)), None, b"hello world", None]
    assert table.fetch_blobs("blob", [ids[0], ids[2]], [(6, 3), (250, 100)]) == [b"wor", bytes(range(250, 256))]
    with table.open_blob("blob", ids[0]) as f:
        assert f.read(5) == b"hello" and f.seek(-5, io.SEEK_END) == 6 and f.read() == b"world" and f.read_range(1, 2) == b"el"
    with pytest.raises(ValueError):
        table.open_blob("blob", ids[1])


# -- expressions -----------------------------------------------------------------------------


@pytest.mark.parametrize(
    "e, sql",
    [
        (col("a") + 1, "(a + 1)"), (2 - col("a"), "(2 - a)"), ((col("a") > 1) & ~(col("b") == "x"), "((a > 1) AND (NOT (b = 'x')))"), (col("Age Now").is_null(), "(`Age Now` IS NULL)"), (col("a").isin([]), "FALSE"),
        (col("a").isin([1, "q"]), "(a IN (1, 'q'))"), (col("s").lower().contains("z"), "contains(lower(s), 'z')"), (lit(b"\x01\xff"), "X'01FF'"), (lit(decimal.Decimal("0.123456789012345678")), "0.123456789012345678BD"),
        (lit(datetime.date(2024, 1, 2)), "DATE '2024-01-02'"), (col("a").cast(str), "CAST(a AS string)"), (func("array_contains_all", col("t"), [1, 2]), "forall(array(1, 2), x -> array_contains(t, x))"), (lit(True) | col("b"), "(TRUE OR b)"),
    ],
)
def test_expression_text(e, sql):
    assert e.to_sql() == sql


def test_expressions_are_guarded():
    with pytest.raises(ValueError):
        func("drop_everything", 1)
    with pytest.raises(TypeError):
        bool(col("a") == 1)
    with pytest.raises(TypeError):
        lit(object())


def test_decimals_compare_exactly(db, spark):
    table = db.create_table("d", spark.sql("SELECT CAST('0.123456789012345678' AS DECIMAL(19,18)) AS val UNION ALL SELECT CAST('0.123456789012345679' AS DECIMAL(19,18))"))
    assert table.count_rows(col("val") == decimal.Decimal("0.123456789012345678")) == 1
    assert table.count_rows(Expr("val").is_not_null()) == 2


def test_empty_tables(db):
    table = db.create_empty_table("e", T.StructType([T.StructField("id", T.LongType()), T.StructField("s", T.StringType())]))
    assert table.count_rows() == 0 and table.to_df().collect() == [] and table.delete("true").deleted == 0 and table.update({"s": "x"}).updated == 0
    assert table.merge_insert("id").when_not_matched_insert_all().execute([{"id": 1, "s": "a"}]).inserted == 1
    assert np.array(table.to_pandas()["id"]).tolist() == [1]


def test_changes_since_a_version(db):
    table = people(db)
    start = table.version
    table.delete("id = 0")
    table.update({"name": "Bo"}, where="id = 1")
    table.add([{"id": 9, "name": "Eve", "age": 1}])
    table.update({"name": "Eva"}, where="id = 9")
    got = {(r["_change"], r.id, r.name) for r in table.changes(start).collect()}
    assert got == {("deleted", 0, "Ann"), ("updated", 1, "Bo"), ("inserted", 9, "Eva")}
    assert table.changes(table.version).count() == 0 and {r["_change"] for r in table.changes(start, start + 1).collect()} == {"deleted"}


def test_function_columns(db):
    from skerry.functions.registry import udf

    @udf(returns="low long, high long", name="span_of")
    def spread(x: int):
        return {"low": x - 1, "high": x + 1}

    table = people(db)
    table.add_function_columns(spread.rename(low="least"), ["age"], ["under", "over"])
    assert table.refresh().updated == 3 and table.refresh().updated == 0 and {(r.under, r.over) for r in table.to_df().collect()} == {(30, 32), (44, 46), (26, 28), (None, None)}
    with pytest.raises(ValueError):
        table.add_function_columns(spread, ["age"], ["one"])
    with pytest.raises(ValueError):
        table.drop_columns(["age"])


def test_sql_insert_and_merge_extras(db):
    people(db)
    db.create_table("more", [{"a": 8, "b": "Hal", "c": 2}])
    assert db.sql("INSERT INTO people SELECT * FROM more").first().inserted == 1 and db.open_table("people").count_rows() == 5
    db.sql("insert overwrite table people select a, b, c from more")
    assert db.open_table("people").count_rows() == 1
    with pytest.raises(ValueError):
        db.sql("INSERT INTO people SELECT a FROM more")
    done = db.open_table("people").merge_insert("id").when_not_matched_insert_all().use_index(False).timeout(5).execute([{"id": 1, "name": "x", "age": 1}])
    assert done.attempts == 1 and func("arrow_cast", col("age"), "Utf8").to_sql() == "CAST(age AS string)"


def test_tokenize_by_index(db):
    table = people(db)
    table.create_index("name", "fts", stem=False)
    assert table.tokenize("The Foxes") == ["foxes"] and table.tokenize("The Foxes", stem=True, remove_stop_words=False) == ["the", "fox"] and table.tokenize("A-b", "name") == ["b"]
    assert table.list_indices() == [{"name": "name_idx", "kind": "fts", "columns": ["name"]}]
    with pytest.raises(ValueError):
        table.tokenize("x", "age")


def test_other_engines_read_an_arrow_dataset(db, spark):
    import duckdb

    table = db.create_table("t", spark.range(1000).selectExpr("id", "id % 7 AS k", "array(cast(id AS float)) AS v").repartition(3))
    table.delete("id >= 900")
    found = table.to_arrow_dataset()
    assert found.count_rows() == 900 and found.schema.names == ["id", "k", "v"]
    assert duckdb.sql("SELECT count(*), sum(id) FROM found WHERE k = 3").fetchall() == [(129, sum(i for i in range(900) if i % 7 == 3))]
    table.alter_columns({"path": "k", "rename": "kind"})
    renamed = table.to_arrow_dataset()
    assert duckdb.sql("SELECT count(*) FROM renamed WHERE kind = 3").fetchall() == [(129,)]


def test_progress_while_a_write_runs(db, spark):
    table, said = db.create_empty_table("slow", T.StructType([T.StructField("id", T.LongType())])), []

    def slowly(batches):
        import time

        for b in batches:
            time.sleep(0.5)
            yield b

    table.add(spark.range(0, 40, 1, 8).mapInArrow(slowly, "id long"), progress=said.append)
    assert len(said) > 1 and not said[0]["done"] and any(s["active_tasks"] for s in said[:-1]) and all(s["total_tasks"] >= s["active_tasks"] for s in said)
    assert said[-1]["done"] and said[-1]["rows"] == 40 and said[-1]["active_tasks"] == 0


def test_io_counters_grow(db, spark):
    before = db.io_stats()
    table = db.create_table("t", spark.range(50_000).selectExpr("id", "md5(cast(id AS string)) AS t"))
    assert table.to_df().filter("t < 'a'").count() > 0
    after = db.io_stats()
    assert after["input_bytes"] > before["input_bytes"] and set(after) == set(before) and all(after[k] >= before[k] for k in after)
