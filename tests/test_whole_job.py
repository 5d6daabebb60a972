"""Queries that must take every row, on tables where a subset gives other results."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.queries import QUERIES
from skerry.sources.catalog import connect


def test_as_of_query_takes_every_order(spark, tmp_path):
    at = lambda d: datetime(2020, 1, 1) + timedelta(days=d)
    orders = [(1, 5, at(0)), (2, 100, at(0)), (3, 1499, at(1)), (4, 2000, at(1)), (5, 100, at(-9))]
    events = [(10, 5, at(9499)), (11, 100, at(9500)), (12, 100, at(9500)), (13, 100, at(9501)), (14, 1499, at(9502))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")

    def last(user, due):
        return max(((ts, e) for e, u, ts in events if u == user and ts <= due), default=(None, None))[1]

    want = {(o, last(user, day + timedelta(days=9500))) for o, user, day in orders}
    assert {tuple(r) for r in QUERIES["join_as_of"](spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("name", ["fts_match_all", "fts_boolean", "fts_boost", "fts_phrase", "fts_fuzzy"])
def test_text_queries_have_no_limit(spark, sf, name):
    frame = QUERIES[name](spark, sf)
    assert "10000000" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_all_matches(spark, tmp_path):
    table = connect(spark, str(tmp_path)).create_table("texts", [{"id": i, "text": "red " * (i % 7 + 1) + "fox"} for i in range(40)])
    table.create_index("text", "fts")
    got = table.search("red").all_matches().to_list()
    assert len(got) == 40 and [r["_score"] for r in got] == sorted((r["_score"] for r in got), reverse=True)
    assert len(table.search("red").all_matches().where("id < 25").offset(5).to_list()) == 20
    assert len(table.search("red").all_matches().limit(3).to_list()) == 3
    with pytest.raises(ValueError):
        table.query().all_matches().to_df()


def test_recall_of_default_probes(spark, tmp_path):
    """More partitions (63) than the fixed number once probed."""
    rows = np.random.default_rng(2).normal(size=(4000, 32)).astype(np.float32)
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id long, vector array<float>")
    table = connect(spark, str(tmp_path)).create_table("many", frame)
    table.create_index("vector", "ivf_flat")
    asked = rows[:20].astype(float) + 0.1
    got = {(r["query_index"], r["id"]) for r in table.search(asked.tolist()).limit(10).to_list()}
    want = {(i, int(j)) for i, q in enumerate(asked) for j in np.argsort(((rows - q) ** 2).sum(axis=1))[:10]}
    assert len(got & want) >= 0.9 * len(want)
