"""How an inverted index is built: in bounded chunks, each task its own texts."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skerry.functions.text import Tokenizer
from skerry.operators import fts
from skerry.queries import PLAIN, QUERIES
from skerry.sources.catalog import connect

TEXTS = [["b", "a", "b"], [], ["c"] * 5, ["a"], ["b", "c"], ["a", "d", "a", "d"], []]


def _batches():
    for at in (slice(0, 4), slice(4, 4), slice(4, 7)):
        ids = list(range(len(TEXTS)))[at]
        yield pa.RecordBatch.from_arrays([pa.array([10 * i for i in ids], pa.int64()), pa.array(TEXTS[at], pa.list_(pa.string()))], names=["_rowid", "tokens"])


@pytest.mark.parametrize("chunk", [1, 4, 6, 1000])
def test_chunks_hold_few_tokens_and_all_postings(chunk):
    want = sorted((10 * i, t, text.count(t), len(text), [p for p, x in enumerate(text) if x == t]) for i, text in enumerate(TEXTS) for t in set(text))
    blocks = [b.to_pylist() for b in fts._blocked(_batches(), chunk)]
    got = sorted((p[0], r["term"], *p[1:]) for b in blocks for r in b if r["term"] is not None for p in zip(r["rows"], r["tfs"], r["dls"], r["positions"], strict=True))
    assert got == want
    for b in blocks:
        terms = [r["term"] for r in b[:-1]]
        assert terms == sorted(set(terms)) and b[-1]["term"] is None
        assert all(r["n"] == len(r["rows"]) and r["tokens"] == sum(r["tfs"]) for r in b[:-1])
        assert b[-1]["tokens"] == sum(r["tokens"] for r in b[:-1]) < chunk + 5  # the longest text has 5
    assert sum(b[-1]["n"] for b in blocks) == len(TEXTS)
    grouped = [b.to_pylist() for b in fts._grouped(_batches(), ["a", "c"], chunk)]
    assert sorted(tuple(r.values()) for b in grouped for r in b) == [w for w in want if w[1] in "ac"]
    assert len(grouped) == len(blocks)


def test_index_is_built_without_a_shuffle(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("_rowid"), F.concat(F.lit("red fox "), F.col("id").cast("string")).alias("text"))
    plan = fts.blocks(fts.tokenized(rows, "text", Tokenizer(**PLAIN)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    table = connect(spark, str(tmp_path)).create_table("texts", rows.select("text"))
    table.create_index("text", "fts", **PLAIN)
    assert len(table.search("fox").all_matches().to_list()) == 1000
    assert [r["text"] for r in table.search("fox 17").limit(1).to_list()] == ["red fox 17"]


def test_index_files_of_another_layout_are_not_read(spark, tmp_path):
    table = connect(spark, str(tmp_path)).create_table("texts", [{"text": None}, {"text": "red fox"}, {"text": ""}, {"text": "fox"}])
    table.create_index("text", "fts", **PLAIN)
    assert table.index_stats("text_idx")["num_indexed_rows"] == 3
    want = table.search("red fox").to_list()
    assert [r["text"] for r in want] == ["red fox", "fox"]
    table.store.replace(table._index_file(), {n: {k: v for k, v in e.items() if k != "layout"} | {"paths": [], "terms": []} for n, e in table.indices().items()})
    assert table.search("red fox").to_list() == want
    table.add([{"text": "a red, red fox"}])
    table.optimize()
    assert table.indices()["text_idx"]["layout"] and len(table.search("red fox").to_list()) == 3


def test_one_arm_reads_only_vectors(spark, tmp_path):
    spark.createDataFrame([(i, [float(i)] * 64, 1) for i in range(60)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["rrf_of_one_arm"](spark, str(tmp_path)).count() == 50
