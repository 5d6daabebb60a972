"""Rows of equal score at the limit of a text search, in tables whose row ids are not in the order of the key."""

import pytest
from pyspark.sql import functions as F

from skerry.queries import ORACLE_SQL, QUERIES

from .oracle import check


@pytest.mark.parametrize("name", ["model_reranked", "fts_match_any", "fts_prefilter", "hybrid_rrf", "knn_l2"])
def test_ties_go_by_the_key(spark, sf, tmp_path, name):
    docs = [(99 - i, "the with blees thention" + "!" * (i * 7 % 100), "en", "web") for i in range(100)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    frame.coalesce(1).write.parquet(f"{tmp_path}/made/documents.parquet")
    vectors = spark.createDataFrame([(99 - i, [0.5] * 64, i % 7) for i in range(100)], "vec_id long, embedding array<float>, label int")
    vectors.coalesce(1).write.parquet(f"{tmp_path}/made/embeddings.parquet")
    (tmp_path / "one").mkdir()
    for t in ("documents", "embeddings"):  # single files, which is what the SQL side reads
        next((tmp_path / "made" / f"{t}.parquet").glob("part-*")).rename(tmp_path / "one" / f"{t}.parquet")
    for t in "region nation customer supplier part orders lineitem events pages benchmark labels conversations".split():
        (tmp_path / "one" / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    check(QUERIES[name](spark, f"{tmp_path}/one"), ORACLE_SQL[name], f"{tmp_path}/one")
