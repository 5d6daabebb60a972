"""Nulls, empty tables, very long values and clashing columns in the operators and every stage of the pipeline."""

import pytest

from skerry.llm import toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_a_very_long_url(spark):
    long = "http://a.org/fr/" + "x" * 300_000 + "?q"
    pages = spark.createDataFrame([(1, long), (2, "http://b.net/" + "y" * 100_000), (3, "http://c.test/" + "z" * 200_000), (4, "http://" + "h" * 50_000), (None, long)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(got) == 5 and (got[1].rule, got[1].verdict, len(got[1].path)) == ("org/fr/", "allow", 300_004) and got[2].verdict == "block"
    assert len(got[4].host) == 50_000 and got[4].path == "" and got[None].verdict == "allow"


def test_toxicity_keeps_clashing_columns_and_takes_long_texts(spark):
    long = "fine words stand here " * 40_000 + "vile " * 30 + "fine words again " * 1_000
    rows = [(i, "vile nasty vile" if i % 5 == 0 else f"a fine text number {i}", 7, "x", 1) for i in range(100)] + [(500, long, 7, "x", 1), (501, "", 7, "x", 1), (None, None, 7, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic_score int, `__0` string, `__score` int")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(100)], "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.fit(docs, labels))
    assert found.columns == ["doc_id", "text", "__0", "__score", "toxic_score", "toxic_passages"]
    got = {r.doc_id: r for r in found.collect()}
    assert all(0 <= r.toxic_score <= 1 and r["__0"] == "x" and r["__score"] == 1 for r in got.values())
    assert got[0].toxic_score > 0.5 > got[1].toxic_score and got[500].toxic_score > 0.5
    spot = got[500].toxic_passages[0]
    assert set(long.encode()[spot.start : spot.end].decode().split()) == {"vile"}
    assert got[501].toxic_score == got[None].toxic_score < 0.5 and not got[None].toxic_passages


@pytest.fixture(scope="module")
def labels_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def run(spark, docs, labels_dir, folder):
    import corpus_pipeline

    out = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, labels_dir)
        if name != "packing":
            assert made.columns == docs.columns
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.collect()
    return out


def test_pipeline_of_nothing(spark, labels_dir, tmp_path):
    got = run(spark, spark.createDataFrame([], DOCS), labels_dir, str(tmp_path))
    assert all(rows == [] for rows in got.values())


def test_pipeline_keeps_null_ids_and_clashing_columns(spark, labels_dir, tmp_path):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(i, "vile nasty " * 8 if i % 4 == 0 else text(i), "en", f"s{i % 3}", 1) for i in range(80)]
    rows += [(None, text(900), None, None, None), (None, text(900), None, None, None), (None, None, None, None, None), (81, "", "en", None, 0), (82, None, "en", "s1", None), (83, text(1), "en", "s1", 1), (1, text(1), "en", "s1", 1)]
    extra = ("__id", "__row", "__text", "__0", "size", "target", "length", "row", "cell", "shift", "at", "__h", "__source")
    docs = spark.createDataFrame([(*r, *range(len(extra))) for r in rows], DOCS + "".join(f", `{c}` int" for c in extra))
    got = run(spark, docs, labels_dir, str(tmp_path))
    kept = [r.doc_id for r in got["near_dedup"]]
    assert kept.count(None) == 3 and 83 not in kept and kept.count(1) == 1 and {81, 82} <= set(kept) and 0 not in kept
    assert all(tuple(r[c] for c in extra) == tuple(range(len(extra))) for name in ("toxicity", "near_dedup", "substring_dedup", "mixing") for r in got[name])
    assert [c for c in extra if c != "length"] == [c for c in got["packing"][0].__fields__ if c in extra and c != "length"] and len(got["packing"]) == len(got["mixing"])
