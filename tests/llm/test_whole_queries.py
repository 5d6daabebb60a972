"""Corpus queries that must take every row, on tables where a subset gives other results."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.llm import packing, url_filter
from skerry.llm import queries as corpus


def test_scores_see_two_words_back(spark, tmp_path):
    """Two texts of the same bigrams, one made of trigrams that recur: only more than one word of context tells them apart."""
    known, shuffled = "a b c b d b a", "a b d b c b a"
    rows = [(0, known), (1, known), (2, known), (3, shuffled)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in corpus.QUERIES["op8_lm_scoring"](spark, str(tmp_path)).collect()}
    assert got[0] == got[1] == got[2] > got[3]


@pytest.mark.parametrize("lacking", ["held-out", "counted"])
def test_url_model_when_one_part_lacks_a_class(spark, lacking):
    urls = [(f"good{i}.example/articles/{i}", 1) for i in range(60)] + [(f"cheap{i}pills.test/buy?now={i}", 0) for i in range(60)]
    table = spark.createDataFrame(urls, "__url string, kind int").withColumn("fold", F.pmod(F.xxhash64("__url"), F.lit(4)))
    kept = table.filter("kind = 0 OR fold > 0" if lacking == "held-out" else "kind = 0 OR fold = 0").drop("fold")
    model = url_filter.fit(kept, order=3)
    fresh = [b"good99.example/articles/999", b"cheap88pills.test/buy?now=999"]
    d = model.difference(np.frombuffer(b"".join(fresh), dtype=np.uint8), np.cumsum([0, *map(len, fresh)]))
    assert d[0] > model.threshold() == 0 > d[1]
    assert not url_filter.fit(kept.filter("kind = 0"), order=3).total.any()


@pytest.mark.parametrize("limit", [{}, {"most": 0}], ids=["model travels", "model stays a table"])
def test_url_differences_come_of_every_counted_context(spark, limit):
    """Witten and Bell's blend by hand over all counted URLs, also of contexts seen once."""
    rng = np.random.default_rng(9)
    name = lambda: "".join(rng.choice(list("abcdeé"), int(rng.integers(1, 9))))
    ends = ["org/fr/", "net/", "example.net/en/", "example.com/de/", "test/fr/", "test/"]
    urls = [f"http://{name()}.{ends[i % 6]}{name()}" for i in range(300)] + [f"http://one.test/{'ab' * 20_000}", "http://", "none", None]
    pages = spark.createDataFrame([*enumerate(urls + urls[::9]), (None, urls[0])], "page_id long, url string")
    rows = url_filter.judge(pages, order=3, **limit).withColumn("fold", F.pmod(F.xxhash64(F.concat("host", "path")), F.lit(4))).collect()
    assert Counter((r.page_id, r.url) for r in rows) == Counter((r.page_id, r.url) for r in pages.collect())

    around = lambda u: [((k, u[max(0, i - k) : i], i < k), u[i]) for i in range(len(u)) for k in range(4)]
    after = {"allow": defaultdict(Counter), "block": defaultdict(Counter)}
    action = dict(url_filter.RULES)
    for r in rows:
        if r.rule and r.fold:
            for context, byte in around((r.host + r.path).encode()):
                after[action[r.rule]][context][byte] += 1
    assert {action[r.rule] for r in rows if r.rule and not r.fold} == {"allow", "block"}
    for r in rows:
        u, want = (r.host + r.path).encode(), 0.0
        for kind, sign in (("allow", 1), ("block", -1)):
            for at, (context, byte) in enumerate(around(u)):
                p = 1 / 256 if at % 4 == 0 else p
                if context in after[kind]:
                    seen = after[kind][context]
                    p = (seen[byte] + len(seen) * p) / (seen.total() + len(seen))
                if at % 4 == 3:
                    want += sign * math.log(p)
        assert r.llr == pytest.approx(want / max(len(u), 1), abs=1e-9)
    free = [(r.llr, r.verdict) for r in rows if not r.rule]
    assert max(x for x, v in free if v == "block") < min(x for x, v in free if v == "allow")


def test_boundaries_of_long_texts_occur(spark):
    lengths = [3, 4097, 5001, 5002, 70_001, 70_003]
    docs = spark.createDataFrame([(i, "", n) for i, n in enumerate(lengths)], "doc_id long, text string, n long")
    got = packing.pack(docs, buckets=4, length=F.col("n")).collect()
    assert sorted(r.length for r in got) == lengths
    assert {r.bucket_length for r in got} == {3, 4097, 5002, 70_003}
