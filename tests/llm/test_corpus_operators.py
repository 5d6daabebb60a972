"""The corpus operators against brute force, and their edge cases."""

import hashlib
import itertools
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from skerry.llm import ann, bounded, components, exact_topk, lm_scoring, minhash, mixing, packing, sharding, substring_dedup, textops, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>"


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n, vocabulary=4000):
    return [f"w{rng.integers(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, nulls, empties, a long text, repeated rows."""
    rng = np.random.default_rng(5)
    texts = []
    passage = sentence(rng, 70)
    base = sentence(rng, 200)
    for i in range(60):
        body = sentence(rng, int(rng.integers(1, 160)))
        if i % 5 == 0:
            at = len(body) // 2
            body = body[:at] + passage[: int(rng.integers(45, 71))] + body[at:]
        texts.append(" ".join(body))
    for i in range(40):
        near = list(base)
        for at in rng.integers(0, 200, int(rng.integers(0, 9))):
            near[at] = f"edit{i}"
        texts.append("\n ".join(near))
    texts += [texts[3], texts[3].upper(), "", " \t\n ", None, "one", "one two three", "\u00e9t\u00e9 na\u00efve \u00df", " ".join(sentence(rng, 30_000))]
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, texts[0], None, "s1", None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# -- shared kernels --------------------------------------------------------------------------


def test_words_match_the_pattern(corpus):
    import pyarrow as pa

    texts = [r[1] for r in corpus]
    for chunk in (1, 200, 1 << 20):
        found = []
        for _, _, buf, at in textops.chunks(pa.array(texts, pa.string()), chunk):
            w = textops.Words(buf, at)
            found += [[w.word(j).decode() for j in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])]
        assert found == [words(t) for t in texts]


def test_word_hashes_depend_on_the_word_alone():
    import pyarrow as pa

    (_, _, buf, at), = textops.chunks(pa.array(["a bb a", "bb  a"]))
    h = textops.Words(buf, at).hashes
    assert h[0] == h[2] == h[4] and h[1] == h[3] and h[0] != h[1]


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(i, i + 1) for i in range(100, 140)] + [(None, 3), (5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    least = {}
    for _ in range(200):
        for a, b in edges:
            if a is not None and b is not None:
                least[a] = least[b] = min(least.get(a, a), least.get(b, b))
    assert got == {n: c for n, c in least.items() if any(n in e and e[0] != e[1] and None not in e for e in edges)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- 1 mixing --------------------------------------------------------------------------------


def water(sizes, weights, top):
    """Targets by repeated sharing, in exact fractions."""
    from fractions import Fraction

    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = Fraction(sum(sizes.values())), set()
    while True:
        rest = total - sum(top * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        share = {s: Fraction(top * sizes[s]) if s in full else rest * weight[s] / open_ for s in names}
        over = {s for s in names if s not in full and share[s] > top * sizes[s]}
        if not over:
            return share
        full |= over


def test_targets_fill_like_water(spark):
    rng = np.random.default_rng(2)
    for _ in range(4):
        sizes = {(f"s{i}" if i else None): int(rng.integers(0, 50)) ** 2 for i in range(int(rng.integers(1, 9)))}
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(rows).collect()}
        assert got == pytest.approx({s: float(t) for s, t in water(sizes, (5, 2, 1), 3).items()})


def test_mix_plan_and_mix(spark, docs, corpus):
    plan = mixing.mix_plan(docs)
    rows = plan.collect()
    assert len(rows) == len(corpus)
    assert Counter(r["size"] for r in rows) == Counter(len(words(r[1])) for r in corpus)
    assert all(0 <= r.copies <= 3 and r.copies in (math.floor(r.target / r.source_size), math.floor(r.target / r.source_size) + 1) for r in rows if r.source_size)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_plan(docs.repartition(7)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)


def test_mix_edges(spark, none):
    assert mixing.mix_plan(none).count() == 0
    clash = spark.createDataFrame([(1, "a b", "x", 9, 9, 9), (2, None, None, 9, 9, 9), (3, "", None, 9, 9, 9)], "doc_id long, text string, source string, size long, Copies long, target long")
    odd = clash.selectExpr("*", "7 AS `__source`", "8 AS `__of`", "9 AS `__size`", "source AS `source_size`")
    assert [(r["size"], r["__source"], r["__size"]) for r in mixing.mix_plan(odd).orderBy("doc_id").collect()] == [(2, 7, 9), (0, 7, 9), (0, 7, 9)]
    assert [r["size"] for r in mixing.mix_plan(clash).orderBy("doc_id").collect()] == [2, 0, 0]
    assert mixing.mix(clash).columns == clash.columns


# -- 2 sharding ------------------------------------------------------------------------------


def test_store_compacts_and_keeps_rows(spark, tmp_path, docs, corpus):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=200_000, floor_bytes=1_000)
    for i in range(6):
        store.append(spark.range(i * 3000, (i + 1) * 3000, numPartitions=2).selectExpr("id", "md5(cast(id as string)) t"))
        store.compact()
    assert len(store.shards()) < 12 and sum(s.rows for s in store.shards()) == 18_000
    assert store.read().distinct().count() == 18_000 and store.read(1).count() == 3000
    assert not sharding.similar_runs([s.bytes for s in store.shards()], 200_000, floor=1_000)
    store.vacuum(keep=1)
    assert store.read().count() == 18_000 and len(store.versions()) == 1
    for i in range(sharding.FULL_EVERY + 2):  # chains with a whole list in them, after one was cut off
        store.append(spark.range(i, i + 1).selectExpr("id", "md5(cast(id as string)) t"))
    assert store.read().count() == 18_002 + sharding.FULL_EVERY and store.read(store.versions()[3]).count() == 18_003
    other = sharding.ShardStore(spark, str(tmp_path / "d"))
    other.append(docs)
    assert sorted(map(str, other.read().collect())) == sorted(str(r) for r in docs.collect())


def test_store_commits_are_atomic(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    store.append(spark.range(3))
    stale = store.manifest()
    store.append(spark.range(3, 5))
    held = store.manifest
    store.manifest = lambda version=None: stale if store.__dict__.pop("once", None) else held(version)
    store.once = True
    assert store.append(spark.range(5, 6)) == 3  # the second try, after the first lost version 2
    assert sorted(r.id for r in store.read().collect()) == list(range(6))
    empty = sharding.ShardStore(spark, str(tmp_path / "e"))
    empty.append(spark.range(0))
    assert empty.read().count() == 0 and empty.read().columns == ["id"]
    with pytest.raises(ValueError):
        store.append(spark.range(2).selectExpr("cast(id as string) x"))


# -- 3 exact top-k and 6 nearest neighbours ---------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(150)]
    rows += [(i, rows[4][1]) for i in range(150, 190)]  # ties
    rows += [(190, None), (191, [float("nan")] * 8), (192, [1.0, None] + [0.0] * 6), (193, [float("inf")] * 8), (194, [0.0] * 8), (195, []), (None, [1.0] * 8), (200, [1.0] * 8)]
    rows += [rows[7], rows[7], (7, rows[60][1]), (20, rows[61][1]), (40, rows[40][1])]  # ids on several rows
    return rows, spark.createDataFrame(rows, VECTORS)


def sound(rows, zero):
    """(id, vector) of each row that takes part."""
    return [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]


@pytest.mark.parametrize("sizes", [(4096, 512), (32, 5)])
def test_exact_top_k(spark, vectors, sizes):
    from pyspark.sql import functions as F

    rows, table = vectors
    held = [(i, np.floor(64 * v)) for i, v in sound(rows, zero=True)]
    want = []
    for n, (q, x) in enumerate(held):
        if q % 20 == 0:
            best = sorted((-int(x @ v), i) for m, (i, v) in enumerate(held) if m != n)[:20]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    got = exact_topk.top_k(table, F.col("vec_id") % 20 == 0, candidates=sizes[0], queries=sizes[1]).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_exact_top_k_keeps_repeated_ids(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 0.5]), (1, [2.0, 3.0]), (1, [1.0, 4.0]), (2, [0.5, 0.0])]
    got = exact_topk.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 64 * 128 + 32 * 192), (0, 2, 1, 64 * 64 + 32 * 256), (0, 3, 2, 64 * 32)]
    assert [r.vec_id for r in got].count(1) == 2
    assert exact_topk.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") == 0).count() == 0


def test_the_cutoff_spares_products():
    """What reaches the cutoff is exact, and most pairs are never completed."""
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(4000, 64))
    rows = np.floor(64 * rows / np.linalg.norm(rows, axis=1, keepdims=True))
    block, formed = exact_topk.Block(rows), 0
    for q in rows[:40]:
        score = rows @ q
        cutoff = float(np.sort(score)[-21])
        at, got, n = block.reach(q, cutoff, 4)
        assert sorted(at) == sorted(np.flatnonzero(score >= cutoff)) and (got == score[at]).all()
        formed += n
    assert formed < 0.65 * 40 * len(rows) * 4
    assert block.reach(rows[0], 1e6, 4)[2] == 0


def test_exact_top_k_of_large_numbers(spark):
    from pyspark.sql import functions as F

    rows = [(0, [2.0**25, 1 / 64]), (1, [2.0**24, 3 / 64]), (2, [-(2.0**24), 3 / 64])]
    got = exact_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.score for r in got] == [2**61 + 3, 3 - 2**61]


def test_nearest(spark, vectors):
    from pyspark.sql import functions as F

    rows, table = vectors
    held = sound(rows, zero=False)
    found = Counter()
    for r in ann.nearest(table, F.col("vec_id") % 10 == 0).collect():
        found[r.query_id, r.rank, r.vec_id, round(r.score, 9)] += 1
    want = Counter()
    for n, (q, x) in enumerate(held):
        if q % 10 == 0:
            best = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for m, (i, v) in enumerate(held) if m != n)[:10]
            want.update((q, r, i, round(s, 9)) for r, (s, i) in enumerate(best, 1))
    assert sum(found.values()) == sum(want.values())
    assert sum((found & want).values()) / sum(want.values()) >= 0.9
    few = table.filter("vec_id in (1, 2, 3)")
    assert ann.nearest(few, F.col("vec_id") == 1).count() == 2
    assert ann.nearest(table.filter("false"), F.col("vec_id") == 1).count() == 0


def test_the_forest_examines_few_rows():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(4096, 64))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    forest, hits, examined = ann.Forest(rows), 0, 0
    for i, at in enumerate(forest.candidates(rows[:50], ann.SHARE, ann.EXAMINED, 11)):
        best = np.argsort(((rows - rows[i]) ** 2).sum(axis=1))[1:11]
        hits, examined = hits + len(set(best) & set(at)), examined + len(at)
    assert hits >= 0.9 * 500 and examined < 0.1 * 50 * len(rows)


def test_recall_on_the_embeddings(spark, sf):
    from pyspark.sql import functions as F

    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    held = dict(sound([(r.vec_id, r.embedding) for r in table.collect()], zero=False))
    ids = np.array(sorted(held))
    matrix = np.stack([held[i] for i in ids])
    found = defaultdict(set)
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q in found:
        d = np.where(ids == q, np.inf, ((matrix - held[q]) ** 2).sum(axis=1))
        hits += len(found[q] & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hits / (10 * len(found)) >= 0.9


# -- 4 repeated passages ----------------------------------------------------------------------


def cut(rows, window):
    first = {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, t, *_ in rows:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("shard_contexts", [512, 3, 1])
def test_remove_repeats(docs, corpus, shard_contexts):
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in substring_dedup.remove_repeats(docs, single_spaces=True, shard_contexts=shard_contexts).collect()]
    want = cut(corpus, 50)
    assert sum(w[2] for w in want) > 1000
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_a_common_line_in_new_surroundings(spark):
    """Many contexts under one anchor: the shard is cut finer until every piece is small."""
    rng = np.random.default_rng(12)
    line, rows = sentence(rng, 40), []
    for i in range(120):
        a, b = sentence(rng, 30), sentence(rng, 30)
        rows.append((i, " ".join((rows[i - 7][1].split()[20:40] if i % 9 == 8 else a) + line + b)))
    rows += [(200, rows[5][1]), (201, rows[5][1] + " tail")]
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), single_spaces=True, shard_contexts=4).collect()]
    want = cut(rows, 50)
    assert sum(w[2] > 0 for w in want) > 10 and sorted(got) == sorted(want)


def test_remove_repeats_keeps_the_rest(docs, corpus):
    texts = defaultdict(set)
    for i, t, *_ in corpus:
        texts[i].add(t or "")
    for r in substring_dedup.remove_repeats(docs).collect():
        assert len(words(r.text)) == r.n_words - r.n_removed
        assert r.n_removed or r.text in texts[r.doc_id]


def test_remove_repeats_edges(spark, none):
    assert substring_dedup.remove_repeats(none).count() == 0
    long = " ".join(f"x{i}" for i in range(60))
    clash = spark.createDataFrame([(1, long, 7), (2, long, 8)], "doc_id long, text string, N_Words long")
    got = substring_dedup.remove_repeats(clash).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed) for r in got] == [(60, 0), (60, 60)]


def test_automaton_matches_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        held = [[str(x).encode() for x in rng.integers(0, 3, int(rng.integers(1, 14)))] for _ in range(3)]
        machine = substring_dedup.SuffixAutomaton()
        for h in held:
            machine.add(h)
        query = [str(x).encode() for x in rng.integers(0, 3, 15)]
        inside = {tuple(h[a:b]) for h in held for a in range(len(h)) for b in range(a + 1, len(h) + 1)}
        want = [max((n for n in range(e + 1) if n == 0 or tuple(query[e - n : e]) in inside), default=0) for e in range(1, 16)]
        assert list(machine.matches(query)) == want


def test_a_threshold_keeps_the_size_bound(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(float(w), n) for w in range(1, 200) for n in (1, 3)], "w double, n int")
    for most in (10_000, 300, 50, 3):
        floor = bounded.threshold(rows, F.col("w"), F.col("n"), 2.0, most)
        kept = lambda f: 4 * sum(w >= f for w in range(1, 200))
        assert kept(floor) <= most and (floor == 2.0 or kept(floor * 2 ** (-1.001 / bounded.STEPS)) > most)
    assert bounded.threshold(rows.filter("false"), F.col("w"), F.col("n"), 2.0, 3) == 2.0


# -- 5 URL filter -----------------------------------------------------------------------------


def test_rules(spark):
    rows = ["http://A.Example.NET/en/x?y#z", "https://foo.net", "x://foo.net/", "ftp://example.com/de/1", "q://a.fr.org/fr/", "http://xexample.net/en/", None, "", "no scheme", "http://net/#a", "http://b.org?x=/fr/", "http://c.org/fr/#/", "http://\n.org/fr/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(rows)], "page_id long, url string, Host string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    want = {0: ("a.example.net", "/en/x", "example.net/en/"), 1: ("foo.net", "", None), 2: ("foo.net", "/", "net/"), 3: ("example.com", "/de/1", "example.com/de/"), 4: ("a.fr.org", "/fr/", "org/fr/"), 5: ("xexample.net", "/en/", "net/"), 6: ("", "", None), 7: ("", "", None), 8: ("", "", None), 9: ("net", "/", "net/"), 10: ("b.org", "", None), 11: ("c.org", "/fr/", "org/fr/"), 12: ("\n.org", "/fr/", "org/fr/")}
    assert {i: (r.host, r.path, r.rule) for i, r in got.items()} == want
    verdict = dict(url_filter.RULES)
    assert all(got[i].verdict == verdict[w[2]] for i, w in want.items() if w[2])
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert url_filter.judge(pages.filter("false")).count() == 0


def test_url_model_is_a_distribution_and_separates(spark):
    good = [f"good{i % 7}.example/articles/{i}" for i in range(400)]
    bad = [f"cheap{i % 5}pills.test/buy?now={i}" for i in range(400)]
    table = spark.createDataFrame([(u, 1) for u in good] + [(u, 0) for u in bad], "__url string, kind int")
    model = url_filter.fit(table, order=3)
    fresh = [b"good9.example/articles/999", b"cheap8pills.test/buy?now=999"]
    buf, at = np.frombuffer(b"".join(fresh), dtype=np.uint8), np.cumsum([0, *map(len, fresh)])
    d = model.difference(buf, at)
    assert d[0] > model.threshold() > d[1]


def test_url_model_against_plain_counts():
    """Witten and Bell's blend by hand, over a few URLs."""
    import pyarrow as pa

    urls = ["ab/", "abc", "b"]
    batch = pa.RecordBatch.from_arrays([pa.array(urls), pa.array([1, 1, 1])], names=["__url", "kind"])
    rows = [r for b in url_filter._count(iter([batch]), 2) for r in b.to_pylist()]
    kind, context, joint, n = (np.array([r[c] for r in rows]) for c in ("kind", "context", "joint", "n"))
    model = url_filter.Model.of(2, kind, context.view(np.uint64), joint.view(np.uint64), n)
    seen = defaultdict(Counter)
    for u in urls:
        for i, c in enumerate(u):
            for k in range(3):
                seen[(k, u[max(0, i - k) : i], i - k < 0)][c] += 1
    want = 0.0
    u = "abb"
    for i, c in enumerate(u):
        p = 1 / 256
        for k in range(3):
            after = seen[(k, u[max(0, i - k) : i], i - k < 0)]
            if after:
                p = (after[c] + len(after) * p) / (sum(after.values()) + len(after))
        want += math.log(p) - math.log(1 / 256)
    got = model.difference(np.frombuffer(b"abb", dtype=np.uint8), np.array([0, 3]))
    assert got[0] * 3 == pytest.approx(want)


# -- 7 toxicity -------------------------------------------------------------------------------


def segments_by_definition(v):
    best = None
    for i, j in itertools.combinations(range(len(v) + 1), 2):
        t = sum(v[i:j])
        if t > 1e-12 and (best is None or t > best[2] + 1e-9):
            best = (i, j, t)
    if best is None:
        return []
    right = [(a + best[1], b + best[1], t) for a, b, t in segments_by_definition(v[best[1] :])]
    return segments_by_definition(v[: best[0]]) + [best] + right


def test_maximal_segments():
    rng = np.random.default_rng(6)
    for _ in range(300):
        v = rng.normal(size=int(rng.integers(0, 14))) - 0.2
        assert [s[:2] for s in toxicity.maximal_segments(v)] == [s[:2] for s in segments_by_definition(list(v))]


def test_poisson_tail():
    log_mean = np.log(np.array([0.01, 1.5, 2.9, 0.3, 40.0]))
    for r, (got, m) in enumerate(zip(toxicity.poisson_tail(log_mean), np.exp(log_mean)), 1):
        want = 1 - sum(math.exp(-m) * m**k / math.factorial(k) for k in range(r))
        assert math.exp(got) == (pytest.approx(want, rel=1e-6) if m <= r else 1.0)


def test_tail_of_clean_scores():
    rng = np.random.default_rng(2)
    scores = rng.exponential(1 / 1.3, 20_000)  # in 400,000 tokens: K = 0.05
    counts = np.bincount((scores / toxicity.SCORE_BIN).astype(int), minlength=toxicity.SCORE_BINS)
    decay, factor, floor = toxicity.tail(counts, 400_000)
    assert decay == pytest.approx(1.3, rel=0.1) and factor == pytest.approx(0.05, rel=0.4) and (scores >= floor).sum() >= 800
    assert toxicity.tail(np.zeros(toxicity.SCORE_BINS), 10) == (1.0, 1.0, 0.0)


@pytest.fixture(scope="module")
def abuse(spark):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(600):
        w = sentence(rng, int(rng.integers(20, 120)), 300)
        toxic = i % 6 == 0
        if toxic:
            at = int(rng.integers(len(w)))
            w[at:at] = [f"nasty{rng.integers(40)}", "vile", f"nasty{rng.integers(40)}"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, abuse):
    from pyspark.sql import functions as F

    rows, labels = abuse
    docs = spark.createDataFrame([*rows, (9001, None), (9002, ""), (None, "nasty3 vile nasty4")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (0, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, ~toxicity.held_out(F.col("doc_id")))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    out = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i].toxic_score >= 0.5) == bool(dict(labels)[i]) for i in out)
    assert right / len(out) > 0.95
    assert got[None].toxic_score >= 0.5 and got[9001].toxic_score == got[9002].toxic_score < 0.5
    spot = got[6].toxic_passages[0]
    assert "vile" in rows[6][1].encode()[spot.start : spot.end].decode()


def test_toxicity_against_plain_counts(spark, abuse):
    """The whole of fit and score over dictionaries; segments, tail and curve are tested by themselves."""
    from pyspark.sql import functions as F

    rows, labels = abuse
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fold = {r.doc_id: r.fold for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("fold")).collect()}
    text, toxic, tokens = dict(rows), dict(labels), lambda t: re.findall("[a-z0-9]+", t.lower())
    counts = {k: (Counter(), Counter()) for k in ("token", "stem")}
    for i, t in rows:
        if fold[i]:
            for w in tokens(t):
                counts["token"][toxic[i]][w] += 1
                counts["stem"][toxic[i]][w[:4]] += 1
    n = [sum(c.values()) for c in counts["token"]]
    share = n[1] / sum(n)
    clip = lambda x: min(max(x, toxicity.LOWEST), toxicity.HIGHEST)

    def odds(kind, key, center):
        clean, bad = (c[key] for c in counts[kind])
        tilt = math.exp(clip(center) / 2)
        return clip(math.log(bad + toxicity.STRENGTH * share * tilt) - math.log(clean + toxicity.STRENGTH * (1 - share) / tilt) - math.log(share / (1 - share)))

    def value(w):
        usual = odds("stem", w[:4], 0.0)
        default = usual if abs(usual) >= toxicity.EVIDENCE else 0.0
        own = odds("token", w, usual) if counts["token"][0][w] + counts["token"][1][w] else default
        return (own if abs(own - default) >= toxicity.EVIDENCE else default) - toxicity.DRIFT

    found = {i: toxicity.maximal_segments(np.array([value(w) for w in tokens(t)])) for i, t in rows}
    clean = [i for i in text if not fold[i] and not toxic[i]]
    bins = np.bincount([min(int(s[2] / toxicity.SCORE_BIN), toxicity.SCORE_BINS - 1) for i in clean for s in found[i]], minlength=toxicity.SCORE_BINS)
    decay, factor, floor = toxicity.tail(bins, sum(len(tokens(text[i])) for i in clean))

    def x(i):
        best = sorted((s[2] for s in found[i] if s[2] >= floor), reverse=True)
        if not best:
            return 0.0
        log_mean = np.array([math.log(factor * max(len(tokens(text[i])), 1)) - decay * s for s in best])
        return min(0.0, float(toxicity.poisson_tail(log_mean).min() / math.log(10)))

    held = Counter((min(max(math.floor((x(i) - toxicity.ORIGIN) / toxicity.BIN), 0), toxicity.BINS - 1), toxic[i]) for i in text if not fold[i])
    at = sorted({b for b, _ in held})
    slope, offset = toxicity.logistic(np.array([toxicity.ORIGIN + (b + 0.5) * toxicity.BIN for b in at]), np.array([float(held[b, 1]) for b in at]), np.array([float(held[b, 0]) for b in at]))
    got = {r.doc_id: r.toxic_score for r in toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()}
    assert got == pytest.approx({i: 1 / (1 + math.exp(-(offset - slope * x(i)))) for i in text}, abs=1e-6)


def test_toxicity_without_labels(spark, abuse, none):
    docs = spark.createDataFrame(abuse[0][:5], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.toxic_score < 0.01 for r in toxicity.score(docs, toxicity.fit(docs, empty)).collect())
    assert toxicity.score(none, toxicity.fit(none, empty)).count() == 0


# -- 8 language-model scores ------------------------------------------------------------------


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_backoff_scores(docs, corpus, order):
    grams = lambda w: Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    counts = sum((grams(words(r[1])) for r in corpus), Counter())
    total = sum(n for g, n in counts.items() if len(g) == 1)

    def log_score(w):
        out, own = 0.0, grams(w)
        rest = lambda g: counts[g] - own[g]
        for i in range(len(w)):
            top = min(order, i + 1)
            k = next(k for k in range(top, 0, -1) if k == 1 or rest(tuple(w[i - k + 1 : i + 1])))
            g = tuple(w[i - k + 1 : i + 1])
            out += (top - k) * math.log(0.4) + math.log(rest(g) / rest(g[:-1]) if k > 1 else max(rest(g), 1) / max(total - len(w), 1))
        return out

    want = sorted(((-1 if r[0] is None else r[0], len(words(r[1]))), log_score(words(r[1]))) for r in corpus)
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.n_words), r.score) for r in lm_scoring.backoff_scores(docs, order=order, batch_bytes=20_000, partition_bytes=4_000).collect())
    assert [k for k, _ in got] == [k for k, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-6)


def test_backoff_scores_of_nothing(none):
    assert lm_scoring.backoff_scores(none).count() == 0


# -- 9 near-duplicates ------------------------------------------------------------------------


def near(rows, size, percent):
    sets = []
    for _, t, *_ in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    label = {r[0]: r[0] for r in rows if r[0] is not None}
    links = [(a[0], b[0]) for (a, x), (b, y) in itertools.combinations(zip(rows, sets), 2) if a[0] is not None and b[0] is not None and x and y and 100 * len(x & y) >= percent * len(x | y)]
    for _ in range(len(rows)):
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return sorted((-1 if r[0] is None else r[0], len(s), -1 if r[0] is None else label[r[0]]) for r, s in zip(rows, sets))


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, corpus, size):
    got = minhash.near_duplicates(docs, shingle=size).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == near(corpus, size, 80)
    assert all(r.kept == (r.component_id in (None, r.doc_id)) for r in got)


@pytest.mark.parametrize("block", [600, 1 << 17])
def test_a_group_of_many_near_copies(spark, block):
    """Copies whose likeness to each other lies around the threshold: links in plenty, and many that just fail."""
    rng = np.random.default_rng(8)
    base, rows = sentence(rng, 100), []
    for i in range(160):
        w = list(base)
        for at in rng.integers(0, 100, int(rng.integers(0, 9))):
            w[at] = f"edit{rng.integers(40)}"
        rows.append((i, " ".join(w), "en", "s", 1))
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3), shingle=4, block_shingles=block).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == near(rows, 4, 80)


def test_drop_near_duplicates(docs, corpus, none):
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = {(a if a >= 0 else None) for a, _, c in near(corpus, 5, 80) if a == c}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, want))
    odd = docs.sparkSession.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "x"), (1, "p q r s t u"), (1, "p q r s t u"), (1, "other words stand here now")], "doc_id long, text string")
    assert Counter((r.doc_id, r.text[0]) for r in minhash.drop_near_duplicates(odd).collect()) == {(None, "a"): 2, (None, "x"): 1, (1, "p"): 1, (1, "o"): 1}
    assert minhash.near_duplicates(none).count() == 0 and minhash.drop_near_duplicates(none).count() == 0


def test_bayesian_bounds():
    least = minhash.least_matches(0.8, 1e-6)
    assert list(least) == sorted(least) and least[96] < 77
    rng = np.random.default_rng(9)
    a = rng.integers(0, 1 << 30, (2000, minhash.N_HASHES)).astype(np.uint32)
    same = rng.random(a.shape) < 0.8
    assert minhash.bayes_filter(a, np.where(same, a, a + 1).astype(np.uint32), least).all()
    assert not minhash.bayes_filter(a, a + np.uint32(1), least).any()


# -- 10 packing -------------------------------------------------------------------------------


def test_boundaries_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = np.unique(rng.integers(0, int(rng.choice([40, 90_000])), int(rng.integers(1, 9))))
        counts, k = rng.integers(1, 5, len(lengths)), int(rng.integers(1, 5))

        def padding(bounds, lengths=lengths, counts=counts):
            return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts))

        best = min(padding(b) for r in range(1, k + 1) for b in itertools.combinations(lengths.tolist(), r) if max(b) == lengths[-1])
        assert padding(packing.boundaries(lengths, counts, k)) == best


@pytest.mark.parametrize("cell_rows", [5, 50_000])
def test_pack(docs, corpus, none, cell_rows):
    got = packing.pack(docs, buckets=4, budget=512, cell_rows=cell_rows).collect()
    assert Counter(r.length for r in got) == Counter(len(words(r[1])) for r in corpus)
    batches = defaultdict(list)
    for r in got:
        assert r.length <= r.bucket_length
        batches[r.bucket, r.batch].append(r)
    for (bucket, batch), rows in batches.items():
        room = max(1, 512 // max(1, rows[0].bucket_length))
        last = max(b for k, b in batches if k == bucket)
        assert sorted(r.place for r in rows) == list(range(len(rows))) and (len(rows) == room or batch == last)
    assert packing.pack(none).count() == 0


def test_equal_rows_spread_over_the_cells(spark):
    table = spark.range(20_000, numPartitions=3).selectExpr("1L AS doc_id", "'a b c' AS text", "id AS `__cell`", "1 AS `__h`", "2 AS row")
    got = packing.pack(table, budget=300, cell_rows=1000)
    assert got.columns == ["doc_id", "text", "__cell", "__h", "row", "length", "bucket", "bucket_length", "batch", "place"]
    rows = got.collect()
    assert {r["__cell"] for r in rows} == set(range(20_000)) and Counter(r.batch for r in rows) == {b: 100 for b in range(200)}
    heavy = [x["n"] for x in got.selectExpr("xxhash64(`__cell`) % 20 AS c").groupBy("c").count().withColumnRenamed("count", "n").collect()]
    assert max(heavy) < 20_000 / 4


def test_long_documents_and_their_batches(spark):
    lengths = [5001, 9001, 70_003, 70_003, 12]
    table = spark.createDataFrame([(i, " ".join(["w"] * n)) for i, n in enumerate(lengths)], "doc_id long, text string")
    got = {r.doc_id: r for r in packing.pack(table, budget=10_000).collect()}
    assert [got[i].bucket_length for i in range(5)] == lengths
    assert {got[2].batch, got[3].batch} == {0, 1}  # longer than the budget: a batch each


# -- registry and pipeline --------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, tmp_path, corpus, abuse):
    import corpus_pipeline

    rows = [r for r in corpus if r[0] is not None] + [(1000 + i, t, "en", "s9", len(t)) for i, t in abuse[0]]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1000 + i, 1, y) for i, y in abuse[1]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, held = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held[name] = [tuple(r) for r in docs.collect()]
    toxic = {1000 + i for i, y in abuse[1] if y}
    left = {r[0] for r in held["toxicity"]}
    assert len(toxic & left) <= 0.1 * len(toxic) and len({r[0] for r in rows} - toxic - left) <= 3
    reference = {a for a, _, c in near(held["toxicity"], 5, 80) if a == c}
    assert sorted(r[0] for r in held["near_dedup"]) == sorted(reference)
    want = {i: (n - m) for i, n, m, _ in cut(held["near_dedup"], 50)}
    assert {r[0]: len(words(r[1])) for r in held["substring_dedup"]} == want
    assert all(r[4] == len(r[1] or "") for r in held["substring_dedup"])
    assert {r[0] for r in held["mixing"]} <= {r[0] for r in held["substring_dedup"]}
    assert len(held["packing"]) == len(held["mixing"])


def test_queries_have_their_contract_columns():
    from skerry.llm import queries

    assert {m[1] for k in queries.QUERIES if (m := re.match(r"op(\d+)_", k))} == {str(n) for n in range(1, 11)}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    json.dumps(queries.ORACLE_SQL)


def test_queries_match_their_sql(spark, sf):
    from skerry.llm import queries

    from tests.oracle import check

    for name, sql in queries.ORACLE_SQL.items():
        check(queries.QUERIES[name](spark, sf), sql, sf)
