"""The queries of this subpackage, one thin `opN_<name>` for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "llr")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and fitting rule of every URL: the part of op5_url_filter that SQL can say too."""
    from pyspark.sql import functions as F

    from .url_filter import RULES, fitting_rule, host_and_path

    host, path = host_and_path(F.col("url"))
    split = _table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule, action = fitting_rule(F.col("host"), F.col("path"), RULES)
    return split.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"))


URL_RULES_SQL = r"""
WITH rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
rules AS (SELECT * FROM (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) t(rule, h, p, action)),
fits AS (SELECT page_id, arg_max(rule, len(rule)) AS rule, arg_max(action, len(rule)) AS action FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, action FROM split LEFT JOIN fits USING (page_id)
"""


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, k=10)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .toxicity import fit, held_out, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = F.col("doc_id")
    model = fit(docs, _table(spark, sf_dir, "labels"), ~held_out(out))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(out).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), "toxic_passages")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .lm_scoring import backoff_scores

    scored = backoff_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "n_words", F.round("score", 6).alias("score"))


#: Stupid backoff of order 5; r is what the other rows hold of an n-gram.
OP8_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
ends AS (SELECT row_no, w, unnest(range(1, len(w) + 1)) AS i FROM texts),
grams AS (SELECT row_no, i, k, array_to_string(list_slice(w, i - k + 1, i), ' ') AS g FROM ends, (SELECT unnest(range(1, 6)) AS k) WHERE k <= i),
own AS (SELECT row_no, k, g, count(*) AS o FROM grams GROUP BY row_no, k, g),
total AS (SELECT k, g, sum(o) AS c FROM own GROUP BY k, g),
rest AS (SELECT row_no, i, k, (c - o)::DOUBLE AS r FROM grams JOIN own USING (row_no, k, g) JOIN total USING (k, g)),
best AS (SELECT row_no, i, max(k) AS k FROM rest WHERE r > 0 OR k = 1 GROUP BY row_no, i),
scored AS (
  SELECT b.row_no, (least(b.i, 5) - b.k) * ln(0.4) + CASE WHEN b.k = 1 THEN ln(greatest(g.r, 1) / greatest((SELECT sum(len(w)) FROM texts) - len(t.w), 1)) ELSE ln(g.r / context.r) END AS s
  FROM best b JOIN texts t USING (row_no) JOIN rest g ON g.row_no = b.row_no AND g.i = b.i AND g.k = b.k
  LEFT JOIN rest context ON context.row_no = b.row_no AND context.i = b.i - 1 AND context.k = b.k - 1
), summed AS (SELECT row_no, sum(s) AS score FROM scored GROUP BY row_no)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(score, 0), 6) AS score FROM texts LEFT JOIN summed USING (row_no)
"""


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


OP9_SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY x, y),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * common >= 80 * (a.n + b.n - common)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x AS a, y AS b FROM edges UNION SELECT reach.a, edges.y FROM reach JOIN edges ON reach.b = edges.x),
least AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, least(doc_id, coalesce(b, doc_id)) = doc_id AS kept FROM texts LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .mixing import mix_plan, word_count
    from .scratch import materialize

    # words are counted once: two columns and the size are written, and read for the sums and for the plan
    sized = materialize(_table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words")), "sizes")
    plan = mix_plan(sized, size=F.col("words"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w, 3 * source_size AS c FROM sizes
), left_over AS (
  SELECT *,
    (sum(source_size) OVER ())::BIGINT - coalesce((sum(c) OVER before)::BIGINT, 0) AS rest,
    (sum(w) OVER ())::BIGINT - coalesce((sum(w) OVER before)::BIGINT, 0) AS open
  FROM weighed
  WINDOW before AS (ORDER BY c::DOUBLE / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_max(rest::DOUBLE / open::DOUBLE, open) AS level FROM left_over WHERE c::DOUBLE * open::DOUBLE > rest::DOUBLE * w::DOUBLE
), targets AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN c::DOUBLE ELSE least(c::DOUBLE, level * w::DOUBLE) END AS target FROM left_over, level
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix-1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS chance
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as read back from the store's last version."""
    from pyspark.sql import functions as F

    from .scratch import new_folder
    from .sharding import shard_table

    store = shard_table(_table(spark, sf_dir, "documents"), new_folder(spark, "shards"))
    store.vacuum(keep=1)
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP2_SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .exact_topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20)


OP3_SQL = """
WITH known AS (
  SELECT vec_id, row_number() OVER () AS node, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.node, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM known q JOIN known c ON q.node <> c.node AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), ranked AS (SELECT query_id, row_number() OVER (PARTITION BY node ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .substring_dedup import remove_repeats

    cut = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=50, single_spaces=True)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (SELECT row_no, doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT row_no, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM texts WHERE len(w) >= 50 AND doc_id IS NOT NULL)),
firsts AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
gone AS (SELECT DISTINCT row_no, unnest(range(i, i + 50)) AS place FROM windows JOIN firsts USING (h) WHERE least < doc_id),
words AS (SELECT row_no, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM texts),
kept AS (SELECT row_no, string_agg(word, ' ' ORDER BY place) AS text FROM words ANTI JOIN gone USING (row_no, place) GROUP BY row_no),
removed AS (SELECT row_no, count(*) AS n FROM gone GROUP BY row_no)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (row_no) LEFT JOIN removed USING (row_no)
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .mixing import word_count
    from .packing import pack

    packed = pack(_table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).alias("words")), length=F.col("words"))
    return packed.select("doc_id", "length", "bucket", "bucket_length", "batch", "place")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_sharding": op2_sharding,
    "op3_exact_topk": op3_exact_topk,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_ann": op6_ann,
    "op7_toxicity": op7_toxicity,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_minhash": op9_minhash,
    "op10_packing": op10_packing,
    "url_rules": url_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": OP1_SQL,
    "op2_sharding": OP2_SQL,
    "op3_exact_topk": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op8_lm_scoring": OP8_SQL,
    "op9_minhash": OP9_SQL,
    "url_rules": URL_RULES_SQL,
}
