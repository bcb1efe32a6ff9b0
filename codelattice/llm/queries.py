"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm import hilbert_ann, hnsw_neardup, html_extract, language_id, minhash_neardup, mixing, packing, substring_dedup, token_counts, url_filter
from codelattice.llm.common import materialise, scratch


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents enter with an estimated count (a token for four characters) and are revised to their
    real counts by a second batch; the first is sent twice, as after a lost driver."""
    counts = materialise(token_counts.count_tokens(_read(spark, sf_dir, "documents")), "counts")
    guess = counts.withColumn("tokens", F.ceil(F.col("chars") / 4).cast("long"))
    rollup = token_counts.Rollup(spark, scratch(spark, "rollup"))
    rollup.commit("0001-load", token_counts.inserts(guess))
    rollup.commit("0002-revise", token_counts.revisions(guess, counts))
    rollup.commit("0001-load", token_counts.inserts(guess))
    return rollup.totals()


def op2_hnsw_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw_neardup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op4_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.nearest(_read(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup_passages(docs)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op10_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_neardup.near_duplicates(_read(spark, sf_dir, "documents"), shingle=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_counts, op2_hnsw_neardup, op3_language_id, op4_hilbert_ann, op5_mixing, op6_substring_dedup, op7_packing, op8_url_filter, op9_html_extract, op10_minmax_neardup)
    return {f.__name__: f for f in own}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _mixing_sql() -> str:
    weights = ", ".join(map(str, mixing.WEIGHTS))
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{weights}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INT] AS weight FROM s),
b AS (SELECT *, {mixing.CAP} * source_size / weight::DOUBLE AS bound, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight FROM w),
c AS (SELECT *, sum(source_size) OVER o - source_size AS before, sum(weight) OVER o - weight AS weight_before FROM b
      WINDOW o AS (ORDER BY bound, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (total - {mixing.CAP} * before)::DOUBLE / (all_weight - weight_before)::DOUBLE AS own_level FROM c),
m AS (SELECT *, max(CASE WHEN own_level <= bound THEN own_level END) OVER () AS level FROM l),
p AS (SELECT source, source_size, CASE WHEN bound <= level THEN ({mixing.CAP} * source_size)::DOUBLE ELSE level * weight END AS target,
      ('0x' || substr(md5('{mixing.SEED}|' || coalesce(source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM m),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0::DOUBLE END AS step FROM p),
n AS (SELECT *, count(*) OVER (PARTITION BY source, size) AS cell FROM d),
r AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % ceil(cell / {mixing.SLICE_ROWS}.0)::BIGINT AS cut FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, cut, doc_id) AS rank FROM r)
SELECT k.doc_id, k.size, q.source_size, q.target,
  (k.size * (floor(q.step) + least(floor((q.step - floor(q.step)) * k.rank + q.u) - floor((q.step - floor(q.step)) * (k.rank - 1) + q.u), 1)))::BIGINT AS taken
FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source"""


def _url_sql() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r), r))
    fits = []
    for r in rules:
        domain, _, start = r.partition("/")
        fits.append(f"WHEN (host = '{domain}' OR suffix(host, '.{domain}')) AND starts_with(path, '/{start}') THEN '{r}'")
    verdicts = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in url_filter.RULES.items())
    low = f"regexp_matches(low, '(^|[^a-z0-9])({'|'.join(url_filter.STRICT)})([^a-z0-9]|$)')"
    soft = " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT" for t in url_filter.SOFT)
    return f"""
WITH a AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN split_part(split_part(substr(url, instr(url, '://') + 3), '#', 1), '?', 1) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, {_LOWER.format("split_part(rest, '/', 1)")} AS host, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path, {_LOWER.format("coalesce(url, '')")} AS low FROM a),
c AS (SELECT *, CASE {' '.join(fits)} END AS rule, {low} AS strict, {soft} AS soft FROM b)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
  CASE {verdicts} WHEN strict OR soft >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict FROM c"""


_REACH = """reach(x, y) AS (SELECT id, id FROM node UNION SELECT r.x, p.b FROM reach r JOIN pair p ON r.y = p.a)"""

_NEAR_VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
pair AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= {hnsw_neardup.COSINE}),
node AS (SELECT vec_id AS id FROM v),
{_REACH},
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT a, count(*) AS n FROM pair GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON vec_id = x LEFT JOIN n ON vec_id = a"""

_NEAR_DOCUMENTS = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: list_aggregate(words[i:i+3], 'string_agg', ' '))
      WHEN len(words) > 0 THEN [list_aggregate(words, 'string_agg', ' ')] ELSE [] END AS grams FROM w),
s AS (SELECT doc_id, unnest(list_distinct(grams)) AS gram FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
joint AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
pair AS (SELECT a, b FROM joint JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * common >= 80 * (na.n + nb.n - common)),
node AS (SELECT doc_id AS id FROM documents),
{_REACH},
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON d.doc_id = x LEFT JOIN n ON n.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_hnsw_neardup": _NEAR_VECTORS, "op5_mixing": _mixing_sql(), "op8_url_filter": _url_sql(), "op10_minmax_neardup": _NEAR_DOCUMENTS}
