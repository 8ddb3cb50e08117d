"""The queries of the training-data operators: each applies its operator, with
production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401

from .decontamination import leaks
from .html_text import extract_text
from .jaccard_join import jaccard_join
from .order_minhash import order_minhash
from .packing import best_fit_packing
from .pii import pii_digest
from .pitman_yor import language_scores
from .quality import quality_scores
from .toxicity import toxicity_scores
from .url_filter import url_verdicts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


#: The rules of the url query (fixed values).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op4_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"), words=3, threshold=(90, 100))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies; never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_html_text": op3_html_text,
    "op4_url_verdicts": op4_url_verdicts,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_pitman_yor": op7_pitman_yor,
    "op8_quality": op8_quality,
    "op9_order_minhash": op9_order_minhash,
    "op10_decontamination": op10_decontamination,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op5_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words),
classes AS (
  SELECT min(doc_id) AS cid, list_sort(s) AS key, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
items AS (SELECT cid, n, unnest(key) AS item FROM classes),
rare AS (SELECT *, count(*) OVER (PARTITION BY item) AS df FROM items),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY df, item) AS place FROM rare),
prefix AS (SELECT * FROM ranked WHERE place <= n - (n * 90 + 99) // 100 + 1),
cand AS (
  SELECT DISTINCT a.cid AS a, b.cid AS b FROM prefix a JOIN prefix b ON a.item = b.item AND a.cid < b.cid
  WHERE least(a.n, b.n) * 100 >= 90 * greatest(a.n, b.n)),
links AS (
  SELECT a, b FROM (
    SELECT cand.a, cand.b, len(list_intersect(x.key, y.key)) AS common, x.n + y.n AS total
    FROM cand JOIN classes x ON x.cid = cand.a JOIN classes y ON y.cid = cand.b)
  WHERE 100 * common >= 90 * (total - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT cid AS node, cid AS root FROM classes
  UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
comp AS (SELECT node, min(root) AS least FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.least, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON c.key = list_sort(s.s) LEFT JOIN comp m ON m.node = c.cid
""",
}
