"""Relations of the domain, made from the test tables by SQL that Spark and
DuckDB both read, so that a query and its oracle start from the same rows.
Secrets are planted by rule, for the plain tables hold none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "labels", "conversations", "benchmark", "pages", "part", "supplier", "nation", "region", "events")
_MD5 = "md5(CAST(doc_id AS STRING))"
_TOKEN = "aB3xK9mP7qR4vN2wZ8sT5uY1"
_TURNED = f"concat(substr('{_TOKEN}', CAST(1 + doc_id % 24 AS INT)), substr('{_TOKEN}', 1, CAST(doc_id % 24 AS INT)))"
_PATH = """concat(CASE doc_id % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'crates/core/src/' WHEN 2 THEN 'docs/' ELSE '' END, source,
  CASE doc_id % 7 WHEN 0 THEN '/mod' WHEN 1 THEN concat('/', lang, '_util') WHEN 2 THEN '/.env' WHEN 3 THEN '/lib' ELSE concat('-', lang, '/', source) END,
  CASE doc_id % 5 WHEN 0 THEN '.rs' WHEN 1 THEN '.toml' WHEN 2 THEN '.md' WHEN 3 THEN '' ELSE '.json' END)"""

SQL = {
    "sections": """SELECT conv_id AS pack_id, turn AS ord, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS priority,
  concat(role, '-', CAST(turn AS STRING)) AS name, text AS content, CAST(ceil(length(text) / CAST(4 AS DOUBLE)) AS BIGINT) AS token_estimate FROM {conversations}""",
    "paths": f"SELECT doc_id, lang, source, {_PATH} AS path FROM {{documents}}",
    "secrets": f"""SELECT doc_id, lang, {_PATH} AS path, concat(text, CASE doc_id % 9
  WHEN 0 THEN concat(' key AKIA', upper(substr({_MD5}, 1, 16)), ' end') WHEN 1 THEN concat(' ghp_', {_MD5}, 'abcd x')
  WHEN 2 THEN concat(' sk-ant-', {_MD5}, '-z') WHEN 3 THEN concat(' password = "', {_TURNED}, '" ok') WHEN 4 THEN concat(' xoxb-', {_MD5})
  WHEN 5 THEN concat('eyJ', {_MD5}, '.eyJ', {_MD5}, '.abc-d_e!') WHEN 6 THEN concat(' hf_', {_MD5}, ' API_KEY=', {_TURNED})
  WHEN 7 THEN concat(' AKIA', upper(substr({_MD5}, 1, 16)), ' AKIA', upper(substr({_MD5}, 17, 16)), ' DB_PASSWORD=', {_TURNED}) ELSE '' END) AS text FROM {{documents}}""",
    "findings": f"""SELECT d.lang AS pack_id, d.doc_id AS ord, CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE concat('f-', CAST(d.doc_id AS STRING)) END AS id,
  {_PATH.replace("doc_id", "d.doc_id")} AS primary_path, CASE d.doc_id % 6 WHEN 0 THEN 'doc_drift_link' WHEN 1 THEN NULL ELSE 'api_change' END AS kind,
  CASE WHEN l.quality IS NULL THEN NULL ELSE CAST(d.doc_id % 97 AS DOUBLE) / 100 END AS confidence,
  CASE l.toxic WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE NULL END AS severity, CASE d.doc_id % 3 WHEN 0 THEN 'tier1' ELSE NULL END AS tier,
  CASE d.doc_id % 4 WHEN 0 THEN substr(d.text, 1, 30) ELSE NULL END AS evidence, CASE d.doc_id % 5 WHEN 0 THEN 'review' ELSE NULL END AS suggested_action
  FROM {{documents}} d LEFT JOIN {{labels}} l ON l.doc_id = d.doc_id""",
    "members": "SELECT p_brand AS name, concat('crates/', lower(p_brand)) AS dir FROM (SELECT DISTINCT p_brand FROM {part})",
    "dependencies": """SELECT concat(CASE p_partkey % 3 WHEN 0 THEN p_brand ELSE p_type END, '') AS name,
  CASE p_partkey % 5 WHEN 0 THEN 'dev' WHEN 1 THEN 'build' ELSE NULL END AS raw_kind, p_partkey FROM {part}""",
    "events": f"""SELECT doc_id AS seq, {_PATH} AS path, CASE doc_id % 3 WHEN 0 THEN 'diff' WHEN 1 THEN 'files_from' ELSE concat('impact_scope:f-', source) END AS source,
  doc_id % 5 <> 0 AS allowed, CASE WHEN doc_id % 10 = 0 THEN '--exclude-path' ELSE NULL END AS reason FROM {{documents}}""",
    "patches": f"""SELECT doc_id, concat('diff --git a/', {_PATH}, ' b/', {_PATH}, chr(10), 'index 1..2 100644', chr(10), '--- a/x', chr(10), '+++ b/x', chr(10),
  '@@ -', CAST(doc_id AS STRING), ',3 +', CAST(doc_id + 2 AS STRING), ',4 @@ fn', chr(10), ' ctx ', substr(replace(text, chr(10), ' '), 1, 40), chr(10), '+added', chr(10), '--- comment gone', chr(10),
  '@@ -9 +x,y @@', chr(10), '-old', chr(10), 'diff --git a/q b/q', chr(10), 'Binary files a and b differ', chr(10), 'diff --git a/z b/dir b/z.rs', chr(10), '@@ -1 +1 @@', chr(10), '+last', chr(10)) AS patch FROM {{documents}}""",
    "messages": """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'garbage' WHEN 2 THEN '{{"reason":"build-finished","success":false}}' ELSE
  concat('{{"reason":"compiler-message","message":{{"message":"m', CAST(doc_id AS STRING), '","level":"', CASE doc_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'failure-note' ELSE 'error: internal compiler error' END,
  '","code":', CASE doc_id % 3 WHEN 0 THEN '{{"code":"E0308"}}' ELSE 'null' END, ',"spans":[{{"file_name":"src/', source, '.rs","line_start":', CAST(doc_id AS STRING), ',"line_end":9,"column_start":5,"column_end":12,"is_primary":', CASE doc_id % 2 WHEN 0 THEN 'true' ELSE 'false' END, '}}],"rendered":"r"}}}}') END AS line, lang FROM {documents}""",
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in SQL[name]}
    return spark.sql(SQL[name], **tables)


def duck(name: str) -> str:
    """The relation as a DuckDB subquery."""
    return "(" + SQL[name].format(**{t: t for t in TABLES}) + ")"
