"""The jobs as queries: each runs twice into a folder of its own below the shared one, and its output is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.plans.cuts import fresh_path
from fieldloom.queries import elimination_sql
from jobs import source_factors, speedups
from jobs.settings import read_config


def job1_speedups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "job1", keep=True)
    config = read_config(speedups.CONFIG, speedups.DEFAULTS)
    for _ in range(2):
        speedups.run(spark, f"{sf_dir}/events.parquet", f"{out}/report", config)
    return speedups.result(spark, f"{out}/report")


def job2_source_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "job2", keep=True)
    config = read_config(source_factors.CONFIG, source_factors.DEFAULTS)
    for _ in range(2):
        source_factors.run(spark, f"{sf_dir}/documents.parquet", f"{out}/factors", f"{out}/checkpoint", config)
    return source_factors.result(spark, f"{out}/factors")


_EDGE, _COLUMNS, _P = (read_config(source_factors.CONFIG, source_factors.DEFAULTS)[k] for k in ("edge", "columns", "prime"))
_SIZE = read_config(speedups.CONFIG, speedups.DEFAULTS)["size"]
_GRAM = rf"""
  WITH words AS (
    SELECT CASE WHEN coalesce(lang, '') = '' THEN 'none' ELSE lang END AS lang, CAST('0x' || md5(coalesce(source, ''))[1:8] AS BIGINT) % {_EDGE} AS i,
           unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM documents),
  a AS (SELECT lang, i, CAST('0x' || md5(word)[1:8] AS BIGINT) % {_COLUMNS} AS k, count(*) % {_P} AS v FROM words GROUP BY ALL),
  g AS (SELECT x.lang, x.i, y.i AS j, sum(x.v * y.v) % {_P} AS v FROM a x JOIN a y ON x.lang = y.lang AND x.k = y.k GROUP BY ALL)
  SELECT l.lang, r.i, c.j, CAST(coalesce(g.v, 0) AS BIGINT) AS v FROM (SELECT DISTINCT lang FROM a) l CROSS JOIN range({_EDGE}) r(i) CROSS JOIN range({_EDGE}) c(j) LEFT JOIN g ON g.lang = l.lang AND g.i = r.i AND g.j = c.j"""

QUERIES = {f.__name__: f for f in (job1_speedups, job2_source_factors)}
ORACLES = {
    "job1_speedups": f"""
WITH best AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS method, CAST(hour(ts) + 1 AS INT) AS threads, count(*) AS runs, min(value) AS real_s
  FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value > 0 AND value < 'infinity'::DOUBLE GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY day, method ORDER BY threads) - 1 AS INT) AS seq FROM best),
f AS (SELECT day, min(real_s) AS base FROM r WHERE seq = 0 GROUP BY day)
SELECT method, threads, seq, runs, real_s, base / real_s AS speedup_global, first_value(real_s) OVER (PARTITION BY day, method ORDER BY seq) / real_s AS speedup_own,
       CAST(2.0 * {_SIZE}::DOUBLE ** 3 / 3e9 AS DOUBLE) / real_s AS rate, day
FROM r JOIN f USING (day)""",
    "job2_source_factors": f"""
WITH gram AS ({_GRAM}), packed AS ({elimination_sql(_GRAM, str(_EDGE - 1), group='lang')})
SELECT i, j, gram.v AS gram, packed.v AS v, min(CASE WHEN i = j AND packed.v = 0 THEN i END) OVER (PARTITION BY lang) AS singular_at, lang FROM packed JOIN gram USING (lang, i, j)""",
}
