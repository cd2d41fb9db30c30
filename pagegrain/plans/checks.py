"""Queries over benchmark runs: rules, reports, the synthetic corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bench, profile
from . import views
from .catalog import query
from .views import sql, table

query("case_execution_rules", lambda k, d: bench.first_violation(views.run(k, d)), sql("""SELECT * FROM (SELECT case_id, invocation_index, CASE WHEN expected_execution = 'model_required' THEN CASE
  WHEN model_calls < 1 THEN 'no call' WHEN shortcut_count > 0 THEN 'shortcut taken' WHEN tile_count > 0 AND active_tile_count > tile_count THEN 'more active tiles than tiles'
  WHEN tile_count > 1 AND active_tile_count >= 1 AND model_calls <> active_tile_count THEN 'calls differ from active tiles' WHEN cluster_count > 1 AND (crops <> cluster_count OR model_calls <> cluster_count) THEN 'calls or crops differ from clusters'
  WHEN cluster_count > 1 AND crop_w > 512 THEN 'crop beyond image' END
  WHEN expected_type IS NULL THEN 'unknown expected type' WHEN model_calls <> 0 THEN 'call in shortcut' WHEN shortcut_count <> 1 THEN 'not one shortcut' WHEN taken <> expected_type THEN 'other shortcut type' END AS violation FROM run) WHERE violation IS NOT NULL""", "invocation", "run"))


def _cases(k: SparkSession, d: str) -> DataFrame:
    """Stored cases of the runs; the number in a case's id says what is wrong with it."""
    rows = views.run(k, d).withColumn("k", F.col("user_id") % 20)
    of = [e for m in bench.COUNTS for e in (F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"), F.round(F.avg(m), 2).alias(f"{m}_mean"), (F.min(m) == F.max(m)).alias(f"{m}_invariant"))]
    got = rows.groupBy("case_id", "k").agg(F.count("*").alias("timing_count"), F.sum("model_calls").alias("model_calls_total"), *of)
    wrong = lambda k_, value, name: F.when(F.col("k") == k_, value).otherwise(F.col(name))
    got = got.withColumns({"status": F.when(F.col("k") == 1, "error").otherwise("ok"), "level": F.when(F.col("k") == 2, "level9").otherwise("level3_e2e"), "per_invocation": F.when(F.col("model_calls_invariant"), F.col("model_calls_min"))})
    return got.withColumns({"timing_count": wrong(3, F.col("timing_count") + 1, "timing_count"), "model_calls_total": wrong(4, F.col("model_calls_total") - 1, "model_calls_total"), "cluster_count_mean": wrong(6, F.col("cluster_count_mean") + 1, "cluster_count_mean"), "tile_count_max": wrong(7, F.lit(99), "tile_count_max"), "per_invocation": wrong(8, F.lit(77), "per_invocation")})


query("case_payload_rules", lambda k, d: bench.payload_violation(_cases(k, d), views.run(k, d)), sql("""+ c AS (SELECT case_id, user_id % 20 AS k, bool_and(latency_ms >= 0 AND isfinite(latency_ms)) AS finite FROM run GROUP BY ALL)
SELECT case_id, violation FROM (SELECT case_id, CASE WHEN k = 1 THEN 'status' WHEN k = 2 THEN 'level' WHEN k = 3 THEN 'timing.count' WHEN NOT finite THEN 'latency' WHEN k = 4 THEN 'model_calls_total' WHEN k = 6 THEN 'summary.cluster_count' WHEN k = 7 THEN 'summary.tile_count' WHEN k = 8 THEN 'per_invocation' END AS violation FROM c) WHERE violation IS NOT NULL""", "invocation", "run"))


def _run_cases(k: SparkSession, d: str) -> DataFrame:
    c = views.run(k, d).select(F.split("case_id", "_")[0].alias("run_id"), "case_id", F.when(F.col("user_id") % 20 == 1, "error").otherwise("ok").alias("status")).distinct()
    return c.unionByName(c.where("case_id = 'purchase_3'"))


def _stored(k: SparkSession, d: str) -> DataFrame:
    got, r = bench.run_summary(_run_cases(k, d)), F.col("run_id")
    return got.withColumns({"schema_version": F.when(r == "view", "1.0").otherwise("1.2.6"), "total_cases": F.when(r == "click", 1).otherwise(F.col("total_cases")), "error_cases": F.when(r == "signup", 9).otherwise(F.col("error_cases"))})


RUN_CASES = "+ c0 AS (SELECT DISTINCT split_part(case_id, '_', 1) AS run_id, case_id, CASE WHEN user_id % 20 = 1 THEN 'error' ELSE 'ok' END AS status FROM run), c AS (SELECT * FROM c0 UNION ALL SELECT * FROM c0 WHERE case_id = 'purchase_3') "
query("run_summary", lambda k, d: bench.run_summary(_run_cases(k, d)), sql(RUN_CASES + "SELECT run_id, count(*) AS total_cases, count(*) FILTER (WHERE status = 'ok') AS ok_cases, count(*) FILTER (WHERE status = 'error') AS error_cases FROM c GROUP BY run_id", "invocation", "run"))
query("run_payload_rules", lambda k, d: bench.run_violation(_stored(k, d), _run_cases(k, d), "1.2.6"), sql(RUN_CASES + """SELECT run_id, CASE run_id WHEN 'view' THEN 'schema_version' WHEN 'click' THEN 'total_cases' WHEN 'signup' THEN 'error_cases' ELSE 'duplicate case_id' END AS violation FROM c
WHERE run_id IN ('view', 'click', 'signup') OR run_id IN (SELECT run_id FROM c GROUP BY run_id, case_id HAVING count(*) > 1) GROUP BY run_id""", "invocation", "run"))
query("ordered_types", lambda k, d: bench.ordered_types(views.run(k, d)), sql("SELECT case_id, string_agg(taken, ',' ORDER BY first) AS types FROM (SELECT case_id, taken, min(invocation_index) AS first FROM run WHERE shortcut_count = 1 GROUP BY ALL) GROUP BY case_id", "invocation", "run"))


def _slowest(k: SparkSession, d: str) -> DataFrame:
    stats = bench.timing_stats(views.invocation(k, d)).withColumn("level", F.split("case_id", "_")[0])
    return bench.top_cases(stats, "level", "p95_ms", 5).select("level", "case_id", "place", "more")


query("top_cases", _slowest, sql("""+ s AS (SELECT split_part(case_id, '_', 1) AS level, case_id, round(quantile_cont(latency_ms, 0.95), 4) AS p FROM invocation GROUP BY ALL)
SELECT level, case_id, CAST(row_number() OVER w AS INTEGER) AS place, greatest(0, count(*) OVER (PARTITION BY level) - 5) AS more FROM s WINDOW w AS (PARTITION BY level ORDER BY p DESC, case_id) QUALIFY place <= 5""", "invocation"))
query("sweep_union", lambda k, d: bench.sweep({n: bench.invariant_calls(views.invocation(k, d).where(F.col("event_id") % 2 == n - 1)) for n in (1, 2)}), sql("SELECT '[' || (event_id % 2 + 1) || 'T] ' || case_id AS case_id, CAST(sum(model_calls) AS BIGINT) AS total, CASE WHEN min(model_calls) = max(model_calls) THEN min(model_calls) END AS per_invocation FROM invocation GROUP BY case_id, event_id % 2", "invocation"))
query("corpus_matrix", lambda k, d: bench.corpus_matrix(k), """WITH s AS (SELECT unnest([128, 256, 384, 512, 640, 768, 1024, 1536, 1000, 300, 1600, 300]) AS width, unnest([128, 256, 384, 512, 640, 768, 1024, 1024, 300, 1000, 300, 1600]) AS height),
m AS (SELECT unnest(['M1_bubble_10pct', 'M2_bubble_25pct', 'M3_bubble_50pct', 'M4_thin_horizontal', 'M5_thin_vertical', 'M6_irregular_blob', 'M7_disconnected_multi', 'M8_clustered_multi']) AS mask_type)
SELECT width, height, mask_type, CAST(42 + width * 1000 + height * 10 + length(mask_type) AS INTEGER) AS seed, 'model_required' AS expected_execution FROM s, m UNION ALL SELECT 256, 256, t, CAST(42 + 256000 + 2560 + length(t) AS INTEGER), 'shortcut' FROM (SELECT unnest(['white', 'black', 'low_std']) AS t)""")
NAMES = "CASE p_size % 7 WHEN 0 THEN 'benchmark_result.json' WHEN 1 THEN 'baseline.json' WHEN 2 THEN 'results.json' WHEN 3 THEN 'notes.txt' ELSE p_name || '.json' END"
query("baseline_locator", lambda k, d: bench.baseline_file(table(k, d, "part").select(F.expr("p_partkey div 2").alias("folder"), F.expr(NAMES.replace("p_name || '.json'", "concat(p_name, '.json')")).alias("name"))), f"""WITH l AS (SELECT p_partkey // 2 AS folder, {NAMES} AS name FROM part),
r AS (SELECT folder, arg_min(name, rank) FILTER (WHERE rank < 4) AS best, any_value(name) FILTER (WHERE name LIKE '%.json') AS one, count(*) FILTER (WHERE name LIKE '%.json') AS n FROM (SELECT *, coalesce(list_position(['benchmark_result.json', 'results.json', 'baseline.json', 'result.json'], name), 9) - 1 AS rank FROM l) GROUP BY folder)
SELECT folder, coalesce(best, CASE WHEN n = 1 THEN one END) AS name, CASE WHEN n = 0 THEN 'none' WHEN best IS NULL AND n > 1 THEN 'ambiguous' END AS error FROM r""")
query("memory_span", lambda k, d: profile.memory_span(table(k, d, "events"), "user_id", ["ts", "event_id"], "value"), "SELECT user_id, arg_min(value, (ts, event_id)) AS start, max(value) AS peak, arg_max(value, (ts, event_id)) AS finish FROM events GROUP BY user_id")
