"""Averages over benchmark tasks and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.operators import leaderboard, rollups
from weftspark.plans import views
from weftspark.plans.registry import query

_NAMES = [(t, m + ("" if "," in m else ",none")) for t, (m, _, _) in rollups.TASKS.items()] + [("gsm8k", "exact_match,flexible"), ("other", "acc,none"), ("mmlu", "alias")]
_PARTS = [(t, m + ",none") for t, (ms, _) in rollups.SUBTASKS.items() for m in ms] + [("leaderboard_bbh", "acc,none"), ("leaderboard", "acc_norm,none")]


def _values(rows):
    return ", ".join(f"({i}, '{t}', '{m}')" for i, (t, m) in enumerate(rows))


def _results(spark, folder, names):
    """Results of tasks that stand for models' scores: means over parts, by the part's number."""
    scores = views.table(spark, folder, "part").groupBy((F.col("p_partkey") % len(names)).cast("int").alias("i")).agg((F.avg("p_size") / 50).alias("value"))
    table = spark.createDataFrame([(i, t, m) for i, (t, m) in enumerate(names)], "i int, task string, metric string")
    return table.join(scores, "i").select("task", "metric", "value")


def _results_sql(names):
    return f"SELECT task, metric, value FROM (VALUES {_values(names)}) n(i, task, metric) JOIN (SELECT p_partkey % {len(names)} AS i, avg(p_size) / 50 AS value FROM part GROUP BY ALL) USING (i)"


_OWN = ", ".join(f"('{t}', '{m}', {str(g).lower()}, {str(o).lower()})" for t, (m, g, o) in rollups.TASKS.items())


@query(
    "openllm_v1",
    f"SELECT round(avg(value) FILTER (o), 6) AS openllm_average, round(avg(value) FILTER (NOT g), 6) AS classification_average, round(avg(value) FILTER (g), 6) AS generation_average, round(avg(value), 6) AS all_average FROM ({_results_sql(_NAMES)}) r JOIN (VALUES {_OWN}) t(task, m, g, o) ON r.task = t.task AND replace(r.metric, ',none', '') = t.m",
)
def openllm_v1(spark, folder):
    out = rollups.first_averages(_results(spark, folder, _NAMES))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


_SUB = ", ".join(f"('{t}', '{m}', CAST({b} AS DOUBLE))" for t, (ms, b) in rollups.SUBTASKS.items() for m in ms)
_NORM = (
    f"SELECT task, raw_score, greatest(0, (raw_score - b) / (1 - b)) AS norm_score FROM (SELECT r.task, avg(CASE WHEN r.task = 'leaderboard_gpqa' THEN 0 ELSE value END) AS raw_score, max(b) AS b FROM ({_results_sql(_PARTS)}) r"
    f" JOIN (VALUES {_SUB}) t(task, m, b) ON r.task = t.task AND replace(r.metric, ',none', '') = t.m GROUP BY r.task)"
)


def _texts(spark, folder):
    rows = _results(spark, folder, _PARTS)
    return rows.withColumn("value", F.when(F.col("task") == "leaderboard_gpqa", "N/A").otherwise(F.col("value").cast("string")))


@query("openllm_v2_tasks", f"SELECT task, round(raw_score, 6) AS raw_score, round(norm_score, 6) AS norm_score FROM ({_NORM})")
def openllm_v2_tasks(spark, folder):
    return rollups.normalized_scores(_texts(spark, folder)).select("task", F.round("raw_score", 6).alias("raw_score"), F.round("norm_score", 6).alias("norm_score"))


@query("openllm_v2", f"SELECT round(avg(norm_score), 6) AS openllm_v2_average FROM ({_NORM})")
def openllm_v2(spark, folder):
    return rollups.second_average(_texts(spark, folder)).select(F.round("openllm_v2_average", 6).alias("openllm_v2_average"))


@query("runs_average", "SELECT metric, round(avg(value), 6) AS value FROM (SELECT event_type AS metric, user_id % 3 AS run, avg(value) AS value FROM events GROUP BY ALL) GROUP BY metric")
def runs_average(spark, folder):
    runs = views.table(spark, folder, "events").groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 3).alias("run")).agg(F.avg("value").alias("value"))
    return leaderboard.metric_average(runs).withColumn("value", F.round("value", 6))
