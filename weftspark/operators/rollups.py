"""Averages of benchmark results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For each task its metric, whether it generates, and whether it belongs to the first leaderboard.
TASKS = {
    "hellaswag": ("acc_norm", False, True),
    "arc_challenge": ("acc_norm", False, True),
    "truthfulqa_mc2": ("acc", False, True),
    "winogrande": ("acc", False, True),
    "gsm8k": ("exact_match,strict-match", True, True),
    "mmlu": ("acc", False, True),
    "bbh_cot_fewshot_date_understanding": ("exact_match,get-answer", True, False),
    "bbh_cot_fewshot_movie_recommendation": ("exact_match,get-answer", True, False),
    "bbh_cot_fewshot_reasoning_about_colored_objects": ("exact_match,get-answer", True, False),
}
#: Tasks of the second leaderboard, with their metrics and what guessing scores.
SUBTASKS = {
    "leaderboard_bbh": (("acc_norm",), 0.2866),
    "leaderboard_gpqa": (("acc_norm",), 0.25),
    "leaderboard_ifeval": (("inst_level_strict_acc", "prompt_level_strict_acc"), 0.0),
    "leaderboard_math_hard": (("exact_match",), 0.0),
    "leaderboard_mmlu_pro": (("acc",), 0.10),
    "leaderboard_musr": (("acc_norm",), 0.3430),
}


def metric_name(name: Column) -> Column:
    """Without the mark of no filter."""
    return F.replace(name, F.lit(",none"), F.lit(""))


def first_averages(results: DataFrame) -> DataFrame:
    """(openllm_average, classification_average, generation_average, all_average) of results (task, metric, value); each task counts by its one metric."""
    rows = [(t, m, g, o) for t, (m, g, o) in TASKS.items()]
    tasks = results.sparkSession.createDataFrame(rows, "task string, name string, generates boolean, listed boolean")
    own = results.withColumn("name", metric_name(F.col("metric"))).join(F.broadcast(tasks), ["task", "name"])
    of = lambda c: F.avg(F.when(c, F.col("value")))
    return own.agg(of(F.col("listed")).alias("openllm_average"), of(~F.col("generates")).alias("classification_average"), of(F.col("generates")).alias("generation_average"), F.avg("value").alias("all_average"))


def normalized_scores(results: DataFrame) -> DataFrame:
    """(task, raw_score, norm_score) of results (task, metric, value as text); N/A is 0, and so is what is worse than guessing."""
    rows = [(t, m, b) for t, (metrics, b) in SUBTASKS.items() for m in metrics]
    tasks = results.sparkSession.createDataFrame(rows, "task string, name string, guess double")
    value = F.when(F.col("value") == "N/A", F.lit(0.0)).otherwise(F.col("value").try_cast("double"))
    own = results.withColumn("name", metric_name(F.col("metric"))).join(F.broadcast(tasks), ["task", "name"])
    raw = own.groupBy("task").agg(F.avg(value).alias("raw_score"), F.max("guess").alias("guess"))
    return raw.select("task", "raw_score", F.greatest(F.lit(0.0), (F.col("raw_score") - F.col("guess")) / (1 - F.col("guess"))).alias("norm_score"))


def second_average(results: DataFrame) -> DataFrame:
    """(openllm_v2_average): the mean of the tasks' normalized scores."""
    return normalized_scores(results).agg(F.avg("norm_score").alias("openllm_v2_average"))


def board_row(board: DataFrame, model: str) -> dict:
    """The one row of a leaderboard for the model, without mode; raises if there isn't just one."""
    found = board.where(F.col("model_name") == model).drop("mode").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{len(found)} rows for {model}")
    return found[0].asDict()
