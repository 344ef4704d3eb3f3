"""Leaderboards of judged answers: mean scores, differences of turns, wins against other models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Score of an answer that the judge failed on.
FAILED = -1.0


def valid(judgments: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Judgments with a score; of the named models only, if any are named. A null score is none."""
    rows = judgments.where(F.col("score") != FAILED)
    return rows if models is None else rows.where(F.col("model").isin(models))


def mean_scores(judgments: DataFrame, *by: str, questions: DataFrame | None = None, models: list[str] | None = None) -> DataFrame:
    """(by..., score): the mean over the valid judgments, best first; with questions (question_id, category) to group by category.

    Every judgment weighs the same, whatever its turn. Questions are few and unique by question_id.
    """
    rows = valid(judgments, models)
    if questions is not None:
        rows = rows.join(F.broadcast(questions), "question_id")
    return rows.groupBy(*by).agg(F.avg("score").alias("score")).orderBy(F.desc("score"), *by)


def score_report(judgments: DataFrame, questions: DataFrame) -> DataFrame:
    """(model, turn, category, score) for every grouping of a leaderboard at once; null where all are taken together."""
    rows = valid(judgments).join(F.broadcast(questions), "question_id")
    sets = [["model", "turn"], ["model"], ["model", "turn", "category"], ["model", "category"]]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], "model", "turn", "category").agg(F.avg("score").alias("score"))


def turn_difference(judgments: DataFrame) -> DataFrame:
    """(model, score_1, score_2, diff) of models with valid scores in both turns."""
    of = lambda t: F.avg(F.when(F.col("turn") == t, F.col("score")))
    means = valid(judgments).groupBy("model").agg(of(1).alias("score_1"), of(2).alias("score_2"))
    both = means.where("score_1 is not null and score_2 is not null")
    return both.withColumn("diff", F.col("score_2") - F.col("score_1")).orderBy(F.desc("diff"), "model")


def run_average(judgments: DataFrame, questions: DataFrame) -> DataFrame:
    """(model, category, score): the mean over runs of each run's mean; category ``overall`` is the mean of the categories."""
    rows = valid(judgments).join(F.broadcast(questions), "question_id")
    runs = rows.groupBy("model", "category", "run").agg(F.avg("score").alias("score"))
    means = runs.groupBy("model", "category").agg(F.avg("score").alias("score"))
    return means.unionByName(means.groupBy("model").agg(F.lit("overall").alias("category"), F.avg("score").alias("score")))


def metric_average(runs: DataFrame) -> DataFrame:
    """(metric, value): the mean over the runs (run, metric, value)."""
    return runs.groupBy("metric").agg(F.avg("value").alias("value"))


def win_rates(judgments: DataFrame, models: list[str] | None = None, baseline: str | None = None) -> DataFrame:
    """(model, win, loss, tie, win_rate, loss_rate, win_rate_adjusted) of two-game pair judgments.

    Rows with an error in either game don't count; nor those whose model_1 isn't named, or without the baseline, which
    itself isn't in the result. A tie in the first game, or games that disagree, are a tie of both models.
    """
    rows = judgments.where("g1_winner != 'error' and g2_winner != 'error'")
    if models is not None:
        rows = rows.where(F.col("model_1").isin(models))
    if baseline is not None:
        rows = rows.where((F.col("model_1") == baseline) | (F.col("model_2") == baseline))
    tied = (F.col("g1_winner") == "tie") | (F.col("g1_winner") != F.col("g2_winner"))
    won = lambda name: F.when(tied, F.lit("tie")).when(F.col("g1_winner") == name, F.lit("win")).otherwise(F.lit("loss"))
    each = rows.select(F.explode(F.array(*(F.struct(F.col(m).alias("model"), won(m).alias("r")) for m in ("model_1", "model_2")))).alias("x")).select("x.*")
    count = lambda r: F.sum((F.col("r") == r).cast("bigint")).alias(r)
    out = each.groupBy("model").agg(count("win"), count("loss"), count("tie"))
    if baseline is not None:
        out = out.where(F.col("model") != baseline)
    n: Column = F.col("win") + F.col("loss") + F.col("tie")
    out = out.withColumn("win_rate", F.col("win") / n).withColumn("loss_rate", F.col("loss") / n).withColumn("win_rate_adjusted", (F.col("win") + 0.5 * F.col("tie")) / n)
    return out.orderBy(F.desc("win_rate_adjusted"), "model")


def average_length(answers: DataFrame) -> DataFrame:
    """(model, avg_tokens): the mean of token_len, cut to a whole number."""
    return answers.groupBy("model").agg(F.floor(F.avg("token_len")).cast("bigint").alias("avg_tokens"))


def previews(answers: DataFrame, width: int = 128) -> DataFrame:
    """(category, previews): for each category the questions as ``id: first signs...``, in the order of their ids."""
    text = F.concat(F.col("question_id").cast("string"), F.lit(": "), F.substring("text", 1, width), F.lit("..."))
    listed = F.sort_array(F.collect_list(F.struct("question_id", text.alias("p"))))
    return answers.groupBy("category").agg(F.transform(listed, lambda x: x["p"]).alias("previews"))
