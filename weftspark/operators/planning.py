"""What is to be judged or answered: matches, what is missing, temperatures and token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.operators.judging import REFERENCE_CATEGORIES, judge_name

#: Sampling temperature by category, and for any other.
TEMPERATURES = {"writing": 0.7, "roleplay": 0.7, "extraction": 0.0, "math": 0.0, "coding": 0.0, "reasoning": 0.0, "stem": 0.1, "humanities": 0.1, "arena-hard-200": 0.0}
DEFAULT_TEMPERATURE = 0.7
#: Tokens kept back from an answer's budget.
RESERVED = {"openai": 100, "other": 300}


def _turns(rows: DataFrame, pairwise: bool) -> DataFrame:
    both = rows.withColumn("multi_turn", F.explode(F.array(F.lit(False), F.lit(True))))
    return both.withColumn("judge", judge_name(F.col("category"), F.col("multi_turn"), pairwise))


def single_matches(questions: DataFrame, models: DataFrame) -> DataFrame:
    """(question_id, category, model, multi_turn, judge): every question for every model, in one and more turns. Both are small tables."""
    return _turns(questions.crossJoin(F.broadcast(models.select("model"))), False)


def pair_matches(questions: DataFrame, models: DataFrame) -> DataFrame:
    """(question_id, category, model_1, model_2, multi_turn, judge) for every two models, once."""
    a, b = models.selectExpr("model as model_1"), models.selectExpr("model as model_2")
    pairs = a.join(F.broadcast(b), F.col("model_1") < F.col("model_2"))
    return _turns(questions.crossJoin(F.broadcast(pairs)), True)


def baseline_matches(questions: DataFrame, models: DataFrame, baseline: str) -> DataFrame:
    """Matches of every other model with the baseline."""
    pairs = models.where(F.col("model") != baseline).select(F.col("model").alias("model_1"), F.lit(baseline).alias("model_2"))
    return _turns(questions.crossJoin(F.broadcast(pairs)), True)


def by_reference(questions: DataFrame) -> DataFrame:
    """Questions with ``needs_reference``: whether judging their category needs a reference answer."""
    return questions.withColumn("needs_reference", F.col("category").isin(*REFERENCE_CATEGORIES))


def missing(questions: DataFrame, models: DataFrame, answers: DataFrame) -> DataFrame:
    """(question_id, model) without an answer."""
    return pending(questions.select("question_id").crossJoin(F.broadcast(models.select("model"))), answers, "question_id", "model")


def complete(questions: DataFrame, models: DataFrame, answers: DataFrame) -> None:
    """Raises if any model has no answer to a question."""
    gaps = missing(questions, models, answers).limit(5).collect()
    if gaps:
        raise ValueError("no answer for " + ", ".join(f"{r.model}: {r.question_id}" for r in gaps))


def pending(rows: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """The rows whose key isn't among those done."""
    return rows.join(done.select(*key).distinct(), list(key), "left_anti")


def temperature(category: Column, required: Column | None = None) -> Column:
    """The required temperature, else that of the category, else the default."""
    table = F.create_map(*(F.lit(x) for pair in TEMPERATURES.items() for x in pair))
    own = F.try_element_at(table, category)
    return F.coalesce(*([required] if required is not None else []), own, F.lit(DEFAULT_TEMPERATURE)).cast("double")


def token_budget(most: Column, prompt_tokens: Column | None, api: str = "openai") -> Column:
    """Tokens left for an answer; all of them where the prompt wasn't counted."""
    return most if prompt_tokens is None else F.coalesce(most - prompt_tokens - RESERVED[api], most)
