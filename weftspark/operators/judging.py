"""Verdicts of judges: read from their texts, put into one form, kept once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIE_DELTA = 0.1
#: Forms in which a judge gives a score, and categories whose judging needs a reference answer.
SCORE, SCORE_BACKUP = r"\[\[(\d+\.?\d*)\]\]", r"\[(\d+\.?\d*)\]"
SCORES, SCORES_BACKUP = r"\[\[(\d+\.?\d*),\s?(\d+\.?\d*)\]\]", r"\[(\d+\.?\d*),\s?(\d+\.?\d*)\]"
ARENA_VERDICT = r"\[\[([AB<>=]+)\]\]"
REFERENCE_CATEGORIES = ("math", "reasoning", "coding", "arena-hard-200")


def score_of(text: Column) -> Column:
    """The first score in double brackets, else in single ones, else -1."""
    first = F.nullif(F.regexp_extract(text, SCORE, 1), F.lit(""))
    second = F.nullif(F.regexp_extract(text, SCORE_BACKUP, 1), F.lit(""))
    return F.coalesce(first.try_cast("double"), second.try_cast("double"), F.lit(-1.0))


def pair_verdict(text: Column) -> Column:
    """A, B, tie or error, by the first of [[A]], [[B]] and [[C]] that the text has anywhere."""
    has = lambda mark: F.contains(text, F.lit(mark))
    return F.when(has("[[A]]"), "A").when(has("[[B]]"), "B").when(has("[[C]]"), "tie").otherwise("error")


def score_verdict(text: Column) -> Column:
    """A, B, tie or error, by two scores in one pair of double brackets, else of single ones; within TIE_DELTA they tie."""
    part = lambda i: F.coalesce(*(F.nullif(F.regexp_extract(text, p, i), F.lit("")) for p in (SCORES, SCORES_BACKUP))).try_cast("double")
    a, b = part(1), part(2)
    return F.when(a.isNull() | b.isNull(), "error").when(F.abs(a - b) <= TIE_DELTA, "tie").when(a > b, "A").otherwise("B")


def arena_verdict(text: Column) -> Column:
    """Struct (score, again): the verdict if the text has just one; whether to ask again, as there is none at all."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(ARENA_VERDICT), F.lit(1)), lambda x: x != ""))
    return F.struct(F.when(F.size(found) == 1, F.element_at(found, 1)).alias("score"), (F.size(found) == 0).alias("again"))


def winner_of(verdict: Column, swapped: bool) -> Column:
    """The model that A or B stands for; in the swapped game A is model_2."""
    a, b = ("model_2", "model_1") if swapped else ("model_1", "model_2")
    return F.when(verdict == "A", a).when(verdict == "B", b).otherwise(verdict)


def last_of(rows: DataFrame, *key: str, order: str = "line") -> DataFrame:
    """For each key the row with the highest order, of equal ones the greatest: in files to which rows were appended, the last counts."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct(F.col(order).alias("__order"), *rest)).alias("r")).select(*key, *(f"r.{c}" for c in rest))


def pairs_normalized(judgments: DataFrame) -> DataFrame:
    """(question_id, model_1, model_2, winner, g1_judgment, g2_judgment), model_1 before model_2, the last line of each key.

    A line without a winner of its own has that of its games if they agree, else ``inconsistent``. Names out of order
    are swapped, with the winner and the judgments. The last line is chosen by the names as written, then as sorted.
    """
    games = F.when(F.col("g1_winner") == F.col("g2_winner"), F.col("g1_winner")).otherwise(F.lit("inconsistent"))
    own = F.coalesce(F.col("winner"), games) if "winner" in judgments.columns else games
    swap = F.col("model_1") >= F.col("model_2")
    other = F.when(F.col("w") == "model_1", "model_2").when(F.col("w") == "model_2", "model_1").otherwise(F.col("w"))
    rows = judgments.withColumn("w", own).select(
        "line",
        "question_id",
        F.least("model_1", "model_2").alias("model_1"),
        F.greatest("model_1", "model_2").alias("model_2"),
        F.when(swap, other).otherwise(F.col("w")).alias("winner"),
        F.when(swap, F.col("g2_judgment")).otherwise(F.col("g1_judgment")).alias("g1_judgment"),
        F.when(swap, F.col("g1_judgment")).otherwise(F.col("g2_judgment")).alias("g2_judgment"),
    )
    return last_of(rows, "question_id", "model_1", "model_2").drop("line")


def judge_name(category: Column, multi_turn: Column, pairwise: bool = False) -> Column:
    """Name of the judge prompt for a question: math prompts for categories with references, and those for more turns."""
    kind = "pair" if pairwise else "single"
    plain = f"{kind}-v{2 if pairwise else 1}"
    base = F.when(category.isin(*REFERENCE_CATEGORIES), f"{kind}-math-v1").otherwise(plain)
    return F.when(multi_turn, F.concat(base, F.lit("-multi-turn"))).otherwise(base)


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """A prompt with its ``{name}`` places filled; places without a value stay, null values are empty."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def explanation(model: Column, score: Column, judgment: Column) -> Column:
    """Text of a single judgment for reading; N/A where there is none."""
    text = F.concat(F.lit("**Game 1**. **A**: "), model, F.lit(", **Score**: "), score.cast("string"), F.lit("\n\n**Judgment**: "), judgment)
    return F.coalesce(text, F.lit("N/A"))


def pair_explanation(model_1: Column, model_2: Column, first: Column, second: Column) -> Column:
    """Text of both games of a pair judgment for reading; N/A where there is none."""
    game = lambda n, a, b, j: F.concat(F.lit(f"**Game {n}**. **A**: "), a, F.lit(", **B**: "), b, F.lit("\n\n**Judgment**: "), j)
    return F.coalesce(F.concat(game(1, model_1, model_2, first), F.lit("\n\n`--------------------------`\n\n"), game(2, model_2, model_1, second)), F.lit("N/A"))


def markdown_fixed(text: Column) -> Column:
    """Bullet signs as dashes, and no blank line before the entries of a list."""
    dashed = F.replace(text, F.lit("•"), F.lit("- "))
    return F.regexp_replace(F.regexp_replace(dashed, r"\n\n(\d+\. )", "\n$1"), r"\n\n- ", "\n- ")
