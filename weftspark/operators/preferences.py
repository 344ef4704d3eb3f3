"""Preference pairs from sampled answers, and their mixing with given pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.operators.mixing import SEED


def varied(rows: DataFrame, answers: str = "gen_answers") -> DataFrame:
    """Rows whose answers aren't all alike; rows without an answer can't be ranked and are dropped too."""
    return rows.where(F.size(F.array_distinct(answers)) > 1)


def best_worst(answers: Column, ranks: Column) -> Column:
    """Struct (best, worst, best_rank, worst_rank): the first answer of the lowest rank and the first of the highest; 1 is best."""
    low, high = F.array_min(ranks), F.array_max(ranks)
    at = lambda r: F.get(answers, (F.array_position(ranks, r) - 1).cast("int"))
    return F.struct(at(low).alias("best"), at(high).alias("worst"), low.alias("best_rank"), high.alias("worst_rank"))


def ranked_pairs(rows: DataFrame, answers: str = "gen_answers", ranks: str = "ranks", messages: str = "prompt_messages") -> DataFrame:
    """Rows with chosen, rejected and messages: the prompt with the best and with the worst answer; ranks in best_rank and worst_rank."""
    say = lambda text: F.array(F.struct(F.lit("assistant").alias("role"), text.alias("content")))
    picked = rows.withColumn("__p", best_worst(F.col(answers), F.col(ranks)))
    chosen = F.concat(F.col(messages), say(F.col("__p.best")))
    out = picked.withColumns({"chosen": chosen, "rejected": F.concat(F.col(messages), say(F.col("__p.worst"))), "messages": chosen, "best_rank": F.col("__p.best_rank"), "worst_rank": F.col("__p.worst_rank")})
    return out.drop("__p", ranks)


def unambiguous(rows: DataFrame, key: str = "prompt_id") -> DataFrame:
    """The rows whose key no other row has. Counted with partial aggregation, so that a placeholder key is no hot group."""
    payload = [c for c in rows.columns if c != key]
    once = rows.groupBy(key).agg(F.count("*").alias("__n"), F.first(F.struct(*payload)).alias("__r")).where("__n = 1")
    return once.select(key, "__r.*").select(rows.columns)


def augmented_ids(generated: DataFrame, original: DataFrame, p_pair: float, p_chosen: float, seed: int = SEED) -> DataFrame:
    """(prompt_id, use): the ids in both tables that take the original pair or its chosen answer.

    Of the n common ids int(n * (p_pair + p_chosen)) are drawn, and of those the first int(drawn * p_pair) take the pair.
    The order is by md5 of seed and id; ranks are taken in blocks of it.
    """
    from pyspark.sql import Window

    common = generated.select("prompt_id").where("prompt_id is not null").distinct().join(original.select("prompt_id").distinct(), "prompt_id", "left_semi")
    n = common.count()
    drawn = int(n * (p_pair + p_chosen))
    pairs = int(drawn * p_pair)
    keyed = common.withColumn("o", F.md5(F.concat_ws(":", F.lit(str(seed)), "prompt_id"))).withColumn("b", F.substring("o", 1, 3))
    sizes = keyed.groupBy("b").agg(F.count("*").alias("n"))
    before = sizes.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("b").orderBy("o", "prompt_id"))
    placed = keyed.withColumn("r", rank).join(F.broadcast(before), "b").withColumn("rank", F.col("before") + F.col("r")).where(F.col("rank") <= drawn)
    return placed.select("prompt_id", F.when(F.col("rank") <= pairs, "pair").otherwise("chosen").alias("use"))


def mixed_original(generated: DataFrame, original: DataFrame, p_pair: float, p_chosen: float, seed: int = SEED) -> DataFrame:
    """Generated rows (prompt_id, chosen, rejected, ...), some with the original pair and some with the original chosen answer.

    Originals whose prompt_id comes more than once take no part. Other columns stay those of the generated rows; ``use``
    says what was taken: pair, chosen or null.
    """
    known = unambiguous(original.select("prompt_id", "chosen", "rejected").where("prompt_id is not null"))
    use = augmented_ids(generated, known, p_pair, p_chosen, seed)
    taken = use.join(known.selectExpr("prompt_id", "chosen as __chosen", "rejected as __rejected"), "prompt_id")
    out = generated.join(taken, "prompt_id", "left")
    chosen = F.when(F.col("use").isNotNull(), F.col("__chosen")).otherwise(F.col("chosen"))
    rejected = F.when(F.col("use") == "pair", F.col("__rejected")).otherwise(F.col("rejected"))
    return out.withColumns({"chosen": chosen, "rejected": rejected}).drop("__chosen", "__rejected")
