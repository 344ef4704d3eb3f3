"""One ranking from pairwise verdicts: the stationary distribution of a comparison Markov chain, by power iteration.

From a model the chain goes to another with the rate at which the other won their comparisons: wins and half the ties by
the number of verdicts, smoothed by half a win for each side, so that it doesn't matter how often a pair met. If
p(i beats j) = s_i / (s_i + s_j), detailed balance gives s as the stationary distribution. Every model is also joined to
an imagined one by even rates, so that models without a loss, a win or a verdict have a strength.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.session import checkpointed

TOLERANCE, MOST_STEPS = 1e-13, 2_000_000
#: Pairs of models up to which the chain is iterated on the driver; beyond, over DataFrames, to a wider tolerance.
DRIVER_PAIRS = 200_000
WIDE_TOLERANCE, MOST_ROUNDS, ROUNDS_A_CHECKPOINT = 1e-6, 2000, 10
#: Half wins that each side of a pair has besides its own.
SMOOTHING = 0.5


def stationary(wins: np.ndarray) -> np.ndarray:
    """Stationary distribution for the rate wins[i, j] of i over j; raises if the iteration doesn't converge."""
    n = len(wins)
    lost = wins.T  # from the loser to the winner
    step = lost / (1.001 * lost.sum(axis=1).max())
    step[np.arange(n), np.arange(n)] = 1 - (step.sum(axis=1) - np.diag(step))
    p = np.full(n, 1 / n)
    power, steps = step, 1
    while steps <= MOST_STEPS:
        after = p @ power
        after /= after.sum()
        if np.abs(after @ step - after).max() <= TOLERANCE * after.max() and np.abs(after / p - 1).max() < 1e-10:
            return after
        p = after
        power, steps = power @ power, steps * 2  # so many steps of the chain at once
        power /= power.sum(axis=1, keepdims=True)
    raise ArithmeticError("power iteration did not converge")


def compared(battles: DataFrame) -> DataFrame:
    """(a, b, points, n) for each two models that met, a before b: verdicts and points of a, with half a point for a tie.

    A battle_id counts once, its earliest row; rows without a verdict, and a model against itself, say nothing of a
    strength, and models of such rows only come as (a, null, 0, 0), as do all models once.
    """
    verdict = F.lower(F.trim("winner"))
    once = battles.select("battle_id", "model_a", "model_b", verdict.alias("v"), "tstamp").groupBy("battle_id").agg(F.min(F.struct("tstamp", "model_a", "model_b", "v")).alias("b")).select("b.*")
    won = F.when(F.col("v") == "model_a", 1.0).when(F.col("v") == "model_b", 0.0).when(F.col("v").rlike(r"^tie\b"), 0.5)
    swap = F.col("model_a") > F.col("model_b")
    told = once.withColumn("won", won).where("won is not null and model_a != model_b")
    pairs = told.select(F.least("model_a", "model_b").alias("a"), F.greatest("model_a", "model_b").alias("b"), F.when(swap, 1 - F.col("won")).otherwise(F.col("won")).alias("won"))
    every = once.select(F.explode(F.array("model_a", "model_b")).alias("a")).where("a is not null").distinct()
    zero = F.lit(0.0).alias("points"), F.lit(0).cast("bigint").alias("n")
    return pairs.groupBy("a", "b").agg(F.sum("won").alias("points"), F.count("*").alias("n")).unionByName(every.select("a", F.lit(None).cast("string").alias("b"), *zero))


def _iterated(pairs: DataFrame) -> DataFrame:
    """(model, strength) of all models over DataFrames; the imagined model is the empty name."""
    rate = lambda w: (w + SMOOTHING) / (F.col("n") + 2 * SMOOTHING)
    met, alone = pairs.where("b is not null"), pairs.where("b is null").select("a")
    edges = met.select(F.col("a").alias("i"), F.col("b").alias("j"), rate(F.col("n") - F.col("points")).alias("r")).unionByName(met.select(F.col("b").alias("i"), F.col("a").alias("j"), rate(F.col("points")).alias("r")))
    edges = edges.unionByName(alone.selectExpr("a as i", "'' as j", "0.5D as r")).unionByName(alone.selectExpr("'' as i", "a as j", "0.5D as r"))
    leaves = edges.groupBy("i").agg(F.sum("r").alias("out"))
    most = 1.001 * leaves.agg(F.max("out")).collect()[0][0]
    edges = edges.select("i", "j", (F.col("r") / most).alias("r")).unionByName(leaves.select("i", F.col("i").alias("j"), (1 - F.col("out") / most).alias("r")))
    edges = checkpointed(edges.repartition("i"))
    n = leaves.count()
    p = leaves.select(F.col("i").alias("model"), F.lit(1.0 / n).alias("p"))
    for _ in range(MOST_ROUNDS // ROUNDS_A_CHECKPOINT):
        before = p
        for _ in range(ROUNDS_A_CHECKPOINT):
            p = edges.join(p, edges.i == p.model).groupBy("j").agg(F.sum(F.col("r") * F.col("p")).alias("p")).withColumnRenamed("j", "model")
        p = checkpointed(p)
        far = p.join(before.withColumnRenamed("p", "q"), "model").agg(F.max(F.abs(F.col("p") / F.col("q") - 1))).collect()[0][0]
        if far is not None and far < WIDE_TOLERANCE:
            return p
    raise ArithmeticError("power iteration did not converge")


def ranking(battles: DataFrame) -> DataFrame:
    """(place, model, strength, n_verdicts): every model of a battle, the best first; strengths sum to 1. Equal ones go by name.

    Only the points of pairs of models are gathered on the driver, up to DRIVER_PAIRS; more are iterated where they are.
    """
    spark = battles.sparkSession
    pairs = checkpointed(compared(battles))
    if pairs.count() > DRIVER_PAIRS:
        from pyspark.sql import Window

        p = _iterated(pairs).where("model != ''")
        seen = pairs.select(F.explode(F.array("a", "b")).alias("model"), "n").where("model is not null").groupBy("model").agg(F.sum("n").alias("n_verdicts"))
        place = F.row_number().over(Window.orderBy(F.desc("strength"), "model"))  # a row a model
        total = F.sum("p").over(Window.partitionBy())
        return p.select("model", (F.col("p") / total).alias("strength")).join(seen, "model").select(place.alias("place"), "model", "strength", "n_verdicts")
    rows = pairs.collect()
    models = sorted({m for r in rows for m in (r.a, r.b) if m is not None})
    if not models:
        return spark.createDataFrame([], "place int, model string, strength double, n_verdicts bigint")
    at = {m: i for i, m in enumerate(models)}
    wins, seen = np.zeros((len(models) + 1,) * 2), np.zeros(len(models), dtype=np.int64)
    wins[:-1, -1] = wins[-1, :-1] = 0.5
    for r in rows:
        if r.b is not None:
            a, b = at[r.a], at[r.b]
            wins[a, b] = (r.points + SMOOTHING) / (r.n + 2 * SMOOTHING)
            wins[b, a] = 1 - wins[a, b]
            seen[[a, b]] += r.n
    p = stationary(wins)[:-1]
    p = p / p.sum()
    order = sorted(range(len(models)), key=lambda i: (-p[i], models[i]))
    found = [(k + 1, models[i], float(p[i]), int(seen[i])) for k, i in enumerate(order)]
    return spark.createDataFrame(found, "place int, model string, strength double, n_verdicts bigint")
