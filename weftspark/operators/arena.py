"""Ratings from judged games against a baseline: battles, maximum-likelihood Elo, win rates, bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, BASE, INIT = 400.0, 10.0, 1000.0
WEIGHT = 3
#: Models of which a general rating is solved on the driver, at most; their pairs are all that is gathered.
MOST_MODELS = 2000


def battles(judgments: DataFrame, baseline: str = "base", weight: int = WEIGHT, first_game_only: bool = False) -> DataFrame:
    """(question_id, model_a, model_b, winner, weight) of every game with a verdict; model_a is the baseline.

    In the first game A is the baseline, in the second the model. A clear verdict (``>>``) weighs more, instead of being
    repeated. Games without one of the five verdicts are left out.
    """
    games = judgments.select("question_id", "model", F.posexplode("games").alias("game", "g")).where("game = 0" if first_game_only else "game < 2")
    better = F.substring(F.col("g.score"), 1, 1)
    first = F.when(F.col("game") == 0, "model_a").otherwise("model_b")
    second = F.when(F.col("game") == 0, "model_b").otherwise("model_a")
    winner = F.when(F.col("g.score") == "A=B", "tie").when(better == "A", first).otherwise(second)
    strong = F.when(F.col("g.score").contains(">>"), weight).otherwise(1)
    rows = games.where(F.col("g.score").isin("A=B", "A>B", "A>>B", "B>A", "B>>A"))
    return rows.select("question_id", F.lit(baseline).alias("model_a"), F.col("model").alias("model_b"), winner.alias("winner"), strong.cast("int").alias("weight"))


def replicated(rows: DataFrame) -> DataFrame:
    """Each battle as many times as it weighs."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("weight")))).drop("copy", "weight")


def tallies(rows: DataFrame) -> DataFrame:
    """(model_a, model_b, n, points): weight of all battles, and of those won by model_b, a tie being half a win."""
    point = F.when(F.col("winner") == "model_b", 1.0).when(F.col("winner") == "tie", 0.5).otherwise(0.0)
    return rows.groupBy("model_a", "model_b").agg(F.sum("weight").cast("bigint").alias("n"), F.sum(F.col("weight") * point).alias("points"))


def star_rating(points: Column, n: Column, anchor: float = INIT) -> Column:
    """Elo of a model that met one baseline only: the likelihood is greatest at the odds of its points. Null if it won or lost all."""
    w = points / n
    return F.when((w > 0) & (w < 1), F.lit(anchor) + F.lit(SCALE) * F.log10(w / (1 - w)))


def elo(rows: DataFrame, anchor: float = INIT) -> DataFrame:
    """(model, elo) from the battles of a star around one baseline, which has the anchor."""
    counts = tallies(rows)
    return counts.select(F.col("model_b").alias("model"), star_rating(F.col("points"), F.col("n"), anchor).alias("elo")).unionByName(counts.select(F.col("model_a").alias("model"), F.lit(anchor).alias("elo")).distinct())


def solved(pairs: list[tuple[str, str, float, float]], anchor: str | None = None, at: float = INIT) -> dict[str, float]:
    """Maximum-likelihood ratings for (a, b, battles, points of b), by Newton's method; the mean, or the anchor, is ``at``.

    Models are rated within the component in which every model has, through others, both points and losses; the rest,
    whose likelihood has no maximum, get nan.
    """
    names = sorted({m for a, b, _, _ in pairs for m in (a, b)})
    if len(names) > MOST_MODELS:
        raise ValueError(f"{len(names)} models are more than {MOST_MODELS}")
    k = {m: i for i, m in enumerate(names)}
    won = np.zeros((len(names), len(names)))
    for a, b, n, points in pairs:
        if a != b:
            won[k[b], k[a]] += points
            won[k[a], k[b]] += n - points
    reach = (won > 0) | np.eye(len(names), dtype=bool)
    for _ in range(max(1, int(np.ceil(np.log2(max(2, len(names))))))):
        reach = (reach.astype(np.float32) @ reach.astype(np.float32)) > 0
    strong = reach & reach.T
    out = dict.fromkeys(names, float("nan"))
    if not names:
        return out
    start = k.get(anchor, int(strong.sum(axis=1).argmax()))
    own = np.flatnonzero(strong[start])
    w = won[np.ix_(own, own)]
    met, theta = w + w.T, np.zeros(len(own))
    for _ in range(100):
        p = 1 / (1 + np.exp(theta[None, :] - theta[:, None]))
        grad = (w - met * p).sum(axis=1)
        curve = met * p * (1 - p)
        hess = np.diag(curve.sum(axis=1)) - curve + 1.0 / len(own)
        step = np.linalg.solve(hess, grad)
        theta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-12:
            break
    rating = SCALE * theta / np.log(BASE)
    rating += at - (rating[list(own).index(k[anchor])] if anchor in k else rating.mean())
    return out | {names[i]: float(r) for i, r in zip(own, rating)}


def general_elo(rows: DataFrame, anchor: str | None = None) -> DataFrame:
    """(model, elo) for battles between any models; only the tallies of pairs of models are gathered. Null if there is no rating."""
    found = solved([(r.model_a, r.model_b, float(r.n), float(r.points)) for r in tallies(rows).collect()], anchor)
    return rows.sparkSession.createDataFrame([(m, None if np.isnan(e) else e) for m, e in found.items()], "model string, elo double")


def win_chance(a: Column, b: Column) -> Column:
    """Chance that a model rated a wins against one rated b."""
    return 1 / (1 + F.pow(F.lit(BASE), (b - a) / F.lit(SCALE)))


def win_matrix(ratings: DataFrame) -> DataFrame:
    """(model_a, model_b, win_rate) for all pairs of models; a model against itself has 0.5. Ratings are one row a model."""
    a, b = ratings.selectExpr("model as model_a", "elo as elo_a"), F.broadcast(ratings.selectExpr("model as model_b", "elo as elo_b"))
    rate = F.when(F.col("model_a") == F.col("model_b"), 0.5).otherwise(win_chance(F.col("elo_a"), F.col("elo_b")))
    return a.join(b, F.col("model_a").isNotNull() & F.col("model_b").isNotNull()).select("model_a", "model_b", rate.alias("win_rate"))


def win_rate(rating: Column, baseline: float | Column = INIT) -> Column:
    """Per cent of wins against the baseline, to two places, halves to even."""
    base = F.lit(baseline) if isinstance(baseline, float) else baseline
    return F.bround(100 * win_chance(rating, base), 2)


def bootstrap(rows: DataFrame, rounds: int = 100, seed: int = 42) -> DataFrame:
    """(round, model, elo) of samples of the battles with replacement, as many as there are.

    A sample of rows is a multinomial draw of the counts of (model, winner), of which there are at most three a model; so
    the rounds are drawn from the counts, each in its own task, and the battles are read once. Weights count as copies.
    """
    cells = rows.groupBy("model_a", "model_b", "winner").agg(F.sum("weight").cast("bigint").alias("n")).orderBy("model_b", "winner").collect()
    if len(cells) > 3 * MOST_MODELS:
        raise ValueError("too many models")
    n = np.array([c.n for c in cells], dtype=np.int64)
    point = np.array([{"model_b": 1.0, "tie": 0.5}.get(c.winner, 0.0) for c in cells])
    names = np.array([c.model_b for c in cells], dtype=object)
    base = cells[0].model_a if cells else None

    def run(batches):
        for batch in batches:
            for r in batch["round"]:
                draw = np.random.default_rng([seed, int(r)]).multinomial(n.sum(), n / n.sum()) if len(n) else n
                table = pd.DataFrame({"model": names, "n": draw, "p": draw * point}).groupby("model", as_index=False).sum()
                w = (table["p"] / table["n"].where(table["n"] > 0)).astype(float)
                table["elo"] = (INIT + SCALE * np.log10(w.where((w > 0) & (w < 1)) / (1 - w))).astype(object).where(w.notna() & (w > 0) & (w < 1), None)
                out = pd.concat([table[["model", "elo"]], pd.DataFrame({"model": [base] * bool(len(n)), "elo": [INIT] * bool(len(n))})])
                out.insert(0, "round", int(r))
                yield out

    return rows.sparkSession.range(rounds).select(F.col("id").cast("int").alias("round")).mapInPandas(run, "round int, model string, elo double")


def intervals(samples: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(model, lower, median, upper) of the ratings of a bootstrap."""
    q = lambda p: F.percentile("elo", F.lit(p))
    return samples.groupBy("model").agg(q(low).alias("lower"), q(0.5).alias("median"), q(high).alias("upper"))


def error_bars(bounds: DataFrame) -> DataFrame:
    """(model, rating, error_y, error_y_minus), best first: the median with its distances from the bounds."""
    return bounds.select("model", F.col("median").alias("rating"), (F.col("upper") - F.col("median")).alias("error_y"), (F.col("median") - F.col("lower")).alias("error_y_minus")).orderBy(F.desc("rating"), "model")


def leaderboard(rows: DataFrame, lengths: DataFrame, bounds: DataFrame | None = None, show_elo: bool = False) -> DataFrame:
    """(model, score, avg_tokens) and with bounds (lower, upper, interval), best first.

    The score is the per cent of wins against the baseline, lower and upper those of the bounds against the baseline's
    own bound; with show_elo all are whole ratings. A model without answers has 0 tokens.
    """
    board = elo(rows).join(lengths, "model", "left").withColumn("avg_tokens", F.coalesce("avg_tokens", F.lit(0)).cast("bigint"))
    shown = (lambda c: F.col(c).cast("int")) if show_elo else (lambda c: win_rate(F.col(c)))
    if bounds is None:
        return board.select("model", shown("elo").alias("score"), "avg_tokens").orderBy(F.desc("score"), "model")
    places = 0 if show_elo else 1
    gap = lambda c: F.round(F.col(c) - F.col("score"), places)
    out = board.join(bounds, "model").select("model", shown("elo").alias("score"), shown("lower").alias("lower"), shown("upper").alias("upper"), "avg_tokens")
    return out.withColumn("interval", F.format_string("(%s, %s)", gap("lower").cast("string"), gap("upper").cast("string"))).orderBy(F.desc("score"), "model")


def compared(first: DataFrame, second: DataFrame) -> DataFrame:
    """(model, place_1, rating_1, place_2, rating_2): two ratings beside each other, rounded half up, placed from 1."""
    from pyspark.sql import Window

    one = lambda df, i: df.select("model", F.row_number().over(Window.orderBy(F.desc_nulls_last("elo"), "model")).alias(f"place_{i}"), F.floor(F.col("elo") + 0.5).cast("bigint").alias(f"rating_{i}"))
    return one(first, 1).join(one(second, 2), "model", "full")
