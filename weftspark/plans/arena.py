"""Ratings of models against a baseline, and of any models that met."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.operators import arena, leaderboard
from weftspark.plans import views
from weftspark.plans.registry import query

_GAME = "SELECT question_id, 'base' AS model_a, model AS model_b, CASE WHEN {s} = 'A=B' THEN 'tie' WHEN {s} IN ('A>B', 'A>>B') THEN '{a}' ELSE '{b}' END AS winner, CASE WHEN {s} IN ('A>>B', 'B>>A') THEN 3 ELSE 1 END AS weight FROM {{arena_judgments}} WHERE {s} IS NOT NULL"
_FIRST = _GAME.format(s="s1", a="model_a", b="model_b")
_BATTLES = _FIRST + " UNION ALL " + _GAME.format(s="s2", a="model_b", b="model_a")
_TALLY = f"SELECT model_b AS model, CAST(sum(weight) AS BIGINT) AS n, sum(weight * CASE winner WHEN 'model_b' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0.0 END) AS points FROM ({_BATTLES}) GROUP BY model_b"
_ELO = f"SELECT model, 1000 + 400 * log10((points / n) / (1 - points / n)) AS elo FROM (SELECT model, CAST(n AS DOUBLE) AS n, CAST(points AS DOUBLE) AS points FROM ({_TALLY})) UNION ALL SELECT 'base', 1000.0"


def _battles(spark, folder, **more):
    return arena.battles(views.arena_judgments(spark, folder), **more)


@query("arena_battles", _BATTLES)
def arena_battles(spark, folder):
    return _battles(spark, folder)


@query("arena_battles_first_game", _FIRST)
def arena_battles_first_game(spark, folder):
    return _battles(spark, folder, first_game_only=True)


@query("arena_battles_repeated", f"SELECT model_b, winner, CAST(sum(weight) AS BIGINT) AS n FROM ({_BATTLES}) GROUP BY ALL")
def arena_battles_repeated(spark, folder):
    return arena.replicated(_battles(spark, folder)).groupBy("model_b", "winner").agg(F.count("*").alias("n"))


@query("arena_tallies", f"SELECT 'base' AS model_a, model AS model_b, n, CAST(points AS DOUBLE) AS points FROM ({_TALLY})")
def arena_tallies(spark, folder):
    return arena.tallies(_battles(spark, folder))


@query("arena_elo", f"SELECT model, round(elo, 6) AS elo FROM ({_ELO})")
def arena_elo(spark, folder):
    return arena.elo(_battles(spark, folder)).withColumn("elo", F.round("elo", 6))


@query("arena_win_rate", f"SELECT model, round(100 * CAST(points AS DOUBLE) / n, 4) AS win_rate FROM ({_TALLY})")
def arena_win_rate(spark, folder):
    rated = arena.elo(_battles(spark, folder)).where("model != 'base'")
    return rated.select("model", F.round(100 * arena.win_chance(F.col("elo"), F.lit(arena.INIT)), 4).alias("win_rate"))


@query("arena_win_matrix", f"WITH e AS ({_ELO}) SELECT a.model AS model_a, b.model AS model_b, round(CASE WHEN a.model = b.model THEN 0.5 ELSE 1 / (1 + pow(10, (b.elo - a.elo) / 400)) END, 6) AS win_rate FROM e a CROSS JOIN e b")
def arena_win_matrix(spark, folder):
    return arena.win_matrix(arena.elo(_battles(spark, folder))).withColumn("win_rate", F.round("win_rate", 6))


@query(
    "arena_leaderboard",
    f"SELECT e.model, round_even(CAST(100 / (1 + pow(10, (1000 - elo) / 400)) AS DOUBLE), 2) AS score, CAST(coalesce(floor(t), 0) AS BIGINT) AS avg_tokens FROM ({_ELO}) e LEFT JOIN (SELECT model, avg(token_len) AS t FROM {{answer_lengths}} GROUP BY model) l ON e.model = l.model",
)
def arena_leaderboard(spark, folder):
    lengths = leaderboard.average_length(views.answer_lengths(spark, folder))
    return arena.leaderboard(_battles(spark, folder), lengths)


@query("arena_avg_tokens", "SELECT model, CAST(floor(avg(token_len)) AS BIGINT) AS avg_tokens FROM {answer_lengths} GROUP BY model")
def arena_avg_tokens(spark, folder):
    return leaderboard.average_length(views.answer_lengths(spark, folder))


@query("arena_bootstrap_ci")
def arena_bootstrap_ci(spark, folder):
    """(model, lower, median, upper); its draws have no twin in SQL."""
    return arena.intervals(arena.bootstrap(_battles(spark, folder)))


@query("arena_leaderboard_ci")
def arena_leaderboard_ci(spark, folder):
    rows = _battles(spark, folder)
    return arena.leaderboard(rows, leaderboard.average_length(views.answer_lengths(spark, folder)), arena.intervals(arena.bootstrap(rows)))


@query("arena_error_bars")
def arena_error_bars(spark, folder):
    return arena.error_bars(arena.intervals(arena.bootstrap(_battles(spark, folder), rounds=40)))


@query(
    "percentile_bounds",
    "SELECT model, round(quantile_cont(score, 0.025), 6) AS lower, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.975), 6) AS upper FROM (SELECT model, score * line % 97 AS score FROM {single_judgments}) GROUP BY model",
)
def percentile_bounds(spark, folder):
    rows = views.single_judgments(spark, folder).select("model", (F.col("score") * F.col("line") % 97).alias("elo"))
    return arena.intervals(rows).select("model", *(F.round(c, 6).alias(c) for c in ("lower", "median", "upper")))


@query(
    "elo_compared",
    f"WITH f AS (SELECT model_b AS model, sum(weight * CASE winner WHEN 'model_b' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0.0 END) / sum(weight) AS w FROM ({_FIRST}) GROUP BY model_b), a AS ({_ELO}), b AS (SELECT model, 1000 + 400 * log10(w / (1 - w)) AS elo FROM f UNION ALL SELECT 'base', 1000.0)"
    " SELECT coalesce(a.model, b.model) AS model, CAST(row_number() OVER (ORDER BY a.elo DESC, a.model) AS INTEGER) AS place_1, CAST(floor(a.elo + 0.5) AS BIGINT) AS rating_1, CAST(row_number() OVER (ORDER BY b.elo DESC, b.model) AS INTEGER) AS place_2, CAST(floor(b.elo + 0.5) AS BIGINT) AS rating_2 FROM a FULL JOIN b ON a.model = b.model",
)
def elo_compared(spark, folder):
    return arena.compared(arena.elo(_battles(spark, folder)), arena.elo(_battles(spark, folder, first_game_only=True)))


def _met(spark, folder):
    own = views.table(spark, folder, "arena_hard_battles").groupBy("battle_id").agg(F.min(F.struct("tstamp", "model_a", "model_b", "winner")).alias("b")).select("b.*")
    verdict = F.lower(F.trim("winner"))
    rows = own.where("model_a != model_b").select("model_a", "model_b", F.when(verdict.isin("model_a", "model_b"), verdict).when(verdict.startswith("tie"), "tie").alias("winner"), F.lit(1).alias("weight"))
    return rows.where("winner is not null")


@query(
    "battle_tallies",
    "SELECT model_a, model_b, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN w = 'model_b' THEN 1.0 WHEN w = 'model_a' THEN 0.0 ELSE 0.5 END) AS DOUBLE) AS points FROM (SELECT model_a, model_b, lower(trim(winner)) AS w FROM (SELECT * FROM arena_hard_battles QUALIFY row_number() OVER (PARTITION BY battle_id ORDER BY tstamp, model_a, model_b) = 1))"
    " WHERE model_a <> model_b AND (w IN ('model_a', 'model_b') OR starts_with(w, 'tie')) GROUP BY model_a, model_b",
)
def battle_tallies(spark, folder):
    return arena.tallies(_met(spark, folder))


@query("battle_elo")
def battle_elo(spark, folder):
    """(model, elo) of models that met in any pairing; solved from the tallies, which SQL can't."""
    return arena.general_elo(_met(spark, folder), "anchor-base")
