"""Preference pairs of sampled answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.operators import preferences
from weftspark.plans import views
from weftspark.plans.registry import query


def _ranked(spark, folder):
    """Candidates ranked by length, the longest first; answers of one length have one rank."""
    rows = preferences.varied(views.candidates(spark, folder))
    rank = F.transform("gen_answers", lambda a: 1 + F.size(F.filter("gen_answers", lambda b: F.length(b) > F.length(a))))
    return rows.withColumn("ranks", rank)


_VARIED = "SELECT * FROM {candidates} WHERE len(list_distinct(gen_answers)) > 1"
_RANKED = f"SELECT *, list_transform(gen_answers, lambda a: 1 + len(list_filter(gen_answers, lambda b: length(b) > length(a)))) AS ranks FROM ({_VARIED})"


@query("pref_filter_dups", f"SELECT gen_id, prompt_id FROM ({_VARIED})")
def pref_filter_dups(spark, folder):
    return preferences.varied(views.candidates(spark, folder)).select("gen_id", "prompt_id")


@query(
    "pref_best_worst",
    f"SELECT gen_id, gen_answers[list_position(ranks, list_min(ranks))] AS best, gen_answers[list_position(ranks, list_max(ranks))] AS worst, CAST(list_min(ranks) AS INTEGER) AS best_rank, CAST(list_max(ranks) AS INTEGER) AS worst_rank FROM ({_RANKED})",
)
def pref_best_worst(spark, folder):
    return _ranked(spark, folder).select("gen_id", preferences.best_worst(F.col("gen_answers"), F.col("ranks")).alias("p")).select("gen_id", "p.*")


@query("pref_drop_ambiguous", "SELECT prompt_id, min(pair_id) AS pair_id FROM {dialogues} WHERE prompt_id IS NOT NULL GROUP BY prompt_id HAVING count(*) = 1")
def pref_drop_ambiguous(spark, folder):
    return preferences.unambiguous(views.dialogues(spark, folder, "prompt_id").where("prompt_id is not null").select("prompt_id", "pair_id"))


@query(
    "pref_mix_original",
    f"WITH g AS (SELECT gen_id, prompt_id, concat('best ', gen_answers[list_position(ranks, list_min(ranks))]) AS chosen, concat('worst ', gen_answers[list_position(ranks, list_max(ranks))]) AS rejected FROM ({_RANKED})),"
    " o AS (SELECT prompt_id, min(coalesce(chosen[-1].content, '')) AS chosen, min(coalesce(rejected[-1].content, '')) AS rejected FROM {dialogues} WHERE prompt_id IS NOT NULL GROUP BY prompt_id HAVING count(*) = 1),"
    " c AS (SELECT prompt_id, row_number() OVER (ORDER BY md5(concat('42:', prompt_id)), prompt_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT prompt_id FROM g WHERE prompt_id IN (SELECT prompt_id FROM o))),"
    " u AS (SELECT prompt_id, CASE WHEN r <= floor(floor(n * CAST(0.4 AS DOUBLE)) * CAST(0.3 AS DOUBLE)) THEN 'pair' ELSE 'chosen' END AS use FROM c WHERE r <= floor(n * CAST(0.4 AS DOUBLE)))"
    " SELECT g.gen_id, CASE WHEN u.use IS NOT NULL THEN o.chosen ELSE g.chosen END AS chosen, CASE WHEN u.use = 'pair' THEN o.rejected ELSE g.rejected END AS rejected, u.use FROM g LEFT JOIN u ON g.prompt_id = u.prompt_id LEFT JOIN o ON g.prompt_id = o.prompt_id",
)
def pref_mix_original(spark, folder):
    picked = _ranked(spark, folder).select("gen_id", "prompt_id", preferences.best_worst(F.col("gen_answers"), F.col("ranks")).alias("p"))
    generated = picked.select("gen_id", "prompt_id", F.concat(F.lit("best "), "p.best").alias("chosen"), F.concat(F.lit("worst "), "p.worst").alias("rejected"))
    last = lambda c: F.coalesce(F.expr(f"try_element_at({c}, -1).content"), F.lit("")).alias(c)
    original = views.dialogues(spark, folder, "prompt_id", "chosen", "rejected").select("prompt_id", last("chosen"), last("rejected"))
    return preferences.mixed_original(generated, original, 0.3, 0.1).select("gen_id", "chosen", "rejected", "use")


@query("pref_augmented_counts", "WITH c AS (SELECT count(*) AS n FROM (SELECT DISTINCT prompt_id FROM {candidates} WHERE prompt_id IN (SELECT prompt_id FROM {dialogues})))"
       " SELECT 'pair' AS use, CAST(floor(floor(n * CAST(0.75 AS DOUBLE)) * CAST(0.5 AS DOUBLE)) AS BIGINT) AS n FROM c UNION ALL SELECT 'chosen', CAST(floor(n * CAST(0.75 AS DOUBLE)) - floor(floor(n * CAST(0.75 AS DOUBLE)) * CAST(0.5 AS DOUBLE)) AS BIGINT) FROM c")  # fmt: skip
def pref_augmented_counts(spark, folder):
    ids = preferences.augmented_ids(views.candidates(spark, folder), views.dialogues(spark, folder, "prompt_id"), 0.5, 0.25)
    return ids.groupBy("use").agg(F.count("*").alias("n"))
