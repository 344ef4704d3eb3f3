"""Leaderboards and verdicts of multi-turn judging."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.operators import judging, leaderboard, planning
from weftspark.plans import views
from weftspark.plans.registry import query

_MEANS = "SELECT {by}, avg(score) AS score FROM {{single_judgments}} j {join} WHERE score <> -1 GROUP BY {by}"


def _means(name, *by):
    category = "category" in by
    sql = _MEANS.format(by=", ".join(by), join="JOIN {questions} q USING (question_id)" if category else "")
    sql = f"SELECT {', '.join(by)}, round(score, 6) AS score FROM ({sql})"

    @query(name, sql)
    def run(spark, folder):
        q = views.questions(spark, folder) if category else None
        return leaderboard.mean_scores(views.single_judgments(spark, folder), *by, questions=q).withColumn("score", F.round("score", 6))


_means("mt_leaderboard_turn", "model", "turn")
_means("mt_leaderboard_model", "model")
_means("mt_leaderboard_turn_category", "model", "turn", "category")
_means("mt_leaderboard_category", "model", "category")


@query(
    "mt_score_report",
    "SELECT model, turn, category, round(avg(score), 6) AS score FROM {single_judgments} j JOIN {questions} q USING (question_id) WHERE score <> -1 GROUP BY GROUPING SETS ((model, turn), (model), (model, turn, category), (model, category))",
)
def mt_score_report(spark, folder):
    return leaderboard.score_report(views.single_judgments(spark, folder), views.questions(spark, folder)).withColumn("score", F.round("score", 6))


@query("mt_leaderboard_named", "SELECT model, round(avg(score), 6) AS score FROM {single_judgments} WHERE score <> -1 AND model IN ('m1', 'm5') GROUP BY model")
def mt_leaderboard_named(spark, folder):
    return leaderboard.mean_scores(views.single_judgments(spark, folder), "model", models=["m1", "m5"]).withColumn("score", F.round("score", 6))


@query(
    "mt_turn_diff",
    "SELECT model, round(score_1, 6) AS score_1, round(score_2, 6) AS score_2, round(score_2 - score_1, 6) AS diff FROM (SELECT model, avg(score) AS score_1 FROM {single_judgments} WHERE score <> -1 AND turn = 1 GROUP BY model)"
    " JOIN (SELECT model, avg(score) AS score_2 FROM {single_judgments} WHERE score <> -1 AND turn = 2 GROUP BY model) USING (model)",
)
def mt_turn_diff(spark, folder):
    out = leaderboard.turn_difference(views.single_judgments(spark, folder))
    return out.select("model", *(F.round(c, 6).alias(c) for c in ("score_1", "score_2", "diff")))


@query(
    "mt_run_average",
    "WITH m AS (SELECT model, category, avg(score) AS score FROM (SELECT model, category, run, avg(score) AS score FROM {single_judgments} j JOIN {questions} q USING (question_id) WHERE score <> -1 GROUP BY ALL) GROUP BY ALL)"
    " SELECT model, category, round(score, 6) AS score FROM m UNION ALL SELECT model, 'overall', round(avg(score), 6) FROM m GROUP BY model",
)
def mt_run_average(spark, folder):
    return leaderboard.run_average(views.single_judgments(spark, folder), views.questions(spark, folder)).withColumn("score", F.round("score", 6))


@query("mt_last_judgments", "SELECT question_id, model, arg_max(score, line) AS score, max(line) AS line FROM {single_judgments} GROUP BY question_id, model")
def mt_last_judgments(spark, folder):
    rows = views.single_judgments(spark, folder).select("question_id", "model", "line", "score").withColumn("at", F.col("line"))
    return judging.last_of(rows, "question_id", "model", order="at").select("question_id", "model", "score", "line")


_MODELS = "(SELECT DISTINCT model FROM {single_judgments})"
_JUDGE = "concat('single-', CASE WHEN category IN ('math', 'reasoning', 'coding') THEN 'math-v1' ELSE 'v1' END, CASE WHEN multi_turn THEN '-multi-turn' ELSE '' END)"


@query("mt_match_plan", f"SELECT question_id, category, model, multi_turn, {_JUDGE} AS judge FROM {{questions}} q CROSS JOIN {_MODELS} m CROSS JOIN (VALUES (false), (true)) t(multi_turn)")
def mt_match_plan(spark, folder):
    models = views.single_judgments(spark, folder).select("model").distinct()
    return planning.single_matches(views.questions(spark, folder), models)


@query(
    "mt_pair_plan",
    "SELECT question_id, a.model AS model_1, b.model AS model_2, multi_turn, concat(CASE WHEN category IN ('math', 'reasoning', 'coding') THEN 'pair-math-v1' ELSE 'pair-v2' END, CASE WHEN multi_turn THEN '-multi-turn' ELSE '' END) AS judge"
    f" FROM {{questions}} q CROSS JOIN {_MODELS} a JOIN {_MODELS} b ON a.model < b.model CROSS JOIN (VALUES (false), (true)) t(multi_turn)",
)
def mt_pair_plan(spark, folder):
    models = views.single_judgments(spark, folder).select("model").distinct()
    return planning.pair_matches(views.questions(spark, folder), models).select("question_id", "model_1", "model_2", "multi_turn", "judge")


@query("mt_baseline_plan", f"SELECT question_id, model AS model_1, 'm0' AS model_2 FROM {{questions}} q CROSS JOIN {_MODELS} m WHERE model <> 'm0'")
def mt_baseline_plan(spark, folder):
    models = views.single_judgments(spark, folder).select("model").distinct()
    return planning.baseline_matches(views.questions(spark, folder), models, "m0").where("not multi_turn").select("question_id", "model_1", "model_2")


@query("mt_completeness", f"SELECT question_id, model FROM {{questions}} q CROSS JOIN {_MODELS} m WHERE NOT EXISTS (SELECT 1 FROM {{single_judgments}} j WHERE j.question_id = q.question_id AND j.model = m.model AND turn = 2 AND score > 9)")
def mt_completeness(spark, folder):
    rows = views.single_judgments(spark, folder)
    return planning.missing(views.questions(spark, folder).select("question_id"), rows.select("model").distinct(), rows.where("turn = 2 and score > 9"))


_RATES = (
    "WITH g AS (SELECT *, g1_winner = 'tie' OR g1_winner <> g2_winner AS tied FROM {pair_judgments} WHERE g1_winner <> 'error' AND g2_winner <> 'error' WHERE_MORE),"
    " e AS (SELECT model_1 AS model, CASE WHEN tied THEN 'tie' WHEN g1_winner = 'model_1' THEN 'win' ELSE 'loss' END AS r FROM g UNION ALL SELECT model_2, CASE WHEN tied THEN 'tie' WHEN g1_winner = 'model_2' THEN 'win' ELSE 'loss' END FROM g),"
    " c AS (SELECT model, CAST(count(*) FILTER (r = 'win') AS BIGINT) AS win, CAST(count(*) FILTER (r = 'loss') AS BIGINT) AS loss, CAST(count(*) FILTER (r = 'tie') AS BIGINT) AS tie FROM e GROUP BY model)"
    " SELECT model, win, loss, tie, round(win / (win + loss + tie), 6) AS win_rate, round(loss / (win + loss + tie), 6) AS loss_rate, round((win + 0.5 * tie) / (win + loss + tie), 6) AS win_rate_adjusted FROM c MODEL_MORE"
)


def _rounded_rates(df):
    return df.select("model", "win", "loss", "tie", *(F.round(c, 6).alias(c) for c in ("win_rate", "loss_rate", "win_rate_adjusted")))


@query("pair_win_rates", _RATES.replace("WHERE_MORE", "").replace("MODEL_MORE", ""))
def pair_win_rates(spark, folder):
    return _rounded_rates(leaderboard.win_rates(views.pair_judgments(spark, folder)))


@query("pair_win_rates_baseline", _RATES.replace("WHERE_MORE", "AND model_1 IN ('m0', 'm1', 'm2') AND 'm0' IN (model_1, model_2)").replace("MODEL_MORE", "WHERE model <> 'm0'"))
def pair_win_rates_baseline(spark, folder):
    return _rounded_rates(leaderboard.win_rates(views.pair_judgments(spark, folder), ["m0", "m1", "m2"], "m0"))


@query(
    "pair_normalize_keys",
    "WITH p AS (SELECT *, CASE WHEN g1_winner = g2_winner THEN g1_winner ELSE 'inconsistent' END AS w, model_1 >= model_2 AS swap FROM {pair_judgments}),"
    " n AS (SELECT line, question_id, least(model_1, model_2) AS a, greatest(model_1, model_2) AS b, CASE WHEN swap AND w = 'model_1' THEN 'model_2' WHEN swap AND w = 'model_2' THEN 'model_1' ELSE w END AS winner,"
    " CASE WHEN swap THEN g2_judgment ELSE g1_judgment END AS g1_judgment, CASE WHEN swap THEN g1_judgment ELSE g2_judgment END AS g2_judgment FROM p)"
    " SELECT question_id, a AS model_1, b AS model_2, winner, g1_judgment, g2_judgment FROM n QUALIFY row_number() OVER (PARTITION BY question_id, a, b ORDER BY line DESC, winner DESC, g1_judgment DESC) = 1",
)
def pair_normalize_keys(spark, folder):
    return judging.pairs_normalized(views.pair_judgments(spark, folder))


@query(
    "pair_explanations",
    "SELECT line, concat('**Game 1**. **A**: ', model_1, ', **B**: ', model_2, chr(10), chr(10), '**Judgment**: ', g1_judgment, chr(10), chr(10), '`--------------------------`', chr(10), chr(10), '**Game 2**. **A**: ', model_2, ', **B**: ', model_1, chr(10), chr(10), '**Judgment**: ', g2_judgment) AS explanation FROM {pair_judgments}",
)
def pair_explanations(spark, folder):
    return views.pair_judgments(spark, folder).select("line", judging.pair_explanation(*map(F.col, ("model_1", "model_2", "g1_judgment", "g2_judgment"))).alias("explanation"))


@query(
    "judge_drilldown",
    "SELECT j.question_id, j.model, j.turn, arg_max(concat('**Game 1**. **A**: ', j.model, ', **Score**: ', CAST(score AS VARCHAR), chr(10), chr(10), '**Judgment**: line ', line), line) AS explanation,"
    f" arg_max({_JUDGE.replace('multi_turn', 'turn = 2')}, line) AS judge FROM {{single_judgments}} j JOIN {{questions}} q USING (question_id) GROUP BY j.question_id, j.model, j.turn",
)
def judge_drilldown(spark, folder):
    rows = views.single_judgments(spark, folder).join(F.broadcast(views.questions(spark, folder)), "question_id")
    text = judging.explanation(F.col("model"), F.col("score"), F.concat(F.lit("line "), F.col("line").cast("string")))
    rows = rows.select("question_id", "model", "turn", "line", text.alias("explanation"), judging.judge_name(F.col("category"), F.col("turn") == 2).alias("judge"))
    return judging.last_of(rows, "question_id", "model", "turn").select("question_id", "model", "turn", "explanation", "judge")


@query(
    "question_previews",
    "SELECT category, array_to_string(list(concat(question_id, ': ', left(concat('question of ', category), 128), '...') ORDER BY question_id), '|') AS previews FROM {questions} GROUP BY category",
)
def question_previews(spark, folder):
    rows = views.questions(spark, folder).withColumn("text", F.concat(F.lit("question of "), F.col("category")))
    return leaderboard.previews(rows).select("category", F.array_join("previews", "|").alias("previews"))


@query(
    "verdict_single_score",
    r"SELECT line, coalesce(try_cast(nullif(regexp_extract(judgment, '\[\[(\d+\.?\d*)\]\]', 1), '') AS DOUBLE), try_cast(nullif(regexp_extract(judgment, '\[(\d+\.?\d*)\]', 1), '') AS DOUBLE), CAST(-1 AS DOUBLE)) AS score FROM {judge_texts}",
)
def verdict_single_score(spark, folder):
    return views.judge_texts(spark, folder).select("line", judging.score_of(F.col("judgment")).alias("score"))


@query(
    "verdict_pair",
    "SELECT line, w AS verdict, CASE w WHEN 'A' THEN 'model_1' WHEN 'B' THEN 'model_2' ELSE w END AS g1_winner, CASE w WHEN 'A' THEN 'model_2' WHEN 'B' THEN 'model_1' ELSE w END AS g2_winner"
    " FROM (SELECT line, CASE WHEN contains(judgment, '[[A]]') THEN 'A' WHEN contains(judgment, '[[B]]') THEN 'B' WHEN contains(judgment, '[[C]]') THEN 'tie' ELSE 'error' END AS w FROM {judge_texts})",
)
def verdict_pair(spark, folder):
    rows = views.judge_texts(spark, folder).select("line", judging.pair_verdict(F.col("judgment")).alias("verdict"))
    return rows.select("line", "verdict", judging.winner_of(F.col("verdict"), False).alias("g1_winner"), judging.winner_of(F.col("verdict"), True).alias("g2_winner"))


@query(
    "verdict_two_scores",
    r"SELECT line, CASE WHEN a IS NULL OR b IS NULL THEN 'error' WHEN abs(a - b) <= CAST(0.1 AS DOUBLE) THEN 'tie' WHEN a > b THEN 'A' ELSE 'B' END AS verdict FROM (SELECT line, try_cast(nullif(regexp_extract(t, '\[\[(\d+\.?\d*),\s?(\d+\.?\d*)\]\]', 1), '') AS DOUBLE) AS a,"
    r" try_cast(nullif(regexp_extract(t, '\[\[(\d+\.?\d*),\s?(\d+\.?\d*)\]\]', 2), '') AS DOUBLE) AS b FROM (SELECT event_id AS line, concat('so [[', CAST(floor(value) AS BIGINT) % 10, ', ', event_id % 10, '.05]]') AS t FROM events))",
)
def verdict_two_scores(spark, folder):
    text = F.concat(F.lit("so [["), (F.floor("value") % 10).cast("string"), F.lit(", "), (F.col("event_id") % 10).cast("string"), F.lit(".05]]"))
    return views.table(spark, folder, "events").select(F.col("event_id").alias("line"), judging.score_verdict(text).alias("verdict"))


@query(
    "verdict_arena",
    r"SELECT line, CASE WHEN len(v) = 1 THEN v[1] END AS score, len(v) = 0 AS again FROM (SELECT line, list_distinct(list_filter(regexp_extract_all(judgment, '\[\[([AB<>=]+)\]\]', 1), lambda x: x <> '')) AS v FROM {judge_texts})",
)
def verdict_arena(spark, folder):
    return views.judge_texts(spark, folder).select("line", judging.arena_verdict(F.col("judgment")).alias("v")).select("line", "v.*")


@query(
    "prompt_rendering",
    "SELECT line, replace(replace('[Question] {question} [Answer] {answer}', '{question}', concat('number ', line)), '{answer}', judgment) AS prompt FROM {judge_texts}",
)
def prompt_rendering(spark, folder):
    values = {"question": F.concat(F.lit("number "), F.col("line").cast("string")), "answer": F.col("judgment")}
    return views.judge_texts(spark, folder).select("line", judging.rendered(F.lit("[Question] {question} [Answer] {answer}"), values).alias("prompt"))


@query(
    "markdown_fixed",
    r"SELECT doc_id, regexp_replace(regexp_replace(replace(text, '•', '- '), '\n\n(\d+\. )', chr(10) || '\1', 'g'), '\n\n- ', chr(10) || '- ', 'g') AS text FROM documents",
)
def markdown_fixed(spark, folder):
    return views.table(spark, folder, "documents").select("doc_id", judging.markdown_fixed(F.col("text")).alias("text"))


@query(
    "temperature_routing",
    "SELECT question_id, CAST(coalesce(required, CASE category WHEN 'writing' THEN 0.7 WHEN 'roleplay' THEN 0.7 WHEN 'extraction' THEN 0.0 WHEN 'math' THEN 0.0 WHEN 'coding' THEN 0.0 WHEN 'reasoning' THEN 0.0 WHEN 'stem' THEN 0.1 WHEN 'humanities' THEN 0.1 END, 0.7) AS DOUBLE) AS temperature"
    " FROM (SELECT question_id, CASE WHEN question_id % 9 = 0 THEN 'other' ELSE category END AS category, CASE WHEN question_id % 10 = 0 THEN 0.3 END AS required FROM {questions})",
)
def temperature_routing(spark, folder):
    q = views.questions(spark, folder)
    category = F.when(F.col("question_id") % 9 == 0, "other").otherwise(F.col("category"))
    required = F.when(F.col("question_id") % 10 == 0, F.lit(0.3))
    return q.select("question_id", planning.temperature(category, required).alias("temperature"))


_COUNT = "len(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f]+'))"


@query("token_budget", f"SELECT doc_id, CAST(greatest(0, 4096 - {_COUNT} - 100) AS BIGINT) AS openai, CAST(greatest(0, 4096 - {_COUNT} - 300) AS BIGINT) AS other FROM documents")
def token_budget(spark, folder):
    n = F.size(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\r\\f]+"))
    budget = lambda api: F.greatest(F.lit(0), planning.token_budget(F.lit(4096), n, api)).cast("bigint")
    return views.table(spark, folder, "documents").select("doc_id", budget("openai").alias("openai"), budget("other").alias("other"))


@query("answers_last_wins", "SELECT model, question_id, max(line) AS line, arg_max(score, line) AS score FROM {single_judgments} GROUP BY model, question_id")
def answers_last_wins(spark, folder):
    rows = views.single_judgments(spark, folder).select("model", "question_id", "line", "score").withColumn("at", F.col("line"))
    return judging.last_of(rows, "model", "question_id", order="at").select("model", "question_id", "line", "score")


@query("resume_pending", f"SELECT question_id, model FROM {{questions}} q CROSS JOIN {_MODELS} m WHERE NOT EXISTS (SELECT 1 FROM {{single_judgments}} j WHERE j.question_id = q.question_id AND j.model = m.model AND score = 10)")
def resume_pending(spark, folder):
    rows = views.single_judgments(spark, folder)
    asked = views.questions(spark, folder).select("question_id").crossJoin(F.broadcast(rows.select("model").distinct()))
    return planning.pending(asked, rows.where("score = 10"), "question_id", "model")
