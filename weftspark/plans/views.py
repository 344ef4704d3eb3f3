"""The shapes that the operators take, from the tables of a folder: once as DataFrames, once as SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ("writing", "roleplay", "reasoning", "math", "coding", "extraction", "stem", "humanities")
VERDICTS = ("A=B", "A>B", "A>>B", "B>A", "B>>A")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """(question_id, category) of 80 questions."""
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), F.col("id").cast("int") % 8 + 1)
    return spark.range(80).select(F.col("id").cast("int").alias("question_id"), category.alias("category"))


def single_judgments(spark: SparkSession, folder: str) -> DataFrame:
    """(line, question_id, model, turn, run, score): one judged answer for each event, score -1 where the judge failed."""
    e = F.col("event_id")
    score = F.when(F.col("event_type") == "error", F.lit(-1.0)).otherwise(1 + F.floor("value") % 10).cast("double")
    return table(spark, folder, "events").select(
        e.alias("line"),
        (e % 80).cast("int").alias("question_id"),
        F.concat(F.lit("m"), (F.col("user_id") % 8).cast("string")).alias("model"),
        (1 + F.expr("event_id div 80") % 2).cast("int").alias("turn"),
        (F.expr("event_id div 160") % 3).cast("int").alias("run"),
        score.alias("score"),
    )


def pair_judgments(spark: SparkSession, folder: str) -> DataFrame:
    """(line, question_id, model_1, model_2, g1_winner, g2_winner, g1_judgment, g2_judgment)."""
    name = lambda c: F.concat(F.lit("m"), (F.col(c) % 5).cast("string"))
    pick = lambda n: F.element_at(F.array(*map(F.lit, ("model_1", "model_2", "tie", "error", "model_1"))), n + 1)
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return (
        table(spark, folder, "lineitem")
        .select(
            line.alias("line"),
            (line % 80).cast("int").alias("question_id"),
            name("l_suppkey").alias("model_1"),
            name("l_partkey").alias("model_2"),
            pick(F.floor("l_quantity").cast("int") % 5).alias("g1_winner"),
            pick(F.round(F.col("l_tax") * 100).cast("int") % 5).alias("g2_winner"),
            F.concat(F.lit("first "), line.cast("string")).alias("g1_judgment"),
            F.concat(F.lit("second "), line.cast("string")).alias("g2_judgment"),
        )
        .where("model_1 != model_2")
    )


def arena_judgments(spark: SparkSession, folder: str) -> DataFrame:
    """(question_id, model, games): two games of each model against the baseline ``base``, the second with places swapped."""
    verdict = lambda n: F.struct(F.element_at(F.array(*map(F.lit, VERDICTS), F.lit(None).cast("string")), n + 1).alias("score"))
    return table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("question_id"),
        F.concat(F.lit("m"), (F.col("l_suppkey") % 8).cast("string")).alias("model"),
        F.array(verdict(F.round(F.col("l_discount") * 100).cast("int") % 6), verdict(F.round(F.col("l_tax") * 100).cast("int") % 6)).alias("games"),
    )


def answer_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """(model, question_id, token_len) of answers; one model has none."""
    return table(spark, folder, "part").select(F.concat(F.lit("m"), (F.col("p_partkey") % 7).cast("string")).alias("model"), F.col("p_partkey").alias("question_id"), F.col("p_size").alias("token_len"))


def mix_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(source, pos, text) of documents."""
    return table(spark, folder, "documents").where("source is not null").select("source", F.col("doc_id").alias("pos"), "text")


def dialogues(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """(pair_id, columns...) of preference_pairs, a pair_id once: the delivery that came first. Only the named columns are read, or else all of these."""
    pairs = table(spark, folder, "preference_pairs").withColumnRenamed("dataset_mix_source", "source")
    keep = columns or ("source", "split", "prompt_id", "prompt", "messages", "chosen", "rejected", "score_chosen", "score_rejected")
    return pairs.groupBy("pair_id").agg(F.min_by(F.struct(*keep), "ingested_at").alias("r")).select("pair_id", "r.*")


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """(gen_id, prompt_id, gen_answers, model_name) of gen_preference_pairs, a gen_id once; null answers are left out of the lists."""
    own = table(spark, folder, "gen_preference_pairs")
    once = own.groupBy("gen_id").agg(F.min_by(F.struct("prompt_id", "gen_answers", "other_info"), "ingested_at").alias("r"))
    answers = F.coalesce(F.filter("r.gen_answers", lambda x: x.isNotNull()), F.array().cast("array<string>"))
    return once.select("gen_id", "r.prompt_id", answers.alias("gen_answers"), F.col("r.other_info.model_name").alias("model_name"))


def sequences(spark: SparkSession, folder: str) -> DataFrame:
    """(source, pos, row_id, input_ids) of sft_tokenized, a row_id once; null sequences are empty."""
    once = table(spark, folder, "sft_tokenized").groupBy("row_id").agg(F.min_by(F.struct(F.col("dataset_mix_source").alias("source"), "pos", "input_ids"), "tokenized_at").alias("r"))
    return once.select(F.coalesce("r.source", F.lit("none")).alias("source"), F.col("r.pos").alias("pos"), "row_id", F.coalesce("r.input_ids", F.array().cast("array<int>")).alias("input_ids"))


def logps(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, batch, pc, pr, rc, rr): log-probabilities of the chosen and rejected answer, by the policy and the reference."""
    part = lambda i: (F.col("embedding")[i].cast("double") * 10).alias(("pc", "pr", "rc", "rr")[i])
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), F.expr("vec_id div 32").alias("batch"), *map(part, range(4)))


def logits(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, pos, logits, label): ten positions a sequence; every seventh label is masked."""
    label = F.when(F.col("vec_id") % 7 == 3, F.lit(-100)).otherwise(F.col("label")).cast("int")
    return table(spark, folder, "embeddings").select(F.expr("vec_id div 10").alias("row_id"), (F.col("vec_id") % 10).cast("int").alias("pos"), F.transform("embedding", lambda x: x.cast("double")).alias("logits"), label.alias("label"))


def judge_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(line, judgment): verdict texts of several shapes."""
    n = F.floor("value").cast("bigint")
    shapes = [
        F.concat(F.lit("Rating: [["), (n % 11).cast("string"), F.lit("]]")),
        F.concat(F.lit("I give [["), (n % 10).cast("string"), F.lit(".5]] and [[3]]")),
        F.concat(F.lit("Score: ["), (n % 10).cast("string"), F.lit("]")),
        F.lit("My final verdict is tie: [[A=B]]"),
        F.concat(F.lit("[[A>B]] so "), F.when(n % 2 == 0, F.lit("[[A>B]]")).otherwise(F.lit("[[B>>A]]"))),
        F.lit("Assistant A is better: [[A]], not [[B]]"),
        F.concat(F.lit("["), (n % 10).cast("string"), F.lit(".0] against ["), (n % 3).cast("string"), F.lit("]")),
        F.lit("no verdict"),
    ]
    shape = F.element_at(F.array(*shapes), (F.col("event_id") % 8).cast("int") + 1)
    return table(spark, folder, "events").select(F.col("event_id").alias("line"), shape.alias("judgment"))


#: The same in SQL for DuckDB.
SQL = {
    "questions": f"SELECT CAST(range AS INTEGER) AS question_id, list_extract({list(CATEGORIES)!r}, CAST(range % 8 + 1 AS INTEGER)) AS category FROM range(80)",
    "single_judgments": "SELECT event_id AS line, CAST(event_id % 80 AS INTEGER) AS question_id, concat('m', user_id % 8) AS model, CAST(1 + (event_id // 80) % 2 AS INTEGER) AS turn,"
    " CAST((event_id // 160) % 3 AS INTEGER) AS run, CAST(CASE WHEN event_type = 'error' THEN -1 ELSE 1 + CAST(floor(value) AS BIGINT) % 10 END AS DOUBLE) AS score FROM events",
    "pair_judgments": "SELECT * FROM (SELECT l_orderkey * 10 + l_linenumber AS line, CAST((l_orderkey * 10 + l_linenumber) % 80 AS INTEGER) AS question_id, concat('m', l_suppkey % 5) AS model_1, concat('m', l_partkey % 5) AS model_2,"
    " list_extract(['model_1', 'model_2', 'tie', 'error', 'model_1'], CAST(floor(l_quantity) AS INTEGER) % 5 + 1) AS g1_winner, list_extract(['model_1', 'model_2', 'tie', 'error', 'model_1'], CAST(round(l_tax * 100) AS INTEGER) % 5 + 1) AS g2_winner,"
    " concat('first ', l_orderkey * 10 + l_linenumber) AS g1_judgment, concat('second ', l_orderkey * 10 + l_linenumber) AS g2_judgment FROM lineitem) WHERE model_1 <> model_2",
    "arena_judgments": f"SELECT l_orderkey * 10 + l_linenumber AS question_id, concat('m', l_suppkey % 8) AS model, list_extract({list(VERDICTS)!r}, CAST(round(l_discount * 100) AS INTEGER) % 6 + 1) AS s1,"
    f" list_extract({list(VERDICTS)!r}, CAST(round(l_tax * 100) AS INTEGER) % 6 + 1) AS s2 FROM lineitem",
    "answer_lengths": "SELECT concat('m', p_partkey % 7) AS model, p_partkey AS question_id, p_size AS token_len FROM part",
    "mix_rows": "SELECT source, doc_id AS pos, text FROM documents WHERE source IS NOT NULL",
    "dialogues": "SELECT pair_id, dataset_mix_source AS source, split, prompt_id, prompt, messages, chosen, rejected, score_chosen, score_rejected FROM preference_pairs QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY ingested_at) = 1",
    "candidates": "SELECT gen_id, prompt_id, coalesce(list_filter(gen_answers, lambda x: x IS NOT NULL), []) AS gen_answers, other_info.model_name AS model_name FROM gen_preference_pairs QUALIFY row_number() OVER (PARTITION BY gen_id ORDER BY ingested_at) = 1",
    "sequences": "SELECT coalesce(dataset_mix_source, 'none') AS source, pos, row_id, coalesce(input_ids, []) AS input_ids FROM sft_tokenized QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY tokenized_at) = 1",
    "logps": "SELECT vec_id AS row_id, vec_id // 32 AS batch, CAST(embedding[1] AS DOUBLE) * 10 AS pc, CAST(embedding[2] AS DOUBLE) * 10 AS pr, CAST(embedding[3] AS DOUBLE) * 10 AS rc, CAST(embedding[4] AS DOUBLE) * 10 AS rr FROM embeddings",
    "logits": "SELECT vec_id // 10 AS row_id, CAST(vec_id % 10 AS INTEGER) AS pos, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS logits, CAST(CASE WHEN vec_id % 7 = 3 THEN -100 ELSE label END AS INTEGER) AS label FROM embeddings",
    "judge_texts": "SELECT event_id AS line, CASE event_id % 8 WHEN 0 THEN concat('Rating: [[', n % 11, ']]') WHEN 1 THEN concat('I give [[', n % 10, '.5]] and [[3]]') WHEN 2 THEN concat('Score: [', n % 10, ']') WHEN 3 THEN 'My final verdict is tie: [[A=B]]'"
    " WHEN 4 THEN concat('[[A>B]] so ', CASE WHEN n % 2 = 0 THEN '[[A>B]]' ELSE '[[B>>A]]' END) WHEN 5 THEN 'Assistant A is better: [[A]], not [[B]]' WHEN 6 THEN concat('[', n % 10, '.0] against [', n % 3, ']') ELSE 'no verdict' END AS judgment"
    " FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS n FROM events)",
}


def with_views(sql: str) -> str:
    """The SQL with each ``{view}`` as a subquery; other braces stay."""
    return re.sub(r"\{(\w+)\}", lambda m: f"({SQL[m[1]]})" if m[1] in SQL else m[0], sql)
