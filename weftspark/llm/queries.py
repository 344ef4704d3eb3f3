"""Queries of the eight training-data problems; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.llm.defects import defective_answers
from weftspark.llm.encode import encode_ids
from weftspark.llm.leaks import leaked_items
from weftspark.llm.mixing import mixed
from weftspark.llm.packing import packed
from weftspark.llm.quality import not_prose, text_kinds
from weftspark.llm.ranking import ranking
from weftspark.llm.splits import cross_split_pairs, cross_split_report


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus, record_id, item_id) for every eval_items row in a text of documents or a prompt of a train row."""
    pairs = _table(spark, sf_dir, "preference_pairs").where("split = 'train'")
    texts = _table(spark, sf_dir, "documents").select(F.lit("documents").alias("corpus"), F.col("doc_id").alias("record_id"), "text")
    texts = texts.unionAll(pairs.select(F.lit("preference_pairs"), "pair_id", "prompt"))
    return leaked_items(texts, _table(spark, sf_dir, "eval_items"))


def p2_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place, model, strength, n_verdicts) for every model of arena_hard_battles."""
    return ranking(_table(spark, sf_dir, "arena_hard_battles"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(answer_field, record_id, answer_no, defect) of every defective answer of the three tables."""
    return defective_answers(*(_table(spark, sf_dir, t) for t in ("preference_pairs", "alpaca_eval_outputs", "gen_preference_pairs", "documents")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id_1, pair_id_2) for every train row and validation or test row with the same or almost the same record."""
    pairs = cross_split_pairs(_table(spark, sf_dir, "preference_pairs"))
    return pairs.select(F.least("held_id", "train_id").alias("pair_id_1"), F.greatest("held_id", "train_id").alias("pair_id_2"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p4_found has, counted for each split and source."""
    return cross_split_report(_table(spark, sf_dir, "preference_pairs"))


def p5_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(config_name, seq_no, seq_offset, row_id, row_offset, input_ids): sft_tokenized packed for every row of sft_config."""
    return packed(_table(spark, sf_dir, "sft_tokenized"), _table(spark, sf_dir, "sft_config"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) for every row of documents, null and empty texts included."""
    return encode_ids(_table(spark, sf_dir, "documents"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mix_name, source, doc_id, n_tokens, times): the documents of every mix of mix_targets and how often each is used."""
    return mixed(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the sources of every mix were to reach and did reach."""
    return mixed(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kind) of the documents that are lists, tables or junk."""
    return not_prose(_table(spark, sf_dir, "documents"))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, the statistics, kind, posterior) of every document."""
    return text_kinds(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_ranking": p2_ranking, "p3_found": p3_found, "p4_found": p4_found, "p4_report": p4_report, "p5_packed": p5_packed, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_report": p7_report, "p8_found": p8_found, "p8_statistics": p8_statistics}


def oracle_sql() -> dict[str, str]:
    """None of these can be said in SQL that runs on whole tables; their tests are in tests/llm."""
    return {}
