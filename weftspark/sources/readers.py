"""Readers of datasets, of files of JSON lines to which rows are appended, of leaderboards and of settings."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import fields, is_dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftspark import schemas

LOCAL = ("data/", "dataset/")


def resolved(name: str, split: str, root: str = ".", remote: Callable[[str, str], str] | None = None) -> str:
    """Path of a dataset's split: below root for names that begin with data/ or dataset/, else where ``remote`` says.

    If remote has none (it raises FileNotFoundError) the name is looked for below root too.
    """
    own = f"{root}/{name}/{split}"
    if name.startswith(LOCAL) or remote is None:
        return own
    try:
        return remote(name, split)
    except FileNotFoundError:
        return own


def split_of(splits: str | Mapping[str, str], name: str) -> str:
    """The split of a dataset: one for all, or by name."""
    return splits if isinstance(splits, str) else splits[name]


def dataset(spark: SparkSession, name: str, splits: str | Mapping[str, str], keep: list[str] | None = None, **where) -> DataFrame:
    """A dataset's split from parquet; of the columns of keep those that there are."""
    df = spark.read.parquet(resolved(name, split_of(splits, name), **where))
    return df if keep is None else df.select(*(c for c in keep if c in df.columns))


def lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows of JSON lines with ``file``, and ``line``, which orders the rows of a file as they were written.

    A row's order is its place in the file, by the block that it was read from and the rows before it in that block.
    """
    rows = spark.read.schema(schema).json(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.jsonl?)?$", 1)
    return rows.select("*", name.alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line"))


def last_lines(rows: DataFrame, *key: str) -> DataFrame:
    """For each key the row that was written last; files count in the order of their names."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("file", "line")).alias("r")).select(*key, "r.*").drop("file", "line")


def questions(spark: SparkSession, path: str, begin: int | None = None, end: int | None = None, schema: str = schemas.QUESTIONS) -> DataFrame:
    """Questions in the order of the file, from begin up to before end. The file is small: its rows are numbered in one task."""
    rows = lines(spark, path, schema).withColumn("place", F.row_number().over(Window.orderBy("file", "line")) - 1)
    if begin is not None:
        rows = rows.where(F.col("place") >= begin)
    if end is not None:
        rows = rows.where(F.col("place") < end)
    return rows.drop("file", "line")


def answers(spark: SparkSession, folder: str, schema: str = schemas.ANSWERS) -> DataFrame:
    """(model, question_id, ...) of a folder with a file for each model, the last line of each question."""
    return last_lines(lines(spark, folder, schema).withColumn("model", F.col("file")), "model", "question_id")


def models(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files of answers in a folder."""
    rows = spark.read.text(f"{folder}/*.jsonl").select(F.regexp_extract("_metadata.file_name", r"^(.*)\.jsonl$", 1).alias("m")).distinct()
    return sorted(r.m for r in rows.collect())


def judge_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Judge prompts, the last of each name."""
    return last_lines(lines(spark, path, schemas.JUDGE_PROMPTS), "name")


def single_judgments(spark: SparkSession, path: str) -> DataFrame:
    """Judgments of single answers, the last of each judge, question and model."""
    return last_lines(lines(spark, path, schemas.SINGLE_JUDGMENTS), "judge", "question_id", "model")


def pair_judgments(spark: SparkSession, path: str) -> DataFrame:
    """All lines of pair judgments with ``line``; see operators.judging.pairs_normalized."""
    return lines(spark, path, schemas.PAIR_JUDGMENTS)


def board(spark: SparkSession, path: str) -> DataFrame:
    """A leaderboard from CSV whose first column, without a name, is the model."""
    return spark.read.csv(path, header=True, inferSchema=True).withColumnRenamed("_c0", "model_name")


def cast_setting(text: str, kind: object) -> object:
    """A setting from the command line as its field's type: numbers, truth values, lists at commas, objects in JSON."""
    name = kind if isinstance(kind, str) else getattr(kind, "__name__", str(kind)) if not hasattr(kind, "__origin__") else str(kind)
    name = name.lower()
    if "dict" in name:
        return json.loads(text)
    if "list" in name:
        return [x for x in text.split(",") if x]
    if "bool" in name:
        if text.lower() not in ("true", "false", "1", "0", "yes", "no"):
            raise ValueError(f"{text!r} is no truth value")
        return text.lower() in ("true", "1", "yes")
    return int(text) if re.search(r"\bint\b", name) else float(text) if "float" in name else text


def settings(base: Mapping[str, object], kinds: list[type], overrides: list[str]) -> list:
    """Objects of the dataclasses from a mapping, as of a YAML file, with overrides ``--name=value``.

    Raises ValueError for a name that two classes have, or none has.
    """
    owner: dict[str, tuple[type, object]] = {}
    for kind in kinds:
        if not is_dataclass(kind):
            raise TypeError(f"{kind} is no dataclass")
        for f in fields(kind):
            if f.name in owner:
                raise ValueError(f"two classes have {f.name}")
            owner[f.name] = (kind, f.type)
    values = dict(base)
    for item in overrides:
        name, sep, text = item.removeprefix("--").partition("=")
        if not sep or name not in owner:
            raise ValueError(f"unknown setting {item!r}")
        values[name] = cast_setting(text, owner[name][1])
    unknown = [k for k in values if k not in owner]
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return [kind(**{k: v for k, v in values.items() if owner[k][0] is kind}) for kind in kinds]


def settings_file(path: str) -> dict:
    """Settings from a file of YAML, if that library is there, or of JSON."""
    text = Path(path).read_text()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text) or {}
