"""Readers, writers, calls of outside models and streams."""

import json
from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F
from weftspark import schemas
from weftspark.functions import providers
from weftspark.operators import judging
from weftspark.sources import readers, writers
from weftspark.streaming import results


def write_lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_resolved():
    assert readers.resolved("data/x", "train", "/r") == "/r/data/x/train"
    assert readers.resolved("hub/x", "train", "/r", lambda n, s: f"/cache/{n}/{s}") == "/cache/hub/x/train"

    def gone(n, s):
        raise FileNotFoundError(n)

    assert readers.resolved("hub/x", "test", "/r", gone) == "/r/hub/x/test"
    assert readers.split_of("train", "a") == "train" and readers.split_of({"a": "test"}, "a") == "test"


def test_lines(spark, tmp_path):
    write_lines(tmp_path / "a/m1.jsonl", [{"question_id": i % 5, "answer_id": str(i)} for i in range(12)])
    write_lines(tmp_path / "a/m2.jsonl", [{"question_id": 1, "answer_id": "x"}])
    got = {(r.model, r.question_id): r.answer_id for r in readers.answers(spark, str(tmp_path / "a")).collect()}
    assert got == {("m1", 0): "10", ("m1", 1): "11", ("m1", 2): "7", ("m1", 3): "8", ("m1", 4): "9", ("m2", 1): "x"}
    assert readers.models(spark, str(tmp_path / "a")) == ["m1", "m2"]
    assert [r.question_id for r in readers.questions(spark, str(tmp_path / "a/m1.jsonl"), 2, 4).orderBy("place").collect()] == [2, 3]
    writers.reorganized(spark, str(tmp_path / "a/m1.jsonl"), schemas.ANSWERS, str(tmp_path / "out"))
    assert [r.answer_id for r in spark.read.json(str(tmp_path / "out")).orderBy("question_id").collect()] == ["10", "11", "7", "8", "9"]
    write_lines(tmp_path / "p.jsonl", [{"name": "a", "type": "x"}, {"name": "a", "type": "y"}])
    assert [r.type for r in readers.judge_prompts(spark, str(tmp_path / "p.jsonl")).collect()] == ["y"]
    write_lines(tmp_path / "s.jsonl", [{"question_id": 1, "model": "m", "judge": ["j", "p"], "score": s} for s in (3, 7)])
    assert [r.score for r in readers.single_judgments(spark, str(tmp_path / "s.jsonl")).collect()] == [7]
    pair = {"question_id": 1, "model_1": "b", "model_2": "a", "g1_winner": "model_1", "g2_winner": "model_1", "g1_judgment": "1", "g2_judgment": "2"}
    write_lines(tmp_path / "q.jsonl", [pair, pair | {"winner": "tie"}])
    out = judging.pairs_normalized(readers.pair_judgments(spark, str(tmp_path / "q.jsonl"))).collect()
    assert [(r.model_1, r.winner, r.g1_judgment) for r in out] == [("a", "tie", "2")]
    (tmp_path / "b.csv").write_text(",win,mode\nm1,3.5,v\nm2,1.0,v\n")
    assert {r.model_name: r.win for r in readers.board(spark, str(tmp_path / "b.csv")).collect()} == {"m1": 3.5, "m2": 1.0}


@dataclass
class One:
    rate: float = 0.1
    names: list[str] = field(default_factory=list)
    mix: dict[str, float] = field(default_factory=dict)


@dataclass
class Two:
    steps: int = 3
    fast: bool = False


def test_settings():
    one, two = readers.settings({"steps": 5, "rate": 0.5}, [One, Two], ["--rate=2", "--names=a,b", '--mix={"x": 0.5}', "--fast=true"])
    assert one == One(2.0, ["a", "b"], {"x": 0.5}) and two == Two(5, True)
    for kinds, more in (([One, One], []), ([One], ["--gone=1"]), ([Two], ["--fast=perhaps"])):
        with pytest.raises(ValueError):
            readers.settings({}, kinds, more)
    with pytest.raises(ValueError):
        readers.settings({"gone": 1}, [One], [])


def test_writers(spark, tmp_path):
    assert writers.cache_key(a=1, b=[2]) == writers.cache_key(b=[2], a=1) != writers.cache_key(a=1, b=[3])
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    assert writers.cached(spark, str(tmp_path), build, n=3).count() == writers.cached(spark, str(tmp_path), build, n=3).count() == 3 and len(calls) == 1
    assert writers.merged({"a": {"x": 1, "y": 1}, "b": 1, "c": 1}, {"a": {"x": 2}, "b": 2, "d": 2}) == {"a": {"x": 2, "y": 1}, "b": 1, "c": 1, "d": 2}
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "source string, pos int")
    assert json.loads(writers.mixture_report(rows)) == {"total": 3, "dataset_numbers": {"a": 2, "b": 1}, "dataset_ratio": {"a": 2 / 3, "b": 1 / 3}}
    for _ in range(2):
        writers.append_lines(rows, str(tmp_path / "l"))
        writers.save(rows, str(tmp_path / "t"), by="source")
    assert spark.read.json(str(tmp_path / "l")).count() == 6 and spark.read.parquet(str(tmp_path / "t")).count() == 3
    writers.outputs(rows, "g", str(tmp_path / "o"), order="pos")
    assert spark.read.json(str(tmp_path / "o")).where("generator = 'g'").count() == 3


def test_calls(spark):
    def echo(messages):  # goes to the workers by value
        if "fail" in messages[-1]["content"]:
            raise RuntimeError("no answer")
        return f"{len(messages)}:{messages[-1]['content']}"

    rows = spark.createDataFrame([("p1", [("user", "a"), ("assistant", "x")]), ("p2", [("user", "fail"), ("assistant", "x")])], f"prompt_id string, chosen {schemas.MESSAGES}")
    out = {r.prompt_id: r for r in providers.sampled_answers(rows, echo, 2, {"model_name": "m", "n": 2}, 2, 0).collect()}
    assert out["p1"].gen_answers == ["1:a", "1:a"] and out["p2"].gen_answers == [] and out["p1"].other_info.model_name == "m"
    ranks = providers.ranked(spark.createDataFrame([([("user", "q")], ["aa", "b"])] * 3, f"prompt_messages {schemas.MESSAGES}, gen_answers array<string>"), lambda p, a: [[len(x) for x in one] for one in a], 2)
    assert [r.ranks for r in ranks.collect()] == [[2, 1]] * 3
    q = spark.createDataFrame([(1, ["a", "b"]), (2, ["fail"])], "question_id int, turns array<string>")
    got = {r.question_id: [c.turns for c in r.choices] for r in providers.answered(q, echo, "m", 2, tries=1).collect()}
    assert got == {1: [["1:a", "3:b"]] * 2, 2: [[providers.FAILED]] * 2}
    kept = providers.answered(q.where("question_id = 1"), echo, "m", 2, keep_history=True, count=len, tries=1).collect()[0]
    assert [t.content for c in kept.choices for t in c.turns] == ["1:a", "3:b", "5:a", "7:b"] and kept.choices[0].turns[0].token_len == 3
    items = spark.createDataFrame([("a", "d"), ("fail", "d")], "instruction string, dataset string")
    assert [r.output for r in providers.outputs(items, echo, "g", wait=0).orderBy("instruction").collect()] == ["1:a", "ERROR"]
    asked = spark.createDataFrame([("say [[7]]",), ("fail",)], "prompt string")
    assert {judging_score for judging_score in [r.s for r in providers.judged(asked, echo, tries=1).select(judging.score_of(F.col("judgment")).alias("s")).collect()]} == {7.0, -1.0}
    logps = spark.createDataFrame([([1, 2], [1, 2], [3], [3])], "chosen_input_ids array<int>, chosen_labels array<int>, rejected_input_ids array<int>, rejected_labels array<int>")
    r = providers.precomputed_logps(logps, lambda ids, labels: [float(sum(x)) for x in ids]).collect()[0]
    assert (r.reference_chosen_logps, r.reference_rejected_logps) == (3.0, 3.0)


def test_games(spark):
    matches = spark.createDataFrame([(1, "m", "j", "q", "mine", "base")], "question_id int, model string, judge string, question string, answer string, baseline_answer string")

    def chat(messages):
        return "hm" if len(messages) < 4 else "A>B"

    r = providers.games(matches, chat, lambda t: ("A>B", False) if "A>B" in t else (None, True), "s", "{question} {answer_a} {answer_b}").collect()[0]
    assert [(g.user_prompt, g.judgment, g.score) for g in r.games] == [("q base mine", "hm\nA>B", "A>B"), ("q mine base", "hm\nA>B", "A>B")]


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", 4.0, 1), ("a", -1.0, 2), ("a", 6.0, 3), ("b", 1.0, 3)], "model string, score double, s int").withColumn("ts", F.timestamp_seconds("s")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("model string, score double, s int, ts timestamp").parquet(str(tmp_path / "in"))
    run = results.running_scores(stream).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {r.model: (r.score, r.n) for r in spark.table("running").collect()} == {"a": (5.0, 2), "b": (1.0, 1)}
    run = results.first_copies(stream, "model").writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("firsts").count() == 2
