"""Operators against plain restatements, and odd rows."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from weftspark.operators import arena, chat, judging, leaderboard, losses, mixing, planning, preferences, rollups, tokens

FEW = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
MSG = "array<struct<role string, content string>>"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).collect()[0].x


def pack_plain(docs, length):
    chunks, offsets, buffer, own = [], [], [], []
    for ids in docs:
        if buffer:
            own.append(len(buffer))
        buffer = buffer + ids
        while len(buffer) > length:
            chunks.append(buffer[:length])
            buffer = buffer[length:]
            if not own or own[-1] != length:
                own.append(length)
            offsets.append(own)
            own = []
    return list(zip(chunks, offsets))


@FEW
@given(st.lists(st.integers(0, 23), max_size=14), st.integers(1, 9))
def test_packing(spark, sizes, length):
    docs, n = [], 0
    for s in sizes:
        docs.append(list(range(n, n + s)))
        n += s
    rows = spark.createDataFrame([(0, i, d) for i, d in enumerate(docs)], "batch int, pos int, input_ids array<int>")
    found = sorted(tokens.packed(rows, length).collect(), key=lambda r: r.chunk)
    assert [(r.input_ids, r.cu_seqlens) for r in found] == pack_plain(docs, length)
    kept = [x for r in sorted(tokens.packed(rows, length, drop_tail=False).collect(), key=lambda r: r.chunk) for x in r.input_ids]
    assert kept == list(range(n))


def mask_plain(ids, begin, end):
    ends = lambda p: [i + len(p) for i in range(len(ids) + 1 - len(p)) if ids[i : i + len(p)] == p]
    events = sorted([(x, 0) for x in ends(begin)] + [(x, 1) for x in ends(end)], key=lambda x: x[0])
    keep = set()
    for (p, a), (q, b) in zip(events, events[1:]):
        if (a, b) == (0, 1):
            keep.update(range(p, q))
    return [x if i in keep else -100 for i, x in enumerate(ids)]


@FEW
@given(st.lists(st.integers(1, 4), max_size=25), st.sampled_from([([1], [2]), ([1, 1], [2]), ([1, 2], [3, 3]), ([1], [2, 2, 1])]))
def test_masking(spark, ids, patterns):
    rows = spark.createDataFrame([(ids,)], "input_ids array<int>")
    assert tokens.masked_labels(rows, *patterns).collect()[0].labels == mask_plain(ids, *patterns)


def test_mostly_learned(spark):
    rows = spark.createDataFrame([(1, [-100] * 9 + [5]), (2, [-100] * 10), (3, [])], "k int, labels array<int>")
    assert {r.k for r in tokens.mostly_learned(rows).collect()} == {1, 3}


def dpo_plain(p, full, bos, eos):
    n = len(p) if full[: len(p)] == p else max(len(p) - 1, 0)
    a, b = full[:n], full[n:]
    return (a if a[:1] == [bos] else [bos] + a), (b if b[-1:] == [eos] else b + [eos])


@FEW
@given(st.lists(st.integers(3, 5), max_size=9), st.lists(st.integers(3, 5), max_size=9), st.lists(st.integers(1, 5), max_size=9), st.sampled_from(["keep_end", "keep_start"]), st.booleans())
def test_dpo_rows(spark, p, c, r, keep, merged):
    full = lambda a: (p[:-1] + [9] + a) if merged and p else p + a
    rows = spark.createDataFrame([(p, full(c), full(r))], "prompt_ids array<int>, chosen_full array<int>, rejected_full array<int>")
    got = tokens.dpo_rows(rows, 1, 2, 10, 4, keep).collect()[0]
    sides = [dpo_plain(p, full(a), 1, 2) for a in (c, r)]
    longer = max(len(b) for _, b in sides)
    for name, (a, b) in zip(("chosen", "rejected"), sides):
        if len(a) + longer > 10:
            a = a[:4] if keep == "keep_start" else a[-4:]
        if len(a) + longer > 10:
            b = b[:6]
        assert got[f"{name}_input_ids"] == a + b
        assert got[f"{name}_labels"] == [-100] * len(a) + b
        assert got[f"{name}_attention_mask"] == [True] * len(a + b)
    assert got.valid


def test_padding_and_masks(spark):
    rows = spark.createDataFrame([(0, 0, [1, 2, 3], [True] * 3), (0, 1, [4], [True]), (1, 0, [], [])], "batch int, pos int, ids array<int>, m array<boolean>")
    out = sorted(tokens.padded(rows, {"ids": 0, "m": False}, multiple=4).collect(), key=lambda r: (r.batch, r.pos))
    assert [r.ids for r in out] == [[1, 2, 3, 0], [4, 0, 0, 0], []]
    masked = tokens.mask_rounded(tokens.padded(rows, {"ids": 0, "m": False}, multiple=4), mask="m", multiple=8).collect()
    assert [r.m for r in sorted(masked, key=lambda r: (r.batch, r.pos))][:2] == [[True] * 4, [True] * 4]
    three = tokens.mask_rounded(tokens.padded(rows, {"ids": 0, "m": False}, multiple=4), mask="m", multiple=3).collect()
    assert [r.m for r in sorted(three, key=lambda r: (r.batch, r.pos))][:2] == [[True] * 4, [True, True, False, False]]
    cu = spark.createDataFrame([(0, 0, [2, 5]), (0, 1, [5]), (0, 2, [1, 3])], "batch int, pos int, cu_seqlens array<int>")
    assert tokens.combined_offsets(cu).collect()[0].cu_seqlens == [0, 2, 5, 10, 11, 13]
    assert tokens.stacked(rows.where("batch = 1"), ids="ids").collect()[0].length == 0
    with pytest.raises(Exception, match="differ"):
        tokens.stacked(rows, ids="ids").collect()


def test_templates(spark):
    m = [("system", " be brief "), ("user", " hi "), ("assistant", "yes ")]
    rows = spark.createDataFrame([(1, m), (2, [("", "")] + m[1:]), (3, [("assistant", "a"), ("user", "b")]), (4, [])], f"k int, messages {MSG}")
    text = lambda t, **o: {r.k: r.t for r in rows.select("k", chat.render(F.col("messages"), t, **o).alias("t")).collect()}
    assert text("default")[1] == "<|system|>\n be brief </s>\n<|user|>\n hi </s>\n<|assistant|>\nyes </s>\n"
    assert text("no_special")[1] == "System: be brief User: hi Assistant: yes </s>"
    assert text("ultralm")[2] == "User: hi\nAssistant: yes </s>\n"
    assert text("vicuna")[1] == "<s>be brief USER: hi ASSISTANT: yes</s>" and text("vicuna")[3] is None
    assert text("alpaca")[1] == "<s>be brief\n### Instruction:\nhi\n### Response:\nyes</s>\n"
    assert text("star")[1] == "<|system|>\nbe brief<|end|><|user|>\nhi<|end|><|assistant|>\nyes <|end|>"
    assert text("chatml", generation=True)[4] == "" and text("chatml", generation=True)[2].endswith("<|im_start|>assistant\n")
    assert text("gemma")[1] == "<start_of_turn>user\n hi <end_of_turn>\n<start_of_turn>model\nyes <end_of_turn>\n"
    with pytest.raises(Exception, match="alternate"):
        rows.select(chat.render(F.col("messages"), "vicuna", strict=True)).collect()
    with pytest.raises(ValueError):
        chat.formatted(rows, "other", "default")
    with pytest.raises(ValueError):
        chat.formatted(rows, "dpo", "default")
    assert chat.evaluation_template("x-templ_zephyr") == "zephyr" and chat.evaluation_template("x") is None
    assert chat.active_template(None, None, True) == "default"
    part = spark.range(4000).select(chat.chance(F.col("id")).alias("x")).agg(F.avg((F.col("x") < 0.8).cast("int"))).collect()[0][0]
    assert abs(part - 0.8) < 0.03


@pytest.mark.parametrize(
    "text, score, pair, both, arena_score, again",
    [("[[7]]", 7, "error", "error", None, True), ("[[7.5]] [3]", 7.5, "error", "error", None, True), ("[8]", 8, "error", "error", None, True), ("none", -1, "error", "error", None, True), ("[[A]] [[B]]", -1, "A", "error", None, False)]
    + [("[[C]]", -1, "tie", "error", None, True), ("[[3, 3.05]]", -1, "error", "tie", None, True), ("[[3, 3.1]]", -1, "error", "B", None, True), ("[3,2]", -1, "error", "A", None, True), ("[[A>B]] [[A>B]]", -1, "error", "error", "A>B", False), ("[[A>B]] [[B>A]]", -1, "error", "error", None, False)],
)
def test_verdicts(spark, text, score, pair, both, arena_score, again):
    t = F.lit(text)
    assert one(spark, judging.score_of(t)) == score
    assert one(spark, judging.pair_verdict(t)) == pair
    assert one(spark, judging.score_verdict(t)) == both
    v = one(spark, judging.arena_verdict(t))
    assert (v.score, v.again) == (arena_score, again) or text in ("[[C]]",)


def test_battles_and_ratings(spark):
    games = [("A>>B", "B>A"), ("A=B", None), ("B>A", "A>>B"), ("odd", "A>B")]
    rows = spark.createDataFrame([(i, "m", [(a,), (b,)]) for i, (a, b) in enumerate(games)], "question_id int, model string, games array<struct<score string>>")
    found = sorted((r.question_id, r.winner, r.weight) for r in arena.battles(rows).collect())
    assert found == [(0, "model_a", 1), (0, "model_a", 3), (1, "tie", 1), (2, "model_b", 1), (2, "model_b", 3), (3, "model_b", 1)]
    assert arena.replicated(arena.battles(rows)).count() == 10
    elo = {r.model: r.elo for r in arena.elo(arena.battles(rows)).collect()}
    w = (1 + 3 + 1 + 0.5) / 10
    assert elo["base"] == 1000 and abs(elo["m"] - 1000 - 400 * math.log10(w / (1 - w))) < 1e-9
    won = spark.createDataFrame([("base", "m", "model_b", 1)], "model_a string, model_b string, winner string, weight int")
    assert {r.model: r.elo for r in arena.elo(won).collect()} == {"base": 1000.0, "m": None}
    assert {r.model: r.elo for r in arena.elo(won.limit(0)).collect()} == {}


def test_general_rating_equals_the_star():
    star = [("base", f"m{i}", 100.0, 20.0 + 13 * i) for i in range(5)]
    found = arena.solved(star, "base")
    for _, m, n, p in star:
        assert abs(found[m] - 1000 - 400 * math.log10(p / n / (1 - p / n))) < 1e-6
    assert math.isnan(arena.solved([("a", "b", 3, 3.0)], "a")["b"])
    assert arena.solved([]) == {}


def test_bootstrap_is_centred(spark):
    rows = spark.createDataFrame([("base", "m", w, 1) for w in ["model_a"] * 300 + ["model_b"] * 200 + ["tie"] * 100], "model_a string, model_b string, winner string, weight int")
    b = {r.model: r for r in arena.intervals(arena.bootstrap(rows)).collect()}["m"]
    exact = {r.model: r.elo for r in arena.elo(rows).collect()}["m"]
    assert b.lower < exact < b.upper and abs(b.median - exact) < 10 and 30 < b.upper - b.lower < 90
    assert arena.bootstrap(rows.limit(0)).count() == 0


def test_losses_are_stable(spark):
    rows = spark.createDataFrame([(i, 0, v, -v, 0.0, 0.0) for i, v in enumerate((0.0, 1e6, -1e6))], "row_id int, batch int, pc double, pr double, rc double, rr double")
    for kind in losses.LOSSES:
        assert all(math.isfinite(r.loss) for r in losses.losses(rows, kind).collect())
    assert abs(losses.losses(rows, "sigmoid").where("row_id = 0").collect()[0].loss - math.log(2)) < 1e-12
    with pytest.raises(ValueError):
        losses.losses(rows, "other")


def test_mixing_does_not_hang_on_partitions(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, "b").otherwise("c").alias("source"), F.col("id").alias("pos"), (F.col("id") % 500).cast("string").alias("text"))
    fractions = {"hot": 2.3, "b": 0.5, "c": 0.0}
    out = [sorted(map(tuple, mixing.mixed(rows.repartition(n), fractions).select("source", "pos", "copy").collect())) for n in (1, 4, 16)]
    assert out[0] == out[1] == out[2]
    n = {s: c for s, c in rows.groupBy("source").count().collect()}
    taken = [r[0] for r in out[0]]
    assert taken.count("hot") == 2 * n["hot"] + int(2.3 % 1 * n["hot"]) and taken.count("b") == int(0.5 * n["b"]) and "c" not in taken
    for bad in ({"hot": -1.0},):
        with pytest.raises(ValueError):
            mixing.mixed(rows, bad)
    with pytest.raises(ValueError):
        mixing.datasets({"hot": rows.drop("text")}, {"hot": 1.0}, key="text")
    with pytest.raises(ValueError):
        mixing.datasets({"hot": rows.limit(0)}, {"hot": 1.0})
    with pytest.raises(ValueError):
        mixing.split_mix(rows.withColumn("split", F.lit("dev")), {"hot": 1.0})
    assert mixing.deduplicated(rows, "text").count() == 500
    assert mixing.deduplicated(spark.createDataFrame([("a", 1, None), ("a", 2, None), ("b", 1, "")], "source string, pos int, text string"), "text").count() == 2


def test_small_remainders_are_for_mixes_only(spark):
    rows = spark.range(1000).select(F.lit("a").alias("source"), F.col("id").alias("pos"), F.col("id").cast("string").alias("text"))
    assert mixing.mixed(rows, {"a": 1.01}).count() == 1010
    stages = mixing.staged(rows, {"one": {"a": 1.009}, "two": {"a": 0.02}}, "text")
    assert {r.stage: r["count"] for r in stages.groupBy("stage").count().collect()} == {"one": 1000, "two": 20}


def test_preferences(spark):
    rows = spark.createDataFrame([(1, []), (2, ["a"]), (3, ["a", "a"]), (4, ["a", "b"])], "k int, gen_answers array<string>")
    assert [r.k for r in preferences.varied(rows).collect()] == [4]
    p = one(spark, preferences.best_worst(F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, (2, 1, 1, 2)))))
    assert tuple(p) == ("b", "a", 1, 2)
    many = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "prompt_id string, v int")
    assert [tuple(r) for r in preferences.unambiguous(many).collect()] == [("y", 3)]
    asked = spark.createDataFrame([([("user", "q")], ["a", "b"], [2, 1])], f"prompt_messages {MSG}, gen_answers array<string>, ranks array<int>")
    pair = preferences.ranked_pairs(asked).collect()[0]
    assert [m.content for m in pair.chosen] == ["q", "b"] and [m.content for m in pair.rejected] == ["q", "a"] and pair.messages == pair.chosen


def test_small_things(spark):
    assert one(spark, planning.temperature(F.lit("math"))) == 0.0 and one(spark, planning.temperature(F.lit("zzz"))) == 0.7 and one(spark, planning.temperature(F.lit("math"), F.lit(0.4))) == 0.4
    assert one(spark, planning.token_budget(F.lit(1000), None)) == 1000 and one(spark, planning.token_budget(F.lit(1000), F.lit(100), "other")) == 600
    assert one(spark, judging.markdown_fixed(F.lit("a\n\n1. x\n\n- y •z"))) == "a\n1. x\n- y - z"
    assert one(spark, judging.rendered(F.lit("{a}{b}{c}"), {"a": F.lit("1"), "b": F.lit(None)})) == "1{c}"
    assert one(spark, judging.explanation(F.lit("m"), F.lit(7.0), F.lit(None))) == "N/A"
    q = spark.createDataFrame([(1, "math"), (2, "stem")], "question_id int, category string")
    models = spark.createDataFrame([("a",), ("b",)], "model string")
    assert {r.question_id: r.needs_reference for r in planning.by_reference(q).collect()} == {1: True, 2: False}
    done = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "question_id int, model string")
    assert [tuple(r) for r in planning.missing(q, models, done).collect()] == [(2, "b")]
    with pytest.raises(ValueError, match="b: 2"):
        planning.complete(q, models, done)
    board = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0)], "model_name string, mode string, v double")
    assert rollups.board_row(board, "b") == {"model_name": "b", "v": 2.0}
    with pytest.raises(ValueError):
        rollups.board_row(board, "c")
    assert leaderboard.win_rates(spark.createDataFrame([], "model_1 string, model_2 string, g1_winner string, g2_winner string")).collect() == []


def test_wins_and_losses_balance(spark):
    rng = random.Random(2)
    pick = lambda: rng.choice(["model_1", "model_2", "tie", "error"])
    rows = spark.createDataFrame([("a", "b", pick(), pick()) for _ in range(200)], "model_1 string, model_2 string, g1_winner string, g2_winner string")
    out = leaderboard.win_rates(rows).collect()
    assert sum(r.win for r in out) == sum(r.loss for r in out) and len({r.tie for r in out}) == 1
