import __spark_entry__ as e
import numpy as np
import pandas as pd
from weftspark.llm.ranking import stationary

SF = "/root/testdata/sf0.01"


def test_strengths_come_back_however_often_models_met():
    s = np.array([0.5, 0.25, 0.15, 0.07, 0.03])
    met = np.random.default_rng(1).integers(0, 1000, (5, 5))
    met = met + met.T + 1
    wins = met * s[:, None] / (s[:, None] + s[None, :])
    np.fill_diagonal(wins, 0)
    assert np.allclose(stationary(wins), s, rtol=1e-8)


def test_every_model_has_a_place(spark):
    b = pd.read_parquet(f"{SF}/arena_hard_battles.parquet").drop_duplicates("battle_id")
    rows = e.queries()["p2_ranking"](spark, SF).collect()
    assert {r.model for r in rows} == set(b.model_a) | set(b.model_b)
    assert [r.place for r in rows] == list(range(1, len(rows) + 1))
    assert abs(sum(r.strength for r in rows) - 1) < 1e-9 and min(r.strength for r in rows) > 0
    v = b[b.winner.fillna("").str.strip().str.lower().str.match(r"model_|tie") & (b.model_a != b.model_b)]
    assert sum(r.n_verdicts for r in rows) == 2 * len(v)


def test_verdicts(spark, tmp_path):
    one = [("x", "y", " Model_A")] * 3 + [("y", "z", "model_b ")] + [("z", "y", "TIE"), ("y", "z", "tie (bothbad)")]
    none = [("z", "x", w) for w in ("error", "", None)] + [("z", "z", "model_a"), ("q", "x", None)]
    rows = [(i, *r, float(i)) for i, r in enumerate(one + none)]
    again = [(*rows[3][:4], 99.0)] * 5
    spark.createDataFrame(rows + again, "battle_id bigint, model_a string, model_b string, winner string, tstamp double").write.parquet(f"{tmp_path}/arena_hard_battles.parquet")
    found = {r.model: r for r in e.queries()["p2_ranking"](spark, str(tmp_path)).collect()}
    assert {m: r.n_verdicts for m, r in found.items()} == {"x": 3, "y": 6, "z": 3, "q": 0}
    assert found["x"].place == 1 and found["y"].place == 4


def test_counts_do_not_bias_and_frames_give_the_same(spark, monkeypatch):
    from weftspark.llm import ranking as r

    rng = np.random.default_rng(3)
    s = np.exp(rng.normal(0, 1, 8))
    rows, k = [], 0
    for i in range(8):
        for j in range(i):
            for _ in range(int(rng.integers(20, 400))):
                rows.append((k, f"m{i}", f"m{j}", "model_a" if rng.random() < s[i] / (s[i] + s[j]) else "model_b", float(k)))
                k += 1
    df = spark.createDataFrame(rows, "battle_id bigint, model_a string, model_b string, winner string, tstamp double")
    found = {x.model: x for x in r.ranking(df).collect()}
    order = sorted(range(8), key=lambda i: -s[i])
    places = [found[f"m{i}"].place for i in order]
    assert sum(abs(p - q - 1) for q, p in enumerate(places)) <= 4
    monkeypatch.setattr(r, "DRIVER_PAIRS", 0)
    again = {x.model: x for x in r.ranking(df).collect()}
    assert all(again[m].place == x.place and again[m].n_verdicts == x.n_verdicts and abs(again[m].strength / x.strength - 1) < 1e-3 for m, x in found.items())


def test_no_battles(spark):
    from weftspark.llm.ranking import ranking

    schema = "battle_id bigint, model_a string, model_b string, winner string, tstamp double"
    assert ranking(spark.createDataFrame([], schema)).collect() == []
    alone = ranking(spark.createDataFrame([(1, "x", None, None, 1.0)], schema)).collect()
    assert [(x.place, x.model, x.strength, x.n_verdicts) for x in alone] == [(1, "x", 1.0, 0)]


def test_ties_go_by_name_and_nulls_say_nothing(spark):
    from weftspark.llm.ranking import ranking

    rows = [(1, "b", "a", "tie", 1.0, 9), (2, "a", "b", "tie", 1.0, 9), (3, None, "c", "model_a", 1.0, 9), (4, "c", None, None, None, 9), (None, "a", "b", "model_a", 1.0, 9)]
    found = [tuple(r)[:2] for r in ranking(spark.createDataFrame(rows, "battle_id bigint, model_a string, model_b string, winner string, tstamp double, n int")).collect()]
    assert found == [(1, "a"), (2, "c"), (3, "b")]
    even = [tuple(r)[:2] for r in ranking(spark.createDataFrame(rows[:2], "battle_id bigint, model_a string, model_b string, winner string, tstamp double, n int")).collect()]
    assert even == [(1, "a"), (2, "b")]
