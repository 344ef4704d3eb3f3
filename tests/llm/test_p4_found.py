import __spark_entry__ as e
import pandas as pd
import pytest
from weftspark.llm.splits import PLACEHOLDER, near
from weftspark.llm.words import words

SF = "/root/testdata/sf0.001"
A = "Compare the blunt replica of Hudroshios with the reliable pillow of Racapeat and say which one carves replicas wisely"


def brute(p):
    """Every train row against every validation or test row."""
    p = p.drop_duplicates("pair_id")
    known = lambda x: x.prompt_id is not None and not pd.Series([x.prompt_id]).str.match(PLACEHOLDER.replace(r"[^\p{L}\p{N}]*", r"\W*"))[0]
    train, held = ([(x, words(x.prompt)) for x in p[mask].itertuples()] for mask in (p.split == "train", p.split.isin(["validation", "test"])))
    out = set()
    for h, hw in held:
        for t, tw in train:
            if (hw and tw and near(hw, tw)) or ((h.prompt is None or t.prompt is None) and known(h) and known(t) and h.prompt_id == t.prompt_id):
                out.add((min(h.pair_id, t.pair_id), max(h.pair_id, t.pair_id)))
    return out


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_equals_every_row_against_every_other(spark, sf):
    p = pd.read_parquet(f"{sf}/preference_pairs.parquet", columns=["pair_id", "split", "prompt_id", "prompt"])
    rows = [tuple(r) for r in e.queries()["p4_found"](spark, sf).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(p)


def test_near():
    w = words(A)
    assert near(w, w[:5] + ["other"] + w[6:]) and near(w, w[1:]) and near(w, w + ["more", "more"])
    assert not near(w, ["x", "y", "z"] + w[3:]) and not near(w, w[:-3]) and not near([], ["x"])


def test_cases(spark, tmp_path):
    rows = [
        (1, "train", "a", A),
        (1, "train", "a", A),
        (2, "test", "b", f"<b>{A.upper()}!</b>"),
        (3, "validation", "None", None),
        (4, "train", "None", None),
        (5, "validation", "c", None),
        (6, "train", "c", "Something else altogether"),
        (7, "test", "a", "Other words with an equal prompt_id"),
        (8, "train", "e", "Hi you"),
        (9, "test", "f", "hi, you"),
    ]
    spark.createDataFrame([(*r, "s") for r in rows], "pair_id bigint, split string, prompt_id string, prompt string, dataset_mix_source string").write.parquet(f"{tmp_path}/preference_pairs.parquet")
    assert sorted(map(tuple, e.queries()["p4_found"](spark, str(tmp_path)).collect())) == [(1, 2), (5, 6), (8, 9)]
    assert sorted(map(tuple, e.queries()["p4_report"](spark, str(tmp_path)).collect())) == [("test", "s", 3, 2, 2), ("validation", "s", 2, 1, 1)]


def test_divided_runs_lose_nothing(spark, monkeypatch):
    from weftspark.llm import splits

    p = pd.read_parquet(f"{SF}/preference_pairs.parquet", columns=["pair_id", "split", "prompt_id", "prompt"])
    monkeypatch.setattr(splits, "RUN_ROWS", 2)
    monkeypatch.setattr(splits, "BLOCK", 3)
    rows = {tuple(sorted(r)) for r in splits.cross_split_pairs(spark.read.parquet(f"{SF}/preference_pairs.parquet")).collect()}
    assert rows == brute(p)


def test_common_words_and_places():
    from weftspark.llm.splits import common_words, least_places

    assert common_words("l a b c", "l a b d") == 2 and common_words("l a", "s a") == 0 and common_words("s a b", "s a b") == 2
    assert least_places(38, 6) == 38 - 4 - 25 and least_places(8, 4) == 1


def test_odd_rows(spark):
    from weftspark.llm.splits import cross_split_pairs

    long_ = " ".join(f"word{i}" for i in range(3000))
    rows = [(1, "train", None, None), (2, "test", None, None), (3, "train", "0000", "…"), (4, "test", "0000", "!"), (None, "train", "k", A), (5, "test", "k", A), (6, None, "k", A), (7, "dev", "k", A)]
    rows += [(8, "train", "x", long_), (9, "test", "y", long_.replace("word7 ", "other ")), (10, "train", "", A + " and so on"), (11, "validation", "z", "")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "pair_id bigint, split string, prompt_id string, prompt string, held string")
    assert sorted(map(tuple, cross_split_pairs(df).collect())) == [(9, 8)]
    assert cross_split_pairs(df.limit(0)).collect() == []
