import __spark_entry__ as e
import pytest
from weftspark.llm.leaks import Items

ITEM = "Sort 5,185 rapid parcels by how barely they remember the layer, and defend the choice of Gajaiz against Brogram. Note that Triquev is reliable"
KNOWN = Items([(7, ITEM)])
W = ITEM.split()


@pytest.mark.parametrize(
    "text",
    [
        "before " + ITEM.upper() + " after",
        "<b>" + ITEM.replace(" ", "\\n").replace(",", "") + "</b>",
        "**" + "​".join(ITEM) + "**",
        "x " + " ".join(W[:12]) + " y",
        "x " + " ".join(W[:8] + ["other"] + W[9:14] + ["other"] + W[15:]) + " y",
        "x " + " ".join(W[:8] + W[9:]) + " y",
        "x " + " ".join(W[:8] + ["more"] + W[8:]) + " y",
    ],
)
def test_found(text):
    assert KNOWN.found(text) == [7]


@pytest.mark.parametrize("text", [None, "", " ".join(W[:10]), " ".join(reversed(W)), " ".join(x for i in range(0, 24, 4) for x in W[i : i + 3] + ["other"])])
def test_not_found(text):
    assert KNOWN.found(text) == []


def test_query_counts_copies_each_and_deliveries_once(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    write("eval_items", [(7, ITEM)], "item_id bigint, instruction string")
    write("documents", [(1, ITEM), (2, ITEM), (3, None)], "doc_id bigint, text string")
    write("preference_pairs", [(4, "train", ITEM), (4, "train", ITEM), (5, "test", ITEM)], "pair_id bigint, split string, prompt string")
    found = sorted(map(tuple, e.queries()["p1_found"](spark, str(tmp_path)).collect()))
    assert found == [("documents", 1, 7), ("documents", 2, 7), ("preference_pairs", 4, 7)]


def test_passes_change_nothing_and_no_items(spark, monkeypatch):
    from weftspark.llm import leaks

    items = spark.createDataFrame([(i, ITEM.replace("rapid", f"rapid{i}")) for i in range(6)] + [(9, None), (10, "")], "item_id bigint, instruction string")
    texts = spark.createDataFrame([("a", i, "so: " + ITEM.replace("rapid", f"rapid{i}")) for i in range(8)] + [("a", 99, None), ("b", 1, "")], "corpus string, record_id bigint, text string")
    one = sorted(map(tuple, leaks.leaked_items(texts, items).collect()))
    monkeypatch.setattr(leaks, "ITEMS", 2)
    assert sorted(map(tuple, leaks.leaked_items(texts, items).collect())) == one and len(one) == 48
    assert leaks.leaked_items(texts, items.limit(0)).collect() == [] and leaks.leaked_items(texts.limit(0), items).collect() == []


def test_short_and_long_items():
    short = Items([(1, "one two three"), (2, "  ")])
    assert short.found("and one two three four") == [1] and short.found("three two one") == []
    long_ = [f"word{i}" for i in range(240)]
    assert Items([(3, " ".join(long_))]).found("x " + " ".join(long_[60:190]) + " y") == [3]
    assert Items([(3, " ".join(long_))]).found(" ".join(long_[:110])) == []
