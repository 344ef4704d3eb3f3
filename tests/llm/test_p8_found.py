import __spark_entry__ as e
import numpy as np
from weftspark.llm.quality import FUNCTIONS, KINDS, learned, statistics, text_kinds

PROSE = "The lamp was lit before the storm came, and we kept it burning through the night. Nobody knew how long it would last."
TEXTS = {
    1: ("prose", PROSE),
    2: ("prose", PROSE.replace(" ", "\n", 9).lower().replace(".", "").replace(",", "").replace("\n", " ")),
    3: ("list", "\n".join(f"- {a} {b}" for a in ("red", "blue", "old") for b in ("lamp", "boat", "door"))),
    4: ("list", PROSE[:50] + "\n" + ", ".join(f"{a} {b}" for a in ("red", "blue", "old", "new", "tall") for b in ("lamp", "boat", "door"))),
    5: ("table", "\n".join(f"name{i}|{i}|{i * 7}.5" for i in range(8))),
    6: ("table", "<table>" + "".join(f"<tr><td>name{i}</td><td>{i}</td><td>x</td></tr>" for i in range(6)) + "</table>"),
    7: ("junk", "lamp Storm boat seven gather chair moon silver paint window carry bottle garden pencil river apple stone paper cloud music"),
    8: ("junk", "4f3a 88b1 09cd 7e21 " * 12),
    9: ("junk", (PROSE[:80] + " ") * 30),
    10: ("prose", PROSE + "\n\n- red lamp\n- blue boat\n- old door"),
    11: (None, None),
    12: (None, ""),
    13: (None, " \n\t "),
}


def test_kinds(spark, tmp_path):
    rows = [(k, t, "clash") for k, (_, t) in TEXTS.items()] + [(100 + i, PROSE + f" It was {i}.", "clash") for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string, kind string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.kind for r in e.queries()["p8_found"](spark, str(tmp_path)).collect()}
    assert found == {k: kind for k, (kind, _) in TEXTS.items() if kind not in (None, "prose")}
    every = e.queries()["p8_statistics"](spark, str(tmp_path)).collect()
    assert len(every) == len(rows)
    assert all((r.kind is None) == (r.n_words is None) == (r.doc_id in (11, 12, 13)) for r in every)


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert text_kinds(empty).collect() == []
    assert text_kinds(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).collect()[0].kind is None


def test_very_long_and_odd_texts():
    for t in ("x" * 1_000_000, "a b\n" * 200_000, "|||", "​", "=" * 50, "\r\n.\r\n", "😀 \U0001f600", "，。" * 30):
        assert all(np.isfinite(statistics(t.encode("utf-8", "replace").decode())))


def test_chances_come_back():
    rng = np.random.default_rng(0)
    own = np.array([[kind == k for kind, _ in FUNCTIONS] for k in KINDS])
    truth = np.where(own, 0.7, 0.05)
    kinds = rng.choice(4, 20000, p=[0.6, 0.2, 0.1, 0.1])
    votes = (rng.random((20000, len(FUNCTIONS))) < truth[kinds]).astype(float)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    shares, fires = learned(patterns, counts.astype(float))
    assert np.abs(shares - [0.6, 0.2, 0.1, 0.1]).max() < 0.03
    assert np.abs(fires - truth).max() < 0.1


def test_small_table_kinds_are_as_reviewed(spark):
    kinds = {r.kind for r in e.queries()["p8_found"](spark, "/root/testdata/sf0.001").collect()}
    assert kinds == {"list", "table", "junk"}
