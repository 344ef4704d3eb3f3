from collections import Counter, defaultdict

import __spark_entry__ as e
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from weftspark.llm import mixing
from weftspark.llm.mixing import budgets, shared

SF = "/root/testdata/sf0.01"


@settings(max_examples=200, deadline=None)
@given(st.floats(0, 1000), st.lists(st.tuples(st.floats(0.01, 5), st.floats(0, 300)), min_size=1, max_size=8))
def test_shared_fills_by_weight(budget, parts):
    weights, rooms = [w for w, _ in parts], [r for _, r in parts]
    out = shared(budget, weights, rooms)
    assert abs(sum(out) - min(budget, sum(rooms))) < 1e-6
    assert all(o <= r + 1e-6 for o, r in zip(out, rooms))
    free = [o / w for o, w, r in zip(out, weights, rooms) if o < r - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * max(1, max(free))


def test_shortages_go_to_siblings_first():
    leaves = [(("sft", "en", "a"), 1.0, 10.0), (("sft", "en", "b"), 1.0, 1000.0), (("sft", "de", "b"), 1.0, 1000.0), (("dpo", "en", "c"), 1.0, 1000.0)]
    out = budgets(leaves, 400.0)
    assert out == {("sft", "en", "a"): 10.0, ("sft", "en", "b"): 190.0, ("sft", "de", "b"): 100.0, ("dpo", "en", "c"): 100.0}
    assert budgets([], 10.0) == {}


def test_mixes_of_the_table(spark):
    rows = e.queries()["p7_mix"](spark, SF).collect()
    report = {(r.mix_name, r.source): r for r in e.queries()["p7_report"](spark, SF).collect()}
    targets = pd.read_parquet(f"{SF}/mix_targets.parquet")
    assert set(report) == {(r.mix_name, r.source) for r in targets.itertuples()}
    most = {(r.mix_name, r.source): r.max_repeats for r in targets.itertuples()}
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    assert all(1 <= r.times <= most[r.mix_name, r.source] for r in rows)
    documents = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")
    assert all(documents.source[r.doc_id] == r.source for r in rows)
    tokens, size = Counter(), defaultdict(int)
    for r in rows:
        tokens[r.mix_name, r.source] += r.n_tokens * r.times
        size[r.mix_name] += r.n_tokens * r.times
    wanted = {m: sum(r.wanted_tokens for (k, _), r in report.items() if k == m) for m in size}
    for key, r in report.items():
        assert r.tokens == tokens[key] and abs(r.actual_share - r.tokens / size[key[0]]) < 1e-9
    for m in ("sft_main", "dpo_narrow"):
        assert abs(size[m] / wanted[m] - 1) < 0.05


def test_blocks_and_partitions_change_nothing(spark, monkeypatch):
    d, t = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/mix_targets.parquet")
    one = sorted(map(tuple, mixing.mixed(d, t)[0].collect()))
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 500)
    assert sorted(map(tuple, mixing.mixed(d.repartition(7), t)[0].collect())) == one


def test_odd_rows(spark):
    d = spark.createDataFrame([(1, "some words", "s", "EN-us", "sft"), (2, None, "s", None, None), (3, "", "s", "??", "sft"), (4, "more words", None, "en", "sft")], "doc_id bigint, text string, source string, lang string, stage string")
    t = spark.createDataFrame([("m", "s", 0.5, 3, 2.0), ("m", "gone", 0.5, 3, 2.0), ("n", None, 1.0, 1, 1.0)], "mix_name string, source string, target_share double, max_repeats int, size_ratio double")
    rows, report = mixing.mixed(d, t)
    assert [(r.mix_name, r.source, r.doc_id, r.times) for r in rows.collect()] == [("m", "s", 1, 3)]
    assert sorted((r.source, r.actual_share, r.most_times) for r in report.collect()) == [("gone", 0.0, 0), ("s", 1.0, 3)]
    empty, report = mixing.mixed(d.limit(0), t)
    assert empty.count() == 0 and {r.tokens for r in report.collect()} == {0}
    assert mixing.mixed(d, t.limit(0))[1].count() == 0
