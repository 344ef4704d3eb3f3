from collections import defaultdict

import __spark_entry__ as e
import pandas as pd
from weftspark.llm.packing import pack

SF = "/root/testdata/sf0.01"


def test_pack_keeps_every_length():
    lengths = {10: 3, 7: 5, 5: 4, 3: 11, 2: 1, 1: 2}
    kept = defaultdict(int)
    for pattern, bins in pack(lengths, 10):
        assert bins > 0 and sum(size * copies for size, copies in pattern) <= 10
        for size, copies in pattern:
            kept[size] += copies * bins
    assert kept == lengths
    assert sum(bins for _, bins in pack({6: 100, 4: 100}, 10)) == 100


def test_every_token_once_within_the_capacity(spark):
    caps = dict(pd.read_parquet(f"{SF}/sft_config.parquet")[["config_name", "max_seq_length"]].values)
    t = pd.read_parquet(f"{SF}/sft_tokenized.parquet").sort_values("tokenized_at").drop_duplicates("row_id").dropna(subset=["input_ids"])
    want = {r.row_id: list(r.input_ids) for r in t.itertuples() if len(r.input_ids)}
    rows = e.queries()["p5_packed"](spark, SF).collect()
    for name, cap in caps.items():
        bins, ids = defaultdict(list), defaultdict(list)
        for r in sorted((r for r in rows if r.config_name == name), key=lambda r: (r.row_id, r.row_offset)):
            assert len(ids[r.row_id]) == r.row_offset
            ids[r.row_id] += r.input_ids
            bins[r.seq_no].append((r.seq_offset, len(r.input_ids)))
            assert len(want[r.row_id]) > cap or len(r.input_ids) == len(want[r.row_id])
        assert ids == want
        for parts in bins.values():
            end = 0
            for at, n in sorted(parts):
                assert at == end
                end += n
            assert end <= cap
        least = -(-sum(map(len, want.values())) // cap)
        print(name, cap, "sequences", len(bins), "least", least)
        assert sorted(bins) == list(range(len(bins))) and len(bins) <= 1.02 * least + 1


def test_planned_by_patterns_keeps_every_length_and_fills():
    import numpy as np
    from weftspark.llm.packing import few_length_patterns, fitted, planned

    rng = np.random.default_rng(4)
    for capacity, n in ((100, 5000), (64, 300), (7, 50)):
        sizes, counts = np.unique(rng.integers(1, capacity + 1, n), return_counts=True)
        lengths = dict(zip(sizes.tolist(), counts.tolist()))
        patterns = few_length_patterns(lengths, capacity)
        assert all(len(p) <= 3 and sum(x * k for x, k in p) <= capacity for p in patterns)
        repeats = fitted(patterns, lengths, capacity)
        assert repeats.min() >= 0 and repeats.sum() > 0
        used = defaultdict(int)
        for p, bins in planned(lengths, capacity):
            assert bins > 0 and sum(x * k for x, k in p) <= capacity
            for x, k in p:
                used[x] += k * bins
        assert used == lengths
        least = -(-sum(x * k for x, k in lengths.items()) // capacity)
        first_fit = sum(b for _, b in pack(lengths, capacity))
        assert sum(b for _, b in planned(lengths, capacity)) <= max(1.03 * first_fit, first_fit + 1) and first_fit >= least
    assert planned({}, 10) == []


def test_few_rows(spark):
    from weftspark.llm.packing import packed

    t = spark.createDataFrame([(1, [1, 2, 3], 1), (1, [1, 2, 3], 2), (2, None, 1), (3, [], 1), (4, [7] * 5, 1), (None, [1], 1)], "row_id bigint, input_ids array<int>, tokenized_at bigint")
    c = spark.createDataFrame([("a", 4), ("b", 2)], "config_name string, max_seq_length int")
    rows = packed(t, c).collect()
    assert sum(len(r.input_ids) for r in rows) == 16
    assert packed(t.limit(0), c).collect() == [] and packed(t, c.limit(0)).collect() == []
