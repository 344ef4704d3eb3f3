"""Whole pipelines: what must hold of their results."""

from collections import Counter

from weftspark.operators import tokens
from weftspark.plans import pipelines, views

SF = "/root/testdata/sf0.01"


def test_sft(spark):
    rows = pipelines.pipeline_sft(spark, SF).collect()
    assert rows and all(r.n == pipelines.LENGTH and r.kept >= 0.1 * r.n for r in rows)
    sizes = Counter()
    mixed = pipelines.mixed_dialogues(spark, SF)
    for r in mixed.select("source", "copy", "pos", tokens.chat_tokens(mixed.messages).alias("t")).collect():
        sizes[r.source, r["copy"], r.pos // 64] += len(r.t)
    chunks = Counter((r.source, r["copy"], r.batch) for r in rows)
    assert all(n <= max(-(-sizes[k] // pipelines.LENGTH) - 1, 0) for k, n in chunks.items())


def test_dpo(spark):
    rows = pipelines.pipeline_dpo(spark, SF).collect()
    assert len({r.pair_id for r in rows}) == len(rows) <= views.dialogues(spark, SF).count()
    assert all(r.chosen_n % 8 == 0 and r.chosen_n <= 256 and r.rejected_n <= 256 and r.masked < r.chosen_n for r in rows)


def test_online(spark):
    rows = pipelines.pipeline_online(spark, SF).collect()
    use = Counter(r.use for r in rows)
    assert set(use) == {"pair", "chosen", None} and len({r.gen_id for r in rows}) == len(rows)
