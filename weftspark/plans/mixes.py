"""Mixes of the documents' sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.operators import mixing
from weftspark.plans import views
from weftspark.plans.registry import query

FRACTIONS = {"maple_chats": 1.0, "quill_notes": 0.25, "harbor_qa": 1.1, "judge_logs": 2.5, "ember_math": 0.0, "tutor_dialogs": 0.003}
STAGES = {"warm": {"maple_chats": 0.5, "harbor_qa": 1.005}, "main": {"quill_notes": 1.25, "judge_logs": 2.0, "harbor_qa": 0.02}}
SOURCES = sorted(FRACTIONS)
_ORDER = "md5(concat_ws(':', '42', source, CAST(pos AS VARCHAR)))"


def _dedup_sql(where, order):
    return f"SELECT source, pos, text FROM {{mix_rows}} {where} QUALIFY row_number() OVER (PARTITION BY text ORDER BY {order}, source, pos) = 1"


_RANK = "CASE source " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SOURCES)) + f" ELSE {len(SOURCES)} END"


@query("mix_dedup", f"SELECT source, pos FROM ({_dedup_sql('', _RANK)})")
def mix_dedup(spark, folder):
    return mixing.deduplicated(views.mix_rows(spark, folder), "text", SOURCES, keep=["source", "pos"])


@query("mix_duplicate_ratio", "SELECT count(*) AS rows, count(DISTINCT coalesce('x' || text, '')) AS kept, round(1 - count(DISTINCT coalesce('x' || text, '')) / count(*), 6) AS ratio FROM {mix_rows}")
def mix_duplicate_ratio(spark, folder):
    return mixing.duplicate_ratio(views.mix_rows(spark, folder), "text").withColumn("ratio", F.round("ratio", 6))


@query("mix_stats", "SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS ratio FROM {mix_rows} GROUP BY source")
def mix_stats(spark, folder):
    return mixing.mixture(views.mix_rows(spark, folder)).withColumn("ratio", F.round("ratio", 6))


def _mixed_sql(rows, fractions, least=0.0):
    values = ", ".join(f"('{s}', {int(f)}, CAST({(f % 1)!r} AS DOUBLE))" for s, f in fractions.items())
    return (
        f"SELECT source, pos, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM ({rows}) JOIN (VALUES {values}) f(source, copies, rest) USING (source) WHERE copies > 0"
        f" UNION ALL SELECT source, pos, 0 FROM (SELECT source, pos, rest, row_number() OVER (PARTITION BY source ORDER BY {_ORDER}) AS r, count(*) OVER (PARTITION BY source) AS n FROM ({rows}) JOIN (VALUES {values}) f(source, copies, rest) USING (source)) WHERE rest > {least} AND r <= floor(rest * n)"
    )


@query("mix_fractional", _mixed_sql(_dedup_sql("", _RANK), FRACTIONS))
def mix_fractional(spark, folder):
    rows = mixing.deduplicated(views.mix_rows(spark, folder), "text", SOURCES, keep=["source", "pos"])
    return mixing.mixed(rows, FRACTIONS).select("source", "pos", "copy")


@query("mix_datasets", _mixed_sql(_dedup_sql("WHERE source IN ('harbor_qa', 'judge_logs')", "CASE source WHEN 'judge_logs' THEN 0 ELSE 1 END"), {"judge_logs": 0.5, "harbor_qa": 1.25}))
def mix_datasets(spark, folder):
    rows = views.mix_rows(spark, folder)
    parts = {s: rows.where(F.col("source") == s).drop("source") for s in ("judge_logs", "harbor_qa")}
    return mixing.datasets(parts, {"judge_logs": 0.5, "harbor_qa": 1.25}, keep=["pos", "text", "absent"], key="text").select("source", "pos", "copy")


_XY = {"maple_chats": 0.3, "harbor_qa": 1.0, "lantern_mix": 0.77}


@query(
    "mix_xy_split",
    "WITH r AS (SELECT source, pos, CASE WHEN pos % 10 = 0 THEN 'test_sft' ELSE 'train_sft' END AS split FROM {mix_rows} WHERE source IN ('maple_chats', 'harbor_qa', 'lantern_mix')),"
    " t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS r, count(*) OVER (PARTITION BY source) AS n FROM r WHERE split = 'train_sft')"
    " SELECT source, pos, split FROM t JOIN (VALUES ('maple_chats', CAST(0.3 AS DOUBLE)), ('harbor_qa', CAST(1.0 AS DOUBLE)), ('lantern_mix', CAST(0.77 AS DOUBLE))) f(source, f) USING (source) WHERE r <= floor(f * n) UNION ALL SELECT source, pos, split FROM r WHERE split = 'test_sft'",
)
def mix_xy_split(spark, folder):
    rows = views.mix_rows(spark, folder).select("source", "pos", F.when(F.col("pos") % 10 == 0, "test_sft").otherwise("train_sft").alias("split"))
    return mixing.split_mix(rows, _XY)


_STAGE_ROWS = _dedup_sql("WHERE source IN ('maple_chats', 'harbor_qa', 'quill_notes', 'judge_logs')", "source")


@query("mix_stages", " UNION ALL ".join(f"SELECT source, pos, copy, '{stage}' AS stage, {i} AS stage_no FROM ({_mixed_sql(_STAGE_ROWS, f, 0.01)})" for i, (stage, f) in enumerate(STAGES.items())))
def mix_stages(spark, folder):
    return mixing.staged(views.mix_rows(spark, folder), STAGES, "text").select("source", "pos", "copy", "stage", "stage_no")


@query("mix_epochs", "SELECT source, pos, CAST(unnest(range(0, 3)) AS INTEGER) AS epoch FROM {mix_rows}")
def mix_epochs(spark, folder):
    return mixing.epochs(views.mix_rows(spark, folder).select("source", "pos"), 3)


@query("mix_union", "SELECT source, pos, NULL::VARCHAR AS split FROM {mix_rows} UNION ALL SELECT coalesce(source, ''), pair_id, split FROM {dialogues}")
def mix_union(spark, folder):
    pairs = views.dialogues(spark, folder, "source", "split").select(F.coalesce("source", F.lit("")).alias("source"), F.col("pair_id").alias("pos"), "split")
    return mixing.union([views.mix_rows(spark, folder).select("source", "pos"), pairs])


def _canonical(c):
    return f"array_to_string(list_transform({c}, lambda m: concat(coalesce(m.role, ''), ': ', coalesce(m.content, ''))), chr(10))"


@query("mix_full_id", f"SELECT pair_id, sha256(concat_ws(' ', {_canonical('chosen')}, {_canonical('rejected')})) AS full_id FROM {{dialogues}}")
def mix_full_id(spark, folder):
    return views.dialogues(spark, folder, "chosen", "rejected").select("pair_id", mixing.full_id().alias("full_id"))
