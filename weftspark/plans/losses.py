"""Log-probabilities, losses and rewards over embeddings taken as logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.operators import losses
from weftspark.plans import views
from weftspark.plans.registry import query

_EACH = "SELECT row_id, logits[next + 1] - (list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))) AS p FROM (SELECT row_id, logits, lead(label) OVER (PARTITION BY row_id ORDER BY pos) AS next FROM {logits}) WHERE next IS NOT NULL AND next <> -100"


@query("logps_sum", f"SELECT row_id, round(sum(p), 6) AS logps FROM ({_EACH}) GROUP BY row_id")
def logps_sum(spark, folder):
    return losses.sequence_logps(views.logits(spark, folder)).withColumn("logps", F.round("logps", 6))


@query("logps_avg", f"SELECT row_id, round(avg(p), 6) AS logps FROM ({_EACH}) GROUP BY row_id")
def logps_avg(spark, folder):
    return losses.sequence_logps(views.logits(spark, folder), average=True).withColumn("logps", F.round("logps", 6))


_Z, _A, _B = "((pc - rc) - (pr - rr))", "(pc - rc)", "(pr - rr)"


def _ls(x):
    return f"(least({x}, 0) - ln(1 + exp(-abs({x}))))"


_SQL = {
    "sigmoid": f"-{_ls(f'(0.1 * {_Z})')} * 0.9 - {_ls(f'(-0.1 * {_Z})')} * 0.1",
    "hinge": f"greatest(0, 1 - 0.1 * {_Z})",
    "ipo": f"pow({_Z} - 5, 2)",
    "sppo_hard": f"pow({_A} - 5, 2) + pow({_B} + 5, 2)",
    "nca_pair": f"-{_ls(f'(0.1 * {_A})')} - 0.5 * {_ls(f'(-0.1 * {_A})')} - 0.5 * {_ls(f'(-0.1 * {_B})')}",
}
_TABLE = {kind: f"SELECT row_id, CAST(0 AS INTEGER) AS part, round(CAST({sql} AS DOUBLE), 6) AS loss FROM {{logps}}" for kind, sql in _SQL.items()}
_TABLE["kto_pair"] = (
    f"WITH m AS (SELECT batch, greatest(0, avg({_A})) AS kc, greatest(0, avg({_B})) AS kr FROM {{logps}} GROUP BY batch), j AS (SELECT * FROM {{logps}} l JOIN m USING (batch))"
    f" SELECT row_id, CAST(0 AS INTEGER) AS part, round(CAST(1 - 1 / (1 + exp(-0.1 * ({_A} - kr))) AS DOUBLE), 6) AS loss FROM j UNION ALL SELECT row_id, 1, round(CAST(1 - 1 / (1 + exp(-0.1 * (kc - {_B}))) AS DOUBLE), 6) FROM j"
)
_TABLE["bco_pair"] = (
    f"WITH m AS (SELECT batch, avg(0.1 * {_A} + 0.1 * {_B}) / 2 AS m FROM {{logps}} GROUP BY batch), r AS (SELECT batch, avg(m) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS delta FROM m)"
    f" SELECT row_id, CAST(0 AS INTEGER) AS part, round(CAST(-{_ls(f'(0.1 * {_A} - delta)')} - {_ls(f'(-(0.1 * {_B} - delta))')} AS DOUBLE), 6) AS loss FROM {{logps}} l JOIN r USING (batch)"
)


def _loss(kind):
    @query(f"loss_{kind}", _TABLE[kind])
    def run(spark, folder):
        return losses.losses(views.logps(spark, folder), kind, smoothing=0.1 if kind == "sigmoid" else 0.0).withColumn("loss", F.round("loss", 6))


for _kind in losses.LOSSES:
    _loss(_kind)


@query(
    "reward_metrics",
    f"WITH m AS (SELECT batch, avg(0.1 * {_A}) AS chosen, avg(0.1 * {_B}) AS rejected, avg(CASE WHEN 0.1 * {_A} > 0.1 * {_B} THEN CAST(1 AS DOUBLE) ELSE 0 END) AS accuracy, avg(0.1 * {_Z}) AS margin FROM {{logps}} GROUP BY batch)"
    " SELECT round(avg(chosen), 9) AS chosen, round(avg(rejected), 9) AS rejected, round(avg(accuracy), 9) AS accuracy, round(avg(margin), 9) AS margin FROM m",
)
def reward_metrics(spark, folder):
    out = losses.reward_metrics(views.logps(spark, folder))
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query("rewards", f"SELECT row_id, batch, round(0.1 * {_A}, 6) AS chosen, round(0.1 * {_B}, 6) AS rejected, CAST(0.1 * {_A} > 0.1 * {_B} AS DOUBLE) AS accuracy, round(0.1 * {_Z}, 6) AS margin FROM {{logps}}")
def rewards(spark, folder):
    rows = losses.rewards(views.logps(spark, folder))
    return rows.select("row_id", "batch", *(F.round(c, 6).alias(c) for c in ("chosen", "rejected")), "accuracy", F.round("margin", 6).alias("margin"))
