"""Log-probabilities of answers, preference losses and rewards, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BETA, SMOOTHING = 0.1, 0.0
LOSSES = ("sigmoid", "hinge", "ipo", "kto_pair", "bco_pair", "sppo_hard", "nca_pair")


def log_sigmoid(x: Column) -> Column:
    """Without overflow for large numbers of either sign."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def token_logp(logits: Column, label: Column) -> Column:
    """Logarithm of the label's softmax; labels count from 0."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.get(logits, label) - (top + F.log(total))


def sequence_logps(rows: DataFrame, average: bool = False, ignored: int = -100) -> DataFrame:
    """(row_id, logps): the sum, or mean, over positions of the log-probability of the next position's label; ignored labels don't count."""
    shifted = rows.withColumn("next", F.lead("label").over(Window.partitionBy("row_id").orderBy("pos")))
    each = shifted.where((F.col("next") != ignored) & F.col("next").isNotNull()).select("row_id", token_logp(F.col("logits"), F.col("next")).alias("p"))
    return each.groupBy("row_id").agg((F.avg("p") if average else F.sum("p")).alias("logps"))


def _parts() -> tuple[Column, Column, Column]:
    a, b = F.col("pc") - F.col("rc"), F.col("pr") - F.col("rr")
    return a, b, a - b


def losses(rows: DataFrame, kind: str, beta: float = BETA, smoothing: float = SMOOTHING) -> DataFrame:
    """(row_id, part, loss) of rows (row_id, batch, pc, pr, rc, rr).

    pc and pr are the policy's log-probabilities of the chosen and rejected answer, rc and rr the reference's. kto_pair
    has two parts a row, one for each answer, against the batch's mean gain, if positive; bco_pair takes off the mean,
    over this batch and those before, of the batches' mean rewards. Raises ValueError for another kind.
    """
    a, b, z = _parts()
    B = F.lit(float(beta))
    if kind == "sigmoid":
        out = -log_sigmoid(B * z) * (1 - smoothing) - log_sigmoid(-B * z) * smoothing
    elif kind == "hinge":
        out = F.greatest(F.lit(0.0), 1 - B * z)
    elif kind == "ipo":
        out = F.pow(z - 1 / (2 * B), 2)
    elif kind == "sppo_hard":
        out = F.pow(a - 0.5 / B, 2) + F.pow(b + 0.5 / B, 2)
    elif kind == "nca_pair":
        out = -log_sigmoid(B * a) - 0.5 * log_sigmoid(-B * a) - 0.5 * log_sigmoid(-B * b)
    elif kind == "kto_pair":
        means = rows.groupBy("batch").agg(F.greatest(F.lit(0.0), F.avg(a)).alias("kc"), F.greatest(F.lit(0.0), F.avg(b)).alias("kr"))
        sigma = lambda x: 1 / (1 + F.exp(-x))
        both = F.array(1 - sigma(B * (a - F.col("kr"))), 1 - sigma(B * (F.col("kc") - b)))
        return rows.join(means, "batch").select("row_id", F.posexplode(both).alias("part", "loss"))
    elif kind == "bco_pair":
        means = rows.groupBy("batch").agg((F.avg(B * a + B * b) / 2).alias("m"))
        running = means.select("batch", F.avg("m").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)).alias("delta"))
        out = -log_sigmoid(B * a - F.col("delta")) - log_sigmoid(-(B * b - F.col("delta")))
        rows = rows.join(running, "batch")
    else:
        raise ValueError(f"loss {kind!r} is none of {', '.join(LOSSES)}")
    return rows.select("row_id", F.lit(0).alias("part"), out.alias("loss"))


def rewards(rows: DataFrame, beta: float = BETA) -> DataFrame:
    """(row_id, batch, chosen, rejected, accuracy, margin): gains over the reference; accurate if the chosen one's is greater."""
    a, b, z = _parts()
    B = F.lit(float(beta))
    return rows.select("row_id", "batch", (B * a).alias("chosen"), (B * b).alias("rejected"), (B * a > B * b).cast("double").alias("accuracy"), (B * z).alias("margin"))


def reward_metrics(rows: DataFrame, beta: float = BETA) -> DataFrame:
    """(chosen, rejected, accuracy, margin): the mean over batches of the batches' means."""
    names = ("chosen", "rejected", "accuracy", "margin")
    means = rewards(rows, beta).groupBy("batch").agg(*(F.avg(c).alias(c) for c in names))
    return means.agg(*(F.avg(c).alias(c) for c in names))
