"""Mixing of datasets: union, exact deduplication, fractions and repeats, stages, epochs.

Rows are (source, pos, ...): the dataset and the place in it. Orders come from md5 of seed, source and pos, so that the
same rows are taken whatever the partitions, and any SQL engine can repeat it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42
#: Hex digits of the md5 that name a block, of which each source has 16 to that power.
BLOCK_DIGITS = 3
LEAST_REMAINDER = 0.01


def union(parts: list[DataFrame]) -> DataFrame:
    """All rows by column name; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def projected(df: DataFrame, keep: list[str], source: str | None = None) -> DataFrame:
    """The columns of keep that there are, and the name of the source."""
    out = df.select(*(c for c in keep if c in df.columns))
    return out if source is None else out.withColumn("source", F.lit(source))


def required(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows; raises ValueError if a column is missing."""
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise ValueError(f"columns are missing: {', '.join(gone)}")
    return df


def canonical(messages: str) -> Column:
    """Text of a dialogue as a key: a line ``role: content`` for each message, null parts being empty."""
    line = lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), F.coalesce(m["content"], F.lit("")))
    return F.array_join(F.transform(messages, line), "\n")


def full_id(chosen: str = "chosen", rejected: str = "rejected") -> Column:
    """sha256 of both dialogues."""
    return F.sha2(F.concat_ws(" ", canonical(chosen), canonical(rejected)), 256)


def source_order(sources: list[str]) -> Column:
    """Place of the source in the list; sources that aren't in it come last."""
    table = F.create_map(*(F.lit(x) for i, s in enumerate(sources) for x in (s, i))) if sources else None
    return F.coalesce(F.try_element_at(table, F.col("source")), F.lit(len(sources))) if sources else F.lit(0)


def deduplicated(rows: DataFrame, key: Column | str, sources: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Of rows with the same key the first by source and pos, with all columns or those of keep; rows with a null key are one key.

    The key is grouped by its sha256 and first rows are chosen with partial aggregation, so that copies of one text,
    however many, are met by one row of each task only.
    """
    key = F.col(key) if isinstance(key, str) else key
    first = F.struct(source_order(sources or []), "source", "pos")
    whole = F.struct(*(keep or rows.columns))
    return rows.groupBy(F.sha2(key.cast("binary"), 256).alias("__key")).agg(F.min_by(whole, first).alias("r")).select("r.*")


def duplicate_ratio(rows: DataFrame, key: str) -> DataFrame:
    """(rows, kept, ratio): the part of the rows that deduplication drops."""
    groups = rows.groupBy(F.sha2(F.col(key).cast("binary"), 256).alias("k")).agg(F.count("*").alias("n"))
    out = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"), F.count("*").alias("kept"))
    return out.withColumn("ratio", 1 - F.col("kept") / F.nullif(F.col("rows"), F.lit(0)))


def mixture(rows: DataFrame) -> DataFrame:
    """(source, n, ratio): how many rows each source has, and their part of all."""
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    return counts.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy()))


def order_key(seed: int = SEED) -> Column:
    """Hex digest by which the rows of a source are shuffled."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), "source", F.col("pos").cast("string")))


def first_of_source(rows: DataFrame, take: DataFrame, order: Column, block: Column, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """The first rows of each group in an order: as many as ``take`` (by..., k) has for it.

    Ranks are taken in blocks of the order, whose sizes are added up before, so that no task sorts a whole source.
    """
    placed = rows.join(F.broadcast(take), list(by)).withColumn("__order", order).withColumn("__block", block)
    sizes = placed.groupBy(*by, "__block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.withColumn("__rank", F.row_number().over(Window.partitionBy(*by, "__block").orderBy("__order", "pos")))
    kept = ranked.join(sizes.select(*by, "__block", before.alias("__before")), [*by, "__block"]).where("__before + __rank <= k")
    return kept.drop("__order", "__block", "__n", "__rank", "__before", "k")


def shuffled_first(rows: DataFrame, take: DataFrame, seed: int = SEED) -> DataFrame:
    """The first k rows of each shuffled source."""
    key = order_key(seed)
    return first_of_source(rows, take, key, F.substring(key, 1, BLOCK_DIGITS))


def _checked(fractions: Mapping[str, float]) -> None:
    if any(f < 0 for f in fractions.values()):
        raise ValueError("a fraction is negative")


def mixed(rows: DataFrame, fractions: Mapping[str, float], seed: int = SEED, least: float = 0.0) -> DataFrame:
    """Each source as many times as its fraction says, with ``copy``: whole copies from 1, and in copy 0 the rest.

    The rest are the first ``int(rest * n)`` rows of the shuffled source; a rest of at most ``least`` is none. Sources
    without a fraction are left out. n is the size as the rows are given, so deduplicate before.
    """
    _checked(fractions)
    spark = rows.sparkSession
    plan = [(s, int(f), f % 1) for s, f in sorted(fractions.items())]
    table = spark.createDataFrame(plan, "source string, copies int, rest double")
    whole = rows.join(F.broadcast(table.where("copies > 0").select("source", "copies")), "source")
    copies = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    some = [s for s, _, rest in plan if rest > least]
    if not some:
        return copies
    own = rows.where(F.col("source").isin(some))
    take = own.groupBy("source").agg(F.count("*").alias("n")).join(F.broadcast(table), "source").select("source", F.floor(F.col("rest") * F.col("n")).cast("bigint").alias("k"))
    return copies.unionByName(shuffled_first(own, take, seed).withColumn("copy", F.lit(0)))


def datasets(parts: Mapping[str, DataFrame], fractions: Mapping[str, float], keep: list[str] | None = None, key: str | None = None, process: Callable[[DataFrame], DataFrame] | None = None, seed: int = SEED) -> DataFrame:
    """The whole pipeline: projection, union, deduplication, a transformation of the rows, and the mix, with ``copy``.

    Each part has pos. Raises ValueError for a negative fraction, a missing key or an empty result.
    """
    _checked(fractions)
    named = [projected(df, keep, s) if keep else df.withColumn("source", F.lit(s)) for s, df in parts.items()]
    rows = union([required(df, "pos", *([key] if key else [])) for df in named])
    if key:
        rows = deduplicated(rows, key, list(parts))
    rows = rows.transform(process) if process else rows
    out = mixed(rows, fractions, seed)
    if out.isEmpty():
        raise ValueError("the mix is empty")
    return out


def split_mix(rows: DataFrame, fractions: Mapping[str, float]) -> DataFrame:
    """Rows (source, pos, split, ...): of train splits the first int(fraction * n) rows of each source by pos, test splits whole.

    A split is of train or test if its name has that in it; another name raises. Fractions above 1 take all rows once.
    """
    _checked(fractions)
    odd = rows.where(~F.col("split").contains("train") & ~F.col("split").contains("test")).select("split").limit(1).collect()
    if odd:
        raise ValueError(f"split {odd[0].split!r} is neither train nor test")
    named = rows.sparkSession.createDataFrame([(s, float(f)) for s, f in sorted(fractions.items())], "source string, fraction double")
    rows = rows.join(F.broadcast(named.select("source")), "source", "left_semi")
    train = rows.where(F.col("split").contains("train"))
    take = train.groupBy("source").agg(F.count("*").alias("n")).join(F.broadcast(named), "source").select("source", F.floor(F.col("fraction") * F.col("n")).cast("bigint").alias("k"))
    return first_of_source(train, take, F.col("pos"), F.floor(F.col("pos") / 4096)).unionByName(rows.where(F.col("split").contains("test")))


def staged(rows: DataFrame, stages: Mapping[str, Mapping[str, float]], key: str, seed: int = SEED) -> DataFrame:
    """The mixes of all stages, one after another, with ``stage`` and ``stage_no``; deduplicated once before, by sorted source names."""
    names = sorted({s for fractions in stages.values() for s in fractions})
    once = deduplicated(rows.where(F.col("source").isin(names)), key, names)
    parts = [mixed(once, f, seed, LEAST_REMAINDER).withColumn("stage", F.lit(stage)).withColumn("stage_no", F.lit(i)) for i, (stage, f) in enumerate(stages.items())]
    return union(parts)


def epochs(rows: DataFrame, n: int) -> DataFrame:
    """Every row in each of n epochs."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else rows.withColumn("epoch", F.lit(0)).limit(0)
