"""Mixes of sources in target shares of their tokens.

A mix is a tree of domains, their languages and their sources. Weights add up from the leaves, budgets are passed
down by weight; what a node can't take, since its documents may be used so many times only, goes to its siblings
first and to those of its ancestors after. A leaf then takes the first tokens of its epochs, each a seeded order of its
documents: whole epochs, and of the next one as many documents as come nearest to the budget.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftspark.llm.encode import DEFAULT_VOCABULARY, token_counts
from weftspark.session import checkpointed

LEVELS = ("domain", "language", "source")
#: Tokens of a block of a leaf, about; the running sum of a leaf is taken over its blocks and then within each.
BLOCK_TOKENS = 2_000_000
SEED = 42


@dataclass
class Node:
    weight: float = 0.0
    room: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)


def shared(budget: float, weights: list[float], rooms: list[float]) -> list[float]:
    """The budget by weight, none above its room; what one can't take the others share by weight."""
    out, open_ = [0.0] * len(weights), [i for i, w in enumerate(weights) if w > 0]
    left = min(budget, sum(rooms[i] for i in open_))
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if rooms[i] - out[i] <= left * weights[i] / total + 1e-9]
        if not full:
            for i in open_:
                out[i] += left * weights[i] / total
            break
        for i in full:
            left -= rooms[i] - out[i]
            out[i] = rooms[i]
        open_ = [i for i in open_ if i not in full]
    return out


def budgets(leaves: list[tuple[tuple[str, ...], float, float]], budget: float) -> dict[tuple[str, ...], float]:
    """Tokens for each leaf (path, weight, room)."""
    root = Node()
    for path, weight, room in leaves:
        node = root
        for step in ("", *path):
            if step:
                node = node.children.setdefault(step, Node())
            node.weight += weight
            node.room += room
    out: dict[tuple[str, ...], float] = {}

    def down(node: Node, path: tuple[str, ...], tokens: float) -> None:
        if not node.children:
            out[path] = tokens
            return
        names = sorted(node.children)
        parts = shared(tokens, [node.children[n].weight for n in names], [node.children[n].room for n in names])
        for name, part in zip(names, parts):
            down(node.children[name], (*path, name), part)

    if leaves:
        down(root, (), budget)
    return out


def sized(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, domain, language, source, n_tokens) of every document, written once; without a language it is ``und``."""
    language = F.regexp_extract(F.lower(F.trim("lang")), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    tree = documents.select("doc_id", "text", F.coalesce("stage", F.lit("none")).alias("domain"), F.coalesce(F.nullif(language, F.lit("")), F.lit("und")).alias("language"), "source")
    return checkpointed(token_counts(tree, keep=LEVELS, vocabulary=vocabulary))


def mixed(documents: DataFrame, targets: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows of the mixes, report).

    Rows are (mix_name, source, doc_id, n_tokens, times), a document at most once for each mix. The report has for each
    row of targets (mix_name, source, target_share, actual_share, wanted_tokens, tokens, documents, most_times); a
    source without documents has share 0. Only the tokens of each leaf, by domain, language and source of the targets,
    reach the driver. Null targets and documents without a source or tokens are in no mix.
    """
    spark = documents.sparkSession
    sizes = sized(documents)
    rows = [r for r in targets.select("mix_name", "source", "target_share", "max_repeats", "size_ratio").collect() if r.source is not None and r.target_share]
    asked = {(r.mix_name, r.source): r for r in rows}
    total = sizes.agg(F.sum("n_tokens").alias("n")).collect()[0].n or 0
    named = spark.createDataFrame([(s,) for s in sorted({r.source for r in rows})], "source string")
    own = sizes.where("n_tokens > 0").join(F.broadcast(named), "source")
    leaves = {(r.domain, r.language, r.source): r.n for r in own.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n")).collect()}
    of_source: dict[str, int] = defaultdict(int)
    for (_, _, source), n in leaves.items():
        of_source[source] += n
    plan, wanted = [], {}
    for mix in sorted({r.mix_name for r in rows}):
        mine = {s: r for (m, s), r in asked.items() if m == mix}
        size = total * max(r.size_ratio for r in mine.values())
        parts = [(leaf, mine[leaf[2]].target_share * n / of_source[leaf[2]], float(n * mine[leaf[2]].max_repeats)) for leaf, n in sorted(leaves.items()) if leaf[2] in mine]
        wanted |= {(mix, s): size * r.target_share for s, r in mine.items()}
        for leaf, tokens in budgets(parts, size).items():
            epochs = min(int(tokens // leaves[leaf]), mine[leaf[2]].max_repeats)
            rest = tokens - epochs * leaves[leaf] if epochs < mine[leaf[2]].max_repeats else 0.0
            plan.append((mix, *leaf, epochs, rest, max(1, leaves[leaf] // BLOCK_TOKENS)))
    table = spark.createDataFrame(plan, "mix_name string, domain string, language string, source string, epochs int, rest double, blocks bigint")
    order = F.xxhash64(F.lit(seed), "mix_name", "epochs", "doc_id")
    placed = own.join(F.broadcast(table), list(LEVELS)).withColumn("order", order).withColumn("block", F.floor((F.shiftrightunsigned("order", 11) / F.lit(float(2**53))) * F.col("blocks")))
    key = ["mix_name", *LEVELS]
    blocks = placed.where("rest > 0").groupBy(*key, "block").agg(F.sum("n_tokens").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select(*key, "block", before.alias("start"))
    within = Window.partitionBy(*key, "block").orderBy(F.shiftrightunsigned("order", 11), "order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    partly = placed.where("rest > 0").withColumn("upto", F.sum("n_tokens").over(within)).join(starts, [*key, "block"])
    partly = partly.withColumn("times", F.col("epochs") + (F.col("start") + F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    columns = ["mix_name", "source", "doc_id", "n_tokens", "times"]
    used = placed.where("rest <= 0").withColumn("times", F.col("epochs")).select(columns).unionAll(partly.select(columns)).where("times > 0")
    reached = used.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.count("*").alias("documents"), F.max("times").alias("most_times"))
    goals = spark.createDataFrame([(m, s, float(r.target_share), float(wanted[m, s])) for (m, s), r in sorted(asked.items())], "mix_name string, source string, target_share double, wanted_tokens double")
    report = goals.join(reached, ["mix_name", "source"], "left").na.fill(0, ["tokens", "documents", "most_times"])
    share = F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy("mix_name")), F.lit(0))
    report = report.withColumn("actual_share", F.coalesce(share, F.lit(0.0)))
    return used, report.select("mix_name", "source", "target_share", "actual_share", "wanted_tokens", "tokens", "documents", "most_times")
