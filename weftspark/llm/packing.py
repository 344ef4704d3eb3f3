"""Packing of token sequences into sequences of at most a capacity.

Patterns of a few lengths, each some times, that fill a capacity are enumerated; non-negative least squares fits how
often each is used to the histogram of lengths; counts are rounded down, and what they leave is packed longest first
into the fullest pattern that has room. Rows then take the places of their length. Only lengths reach the driver.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Pattern = tuple[tuple[int, int], ...]


def pack(lengths: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns of (length, copies) and how many sequences have each."""
    room: dict[int, dict[Pattern, int]] = {0: {}}
    keys: list[int] = []

    def add(left: int, pattern: Pattern, bins: int) -> None:
        if left not in room:
            room[left] = {}
            insort(keys, left)
        room[left][pattern] = room[left].get(pattern, 0) + bins

    for size in sorted(lengths, reverse=True):
        count = lengths[size]
        while count:
            at = bisect_left(keys, size)
            if at < len(keys):
                left = keys[at]
                pattern, bins = room[left].popitem()
            else:
                left, pattern, bins = capacity, (), count
            copies = min(left // size, count)
            used = min(bins, count // copies)
            if pattern and bins > used:
                room[left][pattern] = bins - used
            if left in room and left and not room[left]:
                del room[left]
                keys.remove(left)
            add(left - copies * size, (*pattern, (size, copies)), used)
            count -= copies * used
    return [(p, n) for left in sorted(room) for p, n in sorted(room[left].items())]


#: Second lengths tried for each first one, patterns kept of each first length, and steps of the fit.
SECONDS, KEPT, STEPS = 24, 8, 400
#: Parts of the fitted repeats that are tried, rounded down; the plan with the fewest sequences is taken.
SCALES = (1.0, 0.9, 0.7, 0.5)
#: Patterns that leave more than this part of the capacity are left to the packing of the rest.
SPARE = 512
#: Parts into which the rows of one length are divided to be numbered.
PARTS = 256


def few_length_patterns(lengths: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns of at most three lengths, with as many copies as fit, that leave the least space: the best of each first length."""
    own = np.array(sorted(lengths))
    have = np.array([lengths[x] for x in own.tolist()])
    place = np.full(capacity + 1, -1)
    place[own] = np.arange(len(own))
    below = np.maximum.accumulate(place)
    some = np.unique(np.linspace(0, len(own) - 1, SECONDS).astype(int))
    found: set[Pattern] = set()
    for at in range(len(own)):
        first = int(own[at])
        rated: list[tuple[int, Pattern]] = []
        most = min(capacity // first, int(have[at]))
        for copies in {1, max(1, most // 2), most}:
            rest = capacity - copies * first
            head = {first: copies}
            if rest < own[0]:
                rated.append((rest, ((first, copies),)))
                continue
            tries = np.unique(np.concatenate([some, [below[rest]], [x for q in (1, 2, 3) if rest % q == 0 and (x := place[rest // q]) >= 0]])).astype(int)
            for second in tries[own[tries] <= rest].tolist():
                size = int(own[second])
                fits = min(rest // size, int(have[second]))
                for times in {fits, max(1, fits - 1)}:
                    left = rest - times * size
                    lens = dict(head)
                    lens[size] = lens.get(size, 0) + times
                    if left >= own[0]:
                        third = int(own[below[left]])
                        lens[third] = lens.get(third, 0) + 1
                        left -= third
                    if all(n <= lengths[x] for x, n in lens.items()):
                        rated.append((left, tuple(sorted(lens.items(), reverse=True))))
        found.update(p for _, p in sorted(rated)[:KEPT])
    return sorted(found)


def fitted(patterns: list[Pattern], lengths: dict[int, int], capacity: int) -> np.ndarray:
    """Repeats x >= 0 of the patterns with the least squares of what they leave of each length or use too much; long lengths weigh more."""
    own = {x: i for i, x in enumerate(sorted(lengths))}
    row = np.array([own[x] for p in patterns for x, _ in p])
    col = np.array([j for j, p in enumerate(patterns) for _ in p])
    weight = np.sqrt(np.array(sorted(lengths)) / capacity)
    value = np.array([n for p in patterns for _, n in p], dtype=float) * weight[row]
    goal = np.array([lengths[x] for x in sorted(lengths)], dtype=float) * weight
    apply = lambda x: np.bincount(row, value * x[col], minlength=len(own))
    back = lambda r: np.bincount(col, value * r[row], minlength=len(patterns))
    v = np.ones(len(patterns))
    for _ in range(20):
        v = back(apply(v))
        v /= np.linalg.norm(v) or 1.0
    step = 0.9 / max(1e-12, float(np.linalg.norm(back(apply(v)))))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(STEPS):  # projected gradient with momentum
        after = np.maximum(0.0, y - step * back(apply(y) - goal))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = after + (before - 1) / t * (after - x)
        x = after
    return x


def planned(lengths: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns and how many sequences have each; all copies of every length have a place."""
    lengths = {x: n for x, n in lengths.items() if n}
    if not lengths:
        return []
    patterns = [p for p in few_length_patterns(lengths, capacity) if capacity - sum(x * n for x, n in p) <= capacity // SPARE]
    repeats = fitted(patterns, lengths, capacity) if patterns else np.empty(0)
    plans = []
    for scale in SCALES:
        left, out = dict(lengths), []
        for j in sorted(np.flatnonzero(scale * repeats >= 1).tolist(), key=lambda j: (capacity - sum(x * n for x, n in patterns[j]), -patterns[j][0][0])):
            times = min(int(scale * repeats[j]), *(left[x] // n for x, n in patterns[j]))
            if times:
                out.append((patterns[j], times))
                for x, n in patterns[j]:
                    left[x] -= n * times
        plans.append(out + pack({x: n for x, n in left.items() if n}, capacity))
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def places(patterns: list[tuple[Pattern, int]]) -> dict[int, tuple[list[int], list[tuple[int, int, int]]]]:
    """By length: the first rank of each run, and (number of its first sequence, copies in each, offset)."""
    out: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for pattern, bins in patterns:
        offset = 0
        for size, copies in pattern:
            starts, runs = out.setdefault(size, ([], []))
            starts.append(ranks.get(size, 0))
            runs.append((first, copies, offset))
            ranks[size] = ranks.get(size, 0) + copies * bins
            offset += size * copies
        first += bins
    return out


def packed(tokens: DataFrame, config: DataFrame) -> DataFrame:
    """(config_name, seq_no, seq_offset, row_id, row_offset, input_ids): the pieces of which each sequence consists.

    A row_id counts once, the earliest; rows without one can't be named and are left out; null and empty sequences have
    no piece; only those longer than the capacity are cut, at multiples of it.
    """
    caps = {r[0]: r[1] for r in config.select("config_name", "max_seq_length").collect()}
    if not caps:
        return tokens.sparkSession.createDataFrame([], "config_name string, seq_no bigint, seq_offset int, row_id bigint, row_offset int, input_ids array<int>")
    first = Window.partitionBy("row_id").orderBy("tokenized_at")
    once = lambda *columns: tokens.where("row_id is not null").select("row_id", "tokenized_at", *columns).withColumn("k", F.row_number().over(first)).where("k = 1").drop("k", "tokenized_at")
    sizes = once(F.coalesce(F.size("input_ids"), F.lit(0)).alias("n")).where("n > 0")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("config_name"), F.lit(c).alias("capacity")) for k, c in sorted(caps.items()))))
    pieces = sizes.select("row_id", "n", each.alias("c")).select("row_id", "n", "c.*").withColumn("row_offset", F.explode(F.expr("sequence(0, n - 1, capacity)")))
    pieces = pieces.select("config_name", "row_id", "row_offset", F.expr("least(capacity, n - row_offset)").alias("size"))
    lengths: dict[str, dict[int, int]] = {k: {} for k in caps}
    for r in sizes.groupBy("n").agg(F.count("*").alias("rows")).collect():
        for name, c in caps.items():
            own = lengths[name]
            if r.n >= c:
                own[c] = own.get(c, 0) + r.n // c * r.rows
            if r.n % c:
                own[r.n % c] = own.get(r.n % c, 0) + r.rows
    found = {name: places(planned(lengths[name], c)) for name, c in caps.items()}
    table = tokens.sparkSession.sparkContext.broadcast(found)  # as large as the patterns, which lengths up to the capacities bound

    def run(batches):
        for batch in batches:
            numbers, offsets = [], []
            for name, size, rank in zip(*(batch.column(c).to_pylist() for c in ("config_name", "size", "rank"))):
                starts, runs = table.value[name][size]
                at = bisect_right(starts, rank) - 1
                number, copies, offset = runs[at]
                numbers.append(number + (rank - starts[at]) // copies)
                offsets.append(offset + (rank - starts[at]) % copies * size)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(numbers, pa.int64()), pa.array(offsets, pa.int32())], names=["config_name", "row_id", "row_offset", "size", "seq_no", "seq_offset"])

    part = ["config_name", "size", "part"]
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(PARTS)))
    counts = pieces.groupBy(*part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("config_name", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy(*part).orderBy("row_id", "row_offset")) - 1
    ranked = pieces.withColumn("within", within).join(counts.select(*part, before.alias("before")), part)
    placed = ranked.select("config_name", "row_id", "row_offset", "size", (F.col("before") + F.col("within")).cast("bigint").alias("rank")).mapInArrow(run, "config_name string, row_id bigint, row_offset int, size int, seq_no bigint, seq_offset int")
    return placed.join(once("input_ids"), "row_id").select("config_name", "seq_no", "seq_offset", "row_id", "row_offset", F.expr("slice(input_ids, row_offset + 1, size)").alias("input_ids"))
