"""Texts that hold held-out items whole or in part.

Texts and items are compared as words joined by single spaces. By the q-gram lemma, a stretch of the item of which e
words are altered, missing or added keeps all its character q-grams but those that touch one of these words; and the
kept ones lie within e diagonals of each other, counted in words. Bands of diagonals with so many shared q-grams are
candidates; a banded alignment of their words decides them.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.words import words

#: Characters of a q-gram; about two words, so that few texts share one by chance.
Q = 12
#: One word in so many of the stretch may be altered, missing or added; and this part of the item is repeated.
WORDS_AN_ERROR, PART = 8, 2
#: Bits of the table that tells most q-grams of a text from those of the items at once.
SIEVE_BITS = 22
#: Items that are looked for in one pass over the texts, about.
ITEMS = 20_000


def least_hits(item: list[str]) -> int:
    """Character q-grams that any stretch with half of the item has in common with it, at least.

    Of a stretch of n words with e errors it has those that touch none of the e words; these are at most the longest.
    """
    sizes = [len(w) + 1 for w in item]
    before, longest = [0, *accumulate(sizes)], [0, *accumulate(sorted(sizes, reverse=True))]
    half, least = -(-len(item) // PART), []
    for n in range(half, min(len(item), half + WORDS_AN_ERROR) + 1):
        errors = n // (WORDS_AN_ERROR - 1)
        whole = min(before[at + n] - before[at] for at in range(len(item) + 1 - n))
        least.append(whole - Q - longest[errors] - errors * (Q - 1))
    return max(1, min(least, default=1))


def grams(text: str) -> np.ndarray:
    """A hash for each q-gram of the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    n = len(codes) + 1 - Q
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    by, size, out, at = codes * np.uint64(0x9E3779B97F4A7C15), 1, np.zeros(n, dtype=np.uint64), 0
    for bit in range(Q.bit_length()):  # hashes of 1, 2, 4, ... characters, joined to Q
        if Q >> bit & 1:
            out = (out ^ by[at : at + n]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
            at += size
        if size * 2 <= Q:
            by = (by[: len(by) - size] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (by[size:] + np.uint64(size))
            by ^= by >> np.uint64(29)
            size *= 2
    return out


def word_places(text: str) -> np.ndarray:
    """For each character the number of the word that it is in, or that ends before it."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.cumsum(codes == 32)


def aligned(item: list[str], text: list[str], low: int, high: int) -> bool:
    """Whether a stretch repeats half of the item; text position less item position is from low to high.

    For each cell and number of errors it keeps the most words repeated, and the longest stretch among those; if
    none serves, the longest stretch, and the most words among those.
    """
    n = len(item)
    errors = n // (WORDS_AN_ERROR - 1) + 1
    for repeated, stretch in ((1024, 1), (1, 1024)):
        above: dict[int, list[int]] = {}
        for i in range(n):
            row: dict[int, list[int]] = {}
            for j in range(max(0, i + low), min(len(text), i + high + 1)):
                corner = above.get(j - 1) or [0] + [-1] * errors
                up, left, same = above.get(j), row.get(j - 1), item[i] == text[j]
                cell = [0] + [-1] * errors
                for e in range(errors + 1):
                    best = cell[e]
                    if same and corner[e] >= 0:
                        best = max(best, corner[e] + repeated + stretch)
                    if e:
                        if corner[e - 1] >= 0:
                            best = max(best, corner[e - 1] + stretch)
                        if left and left[e - 1] >= 0:
                            best = max(best, left[e - 1] + stretch)
                        if up:
                            best = max(best, up[e - 1])
                    cell[e] = best
                    if same and best >= 0:
                        m, s = (best // 1024, best % 1024) if repeated > 1 else (best % 1024, best // 1024)
                        if m * PART >= n and s >= e * WORDS_AN_ERROR:
                            return True
                row[j] = cell
            above = row
    return False


class Items:
    """The held-out items with an index of their q-grams."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.items = [(k, w) for k, t in rows if (w := words(t))]
        self.least = [least_hits(w) for _, w in self.items]
        self.short = [x for x, n in enumerate(self.least) if n == 1]
        hashes, owners, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for x, (_, w) in enumerate(self.items):
            if self.least[x] > 1:
                text = " ".join(w)
                own = grams(text)
                hashes.append(own)
                owners.append(np.full(len(own), x))
                places.append(word_places(text)[: len(own)])
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        self.owner, self.place = np.concatenate(owners)[order], np.concatenate(places)[order]
        self.hash, self.start, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << SIEVE_BITS, dtype=bool)
        self.sieve[self._low(self.hash)] = True
        self.fewest = min((n for n in self.least if n > 1), default=0)

    @staticmethod
    def _low(hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64((1 << SIEVE_BITS) - 1)).astype(np.int64)

    def found(self, text: str | None) -> list[int]:
        """Items that the text holds."""
        w = words(text)
        out = [self.items[x][0] for x in self.short if aligned(self.items[x][1], w, -len(self.items[x][1]), len(w))]
        if not self.fewest:
            return out
        joined = " ".join(w)
        own = grams(joined)
        at = np.flatnonzero(self.sieve[self._low(own)])
        if len(at) < self.fewest:
            return out
        known = np.minimum(np.searchsorted(self.hash, own[at]), len(self.hash) - 1)
        same = self.hash[known] == own[at]
        at, known = at[same], known[same]
        if len(at) < self.fewest:
            return out
        times = self.count[known]
        each = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.start[known], times)
        owner, diagonal = self.owner[each], np.repeat(word_places(joined)[at], times) - self.place[each]
        order = np.lexsort((diagonal, owner))
        owner, diagonal = owner[order], diagonal[order]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        for a, b in zip(first, [*first[1:], len(owner)]):
            x = int(owner[a])
            if b - a >= self.least[x] and self._holds(x, w, diagonal[a:b]):
                out.append(self.items[x][0])
        return out

    def _holds(self, x: int, w: list[str], diagonals: np.ndarray) -> bool:
        """Whether a band of diagonals with enough q-grams holds the item by its alignment."""
        item, least = self.items[x][1], self.least[x]
        wide = len(item) // (WORDS_AN_ERROR - 1) + 1
        narrow = diagonals[least - 1 :] - diagonals[: len(diagonals) + 1 - least] <= wide
        bands: list[list[int]] = []
        for a in np.flatnonzero(narrow).tolist():
            low, high = int(diagonals[a]) - wide, int(diagonals[a + least - 1]) + wide
            if bands and low <= bands[-1][1]:
                bands[-1][1] = max(high, bands[-1][1])
            else:
                bands.append([low, high])
        return any(aligned(item, w, low, high) for low, high in bands)


def _found_in(texts: DataFrame, rows: list[tuple[int, str]]) -> DataFrame:
    known = texts.sparkSession.sparkContext.broadcast(Items(rows))

    def run(batches):
        for batch in batches:
            at, found = [], []
            for k, t in enumerate(batch.column(2)):
                for item_id in known.value.found(t.as_py()):
                    at.append(k)
                    found.append(item_id)
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(found, pa.int64())], names=["corpus", "record_id", "item_id"])

    return texts.mapInArrow(run, "corpus string, record_id bigint, item_id bigint")


def leaked_items(texts: DataFrame, items: DataFrame) -> DataFrame:
    """One row (corpus, record_id, item_id) for each item in a text; texts has corpus, record_id and text.

    Items go to the workers with an index of their q-grams, ITEMS at a time; more are looked for in as many passes over
    the texts. Null and empty texts hold none, and null and empty items are in none; only found rows are shuffled, so
    that a record that comes again counts once.
    """
    every = items.select(F.col("item_id").cast("bigint"), F.col("instruction").cast("string")).dropna().distinct()
    columns = texts.select("corpus", F.col("record_id").cast("bigint"), F.col("text").cast("string"))
    passes = max(1, -(-every.count() // ITEMS))
    out: DataFrame | None = None
    for n in range(passes):
        own = every if passes == 1 else every.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == n)
        found = _found_in(columns, [(r[0], r[1]) for r in own.collect()])
        out = found if out is None else out.unionAll(found)
    return out.distinct()
