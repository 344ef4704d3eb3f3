"""Encoding of text with a public byte-level BPE vocabulary.

Two tiers resolve a pre-token: a minimal perfect hash over the whole vocabulary answers for pre-tokens that
are themselves one vocabulary entry; every other pre-token is merged with a heap over linked bytes. A bounded
memo keeps the ids of pre-tokens that the worker has merged.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern published with the vocabulary.
PRE_TOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
MEMO_ENTRIES = 400_000
#: Ids of one outgoing batch, about; places in a batch are 32-bit numbers.
FLUSH = 1 << 22
BUCKET_KEYS = 4
#: A prime: displacements modulo the number of keys alone repeat, and a bucket may then fit at none of them.
PERIOD = 2**31 - 1


class PerfectHash:
    """Minimal perfect hash by displacement: as many slots as keys.

    Keys fall into buckets of about four. A bucket of several keys has a displacement that sends them to free
    slots, found for all buckets at once, largest first; a bucket of one key names its slot outright.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        if len(set(keys)) < n:
            raise ValueError("two keys are the same")
        self.n, self.buckets = n, max(1, n // BUCKET_KEYS)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        bucket = ((hashes >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int64)
        low, step = self._parts(hashes)
        size = np.bincount(bucket, minlength=self.buckets)
        shift = np.zeros(self.buckets, dtype=np.int64)
        slots, free = np.full(n, -1, dtype=np.int64), np.ones(n, dtype=bool)
        for width in range(int(size.max(initial=0)), 1, -1):
            left, d = np.flatnonzero(size[bucket] == width), 0
            left = left[np.argsort(bucket[left], kind="stable")]
            while len(left):
                d += 1
                at = (low[left] + d * step[left]) % PERIOD % n
                _, first = np.unique(at, return_index=True)
                good = np.zeros(len(at), dtype=bool)
                good[first] = True
                done = np.repeat((good & free[at]).reshape(-1, width).all(axis=1), width)
                slots[at[done]] = left[done]
                free[at[done]] = False
                shift[bucket[left[done]]] = d
                left = left[~done]
        single, open_ = np.flatnonzero(size[bucket] == 1), np.flatnonzero(free)
        slots[open_[: len(single)]] = single
        shift[bucket[single]] = -1 - open_[: len(single)]
        self.shift, self.slots = shift.tolist(), slots.tolist()


    @staticmethod
    def _parts(hashes):
        return (hashes & np.uint64(0xFFFFF)).astype(np.int64), ((hashes >> np.uint64(20)) & np.uint64(0xFFFFF)).astype(np.int64) | 1

    def index(self, key: bytes) -> int:
        """Position in the key list of the only key that can be ``key``; the caller compares the bytes."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[(h >> 40) % self.buckets]
        return self.slots[-1 - d if d < 0 else ((h & 0xFFFFF) + d * ((h >> 20) & 0xFFFFF | 1)) % PERIOD % self.n]


def read_vocabulary(vocabulary: str) -> tuple[list[bytes], list[int], PerfectHash]:
    """Entries of a vocabulary file with their ids and the perfect hash over them."""
    with open(vocabulary, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    keys = [base64.b64decode(k) for k, _ in pairs]
    return keys, [int(i) for _, i in pairs], PerfectHash(keys)


class Encoder(dict):
    """Maps a pre-token to its ids; as a dict it is the memo of the merged pre-tokens seen so far."""

    def __init__(self, parts: tuple[list[bytes], list[int], PerfectHash]):
        super().__init__()
        self.keys_, self.ids, self.hash = parts
        self.pattern = regex.compile(PRE_TOKEN)
        self.lookup = self._lookup()

    def _lookup(self) -> Callable[[str], tuple[int, ...]]:
        """Ids of a pre-token: tier one, the perfect hash, for whole entries; tier two, memo or merging, for all others."""
        keys, whole = self.keys_, [(i,) for i in self.ids]
        shift, slots, buckets, n, digest = self.hash.shift, self.hash.slots, self.hash.buckets, self.hash.n, xxhash.xxh3_64_intdigest

        def ids_of(pre_token: str) -> tuple[int, ...]:
            piece = pre_token.encode("utf-8", "replace")
            h = digest(piece)
            d = shift[(h >> 40) % buckets]
            at = slots[-1 - d if d < 0 else ((h & 0xFFFFF) + d * ((h >> 20) & 0xFFFFF | 1)) % PERIOD % n]
            return whole[at] if keys[at] == piece else self[pre_token]

        return ids_of

    def rank(self, piece: bytes) -> int | None:
        at = self.hash.index(piece)
        return self.ids[at] if self.keys_[at] == piece else None

    def __missing__(self, pre_token: str) -> tuple[int, ...]:
        ids = tuple(self.merge(pre_token.encode("utf-8", "replace")))
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        if len(pre_token) <= 64:
            self[pre_token] = ids
        return ids

    def merge(self, piece: bytes) -> list[int]:
        """Merges the adjacent pair of least rank until none is left; ends are linked, stale heap entries skipped."""
        n = len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive, queue = [True] * n, []

        def push(at: int) -> None:
            if end[at] < n and (r := self.rank(piece[at : end[end[at]]])) is not None:
                heapq.heappush(queue, (r, at, end[end[at]]))

        for at in range(n - 1):
            push(at)
        while queue:
            _, at, to = heapq.heappop(queue)
            if not alive[at] or end[at] >= n or end[end[at]] != to:
                continue
            alive[end[at]] = False
            end[at] = to
            if to < n:
                before[to] = at
            push(at)
            if before[at] >= 0:
                push(before[at])
        out, at = [], 0
        while at < n:
            out.append(self.rank(piece[at : end[at]]))
            at = end[at]
        return out

    def encode(self, text: str | None) -> Iterator[int]:
        """Ids of one text; none for a null or empty one."""
        return chain.from_iterable(map(self.lookup, self.pattern.findall(text))) if text else iter(())


_ENCODERS: dict[str, Encoder] = {}
_SHIPPED: dict[tuple[str, str], Broadcast] = {}


def encoder(vocabulary: str, parts: Broadcast | None = None) -> Encoder:
    """The encoder of this process for a vocabulary file, from what the driver sent or else from the file."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(read_vocabulary(vocabulary) if parts is None else parts.value)
    return _ENCODERS[vocabulary]


def shipped(df: DataFrame, vocabulary: str) -> Broadcast:
    """The vocabulary and its perfect hash, read and built once on the driver; their size is the vocabulary's."""
    context = df.sparkSession.sparkContext
    key = (context.applicationId, vocabulary)
    if key not in _SHIPPED:
        _SHIPPED[key] = context.broadcast(read_vocabulary(vocabulary))
    return _SHIPPED[key]


def encode_ids(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """One row ``(key, ids)`` for each input row, without special tokens.

    Null and empty texts give the empty list; text that spells a special token is ordinary text; a null key stays
    null; repeated rows give repeated rows; other columns are dropped. There is no shuffle. Batches are handed on
    whenever they have FLUSH ids.
    """
    parts = shipped(df, vocabulary)
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches):
        enc = encoder(vocabulary, parts)
        for batch in batches:
            ids, offsets, first = array("i"), [0], 0

            def full(to: int) -> pa.RecordBatch:
                values = pa.array(np.frombuffer(ids, dtype=np.int32) if ids else np.empty(0, np.int32), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                return pa.RecordBatch.from_arrays([batch.column(0).slice(first, to - first), lists], names=[key, "ids"])

            for i, t in enumerate(batch.column(1)):
                if t := t.as_py():
                    ids.extend(enc.encode(t))
                offsets.append(len(ids))
                if len(ids) >= FLUSH:
                    yield full(i + 1)
                    ids, offsets, first = array("i"), [0], i + 1
            if first < batch.num_rows or not batch.num_rows:
                yield full(batch.num_rows)

    return rows.mapInArrow(run, f"`{key}` {rows.schema['k'].dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(key, *keep, n_tokens)``: only the number of ids leaves the worker. Null and empty texts count 0."""
    parts = shipped(df, vocabulary)
    extra = df.select(key, *keep, F.col(text).cast("string").alias("__text"))
    kept = extra.schema.fields[:-1]

    def run(batches):
        enc = encoder(vocabulary, parts)
        for batch in batches:
            counts = [sum(map(len, map(enc.lookup, enc.pattern.findall(t)))) if (t := x.as_py()) else 0 for x in batch.column(batch.num_columns - 1)]
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + ["n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_tokens bigint"
    return extra.mapInArrow(run, schema)
