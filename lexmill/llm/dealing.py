"""Packed messages between n buckets of documents and n shards of hash ranges.

A bucket sends each shard the sorted values of the shard's range and gets back an answer for each value in the same
order, so values need no keys of their own on the way. Up to `direct` buckets a bucket writes one row for each shard, n
times n rows in all. Beyond that rows travel by relays, of which each stands for about the square root of n buckets and
shards: a bucket writes one row for each group of shards, a relay sorts the rows of its buckets by shard, and answers
come back the same way, so that each step has some n to the power of 1.5 rows and rows stay large.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: to: the shard, bucket or group that a row is for; by: the bucket, shard or group that it is from.
PACKED = "to int, by int, payload binary"
DIRECT = 2048
Messages = list[tuple[int, bytes]]


def bucket_of(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("bucket")


def slices(values: np.ndarray, shards: int, bits: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of the ranges into which sorted values of so many bits fall."""
    edges = [min((s << bits) // shards, (1 << bits) - 1) for s in range(1, shards)]
    cuts = np.concatenate([[0], np.searchsorted(values, np.array(edges, np.uint64)), [len(values)]]).astype(np.int64)
    full = np.flatnonzero(cuts[1:] > cuts[:-1])
    return list(zip(full.tolist(), cuts[full].tolist(), cuts[full + 1].tolist(), strict=True))


def rows_of(rows: Iterable[tuple[int, int, bytes]]) -> pa.Table:
    rows = list(rows)
    to, by, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"to": pa.array(to, pa.int32()), "by": pa.array(by, pa.int32()), "payload": pa.array(payload, pa.binary())})


def bundle(messages: Messages) -> bytes:
    """Messages with their numbers as one."""
    numbers, bodies = zip(*messages, strict=True)
    return head(len(messages)) + np.array(numbers, np.int64).tobytes() + np.array([len(b) for b in bodies], np.int64).tobytes() + b"".join(bodies)


def unbundled(raw: bytes) -> Messages:
    n = count(raw)
    numbers, sizes = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
    ends = (8 + 16 * n + np.cumsum(sizes)).tolist()
    return [(k, raw[e - s : e]) for k, s, e in zip(numbers.tolist(), sizes.tolist(), ends, strict=True)]


class Routes:
    """The ways between n buckets and n shards."""

    def __init__(self, n: int, direct: int = DIRECT):
        self.n, self.fan = n, 1 if n <= direct else math.isqrt(n - 1) + 1

    def _grouped(self, messages: Messages) -> dict[int, Messages]:
        out: dict[int, Messages] = {}
        for number, body in messages:
            out.setdefault(number // self.fan, []).append((number, body))
        return out

    def sent(self, by: int, messages: Messages) -> pa.Table:
        """Rows of messages (to, body) of a bucket or a shard."""
        if self.fan == 1:
            return rows_of((to, by, body) for to, body in messages)
        return rows_of((group, by, bundle(some)) for group, some in self._grouped(messages).items())

    def relayed(self, rows: DataFrame) -> DataFrame:
        """Rows as they arrive: each for one bucket or shard, (by, body) in one row or in a bundle."""
        if self.fan == 1:
            return rows
        grouped = rows.select("*", (F.col("by") / self.fan).cast("int").alias("relay")).repartition(self.n, "to", "relay")

        def relay(table: pa.Table) -> pa.Table:
            by_to: dict[int, Messages] = {}
            for by, raw in zip(table.column("by").to_pylist(), table.column("payload").to_pylist(), strict=True):
                for to, body in unbundled(raw):
                    by_to.setdefault(to, []).append((by, body))
            own = table.column("relay")[0].as_py()
            return rows_of((to, own, bundle(some)) for to, some in by_to.items())

        return grouped.groupBy("to", "relay").applyInArrow(relay, PACKED)

    def received(self, table: pa.Table) -> Messages:
        """(by, body) of the rows that one bucket or shard gets."""
        rows = list(zip(table.column("by").to_pylist(), table.column("payload").to_pylist(), strict=True))
        return rows if self.fan == 1 else [m for _, raw in rows for m in unbundled(raw)]

    def answered(self, rows: DataFrame, answer: Callable[[Messages], list[bytes]]) -> DataFrame:
        """Messages of buckets through the shards and back: answer gives a body for each message, in order."""

        def shard(table: pa.Table) -> pa.Table:
            messages = self.received(table)
            return self.sent(table.column("to")[0].as_py(), sorted(zip((by for by, _ in messages), answer(messages), strict=True)))

        at_shards = self.relayed(rows).repartitionById(self.n, F.col("to")).groupBy("to").applyInArrow(shard, PACKED)
        return self.relayed(at_shards).withColumnRenamed("to", "bucket")


def head(n: int) -> bytes:
    return n.to_bytes(8, "little")


def count(raw: bytes) -> int:
    return int.from_bytes(raw[:8], "little")


def to_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def split_bits(flags: np.ndarray, counts: list[int]) -> list[bytes]:
    """Bits for each of the messages that hold so many values."""
    cuts = np.cumsum([0, *counts]).tolist()
    return [to_bits(flags[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
