"""Removal of passages that occur earlier in the corpus.

Method: fixed-block anchors. Every non-overlapping block of `block` words of a document goes into an index; every
rolling window of `block` words probes it. A repeat of `window` words, window >= 2 * block - 1, holds a whole block
wherever it starts, so windows that touch no hit can't be repeats. Hits that meet are extended to maximal runs, and
runs are compared as wholes: all of a run that starts earlier elsewhere is a repeat. Only windows at the edges of runs,
and of runs that are the first of their kind, are left; they are compared one by one, which makes the result exact. The
union of repeated runs and windows, the maximal exact repeats, is what is removed.

How it runs. Documents are dealt once into buckets by doc_id; that shuffle serves all four passes (Spark reuses the
exchange). A bucket sends each distinct fingerprint once to the shard that owns its range, in sorted packed arrays (see
`dealing`), so a passage in a third of all documents costs each bucket one entry, and gets back one bit an entry.
Nothing grows with the number of pairs of copies. A task holds one bucket or one shard; both shrink as
spark.sql.shuffle.partitions grows. Words are hashed a batch of texts at a time.

Fingerprints of blocks have 48 bits; a clash only makes more windows be compared. Runs are compared by their length and
96 bits, windows by 96 bits of two independent polynomial hashes.

Exactness. The first occurrence of a window never lies in a repeated run (the run's earlier copy would hold an earlier
one), so it is always among the windows that are compared.

Defined results: null, empty or shorter texts than `window` words lose nothing (null: no words, kept text empty). A
null id counts as larger than any id. Rows that share an id are ordered by their text; the later rows are repeats.
An empty table gives an empty result. Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import NULL_ID, column_bytes, mix, shuffle_partitions
from lexmill.llm.dealing import DIRECT, PACKED, Messages, Routes, bits, bucket_of, count, head, slices, split_bits, to_bits
from lexmill.llm.word_hashes import hash_words, powers

REMOVED = "doc_id long, n_words long, n_removed long, spans array<struct<start: int, stop: int>>, kept_text string"
P1, P2 = np.uint64(0x9E3779B97F4A7C55), np.uint64(0xD6E8FEB86659FD93)
_BLOCKS, _RUNS, _WINDOWS = 1, 2, 3


def ordered(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For entries with equal keys one number: (order, whether new in it, each entry's number). With several keys, entries stay in order."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, new, number


class Bucket:
    """The words of one bucket's documents, as hashes, ordered by (id, text)."""

    def __init__(self, table: pa.Table, block: int, window: int):
        ids, texts = table.column("doc_id").to_pylist(), column_bytes(table, "text")
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or b""))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] or b"" for i in order]
        self.block, self.window = block, window
        self.words, self.lengths = hash_words(self.texts)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.n = len(self.words)
        self.first = self.rolling(P1, self.words)
        self.block_fingerprints()

    def rolling(self, prime: np.uint64, words: np.ndarray) -> np.ndarray:
        """Polynomial hash of the block that starts at each word, also across documents' ends."""
        out = np.zeros(max(0, self.n - self.block + 1), np.uint64)
        for j in range(self.block):
            out *= prime
            out += words[j : j + len(out)]
        return out

    def positions(self, span: int, least: int) -> np.ndarray:
        """Starts of spans inside one document of `least` words or more."""
        ok = np.zeros(self.n + 1, np.int32)
        fit = self.lengths >= max(span, least)
        np.add.at(ok, self.starts[:-1][fit], 1)
        np.add.at(ok, (self.starts[:-1] + self.lengths - span + 1)[fit], -1)
        return np.flatnonzero(np.cumsum(ok[:-1]) > 0) if self.n else np.empty(0, np.int64)

    def owner_ids(self, at: np.ndarray) -> np.ndarray:
        ids = np.array([NULL_ID if i is None else i for i in self.ids], np.int64)
        return ids[np.searchsorted(self.starts, at, side="right") - 1]

    def block_fingerprints(self) -> None:
        """Distinct fingerprints of all rolling blocks, and each one's number by word start."""
        self.at = self.positions(self.block, self.window)
        fps = mix(self.first[self.at]) >> np.uint64(16)
        order, new, self.number = ordered(fps)
        self.fps, self.twice = fps[order][new], np.diff(np.append(np.flatnonzero(new), len(fps))) > 1

    def aligned(self) -> np.ndarray:
        """Which fingerprints are of an indexed block, one that starts at a multiple of the block's length."""
        out = np.zeros(len(self.fps), bool)
        begun = self.starts[np.searchsorted(self.starts, self.at, side="right") - 1]
        out[self.number[(self.at - begun) % self.block == 0]] = True
        return out

    def hits(self, marks: np.ndarray) -> np.ndarray:
        """Word starts of hit blocks."""
        return self.at[marks[self.number]]

    def runs(self, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, stop) of maximal runs of hits that meet, inside one document, of a window's length or more."""
        if not len(hits):
            return hits, hits
        of = np.searchsorted(self.starts, hits, side="right")
        new = np.concatenate([[True], (hits[1:] - hits[:-1] > self.block) | (of[1:] != of[:-1])])
        start, stop = hits[new], hits[np.append(np.flatnonzero(new)[1:] - 1, len(hits) - 1)] + self.block
        long_ = stop - start >= self.window
        return start[long_], stop[long_]

    def run_hashes(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of whole runs, from running sums."""
        out, size = [], (stop - start).astype(np.uint64)
        for prime, words in ((P1, self.words), (P2, mix(self.words + np.uint64(1)))):
            base = int(prime)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers(base, self.n)[: self.n])])
            out.append(mix((sums[stop] - sums[start]) * powers(pow(base, -1, 2**64), self.n)[start] + mix(size)))
        return out[0], out[1] >> np.uint64(32)

    def grouped_runs(self, marks: np.ndarray):
        """Runs by content: distinct (a, b), their first start, and each run's (start, stop, number)."""
        start, stop = self.runs(self.hits(marks))
        a, b = self.run_hashes(start, stop)
        order, new, number = ordered(a, b)
        return a[order][new], b[order][new], start[order][new], start, stop, number

    def known(self, marks: np.ndarray, keeps: np.ndarray) -> np.ndarray:
        """Word starts of windows inside repeated runs, as flags."""
        _, _, first, start, stop, number = self.grouped_runs(marks)
        again = ~keeps[number] | (start != first[number])
        inside = np.zeros(self.n + 1, np.int64)
        np.add.at(inside, start[again], 1)
        np.add.at(inside, stop[again] - self.window + 1, -1)
        return np.cumsum(inside[: self.n]) > 0

    def windows(self, marks: np.ndarray, known: np.ndarray):
        """Windows that touch a hit and aren't known repeats: distinct (a, b), their first start, each one's start and number."""
        touched = np.zeros(self.n + 1, np.int64)
        touched[self.hits(marks) + 1] = 1
        touched = np.cumsum(touched)
        at = self.positions(self.window, self.window)
        reach = self.window - self.block + 1
        at = at[(touched[np.minimum(at + reach, self.n)] > touched[at]) & ~known[at]]
        second = self.rolling(P2, mix(self.words + np.uint64(1)))
        rest = self.window - self.block
        a, b = self.first[at], second[at]
        # blocks that together hold all the window's words: every block's length one, and the last
        for step in [*range(self.block, rest, self.block), rest]:
            a, b = a * P1 ** np.uint64(31) + self.first[at + step], b * P2 ** np.uint64(29) + second[at + step]
        a, b = mix(a), mix(b) >> np.uint64(32)
        order, new, number = ordered(a, b)
        return a[order][new], b[order][new], at[order][new], at, number


def _high_low(values: np.ndarray, low_bits: int) -> bytes:
    """Sorted values, the slow high halves apart from the low ones, so that compression takes the former away."""
    return (values >> np.uint64(low_bits)).astype(np.uint32).tobytes() + (values & np.uint64((1 << low_bits) - 1)).astype(np.uint32).tobytes()


def _from_high_low(raw: bytes, n: int, low_bits: int) -> np.ndarray:
    high, low = np.frombuffer(raw, np.uint32, n), np.frombuffer(raw, np.uint32, n, 4 * n)
    return (high.astype(np.uint64) << np.uint64(low_bits)) | low


def _mark(messages: Messages) -> list[bytes]:
    """Shard: which fingerprints are an indexed block and occur at two places at least."""
    counts, fps, aligned, twice = [], [], [], []
    for _, raw in messages:
        n = count(raw)
        counts.append(n)
        fps.append(_from_high_low(raw[8 : 8 + 8 * n], n, 32))
        k = (n + 7) // 8
        aligned.append(bits(raw[8 + 8 * n : 8 + 8 * n + k], n))
        twice.append(bits(raw[8 + 8 * n + k :], n))
    fps = np.concatenate(fps)
    order, new, number = ordered(fps)
    starts = np.flatnonzero(new)
    indexed = np.logical_or.reduceat(np.concatenate(aligned)[order], starts)
    again = np.logical_or.reduceat(np.concatenate(twice)[order], starts) | (np.diff(np.append(starts, len(fps))) > 1)
    return split_bits((indexed & again)[number], counts)


def _earliest(messages: Messages) -> list[bytes]:
    """Shard: whether the sender of each run or window holds its earliest occurrence."""
    a, b, ids, counts = [], [], [], []
    for _, raw in messages:
        n = count(raw)
        counts.append(n)
        a.append(np.frombuffer(raw, np.uint64, n, 8))
        b.append(np.frombuffer(raw, np.uint32, n, 8 + 8 * n))
        ids.append(np.frombuffer(raw, np.int64, n, 8 + 12 * n))
    a, b, ids = map(np.concatenate, (a, b, ids))
    order = np.lexsort((ids, b, a))
    first = np.ones(len(a), bool)
    first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    flags = np.empty(len(a), bool)
    flags[order] = first
    return split_bits(flags, counts)


class _Passes:
    """What a bucket does in each pass, with the answers of the passes before it."""

    def __init__(self, block: int, window: int, routes: Routes):
        self.block, self.window, self.routes = block, window, routes

    def _parts(self, values: np.ndarray, size: int) -> list[tuple[int, int, int]]:
        return slices(values, self.routes.n, size)

    def _answer(self, back: pa.Table, step: int, values: np.ndarray, size: int) -> np.ndarray:
        """The bits that shards gave back for this bucket, in the order in which its values were sent."""
        by = dict(self.routes.received(back.filter(pa.array([x == step for x in back.column("step").to_pylist()], pa.bool_()))))
        return np.concatenate([*(bits(by[s], j - i) for s, i, j in self._parts(values, size)), np.empty(0, bool)])

    def _bucket(self, docs: pa.Table) -> Bucket:
        return Bucket(docs, self.block, self.window)

    def _occurrences(self, bucket: Bucket, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> Messages:
        b, ids = b.astype(np.uint32), bucket.owner_ids(first)
        return [(s, head(j - i) + a[i:j].tobytes() + b[i:j].tobytes() + ids[i:j].tobytes()) for s, i, j in self._parts(a, 64)]

    def blocks(self, docs: pa.Table) -> pa.Table:
        bucket = self._bucket(docs)
        fps, aligned, twice = bucket.fps, bucket.aligned(), bucket.twice
        messages = [(s, head(j - i) + _high_low(fps[i:j], 32) + to_bits(aligned[i:j]) + to_bits(twice[i:j])) for s, i, j in self._parts(fps, 48)]
        return self.routes.sent(docs.column("bucket")[0].as_py(), messages)

    def runs(self, docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return self.routes.sent(0, [])
        bucket = self._bucket(docs)
        a, b, first, *_ = bucket.grouped_runs(self._answer(back, _BLOCKS, bucket.fps, 48))
        return self.routes.sent(docs.column("bucket")[0].as_py(), self._occurrences(bucket, a, b, first))

    def _left(self, bucket: Bucket, back: pa.Table):
        marks = self._answer(back, _BLOCKS, bucket.fps, 48)
        known = bucket.known(marks, self._answer(back, _RUNS, bucket.grouped_runs(marks)[0], 64))
        return known, bucket.windows(marks, known)

    def windows(self, docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return self.routes.sent(0, [])
        bucket = self._bucket(docs)
        _, (a, b, first, *_) = self._left(bucket, back)
        return self.routes.sent(docs.column("bucket")[0].as_py(), self._occurrences(bucket, a, b, first))

    def cut(self, docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return RESULT.empty_table()
        bucket = self._bucket(docs)
        known, (a, _, first, at, number) = self._left(bucket, back)
        again = ~self._answer(back, _WINDOWS, a, 64)[number] | (at != first[number])
        known[at[again]] = True
        repeats = np.flatnonzero(known)
        cover = np.zeros(bucket.n + 1, np.int64)
        np.add.at(cover, repeats, 1)
        np.add.at(cover, repeats + self.window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        removed, spans, kept = [], [], []
        for k, text in enumerate(bucket.texts):
            lost = gone[bucket.starts[k] : bucket.starts[k + 1]]
            words = text.split()
            edges = np.flatnonzero(np.diff(np.concatenate([[0], lost, [0]]).astype(np.int8))) if lost.any() else ()
            spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)])
            if len(edges):
                words = [w for w, x in zip(words, lost.tolist(), strict=True) if not x]
            removed.append(int(lost.sum()))
            kept.append(b" ".join(words))
        return pa.table([pa.array(bucket.ids, pa.int64()), pa.array(bucket.lengths), pa.array(removed, pa.int64()), pa.array(spans, RESULT.field("spans").type), pa.array(kept, pa.binary()).cast(pa.string())], schema=RESULT)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("kept_text", pa.string())])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, block: int = 10, buckets: int | None = None, direct: int = DIRECT) -> DataFrame:
    """Per document: n_words, n_removed, the removed word spans and the kept text.

    buckets: parts into which documents and fingerprints are dealt, spark.sql.shuffle.partitions if not given; a part
    should hold some ten MB of text. direct: buckets beyond which messages travel by relays.
    """
    if window < 2 * block - 1:
        raise ValueError("window must be at least 2 * block - 1")
    n = buckets or shuffle_partitions(docs.sparkSession)
    routes = Routes(n, direct)
    passes = _Passes(block, window, routes)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.select("*", bucket_of("doc_id", n)).repartitionById(n, F.col("bucket"))

    def met(replies: DataFrame, work, result: str) -> DataFrame:
        return dealt.groupBy("bucket").cogroup(replies.repartitionById(n, F.col("bucket")).groupBy("bucket")).applyInArrow(lambda own, back: work(own, back), result)

    replies = routes.answered(dealt.groupBy("bucket").applyInArrow(lambda own: passes.blocks(own), PACKED), _mark).withColumn("step", F.lit(_BLOCKS))
    runs = routes.answered(met(replies, passes.runs, PACKED), _earliest).withColumn("step", F.lit(_RUNS))
    replies = replies.unionByName(runs)
    windows = routes.answered(met(replies, passes.windows, PACKED), _earliest).withColumn("step", F.lit(_WINDOWS))
    return met(replies.unionByName(windows), passes.cut, REMOVED)
