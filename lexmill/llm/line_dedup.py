"""Removal of lines that many documents share.

Method: a sharded minimal perfect hash over distinct line hashes. Lines are counted by their 128-bit hashes; those of
`min_docs` documents or more are dealt to shards. Each shard builds a minimal perfect hash over its hashes and, at its
slots, compact arrays: a 64-bit fingerprint (the second half of the hash, which the first half's slot must agree with,
so a line that wasn't indexed passes by a chance of 2^-64), a saturating document count and the largest id. The shards
publish their arrays, and documents probe them: lines are never joined, and no line meets another document's line.

How it runs. Counting is built-in expressions: one narrow row a line (two hashes and an id), pre-aggregated, so a line
that a third of all documents hold costs one row a task. The published arrays are sent to the tasks that read the
documents, at most `block_bytes` at a time (a checked bound). If all fit, documents are probed and rewritten in one pass
and never shuffled. If not, each block of shards is one pass that tells only the rows that hold its lines and where;
what it tells is gathered by row and joined to the documents once.

A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of `min_chars` code points or more,
in `min_docs` documents or more, lose all their lines except in the largest id that holds them.

Defined results: a null or empty text is one empty line. A null id counts as larger than any id. Rows that share an id
are one document for the counts, and each keeps or loses its own lines. An empty table gives an empty result. Columns
other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import NULL_ID, SPACE_CHARS, ascii_lower, column_bytes, mix, row_key, written

RESULT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string())])
KEPT = "doc_id long, n_lines long, n_dropped long, kept_text string"
SEED = 42


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bit arrays in which keys alone at a position stay."""

    def __init__(self, keys: np.ndarray, gamma: float = 2.0):
        levels: list[np.ndarray] = []
        while len(keys):
            size = max(8, int(gamma * len(keys)))
            at = self._position(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        self._of(levels)

    def _of(self, levels: list[np.ndarray]) -> None:
        self.levels, self.ranks, self.n = levels, [], 0
        for alone in levels:
            self.ranks.append(self.n + np.cumsum(alone, dtype=np.int64) - 1)
            self.n += int(alone.sum())

    @classmethod
    def from_levels(cls, levels: list[np.ndarray]) -> PerfectHash:
        out = cls.__new__(cls)
        out._of(levels)
        return out

    @staticmethod
    def _position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(0x632BE59BD9B4E019 * (level + 1) % 2**64)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot in [0, n) for each key; a key that wasn't built in gets any slot, or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (alone, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self._position(keys[left], level, len(alone))
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out


class LineIndex:
    """A shard's arrays at the slots of its perfect hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, last: np.ndarray, checks: np.ndarray | None = None, kind=np.uint8):
        """checks: the hashes' other halves, made of the hashes if there are none. kind: the counts' type, at whose largest value they stay."""
        self.hash = PerfectHash(hashes)
        at = self.hash.slots(hashes)
        self.fingerprint, self.counts, self.last = np.empty(len(hashes), np.uint64), np.empty(len(hashes), kind), np.empty(len(hashes), np.int64)
        self.fingerprint[at] = mix(hashes) if checks is None else checks
        self.counts[at] = np.minimum(counts, np.iinfo(kind).max)
        self.last[at] = last

    def probe(self, hashes: np.ndarray, checks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The documents that hold each line (the counts' largest value: as many or more; 0: unknown line) and the largest of their ids."""
        at = self.hash.slots(hashes)
        known = at >= 0
        known[known] = self.fingerprint[at[known]] == (mix(hashes[known]) if checks is None else checks[known])
        held, last = np.zeros(len(hashes), self.counts.dtype), np.full(len(hashes), -1, np.int64)
        held[known], last[known] = self.counts[at[known]], self.last[at[known]]
        return held, last

    def to_bytes(self) -> bytes:
        raw = io.BytesIO()
        levels = {f"level{k}": np.packbits(x) for k, x in enumerate(self.hash.levels)}
        np.savez(raw, sizes=np.array([len(x) for x in self.hash.levels], np.int64), fingerprint=self.fingerprint, counts=self.counts, last=self.last, **levels)
        return raw.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> LineIndex:
        out, held = cls.__new__(cls), np.load(io.BytesIO(raw))
        out.hash = PerfectHash.from_levels([np.unpackbits(held[f"level{k}"], count=n).astype(bool) for k, n in enumerate(held["sizes"].tolist())])
        out.fingerprint, out.counts, out.last = held["fingerprint"], held["counts"], held["last"]
        return out


class LineShards:
    """Some of an index's shards, as documents probe them."""

    def __init__(self, shards: int, bodies: dict[int, bytes]):
        self.shards, self.bodies, self.held = shards, bodies, {}

    def __getstate__(self):
        return {"shards": self.shards, "bodies": self.bodies, "held": {}}

    def probe(self, hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, last = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1, np.int64)
        of = (hashes % np.uint64(self.shards)).astype(np.int64)
        for shard, body in self.bodies.items():
            at = np.flatnonzero(of == shard)
            if len(at):
                if shard not in self.held:
                    self.held[shard] = LineIndex.from_bytes(body)
                counts[at], last[at] = self.held[shard].probe(hashes[at], checks[at])
        return counts, last


def count_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(h, c, n, last): both hash halves of lines of `min_docs` documents or more, the number of documents and the largest id."""
    id_, text = F.coalesce(F.col(id_col).cast("long"), F.lit(int(NULL_ID))), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = docs.select(id_.alias("id"), F.explode(F.split(text, "\n", -1)).alias("line")).where(F.octet_length("line") >= min_chars)
    keys = lines.select("id", ascii_lower(F.trim("line", F.lit(SPACE_CHARS))).alias("key")).where(F.length("key") >= min_chars)
    hashed = keys.select("id", F.xxhash64("key").alias("h"), F.xxhash64(F.concat("key", F.lit("\n"))).alias("c"))
    return hashed.groupBy("h", "c").agg(F.count_distinct("id").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs)


def build_index(counted: DataFrame, shards: int, kind=np.uint8) -> DataFrame:
    """(shard, body): the published arrays of counted lines (h, c, n, last)."""

    def build(table: pa.Table) -> pa.Table:
        h, c = (table.column(k).to_numpy().view(np.uint64) for k in ("h", "c"))
        # two lines of one first half (2^-64 each pair): the perfect hash needs distinct keys, so the rarer one stays unknown
        order = np.lexsort((-table.column("n").to_numpy(), h))
        first = order[np.concatenate([[True], h[order][1:] != h[order][:-1]])]
        index = LineIndex(h[first], table.column("n").to_numpy()[first], table.column("last").to_numpy()[first], c[first], kind)
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "body": pa.array([index.to_bytes()], pa.binary())})

    # the unsigned remainder, as documents compute it
    rest = F.pmod(F.pmod(F.col("h"), F.lit(shards)) + F.when(F.col("h") < 0, F.lit(2**64 % shards)).otherwise(F.lit(0)), F.lit(shards))
    return counted.withColumn("shard", rest.cast("int")).groupBy("shard").applyInArrow(build, "shard int, body binary")


class Lines:
    """The lines of a batch of texts, with both halves of their keys' hashes (of lines that are long enough)."""

    def __init__(self, batch: pa.RecordBatch, min_chars: int):
        self.ids = batch.column("doc_id").to_pylist()
        self.lines = [(t or b"").split(b"\n") for t in column_bytes(pa.Table.from_batches([batch]), "text")]
        self.lengths = np.array([len(x) for x in self.lines], np.int64)
        at, h, c, place, digest = [], [], [], 0, xxhash.xxh64_intdigest
        for doc in self.lines:
            for k, line in enumerate(doc, place):
                if len(line) >= min_chars:
                    key = line.strip().lower()
                    if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                        at.append(k)
                        h.append(digest(key, SEED))
                        c.append(digest(key + b"\n", SEED))
            place += len(doc)
        self.at, self.h, self.c = np.array(at, np.int64), np.array(h, np.uint64), np.array(c, np.uint64)
        self.owner = np.repeat(np.array([NULL_ID if i is None else i for i in self.ids], np.int64), self.lengths)

    def gone(self, index: LineShards, min_docs: int) -> np.ndarray:
        """Which lines go by the shards at hand."""
        out = np.zeros(len(self.owner), bool)
        held, last = index.probe(self.h, self.c)
        out[self.at] = (held >= min_docs) & (last != self.owner[self.at])
        return out

    def kept(self, gone: np.ndarray) -> pa.RecordBatch:
        dropped, kept, k = [], [], 0
        for doc in self.lines:
            lost = gone[k : k + len(doc)]
            k += len(doc)
            n = int(lost.sum())
            dropped.append(n)
            kept.append(b"\n".join([x for x, y in zip(doc, lost.tolist(), strict=True) if not y] if n else doc))
        return pa.record_batch([pa.array(self.ids, pa.int64()), pa.array(self.lengths), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema=RESULT)


def _blocks(index: DataFrame, block_bytes: int) -> list[list[int]]:
    """Shards by blocks of about so many bytes (a larger shard is a block of its own)."""
    out: list[list[int]] = []
    size = 0
    for r in index.select("shard", F.length("body").alias("n")).orderBy("shard").collect():
        if not out or size + r["n"] > block_bytes:
            out.append([])
            size = 0
        out[-1].append(r["shard"])
        size += r["n"]
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, shard_lines: int = 1 << 20, block_bytes: int = 64 << 20) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped and the kept text.

    shard_lines: indexed lines a shard. block_bytes: bytes of published arrays that a task holds (and the driver passes on) at once.
    """
    if min_docs < 1:
        raise ValueError("min_docs must be 1 or more")
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if min_docs <= np.iinfo(k).max)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = written(count_lines(docs, id_col, text_col, min_chars, min_docs), "shared-lines")
    shards = max(1, -(-counted.count() // shard_lines))
    index = written(build_index(counted, shards, kind), "line-index")
    blocks = _blocks(index, block_bytes)

    def arrays(block: list[int]) -> LineShards:
        return LineShards(shards, {r["shard"]: r["body"] for r in index.where(F.col("shard").isin(block)).collect()})

    if len(blocks) <= 1:
        held = arrays(blocks[0] if blocks else [])

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lines = Lines(batch, min_chars)
                yield lines.kept(lines.gone(held, min_docs))

        return rows.mapInArrow(drop, KEPT)

    def told(part: LineShards):
        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lines = Lines(batch, min_chars)
                gone, ends = lines.gone(part, min_docs), np.cumsum(lines.lengths)
                found = [np.flatnonzero(gone[e - n : e]).astype(np.int32) for e, n in zip(ends.tolist(), lines.lengths.tolist(), strict=True)]
                has = pa.array([len(x) > 0 for x in found], pa.bool_())
                yield pa.record_batch({"key": batch.column("key"), "gone": pa.array(found, pa.list_(pa.int32()))}).filter(has)

        return tell

    keyed = rows.withColumn("key", row_key("doc_id", F.col("text")))
    kind_of_key = keyed.schema["key"].dataType.simpleString()
    parts = []
    for block in blocks:
        part = keyed.mapInArrow(told(arrays(block)), f"key {kind_of_key}, gone array<int>")
        parts.append(written(part.groupBy("key").agg(F.first("gone").alias("gone")), "shared-places"))
    all_ = parts[0]
    for part in parts[1:]:
        all_ = all_.unionByName(part)
    gone = all_.groupBy(F.col("key").alias("_key")).agg(F.flatten(F.collect_list("gone")).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = Lines(batch, min_chars)
            out, starts = np.zeros(len(lines.owner), bool), (np.cumsum(lines.lengths) - lines.lengths).tolist()
            for start, places in zip(starts, batch.column("gone").to_pylist(), strict=True):
                out[[start + p for p in places or ()]] = True
            yield lines.kept(out)

    joined = keyed.join(gone, keyed["key"].eqNullSafe(gone["_key"]), "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(cut, KEPT)
