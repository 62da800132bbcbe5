"""SimHash fingerprints of documents and the groups that near-equal fingerprints link.

Method: pigeonring filtering. The 64 bits form a ring of four segments. If two fingerprints differ in at most three
bits, some segment starts a chain along the ring whose cumulative differences stay within the proportional budgets
3/4, 6/4, 9/4 and 3, that is 0, 1, 2 and 3 bits. Every such chain leaves four whole bytes equal: the first segment, and
either a half of each of the next two (second segment differs in at most one bit, third in at most one), or the whole
second (third differs in two). So 20 byte combinations find every pair; a pair found is pruned by the chain's budgets,
then checked by its full Hamming distance.

How it runs. Fingerprints are first made distinct, so exact copies cost one entry. Entries of one combination meet in a
task by their four equal bytes; there only the links that join two groups are emitted (at most one less than entries),
never all pairs. A combination that very many distinct fingerprints share is split once more by each of its other four
bytes (three differing bits leave one of them equal), and where many share those too, each looks up the values within
three bits of the 24 that are left, so the work stays in proportion. Components come from star rounds over checkpointed
edges. Joins by fingerprint or group broadcast what is told of hot keys, of which there can't be many (`spread_join`).

Defined results: null, empty and blank texts have fingerprint zero and link like any other. A null id is never a
component's id unless all its documents' ids are null. Rows that share an id each get a row. An empty table gives an
empty result. Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations as combinations_of

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import checkpointed, free_name, mix, shuffle_partitions, spread_join, written
from lexmill.llm.components import connected_components

SEED = 42
#: Entries above which a combination's group is split by its other bytes.
DENSE = 2048
#: Keys of least hashes by text, and the least hashes in each.
BANDS, BAND_ROWS = 24, 4
#: Texts of a block that meet in one task, and the most tiles that those of a larger block which aren't close to its first are dealt into.
TILE, MOST_TILES = 512, 16


def shingle_hashes(text: bytes | None, size: int) -> list[int]:
    words = (text or b"").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(b" ".join(words), SEED)] if words else []
    ends = [words[i:] for i in range(size)]
    return [digest(b" ".join(x), SEED) for x in zip(*ends, strict=False)]


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def fingerprints_of(texts: list[bytes | None], size: int, part: int = 60_000) -> np.ndarray:
    """Fingerprints; bits are counted over some `part` hashes at a time, whatever the texts' lengths."""
    out = np.zeros(len(texts), np.uint64)
    held: list[tuple[int, list[int]]] = []

    def flush() -> None:
        if held:
            sizes = np.array([len(h) for _, h in held])
            counts = _bit_counts(np.array([x for _, h in held for x in h], np.uint64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            out[[i for i, _ in held]] = np.packbits(2 * counts > sizes[:, None], axis=1).view(">u8")[:, 0]
            held.clear()

    n = 0
    for i, text in enumerate(texts):
        hashes = shingle_hashes(text, size)
        if len(hashes) > part:
            all_ = np.array(hashes, np.uint64)
            counts = sum(_bit_counts(all_[j : j + part], np.array([0]))[0] for j in range(0, len(all_), part))
            out[i] = np.packbits(2 * counts > len(all_)).view(">u8")[0]
        elif hashes:
            held.append((i, hashes))
            n += len(hashes)
        if n > part:
            flush()
            n = 0
    flush()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = fingerprints_of(batch.column("text").cast(pa.large_binary()).to_pylist(), shingle)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(fps.view(np.int64))})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def combinations() -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
    """(first segment, its four equal bytes, the other four); bytes are numbered around the ring, two to a segment."""
    out = []
    for i in range(4):
        a, b, c, d = (2 * i, 2 * i + 1), (2 * i + 2, 2 * i + 3), (2 * i + 4, 2 * i + 5), (2 * i + 6, 2 * i + 7)
        chosen = [(*a, *b)] + [(*a, x, y) for x in b for y in c]
        out += [(i, tuple(k % 8 for k in own), tuple(k % 8 for k in (*a, *b, *c, *d) if k not in own)) for own in chosen]
    return out


COMBINATIONS = combinations()


def _byte(fps: np.ndarray, k: int) -> np.ndarray:
    return (fps >> np.uint64(56 - 8 * k)) & np.uint64(255)


def _keys(fps: np.ndarray, own: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k in own:
        out = (out << np.uint64(8)) | _byte(fps, k)
    return out


def chain_fits(diff: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether the chain that starts at segment `first` keeps its budgets 0, 1, 2 and 3."""
    turned = (diff << (np.uint64(16) * first)) | np.where(first > 0, diff >> ((np.uint64(64) - np.uint64(16) * first) % np.uint64(64)), np.uint64(0))
    ok = turned >> np.uint64(48) == 0
    for budget, shift in ((1, 32), (2, 16), (3, 0)):
        ok &= np.bitwise_count(turned >> np.uint64(shift)) <= budget
    return ok


class _Groups:
    """Union-find over entries; keeps the links that joined two groups."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def roots(self, at: np.ndarray) -> np.ndarray:
        up = self.parent[at]
        while True:
            higher = self.parent[up]
            if np.array_equal(higher, up):
                self.parent[at] = up
                return up
            up = higher

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        ra, rb = self.roots(a), self.roots(b)
        apart = np.flatnonzero(ra != rb)
        for k in apart.tolist():
            x, y = int(ra[k]), int(rb[k])
            while self.parent[x] != x:
                x = int(self.parent[x])
            while self.parent[y] != y:
                y = int(self.parent[y])
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.links.append((int(a[k]), int(b[k])))


def _link_sorted(groups: _Groups, entry: np.ndarray, key: np.ndarray, fps: np.ndarray, first: np.ndarray) -> None:
    """Compares the entries that stand together under equal keys (arrays ordered by key)."""
    alive, step = np.arange(len(key)), 1
    while len(alive):
        alive = alive[alive + step < len(key)]
        alive = alive[key[alive] == key[alive + step]]
        diff = fps[alive] ^ fps[alive + step]
        ok = alive[chain_fits(diff, first[alive])]
        if len(ok):
            groups.join(entry[ok], entry[ok + step])
        step += 1


def _link_dense(groups: _Groups, entry: np.ndarray, fps: np.ndarray, other: list[int]) -> None:
    """Entries that share all bits but those of three bytes: each looks up all values within three bits of its own.

    The work grows with the number of entries (2324 lookups each), not with its square.
    """
    low = np.zeros(len(fps), np.int64)
    for k in other:
        low = (low << 8) | _byte(fps, k).astype(np.int64)
    held, first, of = np.unique(low, return_index=True, return_inverse=True)
    groups.join(entry, entry[first][of])
    table = np.full(1 << 24, -1, np.int32)
    table[held] = np.arange(len(held))
    own = entry[first]
    for flipped in (1, 2, 3):
        for places in combinations_of(range(24), flipped):
            near = table[held ^ sum(1 << p for p in places)]
            ok = np.flatnonzero(near > np.arange(len(held)))
            if len(ok):
                groups.join(own[ok], own[near[ok]])


def link_entries(table_no: np.ndarray, fps: np.ndarray, nodes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between the entries of one task: at most one less than nodes, and every linked pair stays connected.

    Nodes are the fingerprints themselves if none are given. With several fingerprints a node, the combinations of each
    are numbered on, and only entries of one combination of one fingerprint meet.
    """
    distinct, node = np.unique(fps if nodes is None else nodes, return_inverse=True)
    groups = _Groups(len(distinct))
    by_table = np.argsort(table_no, kind="stable")
    cuts = np.flatnonzero(np.diff(table_no[by_table])) + 1
    for at in np.split(by_table, cuts):
        if len(at) < 2:
            continue
        first, own, rest = COMBINATIONS[int(table_no[at[0]]) % len(COMBINATIONS)]
        key = _keys(fps[at], own)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        sizes = np.repeat(np.diff(edges), np.diff(edges))
        few, many = sizes <= DENSE, np.flatnonzero(sizes > DENSE)
        starts = np.full(len(at), first, np.uint64)
        _link_sorted(groups, node[at[few]], key[few], fps[at[few]], starts[few])
        for k in rest if len(many) else ():
            finer = (key[many] << np.uint64(8)) | _byte(fps[at[many]], k)
            again = np.argsort(finer, kind="stable")
            own_at, finer = at[many][again], finer[again]
            sizes_now = np.diff(np.flatnonzero(np.concatenate([[True], finer[1:] != finer[:-1], [True]])))
            few = np.repeat(sizes_now, sizes_now) <= DENSE
            _link_sorted(groups, node[own_at[few]], finer[few], fps[own_at[few]], starts[many][few])
            other = [x for x in rest if x != k]
            for part in np.split(own_at[~few], np.cumsum(sizes_now[sizes_now > DENSE])[:-1]):
                if len(part):
                    _link_dense(groups, node[part], fps[part], other)
    return [(int(distinct[a]), int(distinct[b])) for a, b in groups.links]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for t, (_, own, _) in enumerate(COMBINATIONS):
            key = (np.uint64(t) << np.uint64(32)) | _keys(fps, own)
            yield pa.record_batch({"key": pa.array(key.view(np.int64)), "fp": pa.array(fps.view(np.int64))})


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column("key").to_numpy(), b.column("fp").to_numpy()) for b in batches if b.num_rows]
    if got:
        key, fps = (np.concatenate(x) for x in zip(*got, strict=True))
        found = np.array(link_entries(key >> 32, fps.view(np.uint64)), np.uint64).reshape(-1, 2)
        yield pa.record_batch({"a": pa.array(found[:, 0].view(np.int64) if len(found) else [], pa.int64()), "b": pa.array(found[:, 1].view(np.int64) if len(found) else [], pa.int64())})


def link_fingerprints(distinct: DataFrame, partitions: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all within three bits of each other."""
    return distinct.select("fp").mapInArrow(_entries, "key long, fp long").repartition(partitions, "key").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Per document: doc_id, fp (long) and component_id, the least id reachable over links of three bits or fewer."""
    spark = docs.sparkSession
    fps = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    component = connected_components(link_fingerprints(distinct, shuffle_partitions(spark)))
    grouped = checkpointed(distinct.join(component.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("group")))
    least = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    ids = checkpointed(spread_join(grouped, least, "group").select("fp", "component_id"))
    return spread_join(fps, ids, "fp").select("doc_id", "fp", "component_id")


def _salts(n: int) -> np.ndarray:
    return np.array([0x9E3779B97F4A7C15 * (k + 1) % 2**64 for k in range(n)], np.uint64)


def _several(hashes: np.ndarray, salts: np.ndarray, part: int = 4096) -> np.ndarray:
    counts = np.zeros(64 * len(salts), np.int64)
    for j in range(0, len(hashes), part):
        scrambled = mix(hashes[j : j + part, None] ^ salts).astype(">u8").view(np.uint8)
        counts += np.add.reduce(np.unpackbits(scrambled, axis=1), axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > len(hashes)).view(">u8")


def several_fingerprints_of(texts: list[bytes | None], size: int, n: int, part: int = 4096) -> np.ndarray:
    """n independent fingerprints a text, from the shingles' hashes scrambled n ways."""
    salts, out = _salts(n), np.zeros((len(texts), n), np.uint64)
    for i, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text, size), np.uint64)
        if len(hashes):
            out[i] = _several(hashes, salts, part)
    return out


def _wide_entries(fps: np.ndarray, nodes: pa.Array) -> Iterator[pa.RecordBatch]:
    """Entries of every combination of each of several fingerprints (rows: nodes)."""
    for k in range(fps.shape[1]):
        for t, (_, own, _) in enumerate(COMBINATIONS):
            key = (np.uint64(k * len(COMBINATIONS) + t) << np.uint64(32)) | _keys(fps[:, k], own)
            yield pa.record_batch({"key": pa.array(key.view(np.int64)), "fp": pa.array(fps[:, k].copy().view(np.int64)), "node": nodes})


def near_duplicates_wide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, fingerprints: int = 8) -> DataFrame:
    """Per document: doc_id and component_id over links of three bits or fewer in any of several independent fingerprints.

    One fingerprint of 64 bits finds texts that share nearly all shingles. Each further fingerprint is another chance of
    a close one. At a shingle similarity of 0.8 two texts differ in some ten bits, so this alone misses most such pairs;
    `near_copies` doesn't.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = several_fingerprints_of(batch.column("text").cast(pa.large_binary()).to_pylist(), shingle, fingerprints)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fps": pa.array(list(fps.view(np.int64)), pa.list_(pa.int64()))})

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _wide_entries(np.array(batch.column("fps").to_pylist(), np.int64).view(np.uint64), batch.column("node"))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [tuple(b.column(c).to_numpy() for c in ("key", "fp", "node")) for b in batches if b.num_rows]
        if got:
            key, fps, nodes = (np.concatenate(x) for x in zip(*got, strict=True))
            found = np.array(link_entries(key >> 32, fps.view(np.uint64), nodes), np.int64).reshape(-1, 2)
            yield pa.record_batch({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})

    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = checkpointed(rows.mapInArrow(prints, "doc_id long, fps array<long>").withColumn("node", F.xxhash64("fps")))
    nodes = found.groupBy("node").agg(F.first("fps").alias("fps"), F.min("doc_id").alias("least"))
    edges = nodes.select("node", "fps").mapInArrow(entries, "key long, fp long, node long").repartition(n, "key").mapInArrow(links, "a long, b long")
    grouped = nodes.select("node", "least").join(connected_components(edges).withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    grouped = checkpointed(grouped.select("node", "least", F.coalesce("component", "node").alias("group")))
    least = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    told = checkpointed(spread_join(grouped, least, "group").select("node", "component_id"))
    return spread_join(found.select("doc_id", "node"), told, "node").select("doc_id", "component_id")


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**64, BANDS * BAND_ROWS, np.uint64) | np.uint64(1), rng.integers(0, 2**64, BANDS * BAND_ROWS, np.uint64)


def band_keys(hashes: np.ndarray, factors: tuple[np.ndarray, np.ndarray], part: int = 4096) -> np.ndarray:
    """BANDS keys of a set that isn't empty: each of the least values of BAND_ROWS independent orders of its shingles."""
    low = np.full(len(factors[0]), 2**64 - 1, np.uint64)
    for j in range(0, len(hashes), part):
        low = np.minimum(low, (hashes[j : j + part, None] * factors[0] + factors[1]).min(axis=0))
    rows, out = low.reshape(BANDS, BAND_ROWS), np.zeros(BANDS, np.uint64)
    for r in range(BAND_ROWS):
        out = mix(out ^ rows[:, r]) + np.uint64(1)
    return out


def similar_links(sets: list[np.ndarray], least: float, together: list[int] = ()) -> list[tuple[int, int]]:
    """Links (positions) that connect all sets whose similarity is `least` or more, each link of such a pair.

    Pairs that links connect already aren't compared again, nor are those of positions that are known to be together; sets
    of very different sizes can't be similar.
    """
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    sizes = np.array([len(sets[k]) for k in order], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    words, ids = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    groups, held = _Groups(len(order)), np.zeros(len(words), bool)
    if len(together) > 1:
        place = np.argsort(np.array(order))[np.array(together)]
        groups.parent[place] = place.min()
    for k in range(len(order)):
        # larger sets up to the size that the similarity allows
        end = int(np.searchsorted(sizes, sizes[k] / least + 1e-9, side="right"))
        others = np.arange(k + 1, end)
        if len(others):
            others = others[groups.roots(others) != groups.roots(np.array([k]))]
        if not len(others):
            continue
        own = ids[starts[k] : starts[k + 1]]
        held[own] = True
        if len(others) == end - k - 1:
            common = np.add.reduceat(held[ids[starts[k + 1] : starts[end]]], starts[k + 1 : end] - starts[k + 1], dtype=np.int64)
        else:
            common = np.array([np.count_nonzero(held[ids[starts[x] : starts[x + 1]]]) for x in others.tolist()])
        held[own] = False
        near = others[common >= least * (sizes[k] + sizes[others] - common) - 1e-9]
        groups.join(np.full(len(near), k), near)
    return [(order[a], order[b]) for a, b in groups.links]


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, fingerprints: int = 8, similarity: float = 0.8) -> DataFrame:
    """Per document: doc_id, text_hash (long), component_id and component_hash: the least id, and its least text_hash,
    reachable over pairs of texts whose sets of shingles have a Jaccard similarity of `similarity` or more.

    Candidates come from the close fingerprints of `near_duplicates_wide` and from keys of least hashes: two sets of
    similarity s share one of the 24 keys but for a chance of (1 - s^4)^24, 3 in a million at 0.8. Candidates only make
    blocks; the sets of a block meet and all their pairs are compared, so a link is always a true one. In a large block
    each set is first compared with the block's first one. Those close to it are in one group already and needn't meet each
    other; the others meet all sets of the block, dealt into tiles and parts that meet in tasks of their own, so that none
    is left out or lands in one task.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts, factors = _salts(fingerprints), _factors()
        for batch in batches:
            fps, bands, nodes = [], [], []
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                hashes = np.array(shingle_hashes(text, shingle), np.uint64)
                own = np.unique(hashes)
                nodes.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                fps.append(_several(hashes, salts).astype(np.uint64).view(np.int64) if len(own) else np.empty(0, np.int64))
                bands.append(band_keys(own, factors).view(np.int64) if len(own) else np.empty(0, np.int64))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "node": pa.array(np.array(nodes, np.uint64).view(np.int64)),
                "fps": pa.array(fps, pa.list_(pa.int64())), "bands": pa.array(bands, pa.list_(pa.int64()))})

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if fingerprints:
                yield from _wide_entries(np.array(batch.column("fps").to_pylist(), np.int64).view(np.uint64), batch.column("node"))
            keys = np.array(batch.column("bands").to_pylist(), np.int64).view(np.uint64)
            for k in range(BANDS):
                key = (np.uint64((fingerprints + k) * len(COMBINATIONS)) << np.uint64(32)) | (keys[:, k] >> np.uint64(32))
                yield pa.record_batch({"key": pa.array(key.view(np.int64)), "fp": pa.array(keys[:, k].copy().view(np.int64)), "node": batch.column("node")})

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [tuple(b.column(c).to_numpy() for c in ("key", "fp", "node")) for b in batches if b.num_rows]
        if got:
            key, fps, nodes = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((fps, key))
            key, fps, nodes = key[order], fps[order], nodes[order]
            # equal ones are linked in a row; only one of them meets the close ones
            equal = np.concatenate([[False], (key[1:] == key[:-1]) & (fps[1:] == fps[:-1])])
            at = np.flatnonzero(equal)
            alone = ~equal & (key >> 32 < fingerprints * len(COMBINATIONS))
            found = np.array(link_entries(key[alone] >> 32, fps[alone].view(np.uint64), nodes[alone]), np.int64).reshape(-1, 2)
            yield pa.record_batch({"a": pa.array(np.concatenate([nodes[at - 1], found[:, 0]]), pa.int64()), "b": pa.array(np.concatenate([nodes[at], found[:, 1]]), pa.int64())})

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(t, shingle).tobytes() for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.record_batch({"node": batch.column("node"), "block": batch.column("block"), "n": batch.column("n"), "held": pa.array(made, pa.large_binary())})

    def near_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, first = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("held", "first_held"))
            close = [bool(similar_links([a, b], similarity)) for a, b in zip(first, held, strict=True)]
            yield pa.record_batch({"node": batch.column("node"), "block": batch.column("block"), "first": batch.column("first"), "close": pa.array(close, pa.bool_())})

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int], list[tuple[int, np.ndarray, bool]]] = {}
        for b in batches:
            for block, pair, node, held, close in zip(*(b.column(c).to_pylist() for c in ("block", "pair", "node", "held", "close")), strict=True):
                met.setdefault((block, pair), []).append((node, np.frombuffer(held, np.uint64), close))
        for own in met.values():
            found = similar_links([x for _, x, _ in own], similarity, [k for k, (_, _, close) in enumerate(own) if close])
            yield pa.record_batch({"a": pa.array([own[a][0] for a, _ in found], pa.int64()), "b": pa.array([own[b][0] for _, b in found], pa.int64())})

    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    found = checkpointed(rows.mapInArrow(prints, "doc_id long, text_hash long, node long, fps array<long>, bands array<long>"))
    nodes = found.groupBy("node").agg(F.first("fps").alias("fps"), F.first("bands").alias("bands")).where(F.size("bands") > 0)
    edges = nodes.mapInArrow(entries, "key long, fp long, node long").repartition(n, "key").mapInArrow(links, "a long, b long")
    blocks = checkpointed(connected_components(edges).withColumnRenamed("component", "block"))
    sized = spread_join(blocks, blocks.groupBy("block").agg(F.count("*").alias("n")), "block").select("node", "block", "n")
    # one row a node brings the text whose set is compared
    one = found.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).join(sized, "node")
    one = one.select("node", "block", "n", F.col("r.doc_id").alias("_id"), F.col("r.text_hash").alias("_hash"))
    texts = rows.join(one, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("node", "block", "n", "text")
    held = written(texts.mapInArrow(sets, "node long, block long, n long, held binary"), "shingle-sets")
    # a large block's nodes are compared with its first one; those close to it are linked through it
    large = held.where(F.col("n") > TILE)
    firsts = large.groupBy("block").agg(F.min("node").alias("first"))
    firsts = firsts.join(large.select(F.col("node").alias("_n"), F.col("held").alias("first_held")), F.col("first") == F.col("_n")).drop("_n")
    told = written(spread_join(large.select("node", "block", "held"), firsts, "block", 100).mapInArrow(near_first, "node long, block long, first long, close boolean"), "close-to-first")
    apart = told.groupBy("block").agg(F.count(F.when(~F.col("close"), 1)).alias("apart"), F.count("*").alias("all")).where("apart > 0")
    # what isn't close meets all of its block: each other by tiles, the close ones by parts
    spread = spread_join(told.select("node", "block", "close"), apart, "block", 100).withColumnRenamed("node", "_n")
    tiles = F.least(F.lit(MOST_TILES), F.ceil(F.col("apart") / TILE)).cast("int")
    parts = F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("apart")) / TILE)).cast("int")
    spread = spread.select("_n", "close", tiles.alias("tiles"), parts.alias("parts"))
    tile, part = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    among = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.least(tile, u) * MOST_TILES + F.greatest(tile, u))
    with_parts = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda k: k * MOST_TILES * MOST_TILES + tile)
    with_tiles = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: (part + 1) * MOST_TILES * MOST_TILES + u)
    pairs = F.when(F.col("close"), with_tiles).otherwise(F.concat(among, with_parts))
    met = large.join(spread, F.col("node") == F.col("_n")).select("node", "block", "held", "close", F.explode(pairs).alias("pair"))
    met = met.unionByName(held.where(F.col("n") <= TILE).select("node", "block", "held", F.lit(False).alias("close"), F.lit(-1).alias("pair")))
    true = met.repartition(n, "block", "pair").mapInArrow(verified, "a long, b long")
    true = true.unionByName(told.where("close AND node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")))
    component = connected_components(true).withColumnRenamed("node", "_n")
    identity = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    grouped = found.groupBy("node").agg(F.min(identity).alias("least")).join(component, F.col("node") == F.col("_n"), "left")
    grouped = checkpointed(grouped.select("node", "least", F.coalesce("component", "node").alias("group")))
    least = grouped.groupBy("group").agg(F.min("least").alias("of"))
    told = checkpointed(spread_join(grouped, least, "group").select("node", F.col("of.doc_id").alias("component_id"), F.col("of.text_hash").alias("component_hash")))
    return spread_join(found.select("doc_id", "text_hash", "node"), told, "node").select("doc_id", "text_hash", "component_id", "component_hash")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, fingerprints: int = 8) -> DataFrame:
    """The documents, with all their columns, without those that have a smaller id in their group of `near_copies`.

    A row is told by its id and its text: rows that share an id are each judged on their own text, and of equal ones one
    stays. Rows without an id can't be told apart and stay.
    """
    found = checkpointed(near_copies(docs, id_col, text_col, shingle, fingerprints).where("doc_id IS NOT NULL"))
    mark = free_name(docs, "_gone")
    own, text = f"{mark}_text", F.xxhash64(F.col(text_col).cast("string"))
    gone = found.where("doc_id <> component_id OR text_hash <> component_hash").select(F.col("doc_id").alias(mark), F.col("text_hash").alias(f"{mark}_hash")).distinct()
    keyed = docs.withColumn(own, text)
    kept = keyed.join(gone, (keyed[id_col].cast("long") == gone[mark]) & (keyed[own] == gone[f"{mark}_hash"]), "left_anti")
    repeated = found.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    if not repeated:
        return kept.drop(own)
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, own]).unionByName(kept.where(F.col(id_col).isNull())).drop(own)
