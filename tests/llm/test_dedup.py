import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexmill.llm.common import spread_join
from lexmill.llm.components import connected_components
from lexmill.llm.dealing import Routes, bundle, slices, unbundled
from lexmill.llm.line_dedup import LineIndex, PerfectHash, dedup_lines
from lexmill.llm.simhash import COMBINATIONS, _keys, chain_fits, drop_near_duplicates, link_entries, near_copies, near_duplicates, near_duplicates_wide, several_fingerprints_of, similar_links
from lexmill.llm.substring_dedup import dedup_substrings
from lexmill.llm.word_hashes import hash_words
from tests.llm.conftest import ODD, PASSAGE


def brute_substrings(rows, window):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode())):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def random_texts(seed, n):
    rng = random.Random(seed)
    words = "a b c d".split()
    return [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(n)]


@pytest.mark.parametrize("rows,window,block", [(ODD, 20, 10), (random_texts(1, 40), 5, 3), (random_texts(2, 40), 7, 4)])
def test_substrings(make, rows, window, block):
    got = dedup_substrings(make(rows), window=window, block=block).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=key) == sorted(brute_substrings(rows, window), key=key)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got)


def test_substrings_of_nothing(make):
    assert dedup_substrings(make([])).collect() == []
    with pytest.raises(ValueError):
        dedup_substrings(make([]), window=10, block=10)


def brute_lines(rows, low, docs):
    held = {}
    key = lambda x: x.encode().strip().lower()
    top = lambda i: 2**63 - 1 if i is None else i
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x).decode()) >= low:
                held.setdefault(key(x), set()).add(top(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(held.get(key(x), ())) < docs or max(held[key(x)]) == top(i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def test_lines(make):
    line = "  A line that Many documents share "
    rows = [*ODD, *((k, f"own {k}\n{line}\n{line.upper()}\nlast") for k in range(20, 26)), (30, f"é{'x' * 18}"), (31, f"é{'x' * 18}"), (32, f"é{'x' * 18}")]
    got = dedup_lines(make(rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=key) == sorted(brute_lines(rows, 20, 3), key=key)
    assert dedup_lines(make([])).collect() == []


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(1, 2**63, 5000).astype(np.uint64))
    assert sorted(PerfectHash(keys).slots(keys)) == list(range(len(keys)))
    index = LineIndex(keys, np.arange(len(keys)), np.arange(len(keys)))
    held, last = index.probe(keys)
    assert (held == np.minimum(np.arange(len(keys)), 255)).all() and (last == np.arange(len(keys))).all()


def brute_simhash(rows, size=3):
    prints = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = [min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in group]
    return [(i, p - 2**64 if p >= 2**63 else p, c) for (i, _), p, c in zip(rows, prints, least, strict=True)]


def test_simhash(make):
    rows = [*ODD, (10, None), (11, PASSAGE + " more"), (12, PASSAGE.upper()), *((40 + k, " ".join(WORDS_OF(k))) for k in range(30))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, near_duplicates(make(rows)).collect()), key=key) == sorted(brute_simhash(rows), key=key)
    assert near_duplicates(make([])).collect() == []


def test_several_fingerprints(make):
    rows = [*ODD[:6], ODD[7], *((40 + k, " ".join(WORDS_OF(k))) for k in range(30))]
    fps = several_fingerprints_of([None if t is None else t.encode() for _, t in rows], 5, 4)
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (np.bitwise_count(fps[a] ^ fps[b]) <= 3).any() and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    expected = {i: min(rows[k][0] for k in range(len(rows)) if group[k] == group[n]) for n, (i, _) in enumerate(rows)}
    assert {r.doc_id: r.component_id for r in near_duplicates_wide(make(rows), fingerprints=4).collect()} == expected
    assert len(set(expected.values())) < len(rows) and near_duplicates_wide(make([])).collect() == []


def WORDS_OF(k):
    rng = random.Random(k // 3)
    base = [rng.choice("qwertyuiop") + str(rng.randint(0, 50)) for _ in range(80)]
    base[k % 3] = "changed"
    return base


def test_every_close_pair_meets():
    rng = random.Random(5)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << k
        fps = np.array([a, b], np.uint64)
        met = [t for t, (first, own, _) in enumerate(COMBINATIONS) if _keys(fps, own)[0] == _keys(fps, own)[1] and chain_fits(fps[:1] ^ fps[1:], np.array([first], np.uint64))[0]]
        assert met


def test_dense_group_keeps_its_links():
    rng = np.random.default_rng(1)
    base = np.uint64(0x1234567812345678)
    fps = np.unique(np.concatenate([[base], base ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))]))
    table = np.repeat(np.arange(len(COMBINATIONS)), len(fps))
    links = link_entries(table, np.tile(fps, len(COMBINATIONS)))
    assert len(links) <= len(fps) - 1
    root = {int(f): int(f) for f in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert (a ^ b).bit_count() <= 3
        root[top(a)] = top(b)
    assert len({top(int(f)) for f in fps}) == 1


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 50)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 101: 100, 102: 100}


def test_drop_near_duplicates(make):
    kept = drop_near_duplicates(make([(1, PASSAGE), (2, PASSAGE), (3, "other words here entirely"), (3, "other words here entirely"), (None, PASSAGE)]).withColumn("_gone", F.lit(1)))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3] and "_gone" in kept.columns


def _similar(a, b, size=5):
    x, y = ({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set() for w in ((t or "").encode().lower().split() for t in (a, b)))
    return x == y or bool(x and y) and len(x & y) >= 0.8 * len(x | y)


def _closure(rows):
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and _similar(rows[a][1], rows[b][1]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return [min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in group]


def _near_texts():
    """Texts whose copies have one to six words changed: similarities from 0.6 to 1."""
    rng, rows = random.Random(11), []
    for base in range(12):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
        for copy in range(5):
            own = list(words)
            for k in rng.sample(range(120), copy if base % 2 else copy + 2):
                own[k] = f"c{rng.randint(0, 10**6)}"
            rows.append((100 * base + copy, " ".join(own)))
    return rows


@pytest.mark.parametrize("tile", [512, 2])
def test_near_copies_are_all_pairs_of_similar_texts(make, monkeypatch, tile):
    from lexmill.llm import simhash

    monkeypatch.setattr(simhash, "TILE", tile)
    rows = [*ODD, *_near_texts()]
    got = sorted(((r.doc_id, r.component_id) for r in near_copies(make(rows)).collect()), key=str)
    assert got == sorted(((i, c) for (i, _), c in zip(rows, _closure(rows), strict=True)), key=str)
    assert near_copies(make([])).collect() == []
    unique = _near_texts()
    kept = {r.doc_id for r in drop_near_duplicates(make(unique)).collect()}
    assert kept == set(_closure(unique))


def test_similar_links():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**60, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < p], rng.integers(0, 2**60, k).astype(np.uint64)])) for p in (1.0, 0.95, 0.9, 0.8, 0.5) for k in (1, 10, 30)]
    share = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    links = similar_links(sets, 0.8)
    assert links and all(share(sets[a], sets[b]) >= 0.8 for a, b in links)
    root = list(range(len(sets)))
    for a, b in links:
        root = [root[a] if r == root[b] else r for r in root]
    assert all(root[a] == root[b] for a in range(len(sets)) for b in range(a) if share(sets[a], sets[b]) >= 0.8)


def test_rows_of_a_repeated_id_are_judged_by_their_own_text(make):
    other = " ".join(WORDS_OF(3))
    rows = [(1, PASSAGE), (3, PASSAGE), (3, "other words here entirely"), (3, "other words here entirely"), (3, other), (None, "alone")]
    kept = drop_near_duplicates(make(rows).withColumn("_gone", F.lit(1)))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, PASSAGE), (3, "other words here entirely"), (3, other), (None, "alone")], key=str)
    assert kept.columns == [*make(rows).columns, "_gone"]


def test_windows_longer_than_two_blocks_compare_all_words(make):
    head, tail = [f"h{k}" for k in range(10)], [f"t{k}" for k in range(10)]
    rows = [(k, " ".join([*head, *(f"m{k}_{j}" for j in range(10)), *tail])) for k in range(2)] + [(5, " ".join(f"r{j}" for j in range(40)))] + [(6, "x " + " ".join(f"r{j}" for j in range(40)))]
    got = dedup_substrings(make(rows), window=30, block=10).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == sorted(brute_substrings(rows, 30))


def test_lines_probe_published_arrays_in_blocks(make):
    rng = random.Random(8)
    shared = [f"a shared line of the corpus, number {k}" for k in range(60)]
    rows = [(k % 90 if k % 13 else None, "\n".join(rng.choice(shared).upper() if rng.random() < 0.3 else rng.choice([*shared, "", "short", f"only here {k}" * 3]) for _ in range(rng.randint(0, 9)))) for k in range(120)] + ODD
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    for low in (1, 3, 300):
        expected = sorted(brute_lines(rows, 20, low), key=key)
        for more in ({}, {"shard_lines": 7, "block_bytes": 3000}):
            got = dedup_lines(make(rows), min_docs=low, **more).collect()
            assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=key) == expected
    with pytest.raises(ValueError):
        dedup_lines(make(rows), min_docs=0)


def test_index_refuses_what_it_does_not_hold():
    rng = np.random.default_rng(4)
    keys, checks, other = (rng.integers(1, 2**64, 20_000, np.uint64) for _ in range(3))
    index = LineIndex.from_bytes(LineIndex(keys, np.arange(20_000), np.arange(20_000), checks, np.uint16).to_bytes())
    assert (index.probe(keys, checks)[0] == np.minimum(np.arange(20_000), 65535)).all()
    assert not index.probe(keys, other)[0].any() and not index.probe(other, checks)[0].any() and not index.probe(other, other)[0].any()


def test_repeats_in_copies_runs_and_edges_by_relays(make):
    rng, passage = random.Random(6), [f"p{k}" for k in range(75)]
    own = lambda n: [f"w{rng.randint(0, 9)}" for _ in range(n)]
    texts = [" ".join([*own(rng.randint(0, 25)), *passage[rng.randint(0, 20) : rng.randint(40, 75)], *own(rng.randint(0, 25))]) for _ in range(40)]
    texts += [texts[k % 7] for k in range(20)] + [" ".join(own(300)), "  ".join(passage * 3), "z" * 200, " ".join(["same"] * 90), "文" * 70 + " " + "文" * 70]
    rows = [(k * 7 % 101, t) for k, t in enumerate(texts)] + ODD
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    expected = sorted(brute_substrings(rows, 20), key=key)
    for more in ({}, {"buckets": 11, "direct": 3}):
        got = dedup_substrings(make(rows), **more).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=key) == expected


def test_word_hashes_depend_on_the_word_alone():
    texts = [b"one two  one\tthree", b"", b" \n", b"one " + b"x" * 70 + b" " + b"x" * 71, ("é 文字 " * 3).encode(), b"two"]
    hashes, lengths = hash_words(texts)
    words = [w for t in texts for w in t.split()]
    assert lengths.tolist() == [len(t.split()) for t in texts] and len(hashes) == len(words)
    by = dict(zip(words, hashes.tolist(), strict=True))
    assert all(by[w] == h for w, h in zip(words, hashes.tolist(), strict=True)) and len(set(by.values())) == len(by)
    assert hash_words([])[0].tolist() == [] and hash_words([b"x" * (1 << 22), b"one"])[0][1] == by[b"one"]


def test_relays_carry_what_is_sent():
    routes, messages = Routes(50, 10), [(k, bytes([k]) * k) for k in range(0, 50, 3)]
    assert routes.fan == 8 and routes.received(routes.sent(5, messages)) == messages and unbundled(bundle(messages)) == messages
    assert Routes(50, 50).fan == 1 and slices(np.array([0, 5, 2**48 - 1], np.uint64), 4, 48) == [(0, 0, 2), (3, 2, 3)]


def test_very_dense_groups_keep_their_links(monkeypatch):
    from lexmill.llm import simhash

    rng = np.random.default_rng(9)
    fps = np.unique(np.uint64(0x0F1E2D3C00000000) | rng.integers(0, 2**14, 1500).astype(np.uint64) | (rng.integers(0, 2, 1500).astype(np.uint64) << np.uint64(30)))
    nodes = np.arange(len(fps) + 2).astype(np.int64)
    fps = np.concatenate([fps, fps[:2]])
    table = np.repeat(np.arange(len(COMBINATIONS)), len(fps))

    def parts(links):
        root = {int(n): int(n) for n in nodes}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            assert (int(fps[a]) ^ int(fps[b])).bit_count() <= 3
            root[top(a)] = top(b)
        return sorted(min(m for m in root if top(m) == t) for t in {top(n) for n in root})

    plain = parts(link_entries(table, np.tile(fps, len(COMBINATIONS)), np.tile(nodes, len(COMBINATIONS))))
    monkeypatch.setattr(simhash, "DENSE", 20)
    assert parts(link_entries(table, np.tile(fps, len(COMBINATIONS)), np.tile(nodes, len(COMBINATIONS)))) == plain


def test_spread_join(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id")).alias("k"), "id")
    told = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = spread_join(rows, told, "k", 10)
    assert got.columns == ["k", "id", "n"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(told, "k").collect()))


def test_similar_links_of_sets_that_are_together():
    rng = np.random.default_rng(7)
    sets = [np.unique(np.concatenate([np.arange(100, dtype=np.uint64)[: 100 - k], rng.integers(1000, 2**60, k).astype(np.uint64)])) for k in (0, 5, 9, 30, 2, 60)]
    plain = similar_links(sets, 0.8)
    joined = similar_links(sets, 0.8, [0, 1, 4])
    group = lambda links, start: {frozenset(g) for g in _united(start + [set(x) for x in links] + [{k} for k in range(6)])}
    assert group(joined, [{0, 1, 4}]) == group(plain, []) and not any({a, b} <= {0, 1, 4} for a, b in joined)


def _united(parts):
    out = []
    for p in parts:
        meets = [o for o in out if o & p]
        out = [o for o in out if not o & p] + [set().union(p, *meets)]
    return out
