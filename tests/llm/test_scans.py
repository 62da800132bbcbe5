import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm.boosting import BoostedTrees, threshold_for
from lexmill.llm.decontaminate import contamination, decontaminate
from lexmill.llm.license_scan import NOTICES, PHRASES, scan_licenses
from lexmill.llm.pii import Taken, base_spans, candidates, examples, features, find_personal_data, fitted, luhn, redacted
from tests.llm.conftest import ODD, PASSAGE

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def test_licenses(make):
    rows = [(1, None), (2, ""), (3, "The MIT License, GNU General Public license; gnu GENERAL public"), (4, "cc by cc by-nc Apache-License"), (5, "x. " + NOTICES["bsd"] + " y " * 3000), (6, "Permission is hereby granted free of CHARGE, to ANY other person obtaining a copy of this software and associated documentation files"), (None, "mit license"), (8, "of the in the of the")]
    got = {r.doc_id: r for r in scan_licenses(make(rows)).collect()}
    for i, t in rows:
        w, at, labels = words(t), [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            here = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), sorted(labels))
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    assert got[5].labels == ["bsd"] and "mit" in got[6].labels and got[8].labels == [] and got[1].score == 0
    assert scan_licenses(make([])).collect() == []


def brute_hits(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            b = words(text)
            for s in range(max(1, len(b) - 9) if b else 0):
                x = b[s : s + 10]
                for p in range(len(w) - len(x) + 1):
                    if w[p : p + len(x)] == x:
                        hit |= set(range(p, p + len(x)))
                        found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def test_contamination(spark, make):
    items = [(1, PASSAGE), (2, "short one"), (3, None), (4, ""), (5, "É 文字"), (6, "tiny"), (7, " ".join(PASSAGE.split()[5:17])), (10, "solo")]
    docs = [(1, None), (2, ""), (3, "a short ONE here short one"), (4, f"x {' '.join(PASSAGE.split()[3:20])} y tiny"), (5, PASSAGE + " " + PASSAGE), (6, "É 文字 solo"), (None, "tiny"), (8, "clean " * 2000), (9, " ".join(PASSAGE.split()[:9]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted(brute_hits(docs, items), key=str)
    for limit in (2_000_000, 0):
        got = contamination(make(docs), bench, broadcast_windows=limit).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == expected
    clean = decontaminate(make(docs), bench).collect()
    assert sorted(str(r.doc_id) for r in clean) == sorted(str(i) for i, _, n, _ in expected if not n)
    assert contamination(make([]), bench).collect() == [] and all(r.n_hit == 0 for r in contamination(make(docs), bench.limit(0)).collect())


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)] + [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern, low, high in (("card", CARD, 13, 19), ("phone", PHONE, 9, 15)):
        for m in pattern.finditer(t):
            d = re.sub("[^0-9]", "", m.group())
            if low <= len(d) <= high and (kind == "phone" or luhn(d)):
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_the_patterns():
    rng = random.Random(4)
    for _ in range(20000):
        t = "".join(rng.choice("a1@.-+ (9") for _ in range(rng.randint(0, 40)))
        assert base_spans(t) == plain_spans(t), t


def test_long_texts_are_linear():
    for t in ("a" * 100_000 + "@" + "1" * 100_000, " ".join("1" * 50_000) + "+1" * 20_000 + ".1" * 5_000 + "@" * 5_000):
        base_spans(t), candidates(t)


def test_trees_on_held_out_examples():
    model, made = fitted(), examples(1200, 99)
    scores = model.trees.predict(np.array([features(t, k, i, j) for t, k, i, j, _ in made]))
    right = [(s >= model.thresholds[r[1]]) == bool(r[-1]) for s, r in zip(scores, made, strict=True)]
    told = [r[-1] for s, r in zip(scores, made, strict=True) if s >= model.thresholds[r[1]]]
    assert np.mean(told) >= 0.93 and np.mean(right) >= 0.85


def test_boosting_learns_an_interaction():
    x = np.random.default_rng(0).random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    p = BoostedTrees().fit(x[:400], y[:400]).predict(x[400:])
    assert ((p > 0.5) == y[400:]).mean() > 0.95 and threshold_for(p, y[400:], 0.9) < 1


def test_personal_data(make):
    rows = [*ODD, (20, "mail joe@example.com or +1 (017) 555-7713, 10.0.0.1, 4111 1111 1111 1111"), (21, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'), (22, "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 order 1234567890123")]
    got = find_personal_data(make(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [s.kind for s in by[20].spans if s.base] == ["email", "ip", "card", "phone"] and [s.kind for s in by[21].spans] == ["secret"] and by[22].spans == []
    assert by[20].redacted == "mail [EMAIL] or [PHONE], [IP], [CARD]" and redacted("abc", []) == "abc"
    assert find_personal_data(make([])).collect() == []
    assert by[8].spans[0].start == ODD[8][1].index("a.b@")


def test_account_numbers_of_any_length_and_grouping():
    for own in ("DE89370400440532013000", "FR1420041010050500013M02606", "GB29NWBK60161331926819", "DE89 3704 0044 0532 0130 00", "FR14 2004 1010 0505 0001 3M02 606", "NO9386011117947", "ES91 2100 0418 4502 0005 1332"):
        for text in (f"my iban {own} thanks", f"IBAN: {own}.", f"konto {own} BANK AG"):
            start = text.index(own)
            assert ("id", start, start + len(own)) in candidates(text), text
            assert ("id", start, start + len(own)) in [s[:3] for s in fitted().spans(text)], text


def test_national_phone_numbers():
    for own in ("06 12 34 56 78", "030 12345678", "0171 1234567", "612 345 678", "0171/1234567", "(030) 12345678", "0612345678"):
        text = f"phone {own} please"
        assert ("phone", 6, 6 + len(own)) in candidates(text) and redacted(text, fitted().spans(text)) == "phone [PHONE] please", text
    for text in ("it was on 2024-11-26 then", "order 06 12 34 56 78 came", "price 12 345 678 99 then"):
        assert not fitted().spans(text), text


def test_clean_rows_of_a_null_or_repeated_id_stay(spark, make):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    rows = [(None, f"x {PASSAGE}"), (None, "clean"), (4, PASSAGE), (4, "clean too"), (4, None), (5, "clean")]
    kept = decontaminate(make(rows), bench)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, "clean"), (4, "clean too"), (4, None), (5, "clean")], key=str)
    assert kept.columns == make(rows).columns


def test_whole_license_texts_and_rows_of_one_id(make):
    from lexmill.llm.license_texts import TEXTS

    assert min(len(words(t)) for t in TEXTS.values()) > 63
    rows = [(k, f"start {t} {'end of file ' * 40}") for k, t in enumerate(TEXTS.values())]
    cut = TEXTS["zlib"].split()
    rows += [(50, " ".join(cut[:40] + ["two", "words"] + cut[40:])), (51, " ".join(cut[: len(cut) // 3])), (60, "gnu general x x"), (60, "x general public license"), (61, "mit license"), (61, "mit license")]
    got = scan_licenses(make(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k, label in enumerate(TEXTS):
        assert label in by[k].labels and by[k].score == 1 and any(s.label == label and s.start == 1 for s in by[k].spans), label
    assert by[50].labels == ["zlib"] and by[50].score > 0.9 and by[51].labels == []
    assert all(r.n_base == 0 and r.base_labels == [] for r in got if r.doc_id == 60)
    assert [(r.n_base, r.first_word) for r in got if r.doc_id == 61] == [(1, 0), (1, 0)]
    with pytest.raises(ValueError, match="fewer"):
        scan_licenses(make([]), notices={"x": "one two"})


def test_rows_of_one_id_are_judged_apart(spark, make):
    bench = spark.createDataFrame([(1, PASSAGE), (2, "two words")], "item_id long, text string")
    docs = [(1, " ".join(PASSAGE.split()[:10])), (1, " ".join(["x", *PASSAGE.split()[:10]])), (1, "clean"), (2, "two words"), (2, "two words"), (None, PASSAGE), (None, None)]
    for limit in (1000, 0):
        got = contamination(make(docs), bench, broadcast_windows=limit).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == sorted(brute_hits(docs, [(1, PASSAGE), (2, "two words")]), key=str)


def test_benchmark_without_broadcast_on_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one, two = (sorted(map(tuple, contamination(docs, bench, broadcast_windows=n).select("doc_id", "n_words", "n_hit", F.array_join("items", ",")).collect())) for n in (1_000_000, 0))
    assert one == two and any(r[2] for r in one)


def test_recall_on_the_tables_documents(spark):
    """Secrets and decoys of the tables, told by patterns of their own: the trees have never seen these rows."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").where("text IS NOT NULL").collect()]
    wanted = hit = decoys = false = 0
    for text, spans in zip(texts, fitted().spans_of(texts), strict=True):
        covered = {(i, j) for _, i, j, _, _ in spans}
        secrets = [m.span(1) for m in re.finditer(r"(?i)token = \"([0-9a-f]{40})\"", text)]
        wanted, hit = wanted + len(secrets), hit + sum(s in covered for s in secrets)
        plain = [m.span() for m in re.finditer(r"(?<![0-9])(?<![0-9] )[0-9]{16}(?! ?[0-9])", text) if not luhn(m.group())]
        decoys, false = decoys + len(plain), false + sum(s in covered for s in plain)
    assert wanted > 100 and hit >= 0.95 * wanted and decoys > 100 and false <= 0.05 * decoys


def test_spans_of_many_candidates():
    text = "phone " + ", ".join(f"{k:03d}-555-{k % 9999:04d}" for k in range(100, 999)) * 8
    start = time.time()
    got = fitted().spans(text)
    assert time.time() - start < 20 and all(a[2] <= b[1] for a, b in zip(got, got[1:])) and fitted().spans_of([text[:200], ""]) == [fitted().spans(text[:200]), []]
    taken = Taken([("x", 5, 9), ("y", 7, 12), ("z", 20, 22)])
    plain = lambda i, j: any(a < j and i < b for a, b in ((5, 12), (20, 22)))
    assert all(taken.meets(i, j) == plain(i, j) for i in range(25) for j in range(i + 1, 26))
