"""Ball hashing against all pairs of fingerprints, and groups of copies."""

import math
import random
import re

import numpy as np
import pyarrow as pa
from conftest_llm import rows

from gridcast.llm import neardup
from gridcast.llm.textarrays import Words


def words(rnd, n):
    return [f"{rnd.choice('bcdfgklmnprst')}{rnd.choice('aeiou')}{rnd.randrange(400)}" for _ in range(n)]


def features(text):
    w = re.findall(r"[^\x00-/:-`{-\x7f]+", text.lower())
    return set(w) | set(zip(w, w[1:]))


def brute_groups(texts):
    """Components of all pairs within the accepted angle, from the sets themselves; None where a pair is too near to its bounds to tell."""
    sets = [features(t) for t in texts]
    sure, maybe = list(range(len(texts))), list(range(len(texts)))

    def root(parent, x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            cosine = len(sets[a] & sets[b]) / math.sqrt(len(sets[a]) * len(sets[b]))
            angle = math.acos(min(1.0, cosine)) / math.pi * neardup.POOL
            for parent, bound in ((sure, neardup.MAX_DISTANCE - 25), (maybe, neardup.MAX_DISTANCE + 45)):
                if angle <= bound:
                    x, y = root(parent, a), root(parent, b)
                    parent[max(x, y)] = min(x, y)
    sure, maybe = [root(sure, k) for k in range(len(texts))], [root(maybe, k) for k in range(len(texts))]
    return sure, maybe


def test_same_groups_as_all_pairs(spark, make):
    rnd = random.Random(5)
    texts = []
    for _ in range(40):
        base = words(rnd, rnd.randint(20, 200))
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 12))):
                copy[rnd.randrange(len(copy))] = words(rnd, 1)[0]
            texts.append(" ".join(copy))
    rnd.shuffle(texts)
    got = {r.doc_id: r.kept_doc_id for r in neardup.near_duplicates(make(texts)).collect()}
    sure, maybe = brute_groups(texts)
    label = [got.get(k, k) for k in range(len(texts))]
    for a in range(len(texts)):
        for b in range(a):
            assert sure[a] != sure[b] or label[a] == label[b]
            assert label[a] != label[b] or maybe[a] == maybe[b]
    assert len(got) > 20


def test_one_of_each_group_stays(spark, make):
    rnd = random.Random(15)
    texts = []
    for _ in range(30):
        base = words(rnd, rnd.randint(60, 200))
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 3)):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = words(rnd, 1)[0]
            texts.append(" ".join(copy))
    rnd.shuffle(texts)
    sure, maybe = brute_groups(texts)
    assert sure == maybe
    assert sorted(r.doc_id for r in neardup.drop_near_duplicates(make(texts)).collect()) == sorted(set(sure))


def test_edited_copies_are_found_and_others_left_alone(spark, make):
    rnd = random.Random(6)
    texts, pairs = [], []
    for _ in range(60):
        base = words(rnd, 150)
        copy = list(base)
        for _ in range(4):
            copy[rnd.randrange(150)] = words(rnd, 1)[0]
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(base), " ".join(copy).upper() + "!"]
    got = {(r.kept_doc_id, r.doc_id) for r in neardup.near_duplicates(make(texts)).collect()}
    assert got <= set(pairs) and len(got) >= 0.95 * len(pairs)


def test_edge_cases(spark, make):
    rnd = random.Random(7)
    a, b = " ".join(words(rnd, 50)), " ".join(words(rnd, 50))
    long = " ".join(words(rnd, 50_000))
    texts = [(5, a), (3, a), (3, a), (None, a), (4, None), (6, ""), (7, ""), (8, "?!"), (9, "?!"), (10, "!!!"), (1, b), (1, a), (11, long), (12, long + " end")]
    docs = make(texts)
    got = neardup.near_duplicates(docs)
    assert rows(got, "doc_id", "kept_doc_id", "exact") == [(12, 11, False), (3, 1, True), (5, 1, True), (9, 8, True)]
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = [(1, a), (1, b), (10, "!!!"), (11, long), (4, None), (6, ""), (7, ""), (8, "?!"), (None, a)]
    assert rows(kept, "doc_id", "text") == sorted(want, key=repr)


def test_rows_repeated_outside_groups(spark, make):
    assert rows(neardup.drop_near_duplicates(make([(1, "one two three"), (1, "one two three"), (2, "something else")])), "doc_id") == [(1,), (2,)]


def test_empty_table(spark, make):
    assert neardup.near_duplicates(make([])).count() == 0
    assert neardup.drop_near_duplicates(make([])).count() == 0


def test_fingerprints_don_t_depend_on_the_batch():
    texts = pa.array(["a b c", "", "d e f g", *map(str, range(300))])
    whole = neardup.sketch(Words(texts))
    assert (whole[2] == neardup.sketch(Words(texts.slice(2, 1)))[0]).all()
    assert not np.array_equal(whole[0], whole[2])


def test_copies_are_found_among_chance_neighbours(spark):
    rnd = np.random.default_rng(8)
    place = neardup._places()[0]
    flips = neardup.MAX_DISTANCE
    loose = rnd.integers(0, 2, (60, neardup.POOL), np.uint8).repeat(2, 0)
    loose[:, place[0]] = loose[0, place[0]]  # all meet here, and twins nowhere else
    for k in range(1, 120, 2):
        while True:
            twin = loose[k].copy()
            twin[rnd.permutation(np.setdiff1d(np.arange(neardup.POOL), place[0]))[:flips]] ^= 1
            if ((twin ^ loose[k])[place[1:]].sum(1) > 2 * neardup.HALF).all():
                break
        loose[k] = twin
    packed = np.packbits(loose, axis=1)
    sketches = spark.createDataFrame([(k, bytes(x)) for k, x in enumerate(packed)], "node long, bits binary")
    got = {tuple(sorted((r.a, r.b))) for r in neardup.near_edges(sketches).collect()}
    assert got == {(k, k + 1) for k in range(0, 120, 2)}


def test_recall_at_the_largest_distance(spark):
    rnd = np.random.default_rng(9)
    flips = neardup.MAX_DISTANCE
    assert flips >= neardup.POOL // 5
    loose = rnd.integers(0, 2, (3000, neardup.POOL), np.uint8)
    for k in range(1, 3000, 2):
        loose[k] = loose[k - 1]
        loose[k, rnd.permutation(neardup.POOL)[:flips]] ^= 1
    sketches = spark.createDataFrame([(k, bytes(x)) for k, x in enumerate(np.packbits(loose, axis=1))], "node long, bits binary")
    got = {tuple(sorted((r.a, r.b))) for r in neardup.near_edges(sketches).collect()}
    assert got <= {(k, k + 1) for k in range(0, 3000, 2)} and len(got) >= 0.89 * 1500


def test_long_unrelated_texts_stay_apart(spark, make):
    rnd = random.Random(10)
    texts = [" ".join(f"{k}x{rnd.randrange(10**9)}" for _ in range(50_000)) for k in range(2)]
    texts += [" ".join(words(rnd, 50_000)) for _ in range(2)]  # nearly the same set of words
    copy = texts[2].split()
    for _ in range(5_000):
        copy[rnd.randrange(50_000)] = words(rnd, 1)[0]
    texts.append(" ".join(copy))
    assert rows(neardup.near_duplicates(make(texts)), "doc_id", "kept_doc_id") == [(4, 2)]


def test_unrelated_texts_of_all_lengths_stay_apart_and_copies_are_found(spark, make):
    rnd = np.random.default_rng(11)
    texts, copies = [], {}
    for k, n in enumerate(np.geomspace(1_000, 60_000, 40).astype(int)):
        base = np.char.add(f"{k}w", rnd.permutation(n).astype(str))
        texts.append(" ".join(base))
        if k % 4 == 0:
            base[rnd.permutation(n)[: n // 20]] = "other"
            copies[1000 + k] = k
            texts.append(" ".join(base))
    ids = [x for k in range(40) for x in ((k, 1000 + k) if k % 4 == 0 else (k,))]
    got = {r.doc_id: r.kept_doc_id for r in neardup.near_duplicates(make(list(zip(ids, texts)))).collect()}
    assert got == copies


def test_large_families_and_chunks_of_variants(spark, monkeypatch):
    rnd = np.random.default_rng(12)
    key = rnd.integers(0, 1 << 12, 300).astype(np.uint64)
    check = np.zeros(300, np.uint64)
    whole = rnd.random(300) < 0.8
    results = []
    for variants in (1 << 22, 512):
        monkeypatch.setattr(neardup, "VARIANTS", variants)
        results.append(neardup.joined(300, *neardup._collisions(key, check, whole, 12)).tolist())
    assert results[0] == results[1]
    balls = [{int(k)} | ({int(k) ^ (1 << b) for b in range(12)} if w else set()) for k, w in zip(key, whole)]
    a, b = zip(*[(a, b) for a in range(300) for b in range(a) if balls[a] & balls[b]])
    assert neardup.joined(300, np.array(a), np.array(b)).tolist() == results[0]


def test_shape_keeps_the_recall():
    assert neardup.shape(1000) == (32, neardup.TABLES)
    bits, tables = neardup.shape(1 << 30)
    assert bits == 40 and tables > neardup.TABLES
