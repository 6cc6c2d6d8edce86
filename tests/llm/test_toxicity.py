"""Segments against brute force, tails against sums, and held-out detection."""

import math
import random

import numpy as np
import pytest
from oracle import DATA

from gridcast.llm import toxicity


def brute_segments(score):
    """Recursive definition: take the contiguous part of largest sum (shortest, then first), go on left and right of it."""
    best = None
    for s in range(len(score)):
        for e in range(s + 1, len(score) + 1):
            x = sum(score[s:e])
            if x > 0 and (best is None or x > best[0] + 1e-12):
                best = (x, s, e)
    if best is None:
        return []
    x, s, e = best
    return brute_segments(score[:s]) + [(s, e, x)] + [(a + e, b + e, y) for a, b, y in brute_segments(score[e:])]


@pytest.mark.parametrize("seed", range(60))
def test_all_maximal_segments(seed):
    rnd = random.Random(seed)
    score = [rnd.uniform(-2, 2) for _ in range(rnd.randint(0, 25))]
    got = toxicity.maximal_segments(np.array(score))
    want = brute_segments(score)
    assert [(s, e) for s, e, _ in got] == [(s, e) for s, e, _ in want]
    assert [x for *_, x in got] == pytest.approx([x for *_, x in want])


def test_poisson_tail():
    for mean in (1e-9, 0.01, 0.4, 0.7, 3.0, 20.0):
        for r in (1, 2, 5):
            want = 1 - sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(r)) if mean > 0.3 else sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(r, r + 20))
            assert toxicity.tail(mean, r) == pytest.approx(want, rel=1e-6)


def test_decay_solves_its_equation():
    score, share = np.array([4.0, 2.0, -1.0]), np.array([0.001, 0.01, 0.2])
    x = toxicity.decay(score, share)
    assert (1 - share.sum()) * math.exp(-x * toxicity.DRIFT) + (share * np.exp(x * (score - toxicity.DRIFT))).sum() == pytest.approx(1)
    assert x > 0.1


def test_held_out_detection(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    found = toxicity.toxic_passages(docs, train).select("doc_id", "p_value")
    out = held.join(found, "doc_id", "left").select("toxic", "p_value").collect()
    caught = [r.p_value is not None for r in out if r.toxic == 1]
    false = [r.p_value is not None for r in out if r.toxic == 0]
    assert np.mean(caught) > 0.85 and np.mean(false) < 0.01


def labels_of(spark, items):
    return spark.createDataFrame([(*r, "clash", "clash") for r in items], "doc_id long, toxic int, quality int, text string, p_value string")


def test_edges(spark, make):
    rnd = random.Random(1)
    common, insults = [f"{a}{b}{k}" for a in "bdfgk" for b in "aeiou" for k in range(3)], ["nastyone", "nastytwo", "vile", "grimthree"]

    def sentence(toxic):
        text = [rnd.choice(common) for _ in range(60)]
        if toxic:
            text[20:20] = rnd.sample(insults, 3)
        return " ".join(text)

    texts = [(k, sentence(k % 3 == 0)) for k in range(300)]
    bad = sentence(True)
    texts += [(1000, None), (1001, ""), (1002, bad), (1002, bad), (None, bad), (1003, "ba1 du2 " * 50_000 + " ".join(insults)), (1004, sentence(False)), (1005, "?! ...")]
    marks = [(k, int(k % 3 == 0), 1) for k in range(300)] + [(7, None, 1), (None, 1, 1), (5, 4, 1), (9999, 1, 1)]
    out = toxicity.toxic_passages(make(texts), labels_of(spark, marks)).collect()
    found = [r.doc_id for r in out]
    assert found.count(1002) == 2 and None in found and not {1000, 1001, 1004, 1005} & set(found)
    assert {k for k in found if k is not None and k < 300} == set(range(0, 300, 3))
    # chance grows with length: four insults in 100,004 words weigh less than three in 63
    p = {r.doc_id: r.p_value for r in toxicity.toxic_passages(make(texts), labels_of(spark, marks), alpha=1.0).collect()}
    assert 0 < p[1002] < p[1003] < 1
    words = bad.split()
    passage = next(r for r in out if r.doc_id == 1002).passages[0]
    assert set(words[passage.start_word : passage.end_word]) & set(insults)
    fresh = toxicity.toxic_passages(make([*texts, (2000, sentence(False) + " nastyseven nastyeight")]), labels_of(spark, marks))
    assert 2000 in [r.doc_id for r in fresh.collect()]  # by the beginning of the words


def test_without_labels_or_documents(spark, make):
    assert toxicity.toxic_passages(make(["some text"]), labels_of(spark, [])).count() == 0
    assert toxicity.toxic_passages(make(["some text"]), labels_of(spark, [(0, 1, 1)])).count() == 0
    assert toxicity.toxic_passages(make([]), labels_of(spark, [(0, 1, 1)])).count() == 0
