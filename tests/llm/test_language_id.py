"""Mixtures against a plain EM over one document at a time, and held-out accuracy."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import rows

from gridcast.llm import language_id as lang

SYLLABLES = {"aa": "ba be bi ko ku ta".split(), "bb": "zor xin qua vel dro mip".split(), "cc": "szcz prz wys kow ski nia".split()}


def text(rnd, language, n):
    return " ".join("".join(rnd.choice(SYLLABLES[language]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def plain_em(like, penalty=lang.PENALTY):
    parts, n = like.shape[1], len(like)

    def fit(allowed):
        pi = [1 / len(allowed) if k in allowed else 0.0 for k in range(parts)]
        value = -math.inf
        while True:
            post, now = np.zeros(parts), 0.0
            for line in like:
                top = max(line)
                w = [p * math.exp(x - top) for p, x in zip(pi, line)]
                now += top + math.log(max(sum(w), 1e-300))
                post += np.array(w) / max(sum(w), 1e-300)
            if now - value < lang.GAIN:
                return pi, now - penalty / 2 * math.log(n + 1) * len(allowed)
            pi, value = list(post / n), now

    allowed = list(range(parts))
    pi, value = fit(allowed)
    while len(allowed) > 1:
        fewer = [k for k in allowed if k != min(allowed, key=lambda k: (pi[k], k))]
        new_pi, new_value = fit(fewer)
        if new_value < value:
            break
        allowed, pi, value = fewer, new_pi, new_value
    return [p if k in allowed else 0.0 for k, p in enumerate(pi)]


def test_batched_em_equals_plain_em():
    rnd = np.random.default_rng(1)
    sizes = [1, 2, 5, 20, 3]
    like = [rnd.normal(size=(n, 4)) * 3 for n in sizes]
    share, _ = lang.mixtures(np.concatenate(like), np.repeat([0, 2, 3, 5, 6], sizes), 8)
    for row, part in zip([0, 2, 3, 5, 6], like):
        assert share[row] == pytest.approx(plain_em(part), abs=1e-9)
    assert not share[[1, 4, 7]].any()


@pytest.fixture
def corpus(spark):
    rnd = random.Random(2)
    found = [(k, text(rnd, language, 60), language) for k, language in enumerate(["aa", "bb", "cc"] * 40)]
    return found, rnd


def test_sets_shares_and_rejection(spark, corpus):
    train, rnd = corpus
    new = [(1000 + k, text(rnd, language, 40), None) for k, language in enumerate(["aa", "bb", "cc"] * 10)]
    mixed = [(2000, text(rnd, "aa", 150) + " " + text(rnd, "bb", 50), None)]
    odd = [(3000, " ".join("".join(rnd.choice("fghjklmwxyz") for _ in range(6)) for _ in range(50)), None), (3001, None, "aa"), (3002, "", None), (3003, "12 345 !?", None), (None, train[0][1], "aa"), (3004, text(rnd, "cc", 40_000), None)]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in train + new + mixed + odd], "doc_id long, text string, lang string, languages string, und_share double")
    out = {r.doc_id: r for r in lang.language_mixtures(docs).collect()}
    assert len(out) == docs.count()
    assert all(out[i].languages == [["aa", "bb", "cc"][k % 3]] and out[i].keep for k, (i, _, _) in enumerate(new))
    length = [len(text(random.Random(9), x, 2000)) / 2000 for x in ("aa", "bb")]
    share = 150 * length[0] / (150 * length[0] + 50 * length[1])
    assert out[2000].languages == ["aa", "bb"] and out[2000].shares[0] == pytest.approx(share, abs=0.06)
    assert [out[k].keep for k in (3000, 3001, 3002, 3003, 3004)] == [False, False, False, False, True]
    assert out[3001].und_share == 1.0 and out[3001].languages == [] and out[None].languages == ["aa"]
    kept = lang.drop_rejected(docs)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id") == sorted(((i,) for i in out if out[i].keep), key=repr)


def test_nothing_to_train_on(spark, make):
    assert lang.language_mixtures(make([])).count() == 0
    assert lang.drop_rejected(make([])).count() == 0
    assert not any(r.keep for r in lang.language_mixtures(make(["some text here"], lang=None)).collect())


def test_trigrams_stay_in_their_row():
    bucket, row = lang.trigrams(pa.array(["Ab1c", "", None, "xyz"]))
    same, _ = lang.trigrams(pa.array(["ab!!!c"]))
    assert bucket[row == 0].tolist() == same.tolist() and not (row == 1).any() and (row == 3).sum() == 1


def test_an_address_in_a_short_text_is_no_reason_to_reject(spark, corpus):
    train, rnd = corpus
    short = [(5000 + k, f"{text(rnd, 'aa', 4)} xqzjwv{k}@wqxzj.example 4601274238375394", None) for k in range(30)]
    odd = [(6000 + k, " ".join("".join(rnd.choice("fghjklmwxyz") for _ in range(6)) for _ in range(9)), None) for k in range(30)]
    kept = {r.doc_id for r in lang.drop_rejected(spark.createDataFrame(train + short + odd, "doc_id long, text string, lang string")).collect()}
    assert {d for d, _, _ in train + short} <= kept and not {d for d, _, _ in odd} & kept
