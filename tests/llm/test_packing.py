"""Histogram packing against best-fit decreasing, piece by piece."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridcast.llm import packing


def naive(lengths, capacities, cost):
    """(capacity, contents) of each bin, after shrinking."""
    bins, left = [], sum(lengths)
    for s in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] - sum(b[1]) >= s]
        if fits:
            best = min(fits, key=lambda b: b[0] - sum(b[1]))
            best[1].append(s)
        else:
            capacity = min((c for c in sorted(capacities) if c >= s), key=lambda c: (cost(c) / min(c, left), c))
            bins.append((capacity, [s]))
        left -= s
    return [(min(c for c in capacities if c >= sum(b)), sorted(b)) for _, b in bins]


@pytest.mark.parametrize("seed", range(30))
def test_same_bins_as_naive_best_fit(seed):
    rnd = random.Random(seed)
    capacities = rnd.choice([(8, 16, 32), (10,), (7, 12, 40, 64)])
    lengths = [rnd.randint(1, max(capacities)) for _ in range(rnd.randint(0, 120))] + [rnd.randint(1, 4) for _ in range(rnd.randint(0, 200))]
    cost = rnd.choice([packing.sequence_cost, lambda c: c, lambda c: c + c * c / 20])
    slots = packing.plan(dict(Counter(lengths)), capacities, cost)
    bins = {}
    for s, _, n, first, each, offset, capacity, used in slots.tolist():
        for k in range(n):
            bins.setdefault((first + k // each, capacity, used), []).append((offset + k % each * s, s))
    for (_, capacity, used), content in bins.items():
        at = 0
        for start, s in sorted(content):
            assert start == at
            at += s
        assert at == used <= capacity
    got = Counter((c, tuple(sorted(s for _, s in content))) for (_, c, _), content in bins.items())
    want = Counter((c, tuple(b)) for c, b in naive(lengths, capacities, cost))
    assert sum(got.values()) == sum(want.values())
    assert Counter(c for c, _ in got.elements()) == Counter(c for c, _ in want.elements())
    assert got == want


def test_every_token_is_packed_once(spark, make):
    rnd = random.Random(1)
    texts = [(k, " ".join(["w"] * rnd.choice([1, 5, 40, 300, 1000]))) for k in range(200)]
    texts += [(900, " ".join(["w"] * 20_000)), (901, None), (902, ""), (903, " \n "), (None, "a b c"), (904, "a, b!"), (904, "a, b!")]
    docs = make(texts)
    out = packing.pack(docs).collect()
    held = Counter()
    for r in out:
        held[r.doc_id] += r.n_tokens
    want = Counter()
    for i, t in texts:
        if t and t.strip():
            want[i] += {"a, b!": 4}.get(t, len(t.split()))
    assert held == want
    assert sorted((r.piece, r.start_token, r.n_tokens) for r in out if r.doc_id == 900) == [(0, 0, 8192), (1, 8192, 8192), (2, 16384, 3616)]
    bins = {}
    for r in out:
        bins.setdefault((r.bin_id, r.capacity, r.used), []).append((r.bin_offset, r.n_tokens))
    assert len({b for b, _, _ in bins}) == len(bins)
    for (_, capacity, used), content in bins.items():
        assert capacity in packing.CAPACITIES and used <= capacity and (capacity == 512 or used > capacity // 2)
        at = 0
        for start, n in sorted(content):
            assert start == at
            at += n
        assert at == used


def test_empty_table_and_own_token_counts(spark, make):
    assert packing.pack(make([])).count() == 0
    out = packing.pack(make(["abc", "de"]), capacities=(4,), tokens=F.length("text")).collect()
    assert sorted((r.doc_id, r.n_tokens, r.capacity) for r in out) == [(0, 3, 4), (1, 2, 4)]


def test_many_pieces_of_one_length(spark, make, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 50)
    texts = [(k, " ".join(["w"] * 700)) for k in range(400)] + [(1000 + k % 7, "a b c") for k in range(90)]
    out = packing.pack(make(texts)).collect()
    assert len(out) == len(texts)
    spans = {}
    for r in out:
        spans.setdefault(r.bin_id, []).append((r.bin_offset, r.n_tokens, r.used))
    for content in spans.values():
        content.sort()
        assert [o for o, _, _ in content] == [sum(n for _, n, _ in content[:k]) for k in range(len(content))]
        assert sum(n for _, n, _ in content) == content[0][2]
    assert sum(1 for r in out if r.n_tokens == 3) == 90
