"""Leaks against the edit distance of every stretch."""

import random
import re

import numpy as np
from conftest_llm import rows

from gridcast.llm import decontam

VOCABULARY = [f"{a}{b}{k}" for a in "bcdfglmnprst" for b in "aeiou" for k in range(6)]


def bench(spark, items):
    return spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")


def edits(rnd, words, n):
    out = list(words)
    for _ in range(n):
        at, kind = rnd.randrange(len(out)), rnd.choice("rid")
        out[at : at + (kind != "i")] = [] if kind == "d" else [rnd.choice(VOCABULARY)]
    return out


def distance_to_any(item, text):
    """Least edit distance of item to any stretch of text."""
    line = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(line[j] + 1, new[j - 1] + 1, line[j - 1] + (w != v)))
        line = new
    return min(line)


def test_recall_and_precision_against_brute_force(spark, make):
    rnd = random.Random(3)
    items = {k: [rnd.choice(VOCABULARY) for _ in range(rnd.choice([4, 9, 15, 22, 37, 60]))] for k in range(30)}
    docs = {}
    for d in range(150):
        text = [rnd.choice(VOCABULARY) for _ in range(rnd.randint(0, 80))]
        if d % 2:
            k = rnd.randrange(30)
            leaked = edits(rnd, items[k], rnd.randint(0, int(decontam.tolerance(len(items[k])))))
            at = rnd.randint(0, len(text))
            text[at:at] = leaked
        docs[d] = text
    want = {}
    for d, text in docs.items():
        for k, item in items.items():
            n = distance_to_any(item, text)
            if n <= decontam.tolerance(len(item)):
                want[d, k] = n
    found = decontam.leaks(make([(d, ", ".join(t)) for d, t in docs.items()]), bench(spark, [(k, " ".join(t).title()) for k, t in items.items()]))
    got = {(r.doc_id, r.item_id): r.edits for r in found.collect()}
    assert set(got) <= set(want)
    assert all(got[k] == want[k] for k in got)
    assert len(got) >= 0.9 * len(want) and len(want) > 60


def test_nearest_stretch():
    rnd = random.Random(4)
    pairs = [([rnd.randint(1, 3) for _ in range(rnd.randint(1, 8))], [rnd.randint(1, 3) for _ in range(rnd.randint(1, 10))]) for _ in range(200)]
    best, start = decontam.nearest_stretch(*([np.array(x) for x in side] for side in zip(*pairs)))
    for (item, text), n, at in zip(pairs, best.tolist(), start.tolist()):
        from_here = []
        for s in range(len(text) + 1):
            line = list(range(len(text) - s + 1))
            for i, w in enumerate(item, 1):
                new = [i]
                for j, v in enumerate(text[s:], 1):
                    new.append(min(line[j] + 1, new[j - 1] + 1, line[j - 1] + (w != v)))
                line = new
            from_here.append(min(line))
        assert n == min(from_here) and at == from_here.index(n)


def test_walks_reach_the_recall_asked_for(spark, make):
    assert decontam.repetitions(40, 0.2, 0.5) < decontam.repetitions(40, 0.2, 0.9) and decontam.repetitions(40, 0.2, 0.999)[1] < 3
    rnd = random.Random(9)
    items = {k: [rnd.choice(VOCABULARY) for _ in range(30)] for k in range(200)}
    docs = [(k, " ".join(edits(rnd, t, int(decontam.tolerance(30))))) for k, t in items.items()]
    asked = bench(spark, [(k, " ".join(t)) for k, t in items.items()])
    size = [sum(r.doc_id == r.item_id for r in decontam.leaks(make(docs), asked, recall=x).collect()) for x in (0.3, 0.95)]
    assert size[0] < size[1] and size[1] >= 0.92 * 200


def test_long_items_in_full(spark, make):
    rnd = random.Random(10)
    item = [f"w{rnd.randrange(5000)}" for _ in range(4000)]
    for_all = {1: edits(rnd, item, 700), 2: edits(rnd, item[:2000], 300) + [f"x{k}" for k in range(2000)], 3: item[::-1]}
    found = decontam.leaks(make([(d, " ".join(t)) for d, t in for_all.items()]), bench(spark, [(1, " ".join(item))])).collect()
    assert [(r.doc_id, r.item_words) for r in found] == [(1, 4000)] and 400 < found[0].edits <= 700


def test_edge_cases(spark, make):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    text = "before " + item.replace(" ", "\n").upper() + ". after"
    long = "word " * 100_000 + item + " word" * 100_000
    docs = make([(1, text), (1, text), (2, None), (3, ""), (None, text), (4, "alpha beta"), (5, long), (6, item), (6, item + " more"), (7, re.sub("gamma", "x", item))])
    found = decontam.leaks(docs, bench(spark, [(10, item), (11, item), (12, "alpha beta"), (13, None), (None, item), (14, "")]))
    assert rows(found, "doc_id", "item_id", "start_word", "edits") == sorted([(d, k, s, e) for k in (10, 11) for d, s, e in ((1, 1, 0), (5, 100_000, 0), (6, 0, 0), (6, 0, 0), (7, 0, 1))] + [(d, 12, s, 0) for d, s in ((1, 1), (4, 0), (5, 100_000), (6, 0), (6, 0), (7, 0))], key=repr)
    kept = decontam.drop_leaks(docs, bench(spark, [(10, item)]))
    assert kept.columns == docs.columns and rows(kept, "doc_id") == [(2,), (3,), (4,), (None,)]


def test_empty_tables(spark, make):
    docs = make(["one two three four five"])
    assert decontam.leaks(make([]), bench(spark, [(1, "one two three")])).count() == 0
    assert decontam.leaks(docs, bench(spark, [])).count() == 0
    assert decontam.drop_leaks(docs, bench(spark, [])).count() == 1
