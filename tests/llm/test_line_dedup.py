"""Repeated runs of lines against brute force over all runs."""

import random

import pytest
from conftest_llm import rows
from oracle import DATA, compare, connection

from gridcast.llm import line_dedup
from gridcast.llm.queries import op1_line_dedup


def brute(docs, min_words):
    """(doc, start, end, first doc) of all runs that occurred before as a whole and lie in no other one."""
    first, runs = {}, {}
    lines = {d: [(k, x) for k, x in enumerate(t.split("\n")) if x.strip()] for d, t in docs.items()}
    for d in sorted(lines):
        seq = [x for _, x in lines[d]]
        for s in range(len(seq)):
            for e in range(s + 1, len(seq) + 1):
                first.setdefault(tuple(seq[s:e]), (d, s))
    for d in sorted(lines):
        seq = [x for _, x in lines[d]]
        for s in range(len(seq)):
            for e in range(s + 1, len(seq) + 1):
                if sum(len(x.split()) for x in seq[s:e]) >= min_words and first[tuple(seq[s:e])] < (d, s):
                    runs[d, s, e] = first[tuple(seq[s:e])][0]
    kept = [r for r in runs if not any(r != q and q[0] == r[0] and q[1] <= r[1] and q[2] >= r[2] for q in runs)]
    return sorted((d, lines[d][s][0], lines[d][e - 1][0] + 1, runs[d, s, e]) for d, s, e in kept)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_brute_force(spark, make, seed):
    rnd = random.Random(seed)
    alphabet = [" ".join(["abcdef"[k]] * (1 + k % 4)) for k in range(6)]
    docs = {}
    for d in range(25):
        text = [rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))]
        if d > 2 and rnd.random() < 0.6:
            other = docs[rnd.randrange(d)].split("\n")
            at = rnd.randrange(len(other))
            text += other[at : at + rnd.randint(1, 8)]
        docs[d] = "\n".join(text)
    found = line_dedup.repeated_runs(make(list(docs.items())), min_words=7)
    assert rows(found, "doc_id", "start_line", "end_line", "first_doc_id") == sorted(brute(docs, 7), key=repr)
    for r in found.collect():
        part = [x for x in docs[r.doc_id].split("\n")[r.start_line : r.end_line] if x.strip()]
        assert (r.n_lines, r.n_words) == (len(part), sum(len(x.split()) for x in part)) and r.first_doc_id <= r.doc_id


def test_default_threshold_and_edges(spark, make):
    passage = "\n".join(" ".join(f"w{k}x{j}" for j in range(20)) for k in range(3))
    short = "a line of few words"
    long_line = " ".join(f"long{k}" for k in range(60))
    texts = [(0, f"start\n{passage}\nend"), (1, f"{short}\n\n{passage}"), (2, short), (3, None), (4, ""), (None, passage), (5, long_line), (6, long_line + "\nrest"), (6, long_line + "\nrest"), (7, "x " * 200_000)]
    out = rows(line_dedup.repeated_runs(make(texts)), "doc_id", "start_line", "end_line", "first_doc_id")
    assert out == [(1, 2, 5, 0), (6, 0, 1, 5)]
    kept = line_dedup.delete_repeats(make(texts))
    assert kept.columns == make(texts).columns
    by = {(r.doc_id, r.text) for r in kept.collect()}
    assert (1, short + "\n") in by and (6, "rest") in by and (0, texts[0][1]) in by and (3, None) in by and (4, "") in by and (None, passage) in by
    assert {r.n_chars for r in kept.where("doc_id = 6").collect()} == {4}


def test_a_whole_copy_goes(spark, make):
    text = " ".join(f"w{k}" for k in range(80))
    assert rows(line_dedup.delete_repeats(make([(2, text), (1, text), (3, "other")])), "doc_id") == [(1,), (3,)]


def test_empty_table(spark, make):
    assert line_dedup.repeated_runs(make([])).count() == 0
    assert line_dedup.delete_repeats(make([])).count() == 0


def test_ranks_sort_the_suffixes(spark, make):
    lines = line_dedup.document_lines(make(["a\nb\na\nb\nc", "b\nc\na", "a\nb\nd"]), "doc_id", "text")
    seq = {}
    for r in lines.collect():
        seq.setdefault(r.id, {})[r.pos] = (r.h, r.g)
    for k, level in enumerate(line_dedup.suffix_levels(lines, 1)):
        found = {}
        for r in level.collect():
            found.setdefault(r.rank, set()).add(tuple(seq[r.id][r.pos + j] for j in range(1 << k)))
        assert all(len(v) == 1 for v in found.values())
        prefixes = [next(iter(found[x])) for x in sorted(found)]
        assert prefixes == sorted(prefixes) and len(prefixes) == (3, 2)[k]


def test_a_run_has_one_source(spark, make):
    a, b = ("\n".join(f"{c}{k} " * 20 for k in range(3)) for c in "ab")
    both = f"{a}\n{b}"
    out = rows(line_dedup.repeated_runs(make([(1, a), (2, b), (3, both), (4, both)])), "doc_id", "start_line", "end_line", "first_doc_id")
    assert out == [(3, 0, 3, 1), (3, 3, 6, 2), (4, 0, 6, 3)]


def test_hot_line_and_long_runs(spark, make):
    text = "\n".join(f"line number {k} of some text" for k in range(700))
    docs = [(k, "}\n" * (k + 1)) for k in range(60)] + [(100, text), (101, "other start\n" + text), (102, "\n".join(text.split("\n")[100:333]))]
    out = rows(line_dedup.repeated_runs(make(docs)), "doc_id", "start_line", "end_line", "first_doc_id")
    assert (101, 1, 701, 100) in out and (102, 0, 233, 100) in out
    small = {k: t for k, t in docs if 47 <= k < 100}
    assert rows(line_dedup.repeated_runs(make(list(small.items()))), "doc_id", "start_line", "end_line", "first_doc_id") == sorted(brute(small, 50), key=repr)


def test_sql(spark):
    compare(op1_line_dedup(spark, f"{DATA}/sf0.01"), line_dedup.RUNS_SQL, connection("sf0.01"))
