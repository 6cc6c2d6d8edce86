"""Held-out accuracy of the compression classifier, and its defined corners."""

import numpy as np
import pytest
import zstandard
from conftest_llm import rows
from oracle import DATA
from pyspark.sql import functions as F

from gridcast.llm import quality


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    scored = quality.quality_scores(docs, train).join(held, "doc_id").select("score", "keep", "quality").collect()
    good = np.array([r.quality == 1 for r in scored])
    kept = np.array([r.keep for r in scored])
    assert kept[good].mean() > 0.97 and kept[~good].mean() < 0.25
    score = np.array([r.score for r in scored])
    assert abs(score.mean() - good.mean()) < 0.06  # calibrated


def test_calibration_recovers_a_logistic():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=20_000)
    y = rnd.random(20_000) < 1 / (1 + np.exp(-(3 * x + 1)))
    slope, offset = quality.calibrate(x, y, float(y.mean()))
    assert slope == pytest.approx(3, rel=0.05) and offset == pytest.approx(1, abs=0.1)
    assert quality.calibrate(x, np.ones(20_000, bool)) == (0.0, 0.0)


def test_same_as_plain_compression(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    text = {r.doc_id: r.text for r in docs.collect()}
    marks = {}
    for r in labels.collect():
        if r.quality in (0, 1):
            marks[r.doc_id] = max(marks.get(r.doc_id, 0), r.quality)
    order = [r.doc_id for r in docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    of = {v: [text[d].encode() for d in order if marks.get(d) == v and text[d]] for v in (0, 1)}
    fit, held = {v: of[v][::2] for v in of}, {v: of[v][1::2] for v in of}
    size = min(quality.DICTIONARY_BYTES, *(max(256, sum(map(len, fit[v])) // 4) for v in fit))
    blocks = lambda raw: [raw[k : k + quality.BLOCK] for k in range(0, len(raw), quality.BLOCK)]

    def dictionary(texts):
        try:
            return zstandard.ZstdCompressionDict(zstandard.train_dictionary(size, [x for t in texts for x in blocks(t)]).as_bytes())
        except zstandard.ZstdError:
            return zstandard.ZstdCompressionDict(b"".join(texts)[:size])

    packers = {v: zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=dictionary(fit[v]), write_content_size=False, write_dict_id=False, write_checksum=False) for v in fit}
    difference = lambda raw: sum(len(packers[0].compress(x)) - len(packers[1].compress(x)) for x in blocks(raw)) / len(raw) if raw else 0.0
    x = np.array([difference(t) for v in (0, 1) for t in held[v]])
    slope, offset = quality.calibrate(x, np.repeat([False, True], [len(held[0]), len(held[1])]), float(np.mean([marks[d] for d in marks])))
    for r in quality.quality_scores(docs, labels).collect():
        want = difference((text[r.doc_id] or "").encode())
        assert r.size_difference == pytest.approx(want, abs=2e-6)
        if text[r.doc_id]:
            assert r.score == pytest.approx(1 / (1 + np.exp(-(slope * want + offset))), abs=1e-4)


def labels_of(spark, items):
    return spark.createDataFrame([(*r, "clash", "clash") for r in items], "doc_id long, quality int, toxic int, text string, score string")


def test_edges(spark, make):
    good = [f"a sensible sentence number {k} about trees, rivers and towns." for k in range(40)]
    bad = [f"BUY!! NOW!! {k}!! CHEAP!! " * 5 for k in range(40)]
    texts = list(enumerate(good + bad)) + [(100, None), (101, ""), (None, good[0]), (102, " ".join(f"a sensible sentence number {k} about trees, rivers and towns {k * 7}." for k in range(9000))), (0, good[0])]
    marks = [(k, int(k < 40), 0) for k in range(80)] + [(5, 0, 0), (7, None, 0), (None, 1, 0), (999, 1, 0), (3, 9, 0)]
    out = quality.quality_scores(make(texts), labels_of(spark, marks)).collect()
    assert len(out) == len(texts)
    by = {r.doc_id: r for r in out}
    assert (by[100].score, by[100].keep, by[101].score) == (0.0, False, 0.0)
    assert 0 < by[102].score < 1 and by[None].score == by[0].score
    assert np.mean([by[k].score for k in range(40)]) > np.mean([by[k].score for k in range(40, 80)]) + 0.5


def test_without_labels_or_documents(spark, make):
    docs = make(["some text"])
    assert rows(quality.quality_scores(docs, labels_of(spark, [])), "score", "keep") == [(0.5, True)]
    assert quality.quality_scores(make([]), labels_of(spark, [(1, 1, 0)])).count() == 0
