"""Text quality by compression: two zstandard dictionaries, one from good and one from bad text.

A text like the good ones shrinks more under the dictionary of the good ones.
The texts are cut into blocks, so that the dictionary helps throughout and not
only at their start; the difference of the compressed sizes, divided by the
text's size, becomes a probability by logistic calibration on labelled texts
that no dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import column_of, utf8

#: Labelled texts of each class that are taken for training; half make the dictionary, half calibrate.
SAMPLE = 2400
DICTIONARY_BYTES = 262_144
BLOCK = 4096
LEVEL = 3
#: Least calibrated probability of a good text.
THRESHOLD = 0.5


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


def _blocks(raw: memoryview, size: int = BLOCK) -> list[bytes]:
    return [bytes(raw[k : k + size]) for k in range(0, len(raw), size)]


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """Trained on blocks; where there is too little text (under 16 blocks or twice the size), or zstandard finds nothing in common, the text itself."""
    parts = [p for t in texts for p in _blocks(memoryview(t))]
    if len(parts) >= 16 and sum(map(len, parts)) >= 2 * size:
        try:
            return zstandard.train_dictionary(size, parts).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(parts)[:size]


def _packers(model_good: bytes, model_bad: bytes, level: int = LEVEL) -> list[zstandard.ZstdCompressor]:
    out = []
    for data in (model_good, model_bad):
        shared = zstandard.ZstdCompressionDict(data) if data else None
        if shared:
            shared.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=False, write_dict_id=False, write_checksum=False))
    return out


def differences(texts: list[memoryview], packers: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """(size under the bad dictionary - size under the good one) / size; 0 for an empty text."""
    good, bad = packers
    out = np.zeros(len(texts))
    for k, raw in enumerate(texts):
        if len(raw):
            blocks = _blocks(raw)
            out[k] = (sum(len(bad.compress(x)) for x in blocks) - sum(len(good.compress(x)) for x in blocks)) / len(raw)
    return out


def _views(column: pa.Array) -> list[memoryview]:
    raw, off = utf8(column)
    view = memoryview(np.ascontiguousarray(raw))
    return [view[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def calibrate(x: np.ndarray, good: np.ndarray, prior: float = 0.5) -> tuple[float, float]:
    """Slope and offset of the logistic regression of ``good`` on x, classes weighed by ``prior``, by Newton's method."""
    if not len(x) or good.all() or not good.any():
        return 0.0, 0.0
    scale = x.std() or 1.0
    design = np.stack([x / scale, np.ones(len(x))], 1)
    weight = np.where(good, prior / good.sum(), (1 - prior) / (~good).sum()) * len(x)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (weight * (good - p)) - 1e-2 * w
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """The model from at most ``sample`` labelled texts of each class, those of least hash of the id."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("good"))
    picked = [marks.where(F.col("good") == v).orderBy(F.xxhash64("__id"), "__id").limit(sample) for v in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * sample rows at most, so the texts stay where they are
    texts = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    rows = texts.join(picked, "__id").select(F.xxhash64("__id").alias("h"), "__id", "good", "text").distinct().collect()
    rows.sort(key=lambda r: (r.h, r[1], r.text))
    by = {v: [r.text.encode() for r in rows if r.good == v] for v in (0, 1)}
    fit = {v: by[v][::2] for v in by}
    held = {v: by[v][1::2] for v in by}
    size = min(DICTIONARY_BYTES, *(max(256, sum(map(len, fit[v])) // 4) for v in fit))
    good, bad = _dictionary(fit[1], size), _dictionary(fit[0], size)
    x = differences([memoryview(t) for v in (0, 1) for t in held[v]], _packers(good, bad))
    share = marks.agg(F.avg("good")).first()[0]  # of good texts among all labels
    slope, offset = calibrate(x, np.repeat([False, True], [len(held[0]), len(held[1])]), share)
    return Model(good, bad, slope, offset)


def _score(model: Model, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = _packers(model.good, model.bad)
        for batch in batches:
            x = differences(_views(column_of(batch, "text")), packers)
            p = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))
            empty = np.diff(utf8(column_of(batch, "text"))[1]) == 0
            p[empty] = 0
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(np.round(x, 6)), pa.array(np.round(p, 6)), pa.array(p >= threshold)], ["doc_id", "size_difference", "score", "keep"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Quality of each document: ``(doc_id, size_difference, score, keep)``, a row for each row of docs.

    ``score`` is the calibrated probability that the text is good, ``keep`` whether it reaches ``threshold``.

    Null and empty texts score 0 and aren't kept.  Null ids keep their rows.  A
    label other than 0 and 1, null among them, is no label; of several labels of one id the
    best counts.  Without labels of both classes every text scores 0.5.
    Of the labelled texts at most ``sample`` of each class are used; a class with too little text for a trained dictionary
    has its text as the dictionary.  Texts of any length are compressed to their end.  Repeated rows are
    scored each, and alike; an empty table gives no row.  Other columns, whatever their names, are ignored.
    """
    model = train(docs, labels, id_col, text_col, label_col, sample)
    used = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return used.mapInArrow(_score(model, threshold), "doc_id long, size_difference double, score double, keep boolean")
