"""Toxic passages: maximum-scoring segments over word log-odds.

Words are scored by the log-odds of toxic against clean labelled texts with an
informative Dirichlet prior, their frequency in the whole corpus, drawn
towards 0 by ``Z`` standard deviations; every word also costs ``DRIFT``, so that text at large
scores below 0.  A word that no clean text of the sample has is also scored by its first letters, for insults
are inflected and compounded at will; a word of clean texts has its own score only.  A linear scan (Ruzzo and Tompa) finds all maximal scoring
segments of a text.  Under clean text the best score of m words has
extreme-value tails, P(S >= x) = 1 - exp(-K m exp(-lambda x)) (Karlin and
Altschul): lambda comes from the score distribution of clean text and K from
clean labelled texts that no score was made of.  A document's segments are
aggregated by the Poisson tails of their ranks, equal segments counting once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import Words, column_of, mix64, slices

#: Labelled texts of each class that are taken for training, those of least hash of the id.
SAMPLE = 8000
PRIOR_SHARE = 0.1
Z = 1.64
DRIFT = 1.0
#: Largest probability under clean text at which a passage, and a document, is significant.
ALPHA = 1e-4

#: Numbers of leading letters that stand for all longer words that begin alike.
STEMS = (5, 7)


def stems(words: Words) -> list[np.ndarray]:
    """For each of STEMS, a hash of the first letters of each word that has more; 0 for shorter words."""
    letters = np.flatnonzero((words.raw & 0xC0) != 0x80)  # where a character begins
    first = np.searchsorted(letters, words.start)
    size = np.searchsorted(letters, words.end) - first
    out = []
    for n in STEMS:
        long = np.flatnonzero(size > n)
        part = np.zeros(len(words), np.uint64)
        part[long] = mix64(words.hash_of(words.start[long], letters[first[long] + n]) + np.uint64(n))
        out.append(part)
    return out


@dataclass(frozen=True)
class Model:
    """Scores of words and stems by hash (all others score 0), before the drift, which of them clean texts have, and the tails' parameters."""

    value: np.ndarray
    score: np.ndarray
    clean: np.ndarray
    rate: float
    scale: float


def word_scores(words: Words, model: Model) -> np.ndarray:
    """The score of each word; a word that repeats the one before it in its text scores once."""
    if not len(model.value):
        return np.full(len(words), -DRIFT)

    def of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(model.value, h), len(model.value) - 1)
        known = model.value[at] == h
        return np.where(known, model.score[at], 0.0), known & model.clean[at]

    own, clean = of(words.hash)
    score = np.where(clean, own, np.maximum.reduce([own, *(of(x)[0] for x in stems(words))]))
    score[1:][(words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])] = 0.0
    return score - DRIFT


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order; linear in the length.

    What is left of negative words between two positive ones acts as one step.
    """
    hits = np.flatnonzero(score > 0)
    if not len(hits):
        return []
    total = np.concatenate([[0.0], np.cumsum(score)])
    held: list[list] = []  # start, end, sum before, sum after, nearest earlier one with a lower sum before
    for at in hits.tolist():
        start, low, high = at, float(total[at]), float(total[at + 1])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= low:
                j = held[j][4]
            if j < 0 or held[j][3] >= high:
                held.append([start, at + 1, low, high, j])
                break
            start, low = held[j][0], held[j][2]
            del held[j:]
    return [(s, e, hi - lo) for s, e, lo, hi, _ in held]


def tail(expected: float, r: int) -> float:
    """P(a Poisson variable reaches r)."""
    if r == 1:
        return float(-np.expm1(-expected))
    term, total = np.exp(-expected), 0.0
    if expected < 0.5:  # sum the tail itself: the other way loses all digits
        for i in range(1, r + 1):
            term *= expected / i
        for i in range(r + 1, r + 40):
            total += term
            term *= expected / i
        return float(min(1.0, total))
    for i in range(r):
        total += term
        term *= expected / (i + 1)
    return float(max(0.0, 1 - total))


def document_p(scores: list[float], words: int, model: Model) -> float:
    """P of such segments under clean text: the least over all ranks r of the tail of r segments, weighed by 2**r.

    Where a quarter of r or more are expected, the weighed tail exceeds 1.
    """
    s = np.sort(np.asarray(scores, float))[::-1]
    r = np.arange(1, len(s) + 1)
    with np.errstate(divide="ignore"):
        log_mean = np.log(model.scale) + np.log(words) - model.rate * s
    some = np.flatnonzero(log_mean < np.log(r / 4))
    if not len(some):
        return 1.0
    mean, n = np.exp(log_mean[some]), r[some]
    term, series = np.ones(len(n)), np.ones(len(n))
    for k in range(1, 40):
        term = term * mean / (n + k)
        series += term
    log_p = n * (log_mean[some] + np.log(2.0)) - mean - np.cumsum(np.log(r))[some] + np.log(series)
    return float(min(1.0, np.exp(log_p.min())))


def _count_words(value: np.ndarray | None) -> Callable:
    """In how many texts of each group each word and stem of ``value`` (all, if None) occurs; hash 0 stands for the total of words.

    A word counts once a text, or one long text that harps on a name would
    outweigh many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if value is None else np.zeros((2, len(value) + 1), np.int64)
        for batch in batches:
            text, group = column_of(batch, "text"), column_of(batch, "toxic").to_numpy()
            for a, b in slices(text):
                words = Words(text.slice(a, b - a))
                parts = stems(words)
                h, row = np.concatenate([words.hash, *(x[x > 0] for x in parts)]), np.concatenate([words.row, *(words.row[x > 0] for x in parts)])
                word = np.arange(len(h)) < len(words)
                order = np.lexsort((h, row))
                h, row, word = h[order], row[order], word[order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, word, mine = h[once], word[once], group[a:b][row[once]]
                for g in (0, 1):
                    part, total = h[mine == g], int(word[mine == g].sum())
                    if known is None:
                        some, n = np.unique(part, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some) + 1, g, np.int32)), pa.array(np.append(some.view(np.int64), 0)), pa.array(np.append(n, total).astype(np.int64))], ["toxic", "word", "n"])
                    elif len(part):
                        at = np.minimum(np.searchsorted(value, part), len(value) - 1)
                        known[g, :-1] += np.bincount(at[value[at] == part], minlength=len(value))
                        known[g, -1] += total
        if known is not None:
            for g in (0, 1):
                some = np.flatnonzero(known[g])
                name = np.append(value, np.uint64(0)).view(np.int64)[some]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), g, np.int32)), pa.array(name), pa.array(known[g, some])], ["toxic", "word", "n"])

    return run


def log_odds(toxic: np.ndarray, clean: np.ndarray, corpus: np.ndarray, n_toxic: int, n_clean: int, n_corpus: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores drawn towards 0, and smoothed probabilities in clean text."""
    weight = max(1.0, PRIOR_SHARE * n_toxic)
    prior = weight * (corpus + 1) / (n_corpus + 1)
    odds = np.log((toxic + prior) / np.maximum(1e-9, n_toxic + weight - toxic - prior)) - np.log((clean + prior) / np.maximum(1e-9, n_clean + weight - clean - prior))
    spread = Z * np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    return np.sign(odds) * np.maximum(0, np.abs(odds) - spread), (clean + prior) / (n_clean + weight)


def decay(score: np.ndarray, share: np.ndarray) -> float:
    """The rate at which sum(share * exp(rate * (score - DRIFT))) is 1; words not listed score 0."""
    rest = max(0.0, 1 - share.sum())

    def above(x: float) -> bool:
        return rest * np.exp(-x * DRIFT) + (share * np.exp(np.minimum(700, x * (score - DRIFT)))).sum() > 1

    low, high = 0.0, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if above(mid) else (mid, high)
    return high


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Scores from at most ``sample`` labelled texts of each class, and from the word counts of all docs."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("toxic"))
    order = F.xxhash64("__id")
    picked = [marks.where(F.col("toxic") == v).orderBy(order, "__id").limit(sample) for v in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]).withColumn("held", (F.pmod(order, F.lit(4)) == 0) & (F.col("toxic") == 0)))  # 2 * sample rows at most
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    labelled = texts.join(picked, "__id")

    columns = "toxic int, word long, n long"
    counts = labelled.where("not held").select("toxic", "text").mapInArrow(_count_words(None), columns).groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean")
    )
    counts = counts.toArrow()  # the words of 2 * sample texts
    word = counts["word"].to_numpy().view(np.uint64)
    order_ = np.argsort(word)
    word, toxic, clean = word[order_], counts["toxic"].to_numpy()[order_], counts["clean"].to_numpy()[order_]
    if not len(word) or word[0] != 0 or not toxic[0] or not clean[0]:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool), 1.0, 1.0)
    n_toxic, n_clean, word, toxic, clean = int(toxic[0]), int(clean[0]), word[1:], toxic[1:], clean[1:]

    everywhere = texts.select(F.lit(0).alias("toxic"), "text").mapInArrow(_count_words(word), columns).groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    seen, n = everywhere["word"].to_numpy().view(np.uint64), everywhere["n"].to_numpy()
    n_corpus = int(n[seen == 0].sum())
    corpus = np.zeros(len(word))
    inside = seen != 0
    corpus[np.searchsorted(word, seen[inside])] = n[inside]
    score, share = log_odds(toxic, clean, corpus, n_toxic, n_clean, n_corpus)
    score = np.where(toxic > 0, score, 0.0)  # a word is no evidence of clean text by its absence here
    keep = (score != 0) | (clean > 0)
    counted = score != 0
    model = Model(word[keep], score[keep], clean[keep] > 0, decay(score[counted], share[counted]), 1.0)

    held = labelled.where("held").select("text").mapInArrow(_held_back(model), "n long, total double").agg(F.sum("n"), F.sum("total")).first()
    scale = held[0] / held[1] if held[0] and held[1] else 1.0
    return Model(model.value, model.score, model.clean, model.rate, scale)


def _held_back(model: Model) -> Callable:
    """Parts of the maximum-likelihood estimate of K: texts / sum(words * exp(-rate * best score))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = column_of(batch, "text")
            for a, b in slices(text):
                words = Words(text.slice(a, b - a))
                score = word_scores(words, model)
                size = np.diff(words.first)
                best = [max((s for _, _, s in maximal_segments(score[i:j])), default=0.0) for i, j in zip(words.first[:-1], words.first[1:])]
                used = size > 0
                yield pa.RecordBatch.from_arrays([pa.array([int(used.sum())], pa.int64()), pa.array([float((size * np.exp(-model.rate * np.array(best)))[used].sum())])], ["n", "total"])

    return run


_PASSAGES = "array<struct<start_word:int,end_word:int,score:double,p_value:double>>"


def _find(model: Model, alpha: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ids = column_of(batch, "text"), column_of(batch, "doc_id").to_pylist()
            out = []
            for a, b in slices(text):
                words = Words(text.slice(a, b - a))
                score = word_scores(words, model)
                for i in np.unique(words.row[score > 0]).tolist():
                    low, high = int(words.first[i]), int(words.first[i + 1])
                    found = maximal_segments(score[low:high])
                    # the same words again say nothing new: text that repeats itself isn't independent
                    distinct = {words.hash[low + s : low + e].tobytes(): x for s, e, x in found}
                    p = document_p(list(distinct.values()), high - low, model)
                    if p > alpha:
                        continue
                    each = [(s, e, round(x, 4), tail(model.scale * (high - low) * np.exp(-model.rate * x), 1)) for s, e, x in found]
                    shown = [{"start_word": s, "end_word": e, "score": x, "p_value": q} for s, e, x, q in each if q <= alpha]
                    shown = shown or [{"start_word": s, "end_word": e, "score": x, "p_value": q} for s, e, x, q in [max(each, key=lambda x: (x[2], -x[0]))]]
                    out.append({"doc_id": ids[a + i], "passages": shown, "best_score": max(x for _, _, x, _ in each), "p_value": float(p)})
            if out:
                kind = pa.struct([("start_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())])
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("passages", pa.list_(kind)), ("best_score", pa.float64()), ("p_value", pa.float64())]))

    return run


def toxic_passages(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", alpha: float = ALPHA, sample: int = SAMPLE) -> DataFrame:
    """Documents with toxic text: ``(doc_id, passages, best_score, p_value)``, a row for each such row of docs.

    ``p_value`` is that of the document; ``passages`` are its significant
    segments (words from 0, end exclusive), or the best one (of equal ones the first) where only all together are significant.

    Texts are scanned to their end, however long, and each by itself.  Null and empty texts are never toxic.  Null ids keep their rows.  A label other than
    0 and 1 is none; of several labels of one id the worst counts.  Without labels of both
    classes nothing is found.  Repeated rows give a row each; other columns are ignored.
    """
    model = train(docs, labels, id_col, text_col, label_col, sample)
    used = docs.where(F.length(text_col) > 0).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return used.mapInArrow(_find(model, alpha), f"doc_id long, passages {_PASSAGES}, best_score double, p_value double")
