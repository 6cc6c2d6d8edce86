"""Language mixtures of documents: trigram models, expectation-maximisation, penalised choice of the set.

A language's model is the distribution of letter trigrams (hashed into
``2**BUCKET_BITS`` buckets) over all documents labelled with it, smoothed
towards the distribution over all languages.  A further component, ``und``, puts out
trigrams evenly: text that follows no language.  A document is a sequence
of segments of ``SEGMENT`` trigrams, each put out by one component; its
proportions are estimated by EM.  Starting from all components, the one of
least share is dropped as long as that raises
``log likelihood - PENALTY / 2 * components * log(segments)``, so the set of
languages is chosen by penalised likelihood.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import column_of, mix64, slices, utf8

BUCKET_BITS = 16
SEGMENT = 24
PENALTY = 2.0
#: EM ends for a document when a step raises its log likelihood by less.
GAIN = 1e-4
#: A document with more of its text outside all languages is rejected.  In a short one an address or a number may be half of it.
MAX_UND = 0.7
#: It must also be likelier by so many nats (natural logarithm) to be in no language than in any one; three random identifiers amount to this.
EVIDENCE = 200.0
UND = "und"
#: Labels that a task counts at a time.
TABLES = 200

_LETTER = np.zeros(256, bool)
_LETTER[128:] = _LETTER[97:123] = True


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of lower-case letters and gaps, and the row of each.

    A run of other characters is one gap; a trigram with a gap in its middle
    doesn't count, nor does one that leaves its row.  Letters beyond ASCII count by their bytes.
    """
    raw, off = utf8(pc.utf8_lower(column))
    letter = _LETTER[raw]
    row = np.repeat(np.arange(len(column)), np.diff(off))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character of a gap stands for it
    at = np.flatnonzero(keep)
    code = np.where(letter[at], raw[at], 32).astype(np.uint64)
    row = row[at]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    packed = (code[:-2] << np.uint64(16)) | (code[1:-1] << np.uint64(8)) | code[2:]
    ok = (row[:-2] == row[2:]) & (code[1:-1] != 32)
    bucket = mix64(packed[ok]) >> np.uint64(64 - BUCKET_BITS)
    return bucket.astype(np.int64), row[:-2][ok]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        text, lang = column_of(batch, "text"), column_of(batch, "lang")
        for a, b in slices(text):
            bucket, row = trigrams(text.slice(a, b - a))
            names = lang.slice(a, b - a).dictionary_encode()
            index = names.indices.to_numpy(zero_copy_only=False)
            key, n = np.unique((index[row].astype(np.int64) << BUCKET_BITS) | bucket, return_counts=True)
            of, start = np.unique(key >> BUCKET_BITS, return_index=True)
            for k, x, y in zip(of.tolist(), start.tolist(), [*start[1:].tolist(), len(key)]):
                name = names.dictionary[k].as_py()
                if name not in totals:
                    if len(totals) == TABLES:  # so many labels don't fit in memory, so their counts are added up later
                        yield from _counted(totals)
                        totals = {}
                    totals[name] = np.zeros(1 << BUCKET_BITS, np.int64)
                totals[name][key[x:y] & ((1 << BUCKET_BITS) - 1)] += n[x:y]
    yield from _counted(totals)


def _counted(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, counts in totals.items():
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(counts[seen])], ["lang", "bucket", "n"])


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Component names, ``und`` last, and log probabilities (bucket, component), from all labelled documents.

    What reaches the driver is at most ``2**BUCKET_BITS`` numbers for each language.
    """
    used = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = used.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).toArrow().to_pylist()
    table.sort(key=lambda r: r["lang"])
    size = 1 << BUCKET_BITS
    n = np.zeros((size, len(table)))
    for k, r in enumerate(table):
        n[r["bucket"], k] = r["n"]
    even = np.full((size, 1), 1 / size)
    total = n.sum(1, keepdims=True)
    prior = 0.9 * total / max(1, total.sum()) + 0.1 * even
    languages = (n + 200 * prior) / (n.sum(0) + 200)
    # Of all trigrams few occur in any language: spread over those that occur, and some beyond
    spread = ((total > 0) + 0.05) / ((total > 0) + 0.05).sum()
    return [r["lang"] for r in table] + [UND], np.log(np.concatenate([languages, spread], 1)).astype(np.float32)


def segment_likelihoods(column: pa.Array, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segments, components) log likelihoods, the row of each segment, and its trigrams."""
    bucket, row = trigrams(column)
    if not len(bucket):
        return np.zeros((0, model.shape[1])), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    at = np.flatnonzero(new)
    within = np.arange(len(row)) - np.repeat(at, np.diff(np.append(at, len(row))))
    start = np.flatnonzero(within % SEGMENT == 0)
    size = np.diff(np.append(start, len(row)))
    return np.stack([np.add.reduceat(model[:, k][bucket], start, dtype=np.float64) for k in range(model.shape[1])], 1), row[start], size


def mixtures(like: np.ndarray, row: np.ndarray, rows: int, penalty: float = PENALTY, gain: float = GAIN) -> tuple[np.ndarray, np.ndarray]:
    """Shares (rows, components), 0 outside the set chosen, and the penalised log likelihood of each row.

    Rows without segments get no share at all.  All rows run together: a step
    of EM is one pass over the segments of the rows that still gain by it.
    """
    parts = like.shape[1]
    share = np.zeros((rows, parts))
    score = np.full(rows, -np.inf)
    present, start = np.unique(row, return_index=True)
    if not len(present):
        return share, score
    size = np.diff(np.append(start, len(row)))
    top = like.max(1)
    odds = np.exp(like - top[:, None])
    base = np.add.reduceat(top, start)
    cost = penalty / 2 * np.log(size + 1.0)

    def fit(which: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """EM for some of the present rows, each to its end."""
        shares, reached = allowed / allowed.sum(1, keepdims=True), np.full(len(which), -np.inf)
        left = np.arange(len(which))
        while len(left):
            n = size[which[left]]
            seg = np.concatenate([[0], np.cumsum(n)])[:-1]
            index = np.arange(n.sum()) - np.repeat(seg, n) + np.repeat(start[which[left]], n)
            o, pi, was = odds[index], shares[left], reached[left]
            while True:
                post = o * np.repeat(pi, n, axis=0)
                mixed = np.maximum(post.sum(1), 1e-300)
                now = np.add.reduceat(np.log(mixed), seg)
                going = now - was >= gain
                if 2 * going.sum() <= len(left):
                    break
                step = np.add.reduceat(post / mixed[:, None], seg, axis=0) / n[:, None]
                pi, was = np.where(going[:, None], step, pi), now
            shares[left], reached[left] = pi, now
            if going.any():
                step = np.add.reduceat(post / mixed[:, None], seg, axis=0) / n[:, None]
                shares[left[going]] = step[going]
            left = left[going]
        return shares, base[which] + reached

    live = np.arange(len(present))
    allowed = np.ones((len(present), parts), bool)
    pi, value = fit(live, allowed.astype(float))
    value -= cost * parts
    while len(live):
        live = live[allowed[live].sum(1) > 1]
        if not len(live):
            break
        least = np.where(allowed[live], pi[live], np.inf).argmin(1)
        fewer = allowed[live].copy()
        fewer[np.arange(len(live)), least] = False
        new_pi, new_value = fit(live, fewer.astype(float))
        new_value -= cost[live] * fewer.sum(1)
        better = new_value >= value[live]
        live = live[better]
        allowed[live], pi[live], value[live] = fewer[better], new_pi[better], new_value[better]
    share[present] = np.where(allowed, pi, 0)
    score[present] = value
    return share, score


def advantage(like: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """By how much the log likelihood of each row in no language exceeds that in the best one."""
    whole = np.zeros((rows, like.shape[1]))
    np.add.at(whole, row, like)
    return whole[:, -1] - whole[:, :-1].max(1, initial=-np.inf)


def _score(names: list[str], model: np.ndarray, max_und: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = column_of(batch, "text")
            for a, b in slices(text):
                like, row, size = segment_likelihoods(text.slice(a, b - a), model)
                share, _ = mixtures(like, row, b - a)
                count = np.bincount(row, weights=size, minlength=b - a).astype(np.int64)
                languages, shares = [], []
                for line in share[:, :-1]:
                    order = [k for k in np.lexsort((np.arange(len(line)), -line)) if line[k] > 0]
                    languages.append([names[k] for k in order])
                    shares.append([round(float(line[k]), 6) for k in order])
                und = np.where(count > 0, share[:, -1], 1.0)
                keep = (count > 0) & ~((und > max_und) & (advantage(like, row, b - a) >= EVIDENCE))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(a, b - a) for k in range(batch.num_columns) if batch.schema.field(k).name != "text"),
                        pa.array(languages, pa.list_(pa.string())),
                        pa.array(shares, pa.list_(pa.float64())),
                        pa.array(np.round(und, 6)),
                        pa.array(count),
                        pa.array(keep),
                    ],
                    [*(n for n in batch.schema.names if n != "text"), "languages", "shares", "und_share", "trigrams", "keep"],
                )

    return run


def language_mixtures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_und: float = MAX_UND) -> DataFrame:
    """Languages of each document: ``(doc_id, languages, shares, und_share, trigrams, keep)``, a row for each row of docs.

    ``languages`` holds the chosen set by falling share (ties by name), ``shares`` their
    proportions of the text; ``und_share`` is the rest.  ``keep`` is false where ``und_share`` exceeds
    ``max_und`` and the text is likelier to be in no language than in any one by ``EVIDENCE``.

    Null, empty and letterless texts have no trigram: no language,
    ``und_share`` 1 and ``keep`` false.  If no document is labelled, no text
    is in any known language.  Null ids keep their rows; a null label only means that the
    document takes no part in training.  Repeated rows are judged each; texts of any length are read to
    their end.  Other columns, whatever their names, are ignored.
    """
    names, model = train(docs, lang_col, text_col)
    used = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return used.mapInArrow(_score(names, model, max_und), "doc_id long, languages array<string>, shares array<double>, und_share double, trigrams long, keep boolean")


def drop_rejected(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_und: float = MAX_UND) -> DataFrame:
    """The rows of docs in some known language, unchanged, with all their columns, whatever their names.

    Null, empty and letterless texts go.  Repeated rows are judged each, and alike; null ids don't matter. A null label
    only means that the row takes no part in training; without any label all rows go.  Texts of any length are read to
    their end, and of equal shares ``und`` is dropped last.  An empty table stays empty.
    """
    names, model = train(docs, lang_col, text_col)
    score = _score(names, model, max_und)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = column_of(batch, text_col)
            for found in score([pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), text], ["at", "text"])]):
                index = column_of(found, "at").filter(column_of(found, "keep"))
                if len(index):
                    yield batch.take(index)

    return docs.mapInArrow(run, docs.schema)
