"""Benchmark passages in documents, by CGK embedding and bit-sampling LSH.

Texts are sequences of words.  An item of n words *leaks* into a document when
some stretch of the document is within ``tolerance(n)`` word edits
(insert, delete, replace) of it.

1. Every word position of every document starts a window of n words for each length n
   of items.  A window within k edits of an item of n words shares at least
   n - 2 - 3k word trigrams with it, so windows with fewer trigrams known to an
   item of that length are dropped.  So are windows that start more than 4k words
   before the first of these: k edits spare one of any 3k + 1 trigrams.  Known trigrams sit in
   a bit map that is sized by their number, alone and with their length; a false bit only keeps a
   window.  Items of one or two words are looked up by all of them.
2. A window and an item are embedded by the CGK random walk: at each step the
   current word is put out, and a random function of step and word says
   whether to advance.  Small edit distance becomes small Hamming distance.
   Each walk is sampled at ``STEPS`` steps, some of which make a key, and on the
   keys windows and items are joined.  There are as many walks, and as few steps in a key, as reach the target
   recall for items with all the edits allowed (``repetitions``).
3. Windows lie in *segments*, the stretches of a document that they cover together.
   Each segment and item that meet are verified by the exact edit distance of the item to every stretch of the segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, node_id, spare
from .textarrays import Words, column_of, mix64, slices, windows_of

TOLERANCE = 0.2
#: Share of the items with all edits allowed that meet the window at their place.
RECALL = 0.95
#: Steps at which a walk is sampled, and walks beyond which a key takes fewer of them.
STEPS, WALKS = 18, 8
GRAM = 3
#: Cells of the arrays that are worked on at once.
CELLS = 1 << 20


def tolerance(n: np.ndarray | int, share: float = TOLERANCE) -> np.ndarray:
    """Word edits allowed in an item of n words; few enough that a trigram survives."""
    n = np.asarray(n)
    return np.maximum(0, np.minimum((n * share + 1e-9).astype(np.int64), (n - 3) // 3))


def _cgk_keys(words: np.ndarray, walks: int, samples: int) -> np.ndarray:
    """walks * STEPS / samples keys for each row of words (uint64; 0 is the end)."""
    rows, n = words.shape
    steps, bands = 2 * n, STEPS // samples
    padded = np.concatenate([words, np.zeros((rows, 1), np.uint64)], 1)
    taken = np.stack([np.random.default_rng((n, walk)).integers(0, steps, (bands, samples)) for walk in range(walks)])
    wanted: dict[int, list[tuple[int, int, int]]] = {}
    for (walk, band, k), step in np.ndenumerate(taken):
        wanted.setdefault(int(step), []).append((walk, band, k))
    put = np.zeros((rows, walks, bands, samples), np.uint64)
    at = np.zeros((rows, walks), np.int64)
    row = np.arange(rows)[:, None]
    walk_noise = np.arange(1, walks + 1, dtype=np.uint64) << np.uint64(40)
    for step in range(steps):
        word = padded[row, at]
        for walk, band, k in wanted.get(step, ()):
            put[:, walk, band, k] = word[:, walk]
        at += ((mix64(word ^ mix64(walk_noise + np.uint64(step))) & np.uint64(1)) > 0) & (at < n)
    key = np.broadcast_to(mix64(np.arange(walks * bands, dtype=np.uint64).reshape(walks, bands) + np.uint64(n << 20)), (rows, walks, bands)).copy()
    with np.errstate(over="ignore"):
        for k in range(samples):
            key = mix64(key * np.uint64(0x100000001B3) + put[..., k])
    return key.reshape(rows, -1).view(np.int64)


@lru_cache(1000)
def _met(n: int, share: float, samples: int) -> np.ndarray:
    """Of random items of n words with ``tolerance(n)`` random edits, the share that has met the edited text after each of 4 * WALKS walks."""
    rng = np.random.default_rng(n)
    items = rng.integers(1, 1 << 62, (200, n)).astype(np.uint64)
    texts = np.zeros_like(items)
    for k, item in enumerate(items.tolist()):
        for _ in range(int(tolerance(n, share))):
            place, kind = int(rng.integers(len(item))), int(rng.integers(3))
            item[place : place + (kind > 0)] = [] if kind == 2 else [int(rng.integers(1, 1 << 62))]
        texts[k] = (item + rng.integers(1, 1 << 62, n).tolist())[:n]
    walks = 4 * WALKS if samples == 1 else WALKS
    met = (_cgk_keys(items, walks, samples) == _cgk_keys(texts, walks, samples)).reshape(len(items), walks, -1).any(2)
    return np.logical_or.accumulate(met, axis=1).mean(0)


def repetitions(n: int, share: float = TOLERANCE, recall: float = RECALL) -> tuple[int, int]:
    """Walks, and steps in a key, for items of n words: as many steps as reach the recall in WALKS walks, 3 at most.

    Lengths are rounded up by a fifth at most.  Above 1,024 words the walks grow
    with the root of the length, as the chance of a single walk to meet falls no faster.
    """
    if not tolerance(n, share):
        return 1, 3
    size = 8
    while size < min(n, 1024):
        size = min(1024, max(size + 1, size * 6 // 5))
    for samples in (3, 2, 1):
        reached = _met(size, share, samples)
        if reached[-1] >= recall or samples == 1:
            walks = int((reached >= recall).argmax()) + 1 if reached[-1] >= recall else int(np.ceil(len(reached) * np.log(1 - recall) / np.log(max(1e-9, 1 - reached[-1]))))
            return int(np.ceil(walks * max(1.0, n / 1024) ** 0.5)), samples
    raise AssertionError


class _Bits:
    """A set of numbers as bits by their uppermost ones; may hold others as well."""

    def __init__(self, data: bytes, width: int):
        self.data, self.shift = np.frombuffer(data, np.uint8), np.uint64(64 - width)

    def has(self, value: np.ndarray) -> np.ndarray:
        place = (value >> self.shift).astype(np.int64)
        return (self.data[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _gram(n: int) -> int:
    return min(GRAM, n)


def _of_length(grams: np.ndarray, n: int) -> np.ndarray:
    return mix64(grams + np.uint64(n))


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = column_of(batch, "text")
        for a, b in slices(text):
            words = Words(text.slice(a, b - a))
            size = np.diff(words.first)
            lists = pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), pa.array(words.hash.view(np.int64)))
            yield pa.RecordBatch.from_arrays([column_of(batch, "item_id").slice(a, b - a), pa.array(size.astype(np.int32)), lists], ["item_id", "n", "item"])


def _item_keys(walks: dict[int, tuple[int, int]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item_id, n, item in zip(*(column_of(batch, k).to_pylist() for k in ("item_id", "n", "item"))):
                h = np.array(item, np.int64).view(np.uint64)
                grams, _ = windows_of(h, np.array([0, n]), _gram(n))
                grams = mix64(grams)
                out.append({"item_id": item_id, "n": n, "grams": np.concatenate([grams, _of_length(grams, n)]).view(np.int64).tolist(), "keys": np.unique(_cgk_keys(h[None, :], *walks[n])).tolist()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("item_id", pa.int64()), ("n", pa.int32()), ("grams", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))]))

    return run


def _starts(words: Words, lengths: list[int], known: _Bits, share: float) -> tuple[np.ndarray, np.ndarray]:
    """First words and lengths of the windows with enough known trigrams."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for size in sorted({_gram(n) for n in lengths}):
        grams, index = windows_of(words.hash, words.first, size)
        grams = mix64(grams)
        met = known.has(grams)
        grams, index = grams[met], index[met]
        if not len(index):
            continue
        for n in (n for n in lengths if _gram(n) == size):
            edits = int(tolerance(n, share))
            need, reach = max(1, n - size + 1 - size * edits), n + edits
            hits = index[known.has(_of_length(grams, n))]
            if len(hits) < need:
                continue
            # need hits from hits[j] on lie in the window of each start from reach before the last of them up to hits[j]
            end = hits[need - 1 :]
            begin = hits[: len(end)]
            ok = (words.row[begin] == words.row[end]) & (end - begin <= reach - size)
            begin, end = begin[ok], end[ok]
            since = np.maximum(np.maximum(end - reach + size, begin - 4 * edits), words.first[words.row[begin]])
            mark = np.zeros(len(words) + 1, np.int32)
            np.add.at(mark, since, 1)
            np.add.at(mark, begin + 1, -1)
            start = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            found.append((start, np.full(len(start), n)))
    return tuple(np.concatenate(x) for x in zip(*found))


_WINDOWS = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("segment", pa.int32()), ("words", pa.list_(pa.int64())), ("start", pa.int32()), ("n", pa.int32()), ("keys", pa.list_(pa.int64()))])


def _window_rows(bits: Callable[[], _Bits], walks: dict[int, tuple[int, int]], share: float) -> Callable:
    """A row with words for each segment, and one with keys for each window."""
    lengths = sorted(walks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits()
        for batch in batches:
            text = column_of(batch, "text")
            for a, b in slices(text):
                words = Words(text.slice(a, b - a))
                start, n = _starts(words, lengths, known, share)
                if not len(start):
                    continue
                order = np.lexsort((n, start))
                start, n = start[order], n[order]
                last = words.first[1:][words.row[start]]  # the end of the window's document
                stop = np.minimum(start + n + tolerance(n, share), last)
                reach = np.maximum.accumulate(stop)
                new = np.concatenate([[True], start[1:] >= reach[:-1]])
                low = np.flatnonzero(new)
                segment = start[low]
                size = np.maximum.reduceat(stop, low) - segment
                node, doc = column_of(batch, "node").slice(a, b - a), column_of(batch, "doc_id").slice(a, b - a)

                def of(at: np.ndarray) -> list[pa.Array]:  # document and segment of windows or segments at these words
                    row = pa.array(words.row[at])
                    return [node.take(row), doc.take(row)]

                flat = np.repeat(segment - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())
                whole = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(words.hash[flat].view(np.int64)))
                none = pa.nulls(len(low), pa.int32())
                yield pa.RecordBatch.from_arrays([*of(segment), pa.array((segment - words.first[words.row[segment]]).astype(np.int32)), whole, none, none, pa.nulls(len(low), pa.list_(pa.int64()))], schema=_WINDOWS)
                of_segment = segment[np.cumsum(new) - 1]
                padded = np.append(words.hash, np.uint64(0))
                for length in np.unique(n).tolist():
                    mine = np.flatnonzero(n == length)
                    step = max(1, CELLS // (length + walks[length][0] * STEPS))
                    for k in range(0, len(mine), step):
                        part = mine[k : k + step]
                        at = start[part]
                        grid = at[:, None] + np.arange(length)
                        window = np.where(grid < last[part][:, None], padded[np.minimum(grid, len(words))], np.uint64(0))
                        keys = _cgk_keys(window, *walks[length])
                        base = words.first[words.row[at]]
                        yield pa.RecordBatch.from_arrays(
                            [
                                *of(at),
                                pa.array((of_segment[part] - base).astype(np.int32)),
                                pa.nulls(len(at), pa.list_(pa.int64())),
                                pa.array((at - base).astype(np.int32)),
                                pa.array(np.full(len(at), length, np.int32)),
                                pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel())),
                            ],
                            schema=_WINDOWS,
                        )

    return run


def nearest_stretch(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each item the least edit distance to a stretch of its text, and the first word of the first such stretch; all at once.

    Everything is taken backwards, so that a place in the last line of the table is where a stretch starts.
    """
    n, m = np.array([len(x) for x in items]), np.array([len(x) for x in texts])
    width = int(m.max(initial=0))
    item, text = np.zeros((len(items), int(n.max(initial=0))), np.int64), np.zeros((len(texts), width), np.int64)
    for k, (x, y) in enumerate(zip(items, texts)):
        item[k, : len(x)], text[k, : len(y)] = x[::-1], y[::-1]
    column = np.arange(width + 1)
    line = np.zeros((len(items), width + 1), np.int32)
    last = line.copy()
    for i in range(1, item.shape[1] + 1):
        step = np.empty_like(line)
        step[:, 0] = i
        step[:, 1:] = np.minimum(line[:, 1:] + 1, line[:, :-1] + (text != item[:, i - 1 : i]))
        # insertions along the line: step[j] = min over k <= j of step[k] + j - k
        line = (np.minimum.accumulate(step - column, axis=1) + column).astype(np.int32)
        done = n == i
        last[done] = line[done]
    last[column[None, :] > m[:, None]] = np.iinfo(np.int32).max
    best = last.min(1)
    return best, m - (width - (last == best[:, None])[:, ::-1].argmax(1))


def _verify(share: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, texts = (column_of(batch, k) for k in ("item", "words"))
            n, m = (np.diff(x.offsets.to_numpy()) for x in (items, texts))
            order = np.lexsort((m, n))
            k = 0
            while k < len(order):
                stop = k + 1
                while stop < len(order) and (stop + 1 - k) * max(m[order[k : stop + 1]]) <= CELLS and stop - k < 2048:
                    stop += 1
                part = order[k:stop]
                edits, start = nearest_stretch(*([x[i].values.to_numpy(zero_copy_only=False) for i in part.tolist()] for x in (items, texts)))
                at = pa.array(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(column_of(batch, c).take(at) for c in ("node", "doc_id", "item_id")),
                        pa.array((column_of(batch, "segment").to_numpy()[part] + start).astype(np.int32)),
                        pa.array(edits.astype(np.int32)),
                        pa.array(n[part].astype(np.int32)),
                        pa.array(edits <= tolerance(n[part], share)),
                    ],
                    ["node", "doc_id", "item_id", "start_word", "edits", "item_words", "near"],
                )
                k = stop

    return run


def _known(items: DataFrame) -> Callable[[], _Bits]:
    """The bit map of the items' trigrams, 32 bits for each or more; it grows with the benchmark only."""
    grams = items.select(F.explode("grams").alias("gram"))
    width = max(16, int(32 * max(1, grams.count()) - 1).bit_length())
    place = F.shiftrightunsigned("gram", 64 - width)
    rows = grams.groupBy(F.shiftright(place, 3).alias("byte")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(shiftrightunsigned(gram, {64 - width}) & 7 as int))")).alias("bits")).toArrow()
    data = np.zeros(1 << (width - 3), np.uint8)
    data[rows["byte"].to_numpy()] = rows["bits"].to_numpy()
    shared = items.sparkSession.sparkContext.broadcast(data.tobytes())
    return lambda: _Bits(shared.value, width)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = TOLERANCE, recall: float = RECALL) -> DataFrame:
    """Benchmark items found in documents: ``(doc_id, item_id, start_word, edits, item_words, node)``.

    One row for each document and item that leaks into it, with the least
    edit distance and the first word (from 0) of the first stretch at it.  Every item
    is looked for in every document; the stretch may lie anywhere.  ``share`` of the words of an item may be
    edited, and ``recall`` of the items with so many edits are found at least; unedited ones all are.

    Documents with a null id and null or empty texts give no row, nor do items
    with a null id or without words.  Items and documents of any length are treated alike.  Equal items are all
    reported.  Rows repeated in either table don't repeat the result; equal
    ids with other texts give a row each.  An empty table on either side gives no row.
    Other columns, whatever their names, are ignored.
    """
    named = benchmark.where(F.col("item_id").isNotNull() & (F.length("text") > 0)).select(F.col("item_id").cast("long"), "text")
    items = cut(named.mapInArrow(_item_words, "item_id long, n int, item array<long>").where("n > 0").distinct())
    walks = {r.n: repetitions(r.n, share, recall) for r in items.select("n").distinct().collect()}
    marked = cut(items.mapInArrow(_item_keys(walks), "item_id long, n int, grams array<long>, keys array<long>"))
    used = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(node_id(id_col, text_col).alias("node"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(used.mapInArrow(_window_rows(_known(marked), walks, share), "node long, doc_id long, segment int, words array<long>, start int, n int, keys array<long>"))
    keyed = rows.where("keys is not null").select("node", "segment", F.explode("keys").alias("key")).distinct()
    pairs = keyed.join(marked.select("item_id", "n", F.explode("keys").alias("key")), "key").select("node", "segment", "item_id", "n").distinct()
    segments = rows.where("words is not null").select("node", "doc_id", "segment", "words").dropDuplicates(["node", "segment"])
    found = pairs.join(segments, ["node", "segment"]).join(items, ["item_id", "n"])
    checked = found.select("node", "doc_id", "item_id", "segment", "item", "words").mapInArrow(_verify(share), "node long, doc_id long, item_id long, start_word int, edits int, item_words int, near boolean")
    best = checked.where("near").groupBy("node", "doc_id", "item_id").agg(F.min(F.struct("edits", "start_word", "item_words")).alias("best"))
    return best.select("doc_id", "item_id", "best.start_word", "best.edits", "best.item_words", "node")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those into which an item leaks; repeated rows go together.

    The others, null ids and null or empty texts among them, stay as they are, with all their columns,
    whatever their names; without items all stay.
    """
    key = spare(docs, "node")
    gone = cut(leaks(docs, benchmark, id_col, text_col).select(F.col("node").alias(key)).distinct())
    return docs.withColumn(key, node_id(id_col, text_col)).join(gone, key, "left_anti").drop(key)
