"""Variable-capacity best-fit packing of documents into training sequences.

Best-fit decreasing treats equal lengths alike, so it runs on the *histogram*
of lengths: groups of equal bins are filled, split and opened by count.  The
histogram has at most as many entries as the largest capacity, whatever the
number of documents, and the outcome equals packing piece by piece.  What
it decides, runs of ranks among the pieces of one length, is then looked up
for every piece in parallel.

Several capacities are optimised jointly: a piece that fits no open bin opens
the capacity of least cost per token it can come to hold; in the end every
bin shrinks to the least capacity that takes its contents.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .textarrays import column_of

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Pieces that are ranked in one sort, about: even if all have one length, no task gets more.
RANKED = 1 << 20
#: A token is a word (letters, marks, digits) or another character that isn't white space.
TOKEN_RE = r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"


def sequence_cost(capacity: int) -> float:
    """Of a step over one sequence: a fixed part, a part by token and a part by pair of tokens."""
    return 64 + capacity + capacity * capacity / 32768


def token_count(text_col: str) -> Column:
    return F.regexp_count(F.col(text_col), F.lit(TOKEN_RE))


def plan(histogram: dict[int, int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> np.ndarray:
    """Rows (length, first rank, pieces, first bin, pieces a bin, offset, capacity, used) for the pieces of ``histogram``.

    The pieces of a length with ranks from ``first rank`` on go to bins from
    ``first bin`` on, so many in each, from ``offset`` on.  No length exceeds the largest capacity.
    """
    sizes = sorted(capacities)
    left = sum(s * n for s, n in histogram.items())
    rooms: list[int] = []  # residuals with an open group, ascending
    groups: dict[int, list[tuple[int, int, int]]] = {}  # residual: heap of (first bin, bins, capacity)
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def put(room: int, first: int, count: int, capacity: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        heapq.heappush(groups[room], (first, count, capacity))

    for s in sorted((k for k, n in histogram.items() if n), reverse=True):
        rank, todo = 0, histogram[s]
        while todo:
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                first, count, capacity = heapq.heappop(groups[room])
                if not groups[room]:
                    del groups[room], rooms[at]
                # best fit returns to the same bin as long as the piece fits, for what is left is the tightest room
                each = room // s
                full = min(count, todo // each)
                if full:
                    runs.append((s, rank, full * each, first, each, capacity - room))
                    put(room - each * s, first, full, capacity)
                    rank, todo = rank + full * each, todo - full * each
                    first, count = first + full, count - full
                if todo and count:
                    runs.append((s, rank, todo, first, todo, capacity - room))
                    put(room - todo * s, first, 1, capacity)
                    first, count, rank, todo = first + 1, count - 1, rank + todo, 0
                if count:
                    put(room, first, count, capacity)
                continue
            volume = left - rank * s
            capacity = min((c for c in sizes if c >= s), key=lambda c: (cost(c) / min(c, volume), c))
            each = capacity // s
            # bins of the same cost are opened at once, as long as the choice can't change
            whole = max(1, min(-(-todo // each), (volume - sizes[-1]) // capacity))
            put(capacity, bins, whole, capacity)
            bins += whole
        left -= histogram[s] * s
    ends, shown = [], []
    for room, heap in groups.items():
        for first, count, capacity in heap:
            used = capacity - room
            ends.append((first, first + count, next((c for c in sizes if c >= used), sizes[-1]), used))
    ends.sort()
    edges = [e[0] for e in ends]
    for s, rank, n, first, each, offset in runs:
        last = first + -(-n // each)
        k = bisect_left(edges, first + 1) - 1
        while first < last:
            stop = min(last, ends[k][1])
            part = min(n, (stop - first) * each)
            shown.append((s, rank, part, first, each, offset, ends[k][2], ends[k][3]))
            rank, n, first, k = rank + part, n - part, stop, k + 1
    return np.array(shown, np.int64).reshape(-1, 8)


def _place(slots: np.ndarray, base: int) -> Callable:
    order = np.lexsort((slots[:, 1], slots[:, 0]))
    slots = slots[order]
    key = slots[:, 0] * (1 << 40) + slots[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, rank = (column_of(batch, k).to_numpy() for k in ("n_tokens", "rank"))
            slot = slots[np.searchsorted(key, n.astype(np.int64) * (1 << 40) + rank, side="right") - 1]
            turn = rank - slot[:, 1]
            values = [slot[:, 3] + turn // slot[:, 4] + base, slot[:, 5] + turn % slot[:, 4] * n, slot[:, 6], slot[:, 7]]
            yield pa.RecordBatch.from_arrays(
                [*(column_of(batch, k) for k in ("doc_id", "piece", "start_token", "n_tokens")), pa.array(values[0]), *(pa.array(v.astype(np.int32)) for v in values[1:])],
                ["doc_id", "piece", "start_token", "n_tokens", "bin_id", "bin_offset", "capacity", "used"],
            )

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost, tokens: Column | None = None) -> DataFrame:
    """Where each piece of each document goes: ``(doc_id, piece, start_token, n_tokens, bin_id, bin_offset, capacity, used)``.

    A document longer than the largest capacity is cut into pieces of it and a
    rest; other documents are one piece.  All tokens are packed once, and
    ``bin_offset`` says from which token of its bin on a piece lies.  ``capacity`` is the
    final size of the bin, ``used`` what it holds.

    Texts that are null or have no token have no piece.  Null ids are packed
    under a null ``doc_id``; repeated rows are packed as often as they occur.
    Pieces of equal length are interchangeable; which of them goes where follows from hashes of id and text, whatever the layout of docs.
    Texts of any length are counted to their end.
    An empty table gives no row.  Other columns, whatever their names, are ignored.
    """
    largest = max(capacities)
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), (token_count(text_col) if tokens is None else tokens).cast("long").alias("n")).where("n > 0")
    whole = F.floor((F.col("n") - 1) / largest).cast("int")
    pieces = counted.select("doc_id", "h", "n", F.explode(F.sequence(F.lit(0), whole)).alias("piece"))
    start = F.col("piece").cast("long") * largest
    pieces = cut(pieces.select("doc_id", "h", "piece", start.alias("start_token"), F.least(F.lit(largest), F.col("n") - start).cast("int").alias("n_tokens")))
    histogram = {r.n_tokens: r.n for r in pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = 1 + sum(histogram.values()) // RANKED
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "h", "piece"), F.lit(parts)).cast("int"))
    own = F.row_number().over(Window.partitionBy("n_tokens", "part").orderBy("doc_id", "h", "piece"))
    before = F.sum("n").over(Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = pieces.groupBy("n_tokens", "part").agg(F.count(F.lit(1)).alias("n")).select("n_tokens", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.withColumn("own", own).join(offsets, ["n_tokens", "part"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    return ranked.mapInArrow(_place(plan(histogram, capacities, cost), 0), "doc_id long, piece int, start_token long, n_tokens int, bin_id long, bin_offset int, capacity int, used int")
