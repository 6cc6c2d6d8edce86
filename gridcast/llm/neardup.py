"""Near-duplicate documents by SimHash and meet-in-the-middle ball hashing.

A document's set of words and of pairs of adjoining words is projected on
``POOL`` random directions; the signs are its sketch.  Pairs keep long texts apart,
whose sets of words may exhaust the vocabulary.  Several permutations of the
sketch are each cut into fingerprints of ``BITS`` bits, ``TABLES`` in all.  Two fingerprints at distance
``2 * HALF`` or less share a variant that is at most ``HALF`` bits from either.
So every fingerprint emits its ball of radius ``HALF``, the variants are
shuffled, and documents that meet on a variant are candidates.

Variants are routed by a few of their bits, so those that leave these bits alone
travel as one entry; a task takes one route of one table at a time and emits the rest of the ball there.
Each entry has ``CHECK`` further bits of the sketch: pairs that differ in more
than ``MAX_CHECK`` of them are chance neighbours and go no further.  Documents that are connected
by the pairs left are compared on their whole sketches, all with all (a document
that is already connected isn't compared again).

Texts are read once; what is shuffled is fixed-size numbers, in blocks.  The number of routes
grows with the documents and has no influence on what is found.  With the number of documents
chance neighbours would grow as well, so from 2**27 documents on fingerprints are a byte longer, and
there are as many tables as keep the recall (``shape``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, node_id, spare
from .textarrays import Words, column_of, mix64, slices

#: So many that of two sketches at MAX_DISTANCE 0.91 meet in some table; of nearer ones more.
TABLES, BITS, HALF = 80, 32, 1
#: Bits of a sketch; each is in TABLES * BITS / POOL tables.
POOL = 512
#: Of POOL bits; a fifth is an angle of 0.63, a cosine of 0.81 between sets of words and pairs.
MAX_DISTANCE = POOL // 5
#: Of two sketches at MAX_DISTANCE one in 6,000 differs in more of the CHECK bits, of unrelated ones 97 %.
CHECK, MAX_CHECK = 64, 24
#: Entries of a route of a table, about; a task holds one at a time.
PER_ROUTE = 1 << 21
#: Variants that are sorted at once.
VARIANTS = 1 << 22
#: Buckets up to this size are compared pair by pair.
SMALL = 16

_SALTS = np.random.default_rng(20240229).integers(1, 1 << 63, POOL // 64).astype(np.uint64)


def shape(documents: int) -> tuple[int, int]:
    """Bits of a fingerprint, and tables."""
    bits = BITS + 8 * max(0, -(-((documents >> 27).bit_length()) // 7))
    share = MAX_DISTANCE / POOL
    meet = sum(math.comb(bits, d) * share**d * (1 - share) ** (bits - d) for d in range(2 * HALF + 1))
    return bits, TABLES if bits == BITS else math.ceil(math.log(0.09) / math.log(1 - meet))


def _signs(row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
    """For each row POOL bits: what most of its distinct features have there, 0 in a tie.

    Counts are kept as bit planes, and those of a row added up two by two.
    """
    shift = np.uint64(40)  # of a feature so many bits count, the same ones in any batch
    key = np.sort((row.astype(np.uint64) << shift) | (feature >> np.uint64(24)))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]]
    size = np.bincount((key >> shift).astype(np.int64), minlength=rows)
    value = key & ((np.uint64(1) << shift) - np.uint64(1))
    out = np.zeros((rows, len(_SALTS)), np.uint64)
    step = max(1, min(len(_SALTS), (1 << 18) // (len(value) + 1)))
    full, none = ~np.uint64(0), np.uint64(0)
    with np.errstate(over="ignore"):
        for k in range(0, len(_SALTS), step):
            planes, left = [mix64(value[:, None] + _SALTS[k : k + step])], size
            while left.max(initial=0) > 1:
                half = (left + 1) // 2
                turn = 2 * (np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half))
                one = np.repeat(np.cumsum(left) - left, half) + turn
                lone = turn + 1 >= np.repeat(left, half)
                other, keep = np.where(lone, one, one + 1), np.where(lone, none, full)[:, None]
                carry, added = np.zeros((len(one), planes[0].shape[1]), np.uint64), []
                for plane in planes:
                    x, y = plane[one], plane[other] & keep
                    differ = x ^ y
                    added.append(differ ^ carry)
                    carry = (x & y) | (carry & differ)
                planes, left = [*added, carry], half
            some = size > 0
            more, same = np.zeros_like(planes[0]), np.full_like(planes[0], full)
            for j in reversed(range(len(planes))):  # the count exceeds half the size
                bit = np.where((size[some] // 2 >> j) & 1, full, none)[:, None]
                more |= same & planes[j] & ~bit
                same &= ~(planes[j] ^ bit)
            out[some, k : k + step] = more
    return out


def sketch(words: Words) -> np.ndarray:
    """POOL bits of each text, packed into bytes."""
    inner = words.row[1:] == words.row[:-1] if len(words) else np.zeros(0, bool)
    with np.errstate(over="ignore"):
        pair = mix64(words.hash[:-1] * np.uint64(3) + words.hash[1:])[inner] if len(inner) else words.hash[:0]
    row = np.concatenate([words.row, words.row[:-1][inner] if len(inner) else words.row[:0]])
    return _signs(row, np.concatenate([words.hash, pair]), words.rows).view(np.uint8)


@lru_cache(4)
def _places(bits: int = BITS, tables: int = TABLES) -> tuple[np.ndarray, np.ndarray]:
    """The bits of the sketch that each table takes, and those with which it checks."""
    rng = np.random.default_rng(20240301)
    place = np.concatenate([rng.permutation(POOL) for _ in range(-(-tables * bits // POOL))])[: tables * bits].reshape(tables, bits)
    return place, np.stack([rng.permutation(np.setdiff1d(np.arange(POOL), p))[:CHECK] for p in place])


def _packed(loose: np.ndarray, width: int) -> np.ndarray:
    """Rows of at most 64 bits as numbers, the first bit lowest."""
    out = np.zeros((len(loose), 8), np.uint8)
    part = np.packbits(loose[:, :width], axis=1, bitorder="little")
    out[:, : part.shape[1]] = part
    return out.view(np.uint64)[:, 0]


def _matrix(column: pa.Array) -> np.ndarray:
    """Sketches as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, POOL // 8)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = column_of(batch, "text")
        for a, b in slices(text):
            words = Words(text.slice(a, b - a))
            yield pa.RecordBatch.from_arrays(
                [*(column_of(batch, c).slice(a, b - a) for c in ("node", "id", "same")), pa.array(np.diff(words.first) > 0), pa.array([x.tobytes() for x in sketch(words)], pa.binary())],
                ["node", "id", "same", "worded", "bits"],
            )


def _emit(route: int, bits: int, tables: int) -> Callable:
    """Blocks of entries for each route of each table: first those that stand for all their variants there, then single variants."""
    place, check = _places(bits, tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ref = column_of(batch, "ref").to_numpy()
            base = int(ref[0])  # rows of a partition are numbered in order
            number = (ref - base).astype(np.uint32)
            loose = np.unpackbits(_matrix(column_of(batch, "bits")), axis=1)
            for table in range(tables):
                fp, extra = _packed(loose[:, place[table]], bits), _packed(loose[:, check[table]], CHECK)
                key = np.concatenate([fp] + [fp ^ np.uint64(1 << k) for k in range(route)])
                to = key & np.uint64((1 << route) - 1)
                single = np.repeat(np.arange(1 + route) > 0, len(fp))
                order = np.lexsort((single, to))
                at, to = order % len(fp), to[order]
                start = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                stop = np.append(start[1:], len(to))
                whole = np.add.reduceat((~single[order]).astype(np.int32), start)
                parts = (key[order] >> np.uint64(route)).astype(np.uint32), number[at], extra[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((to[start].astype(np.int64) * tables + table)),
                        pa.array(np.full(len(start), base)),
                        pa.array(whole.astype(np.int32)),
                        pa.array([b"".join(p[a:b].tobytes() for p in parts) for a, b in zip(start.tolist(), stop.tolist())], pa.binary()),
                    ],
                    ["route", "base", "whole", "entries"],
                )

    return run


def _meet(rest: int) -> Callable:
    """Connected candidates as (bucket, ref); rows are sorted by route, of whose variants ``rest`` bits are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None
        for batch in batches:
            columns = [column_of(batch, k) for k in ("route", "base", "whole", "entries")]
            for route, base, whole, entries in zip(*(c.to_pylist() for c in columns[:3]), columns[3]):
                if held and route != at:
                    yield from _grouped(*_gathered(held), rest)
                    held = []
                at = route
                held.append((base, whole, entries.as_buffer()))
        if held:
            yield from _grouped(*_gathered(held), rest)

    return run


def _gathered(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, ref, check bits, and whether the entry stands for all its variants."""
    out = []
    for base, whole, entries in held:
        n = entries.size // 16
        raw = np.frombuffer(entries, np.uint8)
        out.append((raw[: 4 * n].view(np.uint32), base + raw[4 * n : 8 * n].view(np.uint32).astype(np.int64), raw[8 * n :].copy().view(np.uint64), np.arange(n) < whole))
    return tuple(np.concatenate(x) for x in zip(*out))


def _grouped(key: np.ndarray, ref: np.ndarray, check: np.ndarray, whole: np.ndarray, rest: int) -> Iterator[pa.RecordBatch]:
    one, other = _collisions(key.astype(np.uint64), check, whole, rest)
    if not len(one):
        return
    some, at = np.unique(np.concatenate([one, other]), return_inverse=True)
    label = joined(len(some), at[: len(one)], at[len(one) :])
    order = np.argsort(label, kind="stable")
    member, label = ref[some[order]], label[order]
    start = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
    with np.errstate(over="ignore"):  # the name follows from the members
        name = np.add.reduceat(mix64(member.view(np.uint64)), start)
    name = np.repeat(name.view(np.int64), np.diff(np.append(start, len(member))))
    yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(member)], ["bucket", "ref"])


def _collisions(key: np.ndarray, check: np.ndarray, whole: np.ndarray, rest: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries that share a variant and most check bits; of many on one variant a forest with the same components."""
    index = np.arange(len(key), dtype=np.uint64)
    mine, single = np.flatnonzero(whole), np.flatnonzero(~whole)
    total = len(mine) * (1 + rest) + len(single)
    cuts = min(rest, max(0, -(-total // VARIANTS) - 1).bit_length())
    low = rest - cuts
    top = (key >> np.uint64(low)).astype(np.int64)
    shift = np.uint64(32)
    pairs: list[np.ndarray] = []
    for part in range(1 << cuts):  # variants by their uppermost bits
        stay, here = mine[top[mine] == part], single[top[single] == part]
        chunk = [(key[stay] << shift) | index[stay], (key[here] << shift) | index[here]]
        chunk += [((key[stay] ^ np.uint64(1 << k)) << shift) | index[stay] for k in range(low)]
        for k in range(cuts):
            come = mine[top[mine] == part ^ (1 << k)]
            chunk.append(((key[come] ^ np.uint64(1 << (low + k))) << shift) | index[come])
        variants = np.sort(np.concatenate(chunk))
        value = variants >> shift
        same = value[1:] == value[:-1]
        many = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(value) > 1 else np.zeros(len(value), bool)
        value, at = value[many], (variants[many] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if not len(at):
            continue
        start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        size = np.diff(np.append(start, len(at)))
        few = np.flatnonzero(np.repeat(size <= SMALL, size))
        for k in range(1, SMALL):
            few = few[few + k < len(at)]
            few = few[value[few] == value[few + k]]
            if not len(few):
                break
            a, b = at[few], at[few + k]
            ok = np.bitwise_count(check[a] ^ check[b]) <= MAX_CHECK
            pairs.append(np.unique((np.minimum(a, b)[ok] << 32) | np.maximum(a, b)[ok]))
        for k in np.flatnonzero(size > SMALL).tolist():
            part_ = at[start[k] : start[k] + size[k]]
            a, b = _reached(check[part_], lambda x, y: np.bitwise_count(x ^ y) <= MAX_CHECK)
            pairs.append((part_[a] << 32) | part_[b])
    found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return found >> 32, found & 0xFFFFFFFF


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component under the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            far = label[label]
            if (far == label).all():
                break
            label = far
        left = label[a] != label[b]
        a, b = a[left], b[left]
    return label


def _settle(max_distance: int) -> Callable:
    """Edges that connect what is near inside each bucket; rows are sorted by bucket."""

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) <= max_distance

    def edges(name: np.ndarray, node: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((node, name))
        name, node, bits = name[order], node[order], bits[order].view(np.uint64)
        start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        size = np.diff(np.append(start, len(name)))
        pairs = [np.zeros((0, 2), np.int64)]
        few = np.flatnonzero(np.repeat(size <= SMALL, size))  # all pairs
        for k in range(1, SMALL):
            few = few[few + k < len(name)]
            few = few[name[few] == name[few + k]]
            a = few[near(bits[few], bits[few + k])]
            pairs.append(np.stack([node[a], node[a + k]], 1))
        for k in np.flatnonzero(size > SMALL).tolist():
            part = slice(start[k], start[k] + size[k])
            a, b = _reached(bits[part], near)
            pairs.append(np.stack([node[part][a], node[part][b]], 1))
        found = np.unique(np.concatenate(pairs), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            name, node, bits = column_of(batch, "bucket").to_numpy(), column_of(batch, "node").to_numpy(), _matrix(column_of(batch, "bits"))
            last = int(np.searchsorted(name, name[-1]))  # the last bucket may go on
            if last:
                yield edges(*(np.concatenate(x) for x in zip(*held, (name[:last], node[:last], bits[:last]))))
                held = []
            held.append((name[last:], node[last:], bits[last:]))
        if held:
            yield edges(*(np.concatenate(x) for x in zip(*held)))

    return run


def _reached(bits: np.ndarray, near: Callable) -> tuple[list[int], list[int]]:
    """Edges (a, b), a forest with the connected components of all near pairs: each row meets all that no row has reached yet."""
    one, other, left, todo = [], [], np.arange(len(bits)), []
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
        at = todo.pop()
        hit = near(bits[at], bits[left])
        found, left = left[hit].tolist(), left[~hit]
        one += [at] * len(found)
        other += found
        todo += found
    return one, other


def near_edges(sketches: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Edges (a, b) between ``sketches(node, bits)`` that connect all pairs near each other that meet in some table.

    sketches is read several times and must give the same rows in the same order, as a checkpoint does.
    """
    known = sketches.select("node", "bits").withColumn("ref", F.monotonically_increasing_id())
    documents = known.count()
    bits, tables = shape(documents)
    route = max(2, bits - 32, (documents // PER_ROUTE).bit_length())
    entries = documents * tables * (1 + route)
    parts = max(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(tables << route, entries >> 18))  # 4 MB each, if routes are so small
    blocks = known.mapInArrow(_emit(route, bits, tables), "route long, base long, whole int, entries binary")
    met = blocks.repartition(parts, "route").sortWithinPartitions("route").mapInArrow(_meet(bits - route), "bucket long, ref long")
    members = met.distinct().join(known, "ref").select("bucket", "node", "bits")
    return members.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_settle(max_distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Documents that copy another one: ``(doc_id, kept_doc_id, exact, node)``.

    One row for each document that has an equal or nearly equal document with a
    lower id (of equal ids, a lower hash of the text); ``kept_doc_id`` is the least id of
    its group, which has no row.  ``exact`` says that its text equals that of
    the one kept.  Groups are connected components of verified pairs.

    Rows with a null id, and null or empty texts, belong to no group.  Texts
    without any word are grouped only with equal texts.  Texts of any length are read
    to their end.  Rows equal in id and text count as one document; of equal ids the text of lower hash
    comes first.  An empty table gives no row.  Other columns, whatever their names, are ignored.
    """
    used = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(node_id(id_col, text_col).alias("node"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.lit(1), F.col(text_col)).alias("same"), F.col(text_col).alias("text"))
    sketches = cut(used.mapInArrow(_sketch, "node long, id long, same long, worded boolean, bits binary"))
    least = F.min(F.struct("id", "node")).alias("first")
    firsts = sketches.groupBy("same").agg(least, F.first("worded").alias("worded"), F.first("bits").alias("bits"), F.count_distinct("node").alias("n"))
    firsts = cut(firsts.select("same", F.col("first.node").alias("node"), "worded", "bits", "n"))
    copies = sketches.join(firsts.where("n > 1").select("same", F.col("node").alias("a")), "same").where("node <> a").select("a", F.col("node").alias("b"))
    near = near_edges(firsts.where("worded").select("node", "bits"), max_distance)
    labels = components(copies.unionByName(near))
    members = sketches.select("node", "id", "same").distinct().join(labels, "node")
    kept = members.groupBy("label").agg(F.min(F.struct("id", "node", "same")).alias("kept"))
    found = members.join(kept, "label").where(F.col("node") != F.col("kept.node"))
    return found.select(F.col("id").alias("doc_id"), F.col("kept.id").alias("kept_doc_id"), (F.col("same") == F.col("kept.same")).alias("exact"), "node")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group; of rows equal in id and text one stays.

    Rows outside the groups, with null ids or texts among them, are kept as they are, with
    all their columns; an empty table stays empty.
    """
    key, turn = spare(docs, "node"), spare(docs, "turn")
    gone = cut(near_duplicates(docs, id_col, text_col)).select(F.col("node").alias(key))
    kept = docs.withColumn(key, node_id(id_col, text_col)).join(gone, key, "left_anti")
    kept = kept.withColumn(turn, F.row_number().over(Window.partitionBy(key).orderBy(key)))  # the join has sorted by it
    return kept.where((F.col(turn) == 1) | F.col(id_col).isNull()).drop(key, turn)
