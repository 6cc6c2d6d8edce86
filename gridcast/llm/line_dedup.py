"""Repeated runs of lines, by a suffix array over line ids built by distributed prefix doubling.

Each document is a sequence of line ids.  The suffix starting at a line is
ranked by its first 1, 2, 4, ... lines: the rank by 2h lines sorts the pairs of
the rank by h lines and that of the suffix h lines on.  Only the distinct pairs
are sorted; a suffix that shares its prefix with no other is discarded at once (it
can't start a longer repeat), so after the first round only repeated text takes part.

All suffixes that share their first L lines are one longest-common-prefix
interval of that array.  For each suffix the deepest interval that has an
earlier member is looked for by halving: its length is found bit by bit, from the
highest level at which an earlier suffix has the same rank.  An interval is known by its
length and its earliest member, so a suffix and the interval's earliest member
(``_halve``) are all that is looked at in a step.  The runs found are maximal: they can't be
extended in either direction and still have an earlier copy.  The earliest copy stays and the
later ones are deleted.

No step has a window over equal lines or a task for each of them: what is grouped is first
combined where it lies, and joins on a hot key can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, node_id, spare
from .textarrays import column_of, slices, utf8

#: A run shorter than this many words stays, however often it occurs.
MIN_WORDS = 50

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = "struct<id:bigint,node:bigint,pos:int>"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = column_of(batch, "text")
        for a, b in slices(text):
            raw, off = utf8(text.slice(a, b - a))
            turn = np.flatnonzero(raw == 10)
            row_of = np.searchsorted(off, turn, side="right") - 1
            per = np.bincount(row_of, minlength=b - a) + 1
            first = np.concatenate([[0], np.cumsum(per)])
            start, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
            lead, tail = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
            lead[first[:-1]] = tail[first[1:] - 1] = True
            start[lead], start[~lead], end[tail], end[~tail] = off[:-1], turn + 1, off[1:], turn
            space = _SPACE[raw]
            begins = ~space
            begins[1:] &= space[:-1]
            edge = off[1:-1][off[1:-1] < len(raw)]
            begins[edge] = ~space[edge]
            upto = np.concatenate([[0], np.cumsum(begins)])
            words = upto[end] - upto[start]
            row = np.repeat(np.arange(b - a), per)
            line = np.arange(first[-1]) - first[row]
            keep = np.flatnonzero(words > 0)
            row = row[keep]
            if not len(row):
                continue
            pos = np.arange(len(row)) - np.searchsorted(row, row)
            whole = memoryview(np.ascontiguousarray(raw))
            h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(whole[s:e]) for s, e in zip(start[keep].tolist(), end[keep].tolist())), np.int64).reshape(-1, 2)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(column_of(batch, c).slice(a, b - a).take(at) for c in ("node", "id")), pa.array(pos.astype(np.int32)), pa.array(line[keep].astype(np.int32)), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(words[keep].astype(np.int32))],
                ["node", "id", "pos", "line", "h", "g", "words"],
            )


def document_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, id, pos, line, h, g, words) of each line with a word; pos counts those only, line all; h and g are 128 bits of hash."""
    used = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(node_id(id_col, text_col).alias("node"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return used.mapInArrow(_lines, "node long, id long, pos int, line int, h long, g long, words int")


def _place() -> Column:
    """Documents come in the order of their ids, of equal ids in that of their hashes."""
    return F.struct("id", "node", "pos")


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``keys`` that occur more than once, with their earliest place and a rank that sorts as they do."""
    some = rows.groupBy(*keys).agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return some.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("new", F.monotonically_increasing_id())


def _dense(min_words: int):
    """Lines in unbroken runs of repeated lines with enough words, and how many lines from each on hold so many (0: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column_of(batch, "lines")
            flat = lists.flatten()
            n = len(flat)
            if not n:
                continue
            pos, words = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("pos", "words"))
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            new = np.ones(n, bool)
            new[1:] = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1)
            start = np.flatnonzero(new)
            end = np.append(start[1:], n)
            part = np.cumsum(new) - 1
            total = np.concatenate([[0], np.cumsum(words)])
            stop = np.searchsorted(total, total[:-1] + min_words)
            need = np.where(stop <= end[part], np.maximum(stop - np.arange(n), 1), 0)
            keep = np.flatnonzero((total[end] - total[start])[part] >= min_words)
            if not len(keep):
                continue
            some, at = flat.take(pa.array(keep)), pa.array(row[keep])
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "node").take(at), column_of(batch, "id").take(at), *(some.field(k) for k in ("pos", "line", "words", "new")), pa.array(need[keep].astype(np.int32)), some.field("first")],
                ["node", "id", "pos", "line", "words", "rank", "need", "first"],
            )

    return run


def suffix_levels(lines: DataFrame, min_words: int) -> list[DataFrame]:
    """The suffix array of repeated lines by levels, each ``(node, id, pos, rank, need, first)``; level 0 also has line and words.

    A row of level k ranks the suffix at ``pos`` by its first 2**k lines, the first of
    which are at ``first``; there is none where no other suffix shares them.
    """
    again = lines.join(ranked(lines, ["h", "g"]), ["h", "g"])
    listed = again.groupBy("node").agg(F.min("id").alias("id"), F.sort_array(F.collect_set(F.struct("pos", "line", "words", "new", "first"))).alias("lines"))
    live = cut(listed.mapInArrow(_dense(max(1, min_words)), f"node long, id long, pos int, line int, words int, rank long, need int, first {_PLACE}"))
    levels = [live]
    while not live.isEmpty():
        step = 1 << (len(levels) - 1)
        ahead = Window.partitionBy("node").orderBy("pos").rangeBetween(step, step)
        pairs = live.select("node", "id", "pos", "rank", "need", F.max("rank").over(ahead).alias("next")).where("next is not null")
        live = cut(pairs.join(ranked(pairs, ["rank", "next"]), ["rank", "next"]).select("node", "id", "pos", F.col("new").alias("rank"), "need", "first"))
        levels.append(live)
    return levels[:-1] if len(levels) > 1 else levels


def _later(level: DataFrame, k: int) -> DataFrame:
    """States (node, id, pos, size, first) of suffixes whose first 2**k lines have an earlier copy and may be part of a long enough run."""
    rows = level.where((_place() != F.col("first")) & F.col("need").between(1, (2 << k) - 1))
    return rows.select("node", "id", "pos", F.lit(1 << k).alias("size"), "first")


def _halve(states: DataFrame, level: DataFrame, k: int) -> DataFrame:
    """States that are 2**k lines longer where such a prefix has an earlier copy.

    Of suffixes with the same state, an earlier copy of a longer prefix is one of them or their common first:
    whatever else shares the prefix was overtaken by an earlier one.
    """
    firsts = states.select("size", "first").distinct().select("first.node", "first.id", "first.pos", "size", "first", F.lit(False).alias("own"))
    asked = states.withColumn("own", F.lit(True)).unionByName(firsts).withColumn("at", F.col("pos") + F.col("size"))
    met = asked.join(level.select("node", F.col("pos").alias("at"), "rank"), ["node", "at"])
    key = ["size", "first", "rank"]
    least = met.groupBy(*key).agg(F.min(_place()).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    longer = met.where("own").join(least, key).where(_place() != F.col("least")).select("node", "pos", F.col("least").alias("found"))
    grown = states.join(longer, ["node", "pos"], "left")
    return grown.select("node", "id", "pos", F.when(F.col("found").isNull(), F.col("size")).otherwise(F.col("size") + (1 << k)).alias("size"), F.coalesce("found", "first").alias("first"))


def _maximal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each document that no other run of it contains."""
    for batch in batches:
        lines, runs = column_of(batch, "lines"), column_of(batch, "runs")
        if not batch.num_rows:
            continue
        flat, found = lines.flatten(), runs.flatten()
        low = lines.offsets.to_numpy() - lines.offsets[0].as_py()
        pos, line, words = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("pos", "line", "words"))
        row = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
        start, size = (found.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("pos", "size"))
        # ends never fall from one start to the next, so a run is contained in an earlier one exactly if it ends with the one before
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (start[1:] + size[1:] != start[:-1] + size[:-1])
        row, start, size = row[keep], start[keep], size[keep]
        span = np.int64(1) << 32
        place = np.searchsorted(np.repeat(np.arange(len(lines)), np.diff(low)) * span + pos, row * span + start)
        total = np.concatenate([[0], np.cumsum(words)])
        at = pa.array(row)
        values = [line[place], line[place + size - 1] + 1, size, total[place + size] - total[place]]
        yield pa.RecordBatch.from_arrays(
            [column_of(batch, "id").take(at), *(pa.array(v.astype(np.int32)) for v in values), found.field("source").filter(pa.array(keep)), column_of(batch, "node").take(at)],
            ["doc_id", "start_line", "end_line", "n_lines", "n_words", "first_doc_id", "node"],
        )


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Maximal runs of lines that occurred before: ``(doc_id, start_line, end_line, n_lines, n_words, first_doc_id, node)``.

    A run holds ``min_words`` words at least and occurs as a whole, line for line, at an
    earlier place: in a document of lower id (of equal ids, of lower hash) or
    further up in the same one, where the two may overlap.  No other such run of the document contains
    it; runs with different sources may overlap.  ``start_line`` to
    ``end_line`` count from 0, end exclusive; ``n_lines`` and ``n_words``
    leave out lines without words, which are no part of the sequence.
    ``first_doc_id`` is the document with the earliest copy of the whole run.

    Lines are equal if all their bytes are (128 bits of hash are compared); texts are read to
    their end, however long.  Rows with null id or text, and empty texts, give
    nothing; rows equal in id and text count as one document.  An empty table gives no row.
    Other columns, whatever their names, are ignored.
    """
    lines = cut(document_lines(docs, id_col, text_col))
    levels = suffix_levels(lines, min_words)
    states = None
    for k in reversed(range(len(levels))):
        starts = _later(levels[k], k)
        if states is not None:
            longer = _halve(states, levels[k], k)
            starts = longer.unionByName(starts.join(states.select("node", "pos"), ["node", "pos"], "left_anti"))
        states = cut(starts)
    need = levels[0].select("node", "pos", "need").where("need > 0")
    runs = states.join(need, ["node", "pos"]).where("size >= need").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "size", F.col("first.id").alias("source")))).alias("runs"))
    listed = levels[0].groupBy("node").agg(F.min("id").alias("id"), F.sort_array(F.collect_list(F.struct("pos", "line", "words"))).alias("lines"))
    return listed.join(runs, "node").mapInArrow(_maximal, "doc_id long, start_line int, end_line int, n_lines int, n_words int, first_doc_id long, node long")


def delete_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the lines of repeated runs.

    Lines without words inside a run go with it.  A document of which no word
    is left goes altogether, as its text lives on in earlier ones; so do rows that repeat it.
    ``length_col``, if docs has it, is set to the new number of characters where lines went.
    Documents without repeats, with null ids or texts, and empty ones stay as they are, with all
    their columns, whatever their names; texts of any length are treated alike.  Of equal texts the one of lowest id stays.
    """
    key, gone, left = spare(docs, "node"), spare(docs, "gone"), spare(docs, "left")
    spans = repeated_runs(docs, id_col, text_col, min_words).groupBy(F.col("node").alias(key)).agg(F.collect_list(F.struct("start_line", "end_line")).alias(gone))
    joined = docs.withColumn(key, node_id(id_col, text_col)).join(cut(spans), key, "left")
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.exists(gone, lambda g: (i >= g.start_line) & (i < g.end_line)))
    changed = F.col(gone).isNotNull() & F.col(id_col).isNotNull()
    out = joined.withColumn(left, F.when(changed, F.array_join(kept, "\n")).otherwise(F.col(text_col)))
    out = out.where(~changed | F.col(left).rlike(r"\S"))
    values = {text_col: F.col(left)}
    if length_col and length_col in docs.columns:
        values[length_col] = F.when(changed, F.length(left).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col))
    return out.withColumns(values).select(*docs.columns)


#: The same in DuckDB, from all pairs of equal lines: successive pairs on one diagonal are a common run.
RUNS_SQL = rf"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
u AS (SELECT doc_id, unnest(lines) AS x, unnest(range(len(lines))) AS line FROM s),
w AS (SELECT *, len(regexp_extract_all(x, '[^ \t\n\v\f\r]+')) AS words FROM u),
l AS (SELECT *, row_number() OVER d - 1 AS pos, sum(words) OVER d AS upto FROM w WHERE words > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY line)),
p AS (SELECT a.doc_id, b.doc_id AS source, a.pos, a.pos - b.pos AS shift FROM l a JOIN l b ON a.x = b.x AND (b.doc_id, b.pos) < (a.doc_id, a.pos)),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, source, shift ORDER BY pos) AS island FROM p),
r AS (SELECT doc_id, source, min(pos) AS a, max(pos) AS b FROM i GROUP BY doc_id, source, shift, island),
f AS (SELECT r.doc_id, a, b, min(source) AS first_doc_id, any_value(y.upto - x.upto + x.words) AS n_words, any_value(x.line) AS start_line, any_value(y.line) + 1 AS end_line
  FROM r JOIN l x ON x.doc_id = r.doc_id AND x.pos = a JOIN l y ON y.doc_id = r.doc_id AND y.pos = b WHERE y.upto - x.upto + x.words >= {MIN_WORDS} GROUP BY r.doc_id, a, b)
SELECT doc_id, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, CAST(b - a + 1 AS INTEGER) AS n_lines, CAST(n_words AS INTEGER) AS n_words, first_doc_id
FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.doc_id = f.doc_id AND g.a <= f.a AND g.b >= f.b AND (g.a, g.b) <> (f.a, f.b))
"""
