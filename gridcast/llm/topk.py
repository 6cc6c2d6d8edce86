"""Exact BM25 top-k search with MaxScore over document shards.

Every shard of documents holds the postings of the query words, with their
BM25 contributions and the largest one of each list.  For a query the lists
are added up by falling bound (the essential ones) until what the others
could still add, taken together, can't lift a new document over the k-th best score; the
others are only probed for documents that can still compete.  The shards'
best are merged.  Scores are rounded to six places before they are compared;
ties go to the lower id.

Counts and lengths are those of the whole table.  Queries are worked through in
blocks of bounded size, so their number may grow as well.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textarrays import WORD_RE, Words, column_of, slices

K, K1, B = 10, 1.2, 0.75
#: Characters of queries that are looked up in one pass over the documents.
QUERY_BLOCK = 20_000_000
#: Postings of a shard, about; a shard holds whole documents.
SHARD_POSTINGS = 2_000_000
_EPS = 2e-6


def _statistics(value: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(value) + 2, np.int64)  # documents with each word, documents, words
        for batch in batches:
            text = column_of(batch, "text")
            for a, b in slices(text):
                words = Words(text.slice(a, b - a))
                place = np.searchsorted(value, words.hash)
                found = value[np.minimum(place, len(value) - 1)] == words.hash
                pair = np.unique(words.row[found] * len(value) + place[found])
                total[:-2] += np.bincount(pair % len(value), minlength=len(value))
                total[-2] += b - a
                total[-1] += len(words)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["place", "n"])

    return run


class Shard:
    """Postings by query word: documents (ascending), contributions, and the bound of each list."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, ids: np.ndarray, terms: int):
        order = np.lexsort((doc, term))
        self.doc, self.impact, self.ids = doc[order], impact[order], ids
        self.at = np.searchsorted(term[order], np.arange(terms + 1))
        self.bound = np.zeros(terms)
        filled = np.flatnonzero(np.diff(self.at))
        if len(filled):
            self.bound[filled] = np.maximum.reduceat(self.impact, self.at[filled])
        self.score = np.zeros(len(ids))

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rounded scores and ids of the best k documents."""
        bound = self.bound[terms] * weight
        use = np.flatnonzero(bound > 0)
        use = use[np.argsort(-bound[use], kind="stable")]
        rest = np.append(np.cumsum(bound[use][::-1])[::-1], 0.0)  # what lists from here on can add
        score, least, n = self.score, 0.0, 0
        score[:] = 0
        while n < len(use) and rest[n] >= least - _EPS:  # essential lists
            part = slice(self.at[terms[use[n]]], self.at[terms[use[n]] + 1])
            score[self.doc[part]] += self.impact[part] * weight[use[n]]
            n += 1
            if len(score) > k:
                least = max(least, np.partition(score, len(score) - k)[len(score) - k])
        some = np.flatnonzero((score > 0) & (score + rest[n] >= least - _EPS))
        held = score[some]
        for j in range(n, len(use)):  # the others are probed
            part = slice(self.at[terms[use[j]]], self.at[terms[use[j]] + 1])
            docs = self.doc[part]
            place = np.minimum(np.searchsorted(docs, some), len(docs) - 1)
            held = held + np.where(docs[place] == some, self.impact[part][place] * weight[use[j]], 0)
            if len(held) > k:
                least = max(least, np.partition(held, len(held) - k)[len(held) - k])
            ok = held + rest[j + 1] >= least - _EPS
            some, held = some[ok], held[ok]
        held = np.round(held, 6)
        best = np.lexsort((self.ids[some], -held))[:k]
        return held[best], self.ids[some[best]]


def _search(queries: list[tuple[int, int, np.ndarray, np.ndarray]], value: np.ndarray, idf: np.ndarray, mean: float, k: int) -> Callable:
    def answer(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        term, doc, tf, ids, length = (np.concatenate(x) for x in zip(*parts))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
        shard = Shard(term, doc, impact, ids, len(value))
        out = [(item, query, *shard.search(terms, weight, k)) for item, query, terms, weight in queries]
        items, numbers, scores, found = zip(*out)
        size = [len(s) for s in scores]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(items, np.int64), size)), pa.array(np.repeat(np.array(numbers, np.int32), size)), pa.array(np.concatenate(found)), pa.array(np.concatenate(scores))], ["item_id", "query", "doc_id", "score"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        docs = postings = 0
        for batch in batches:
            text, ids = column_of(batch, "text"), column_of(batch, "doc_id").to_numpy()
            for a, b in slices(text):
                words = Words(text.slice(a, b - a))
                place = np.minimum(np.searchsorted(value, words.hash), len(value) - 1)
                found = value[place] == words.hash
                pair, tf = np.unique(words.row[found] * len(value) + place[found], return_counts=True)
                parts.append((pair % len(value), pair // len(value) + docs, tf.astype(np.float64), ids[a:b], np.diff(words.first).astype(np.float64)))
                docs, postings = docs + b - a, postings + len(pair)
                if postings >= SHARD_POSTINGS:
                    yield from answer(parts)
                    parts, docs, postings = [], 0, 0
        if parts:
            yield from answer(parts)

    return run


def top_documents(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """The k best documents of each query: ``(item_id, query, doc_id, score, rank)``; fewer where fewer share a word with it.

    ``queries`` has ``item_id`` and ``text``; every row is a query, and a word that it repeats counts as often.
    ``query`` numbers the rows of an ``item_id`` from 1 in the order of their texts, so repeated rows
    and further texts of an item have ranks of their own.
    Every row of docs is a document: repeated rows take several ranks.  Of equal scores the lower id comes first.

    Rows with a null id or text are left out on both sides; a text without
    words counts for the number of documents, and as a query it finds
    nothing.  Texts of any length are read to their end.  An empty table on either side gives no row.
    Other columns, whatever their names, are ignored.
    """
    used = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = queries.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")
    asked = asked.withColumn("query", F.row_number().over(Window.partitionBy("item_id").orderBy("text")))
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "query"), F.lit(blocks)) == block).orderBy("item_id", "query").collect()
        words = Words(pa.array([r.text for r in rows], pa.string()))
        value = np.unique(words.hash)
        if not len(value):
            continue
        place = np.searchsorted(value, words.hash)
        counts = [Counter(place[words.first[i] : words.first[i + 1]].tolist()) for i in range(len(rows))]
        wanted = [(r.item_id, r.query, np.array(list(c)), np.array(list(c.values()), float)) for r, c in zip(rows, counts) if c]
        n = {r.place: r.n for r in used.mapInArrow(_statistics(value), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}
        documents, mean = n.get(len(value), 0), n.get(len(value) + 1, 0) / max(1, n.get(len(value), 0))
        frequency = np.array([n.get(i, 0) for i in range(len(value))], float)
        idf = np.log(1 + (documents - frequency + 0.5) / (frequency + 0.5))
        part = used.mapInArrow(_search(wanted, value, idf, max(mean, 1e-9), k), "item_id long, query int, doc_id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, query int, doc_id long, score double, rank int")
    place = F.row_number().over(Window.partitionBy("item_id", "query").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


#: The same in DuckDB.
TOP_SQL = f"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD_RE}')) AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
l AS (SELECT doc_id, count(*) AS len FROM d GROUP BY doc_id),
s AS (SELECT (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) AS n, (SELECT sum(len) FROM l) AS total),
tf AS (SELECT doc_id, w, count(*) AS tf FROM d GROUP BY doc_id, w),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
a AS (SELECT item_id, text, row_number() OVER (PARTITION BY item_id ORDER BY text) AS query FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
q AS (SELECT item_id, query, w, count(*) AS qtf FROM (SELECT item_id, query, unnest(regexp_extract_all(lower(text), '{WORD_RE}')) AS w FROM a) GROUP BY ALL),
r AS (SELECT item_id, query, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * len / (total / n)))), 6) AS score
  FROM q JOIN tf USING (w) JOIN df USING (w) JOIN l USING (doc_id) CROSS JOIN s GROUP BY item_id, query, doc_id)
SELECT item_id, CAST(query AS INTEGER) AS query, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, query ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= {K}
"""
