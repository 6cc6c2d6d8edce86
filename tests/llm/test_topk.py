"""MaxScore against full scoring, and the SQL."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest_llm import rows
from oracle import DATA, compare, connection

from gridcast.llm import topk
from gridcast.llm.queries import op8_maxscore_topk


def brute(docs, queries, k=topk.K):
    tokens = {d: t.split() for d, t in docs}
    n, mean = len(docs), sum(len(t.split()) for _, t in docs) / len(docs)
    df = Counter(w for t in tokens.values() for w in set(t))
    out = {}
    for q, text in queries:
        scored = []
        for d, t in tokens.items():
            tf = Counter(t)
            s = sum(c * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (topk.K1 + 1) / (tf[w] + topk.K1 * (1 - topk.B + topk.B * len(t) / mean)) for w, c in Counter(text.split()).items() if tf[w])
            if s:
                scored.append((-round(s, 6), d))
        out[q] = [(d, -s) for s, d in sorted(scored)[:k]]
    return out


def bench(spark, items):
    return spark.createDataFrame([(*q, "x") for q in items], "item_id long, text string, doc_id string")


def test_same_as_full_scoring(spark, make):
    rnd = random.Random(1)
    vocabulary = [f"w{k}" for k in range(200)]
    weights = [1 / (k + 1) for k in range(200)]
    docs = [(d, " ".join(rnd.choices(vocabulary, weights, k=rnd.randint(1, 60)))) for d in range(400)]
    docs += [(400 + d, docs[d][1]) for d in range(40)]  # ties
    queries = [(q, " ".join(rnd.choices(vocabulary, weights, k=rnd.randint(1, 25)))) for q in range(60)] + [(99, "unknown words"), (98, "w0 w0 w0")]
    want = brute(docs, queries)
    got = {}
    for r in topk.top_documents(make(docs), bench(spark, queries)).orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append((r.doc_id, r.score))
    assert set(got) == {q for q in want if want[q]}
    for q, found in got.items():
        assert [d for d, _ in found] == [d for d, _ in want[q]]
        assert [s for _, s in found] == pytest.approx([s for _, s in want[q]], abs=2e-6)


def test_shards_prune_without_loss():
    rnd = np.random.default_rng(3)
    for k in (1, 3, 10):
        terms, docs = 12, 300
        dense = np.where(rnd.random((terms, docs)) < 0.3, rnd.random((terms, docs)) * rnd.random((terms, 1)) * 5, 0)
        t, d = np.nonzero(dense)
        shard = topk.Shard(t, d, dense[t, d], np.arange(docs) * 7, terms)
        weight = rnd.integers(1, 3, terms).astype(float)
        score, ids = shard.search(np.arange(terms), weight, k)
        full = np.round(weight @ dense, 6)
        best = np.lexsort((np.arange(docs), -full))[:k]
        assert ids.tolist() == (best * 7).tolist() and score == pytest.approx(full[best])


def test_edges(spark, make):
    docs = make([(1, "red fish"), (1, "red fish"), (2, None), (3, ""), (None, "red"), (4, "blue " * 100_000)])
    out = topk.top_documents(docs, bench(spark, [(1, "RED"), (2, None), (None, "red"), (3, ""), (4, "blue!"), (5, "red"), (5, "red")]))
    assert rows(out.where("item_id = 1"), "doc_id", "rank") == [(1, 1), (1, 2)]
    assert {r.item_id for r in out.collect()} == {1, 4, 5}
    assert rows(out.where("item_id = 5"), "query", "doc_id", "rank") == [(1, 1, 1), (1, 1, 2), (2, 1, 1), (2, 1, 2)]
    assert topk.top_documents(make([]), bench(spark, [(1, "red")])).count() == 0
    assert topk.top_documents(docs, bench(spark, [])).count() == 0


def test_repeated_queries_and_the_sql(spark, make, tmp_path):
    rnd = random.Random(4)
    docs = make([(d, " ".join(rnd.choices("red blue green fish bird".split(), k=rnd.randint(1, 9)))) for d in range(40)])
    queries = bench(spark, [(5, "red"), (5, "red"), (5, "blue fish"), (6, "bird bird green")])
    got = topk.top_documents(docs, queries)
    assert len({r.doc_id for r in got.where("item_id = 5 and query = 3").collect()}) == 10
    docs.write.parquet(str(tmp_path / "d")), queries.write.parquet(str(tmp_path / "q"))
    con = duckdb.connect()
    for name, path in (("documents", "d"), ("benchmark", "q")):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / path}/*.parquet'")
    compare(got, topk.TOP_SQL, con)


def test_blocks_of_queries(spark, make, monkeypatch):
    docs, queries = make(["red fish", "blue fish", "one two"]), bench(spark, [(k, w) for k, w in enumerate(["red", "blue", "fish", "two"])])
    whole = rows(topk.top_documents(docs, queries), "item_id", "query", "doc_id", "score", "rank")
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    assert rows(topk.top_documents(docs, queries), "item_id", "query", "doc_id", "score", "rank") == whole


def test_sql(spark):
    compare(op8_maxscore_topk(spark, f"{DATA}/sf0.01"), topk.TOP_SQL, connection("sf0.01"))
