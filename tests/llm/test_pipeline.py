"""The pipeline's stages, each on what the one before kept."""

from collections import Counter

import corpus_pipeline
import pyarrow as pa
import regex
from oracle import DATA, connection
from test_language_id import plain_em
from test_line_dedup import brute as repeated_runs
from test_neardup import brute_groups as near_groups
from test_packing import naive as naive_bins

from gridcast.llm import language_id, packing
from gridcast.llm.queries import ORACLE_SQL, QUERIES

SF = f"{DATA}/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, []
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / f"{k}"))
        held.append(docs)
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    held.append(docs)
    texts = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in held[:5]]

    names, model = language_id.train(held[0])
    keep = set()
    for i, t in texts[0].items():
        like, _, _ = language_id.segment_likelihoods(pa.array([t]), model)
        total = [sum(x) for x in zip(*like.tolist())]
        if len(like) and (plain_em(like)[-1] <= language_id.MAX_UND or total[-1] - max(total[:-1]) < language_id.EVIDENCE):
            keep.add(i)
    assert texts[1] == {i: t for i, t in texts[0].items() if i in keep}

    gone = {(d, k) for d, a, b, _ in repeated_runs(texts[1], 50) for k in range(a, b)}
    want = {}
    for i, t in texts[1].items():
        left = [x for k, x in enumerate(t.split("\n")) if (i, k) not in gone]
        if "".join(left).strip() or not any(d == i for d, _ in gone):
            want[i] = "\n".join(left)
    assert texts[2] == want

    ids = sorted(texts[2])
    sure, maybe = near_groups([texts[2][i] for i in ids])
    kept = [k for k, i in enumerate(ids) if i in texts[3]]
    assert {ids[k] for k in kept} >= {ids[k] for k in range(len(ids)) if maybe[k] == k}
    assert len({sure[k] for k in kept}) == len(kept)
    assert texts[3] == {ids[k]: texts[2][ids[k]] for k in kept}

    con = connection("sf0.001")
    words = lambda t: " " + " ".join(con.execute("SELECT regexp_extract_all(lower(?), '[^\\x00-/:-`{-\\x7f]+')", [t]).fetchone()[0]) + " "
    items = [words(t) for (t,) in con.execute("SELECT text FROM benchmark").fetchall()]
    assert texts[4] == {i: t for i, t in texts[3].items() if not any(q in words(t) for q in items)}

    lengths = [n for t in texts[4].values() for n in [len(regex.findall(packing.TOKEN_RE, t))]]
    pieces = [p for n in lengths for p in [8192] * (n // 8192) + [n % 8192] if p]
    bins = {}
    for r in docs.collect():
        bins.setdefault((r.bin_id, r.capacity), []).append(r.n_tokens)
    assert Counter((c, tuple(sorted(x))) for (_, c), x in bins.items()) == Counter((c, tuple(x)) for c, x in naive_bins(pieces, packing.CAPACITIES, packing.sequence_cost))


def test_stages_on_awkward_rows(spark, tmp_path):
    good = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and n_chars > 500").limit(3).collect()
    text = good[0].text
    rows = [(1, text, "en", "s", len(text)), (1, text, "en", "s", len(text)), (2, text, None, None, None), (None, good[1].text, "en", "s", 1), (3, None, "en", "s", None), (4, "", "en", "s", 0), (5, good[2].text + (" " + good[2].text) * 200, "en", "s", 9), (6, "?!", "en", "s", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, gone string, left string, turn int, _node int"
    docs = spark.createDataFrame([(*r, 1, "k", "g", "l", 2, 3) for r in rows], schema)
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        seen.append(sorted((r.doc_id for r in docs.collect()), key=repr))
    assert seen[0] == [1, 1, 2, 5, None] and seen[1] == [1, 1, 5, None] and seen[2] == [1, 5, None]
    assert seen[3] == seen[2] and set(seen[4]) == {1, 5, None}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names) and [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())
