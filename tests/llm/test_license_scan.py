"""Notices against a scan of every position."""

import random
from itertools import product

import duckdb
from conftest_llm import rows
from oracle import DATA, compare, connection

from gridcast.llm import license_scan as lic
from gridcast.llm.queries import op4_license_scan

FILLER = "the of this any software license licensed version public under to gnu apache mit alpha beta 2 0 3 granted".split()


def brute(words, template, frequency):
    """Starts at which rare words and phrases stand, each up to SLACK words off."""
    ids, rare, spans = lic._positional_index([template], frequency)[0]
    found = set()
    for base, w in enumerate(words):
        if w != ids[rare[0]]:
            continue
        start = base - rare[0]
        parts = [(p, p + 1) for p in rare[1:]] + spans
        if all(any(start + a + d >= 0 and words[start + a + d : start + b + d] == ids[a:b] for d in range(-lic.SLACK, lic.SLACK + 1)) for a, b in parts):
            found.add(max(start, 0))
    return found


def test_same_as_brute_force(spark, make):
    rnd = random.Random(1)
    docs = {}
    for d in range(300):
        words = [rnd.choice(FILLER) for _ in range(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 2)):
            notice = lic._split(rnd.choice(lic.TEMPLATES).text)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                at = rnd.randrange(len(notice))
                notice[at : at + rnd.randint(0, 1)] = [rnd.choice(FILLER)] * rnd.randint(0, 1)
            at = rnd.randint(0, len(words))
            words[at:at] = notice
        docs[d] = words
    frame = make([(d, " ".join(w)) for d, w in docs.items()])
    frequency, n = lic.document_frequencies(frame, "text", lic.TEMPLATES)
    assert n == 300 and all(frequency[w] == sum(w in x for x in docs.values()) for w in frequency)
    want = {}
    for (d, words), t in product(docs.items(), lic.TEMPLATES):
        for start in brute(words, t, frequency):
            want.setdefault((d, t.license_id), set()).add(start)
    got = rows(lic.license_notices(frame), "doc_id", "license_id", "n_notices", "start_word")
    assert got == sorted(((*k, len(v), min(v)) for k, v in want.items()), key=repr)
    assert len(got) > 150


def test_each_template_finds_itself_and_a_broken_phrase_doesn_t(spark, make):
    texts = [f"Some words.\n{t.text.upper()}!" for t in lic.TEMPLATES]
    out = rows(lic.license_notices(make(texts)), "doc_id", "license_id")
    assert out == sorted(((k, t.license_id) for k, t in enumerate(lic.TEMPLATES)), key=repr)
    assert lic.license_notices(make(["Licensed under the Apache Software License, Version 2.0", "Released under the License MIT", "licensed CC"])).count() == 0


def test_edges(spark, make):
    notice = "Released under the MIT License."
    docs = make([(1, notice), (1, notice), (2, None), (3, ""), (None, notice), (4, "x " * 200_000 + notice), (5, notice + " " + notice), (6, notice), (6, notice + " again")])
    assert rows(lic.license_notices(docs), "doc_id", "n_notices", "start_word") == [(1, 1, 0), (4, 1, 200_000), (5, 2, 0), (6, 1, 0), (6, 1, 0)]
    assert lic.license_notices(make([])).count() == 0


def test_sql(spark):
    compare(op4_license_scan(spark, f"{DATA}/sf0.01"), lic.LICENSES_SQL, connection("sf0.01"))


def test_sql_on_all_templates(spark, make, tmp_path):
    rnd = random.Random(8)
    docs = []
    for k, t in enumerate(lic.TEMPLATES * 3):
        words = [rnd.choice(FILLER) for _ in range(rnd.randint(0, 9))] + lic._split(t.text) + [rnd.choice(FILLER) for _ in range(rnd.randint(0, 9))]
        words[rnd.randrange(len(words))] = rnd.choice(FILLER)
        docs.append((k, " ".join(words)))
    make(docs).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    compare(lic.license_notices(make(docs)), lic.LICENSES_SQL, con)


def test_headers_titles_and_spdx_lines(spark, make):
    gnu = "under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    texts = [gnu.format("", 3), gnu.format("", 2), gnu.format("Lesser ", "2.1"), gnu.format("Affero ", 3), "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007", "// SPDX-License-Identifier: GPL-2.0-or-later", "# SPDX-License-Identifier: MIT", "It is available under the MIT License."]
    texts += ["licensed under a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License", "Neither the name of Acme nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]
    want = ["GPL-3.0", "GPL-2.0", "LGPL-2.1", "AGPL-3.0", "GPL-3.0", "GPL-2.0", "MIT", "MIT", "CC-BY-4.0", "CC-BY-NC-SA-4.0", "BSD-3-Clause"]
    assert rows(lic.license_notices(make(texts)), "doc_id", "license_id") == sorted(enumerate(want), key=repr)
