"""Licence notices in files, by a positional index of rare template words.

A template is the word sequence of a notice.  Over the whole corpus each word
of the templates gets its inverse document frequency; a template is indexed,
with positions, under its ``RARE`` words of highest IDF.  A file's words are
looked up in that index; where all rare words of a template stand at the
same relative positions, ``SLACK`` words more or less, the file has a
candidate, whose mandatory phrases must then stand there word by word.

What is kept in memory grows with the templates only, never with the files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import node_id
from .textarrays import WORD_RE, Words, column_of, slices

RARE = 3
SLACK = 2


@dataclass(frozen=True)
class Template:
    """A notice and the phrases of it that may not differ."""

    license_id: str
    text: str
    phrases: tuple[str, ...]


#: One-sentence notices, headers and titles of the GNU licences, clauses and full names, SPDX lines.
TEMPLATES = (
    Template("Apache-2.0", "licensed under the Apache License, Version 2.0", ("Apache License, Version 2.0",)),
    Template("MIT", "released under the MIT License", ("the MIT License",)),
    Template("MIT", "licensed under the MIT License", ("the MIT License",)),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ("Permission is hereby granted, free of charge", "copy of this software")),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    Template("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("source and binary forms", "with or without modification")),
    Template("GPL-3.0", "licensed under the GNU General Public License, version 3", ("GNU General Public License, version 3",)),
    Template("GPL-2.0", "licensed under the GNU General Public License, version 2", ("GNU General Public License, version 2",)),
    Template("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3", ("GNU Lesser General Public License, version 3",)),
    Template("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1", ("GNU Lesser General Public License, version 2.1",)),
    Template("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3", ("GNU Affero General Public License, version 3",)),
    Template("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("Mozilla Public License, v. 2.0",)),
    Template("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0", ("Eclipse Public License 2.0",)),
    Template("BSL-1.0", "distributed under the Boost Software License, Version 1.0", ("Boost Software License, Version 1.0",)),
    Template("Unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    Template("CC0-1.0", "dedicated to the public domain under CC0 1.0 Universal", ("CC0 1.0",)),
    Template("CC-BY-4.0", "licensed under CC BY 4.0", ("CC BY 4.0",)),
    Template("CC-BY-SA-4.0", "licensed under CC BY-SA 4.0", ("CC BY-SA 4.0",)),
    Template("CC-BY-NC-4.0", "licensed under CC BY-NC 4.0", ("CC BY-NC 4.0",)),
    Template("CC-BY-ND-4.0", "licensed under CC BY-ND 4.0", ("CC BY-ND 4.0",)),
    Template("CC-BY-NC-SA-4.0", "licensed under CC BY-NC-SA 4.0", ("CC BY-NC-SA 4.0",)),
    Template("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License", ("GNU General Public License as published", "either version 2 of the License",)),
    Template("GPL-2.0", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", ("GNU General Public License version 2 as published",)),
    Template("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("GNU General Public License as published", "either version 3 of the License",)),
    Template("GPL-3.0", "under the terms of the GNU General Public License version 3 as published by the Free Software Foundation", ("GNU General Public License version 3 as published",)),
    Template("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License", ("GNU Lesser General Public License as published", "either version 2.1 of the License",)),
    Template("LGPL-2.1", "under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation", ("GNU Lesser General Public License version 2.1 as published",)),
    Template("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", ("GNU Lesser General Public License as published", "either version 3 of the License",)),
    Template("LGPL-3.0", "under the terms of the GNU Lesser General Public License version 3 as published by the Free Software Foundation", ("GNU Lesser General Public License version 3 as published",)),
    Template("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ("GNU Affero General Public License as published", "either version 3 of the License",)),
    Template("AGPL-3.0", "under the terms of the GNU Affero General Public License version 3 as published by the Free Software Foundation", ("GNU Affero General Public License version 3 as published",)),
    Template("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ("must retain the above copyright notice", "this list of conditions and the following disclaimer")),
    Template("BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software", "without specific prior written permission")),
    Template("Zlib", "without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("without any express or implied warranty", "in no event will the authors be held liable")),
    Template("CC-BY-4.0", "Creative Commons Attribution 4.0 International", ("Creative Commons Attribution 4.0",)),
    Template("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International", ("Creative Commons Attribution-ShareAlike 4.0",)),
    Template("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International", ("Creative Commons Attribution-NonCommercial 4.0",)),
    Template("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International", ("Creative Commons Attribution-NoDerivatives 4.0",)),
    Template("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0",)),
    Template("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International", ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0",)),
    Template("CC0-1.0", "Creative Commons Zero v1.0 Universal", ("Creative Commons Zero v1.0",)),
    Template("Zlib", "SPDX-License-Identifier: Zlib", ("SPDX-License-Identifier: Zlib",)),
    Template("CC-BY-NC-ND-4.0", "SPDX-License-Identifier: CC-BY-NC-ND-4.0", ("SPDX-License-Identifier: CC-BY-NC-ND-4.0",)),
    Template("GPL-3.0", "GNU General Public License Version 3, 29 June 2007", ("GNU General Public License Version 3, 29 June 2007",)),
    Template("GPL-2.0", "GNU General Public License Version 2, June 1991", ("GNU General Public License Version 2, June 1991",)),
    Template("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007", ("GNU Lesser General Public License Version 3, 29 June 2007",)),
    Template("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999", ("GNU Lesser General Public License Version 2.1, February 1999",)),
    Template("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007", ("GNU Affero General Public License Version 3, 19 November 2007",)),
    Template("Apache-2.0", "Apache License Version 2.0, January 2004", ("Apache License Version 2.0, January 2004",)),
    Template("MIT", "available under the MIT License", ("available under the MIT License",)),
    Template("MIT", "distributed under the MIT License", ("distributed under the MIT License",)),
    Template("Apache-2.0", "SPDX-License-Identifier: Apache-2.0", ("SPDX-License-Identifier: Apache-2.0",)),
    Template("MIT", "SPDX-License-Identifier: MIT", ("SPDX-License-Identifier: MIT",)),
    Template("ISC", "SPDX-License-Identifier: ISC", ("SPDX-License-Identifier: ISC",)),
    Template("MPL-2.0", "SPDX-License-Identifier: MPL-2.0", ("SPDX-License-Identifier: MPL-2.0",)),
    Template("EPL-2.0", "SPDX-License-Identifier: EPL-2.0", ("SPDX-License-Identifier: EPL-2.0",)),
    Template("BSL-1.0", "SPDX-License-Identifier: BSL-1.0", ("SPDX-License-Identifier: BSL-1.0",)),
    Template("Unlicense", "SPDX-License-Identifier: Unlicense", ("SPDX-License-Identifier: Unlicense",)),
    Template("CC0-1.0", "SPDX-License-Identifier: CC0-1.0", ("SPDX-License-Identifier: CC0-1.0",)),
    Template("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0", ("SPDX-License-Identifier: CC-BY-4.0",)),
    Template("CC-BY-SA-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0", ("SPDX-License-Identifier: CC-BY-SA-4.0",)),
    Template("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0", ("SPDX-License-Identifier: CC-BY-NC-4.0",)),
    Template("CC-BY-ND-4.0", "SPDX-License-Identifier: CC-BY-ND-4.0", ("SPDX-License-Identifier: CC-BY-ND-4.0",)),
    Template("CC-BY-NC-SA-4.0", "SPDX-License-Identifier: CC-BY-NC-SA-4.0", ("SPDX-License-Identifier: CC-BY-NC-SA-4.0",)),
    Template("BSD", "SPDX-License-Identifier: BSD-2-Clause", ("SPDX-License-Identifier: BSD-2-Clause",)),
    Template("BSD", "SPDX-License-Identifier: BSD-3-Clause", ("SPDX-License-Identifier: BSD-3-Clause",)),
    Template("GPL-2.0", "SPDX-License-Identifier: GPL-2.0", ("SPDX-License-Identifier: GPL-2.0",)),
    Template("GPL-3.0", "SPDX-License-Identifier: GPL-3.0", ("SPDX-License-Identifier: GPL-3.0",)),
    Template("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1", ("SPDX-License-Identifier: LGPL-2.1",)),
    Template("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0", ("SPDX-License-Identifier: LGPL-3.0",)),
    Template("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0", ("SPDX-License-Identifier: AGPL-3.0",)),
)


def _split(text: str) -> list[str]:
    words = Words(pa.array([text]))
    return words.texts(np.arange(len(words)))


def _lexicon(templates: Sequence[Template]) -> tuple[list[str], np.ndarray]:
    """The words of the templates and their hashes, by hash."""
    words = Words(pa.array([t.text for t in templates]))
    value, at = np.unique(words.hash, return_index=True)
    return words.texts(at), value


def _lookup(words: Words, value: np.ndarray) -> np.ndarray:
    """The place of each word in the lexicon, or -1."""
    at = np.minimum(np.searchsorted(value, words.hash), len(value) - 1)
    return np.where(value[at] == words.hash, at, -1)


def document_frequencies(docs: DataFrame, text_col: str, templates: Sequence[Template]) -> tuple[dict[str, int], int]:
    """Of each template word, over all documents; and the number of documents."""
    names, value = _lexicon(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(value) + 1, np.int64)
        for batch in batches:
            text = column_of(batch, "text")
            for a, b in slices(text):
                words = Words(text.slice(a, b - a))
                place = _lookup(words, value)
                found = place >= 0
                pair = np.unique(words.row[found] * len(value) + place[found])
                total[:-1] += np.bincount(pair % len(value), minlength=len(value))
                total[-1] += b - a
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    n = {r.place: r.n for r in rows}
    return {w: n.get(k, 0) for k, w in enumerate(names)}, n.get(len(names), 0)


def _positional_index(templates: Sequence[Template], frequency: dict[str, int]) -> list[tuple]:
    """(words, rare positions by rising frequency, phrase spans) of each template."""
    out = []
    for t in templates:
        words = _split(t.text)
        order = sorted({w: k for k, w in reversed(list(enumerate(words)))}.items(), key=lambda x: (frequency[x[0]], x[1]))
        spans = []
        for phrase in t.phrases:
            p = _split(phrase)
            k = next(k for k in range(len(words)) if words[k : k + len(p)] == p)
            spans.append((k, k + len(p)))
        out.append((words, [k for _, k in order[:RARE]], spans))
    return out


def _scan(templates: Sequence[Template], frequency: dict[str, int]) -> Callable:
    names, value = _lexicon(templates)
    number = {w: k for k, w in enumerate(names)}
    index = [([number[w] for w in words], rare, spans) for words, rare, spans in _positional_index(templates, frequency)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = column_of(batch, "text")
            for a, b in slices(text):
                words = Words(text.slice(a, b - a))
                place = _lookup(words, value)
                hit = np.flatnonzero(place >= 0)
                order = hit[np.argsort(place[hit], kind="stable")]
                cut = np.searchsorted(place[order], np.arange(len(value) + 1))
                for k, (ids, rare, spans) in enumerate(index):
                    # the rarest word leads; the start of the notice follows from its position
                    base = order[cut[ids[rare[0]]] : cut[ids[rare[0]] + 1]]
                    if not len(base):
                        continue
                    row = words.row[base]
                    low, high = words.first[row], words.first[row + 1]

                    def stands(span: range, shift: int) -> np.ndarray:
                        ok = np.ones(len(base), bool)
                        for p in span:
                            at = base + (p - rare[0]) + shift
                            inside = (at >= low) & (at < high)
                            ok &= inside & (place[np.where(inside, at, 0)] == ids[p])
                        return ok

                    ok = np.ones(len(base), bool)
                    for span in [range(p, p + 1) for p in rare[1:]] + [range(*s) for s in spans]:
                        ok &= np.logical_or.reduce([stands(span, d) for d in range(-SLACK, SLACK + 1)])
                    if not ok.any():
                        continue
                    doc = pa.array(row[ok])
                    begin = np.maximum(base[ok] - rare[0], low[ok]) - low[ok]
                    yield pa.RecordBatch.from_arrays(
                        [column_of(batch, "node").slice(a, b - a).take(doc), column_of(batch, "doc_id").slice(a, b - a).take(doc), pa.array(np.full(len(begin), k, np.int32)), pa.array(begin.astype(np.int32))],
                        ["node", "doc_id", "template", "start_word"],
                    )

    return run


def license_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Licences of each file: ``(doc_id, license_id, n_notices, start_word)``, a row for each file and licence found.

    ``n_notices`` counts the starts at which some template of the licence matches,
    ``start_word`` is the first, as a word index of the file (0 if the notice is cut off there).

    Null and empty texts hold no notice; rows with a null id give none but
    count for the frequencies.  Rows equal in id and text give one row, equal
    ids with other texts one each.  Words of equal frequency are taken in
    alphabetical order.  Texts of any length are read to their end.  An empty table gives no row.
    Other columns, whatever their names, are ignored.
    """
    frequency, _ = document_frequencies(docs, text_col, templates)
    used = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(node_id(id_col, text_col).alias("node"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = used.mapInArrow(_scan(templates, frequency), "node long, doc_id long, template int, start_word int")
    names = F.array(*[F.lit(t.license_id) for t in templates])
    named = found.select("node", "doc_id", F.element_at(names, F.col("template") + 1).alias("license_id"), "start_word").distinct()
    return named.groupBy("node", "doc_id", "license_id").agg(F.count(F.lit(1)).alias("n_notices"), F.min("start_word").alias("start_word")).drop("node")


def _sql_list(words: Sequence[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _template_rows() -> tuple[str, str]:
    """VALUES of the templates (number, licence, words) and of their phrases (number, start, end)."""
    texts, phrases = [], []
    for k, t in enumerate(TEMPLATES):
        words = _split(t.text)
        texts.append(f"({k}, '{t.license_id}', {_sql_list(words)})")
        for phrase in t.phrases:
            p = _split(phrase)
            at = next(i for i in range(len(words)) if words[i : i + len(p)] == p)
            phrases.append(f"({k}, {at}, {at + len(p)})")
    return ", ".join(texts), ", ".join(phrases)


#: The same in DuckDB.
LICENSES_SQL = f"""
WITH t(tid, license_id, tw) AS (VALUES {_template_rows()[0]}), p(tid, a, b) AS (VALUES {_template_rows()[1]}),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_RE}') AS words FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0),
k AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS pos FROM d),
tp AS (SELECT tid, w, min(pos) AS pos FROM (SELECT tid, unnest(tw) AS w, unnest(range(len(tw))) AS pos FROM t) GROUP BY tid, w),
f AS (SELECT w, count(DISTINCT doc_id) AS n FROM k WHERE w IN (SELECT w FROM tp) GROUP BY w),
r AS (SELECT tid, w, pos, row_number() OVER (PARTITION BY tid ORDER BY coalesce(n, 0), w) AS place FROM tp LEFT JOIN f USING (w)),
s AS (SELECT tid, a, b FROM p UNION ALL SELECT tid, pos, pos + 1 FROM r WHERE place BETWEEN 2 AND {RARE}),
c AS (SELECT doc_id, tid, k.pos - r.pos AS start FROM k JOIN r USING (w) WHERE place = 1),
ok AS (SELECT doc_id, tid, start FROM c JOIN d USING (doc_id) JOIN t USING (tid) JOIN s USING (tid) GROUP BY doc_id, tid, start
  HAVING bool_and(len(list_filter(range({-SLACK}, {SLACK + 1}), lambda x: start + a + x >= 0 AND words[start + a + x + 1 : start + b + x] = tw[a + 1 : b])) > 0))
SELECT doc_id, license_id, count(DISTINCT greatest(start, 0)) AS n_notices, CAST(min(greatest(start, 0)) AS INTEGER) AS start_word FROM ok JOIN t USING (tid) GROUP BY doc_id, license_id
"""
