"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

Every line of every text, every block of lines between lines without words, and every text as a whole, is compared with the templates;
inverse document frequencies of all words are counted over all documents. A scan first gives each word outside the templates the least idf there is, 1, which bounds the cosine from above; what
may still reach a threshold is joined with the idf of its other words and decided exactly. A text's best line or block names its licence if the cosine reaches
``header``, else the whole text if that reaches ``whole``. A file whose name says so (LICENSE, COPYING and the like) and that has a licence is
the licence file of its directory; no other file licenses a directory. Files without a licence of
their own take that of the nearest directory above that has a licence file: directories, not files, are expanded into their ancestors
and joined by path, so a directory with a third of all files costs one row, and each file then joins its directory's result.

Defined cases: a null text matches nothing; a null or missing path lies in the root directory; of several licence files in a directory the one with
the highest cosine counts, then the first path; ties between templates go to the first name; repeated rows each give a row; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, column_or_null, settle, small, trimmed

WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: Names of files that hold a directory's licence.
NAMED = r"(?i)(^|/)(licen[cs]e|copying|copyright|notice|unlicense)([.-][^/]*)?$"

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
)
_MIT_END = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)


def _gpl(name: str, version: str) -> str:
    """The notice of the family's licences."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
        f"You should have received a copy of the GNU {name} along with this program. If not, see https://www.gnu.org/licenses/."
    )


#: Statements, notices and short licences in full, by SPDX identifier. Callers add the long licences as further templates.
TEMPLATES = {
    "AGPL-3.0": ["GNU Affero General Public License version 3", "SPDX-License-Identifier: AGPL-3.0-or-later", _gpl("Affero General Public License", "3")],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "you may not use this file except in compliance with the License. http://www.apache.org/licenses/LICENSE-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", _BSD + _BSD_END],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted", _BSD + _BSD_3 + _BSD_END],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0-1.0": ["Licensed under CC0 1.0.", "Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "SPDX-License-Identifier: GPL-2.0-only", _gpl("General Public License", "2")],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0-or-later", _gpl("General Public License", "3")],
    "ISC": [
        "Licensed under the ISC License.", "SPDX-License-Identifier: ISC",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: LGPL-3.0-or-later", _gpl("Lesser General Public License", "3")],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", _MIT, _MIT + _MIT_END],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
}


@dataclass(frozen=True)
class Scan:
    header: float = 0.72
    whole: float = 0.6


class Matcher:
    """Templates as unit vectors over their own terms, by term."""

    def __init__(self, templates: dict[str, list[str]]) -> None:
        self.names = [name for name, texts in sorted(templates.items()) for _ in texts]
        self.counts = [Counter(WORD.findall(t.lower())) for _, texts in sorted(templates.items()) for t in texts]
        self.terms = sorted(set().union(*self.counts))

    def weigh(self, df: dict[str, int], docs: int) -> Matcher:
        self.idf = {t: math.log((1 + docs) / (1 + df.get(t, 0))) + 1 for t in self.terms}
        self.postings: dict[str, list[tuple[int, float]]] = {t: [] for t in self.terms}
        for k, c in enumerate(self.counts):
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in c.items()))
            for t, n in c.items():
                self.postings[t].append((k, n * self.idf[t] / norm))
        return self

    def nearest(self, counts: Counter, least: float) -> tuple[float, str, float, list[tuple[str, int]]] | None:
        """The closest template if its cosine may reach ``least``: dot product, name, squared length within the templates, other words."""
        get, known, other = self.idf.get, 0.0, 0
        for t, n in counts.items():
            i = get(t)
            if i is None:
                other += n * n
            else:
                known += (n * i) ** 2
        norm2 = known + other
        if not known or known < least * least * norm2:  # the part within the templates bounds every cosine
            return None
        sims: dict[int, float] = {}
        for t, n in counts.items():
            if t in self.postings:
                w = n * self.idf[t]
                for k, x in self.postings[t]:
                    sims[k] = sims.get(k, 0.0) + w * x
        k = min(sims, key=lambda k: (-round(sims[k], 12), self.names[k]))
        if sims[k] / math.sqrt(norm2) < least:
            return None
        return sims[k], self.names[k], known, [(t, n) for t, n in counts.items() if t not in self.postings]

    def best(self, counts: Counter, least: float) -> tuple[float, str] | None:
        """The closest template, if its cosine is at least ``least`` where words outside the templates have idf 1."""
        found = self.nearest(counts, least)
        return (min(1.0, found[0] / math.sqrt(found[2] + sum(n * n for _, n in found[3]))), found[1]) if found else None

    def scan(self, text: str, p: Scan) -> tuple[tuple[float, str, int] | None, tuple[float, str] | None, list[dict]]:
        """The best line or block (score, licence, line number) and the match of the whole, of those without other words; and the others, undecided."""
        head, last, whole, undecided = None, None, Counter(), []
        block, began, size = Counter(), 0, 0

        def wait(line: int, found: tuple[float, str, float, list[tuple[str, int]]]) -> None:
            undecided.append({"line": line, "name": found[1], "dot": found[0], "known": found[2], "words": [{"word": t, "n": n} for t, n in found[3]]})

        def header(line: int, counts: Counter) -> None:
            nonlocal head
            found = self.nearest(counts, p.header)
            if found and found[3]:
                wait(line, found)
            elif found:
                score = min(1.0, found[0] / math.sqrt(found[2]))
                if head is None or score > head[0] + 1e-12:
                    head = (score, found[1], line)

        for i, line in enumerate([*text.lower().split("\n"), ""]):
            words = WORD.findall(line)
            if words:
                counts = Counter(words)
                block.update(counts)
                began, size = (began, size + 1) if size else (i, 1)
                header(i, counts)
                continue
            if size > 1:  # lines between lines without words, as wrapped notices are
                header(began, block)
            whole.update(block)
            block, size = Counter(), 0
        found = self.nearest(whole, p.whole)
        if found and found[3]:
            wait(WHOLE, found)
        elif found:
            last = (min(1.0, found[0] / math.sqrt(found[2])), found[1])
        return head, last, undecided


#: Stands for the line number where a text is compared as a whole.
WHOLE = -1
#: Words that a task counts before it passes the counts on.
HELD = 200_000


def document_frequencies(files: DataFrame) -> DataFrame:
    """word, n of every word of all files, and the number of files as that of the empty word; tasks add up their own counts first."""

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for b in batches:
            seen[""] += b.num_rows
            for at in range(0, b.num_rows, 256):
                for text in b.column(0).slice(at, 256).to_pylist():
                    seen.update(set(WORD.findall((text or "").lower())))
                if len(seen) > HELD:
                    yield flush()
        if seen:
            yield flush()

    return settle(files.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))


def weighed(matcher: Matcher, df: DataFrame) -> tuple[Matcher, int]:
    """The matcher with its terms' document frequencies, and the number of files."""
    rows = {r["word"]: r["n"] for r in df.where(F.col("word").isin(["", *matcher.terms])).collect()}  # a row a term at most
    docs = rows.pop("", 0)
    return matcher.weigh(rows, docs), docs


def decided(found: DataFrame, df: DataFrame, docs: int, p: Scan) -> DataFrame:
    """u_uid, line (score, -line, licence) and whole (score, licence) of the rows with undecided comparisons, by the idf of all their words."""
    each = found.where(F.size("undecided") > 0).select("uid", F.posexplode("undecided").alias("part", "c"))
    words = each.select("uid", "part", "c.line", "c.name", "c.dot", "c.known", F.explode("c.words").alias("w")).select("uid", "part", "line", "name", "dot", "known", "w.word", F.col("w.n").alias("times"))
    idf = settle(words.select("word").distinct().join(df, "word").select("word", (F.log((1.0 + docs) / (1 + F.col("n"))) + 1).alias("idf")))
    scores = words.join(small(idf), "word").groupBy("uid", "part", "line", "name", "dot", "known").agg(F.sum(F.pow(F.col("times") * F.col("idf"), 2)).alias("other"))
    scores = scores.withColumn("score", F.least(F.lit(1.0), F.col("dot") / F.sqrt(F.col("known") + F.col("other"))))
    whole = F.col("line") == WHOLE
    line = F.when(~whole & (F.col("score") >= p.header), F.struct(F.round("score", 12).alias("score"), (-F.col("line")).alias("up"), "name"))
    text = F.when(whole & (F.col("score") >= p.whole), F.struct("score", "name"))
    return settle(scores.groupBy(F.col("uid").alias("u_uid")).agg(F.max(line).alias("u_line"), F.max(text).alias("u_whole")))


def parent(path: Column) -> Column:
    """The directory of a path; the root is the empty text."""
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def license_scan(files: DataFrame, p: Scan = Scan(), templates: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, path, license, origin (header, file, inherited or none), score, line (of a header), licensed_by (a directory)."""
    files = bounded_batches(files)
    own = files.select("doc_id", F.coalesce(column_or_null(files, "path", "string"), F.lit("")).alias("path"), F.col("text").cast("string").alias("text"))
    df = document_frequencies(own)
    model, docs = weighed(Matcher(templates or TEMPLATES), df)
    matcher = own.sparkSession.sparkContext.broadcast(model)
    id_type = own.schema["doc_id"].dataType.simpleString()
    kinds = [("uid", pa.int64()), ("h_score", pa.float64()), ("h_name", pa.string()), ("h_line", pa.int32()), ("w_score", pa.float64()), ("w_name", pa.string())]
    kinds.append(("undecided", pa.list_(pa.struct([("line", pa.int32()), ("name", pa.string()), ("dot", pa.float64()), ("known", pa.float64()), ("words", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())])))]))))

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, uid = matcher.value, TaskContext.get().partitionId() << 40
        for b in batches:
            out = []
            for at in range(0, b.num_rows, 256):
                for text in b.column(2).slice(at, 256).to_pylist():
                    head, whole, undecided = m.scan(text or "", p)
                    out.append((uid + len(out), *(head or (None,) * 3), *(whole or (None,) * 2), undecided))
            uid += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(kinds))], ["doc_id", "path", *(k for k, _ in kinds)])

    found = settle(own.mapInArrow(scan, f"doc_id {id_type}, path string, uid long, h_score double, h_name string, h_line int, w_score double, w_name string, undecided array<struct<line int, name string, dot double, known double, words array<struct<word string, n int>>>>"))
    found = found.drop("undecided").join(small(decided(found, df, docs, p)), F.col("uid") == F.col("u_uid"), "left")
    # Of equal lines the first counts; -line is the larger for it.
    head = F.greatest(F.when(F.col("h_score").isNotNull(), F.struct(F.round("h_score", 12).alias("score"), (-F.col("h_line")).alias("up"), F.col("h_name").alias("name"))), F.col("u_line"))
    found = found.select("doc_id", "path", head.alias("h"), F.coalesce("w_score", "u_whole.score").alias("w_score"), F.coalesce("w_name", "u_whole.name").alias("w_name"))
    found = found.select("doc_id", "path", F.coalesce("h.name", "w_name").alias("own"), F.coalesce("h.score", "w_score").alias("score"), (-F.col("h.up")).alias("line"), F.col("w_name").isNotNull().alias("whole"))
    found = settle(found.withColumn("dir", parent(F.col("path"))))
    by_dir = found.where(F.col("own").isNotNull() & F.col("path").rlike(NAMED)).groupBy(F.col("dir").alias("at")).agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "own")).alias("f"))
    by_dir = settle(by_dir.select("at", F.col("f.own").alias("d_own"), (-F.col("f.s")).alias("d_score")))
    # Each directory with unlicensed files, and all directories above it, nearest first.
    dirs = found.where(F.col("own").isNull()).groupBy("dir").agg(F.lit(1).alias("one")).drop("one")
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))).alias("up"))
    nearest = above.join(small(by_dir), F.col("up") == F.col("at")).groupBy(F.col("dir").alias("n_dir")).agg(F.max(F.struct(F.length("up").alias("depth"), "up", "d_own", "d_score")).alias("n"))
    nearest = settle(nearest.select("n_dir", F.col("n.up").alias("up"), F.col("n.d_own").alias("i_own"), F.col("n.d_score").alias("i_score")))
    out = found.join(small(nearest), (F.col("dir") == F.col("n_dir")) & F.col("own").isNull(), "left")
    origin = F.when(F.col("own").isNull(), F.when(F.col("i_own").isNotNull(), "inherited").otherwise("none")).when(F.col("whole") | F.col("path").rlike(NAMED), "file").otherwise("header")
    return out.select("doc_id", "path", F.coalesce("own", "i_own").alias("license"), origin.alias("origin"), F.coalesce("score", "i_score").alias("score"), "line", F.when(F.col("own").isNull(), F.col("up")).alias("licensed_by"))
