"""License notices in documents: MinHash retrieval over overlapping windows, exact containment.

Native: the whole path is DataFrame expressions.  A text's words are its runs of ASCII letters
and digits, lower-cased; its shingles are five words joined by blanks.  For templates of m
shingles the windows hold 2m shingles and begin at every m-th, so each stretch of m
shingles lies wholly in one.  A window and a template share a band if they have the same
least hash under one of ``BANDS`` hash functions; a window with a containment of 0.75 or more has
a Jaccard similarity of at least 1/3, so it is missed with probability (2/3)**BANDS, about
1e-8.  What the bands retrieve is verified: shared distinct shingles / template shingles >= 0.75.

The bands are looked up from the side of the templates: a window can only share a template's least hash if it
holds the shingle that has it.  So the shingles that are a template's least under some function (``BANDS`` of a
template at most) are the index; the signatures of windows around them are computed in full and compared, and
of all other windows it is known that they share no band.  Which shingles of a template are in the index is up to the
hash functions alone: a window that holds only its others is not retrieved, as with signatures of all windows.

The templates are a table (license, text): a list of licenses, which doesn't grow with the documents.

Defined results: null and empty texts, and texts of fewer than five words, match nothing; texts of any length are
scanned whole; several windows of a document count as one match, the best (then the first); rows that repeat an
id are scanned as one document each and folded into one row; a null id gets rows of its own;
an empty table of documents or templates gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS, BANDS = 5, 45
LEAST = 0.75
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_GNU_END = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
#: Whole license texts of the short licenses, the notices that the long ones ask for, and one-line notices.
TEMPLATES = {
    "mit": f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2-clause": f"{_BSD} {_BSD_END}",
    "bsd-3-clause": f"{_BSD} {_BSD_THIRD} {_BSD_END}",
    "isc": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}",
    "0bsd": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_END}",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_WARRANTY}",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-2.0-header": f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. {_GNU_END} See the GNU General Public License for more details.",
    "gpl-3.0-header": f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. {_GNU_END} See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl-3.0-header": f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. {_GNU_END} See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
}


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((TEMPLATES if templates is None else templates).items()), "license string, text string")


def _once(column):
    """Generated, so that no later expression takes the column's place and is evaluated per element."""
    return F.explode(F.array(column))


def _words(text):
    return F.split(F.lower(F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", " "))), " ")


def _places(w):
    return F.when(F.size(w) >= WORDS, F.sequence(F.lit(0), F.size(w) - WORDS)).otherwise(F.array().cast("array<int>"))


def _hash(w, i):
    return F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)])


def _shingle(w, i):
    return F.array_join(F.slice(w, i + 1, WORDS), " ")


def _signature(hashes):
    """The least hash under each function."""
    least = lambda j: F.array_min(F.transform(hashes, lambda h: F.xxhash64(F.lit(j), h)))
    return F.array(*map(least, range(BANDS)))


def _index(templates: DataFrame) -> DataFrame:
    """license, m, wanted (shingles), bands, and keys: the hashes of shingles that are least under some function."""
    w = F.col("w")
    rows = templates.select("license", _once(_words(F.coalesce("text", F.lit("")))).alias("w")).filter(F.size("w") >= WORDS)
    rows = rows.select("license", F.array_distinct(F.transform(_places(w), lambda i: _shingle(w, i))).alias("wanted"), _once(F.array_distinct(F.transform(_places(w), lambda i: _hash(w, i)))).alias("h"))
    rows = rows.select("license", F.size("wanted").alias("m"), "wanted", "h", _once(_signature(F.col("h"))).alias("bands"))
    least = lambda h: F.exists(F.array(*[F.xxhash64(F.lit(j), h) == F.col("bands")[j] for j in range(BANDS)]), lambda x: x)
    return rows.select("license", "m", "wanted", "bands", F.filter("h", least).alias("keys"))


def license_scan(spark: SparkSession, docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Per document and template that it holds: doc_id, license, n_shared, n_template, containment, first_word.

    templates: license, text.
    """
    index = _index(template_table(spark) if templates is None else templates)
    known = index.collect()  # as many rows as there are licenses
    table = spark.createDataFrame(known, index.schema)
    sizes: dict[int, set[int]] = {}
    for r in known:
        for h in r["keys"]:
            sizes.setdefault(h, set()).add(r["m"])
    w = F.col("w")
    rows = common.texts(docs).select("doc_id", _once(_words("text")).alias("w"))
    # Of the shingles those in the index, with the template sizes that have them.
    hits = F.filter(F.transform(_places(w), lambda i: F.struct(i.alias("i"), _hash(w, i).alias("h"))), lambda x: x["h"].isin(list(sizes)))
    rows = rows.select("doc_id", "w", _once(hits).alias("at")).filter(F.size("at") > 0)
    of = F.map_from_arrays(F.array(*map(F.lit, sizes)), F.array(*[F.array(*map(F.lit, sorted(m))) for m in sizes.values()])) if sizes else F.lit(None).cast("map<bigint,array<int>>")
    begins = lambda i, m: F.array(F.floor(i / m) * m, (F.floor(i / m) - 1) * m)
    near = lambda x: F.flatten(F.transform(F.element_at(of, x["h"]), lambda m: F.transform(begins(x["i"], m), lambda b: F.struct(m.alias("m"), b.cast("int").alias("begin")))))
    windows = rows.select("doc_id", "w", F.explode(F.array_distinct(F.flatten(F.transform("at", near)))).alias("x")).filter("x.begin >= 0").select("doc_id", "w", "x.m", "x.begin")
    windows = windows.select("doc_id", "w", "m", "begin", _once(F.sequence("begin", F.least(F.col("begin") + 2 * F.col("m") - 1, F.size("w") - WORDS))).alias("places"))
    windows = windows.select("doc_id", "m", "begin", "w", "places", _once(_signature(F.transform("places", lambda i: _hash(w, i)))).alias("bands"))

    found = windows.join(F.broadcast(table.select("license", "m", "wanted", F.col("bands").alias("template_bands"))), "m").filter(F.arrays_overlap("bands", "template_bands"))
    shared = F.size(F.array_intersect(F.transform("places", lambda i: _shingle(w, i)), "wanted"))
    found = found.select("doc_id", "license", F.col("m").cast("long").alias("n_template"), "begin", shared.cast("long").alias("n_shared"))
    found = found.filter(F.col("n_shared") >= LEAST * F.col("n_template"))
    best = found.groupBy("doc_id", "license", "n_template").agg(F.max(F.struct("n_shared", (-F.col("begin")).alias("b"))).alias("x"))
    return best.select("doc_id", "license", F.col("x.n_shared").alias("n_shared"), "n_template", F.round(F.col("x.n_shared") / F.col("n_template"), 6).alias("containment"), (-F.col("x.b")).cast("long").alias("first_word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark, common.table(spark, sf_dir, "documents"))


def template_shingles(text: str) -> list[str]:
    words = re.sub("[^A-Za-z0-9]+", " ", text).strip().lower().split(" ")
    return sorted({" ".join(words[k : k + WORDS]) for k in range(len(words) - WORDS + 1)})


def _oracle() -> str:
    values = ", ".join(f"('{k}', {len(s)}, '{x}')" for k, t in TEMPLATES.items() for s in [template_shingles(t)] for x in s)
    return f"""
WITH t(license, m, s) AS (VALUES {values}),
w AS (SELECT doc_id, string_split(lower(trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS i FROM w WHERE len(w) >= 5),
h AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM g),
x AS (SELECT doc_id, license, m, i, s FROM h JOIN t USING (s)),
k AS (SELECT doc_id, license, m, s, (i // m) * m AS b FROM x
      UNION ALL SELECT doc_id, license, m, s, (i // m - 1) * m FROM x WHERE i >= m),
c AS (SELECT doc_id, license, m, b, count(DISTINCT s) AS n FROM k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY n DESC, b) AS rn FROM c WHERE n >= 0.75 * m)
SELECT doc_id, license, n AS n_shared, CAST(m AS BIGINT) AS n_template, round(n / m, 6) AS containment, CAST(b AS BIGINT) AS first_word FROM r WHERE rn = 1
"""


ORACLE = _oracle()
