"""License scans: MinHash bands of text windows retrieve templates, shingle containment verifies them.

Words are runs of digits, letters and characters above 127, lower-cased; shingles are five words. Templates are held as the band
keys of all their windows, at every offset, so that a document's window meets the equal template window whatever its alignment.

Templates of fewer than LONG_WORDS words are retrieved by windows of one shingle at every word, whose MinHash is the shingle: any shingle
in common is a collision. Longer ones are retrieved by windows of WINDOW_SHINGLES shingles at every STRIDE words, by BANDS bands
of one MinHash: a window of similarity s collides with probability 1 - (1 - s) ** BANDS, 0.9998 at two thirds and
above 0.94 at 0.3, and a template of LONG_WORDS words holds at least one whole window. MinHash i of a window is the shingle
hash nearest to the constant C_i, by exclusive or.

A hit is a template of whose shingles at least MIN_CONTAINMENT are in the text within a template's length of the window. Only
DataFrame functions are used. The templates are a bounded table and are broadcast; the texts are not shuffled.

Defined results. A null or empty text, and one of fewer than five words, matches nothing. A text that holds a template several times gives one row for it, with
the best containment and the first place. Rows that repeat a doc_id count as one document; rows without doc_id give rows without it.
Other columns play no part.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
MIN_CONTAINMENT = 0.8
LONG_WORDS = 24
WINDOW_SHINGLES = 12
STRIDE = 8
BANDS = 8
#: Slots of the table that tells most foreign band keys from those of templates.
SLOTS = 1 << 18
#: Most words of all templates together: what is broadcast stays under a few MB.
MOST_TEMPLATE_WORDS = 20_000
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Notices of public licenses, and the whole texts of short ones.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT line": "Released under the MIT License.",
    "MIT grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "ISC grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "Unlicense line": "This is free and unencumbered software released into the public domain.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
        "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to "
        "anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, "
        "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
        "following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the "
        "Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, "
        "or (at your option) any later version."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
        "License, or (at your option) any later version."
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version."
    ),
}

_CONSTANTS = [int(c) for c in np.random.RandomState(41).randint(-(2**62), 2**62, BANDS)]


def shingles(words: Column) -> Column:
    """Hashes of the five-word shingles of an array of words, in order."""
    at = F.sequence(F.lit(1), F.size(words) - SHINGLE_WORDS + 1)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k - 1) for k in range(SHINGLE_WORDS)]))
    return F.when(F.size(words) >= SHINGLE_WORDS, hashes).otherwise(F.array().cast("array<bigint>"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text.cast("string")), F.lit(WORDS), F.lit(0))


def _min_hashes(grams: Column, at: Column) -> Column:
    """Band keys of the window of shingles from place `at` (from 0): each band's MinHash, with the band."""
    window = F.slice(grams, at + 1, F.lit(WINDOW_SHINGLES))

    def key(band: int) -> Column:
        return F.xxhash64(F.lit(band), F.array_min(F.transform(window, lambda s: s.bitwiseXOR(F.lit(_CONSTANTS[band])))))

    return F.array(*[key(b) for b in range(BANDS)])


def band_keys(grams: Column, stride: int) -> Column:
    """Structs of place and band key of the long windows at every stride-th word."""
    starts = F.sequence(F.lit(0), F.size(grams) - WINDOW_SHINGLES, F.lit(stride))
    keyed = F.transform(starts, lambda at: F.transform(_min_hashes(grams, at), lambda key: F.struct(at.alias("at"), key.alias("key"))))
    return F.when(F.size(grams) >= WINDOW_SHINGLES, F.flatten(keyed)).otherwise(F.array().cast("array<struct<at:int,key:bigint>>"))


def shingle_keys(grams: Column) -> Column:
    """Structs of place and band key of the windows of one shingle."""
    return F.transform(grams, lambda s, i: F.struct(i.alias("at"), s.alias("key")))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, size in words, shingles and band keys of each template."""
    if sum(len(re.findall(WORDS, t)) for t in templates.values()) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MOST_TEMPLATE_WORDS} words: scan with parts of them")
    rows = spark.createDataFrame(list(templates.items()), "license string, text string")
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("grams", shingles(F.col("words")))
    keys = F.when(F.size("words") < LONG_WORDS, shingle_keys(F.col("grams"))).otherwise(band_keys(F.col("grams"), 1))
    return rows.select("license", F.size("words").alias("n_words"), F.array_distinct("grams").alias("template"), F.array_distinct(F.transform(keys, lambda k: k["key"])).alias("keys"))


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment and first_word of every template found in docs (doc_id, text)."""
    spark = docs.sparkSession
    table = template_table(spark, templates or TEMPLATES).collect()
    keys = spark.createDataFrame([(r.license, r.n_words, r.template, k) for r in table for k in r["keys"]], "license string, n_words int, template array<bigint>, key bigint")
    slots = np.zeros(SLOTS, np.uint8)
    slots[[k & (SLOTS - 1) for r in table for k in r["keys"]]] = 1
    filled = F.lit(slots.tobytes())
    may_match = lambda k: F.substring(filled, k["key"].bitwiseAND(F.lit(SLOTS - 1)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", shingles(F.col("words")).alias("grams"))
    both = F.concat(F.filter(shingle_keys(F.col("grams")), may_match), F.filter(band_keys(F.col("grams"), STRIDE), may_match))
    # explode() would have the optimizer infer a filter on its array and evaluate that once more, below the shingles.
    hits = rows.select("doc_id", "grams", F.explode_outer(both).alias("hit")).select("doc_id", "grams", "hit.at", "hit.key").join(F.broadcast(keys), "key")
    first = F.greatest(F.lit(0), F.col("at") - F.col("n_words"))
    near = F.slice("grams", first + 1, 2 * F.col("n_words") + WINDOW_SHINGLES)
    within = F.array_intersect("template", near)
    hits = hits.withColumn("containment", F.size(within) / F.size("template")).where(F.col("containment") >= MIN_CONTAINMENT)
    place = first + F.array_min(F.transform(within, lambda s: F.array_position(near, s))) - 1
    found = hits.select("doc_id", "license", "containment", place.cast("long").alias("first_word"))
    return found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word"))
