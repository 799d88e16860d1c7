"""Licence scans: Dice coefficient over word bigrams against licence templates, in DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short notices of public licences, by SPDX identifier; all_templates() has standard headers and short whole texts too.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
_GNU_ONLY = "This work is licensed under the GNU {name}, version {version}."
_CC = "This work is licensed under a Creative Commons Attribution{name} 4.0 International License."
_ASIS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_NO_ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_MIT = dict(TEMPLATES)["MIT"]

#: Standard headers, and whole texts short enough to stand here.
HEADERS = [
    ("AGPL-3.0-only", _GNU_ONLY.format(name="Affero General Public License", version="3")),
    ("AGPL-3.0-or-later", _GNU.format(name="Affero General Public License", version="3")),
    ("BSD-2-Clause", _BSD + _ASIS),
    ("BSD-3-Clause", _BSD + _NO_ENDORSEMENT + _ASIS),
    ("BSL-1.0", 'Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("CC-BY-NC-4.0", _CC.format(name="-NonCommercial")),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", _CC.format(name="-NonCommercial-NoDerivatives")),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", _CC.format(name="-NonCommercial-ShareAlike")),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", _CC.format(name="-NoDerivatives")),
    ("CC-BY-SA-4.0", _CC.format(name="-ShareAlike")),
    ("GPL-2.0-only", _GNU_ONLY.format(name="General Public License", version="2")),
    ("GPL-2.0-or-later", _GNU.format(name="General Public License", version="2")),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("LGPL-2.1-only", _GNU_ONLY.format(name="Lesser General Public License", version="2.1")),
    ("LGPL-2.1-or-later", _GNU.format(name="Lesser General Public License", version="2.1")),
    ("LGPL-3.0-only", _GNU_ONLY.format(name="Lesser General Public License", version="3")),
    ("LGPL-3.0-or-later", _GNU.format(name="Lesser General Public License", version="3")),
    ("MIT", _MIT + ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]

THRESHOLD = 0.8


def all_templates() -> list[tuple[str, str]]:
    """Notices, headers and short whole texts; long texts (GPL, LGPL, MPL, Apache and others) have headers only."""
    return [*TEMPLATES, *HEADERS]


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _bigrams(unit: Column) -> Column:
    words = F.filter(F.split(unit, " "), lambda w: w != "")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


#: Words too common to tell a licence by; a signature takes them last.
COMMON = {"a", "and", "any", "by", "for", "in", "is", "of", "or", "the", "this", "to", "under", "with", "you"}


def signature_words(bigrams: list[str], threshold: float) -> list[str]:
    """Words of which a matching unit has one at least.

    A match shares threshold / (2 - threshold) of the template's bigrams. The words taken cover so many bigrams that a unit without
    any of them shares too few, so dropping such units loses no match.
    """
    needed = math.ceil(threshold / (2 - threshold) * len(bigrams) - 1e-9)
    words = sorted({w for b in bigrams for w in b.split()}, key=lambda w: (w in COMMON, -len(w), w))
    taken: list[str] = []
    while sum(any(w in taken for w in b.split()) for b in bigrams) < len(bigrams) - needed + 1:
        taken.append(words.pop(0))
    return taken


def scan_licences(df: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Add n_matches, license_ids, best_license, best_dice and licensed to each row; no shuffle, one row in, one row out.

    Units are the lines, the paragraphs of several lines and, if there are several paragraphs, the whole text. A unit of b distinct
    bigrams is compared only with templates of t bigrams for which 2 * min(b, t) / (b + t) reaches the threshold (the size bound), and
    matches the templates of the greatest Dice coefficient if that does; units without a template's signature words can't match and are dropped first. Null or
    empty text matches nothing; ties of the best match go to the smallest identifier. Repeated rows get equal results; columns of the
    result's names are replaced.
    """
    # Empty templates can't match. The table is a literal of fixed size: part of the plan, not of the data.
    table = [(i, b) for i, t in (all_templates() if templates is None else templates) if (b := template_bigrams(t))]
    known = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(len(b)).alias("n"), F.split(F.lit(",".join(b)), ",").alias("bigrams")) for i, b in table])
    signs = F.split(F.lit(",".join(sorted({w for _, b in table for w in signature_words(b, threshold)}))), ",")

    def signed(x: Column) -> Column:
        return F.arrays_overlap(F.split(x, " "), signs)

    none = F.array().cast("array<string>")
    df = df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    normal = F.regexp_replace("_low", r"[^a-z0-9\n]+", " ")
    paragraphs = F.split(normal, r"\n *\n")
    several = F.when(F.size(paragraphs) > 1, F.array(F.regexp_replace(normal, "\n", " "))).otherwise(none)
    blocks = F.transform(F.filter(paragraphs, lambda p: p.contains("\n")), lambda p: F.regexp_replace(p, "\n", " "))
    units = F.filter(F.concat(F.split(normal, "\n"), blocks, several), signed)
    out = df.withColumn("_bigrams", F.when(signed(F.translate(normal, "\n", " ")), F.transform(units, _bigrams)).otherwise(F.array().cast("array<array<string>>")))

    def matches(b: Column) -> Column:
        fits = F.filter(known, lambda t: F.lit(2.0) * F.least(F.size(b), t["n"]) >= F.lit(threshold) * (F.size(b) + t["n"]))
        found = F.transform(fits, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(b, t["bigrams"])) / (F.size(b) + t["n"])).alias("dice"), t["id"].alias("id")))
        # Versions of a licence differ in a few words: of a unit's templates, the most like it count.
        return F.transform(F.array(found), lambda x: F.filter(x, lambda h: h["dice"] == F.array_max(x["dice"])))[0]

    out = out.withColumn("_hits", F.filter(F.flatten(F.transform(F.col("_bigrams"), matches)), lambda h: h["dice"] >= threshold))
    best = F.array_max(F.col("_hits")["dice"])
    return (
        out.withColumn("n_matches", F.size("_hits").cast("long"))
        .withColumn("license_ids", F.array_join(F.array_sort(F.array_distinct(F.col("_hits")["id"])), ","))
        .withColumn("best_license", F.array_min(F.filter("_hits", lambda h: h["dice"] == best)["id"]))
        .withColumn("best_dice", F.round(best, 6))
        .withColumn("licensed", F.size("_hits") > 0)
        .drop("_low", "_bigrams", "_hits")
    )


def op10_licence_dice(spark, sf_dir: str) -> DataFrame:
    """Licence notices of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_licences(docs.select("doc_id", "text")).drop("text")
