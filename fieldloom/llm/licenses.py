"""License texts found in documents, with column functions only.

Templates are sets of word shingles. Shingles of a document that no template has cannot count for
any and are passed over where they arise. The others fall into overlapping windows as long as two
templates of a size class, so a template lies whole inside one. Per window, MinHash bands retrieve
templates, and the exact share of a template's shingles in the window decides.

Bands have one row each, so a window and a template collide in one with a probability of their
similarity. The least similarity of a find is that of a window that holds just the share asked for
and only other templates' shingles beside it; a size class has as many bands as miss its worst
template with a probability below ``MISS`` (``bands_of``).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.fingerprints import shingle_hashes
from fieldloom.llm.stage import written

SHINGLE = 5
LEAST_SHARE = 0.75
NO_LITERAL = -(1 << 63)  # cannot be written as a negated number
# The probability with which bands may miss a find.
MISS = 1e-9

# License statements, openings of notices, and whole notices and short licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "BSD notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"
    ),
    "MIT": "Released under the MIT License.",
    "MIT notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction'
    ),
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "AGPL-3.0 notice": (
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero '
        'General Public License as published by the Free Software Foundation, either version 3 of the License, or (at '
        'your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY '
        'WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU '
        'Affero General Public License for more details. You should have received a copy of the GNU Affero General Public '
        'License along with this program'
    ),
    "Apache-2.0 whole notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        'with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless '
        'required by applicable law or agreed to in writing, software distributed under the License is distributed on an '
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        'specific language governing permissions and limitations under the License.'
    ),
    "BSD-2-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the '
        'following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this '
        'list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above '
        'copyright notice, this list of conditions and the following disclaimer in the documentation and/or other '
        'materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS '
        '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        'MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR '
        'CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES '
        '(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR '
        'BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR '
        'TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF '
        'THE POSSIBILITY OF SUCH DAMAGE.'
    ),
    "BSD-3-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the '
        'following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this '
        'list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above '
        'copyright notice, this list of conditions and the following disclaimer in the documentation and/or other '
        'materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its '
        'contributors may be used to endorse or promote products derived from this software without specific prior '
        'written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS '
        'OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR '
        'A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY '
        'DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, '
        'PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER '
        'CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR '
        'OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH '
        'DAMAGE.'
    ),
    "BSL-1.0": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and '
        'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, '
        'execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties '
        'to whom the Software is furnished to do so, all subject to the following:'
    ),
    "EPL-2.0 notice": (
        'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 '
        'which is available at https://www.eclipse.org/legal/epl-2.0/'
    ),
    "GPL-2.0 notice": (
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General '
        'Public License as published by the Free Software Foundation; either version 2 of the License, or (at your '
        'option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY '
        'WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU '
        'General Public License for more details. You should have received a copy of the GNU General Public License along '
        'with this program'
    ),
    "GPL-3.0 notice": (
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General '
        'Public License as published by the Free Software Foundation, either version 3 of the License, or (at your '
        'option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY '
        'WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU '
        'General Public License for more details. You should have received a copy of the GNU General Public License along '
        'with this program'
    ),
    "ISC": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby '
        'granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE '
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        'WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, '
        'INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, '
        'WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE '
        'USE OR PERFORMANCE OF THIS SOFTWARE.'
    ),
    "LGPL-2.1 notice": (
        'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser '
        'General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at '
        'your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY '
        'WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU '
        'Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public '
        'License along with this library'
    ),
    "LGPL-3.0 notice": (
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser '
        'General Public License as published by the Free Software Foundation, either version 3 of the License, or (at '
        'your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY '
        'WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU '
        'Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public '
        'License along with this program'
    ),
    "MIT text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        'the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and '
        'to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above '
        'copyright notice and this permission notice shall be included in all copies or substantial portions of the '
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        'LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT '
        'SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION '
        'OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER '
        'DEALINGS IN THE SOFTWARE.'
    ),
    "MPL-2.0 whole notice": (
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was '
        'not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.'
    ),
    "Unlicense text": (
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, '
        'use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any '
        'purpose, commercial or non-commercial, and by any means.'
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        'liable for any damages arising from the use of this software. Permission is granted to anyone to use this '
        'software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject '
        'to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim '
        'that you wrote the original software. If you use this software in a product, an acknowledgment in the product '
        'documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as '
        'such, and must not be misrepresented as being the original software. 3. This notice may not be removed or '
        'altered from any source distribution.'
    ),
}
# Whole texts of longer licenses, read by the driver.
TEXTS = Path(__file__).parent / "license_texts"


def all_templates() -> dict[str, str]:
    """``TEMPLATES`` and the whole texts, named after their files."""
    return TEMPLATES | {f"{path.stem} license": path.read_text(encoding="utf-8") for path in sorted(TEXTS.glob("*.txt"))}


def plain_words(text: Column) -> Column:
    """Words of letters and digits in lower case; null counts as empty."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def hashed_shingles(df: DataFrame, text: str, name: str, n: int = SHINGLE) -> DataFrame:
    """``df`` with the hashes of the shingles that begin at every word."""
    hashed = df.withColumn("_words", F.transform(plain_words(F.col(text)), lambda w: F.xxhash64(w)))
    return hashed.withColumn(name, shingle_hashes(F.col("_words"), n)).drop("_words")


def size_class(size: int) -> int:
    """The least power of two that is not below a template's number of shingles."""
    return 1 << (size - 1).bit_length()


def least_similarity(size: int, share: float = LEAST_SHARE) -> float:
    """Similarity of a template and the worst window of its class, two class sizes long, that still
    holds the share of it."""
    held = math.ceil(share * size)
    return held / (size + max(2 * size_class(size) - held, 0))


def bands_of(sizes: list[int], share: float = LEAST_SHARE, miss: float = MISS) -> int:
    """Bands that miss the worst of these templates with a probability of at most ``miss``."""
    worst = min(least_similarity(size, share) for size in sizes)
    return 1 if worst >= 1 else math.ceil(math.log(miss) / math.log1p(-worst))


def template_table(spark: SparkSession, templates: Mapping[str, str]) -> DataFrame:
    """``license, shingles``: a row per template that has words."""
    rows = spark.createDataFrame(list(templates.items()), "license string, text string")
    hashed = hashed_shingles(rows, "text", "all").withColumn("shingles", F.array_distinct("all"))
    return hashed.select("license", "shingles").where(F.size("shingles") > 0)


def band_values(shingles: Column, bands: Column) -> Column:
    """MinHash of a set of shingles in every band."""
    return F.transform(
        F.sequence(F.lit(1), bands),
        lambda b: F.struct(b.alias("band"), F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b))).alias("value")),
    )


def among(placed: str, shingles: Iterable[int]) -> Column:
    """The placed shingles that are of a list.

    Written as text: a call for each of many thousand constants would take the driver's time.
    """
    listed = ", ".join(f"{s}L" if s > NO_LITERAL else f"bigint('{s}')" for s in sorted(shingles))
    return F.expr(f"filter({placed}, x -> x.s in ({listed or 'null'}))")


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    key: str = "doc_id",
    text: str = "text",
    least_share: float = LEAST_SHARE,
    miss: float = MISS,
    decide: bool = False,
) -> DataFrame:
    """``key, license, share, first_word, last_word`` of every template found in a whole text.

    Words are runs of letters and digits in lower case. A template is found where a window holds
    ``least_share`` of its distinct 5-word shingles (a template of fewer words is one shingle,
    found only in texts of just these words). Of several windows the one with the largest share
    counts, then the first; the words are counted from 0 and span the template's shingles in it.
    Null, empty and wordless texts match nothing; repeated rows give one row; no templates, no
    rows. Templates and their shingles are a list of the caller's, and are broadcast: it should
    hold thousands of shingles, not millions.

    With ``decide``, a find is left out if another at its place has all of its shingles and more,
    or as many and a larger share: clauses in which licenses with a common text differ decide
    between them, and a whole notice stands for its opening.
    """
    spark = docs.sparkSession
    # Collected to become constants of the plan: a few shingles for each template given.
    known = template_table(spark, templates).collect()
    vocabulary = sorted({s for row in known for s in row["shingles"]})
    classes, members = {}, {}
    for row in known:
        span = size_class(len(row["shingles"]))
        classes.setdefault(span, []).append(len(row["shingles"]))
        members.setdefault(span, set()).update(row["shingles"])
    spans = sorted(classes)
    bands = {span: bands_of(sizes, least_share, miss) for span, sizes in classes.items()}
    found = docs.select(F.col(key), F.xxhash64(text).alias("_body"), F.col(text).alias("_text"))
    found = hashed_shingles(found, "_text", "_all").drop("_text")
    found = found.withColumn("_placed", F.transform("_all", lambda s, i: F.struct(s.alias("s"), i.alias("at"))))
    # The row number keeps the condition above the projection, which would be computed for both.
    found = found.select(key, "_body", among("_placed", vocabulary).alias("_hits"), F.monotonically_increasing_id().alias("_row"))
    # Few rows are left, and each is used several times from here on.
    found = written(found.where(F.size("_hits") > 0).drop("_row"))

    # A class sees the shingles of its own templates only, so small ones have few windows in long texts.
    of_class = [
        F.struct(F.lit(span).alias("span"), F.lit(bands[span]).alias("bands"), among("_hits", members[span]).alias("hits"))
        for span in spans
    ]
    every = F.array(*of_class) if spans else F.expr("cast(array() as array<struct<span:int,bands:int,hits:array<struct<s:bigint,at:int>>>>)")
    cut = found.select(key, "_body", F.inline(every)).where(F.size("hits") > 0)
    at = F.transform("hits", lambda x: F.floor(x["at"] / F.col("span")).cast("int"))
    both = F.flatten(F.transform(at, lambda w: F.array(w, F.greatest(w - 1, F.lit(0)))))
    cut = cut.withColumn("window", F.explode(F.array_distinct(both)))
    inside = F.filter("hits", lambda x: F.floor(x["at"] / F.col("span")).between(F.col("window"), F.col("window") + 1))
    cut = cut.select(key, "_body", "span", "bands", "window", inside.alias("_hits"))
    banded = cut.withColumn("_values", band_values(F.transform("_hits", lambda x: x["s"]), F.col("bands")))
    banded = banded.withColumn("_b", F.explode("_values"))
    sized = [(row["license"], row["shingles"], size_class(len(row["shingles"]))) for row in known]
    sets = spark.createDataFrame([(*row, bands[row[2]]) for row in sized], "license string, shingles array<long>, _span int, _bands int")
    sets = sets.withColumn("_asked", band_values(F.col("shingles"), F.col("_bands")))
    asked = sets.select("license", "_span", "_asked", F.explode("_asked").alias("_a"))
    # Of the bands in which a window and a template meet, the first hands the pair on.
    equal = F.zip_with("_values", "_asked", lambda one, other: one["value"] == other["value"])
    met = (
        banded.join(
            F.broadcast(asked),
            (F.col("span") == F.col("_span")) & (F.col("_b.band") == F.col("_a.band")) & (F.col("_b.value") == F.col("_a.value")),
        )
        .where(F.array_position(equal, True) == F.col("_b.band"))
        .select(key, "_body", "license", "window", "_hits")
        .join(F.broadcast(sets.select("license", "shingles")), "license")
    )
    held = F.size(F.array_intersect(F.transform("_hits", lambda x: x["s"]), "shingles"))
    own = F.filter("_hits", lambda x: F.array_contains(F.col("shingles"), x["s"]))
    sure = (
        met.withColumn("share", held / F.size("shingles"))
        .where(F.col("share") >= least_share)
        .withColumn("_own", own)
        .select(
            key,
            "_body",
            "license",
            "share",
            F.element_at("_own", 1)["at"].alias("first_word"),
            (F.element_at("_own", -1)["at"] + SHINGLE - 1).alias("last_word"),
            *([F.transform("_own", lambda x: x["at"]).alias("_at")] if decide else []),
        )
    )
    if decide:
        sure = _decided(sure, key)
    best = F.max(F.struct("share", -F.col("first_word"), -F.col("last_word"))).alias("_best")
    return (
        sure.groupBy(key, "_body", "license")
        .agg(best)
        .select(key, "license", F.col("_best.share").alias("share"), (-F.col("_best.col2")).alias("first_word"), (-F.col("_best.col3")).alias("last_word"))
    )


def _decided(sure: DataFrame, key: str) -> DataFrame:
    """Finds that no other find at their place beats; a document's finds are few."""
    find = F.struct("license", "share", "first_word", "last_word", "_at")

    def beaten(found: Column, by: Column) -> Column:
        shared = F.size(F.array_except(found["_at"], by["_at"])) == 0
        more = F.struct(F.size(by["_at"]), by["share"], by["license"]) > F.struct(F.size(found["_at"]), found["share"], found["license"])
        return (found["license"] != by["license"]) & more & shared

    held = sure.groupBy(key, "_body").agg(F.collect_set(find).alias("_finds"))
    kept = F.filter("_finds", lambda found: ~F.exists("_finds", lambda by: beaten(found, by)))
    return held.select(key, "_body", F.inline(kept)).drop("_at")
