"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Native: DataFrame functions only. The units of a text are its lines, its paragraphs of several lines, and the whole text
of several paragraphs; those that hold one of the marker phrases become sparse TF-IDF vectors over the templates' vocabulary and
are matched with every template, headers and whole licence texts, by an inner join on the token. Every template holds a marker. A text is a
licence file if it matches as a whole, or if its matched lines or paragraphs make up at least
half of it; it then speaks for its directory. A text without a notice
takes the licence of the nearest directory above it that has one, found by joining the directories'
ancestor paths.

Results. One row for each row in. A null text has no notice, a null path is the
root directory. Repeated rows have equal results. Among licences of equal
cosine, and among files of one directory, the better cosine and then the lower name wins. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.store import Scratch

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE_FORM = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY_FORM = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NO_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
    "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:"
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, "
    "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
    "FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
)

#: Headers and texts of well-known licences; what follows a slash tells texts of one licence apart.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT/grant": _MIT,
    "MIT/file": f"MIT License Copyright (c) {_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0/header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0/file": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/header": _GNU.format("General Public License", 3),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0/header": _GNU.format("General Public License", 2),
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0/header": _GNU.format("Lesser General Public License", 3),
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0/header": _GNU.format("Affero General Public License", 3),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause": "Permitted under the 3-clause BSD license",
    "BSD-3-Clause/file": f"BSD 3-Clause License Copyright (c) All rights reserved. {_REDISTRIBUTION} 1. {_SOURCE_FORM} 2. {_BINARY_FORM} 3. {_NO_NAME} {_DISCLAIMER}",
    "BSD-2-Clause": "Permitted under the 2-clause BSD license",
    "BSD-2-Clause/grant": _REDISTRIBUTION,
    "BSD-2-Clause/file": f"BSD 2-Clause License Copyright (c) All rights reserved. {_REDISTRIBUTION} 1. {_SOURCE_FORM} 2. {_BINARY_FORM} {_DISCLAIMER}",
    "ISC/file": "ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "Copyright. All rights reserved.",
}
MARKERS = r"(?i)licen[sc]e|copyright|spdx|rights reserved|public domain|permission is hereby|redistribution and use|free software"
#: What parts paragraphs.
BLANK = "\n[ \t\r]*\n"
TOKEN = "[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]"
COSINE = 0.6


def _tokens(text: str) -> list[str]:
    import re

    return re.findall(TOKEN, text.lower())


def weights() -> tuple[list[tuple[str, float]], list[tuple[str, str, float]]]:
    """(token, idf) of the vocabulary and (license, token, weight) of the templates' unit vectors."""
    counts = {name: Counter(_tokens(t)) for name, t in TEMPLATES.items()}
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
    out = []
    for name, c in counts.items():
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        out += [(name, t, n * idf[t] / norm) for t, n in c.items()]
    return sorted(idf.items()), out


def scan(docs: DataFrame, *, text: str = "text", path: Column, keep: list[str], cosine: float = COSINE) -> DataFrame:
    """Licence of every row: the kept columns and path, own_license, own_cosine, n_notices, is_license_file, license, via.

    via: header (own notice), file (own, and the row is a licence file), inherited, or null without licence.
    """
    spark = docs.sparkSession
    vocabulary, vectors = weights()
    # Constants of the template list: a few hundred rows, whatever the input.
    idf = F.broadcast(spark.createDataFrame(vocabulary, "token string, idf double"))
    template = F.broadcast(spark.createDataFrame(vectors, "license string, token string, weight double"))
    rows = docs.select(*[F.col(c) for c in keep], F.coalesce(path, F.lit("")).alias("path"), F.col(text).alias("__text"))
    rows = rows.withColumn("__row", F.xxhash64("path", "__text", *keep))
    marked = rows.where(F.col("__text").rlike(MARKERS)).select("__row", "__text").distinct()
    tagged = lambda parts, kind, many: F.transform(F.filter(parts, lambda x: many(x)), lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x).alias("chars"), x.alias("body")))
    units = F.concat(
        tagged(F.split("__text", "\n"), 0, lambda x: F.lit(True)),
        tagged(F.split("__text", BLANK), 1, lambda x: x.contains("\n")),
        tagged(F.array("__text"), 2, lambda x: x.rlike(BLANK)),
    )
    lines = (
        marked.select("__row", F.length("__text").alias("__size"), F.posexplode(units).alias("__line", "u"))
        .where(F.col("u.body").rlike(MARKERS))
        .select("__row", "__size", "__line", F.col("u.kind").alias("__kind"), F.col("u.chars").alias("__chars"), F.explode(F.regexp_extract_all(F.lower("u.body"), F.lit(TOKEN), F.lit(0))).alias("token"))
    )
    counted = lines.groupBy("__row", "__line", "token").agg(F.count("*").alias("n"), F.max("__kind").alias("__kind"), F.max("__chars").alias("__chars"), F.max("__size").alias("__size"))
    # Written once, as both aggregations below read it: the texts of a few rows in a hundred, by token.
    weighed = Scratch(spark, "license").keep(counted.join(idf, "token").withColumn("x", F.col("n") * F.col("idf")), "weighed")
    # Dot products and the vector's own length in one aggregation: a row without template adds to the length.
    dots = weighed.join(template, "token").groupBy("__row", "__line", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    norms = weighed.groupBy("__row", "__line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.max("__kind").alias("__kind"), F.max("__chars").alias("__chars"), F.max("__size").alias("__size"))
    matched = (
        dots.join(norms, ["__row", "__line"])
        .withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6))
        .where(F.col("cosine") >= cosine)
        .groupBy("__row", "__line")
        .agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.substring_index("license", "/", 1).alias("license"))).alias("best"), F.max("__kind").alias("__kind"), F.max("__chars").alias("__chars"), F.max("__size").alias("__size"))
    )
    own = matched.groupBy("__row").agg(
        F.min("best").alias("best"),
        F.count_if(F.col("__kind") < 2).alias("n_notices"),
        (F.greatest(*[F.sum(F.when(F.col("__kind") == k, F.col("__chars")).otherwise(0)) for k in range(3)]) * 2 >= F.max("__size")).alias("is_license_file"),
    )
    own = own.select("__row", F.col("best.license").alias("own_license"), (-F.col("best.c")).alias("own_cosine"), "n_notices", "is_license_file")
    found = rows.drop("__text").join(own, "__row", "left").withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    files = own.where("is_license_file").join(rows.select("__row", "path").distinct(), "__row")
    declared = (
        files.groupBy(F.regexp_replace("path", "/?[^/]*$", "").alias("ancestor"))
        .agg(F.min(F.struct((-F.col("own_cosine")).alias("c"), F.col("own_license").alias("license"))).alias("d"))
        .select("ancestor", F.col("d.license").alias("dir_license"))
    )
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("ancestor")))
    inherited = (
        found.select("dir").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.ancestor").distinct()
        .join(declared, "ancestor")
        .groupBy("dir").agg(F.max_by("dir_license", "depth").alias("dir_license"))
    )
    out = found.join(inherited, "dir", "left")
    license_ = F.coalesce("own_license", "dir_license")
    via = F.when(F.col("own_license").isNotNull(), F.when(F.col("is_license_file"), "file").otherwise("header")).when(F.col("dir_license").isNotNull(), "inherited")
    return out.select(
        *keep, "path", "own_license", "own_cosine", F.coalesce("n_notices", F.lit(0)).cast("bigint").alias("n_notices"),
        F.coalesce("is_license_file", F.lit(False)).alias("is_license_file"), license_.alias("license"), via.alias("via"),
    )
