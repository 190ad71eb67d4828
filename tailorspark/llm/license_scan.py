"""Licence scans in DataFrame functions only.

A file's *notices* are its lines with a licence cue, its blocks of consecutive
lines (paragraphs, runs of comment lines) with one, and a licence file's whole text.
Notices and licence templates are sparse TF-IDF vectors
(counts times ``ln((1 + N) / (1 + df)) + 1`` over the N templates; a word that no
template has weighs as df = 0), and a notice has the licence of the template
with the largest cosine, if that is at least ``MIN_COSINE``.  One-sentence notices
(``TEMPLATES``) and licence bodies and headers (``BODIES``) are two such sets of
templates; "All rights reserved" decides only if nothing else in the file does, and a
line that denies a licence ("is not released under ...") names none, alone or in a block.

A file without a notice of its own inherits: of the licence files in its
directory and the directories above, up to its repository's root, the nearest
directory's count.  Directories are joined with their ancestors' paths, so this
is an equality join, and files only meet their own directory's answer.

Equal notices, texts and directories are worked out once: a notice in a third of
all files is one row by the time it is compared.

Defined results: null text or path -> no notice; a file without a path lies in
its repository's root; null repositories are one repository.  Equal cosines ->
alphabetically first licence; several licence files in one directory -> all
their licences, sorted, joined by " AND ".  Rows repeat as they come; columns
beyond those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailorspark.llm.store import stored

MIN_COSINE = 0.6
#: Fixed patterns: a line that may be a notice, a file that holds a licence, the words of a notice.
CUE = r"(?i)licen[cs]e|licensing|copyright|copyleft|spdx|public domain|all rights reserved"
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"
_SEPARATORS = r"[^0-9a-z.+]+"
#: Blocks of lines: without a blank line, or comments of one kind with the empty comment lines between.
_BLANK = r"\n[\x20\t\r]*\n"
_COMMENTS = r"(?:(?<![^\n])[\x20\t]*+(?:#|//|/?\*|--|;|%|\"|')[^\n]*+(?:\n|\z))++"

# Notices by which the licences are commonly stated.
TEMPLATES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in "
                   "compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the "
                     "LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
                     "License."),
    ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
                     "License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", "Licensed under the ISC License."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: ")
_MIT_REST = ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
             "the Software. ")
_AS_IS = ("THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
          "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
          "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
          "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. ")
_BSD_3 = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
          "products derived from this software without specific prior written permission. ")
_BSD_REST = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, "
             "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
             "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
             "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
             "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
             "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING "
             "IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. ")
_ISC_REST = ("THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
             "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
             "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
             "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
             "USE OR PERFORMANCE OF THIS SOFTWARE.")
_APACHE = ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
           "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 ")
_APACHE_REST = ("Unless required by applicable law or agreed to in writing, software distributed under the License is "
                "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See "
                "the License for the specific language governing permissions and limitations under the License.")
_UNLICENSE = ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
              "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
              "purpose, commercial or non-commercial, and by any means. ")
_MPL = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.")


def _gnu(name: str, version: str) -> list[str]:
    """The GNU licences' header: its first paragraph, and all three."""
    first = (f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as "
             f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
             f"later version. ")
    return [first, first + "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
            "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
            f"{name} for more details. You should have received a copy of the GNU {name} along with this program. If not, see "
            "https://www.gnu.org/licenses/."]


# Bodies, standard headers and (of the long licences) titles; vectors of their own, beside TEMPLATES.
BODIES = [
    *[("AGPL-3.0", t) for t in _gnu("Affero General Public License", "3")],
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", _APACHE), ("Apache-2.0", _APACHE + _APACHE_REST),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", _BSD), ("BSD-2-Clause", _BSD + _BSD_REST),
    ("BSD-3-Clause", _BSD + _BSD_3), ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_REST),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    *[("GPL-2.0", t) for t in _gnu("General Public License", "2")],
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    *[("GPL-3.0", t) for t in _gnu("General Public License", "3")],
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", _ISC), ("ISC", _ISC + _ISC_REST),
    *[("LGPL-3.0", t) for t in _gnu("Lesser General Public License", "3")],
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", _MIT), ("MIT", _MIT + _MIT_REST), ("MIT", _MIT + _MIT_REST + _AS_IS),
    ("MPL-2.0", _MPL), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE + _AS_IS),
]


#: A line that denies a licence names none.
NEGATED = r"(?i)\b(is|are|was|were|been|be)\s+(not|never|no longer)\s+(\w+\s+)?(licen[cs]ed|released|distributed|published|covered|available)\b"


def _terms(text: Column) -> Column:
    """Lower-case words; full stops only count inside one (version numbers)."""
    words = F.transform(F.split(F.lower(text), _SEPARATORS), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    return F.filter(words, lambda w: w != "")


def template_vectors(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """``(template, license, term, idf, weight)``: unit vectors of the templates, a row per term."""
    t = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(templates)], "template int, license string, text string")
    tf = t.select("template", "license", F.explode(_terms(F.col("text"))).alias("term")) \
        .groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("term", (F.log(F.lit(1.0 + len(templates)) / (F.col("df") + 1)) + 1).alias("idf"))
    w = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "template").select("template", "license", "term", "idf", (F.col("w") / F.col("norm")).alias("weight"))


def classify(notices: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = MIN_COSINE) -> DataFrame:
    """``(id, license, cosine)`` of the notices ``(id, notice)`` that resemble a template, a row per id.

    Terms carry the notice's id, not its text: a whole licence text has many.
    """
    vectors = stored(template_vectors(notices.sparkSession, templates), "templates")
    idf = vectors.select("term", "idf").distinct()
    unseen = F.lit(1.0 + len(templates))
    tf = notices.select("id", F.explode(_terms(F.col("notice"))).alias("term")) \
        .groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    w = tf.join(idf, "term", "left").select("id", "term", (F.col("tf") * F.coalesce("idf", F.log(unseen) + 1)).alias("w"))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = w.join(vectors, "term").groupBy("id", "template", "license").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosine = dot.join(norm, "id").select("id", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"))
    # the largest cosine, and of equal ones the first licence
    best = cosine.groupBy("id", "license").agg(F.max("cosine").alias("cosine")).groupBy("id").agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    return best.select("id", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine")) \
        .where(F.col("cosine") >= least)


def _directory(path: Column) -> Column:
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"(^|/)[^/]*$", "")


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = MIN_COSINE,
         bodies: list[tuple[str, str]] = BODIES) -> DataFrame:
    """Add to every row of ``files`` (repo, path, text, any others): ``own_license``, ``own_cosine``,
    ``inherited_license``, ``inherited_from`` (a directory, "" the root) and ``license`` (own, else
    inherited).  Columns of those names in ``files`` are replaced.
    """
    added = ["own_license", "own_cosine", "inherited_license", "inherited_from", "license"]
    files = files.select(*[F.col(f"`{c}`") for c in files.columns if c not in added])
    whole = F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False))
    # a text's notices depend on whether it is a licence file; the key says both
    key = F.md5(F.concat(F.when(whole, "1").otherwise("0"), F.coalesce("text", F.lit(""))))
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(CUE))
    blocks = F.filter(F.transform(F.concat(F.split(text, _BLANK), F.regexp_extract_all(text, F.lit(_COMMENTS), F.lit(0))),
                                  lambda x: F.regexp_replace(x, f"(?m)^.*{NEGATED}.*$", "")), lambda x: x.rlike(CUE))
    units = files.where(text.rlike(CUE) | whole).select(
        key.alias("_key"), F.explode(F.array_distinct(F.concat(
            lines, blocks, F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>"))))).alias("notice"))
    units = units.where(F.col("notice").contains("\n") | ~F.col("notice").rlike(NEGATED))
    units = stored(units.select("_key", F.unhex(F.md5("notice")).alias("id"), "notice").distinct(), "notices")
    notices = units.groupBy("id").agg(F.min("notice").alias("notice"))
    licenses = classify(notices, templates, least).unionByName(classify(notices, bodies, least))
    found = units.select("_key", "id").join(stored(licenses, "licenses"), "id")
    own = found.groupBy("_key").agg(F.min(F.struct(
        (F.col("license") == "Proprietary").alias("last"), (-F.col("cosine")).alias("c"), "license")).alias("b")) \
        .select("_key", F.col("b.license").alias("own_license"), (-F.col("b.c")).alias("own_cosine"))
    own = stored(own, "own")

    keyed = files.withColumns({"_key": key, "_repo": F.coalesce("repo", F.lit("")), "_dir": _directory(F.col("path")),
                               "_whole": whole})
    # licences of the directories that hold licence files
    held = keyed.where("_whole").select("_key", "_repo", "_dir").join(own, "_key") \
        .groupBy("_repo", F.col("_dir").alias("up")).agg(F.array_sort(F.collect_set("own_license")).alias("held"))
    parts = F.split("_dir", "/")
    # "a/b" -> "a/b", "a", ""
    upward = F.when(F.col("_dir") == "", F.array(F.lit(""))).otherwise(F.concat(
        F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")),
        F.array(F.lit(""))))
    above = keyed.select("_repo", "_dir").distinct().select("_repo", "_dir", F.posexplode(upward).alias("away", "up"))
    nearest = above.join(held, ["_repo", "up"]).groupBy("_repo", "_dir").agg(
        F.min(F.struct("away", "up", "held")).alias("n")).select(
        "_repo", "_dir", F.array_join("n.held", " AND ").alias("inherited_license"), F.col("n.up").alias("inherited_from"))

    out = keyed.join(own, "_key", "left").join(nearest, ["_repo", "_dir"], "left")
    return out.select(*[F.col(f"`{c}`") for c in files.columns], *added[:4],
                      F.coalesce("own_license", "inherited_license").alias("license"))
