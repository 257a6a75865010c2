"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm._store import small_side, stored

# License names, whole short licenses, usual notices, titles of long licenses.
SPDX = ["MIT", "MIT-0", "X11", "ISC", "Zlib", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "Apache-1.1", "Apache-2.0", "BSL-1.0",
        "Unlicense", "WTFPL", "CC0-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0",
        "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CDDL-1.0", "EUPL-1.2", "Artistic-2.0", "OFL-1.1",
        "PSF-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
        "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later"]
_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
          "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
          "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
          "subject to the following conditions:")
_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
          "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
          "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
          "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_REDISTRIBUTION = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                   "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                   "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
                   "the following disclaimer in the documentation and/or other materials provided with the distribution.")
_ENDORSE = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
            "this software without specific prior written permission.")
_BSD_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
              "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
              "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
              "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
              "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
              "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.")
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
        "Foundation, either version {version} of the License, or (at your option) any later version.")
_GNU_OLD = ("This program is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
            "Foundation; either version {version} of the License, or (at your option) any later version.")
_GNU_AS_IS = ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
              "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.")
_GNU_COPY = "You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
_APACHE = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
           "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")
_APACHE_AS_IS = ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
                 "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                 "permissions and limitations under the License.")
_MPL = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.")
_FAMILIES = [("GPL-2.0", "GNU General Public License", "2", "June 1991"), ("GPL-3.0", "GNU General Public License", "3", "29 June 2007"),
             ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "February 1999"),
             ("LGPL-3.0", "GNU Lesser General Public License", "3", "29 June 2007"),
             ("AGPL-3.0", "GNU Affero General Public License", "3", "19 November 2007")]
_NAMED = [("MIT", "MIT License"), ("ISC", "ISC License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
          ("Apache-2.0", "Apache License, Version 2.0"), ("MPL-2.0", "Mozilla Public License, version 2.0"),
          ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-ND-4.0", "CC BY-ND 4.0")]
# End of fixed values.


def _templates() -> list[tuple[str, str]]:
    out = [(s.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {s}") for s in SPDX]
    for name, title in [*_NAMED, *[(f[0], f"{f[1]}, version {f[2]}") for f in _FAMILIES]]:
        out += [(name, title), (name, f"Licensed under the {title}."), (name, f"Released under the {title}."),
                (name, f"This work is licensed under the {title}."), (name, f"Subject to the terms of the {title}.")]
    for name, title, version, day in _FAMILIES:
        head = (_GNU_OLD if version.startswith("2") else _GNU).format(name=title, version=version)
        rest = f"{_GNU_AS_IS} {_GNU_COPY}".format(name=title)
        out += [(name, f"{title} Version {version}, {day}"), (name, head), (name, f"{head} {rest}")]
    out += [("MIT", _GRANT), ("MIT", f"{_GRANT} {_NOTICE} {_AS_IS}"), ("BSD-2-Clause", f"{_REDISTRIBUTION} {_BSD_AS_IS}"),
            ("BSD-3-Clause", f"{_REDISTRIBUTION} {_ENDORSE} {_BSD_AS_IS}"), ("ISC", _ISC), ("Apache-2.0", _APACHE),
            ("Apache-2.0", f"{_APACHE} {_APACHE_AS_IS}"), ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
            ("MPL-2.0", _MPL), ("MPL-2.0", "Mozilla Public License Version 2.0")]
    return out


TEMPLATES = _templates()
COSINE = 0.8
LENGTH = 2      # the SQL of the query weighs no unit of more words than this times the longest template; here all are weighed
BLANK = "\n[^A-Za-z0-9\n]*\n"                                                     # between blocks
COPYRIGHT = r"(^|\n)[^A-Za-z0-9\n]*[Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt] [^\n]*"   # whose work it is says nothing of the license


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def units(files: DataFrame) -> DataFrame:
    """(id, version, kind, pos, last, words): lines (kind 0), blocks between blank lines (1) and the whole text (2); ``last`` ends the text.

    Lines of copyright holders are left out of blocks and whole texts;
    ``version`` tells different texts of one id apart.
    """
    kept = F.regexp_replace("text", COPYRIGHT, "\n")
    pieces = files.select("id", F.xxhash64("text").alias("version"), F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.split("text", "\n").alias("pieces")),
        F.struct(F.lit(1).alias("kind"), F.split(kept, BLANK).alias("pieces")),
        F.struct(F.lit(2).alias("kind"), F.array(kept).alias("pieces")))).alias("u")).select("id", "version", "u.kind", "u.pieces")
    each = pieces.select("id", "version", "kind", F.size("pieces").alias("n"), F.posexplode("pieces").alias("pos", "piece"))
    return each.select("id", "version", "kind", "pos", (F.col("pos") == F.col("n") - 1).alias("last"), terms(F.col("piece")).alias("words"))


def key_terms(weights: DataFrame, least: float) -> list[str]:
    """Terms of which a unit must have one to reach ``least`` with any template.

    Without the rarest terms of a template, the others' squared weights sum to
    less than the square of ``least``, and so does any unit's squared cosine.
    """
    rarest = Window.partitionBy("template").orderBy(F.desc("idf"), F.desc("weight"), "term")
    rows = weights.withColumn("left", 1 - F.sum(F.col("weight") * F.col("weight")).over(rarest.rowsBetween(Window.unboundedPreceding, -1)))
    # As large as the templates, which are a parameter and not data.
    return sorted(r["term"] for r in rows.filter(F.coalesce("left", F.lit(1.0)) >= (least - 1e-6) ** 2).select("term").distinct().collect())


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def term_counts(words: Column) -> Column:
    """[(term, tf)] of a unit, as the runs of its sorted words."""
    def runs(s: Column) -> Column:
        starts = F.array_compact(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)))
        return _let(starts, lambda p: F.transform(p, lambda i, k: F.struct(
            F.get(s, i).alias("term"), (F.coalesce(F.get(p, k + 1), F.size(s)) - i).alias("tf"))))
    return _let(F.sort_array(words), runs)


def may_reach(counts: Column, idf: dict[str, float], least: float) -> Column:
    """Whether a unit of these term counts can reach ``least`` with templates whose terms have these ``idf``.

    No cosine exceeds the share of the unit's length that lies in template
    terms; any other term weighs its count at least, as no inverse frequency is
    below 1.
    """
    square = (least - 1e-6) ** 2
    inside = F.map_from_arrays(F.array(*map(F.lit, idf)), F.array(*[F.lit(v * v * (1 - square)) for v in idf.values()]))
    gain = lambda term: F.when(term.isin(*idf), inside[term]).otherwise(-square)
    return F.aggregate(counts, F.lit(0.0), lambda a, c: a + c["tf"].cast("double") * c["tf"] * gain(c["term"])) >= 0


def statements(files: DataFrame, templates: list[tuple[str, str]] | None = None, *, least: float = COSINE) -> DataFrame:
    """(id, version, kind, pos, last, license, cosine): lines, blocks and whole texts that state a license.

    Weights are term counts times the inverse frequency over all texts.  The
    best template wins, ties by license name.  Texts and units are looked at
    that have one of the ``key_terms``, and weighed if they ``may_reach``
    ``least``; no other can state a license.
    """
    spark = files.sparkSession
    split = stored(files.select("id", F.array_distinct(terms(F.col("text"))).alias("words")), "terms", "zstd")
    df = stored(split.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    n = split.count()
    idf = F.log((n + 1.0) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(templates or TEMPLATES)], "template int, license string, text string")
    rows = rows.select("template", "license", terms(F.col("text")).alias("words"))
    tf = rows.select("template", "license", F.explode("words").alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    w = tf.join(df, "term", "left").select("template", "license", "term", idf.alias("idf"), (F.col("tf") * idf).alias("w"))
    norm = w.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weights = stored(w.join(norm, "template").select("template", "license", "term", "idf", (F.col("w") / F.col("norm")).alias("weight")), "templates")
    keys = key_terms(weights, least)
    unit = ["id", "version", "kind", "pos", "last"]
    some = stored(split.filter(F.exists("words", lambda w: w.isin(keys))).select("id").distinct(), "candidates")
    few = units(files.join(small_side(some), "id", "left_semi"))
    inside = {r["term"]: r["idf"] for r in weights.select("term", "idf").distinct().collect()}  # as large as the templates
    few = few.filter(F.exists(F.array("words"), lambda w: F.exists(w, lambda y: y.isin(keys)) & may_reach(term_counts(w), inside, least)))  # split once
    counts = few.select(*unit, F.explode(term_counts(F.col("words"))).alias("c"))
    # Rows that repeat a text have the same counts.
    counted = stored(counts.groupBy(*unit, F.col("c.term").alias("term")).agg(F.max("c.tf").alias("tf")), "unit-terms", "zstd")
    weighed = counted.join(df, "term", "left").select(*unit, "term", (F.col("tf") * idf).alias("w"))
    norms = weighed.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(weights), "term").groupBy(*unit, "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, unit).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("cosine") >= least)
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "license"))
    return scored.groupBy(*unit).agg(best.alias("b")).select(*unit, "b.license", (-F.col("b.c")).alias("cosine"))


def scan(files: DataFrame, *, id_col: str, path: Column, text_col: str = "text", license_file: Column | None = None,
         least: float = COSINE) -> DataFrame:
    """(id_col, path, own_license, cosine, license, inherited_from) for every row of ``files``.

    A file's own license is that of its best statement: line, block or whole
    text (ties: the wider, then the earlier).  A
    license file speaks for its directory: by default one named LICENSE, LICENCE,
    COPYING or NOTICE; ``license_file`` may be any condition on ``path`` and on
    ``last``, whether the statement ends the file.  A directory with
    several has the most frequent license, ties by name.  A file without a
    license of its own inherits from the nearest directory above it that has one.

    Null and empty texts state nothing; units of any length are weighed; a file
    with a null path inherits nothing; rows that repeat an id share their statements, and rows without id
    state nothing.  Other columns are ignored.
    """
    base = files.select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).cast("string").alias("text"))
    rule = license_file if license_file is not None else F.element_at(F.split("path", "/"), -1).rlike(r"(?i)^(licen[sc]e|copying|notice)(\..*)?$")
    found = stored(statements(base.filter("id is not null"), least=least), "statements")
    own = stored(found.groupBy("id").agg(F.min(F.struct((-F.col("cosine")).alias("c"), (-F.col("kind")).alias("k"), "pos", "license", "last")).alias("b"))
                 .select("id", F.col("b.license").alias("own_license"), (-F.col("b.c")).alias("cosine"), F.col("b.last").alias("last")), "own")
    directory = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", ""))
    placed = base.select("id", "path", directory.alias("dir")).join(small_side(own), "id", "left")
    speaking = placed.filter(F.col("own_license").isNotNull() & F.col("dir").isNotNull() & rule)
    votes = speaking.groupBy("dir", "own_license").agg(F.count("*").alias("n"))
    licensed = stored(votes.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "own_license")).alias("b"))
                      .select(F.col("dir").alias("from"), F.col("b.own_license").alias("given")), "directories")
    parts = F.split("dir", "/")
    above = (placed.select("dir").filter("dir is not null").distinct()
             .select("dir", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
             .select("dir", "depth", F.concat_ws("/", F.slice(F.split("dir", "/"), F.lit(1), F.col("depth"))).alias("from")))
    nearest = above.join(licensed, "from").groupBy("dir").agg(F.max(F.struct("depth", "from", "given")).alias("b")).select("dir", "b.from", "b.given")
    nearest = stored(nearest, "nearest")
    out = placed.join(small_side(nearest), "dir", "left")
    return out.select(F.col("id").alias(id_col), "path", "own_license", "cosine", F.coalesce("own_license", "given").alias("license"),
                      F.when(F.col("own_license").isNull(), F.col("from")).alias("inherited_from"))
