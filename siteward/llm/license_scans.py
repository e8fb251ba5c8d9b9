"""License scans by sparse TF-IDF cosine to templates and nearest-ancestor inheritance, in DataFrame functions only.

Units are the lines of a file, its blocks (runs of lines with a letter or digit, so that comment marks do not matter), and
its whole text. A unit and a template are sparse vectors over words, tf * idf, with idf from how many files have the
template's word; words that no template has weigh the mean of those. Templates are short notices, the paragraphs and
headers by which licences are known, full texts of the short licences and the titles of the long ones; an SPDX tag names
its licence itself. Of equal units one is compared. A unit can only reach the threshold if it has one of a template's
heaviest words: the template's other words together weigh too little. This exact filter leaves few units, whose words meet
the templates' words in a join. A file whose whole text is a licence, whose first block is a licence's title, or that is
named like one and has one, governs its directory; a file without a licence of its own takes that of the nearest ancestor
directory which has one, by a join of directories with their ancestors' paths.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteward.llm.common import table
from siteward.session import discard, materialize

# Texts of public licences, by SPDX identifier; after a #, which text it is: several licences have a generic one,
# and a title at the top of a file says that all of it is the licence.
_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_AS_IS = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_FORMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_RETAIN = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIM = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_FREE = "you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT#grant": _GRANT,
    "MIT#full": f"MIT License Copyright (c) {_GRANT} {_AS_IS}",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0#header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0""",
    "Apache-2.0#basis": """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0#title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "GPL-2.0": "This program is free software; " + _FREE.format("", "2"),
    "GPL-2.0#title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0#header": "This program is free software: " + _FREE.format("", "3"),
    "GPL-3.0#title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "AGPL-3.0#header": "This program is free software: " + _FREE.format("Affero", "3"),
    "AGPL-3.0#title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "LGPL-2.1#header": "This library is free software; " + _FREE.format("Lesser", "2.1"),
    "LGPL-2.1#title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0#title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0#header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one
at https://mozilla.org/MPL/2.0/.""",
    "MPL-2.0#title": "Mozilla Public License Version 2.0",
    "BSD-2-Clause#generic": _FORMS,
    "BSD-2-Clause#full": f"BSD 2-Clause License Copyright (c) All rights reserved. {_FORMS} {_RETAIN} {_DISCLAIM}",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License.",
    "BSD-3-Clause#endorse": _ENDORSE,
    "BSD-3-Clause#full": f"BSD 3-Clause License Copyright (c) All rights reserved. {_FORMS} {_RETAIN} {_ENDORSE} {_DISCLAIM}",
    "ISC#grant": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies.""",
    "Unlicense#grant": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "Proprietary": "Copyright. All rights reserved.",
}
GENERIC, TITLE = "#generic", "#title"
#: Lines without a letter or digit part blocks.
BLANK = "\\n(?:[^a-z0-9\\n]*\\n)+"
#: An SPDX tag, and the names of files that hold licences.
SPDX = "spdx-license-identifier:[ \\t]*([a-z0-9][a-z0-9.+-]*)"
NAMED = "(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"
WORD = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"
THRESHOLD = 0.75


def template_words(templates: dict[str, str]) -> list[tuple[str, str, int]]:
    import re

    return [(k, w, n) for k, text in templates.items() for w, n in sorted(Counter(re.findall(WORD, text.lower())).items())]


def weights(words: list[tuple[str, str, int]], df: dict[str, int], files: int, threshold: float) -> tuple[list[tuple[str, str, float, float]], float, list[str]]:
    """(template, word, weight over the template's norm, idf) rows, the mean idf, and the words of which a unit must have one."""
    idf = {w: math.log((1 + files) / (1 + df.get(w, 0))) + 1 for _, w, _ in words}
    mean = sum(idf.values()) / len(idf)
    rows, needed = [], set()
    for k in dict.fromkeys(k for k, _, _ in words):
        own = [(w, n * idf[w]) for t, w, n in words if t == k]
        norm = math.sqrt(sum(x * x for _, x in own))
        rows += [(k, w, x / norm, idf[w]) for w, x in own]
        rest = 1.0
        for w, x in sorted(own, key=lambda r: (-r[1], r[0])):
            if rest < threshold * threshold - 1e-9:
                break
            needed.add(w)
            rest -= (x / norm) ** 2
    return rows, mean, sorted(needed)


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of files: its columns but the text, and licence, cosine, how (file, header or inherited),
    licence_path (of the file that governs by inheritance, else the own path). All are null where no licence is found.
    An SPDX tag of a licence with a template counts before all else, with cosine 1; then the template of the largest cosine, of equals the
    first by name, generic ones last; of a directory's licence files the one of the
    largest cosine, then of the least path. Null and empty texts have no licence of their own; a null path has no
    directory and inherits nothing; equal rows stay apart; an empty table gives an empty one. templates: {name: text}, some
    hundreds at most."""
    spark = files.sparkSession
    words = template_words(TEMPLATES if templates is None else templates)
    vocabulary = sorted({w for _, w, _ in words})
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    own = [c for c in files.columns if c != text_col]
    rows = files.select(F.struct(*own).alias("_row"), F.col(path_col).alias("_path"), text.alias("_text"))
    has = F.array_intersect(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), F.array(*map(F.lit, vocabulary)))
    counted = rows.select(F.explode(F.concat(has, F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()  # a row for each template word
    df = {r.w: r["count"] for r in counted}
    vectors, mean, needed = weights(words, df, df.pop("", 0), threshold)

    blocks = F.split("_text", BLANK)
    has_needed = lambda c: F.arrays_overlap(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), F.array(*map(F.lit, needed)))
    units = F.array_distinct(F.concat(F.split("_text", "\n"), blocks, F.array("_text")))
    units = F.when(has_needed(F.col("_text")), F.filter(units, has_needed)).otherwise(F.array().cast("array<string>"))
    known = sorted({k.partition("#")[0] for k in (TEMPLATES if templates is None else templates)})
    tag = F.regexp_extract("_text", SPDX, 1)
    spdx = F.coalesce(*(F.when(tag.isin(k.lower(), f"{k.lower()}-only", f"{k.lower()}-or-later"), F.lit(k)) for k in known))
    first = F.md5(F.coalesce(F.get(F.filter(blocks, lambda u: u.rlike("[a-z0-9]")), F.lit(0)), F.lit("")))
    found = rows.select("_row", "_path", F.md5("_text").alias("_whole"), first.alias("_first"), spdx.alias("_spdx"), units.alias("_units"))
    found = materialize(found.withColumns({"_keys": F.transform("_units", lambda u: F.md5(u))}), "licence-units")

    pairs = found.select(F.explode(F.arrays_zip("_keys", "_units")).alias("u")).select(F.col("u._keys").alias("key"), F.col("u._units").alias("unit"))
    once = pairs.groupBy("key").agg(F.first("unit").alias("unit"))
    tf = once.select("key", F.explode(F.regexp_extract_all("unit", F.lit(WORD), F.lit(0))).alias("word")).groupBy("key", "word").agg(F.count(F.lit(1)).alias("tf"))
    by_word = spark.createDataFrame(vectors, "template string, word string, weight double, idf double")
    by_word = by_word.groupBy("word").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("template", "weight")).alias("of"))
    tf = tf.join(F.broadcast(by_word), "word", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(mean)))
    norms = tf.groupBy("key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = tf.where("of IS NOT NULL").select("key", "x", F.explode("of").alias("t")).groupBy("key", "t.template").agg(F.sum(F.col("x") * F.col("t.weight")).alias("dot"))
    cosine = dots.join(norms, "key").select("key", "template", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).where(F.col("cosine") >= threshold)
    # max_by of a struct: the largest cosine, then the first template by name.
    best = cosine.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "template")).alias("b"))
    best = materialize(best.select("key", F.struct(F.col("b.less").alias("less"), F.col("b.template").alias("template")).alias("b")), "licences")

    marked = found.select("_row", "_path", "_whole", "_first", "_spdx", "_keys").withColumn("_id", F.monotonically_increasing_id())
    marked = materialize(marked, "licence-files")
    discard(found)
    # What is generic counts where nothing else is found.
    named_b = F.struct(F.col("b.template").endswith(GENERIC).alias("generic"), F.col("b.less").alias("less"), F.substring_index("b.template", "#", 1).alias("template"))
    all_of_it = (F.col("key") == F.col("_whole")) | ((F.col("key") == F.col("_first")) & F.col("b.template").endswith(TITLE)) | F.lower("_path").rlike(NAMED)
    hits = marked.select("_id", "_whole", "_first", "_path", F.explode("_keys").alias("key")).join(best, "key")
    hits = hits.select("_id", named_b.alias("n"), F.when(F.coalesce(all_of_it, F.lit(False)), named_b).alias("a")).groupBy("_id").agg(F.min("n").alias("n"), F.min("a").alias("a"))
    pair = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.less").alias("less"), F.col(f"{c}.template").alias("template")))
    tagged = F.when(F.col("_spdx").isNotNull(), F.struct(F.lit(-1.0).alias("less"), F.col("_spdx").alias("template")))
    named = marked.drop("_keys", "_whole", "_first").join(hits, "_id", "left").withColumns({"b": F.coalesce(tagged, pair("n")), "w": pair("a"), "_dir": F.regexp_extract("_path", "^(.*)/[^/]*$", 1)})
    named = materialize(named.drop("_id", "_spdx", "n", "a"), "licence-found")
    discard(marked)
    discard(best)

    governs = named.where("w IS NOT NULL AND _path IS NOT NULL").groupBy("_dir").agg(F.min(F.struct("w.less", "w.template", F.col("_path").alias("path"))).alias("g"))
    dirs = named.where("b IS NULL AND _path IS NOT NULL").select("_dir").distinct()
    parts = F.split("_dir", "/")
    above = dirs.select("_dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("n")).withColumn("up", F.array_join(F.slice(F.split("_dir", "/"), 1, F.col("n")), "/"))
    near = above.join(governs.withColumnRenamed("_dir", "up"), "up").groupBy("_dir").agg(F.max_by("g", "n").alias("g"))
    out = named.join(near, "_dir", "left")
    pick = F.when(F.col("w").isNotNull() & (F.col("w") == F.col("b")), F.struct("w.template", "w.less", F.lit("file").alias("how"), F.col("_path").alias("path")))
    pick = pick.when(F.col("b").isNotNull(), F.struct("b.template", "b.less", F.lit("header").alias("how"), F.col("_path").alias("path")))
    pick = pick.when(F.col("g").isNotNull() & F.col("_path").isNotNull(), F.struct("g.template", "g.less", F.lit("inherited").alias("how"), F.col("g.path").alias("path")))
    out = out.withColumn("_p", pick)
    return out.select("_row.*", F.col("_p.template").alias("licence"), (-F.col("_p.less")).alias("cosine"), F.col("_p.how").alias("how"), F.col("_p.path").alias("licence_path"))


#: The tables have no paths: a document's directories are its source and the thousands and hundreds of its id.
PATH = "concat_ws('/', coalesce(source, ''), concat('k', CAST(floor(doc_id / 1000) AS bigint)), concat('c', CAST(floor(doc_id / 100) AS bigint)), CAST(doc_id AS string))"


def op7_license_scans(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs.select("doc_id", F.expr(PATH).alias("path"), "text"))


def _oracle() -> str:
    rows = ", ".join(f"('{k}', '{w}', {n})" for k, w, n in template_words(TEMPLATES))
    return f"""
WITH t(template, word, tf) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, {PATH.replace("AS string", "AS varchar")} AS path, lower(coalesce(text, '')) AS txt FROM documents),
n AS (SELECT count(*) AS files FROM d),
df AS (SELECT word, count(*) AS df FROM (SELECT r, unnest(list_distinct(regexp_extract_all(txt, '{WORD}'))) AS word FROM d) WHERE word IN (SELECT word FROM t) GROUP BY word),
idf AS (SELECT word, ln((1 + files) / (1 + coalesce(df, 0))::DOUBLE) + 1 AS idf FROM (SELECT DISTINCT word FROM t) LEFT JOIN df USING (word), n),
tv AS (SELECT template, word, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS weight FROM t JOIN idf USING (word)),
bl AS (SELECT r, regexp_split_to_array(txt, '{BLANK}') AS l FROM d), fb AS (SELECT r, list_filter(l, lambda x: regexp_matches(x, '[a-z0-9]'))[1] AS first FROM bl),
u AS (SELECT r, txt AS unit, 1 AS whole FROM d UNION ALL SELECT r, unnest(string_split(txt, chr(10))) AS unit, 0 AS whole FROM d UNION ALL SELECT r, unnest(l), 0 FROM bl),
tf AS (SELECT unit, word, count(*) AS tf FROM (SELECT unit, unnest(regexp_extract_all(unit, '{WORD}')) AS word FROM (SELECT DISTINCT unit FROM u)) GROUP BY ALL),
x AS (SELECT unit, word, tf * coalesce(idf, (SELECT avg(idf) FROM idf)) AS x FROM tf LEFT JOIN idf USING (word)),
norms AS (SELECT unit, sqrt(sum(x * x)) AS norm FROM x GROUP BY unit),
cosines AS (SELECT unit, template, round(sum(x * weight) / any_value(norm), 6) AS cosine FROM x JOIN tv USING (word) JOIN norms USING (unit) GROUP BY unit, template),
best AS (SELECT unit, -cosine AS less, template FROM cosines WHERE cosine >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY cosine DESC, template) = 1),
tagged AS (SELECT r, -1.0::DOUBLE AS less, k.name AS template FROM d JOIN (SELECT DISTINCT split_part(template, '#', 1) AS name FROM t) k ON regexp_extract(txt, '{SPDX}', 1) IN (lower(k.name), lower(k.name) || '-only', lower(k.name) || '-or-later')),
ranked AS (SELECT r, less, split_part(template, '#', 1) AS template, row_number() OVER (PARTITION BY r ORDER BY template LIKE '%{GENERIC}', less, split_part(template, '#', 1)) AS k FROM u JOIN best USING (unit)),
b AS (SELECT * FROM tagged UNION ALL SELECT r, less, template FROM ranked WHERE k = 1 AND r NOT IN (SELECT r FROM tagged)),
ws AS (SELECT u.r, less, split_part(template, '#', 1) AS template, row_number() OVER (PARTITION BY u.r ORDER BY template LIKE '%{GENERIC}', less, split_part(template, '#', 1)) AS k FROM u JOIN best USING (unit) JOIN fb ON fb.r = u.r JOIN d ON d.r = u.r
  WHERE whole = 1 OR unit = first AND template LIKE '%{TITLE}' OR regexp_matches(lower(path), '{NAMED}')),
w AS (SELECT r, less, template FROM ws WHERE k = 1),
f AS (SELECT d.r, doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, b.less, b.template, w.less AS wless, w.template AS wtemplate FROM d LEFT JOIN b ON b.r = d.r LEFT JOIN w ON w.r = d.r),
g AS (SELECT dir, wless, wtemplate, path FROM f WHERE wtemplate IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY wless, wtemplate, path) = 1),
near AS (SELECT f.r, g.wless, g.wtemplate, g.path FROM f JOIN g ON f.dir = g.dir OR starts_with(f.dir, g.dir || '/') WHERE f.template IS NULL
  QUALIFY row_number() OVER (PARTITION BY f.r ORDER BY length(g.dir) DESC) = 1)
SELECT doc_id, f.path, coalesce(template, near.wtemplate) AS licence, -coalesce(less, near.wless) AS cosine,
  CASE WHEN template IS NULL AND near.wtemplate IS NULL THEN NULL WHEN template IS NULL THEN 'inherited' WHEN f.wless = less AND f.wtemplate = template THEN 'file' ELSE 'header' END AS how,
  CASE WHEN template IS NOT NULL THEN f.path ELSE near.path END AS licence_path
FROM f LEFT JOIN near ON near.r = f.r"""


ORACLE_SQL = _oracle()
