"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

DataFrame functions only. Template words are a fixed vocabulary, whose document frequencies are counted over all
texts. A unit is a line, a paragraph (what stands between lines without a letter or digit, so a notice may be wrapped and
commented out), or a whole text (a licence file); its vector has a weight tf * idf for every word, words outside the
vocabulary weighing as words of no document. A unit matches a template at a cosine of LEAST or more; a licence may have
several templates. Words meet templates by a join, and a sum by unit and template gives all dot products. A line
with an SPDX tag has the licence that it names, or the expression of several, with a score of 1.

Rows get a number in a scan that is written, and all that is grouped and joined goes by it: ids may be null or shared.

Only units that can reach LEAST are looked at: a template's anchors are its rarest words, enough of them that the others
weigh less than LEAST together, so a unit without any anchor has a smaller cosine with every template. Only texts with an anchor are
split into words a second time.

A document whose whole text matches is a licence file and speaks for its directory; a document with a matching line or
paragraph has that licence; any other takes that of the nearest ancestor directory with a licence file. Directories are
resolved once each, by joins on their ancestors' paths, and documents join their own directory.

Defined cases: null and empty texts match nothing and may inherit; ties go to the template of the smaller name, then to
paragraphs before lines and the earlier line, in a directory to the licence file with the smallest id, null last; every row is judged by its own text,
whatever its id, and repeated rows alike; long texts are read whole; other columns are ignored; an empty table gives no rows; a null path has no directory.
"""

from __future__ import annotations

import math
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm.staging import small, stage

_GRANT_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_GRANT_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_TERMS_BSD = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES_BSD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_END_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GRANT_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
_GRANT_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_END_GPL = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."
#: Licence ids and the notices that name them; what follows # tells the notices of one licence apart.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0#grant": _GRANT_APACHE,
    "Apache-2.0#header": _GRANT_APACHE + ' http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause#text": f"{_GRANT_BSD}: {_TERMS_BSD} {_END_BSD}",
    "BSD-3-Clause": _GRANT_BSD,
    "BSD-3-Clause#text": f"{_GRANT_BSD}: {_TERMS_BSD} {_NAMES_BSD} {_END_BSD}",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "This work has been dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0#grant": _GRANT_GPL.format(2),
    "GPL-2.0#header": f"{_GRANT_GPL.format(2)} {_END_GPL}",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0#grant": _GRANT_GPL.format(3),
    "GPL-3.0#header": f"{_GRANT_GPL.format(3)} {_END_GPL}",
    "ISC#text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT#grant": _GRANT_MIT,
    "MIT#text": _GRANT_MIT + ' The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0#header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Proprietary": "All rights reserved.",
}
#: The tag that names a licence, and the form of an expression: names, joined by AND, OR and WITH, in brackets.
TAG = "SPDX-License-Identifier:"
_NAME = r"\(*[A-Za-z0-9.+:-]+\)*"
SPDX = rf"{TAG}[ \t]*({_NAME}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_NAME})*)"
#: Bytes of a row with a path; longer paths make the measured bound of a broadcast a little larger.
_PATH_BYTES = 400
_PARAGRAPH = r"\n[^a-z0-9\n]*\n"
LEAST = 0.6
_WORD = "[^a-z0-9]+"


def words(text: str) -> list[str]:
    return [w for w in re.split(_WORD, text.lower()) if w]


def _split(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _WORD), lambda w: w != "")


class Model:
    """Template vectors over the corpus's document frequencies; the vocabulary's size is that of the templates."""

    def __init__(self, templates: dict[str, str], n_docs: int, frequency: dict[str, int], least: float):
        self.rare = math.log(n_docs + 1) + 1
        vocabulary = sorted({w for t in templates.values() for w in words(t)})
        self.idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) + 1 for w in vocabulary}
        self.unit: dict[str, dict[str, float]] = {}
        self.anchors: set[str] = set()
        for name, text in templates.items():
            weight = {w: words(text).count(w) * self.idf[w] for w in set(words(text))}
            norm = math.sqrt(sum(x * x for _, x in sorted(weight.items())))
            self.unit[name] = {w: x / norm for w, x in weight.items()}
            rest = 1.0
            for w, x in sorted(self.unit[name].items(), key=lambda p: (-self.idf[p[0]], -p[1], p[0])):
                if rest < least * least * 0.999:
                    break
                self.anchors.add(w)
                rest -= x * x

    def pattern(self) -> str:
        """Any anchor as a word of its own; words with one first letter are tried together."""
        heads: dict[str, list[str]] = {}
        for w in sorted(self.anchors):
            heads.setdefault(w[0], []).append(w[1:])
        return "(?:^|[^a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in heads.items()) + ")(?:$|[^a-z0-9])"


def fit(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text: str = "text", least: float = LEAST) -> Model:
    """Document frequencies of the template words over all texts; one row a template word comes back."""
    vocabulary = sorted({w for t in templates.values() for w in words(t)})
    held = F.array_intersect(F.split(F.lower(F.col(text)), _WORD), F.array(*map(F.lit, vocabulary)))
    found = docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()
    return Model(templates, docs.count(), {r["word"]: r["count"] for r in found}, least)


def expression(tag: Column) -> Column:
    """An SPDX expression in one form: single blanks, no outer brackets, none at all where they do not pair up."""
    paired = F.length(F.regexp_replace(tag, r"[^(]", "")) == F.length(F.regexp_replace(tag, r"[^)]", ""))
    plain = F.regexp_replace(F.when(paired, tag).otherwise(F.translate(tag, "()", "")), r"[ \t]+", " ")
    return F.regexp_replace(plain, r"^\(([^()]*)\)$", "$1")


def names(licence: Column) -> Column:
    """The licences that an expression names, exceptions left out."""
    plain = F.translate(F.regexp_replace(licence, r" WITH [^ )]+", ""), "()", "")
    return F.array_sort(F.array_distinct(F.split(plain, " (?:AND|OR) ")))


def matches(rows: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """(row, unit, licence, score): the best template of each unit that matches, and SPDX tags. rows: row, text. Unit -1 is the whole text, smaller ones
    are paragraphs, larger ones line numbers.

    Texts are dealt by row once; what is grouped by row and unit afterwards stays where it is."""
    spark = rows.sparkSession
    dealt = rows.repartition("row").withColumn("low", F.lower("text"))

    def some(separator: str, number) -> Column:
        parts = F.transform(F.split("low", separator), lambda x, k: F.struct(number(k).cast("int").alias("unit"), x.alias("body")))
        return F.filter(parts, lambda u: u["body"].rlike(model.pattern()))

    whole = F.array(F.struct(F.lit(-1).alias("unit"), F.col("low").alias("body")))
    every = F.concat(whole, some("\n", lambda k: k), some(_PARAGRAPH, lambda k: -2 - k))
    units = dealt.filter(F.col("low").rlike(model.pattern())).select("row", F.explode(every).alias("u")).select("row", "u.unit", F.explode(_split(F.col("u.body"))).alias("word"))
    tf = units.groupBy("row", "unit", "word").agg(F.count(F.lit(1)).alias("tf"))
    # both tables are as large as the templates, a parameter
    idf = spark.createDataFrame(sorted(model.idf.items()), "word string, idf double")
    weight = spark.createDataFrame([(w, [(n, model.unit[n][w]) for n in sorted(model.unit) if w in model.unit[n]]) for w in sorted(model.idf)], "word string, parts array<struct<name:string,x:double>>")
    vector = tf.join(F.broadcast(idf.join(weight, "word")), "word", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(model.rare)))
    # a word's share in each template's dot product, and under no name in the square of the norm
    square = F.array(F.struct(F.lit("").alias("name"), F.col("x").alias("x")))
    shares = vector.select("row", "unit", "x", F.explode(F.concat(F.coalesce("parts", F.array().cast("array<struct<name:string,x:double>>")), square)).alias("p"))
    dots = shares.groupBy("row", "unit", F.col("p.name").alias("name")).agg(F.sum(F.col("x") * F.col("p.x")).alias("dot"))
    # as many names as templates; rounded, so that the order of a sum decides neither a tie nor a match
    sums = dots.groupBy("row", "unit").agg(F.sqrt(F.max(F.when(F.col("name") == "", F.col("dot")))).alias("norm"), F.collect_list(F.when(F.col("name") != "", F.struct("dot", "name"))).alias("dots"))
    scores = F.array_sort(F.transform("dots", lambda d: F.struct((-F.round(d["dot"] / F.col("norm"), 6)).alias("less"), d["name"].alias("name"))))
    best = sums.select("row", "unit", F.get(scores, F.lit(0)).alias("b")).filter(-F.col("b.less") >= least)
    by_text = best.select("row", "unit", F.split_part("b.name", F.lit("#"), F.lit(1)).alias("licence"), (-F.col("b.less")).alias("score"))
    tags = F.filter(F.transform(F.split(F.col("text"), "\n"), lambda x, k: F.struct(k.alias("unit"), expression(F.regexp_extract(x, SPDX, 1)).alias("licence"))), lambda t: t["licence"] != "")
    tagged = rows.filter(F.contains(F.col("text"), F.lit(TAG))).select("row", F.explode(tags).alias("t"))
    return by_text.unionByName(tagged.select("row", "t.unit", "t.licence", F.lit(1.0).alias("score")))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def scan(docs: DataFrame, path: Column, model: Model, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row a document: doc_id, path, licence, how (file, header, inherited, none), score, from_doc, licences (an expression's names)."""
    able = F.lower(F.col(text)).rlike(model.pattern()) | F.contains(F.col(text), F.lit(TAG))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), path.alias("path"), directory(path).alias("dir"), F.when(able, F.col(text)).alias("text"))
    rows = stage(numbered)  # written, so that a row keeps its number
    found = matches(rows.filter("text is not null").select("row", "text"), model, least)
    # a file's own licence: its whole text's, or that of its best paragraph or line
    rank = F.struct((F.col("unit") == -1).alias("whole"), F.col("score"), (-F.col("unit")).alias("line"), "licence")
    own = stage(found.groupBy("row").agg(F.max(rank).alias("m")).select("row", F.col("m.licence").alias("own"), F.col("m.whole").alias("whole"), F.col("m.score").alias("own_score")), light=True)
    held = rows.drop("text").join(small(own, 100), "row", "left")
    # of a directory's licence files that with the smallest id, null last
    files = held.filter("whole").groupBy(F.col("dir").alias("at")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "own", "own_score")).alias("f"))
    part = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(part)), lambda k: F.array_join(F.slice(part, 1, k), "/"))
    dirs = rows.select("dir").filter("dir is not null").distinct().select("dir", F.explode(ancestors).alias("at"))
    near = dirs.join(small(stage(files, light=True), _PATH_BYTES), "at").groupBy(F.col("dir").alias("in_dir")).agg(F.max(F.struct(F.length("at").alias("depth"), "f")).alias("n")).select("in_dir", F.col("n.f").alias("f"))
    out = held.join(small(stage(near, light=True), _PATH_BYTES), F.col("dir") == F.col("in_dir"), "left")
    how = F.when(F.col("whole"), "file").when(F.col("own").isNotNull(), "header").when(F.col("f").isNotNull(), "inherited").otherwise("none")
    mine = F.col("own").isNotNull()
    licence = F.when(mine, F.col("own")).otherwise(F.col("f.own"))
    return out.select("doc_id", "path", licence.alias("licence"), how.alias("how"), F.when(mine, F.col("own_score")).otherwise(F.col("f.own_score")).alias("score"), F.when(mine, F.col("doc_id")).otherwise(F.col("f.doc_id")).alias("from_doc"), names(licence).alias("licences"))


def texts(spark: SparkSession, folder: str) -> dict[str, str]:
    """Templates from a folder of licence texts, by file name: each is a licence's name, or its name, # and more. A parameter's size: they go with every task."""
    read = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    return {re.sub(r"\.txt$", "", unquote(r["name"])): r["value"] for r in read.collect()}


def corpus_path() -> Column:
    """documents have no path; the query lays them out as source/language/hundred/id, short texts one level higher."""
    hundred = F.when(F.col("n_chars") < 500, F.lit("")).otherwise(F.concat(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("/")))
    return F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("und")), F.lit("/"), hundred, F.col("doc_id").cast("string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, corpus_path(), fit(docs))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


SQL = rf"""
WITH tw AS (SELECT t.id, unnest(list_filter(regexp_split_to_array(lower(t.body), '{_WORD}'), lambda w: w <> '')) AS word FROM (VALUES {_values(sorted(TEMPLATES.items()))}) t(id, body)),
tt AS (SELECT id, word, count(*) AS tf FROM tw GROUP BY id, word),
d AS (SELECT doc_id, lower(coalesce(text, '')) AS low, regexp_split_to_array(lower(coalesce(text, '')), '{_WORD}') AS ws,
  '/' || coalesce(source, 'none') || '/' || coalesce(lang, 'und') || '/' || CASE WHEN n_chars < 500 THEN '' ELSE CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR) || '/' END || CAST(doc_id AS VARCHAR) AS path FROM documents),
n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(ws) AS word FROM d) WHERE word IN (SELECT word FROM tt) GROUP BY word),
idf AS (SELECT v.word, ln((n.n + 1) / CAST(coalesce(df.df, 0) + 1 AS DOUBLE)) + 1 AS idf FROM (SELECT DISTINCT word FROM tt) v CROSS JOIN n LEFT JOIN df ON v.word = df.word),
tv AS (SELECT id, tt.word, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS x FROM tt JOIN idf ON tt.word = idf.word),
un AS (SELECT doc_id, -1 AS unit, ws FROM d UNION ALL
  SELECT doc_id, -1 - i, regexp_split_to_array(ps[i], '{_WORD}') FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(low, '{_PARAGRAPH}') AS ps FROM d)) UNION ALL
  SELECT doc_id, i - 1, regexp_split_to_array(ls[i], '{_WORD}') FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(low, chr(10)) AS ls FROM d))),
tf AS (SELECT doc_id, unit, word, count(*) AS tf FROM (SELECT doc_id, unit, unnest(ws) AS word FROM un) WHERE word <> '' GROUP BY ALL),
uv AS (SELECT doc_id, unit, tf.word, tf * coalesce(idf, ln(n.n + 1) + 1) AS x FROM tf CROSS JOIN n LEFT JOIN idf ON tf.word = idf.word),
nm AS (SELECT doc_id, unit, sqrt(sum(x * x)) AS norm FROM uv GROUP BY doc_id, unit),
sc AS (SELECT uv.doc_id, uv.unit, tv.id, round(sum(uv.x * tv.x) / any_value(norm), 6) AS score FROM uv JOIN tv ON uv.word = tv.word JOIN nm ON uv.doc_id = nm.doc_id AND uv.unit = nm.unit GROUP BY uv.doc_id, uv.unit, tv.id),
bu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY score DESC, id) AS r FROM sc WHERE score >= {LEAST}) WHERE r = 1),
tg AS (SELECT doc_id, i - 1 AS unit, regexp_extract(ls[i], '{SPDX}', 1) AS id FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
tag AS (SELECT doc_id, unit, regexp_replace(regexp_replace(CASE WHEN length(replace(id, '(', '')) = length(replace(id, ')', '')) THEN id ELSE translate(id, '()', '') END, '[ \t]+', ' ', 'g'), '^\(([^()]*)\)$', '\1') AS id FROM tg),
fu AS (SELECT doc_id, unit, split_part(id, '#', 1) AS id, score FROM bu UNION ALL SELECT doc_id, unit, id, 1.0::DOUBLE FROM tag WHERE id <> ''),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (unit = -1) DESC, score DESC, unit, id DESC) AS q FROM fu) WHERE q = 1),
h AS (SELECT d.doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, own.id AS own, own.unit = -1 AS whole, own.score FROM d LEFT JOIN own ON d.doc_id = own.doc_id),
f AS (SELECT * FROM (SELECT dir AS fdir, doc_id AS fdoc, own AS fown, score AS fscore, row_number() OVER (PARTITION BY dir ORDER BY doc_id) AS r FROM h WHERE whole) WHERE r = 1),
near AS (SELECT * FROM (SELECT x.dir AS ndir, f.*, row_number() OVER (PARTITION BY x.dir ORDER BY length(fdir) DESC) AS k FROM (SELECT DISTINCT dir FROM h) x JOIN f ON x.dir = fdir OR starts_with(x.dir, fdir || '/')) WHERE k = 1)
SELECT doc_id, path, CASE WHEN own IS NOT NULL THEN own ELSE fown END AS licence,
  CASE WHEN whole THEN 'file' WHEN own IS NOT NULL THEN 'header' WHEN fown IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  CASE WHEN own IS NOT NULL THEN score ELSE fscore END AS score, CASE WHEN own IS NOT NULL THEN doc_id ELSE fdoc END AS from_doc,
  list_sort(list_distinct(regexp_split_to_array(translate(regexp_replace(CASE WHEN own IS NOT NULL THEN own ELSE fown END, ' WITH [^ )]+', '', 'g'), '()', ''), ' (?:AND|OR) '))) AS licences
FROM h LEFT JOIN near ON h.dir = near.ndir
"""
