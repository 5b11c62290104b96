"""License scans by an exact set-similarity join with templates (operator 4). Native: columns only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickwise.llm.common import stage, text_or_empty

#: What separates words, once the text is in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose words must stand consecutively, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Templates of the method by label, or label/variant; a text block that contains the needed share of a
#: template's distinct words matches it.
TEMPLATES = {
    "agpl-3": "licensed under the gnu affero general public license version 3",
    "apache-2": "licensed under the apache license version 2 0",
    "apache-2/notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd-2-clause/whole": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-3-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-3-clause/third": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsl-1/whole": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under a creative commons attribution sharealike 4 0 international license",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "gpl-3/notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses",
    "isc/whole": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "lgpl-3": "licensed under the gnu lesser general public license version 3",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit/whole": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense/whole": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
    "zlib/whole": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
}
CONTAINMENT = 0.8
#: Lines are cut to so many words, and templates are looked for from the first of such parts on, over as many words as they have.
PART = 8
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words with A-Z in lower case; other letters stay as they are."""
    return F.filter(F.split(F.translate(text, CAPITALS, SMALL), SEPARATORS), lambda w: w != "")


def _starts(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    at = F.sequence(F.lit(0), F.size(words) - len(parts))
    same = lambda i: F.slice(words, i + 1, len(parts)) == F.array(*map(F.lit, parts))
    return F.when(F.size(words) >= len(parts), F.filter(at, lambda i: (F.get(words, i) == parts[0]) & same(i))).otherwise(F.array().cast("array<int>"))


def _likely(text: Column) -> Column:
    """Whether a phrase can stand in a text, told by one regular expression."""
    loose = "|".join(SEPARATORS.join(p.split()) for p in PHRASES).replace("\\x60", "\\x40\\x5B-\\x60")
    return text.rlike(f"(?i)(?:{loose})")


def phrase_places(words: str) -> Column:
    """A struct of the starts of every phrase in a column of words; none where that is null."""
    none = F.array().cast("array<int>")
    return F.struct(*[F.coalesce(_starts(F.col(words), p), none).alias(f"p{k}") for k, p in enumerate(PHRASES)])


def _shapes(templates: dict[str, str], threshold: float) -> list[tuple[str, set[str], int, int]]:
    """Of each template its label, distinct words, how many of them are needed, and its length in words."""
    out = []
    for name, text in sorted(templates.items()):
        words = set(text.split())
        out.append((name.split("/")[0], words, max(1, math.ceil(threshold * len(words) - 1e-9)), len(text.split())))
    return out


def scan_texts(docs: DataFrame, shapes: list) -> DataFrame:
    """What one pass over docs(doc_id, text) tells: row, doc_id, n_words, the phrases' places p, hits (the distinct
    template words of the text), and the lines, in parts of PART words at most (n, hits), of each text whose hits could meet
    a template together."""
    vocabulary = sorted({w for _, words, _, _ in shapes for w in words})
    known = F.array(*map(F.lit, vocabulary))
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    read = read.select("*", words_of(F.col("text")).alias("words"))
    read = read.select("row", "doc_id", "text", F.size("words").cast("long").alias("n_words"), F.when(_likely(F.col("text")), F.col("words")).alias("words"), F.array_intersect("words", known).alias("hits"))

    def parts(line: Column) -> Column:
        part = lambda w, at: F.get(F.transform(F.array(F.slice(w, at + 1, PART)), lambda x: F.struct(F.size(x).alias("n"), F.array_intersect(x, known).alias("hits"))), F.lit(0))
        none = F.array().cast("array<struct<n:int,hits:array<string>>>")
        cut = lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(PART)), lambda at: part(w, at))).otherwise(none)
        return F.get(F.transform(F.array(words_of(line)), cut), F.lit(0))

    meets = F.lit(False)
    for _, words, need, _ in shapes:
        meets = meets | (F.size(F.array_intersect("hits", F.array(*map(F.lit, sorted(words))))) >= need)
    meets = (F.size("hits") >= min((x[2] for x in shapes), default=1)) & meets
    lines = F.when(meets, F.flatten(F.transform(F.split("text", "\n"), parts)))
    return stage(read.select("row", "doc_id", "n_words", phrase_places("words").alias("p"), "hits", lines.alias("lines")), "licenses")


def template_order(scanned: DataFrame, shapes: list) -> list[str]:
    """The words of the templates, rarest first by the number of texts of the whole corpus that hold them. The result
    has a row for each template word at most, so it is small whatever the corpus."""
    counts = {r["word"]: r["n"] for r in scanned.select(F.explode("hits").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted({w for _, words, _, _ in shapes for w in words}, key=lambda w: (counts.get(w, 0), w))


def template_matches(scanned: DataFrame, shapes: list) -> DataFrame:
    """(row, block, label, containment) of every part of a line that holds, alone or with the parts behind it over which a
    template that begins in it can reach, enough of the template's distinct words. A template of n words takes
    parts until there are n - 1 words behind the first one, across line ends. A template goes where one of another label has
    more of its words there, all of the first one's among them: a GNU General Public License isn't an Affero or Lesser one. Exact: a match shares a
    word of the template's prefix (its rarest words, one more than may be missing), and what is left behind the first
    common word on either side can still reach the need. Only blocks that pass are verified."""
    order = template_order(scanned, shapes)
    rank = {w: k for k, w in enumerate(order)}
    entries, longest, least = [], max((x[3] for x in shapes), default=1), min((x[2] for x in shapes), default=1)
    for label, words, need, length in shapes:
        ranks = sorted(rank[w] for w in words)
        entries += [(r, label, p, len(ranks), need, ranks, length) for p, r in enumerate(ranks[: len(ranks) - need + 1])]
    # The prefix table has a row for each prefix word of the given templates: bounded by the parameter.
    prefixes = scanned.sparkSession.createDataFrame(entries, "rank int, label string, at int, size int, need int, template array<int>, length int")
    to_rank = F.create_map(*[x for w, k in rank.items() for x in (F.lit(w), F.lit(k))]) if rank else F.lit(None).cast("map<string,int>")
    ranked = F.transform("l.hits", lambda w: to_rank[w])
    lines = scanned.where("lines is not null").select("row", F.posexplode("lines").alias("block", "l")).select("row", "block", "l.n", ranked.alias("own"))
    by_row = Window.partitionBy("row").orderBy("block")
    placed = lines.withColumn("s", F.sum("n").over(by_row) - F.col("n")).where(F.size("own") > 0)
    # A document's parts with hits; one can be followed by so many at most, as each has a word.
    near = placed.withColumn("near", F.collect_list(F.struct("s", "own")).over(by_row.rowsBetween(1, longest - 1)))
    near = near.select("row", "block", "own", F.transform("near", lambda x: F.struct((x["s"] - F.col("s") - F.col("n")).alias("before"), x["own"].alias("hits"))).alias("near"))
    near = near.withColumn("following", F.filter("near", lambda x: x["before"] < longest - 1))
    blocks = near.select("row", "block", "own", "following", F.array_sort(F.array_union("own", F.flatten("following.hits"))).alias("ranks")).where(F.size("ranks") >= least)
    cand = blocks.select("*", F.posexplode("ranks").alias("place", "rank")).join(F.broadcast(prefixes), "rank")
    rest = F.least(F.col("size") - F.col("at"), F.size("ranks") - F.col("place"))
    cand = cand.where(rest >= F.col("need")).where(F.size(F.array_intersect("ranks", "template")) >= F.col("need"))
    reach = F.filter("following", lambda x: x["before"] < F.col("length") - 1)
    held = F.array_union("own", F.flatten(F.transform(reach, lambda x: x["hits"])))
    shared = F.array_intersect(held, F.col("template"))
    met = cand.select("row", "block", "label", "size", "need", shared.alias("shared")).where(F.size("shared") >= F.col("need"))
    # One block meets as many templates at most as there are.
    all_met = met.groupBy("row", "block").agg(F.collect_set(F.struct("label", (F.size("shared") / F.col("size")).alias("containment"), F.array_sort("shared").alias("shared"))).alias("all"))
    other = lambda x, y: (x["label"] != y["label"]) & (y["containment"] > x["containment"]) & (F.size(F.array_except(x["shared"], y["shared"])) == 0)
    kept = F.filter("all", lambda x: ~F.exists("all", lambda y: other(x, y)))
    return all_met.select("row", "block", F.explode(kept).alias("x")).select("row", "block", "x.label", "x.containment").distinct()


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = CONTAINMENT) -> DataFrame:
    """A row for each row of docs(doc_id, text): doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    Phrase places are counted over the whole text, whatever separates their words; labels join those
    of the phrases and of the templates that stand somewhere, over about as many words as they have. score is 1 where a
    phrase stands, else the largest containment met, else 0. A null text counts as empty: no words, empty labels, null
    places. Repeated rows keep a row each, and rows of one doc_id are judged by their own texts. A null
    doc_id keeps its row. Other columns are ignored; an empty table gives an empty result."""
    shapes = _shapes(TEMPLATES if templates is None else templates, threshold)
    rows = scan_texts(docs, shapes)
    found = template_matches(rows, shapes).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    names = list(PHRASES.values())
    every = F.concat(*[F.col(f"p.p{k}") for k in range(len(names))])
    base = F.concat(*[F.when(F.size(f"p.p{k}") > 0, F.array(F.lit(n))).otherwise(F.array().cast("array<string>")) for k, n in enumerate(names)])
    rows = rows.select(
        "row",
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(base)).alias("base"),
    )
    return rows.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def license_sql(templates: dict[str, str] | None = None, threshold: float = CONTAINMENT) -> str:
    """The same by brute force in DuckDB SQL: every block against every template."""
    templates = TEMPLATES if templates is None else templates
    split = r"list_filter(string_split_regex(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    values = ", ".join(f"('{p}', '{n}')" for p, n in PHRASES.items())
    shapes = ", ".join(f"('{n}', '{n.split('/')[0]}', string_split('{t}', ' '))" for n, t in templates.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, {split.format('text')} AS w FROM documents),
phrases(phrase, label) AS (VALUES {values}),
places AS (
  SELECT r, label, i FROM (SELECT r, w, phrase, label, unnest(range(len(w))) AS i FROM d, phrases)
  WHERE w[i + 1] = split_part(phrase, ' ', 1) AND w[i + 1 : i + len(string_split(phrase, ' '))] = string_split(phrase, ' ')),
base AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS l FROM places GROUP BY r),
shapes(name, label, t) AS (VALUES {shapes}),
entries AS (SELECT DISTINCT name, label, len(t) AS length, len(list_distinct(t)) AS size, unnest(t) AS word FROM shapes),
cut AS (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM d),
parts AS (SELECT r, i, c, w[c + 1 : c + {PART}] AS w FROM (SELECT r, i, w, unnest(range(0, len(w), {PART})) AS c FROM (SELECT r, i, {split.format('line')} AS w FROM cut))),
lines AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY i, c) AS i, w, len(w) AS n FROM parts),
placed AS (SELECT *, sum(n) OVER (PARTITION BY r ORDER BY i) AS stop FROM lines),
met AS (SELECT DISTINCT r, i, stop - n AS start, stop, word FROM (SELECT *, unnest(w) AS word FROM placed) WHERE word IN (SELECT word FROM entries)),
firsts AS (SELECT DISTINCT r, i, stop FROM met),
hits AS (
  SELECT f.r, f.i, e.name, e.label, e.size, count(DISTINCT m.word) AS k, list(DISTINCT m.word) AS shared
  FROM firsts f JOIN met m ON m.r = f.r AND m.i >= f.i AND (m.i = f.i OR m.start - f.stop < {max((len(t.split()) for t in templates.values()), default=1)} - 1)
  JOIN entries e ON e.word = m.word AND (m.i = f.i OR m.start - f.stop < e.length - 1)
  GROUP BY ALL HAVING count(DISTINCT m.word) >= {threshold} * e.size - 1e-9),
more AS (SELECT r, list(DISTINCT label) AS l, max(k / size::DOUBLE) AS c FROM hits h
  WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.r = h.r AND o.i = h.i AND o.label <> h.label AND o.k / o.size::DOUBLE > h.k / h.size::DOUBLE AND list_has_all(o.shared, h.shared)) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.l), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base.l, more.l))), ','), '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(more.c, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN more USING (r)"""
