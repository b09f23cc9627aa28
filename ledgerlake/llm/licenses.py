"""Licence scans by diagonal voting, in DataFrame functions only.

All rolling 2-word hashes of every text are joined to their positions in a
fixed set of templates. A hit votes for the diagonal (place in the text less
place in the template), that is, for the word at which the template would
begin. Each vote is verified on the words themselves, so votes are exact.
Votes are summed by (document, template, diagonal); neighbouring diagonals,
which differ by a few words put in or left out, are merged into one span; a
span whose votes cover enough of its template gives the template's label, if the
positions that tell the template from its likes are among them: the phrases it
names, or a short template's last two words, which tell versions apart. A base
phrase counts only where one diagonal covers all of it.

The broadcast side has a row per 2-word position of the templates. Texts meet
no one but themselves: rows are dealt by document.

Defined results: a null text has no words; no match gives empty labels, null
places and score 0; repeated rows are judged one by one; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerlake.llm.tables import ascii_lower, named, text_of

#: Fixed value: what stands between words, after lower-casing A to Z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

COVERAGE = 0.8
#: Diagonals up to so many words apart are one span.
NEIGHBOURS = 4
#: Templates up to so many words need their last position, however much else is covered.
SHORT = 8


@dataclass(frozen=True)
class Template:
    """``telling``: phrases of the text, of two words or more, that a span must cover whatever else it covers."""

    label: str
    text: str
    base: bool = False
    telling: tuple[str, ...] = ()

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def telling_positions(self) -> list[int]:
        words, found = self.words, []
        for phrase in map(str.split, self.telling):
            at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
            found += range(at, at + len(phrase) - 1)
        return found or ([len(words) - 2] if 2 <= len(words) <= SHORT else [])


# Phrases, notices and texts by which licences are known.
_GPL_NOTICE = (
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
    " license as published by the free software foundation"
)
_CC_NOTICE = "this work is licensed under a creative commons attribution"
_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files the software to deal in the software without restriction"
)
_BSD_START = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the"
    " following conditions are met"
)
TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("gpl-3", "gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("apache-2.0", "apache license version 2 0"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("mpl", "subject to the terms of the mozilla public license"),
    Template("gpl", _GPL_NOTICE, telling=("gnu general",)),
    Template("gpl-2", _GPL_NOTICE + " either version 2 of the license", telling=("gnu general", "version 2 of")),
    Template("gpl-3", _GPL_NOTICE + " either version 3 of the license", telling=("gnu general", "version 3 of")),
    Template(
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        telling=("obtain a copy of the license at",),
    ),
    Template("cc-by", _CC_NOTICE + " 4 0 international license", telling=("attribution 4",)),
    Template("cc-by-sa", _CC_NOTICE + " sharealike 4 0 international license", telling=("attribution sharealike 4",)),
    Template("cc-by-nc", _CC_NOTICE + " noncommercial 4 0 international license", telling=("attribution noncommercial 4",)),
    Template("cc-by-nd", _CC_NOTICE + " noderivatives 4 0 international license", telling=("attribution noderivatives 4",)),
    Template("cc-by-nc-sa", _CC_NOTICE + " noncommercial sharealike 4 0 international license", telling=("noncommercial sharealike",)),
    Template("cc-by-nc-nd", _CC_NOTICE + " noncommercial noderivatives 4 0 international license", telling=("noncommercial noderivatives",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    Template("mit", _MIT_GRANT),
    Template(
        "mit-text",
        _MIT_GRANT + " including without limitation the rights to use copy modify merge publish distribute sublicense and or"
        " sell copies of the software and to permit persons to whom the software is furnished to do so subject to the"
        " following conditions the above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the software the software is provided as is without warranty of any kind express or"
        " implied including but not limited to the warranties of merchantability fitness for a particular purpose and"
        " noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other"
        " liability whether in an action of contract tort or otherwise arising from out of or in connection with the"
        " software or the use or other dealings in the software",
        telling=("sublicense and or sell",),
    ),
    Template(
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
        " granted provided that the above copyright notice and this permission notice appear in all copies the software is"
        " provided as is and the author disclaims all warranties with regard to this software including all implied"
        " warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect"
        " or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an"
        " action of contract negligence or other tortious action arising out of or in connection with the use or"
        " performance of this software",
        telling=("with or without fee is hereby granted",),
    ),
    Template("bsd", _BSD_START),
    Template(
        "bsd-text",
        _BSD_START + " redistributions of source code must retain the above copyright notice this list of conditions and the"
        " following disclaimer redistributions in binary form must reproduce the above copyright notice this list of"
        " conditions and the following disclaimer in the documentation and or other materials provided with the"
        " distribution",
        telling=("must retain the above",),
    ),
    Template(
        "bsd-3",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission",
        telling=("names of its contributors",),
    ),
    Template(
        "zlib-text",
        "this software is provided as is without any express or implied warranty in no event will the authors be held"
        " liable for any damages arising from the use of this software permission is granted to anyone to use this software"
        " for any purpose including commercial applications and to alter it and redistribute it freely subject to the"
        " following restrictions the origin of this software must not be misrepresented you must not claim that you wrote"
        " the original software if you use this software in a product an acknowledgment in the product documentation would"
        " be appreciated but is not required altered source versions must be plainly marked as such and must not be"
        " misrepresented as being the original software this notice may not be removed or altered from any source"
        " distribution",
        telling=("must not be misrepresented you",),
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)

_NO_TEMPLATE = -1
_MARK = 0


def _template_positions(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """(gram, template, at, first, second): every 2-word position, and the mark that each document carries."""
    rows = [(i, at, *pair) for i, t in enumerate(templates) for at, pair in enumerate(zip(t.words, t.words[1:]))]
    literal = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(at).alias("at"), F.lit(a).alias("first"), F.lit(b).alias("second")) for i, at, a, b in rows])
    pairs = spark.range(1, numPartitions=1).select(F.inline(literal))
    mark = spark.range(1, numPartitions=1).select(
        F.lit(_NO_TEMPLATE).alias("template"), F.lit(0).alias("at"), F.lit("").alias("first"), F.lit("").alias("second")
    )
    return pairs.withColumn("gram", F.xxhash64("first", "second")).unionByName(mark.withColumn("gram", F.lit(_MARK).cast("long")))


def _telling(template: Template, block: int) -> int:
    """The positions that a span must cover, as a signed mask of the 64 positions of a block."""
    mask = sum(1 << at % 64 for at in set(template.telling_positions) if at // 64 == block)
    return mask - (1 << 64) if mask >> 63 else mask


def _chosen(templates: Sequence[Template], value) -> Column:
    return F.element_at(F.array(*[F.lit(value(t)) for t in templates]), F.col("template") + 1)


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[Template] = TEMPLATES,
    doc_id: str = "doc_id",
    text: str = "text",
    coverage: float = COVERAGE,
    neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = F.filter(F.split(ascii_lower(text_of(text)), NOT_WORD), lambda w: w != "")
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), named(doc_id).alias("doc_id"), words.alias("words"))
    word = F.col("words")

    def gram(w: Column, i: Column) -> Column:
        following = F.get(word, i + 1)
        return F.struct(F.xxhash64(w, following).alias("gram"), w.alias("w1"), following.alias("w2"))

    grams = F.transform(word, gram)
    mark = F.array(F.struct(F.lit(_MARK).cast("long").alias("gram"), F.lit("").alias("w1"), F.lit("").alias("w2")))
    places = rows.select("doc", "doc_id", F.size(word).cast("long").alias("n_words"), F.posexplode(F.concat(mark, grams)).alias("place", "g"))
    places = places.select("doc", "doc_id", "n_words", "place", "g.gram", "g.w1", "g.w2")
    positions = _template_positions(docs.sparkSession, templates)
    hits = places.join(F.broadcast(positions), "gram").filter((F.col("w1") == F.col("first")) & (F.col("w2") == F.col("second")))

    own = ["doc", "doc_id", "n_words"]
    diagonal = (F.col("place") - 1 - F.col("at")).cast("long")
    # One mask per block of 64 positions, since a long holds no more.
    masks = {f"covered_{block}": block for block in range(max((len(t.words) + 62) // 64 for t in templates))}
    covered = [F.bit_or(F.expr(f"if(at div 64 = {block}, shiftleft(1L, at % 64), 0L)")).alias(m) for m, block in masks.items()]
    votes = hits.groupBy(*own, "template", diagonal.alias("diagonal")).agg(*covered)
    n_covered = F.expr(" + ".join(f"bit_count({m})" for m in masks))

    in_order = Window.partitionBy(*own, "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(in_order) > neighbours
    votes = votes.withColumn("span", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(in_order))
    needed = _chosen(templates, lambda t: len(t.words) - 1)
    base = (F.col("template") >= 0) & _chosen(templates, lambda t: t.base)
    whole = base & (n_covered == needed)
    spans = votes.groupBy(*own, "template", "span").agg(
        F.count_if(whole).alias("n_base"),
        F.min(F.when(whole, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(whole, F.col("diagonal"))).alias("last_word"),
        *[F.bit_or(m).alias(m) for m in masks],
    )
    share = F.when(F.col("template") < 0, 0.0).when(base, F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).otherwise(n_covered / needed)
    missed = [F.bitwise_not(m).bitwiseAND(_chosen(templates, lambda t, block=block: _telling(t, block)).cast("long")) for m, block in masks.items()]
    told = F.when(F.col("template") >= 0, reduce(Column.bitwiseOR, missed) == 0)
    label = _chosen(templates, lambda t: t.label)
    spans = spans.withColumns({"share": share, "told": told, "label": F.when(F.col("template") >= 0, label), "is_base": base})

    def labels(chosen: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(chosen, F.col("label")))), ",")

    return (
        spans.groupBy(*own)
        .agg(
            F.sum("n_base").alias("n_base"),
            F.min("first_word").alias("first_word"),
            F.max("last_word").alias("last_word"),
            labels(F.col("n_base") > 0).alias("base_labels"),
            labels((F.col("share") >= coverage) & F.col("told")).alias("labels"),
            F.max("share").alias("score"),
        )
        .drop("doc")
    )


def sql(templates: Sequence[Template] = TEMPLATES, coverage: float = COVERAGE, neighbours: int = NEIGHBOURS) -> str:
    """The same for DuckDB, without hashes."""

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def row(i: int, t: Template) -> str:
        return f"({i}, {text(t.label)}, {str(t.base).lower()}, [{', '.join(map(text, t.words))}], {t.telling_positions}::BIGINT[])"

    listed = ", ".join(row(i, t) for i, t in enumerate(templates))
    return rf"""
        WITH t AS (SELECT * FROM (VALUES {listed}) AS v(template, label, base, words, telling)),
        tp AS (
            SELECT template, i - 1 AS pos, words[i] AS w1, words[i + 1] AS w2
            FROM (SELECT *, unnest(range(1, len(words))) AS i FROM t)),
        d AS (
            SELECT row_number() OVER () AS doc, doc_id,
                   list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '{NOT_WORD}'), lambda x: x <> '') AS words
            FROM documents),
        g AS (
            SELECT doc, i, words[i] AS w1, words[i + 1] AS w2 FROM (SELECT doc, words, unnest(range(1, len(words))) AS i FROM d)),
        votes AS (
            SELECT doc, template, i - 1 - pos AS diagonal, list(DISTINCT pos::BIGINT) AS covered
            FROM g JOIN tp USING (w1, w2) GROUP BY ALL),
        spanned AS (
            SELECT *, sum(apart) OVER (PARTITION BY doc, template ORDER BY diagonal) AS span
            FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc, template ORDER BY diagonal) > {neighbours} THEN 1 ELSE 0 END AS apart FROM votes)),
        spans AS (
            SELECT doc, template, span, list_distinct(flatten(list(covered))) AS covered,
                   count(*) FILTER (base AND len(covered) = len(words) - 1) AS n_base,
                   min(diagonal) FILTER (base AND len(covered) = len(words) - 1) AS first_word,
                   max(diagonal) FILTER (base AND len(covered) = len(words) - 1) AS last_word,
                   any_value(label) AS label, any_value(base) AS base, any_value(len(words) - 1) AS needed, any_value(telling) AS telling
            FROM spanned JOIN t USING (template) GROUP BY doc, template, span),
        shared AS (
            SELECT *, list_has_all(covered, telling) AS told,
                   CASE WHEN base THEN CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END ELSE len(covered)::DOUBLE / needed END::DOUBLE AS share FROM spans)
        SELECT any_value(doc_id) AS doc_id, any_value(len(words))::BIGINT AS n_words, coalesce(sum(n_base), 0)::BIGINT AS n_base,
               min(first_word)::BIGINT AS first_word, max(last_word)::BIGINT AS last_word,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (n_base > 0), '') AS base_labels,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share >= {coverage} AND told), '') AS labels,
               coalesce(max(share), 0)::DOUBLE AS score
        FROM d LEFT JOIN shared USING (doc) GROUP BY d.doc
    """
