"""License scans: exact set-similarity join of text blocks with license templates, by built-in functions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import table

#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Notices that mark a license and whole texts of short licenses, as words, with their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under a creative commons attribution license", "cc-by"),
    ("all rights reserved no part of this publication may be reproduced", "reserved"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
        "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
        "bsd",
    ),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3"),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages "
        "or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache",
    ),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "agpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "lgpl"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "unlicense"),
)
#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.8
#: Words that a block may reach beyond the template's own place on either side.
SLACK = 2
#: What parts words once A-Z are lower-cased (given for the raw text, so A-Z are kept).
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words of a text; [] for null. U+212A, the one other sign that lower-cases to an ASCII letter, stays apart."""
    norm = F.trim(F.lower(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å")), _GAPS, " ")))
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def places(words: Column, phrase: Sequence[str]) -> Column:
    """Ascending indices at which the phrase's words stand one after another."""

    def at(w, i):
        hit = w == phrase[0]
        for k, p in enumerate(phrase[1:], 1):
            hit = hit & (F.get(words, i + k) == p)
        return F.when(hit, i)

    return F.filter(F.transform(words, at), lambda i: i.isNotNull())


def token_frequencies(worded: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """Documents that hold each template token, over all rows of ``worded`` (column words)."""
    held = worded.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, vocabulary)))).alias("t"))
    return {t: n for t, n in held.groupBy("t").agg(F.count("*")).collect()}  # one row for each template token at most


def families(templates) -> list[int]:
    """For each template the first of its family: names of one family differ in a word, and so do their notices."""
    sets, out = [set(t.split()) for t, _ in templates], []
    for k, (_, label) in enumerate(templates):
        out.append(next((out[j] for j in range(k) if templates[j][1] != label and len(sets[j] ^ sets[k]) <= 2), k))
    return out


class Join:
    """Prefix index of the templates under a global order of tokens, rarest first."""

    def __init__(self, templates, frequencies: dict[str, int], threshold: float):
        self.templates, self.threshold = [(t.split(), label) for t, label in templates], threshold
        self.families = families(templates)
        self.by_token: dict[str, list[int]] = {}
        for k, (seq, _) in enumerate(self.templates):
            tokens = sorted(set(seq), key=lambda t: (frequencies.get(t, 0), t))
            need = math.ceil(threshold * len(tokens) - 1e-9)
            for t in tokens[: len(tokens) - need + 1]:
                self.by_token.setdefault(t, []).append(k)

    @property
    def prefix(self) -> Column:
        return F.array(*map(F.lit, self.by_token))

    def blocks(self, words: Column) -> Column:
        """Blocks that meet the threshold: array of (label, share, start, held words, family, whole), by family and start.

        A block of a template is a window of its length and some slack, at any word. Each token of
        the template's prefix that occurs fixes the windows around it (positional filter); those
        with fewer words than the threshold needs are skipped (length filter), and the others are
        verified by intersecting the sets. A window without any such token cannot qualify. Windows
        are told apart by one number, template and start, so that many cost no comparison of all
        with all. ``whole`` says whether the template stands in the block word for word.
        """
        widths = F.array(*(F.lit(len(s) + 2 * SLACK) for s, _ in self.templates))
        distinct = F.array(*(F.lit(len(set(s))) for s, _ in self.templates))
        needed = F.array(*(F.lit(math.ceil(self.threshold * len(set(s)) - 1e-9)) for s, _ in self.templates))
        labels = F.array(*(F.lit(label) for _, label in self.templates))
        phrases = F.array(*(F.lit(f" {' '.join(s)} ") for s, _ in self.templates))
        family = F.array(*map(F.lit, self.families))
        sets = F.array(*(F.array(*map(F.lit, sorted(set(s)))) for s, _ in self.templates))
        index = F.create_map(*(x for t, at in self.by_token.items() for x in (F.lit(t), F.array(*map(F.lit, at)))))

        def around(w, i):
            """Numbers of the windows around a prefix token: template * 2^32 + start."""

            def windows(k):
                first = F.greatest(i - F.get(widths, k) + 1, F.lit(0))
                last = F.least(i, F.size(words) - F.get(needed, k))
                starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
                return F.transform(starts, lambda s: k.cast("bigint") * (1 << 32) + s)

            return F.when(F.array_contains(self.prefix, w), F.flatten(F.transform(F.element_at(index, w), windows)))

        def verified(at):
            k, s = F.shiftright(at, 32).cast("int"), at.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
            held = F.size(F.array_intersect(F.get(sets, k), F.slice(words, s + 1, F.get(widths, k))))
            return F.struct(F.get(family, k).alias("family"), s.alias("start"), k.alias("k"), held.alias("held"))

        def named(b):
            k = b["k"]
            text = F.concat(F.lit(" "), F.array_join(F.slice(words, b["start"] + 1, F.get(widths, k)), " "), F.lit(" "))
            return F.struct(F.get(labels, k).alias("label"), (b["held"] / F.get(distinct, k)).alias("share"), b["start"], b["held"], b["family"], text.contains(F.get(phrases, k)).alias("whole"))

        at = F.array_distinct(F.flatten(F.array_compact(F.transform(words, around))))
        enough = F.filter(F.transform(at, verified), lambda b: b["held"] >= F.get(needed, b["k"]))
        return F.transform(F.array_sort(enough), named)


def scan(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases=PHRASES,
    templates=TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row for each document row: id, n_words, starts (of base phrases), base_labels, blocks.

    First the document frequency of every template token is counted over all documents; that
    orders the tokens of each template. By the prefix filter a block can only reach the threshold
    if it holds one of the template's ``n - ceil(threshold * n) + 1`` rarest tokens, so documents
    without any are passed over after one set test, and only blocks around such tokens are verified.
    The template side is a constant of a few hundred tokens; documents are never shuffled.

    Null texts are empty, and have no words. Texts of any length are scanned whole; time grows with
    their words and, where notices repeat, with the blocks. Repeated rows each give a row; an empty
    table gives none; ties of frequency are ordered by token; other columns are ignored.
    """
    worded = documents.select(F.col(id_col), words_of(F.col(text_col)).alias("words"))
    vocabulary = sorted({t for seq, _ in templates for t in seq.split()})
    join = Join(templates, token_frequencies(worded, vocabulary), threshold)
    none = F.array().cast("array<int>")
    starts, labels = [], []
    for phrase, label in phrases:
        p = phrase.split()
        found = F.when(F.arrays_overlap("words", F.array(F.lit(p[0]))), places(F.col("words"), p)).otherwise(none)
        starts.append(found)
        labels.append(label)
    rows = worded.select(
        id_col,
        F.size("words").cast("long").alias("n_words"),
        F.array(*starts).alias("_starts"),
        F.when(F.arrays_overlap("words", join.prefix), join.blocks(F.col("words"))).otherwise(F.array().cast("array<struct<label:string,share:double,start:int,held:int,family:int,whole:boolean>>")).alias("blocks"),
    )
    base = F.filter(F.array(*(F.when(F.size(F.get("_starts", F.lit(k))) > 0, F.lit(label)) for k, label in enumerate(labels))), lambda x: x.isNotNull())
    return rows.select(
        id_col,
        "n_words",
        F.array_sort(F.flatten("_starts")).alias("starts"),
        F.array_sort(F.array_distinct(base)).alias("base_labels"),
        "blocks",
    )


def leading(blocks: Column, templates=TEMPLATES) -> Column:
    """Blocks that stand word for word, or of whose family no other at the same place holds more template words.

    Only names of one family, which differ in a word, dispute a place: a longer notice of another
    license beside a block takes nothing from it. Blocks come by family and start, so those at the
    same place are near by, and no block is compared with all.
    """
    sizes = [families(templates).count(f) for f in set(families(templates))]
    reach = (2 * 2 * SLACK + 1) * max(sizes, default=1)

    def kept(b, i):
        near = F.slice(blocks, F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1))
        return b["whole"] | ~F.exists(near, lambda c: (c["family"] == b["family"]) & (F.abs(c["start"] - b["start"]) <= 2 * SLACK) & (c["held"] > b["held"]))

    return F.filter(blocks, kept)


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_union("base_labels", F.transform(leading(F.col("blocks")), lambda b: b["label"])))
    score = F.when(F.size("base_labels") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["share"])), F.lit(0.0)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
    )


def _sql() -> str:
    """The same blocks without any filter: every window of every document that could hold enough of a template."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    temps = ", ".join(f"('{label}', {quoted(sorted(set(t.split())))}, {len(t.split()) + 2 * SLACK}, {f}, ' {t} ')" for (t, label), f in zip(TEMPLATES, families(TEMPLATES)))
    base = ", ".join(f"('{label}', {quoted(p.split())})" for p, label in PHRASES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
t(label, s, n, family, phrase) AS (VALUES {temps}),
p(label, s) AS (VALUES {base}),
b AS (SELECT r, label, unnest(list_filter(range(0, len(w) - len(s) + 1), lambda i: w[i + 1 : i + len(s)] = s)) AS i FROM d, p WHERE list_has_all(w, s)),
bb AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, list_sort(list_distinct(list(label))) AS labels FROM b GROUP BY r),
c AS (SELECT r, label, s, n, family, phrase, w, unnest(range(0, len(w))) AS i FROM d, t WHERE len(list_intersect(list_distinct(w), s)) >= {THRESHOLD} * len(s) - 1e-9),
h AS (SELECT r, label, i, family, len(s) AS m, len(list_intersect(s, w[i + 1 : i + n])) AS held, contains(' ' || array_to_string(w[i + 1 : i + n], ' ') || ' ', phrase) AS whole FROM c),
k AS (SELECT * FROM h WHERE held >= {THRESHOLD} * m - 1e-9),
l AS (SELECT r, list(DISTINCT label) AS labels FROM k WHERE whole OR NOT EXISTS (SELECT 1 FROM k o WHERE o.r = k.r AND o.family = k.family AND abs(o.i - k.i) <= {2 * SLACK} AND o.held > k.held) GROUP BY r),
m AS (SELECT r, max(held / m) AS share FROM k GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(bb.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(array_to_string(bb.labels, ','), '') AS base_labels,
array_to_string(list_sort(list_distinct(list_concat(coalesce(bb.labels, []), coalesce(l.labels, [])))), ',') AS labels, CASE WHEN bb.n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN bb USING (r) LEFT JOIN l USING (r) LEFT JOIN m USING (r)
"""


OP4_SQL = _sql()
