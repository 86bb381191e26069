"""Licence scan: a positional rare-token index over licence phrases, in DataFrame functions only.

Every template is a sequence of words with a label, a least number of words that must stand at their relative positions,
and a mandatory key phrase that must stand whole. Over all documents the document frequency of each licence word is counted
(one row per word, so the result is bounded by the templates). A template with n words of which `need` must match is looked
up by its n - need + 1 words of highest IDF: any acceptable place holds at least one of them, so no place is lost. A file's
positions of those rare words meet the template's postings by relative position, which gives candidate starts; each is
verified word by word, and then by its key phrase. All of it happens within the row: no shuffle but that of the word counts.

Defined results: null or empty text: no words, no labels, score 0, null first and last word. Repeated rows give repeated
rows. Ties in IDF go to the earlier word of the template. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels, as the contract has them.
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
# Further templates (label, words, key phrase): notices, and whole texts of short public licences.
MORE = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0"),
    ("mit-notice", "released under the mit license", "mit license"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "permission is hereby granted free of charge",
    ),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "with or without fee is hereby granted",
    ),
    (
        "bsd-2-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "source and binary forms",
    ),
    (
        "apache-2.0-notice",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache org licenses license 2 0",
    ),
    (
        "gpl-3.0-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gnu general public license as published by the free software foundation",
    ),
    (
        "zlib-text",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "alter it and redistribute it freely",
    ),
    (
        "unlicense-text",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "free and unencumbered software",
    ),
]
#: Least share of a further template's words that must stand in place.
COVER = 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates() -> list[dict]:
    """All templates: label, words, need (least words in place), key (start and length of the key phrase), base."""
    out = [{"label": x, "words": p.split(), "need": len(p.split()), "key": (0, len(p.split())), "base": True} for x, p in BASE]
    for label, phrase, key in MORE:
        w, k = phrase.split(), key.split()
        at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
        out.append({"label": label, "words": w, "need": math.ceil(COVER * len(w)), "key": (at, len(k)), "base": False})
    return out


def _quoted(words) -> str:
    return "array(" + ",".join(f"'{w}'" for w in words) + ")"


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, w): the words. Lower-casing is Unicode's, which differs from A-Z only in letters that stay word letters; the
    one letter that would become an ASCII word letter by itself (the Kelvin sign) is put aside first."""
    clean = F.lower(F.replace(F.coalesce(df[text], F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return df.select("doc_id", F.array_remove(F.split(clean, SEPARATORS), "").alias("w"))


def word_counts(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each licence word; one row per word of the templates at most."""
    rows = words.select(F.explode(F.array_intersect("w", F.expr(_quoted(vocabulary)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r.word: r.n for r in rows}


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_words, hits): hits has the template's index, its start (word from 0) and the words in place."""
    temps = templates()
    vocabulary = sorted({w for t in temps for w in t["words"]})
    words = with_words(df, text)
    df_of = word_counts(words, vocabulary)
    postings: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(temps):
        n = len(t["words"])
        rare = sorted(range(n), key=lambda i: (df_of.get(t["words"][i], 0), i))[: n - t["need"] + 1]
        for i in rare:
            postings.setdefault(t["words"][i], []).append((k, i))
    anchors = _quoted(sorted(postings))
    index = "map(" + ",".join(f"'{w}', array({','.join(f'named_struct("t",{k},"p",{p})' for k, p in ps)})" for w, ps in sorted(postings.items())) + ")"
    temp = "array(" + ",".join(f"named_struct('words',{_quoted(t['words'])},'need',{t['need']},'key',{t['key'][0]},'len',{t['key'][1]})" for t in temps) + ")"
    rows = words.select("doc_id", F.size("w").cast("long").alias("n_words"), F.expr(f"CASE WHEN arrays_overlap(w, {anchors}) THEN w END").alias("w"))
    at = f"filter(transform(w, (x, i) -> CASE WHEN array_contains({anchors}, x) THEN i END), i -> i IS NOT NULL)"
    rows = rows.select("doc_id", "n_words", "w", F.expr(at).alias("at"))
    starts = f"array_distinct(filter(flatten(transform(at, i -> transform(element_at({index}, w[i]), q -> named_struct('t', q.t, 's', i - q.p)))), c -> c.s >= 0))"
    rows = rows.select("doc_id", "n_words", "w", F.expr(starts).alias("starts"))
    here = "size(filter(transform({of}, (x, j) -> get(w, c.s + {off} + j) = x), ok -> ok))"
    found = here.format(of=f"{temp}[c.t].words", off="0")
    keyed = here.format(of=f"slice({temp}[c.t].words, {temp}[c.t].key + 1, {temp}[c.t].len)", off=f"{temp}[c.t].key")
    hits = f"filter(transform(starts, c -> named_struct('t', c.t, 's', c.s, 'n', {found}, 'k', {keyed})), h -> h.n >= {temp}[h.t].need AND h.k = {temp}[h.t].len)"
    return rows.select("doc_id", "n_words", F.coalesce(F.expr(hits), F.expr("cast(array() as array<struct<t:int,s:int,n:int,k:int>>)")).alias("hits"))


def report(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: counts, places and labels."""
    temps = templates()
    labels = _quoted(t["label"] for t in temps)
    sizes = "array(" + ",".join(str(len(t["words"])) for t in temps) + ")"
    base = f"filter(hits, h -> h.t < {len(BASE)})"
    return scan(df, text).select(
        "doc_id",
        "n_words",
        F.expr(f"cast(size({base}) as long)").alias("n_base"),
        F.expr(f"cast(array_min(transform({base}, h -> h.s)) as long)").alias("first_word"),
        F.expr(f"cast(array_max(transform({base}, h -> h.s)) as long)").alias("last_word"),
        F.expr(f"array_join(array_sort(array_distinct(transform({base}, h -> {labels}[h.t]))), ',')").alias("base_labels"),
        F.expr(f"array_join(array_sort(array_distinct(transform(hits, h -> {labels}[h.t]))), ',')").alias("labels"),
        F.expr(f"coalesce(array_max(transform(hits, h -> h.n / cast({sizes}[h.t] as double))), 0D)").alias("score"),
    )


def oracle() -> str:
    """The same by brute force over all words and all template positions, as DuckDB SQL."""
    temps = templates()
    rows = ",".join(f"({k},{p},'{w}')" for k, t in enumerate(temps) for p, w in enumerate(t["words"]))
    meta = ",".join(f"({k},'{t['label']}',{len(t['words'])},{t['need']},{t['key'][0]},{t['key'][1]},{t['base']})" for k, t in enumerate(temps))
    return f"""
WITH tw(t, p, word) AS (VALUES {rows}),
tm(t, label, n, need, ks, kl, base) AS (VALUES {meta}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
x AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
m AS (SELECT r, tw.t, i - tw.p AS s, count(*) AS n, count(*) FILTER (WHERE tw.p >= ks AND tw.p < ks + kl) AS k FROM x JOIN tw USING (word) JOIN tm ON tm.t = tw.t WHERE i - tw.p >= 0 GROUP BY ALL),
h AS (SELECT m.r, m.s, tm.label, tm.base, m.n / tm.n::DOUBLE AS cover FROM m JOIN tm USING (t) WHERE m.n >= tm.need AND m.k = tm.kl),
a AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(s) FILTER (WHERE base) AS first_word, max(s) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN a USING (r)"""
