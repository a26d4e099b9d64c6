"""License scans over a positional index of rare template words, in Spark SQL expressions alone.

1. Words of the templates are the index: (word, template, segment, position).  It is a literal of fixed size, as the templates
   are.  Long wordings are cut into segments of SEGMENT words, so that an inserted word moves the places of one segment alone.
2. One pass over the texts tells, by the joined words, which mandatory phrases stand in each, word for word.  Texts with none
   are done.  The number of documents that hold each licence word is counted over all rows; the fewer, the higher its IDF.
3. A segment is a hit where ``share`` of its words stand at their places.  So a hit holds one of any floor((1 - share) size) + 1
   of them: the segment's words of highest IDF are looked up in the document, and the place of each minus its place in the
   segment is where the segment may start.
4. At each such start the other postings are intersected by relative position, that is, words of the segment at their places
   are counted; a segment counts with its best start.  A template is a hit where ``share`` of its words do; the score is the
   largest such share.

All of 3 and 4 happens within a row, on arrays, so nothing is exploded or shuffled but the counts of words.

Base labels: places where a base phrase's words stand consecutively.  Defined results: null or empty texts have no words,
no places, empty labels and score 0; ids may be null and repeat, every row gives its own result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrase -> label, from the operator's contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_GNU = "gnu {}general public license as published by the free software foundation either version {}"
_GNU_NOTICE = (
    "{0} is free software you can redistribute it and or modify it under the terms of the gnu {1}general public license as published by the free software foundation either version {2} of the license or at your option any later version "
    "{0} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {1}general public license for more details"
)
_DISCLAIMER = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {}redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "{}redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
#: Words of a segment.
SEGMENT = 24
# One-line notices, file notices and whole short licences, as (label, wording, mandatory phrase).
TEMPLATES = (
    ("agpl-3.0", _GNU_NOTICE.format("this program", "affero ", 3), _GNU.format("affero ", 3)),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "except in compliance with the license",
    ),
    ("bsd-2-clause", _BSD.format("1 ", "2 ") + _DISCLAIMER, "redistribution and use in source and binary forms"),
    (
        "bsd-3-clause",
        _BSD.format("1 ", "2 ") + "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission " + _DISCLAIMER,
        "may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike 4 0 international"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", "eclipse public license 2 0"),
    ("gpl-2.0", _GNU_NOTICE.format("this program", "", 2), _GNU.format("", 2)),
    ("gpl-3.0", _GNU_NOTICE.format("this program", "", 3), _GNU.format("", 3)),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever "
        "resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "with or without fee is hereby granted",
    ),
    ("lgpl-3.0", _GNU_NOTICE.format("this library", "lesser ", 3), _GNU.format("lesser ", 3)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
        "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "permission is hereby granted free of charge",
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "if a copy of the mpl was not distributed with this file"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software released into the public domain"),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications "
        "and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
        "permission is granted to anyone to use this software for any purpose",
    ),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("reserved", "all rights reserved", "all rights reserved"),
)


def segments(wording: str) -> list[list[str]]:
    own = wording.split(" ")
    return [own[low : low + SEGMENT] for low in range(0, len(own), SEGMENT)]


def _places(words: Column, phrase: str) -> Column:
    """Starts (from 0) of a phrase in an array of words."""
    parts = phrase.split(" ")
    last = F.size(words) - len(parts)

    def here(i):
        ok = F.element_at(words, i + 1) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            ok = ok & (F.element_at(words, i + 1 + k) == p)
        return ok

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def _agreeing(words: Column, spots: Column, segment: Column) -> Column:
    """Most words of a segment that stand at their places from one start; only starts of its looked-up words are tried."""
    starts = F.flatten(F.transform(segment["looked"], lambda r: F.transform(F.filter(spots, lambda x: x["word"] == r["word"]), lambda x: x["at"] - r["place"])))
    places = F.sequence(F.lit(0), F.size(segment["words"]) - 1)
    agree = lambda start: F.size(F.filter(places, lambda p: F.coalesce(F.get(words, start + p) == F.get(segment["words"], p), F.lit(False))))
    return F.coalesce(F.array_max(F.transform(F.array_distinct(starts), agree)), F.lit(0))


def _total(template: int) -> Column:
    """Words of a template's segments that agree, null where nothing was asked."""
    return F.aggregate("agreed", F.lit(0), lambda s, a: s + F.when(a["template"] == template, a["n"]).otherwise(0))


def scan(docs: DataFrame, share: float = 0.75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    vocabulary = sorted({w for _, wording, _ in TEMPLATES for w in wording.split(" ")})
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.filter(F.split(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER), GAP), lambda w: w != "").alias("words"))
    spaced = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    rows = rows.withColumn("spaced", spaced)
    stands = lambda phrase: F.col("spaced").contains(f" {phrase} ")
    must = F.array(*map(stands, [m for _, _, m in TEMPLATES]))
    base = [F.when(stands(p), _places(F.col("words"), p)).otherwise(F.array().cast("array<int>")).alias(f"base{i}") for i, p in enumerate(BASE)]
    rows = rows.select("doc_id", "words", must.alias("must"), *base, F.array_intersect(_strings(vocabulary), F.col("words")).alias("own"))
    held = F.exists("must", lambda m: m)
    read = scratch.write(rows.select("doc_id", F.size("words").cast("bigint").alias("n_words"), "must", *(f"base{i}" for i in range(len(BASE))), "own", F.when(held, F.col("words")).alias("words")))

    counts = {r["word"]: r["df"] for r in read.select(F.explode("own").alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect()}  # the templates' words
    index, looked_up = [], set()
    for t, (_, wording, _) in enumerate(TEMPLATES):
        for own in segments(wording):
            # More words than a hit may lack, rarest first, so that every hit holds one of them.
            rare = sorted(range(len(own)), key=lambda p: (counts.get(own[p], 0), own[p], p))[: int(len(own) * (1 - share) + 1e-9) + 1]
            looked_up |= {own[p] for p in rare}
            looked = F.array(*(F.struct(F.lit(own[p]).alias("word"), F.lit(p).alias("place")) for p in rare))
            index.append(F.struct(F.lit(t).alias("template"), _strings(own).alias("words"), looked.alias("looked")))
    spots = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(sorted(looked_up)))
    read = read.withColumn("spots", spots)
    asked = F.filter(F.array(*index), lambda s: F.element_at("must", s["template"] + 1))
    agreed = F.transform(asked, lambda s: F.struct(s["template"].alias("template"), F.size(s["words"]).alias("size"), _agreeing(F.col("words"), F.col("spots"), s).alias("n")))
    read = read.withColumn("agreed", F.when(F.col("words").isNotNull(), F.filter(agreed, lambda a: a["n"] >= a["size"] * share - 1e-9)))
    scores = []
    for t, (_, wording, _) in enumerate(TEMPLATES):
        n = _total(t)
        scores.append(F.struct(F.lit(TEMPLATES[t][0]).alias("label"), (n / len(wording.split(" "))).alias("s")))
    kept = F.filter(F.array(*scores), lambda h: F.coalesce(h["s"] >= share - 1e-9, F.lit(False)))
    read = read.withColumn("kept", kept)

    places = F.concat(*(F.col(f"base{i}") for i in range(len(BASE))))
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"base{i}") > 0, F.lit(label)) for i, label in enumerate(BASE.values()))))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return read.select(
        "doc_id",
        "n_words",
        F.size(places).cast("bigint").alias("n_base"),
        F.array_min(places).cast("bigint").alias("first_word"),
        F.array_max(places).cast("bigint").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, F.transform("kept", lambda h: h["label"]))).alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("kept", lambda h: h["s"])), F.lit(0.0)), F.when(F.size(places) > 0, 1.0).otherwise(0.0)).alias("score"),
    )
