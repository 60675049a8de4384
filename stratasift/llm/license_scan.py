"""License scans by diagonal voting.

All rolling word k-grams of a text are hashed and joined to the positions of the same
k-grams in license templates. A hit at text word i and template word j votes for the
diagonal i - j: words that follow each other in both stay on one diagonal. Votes are
counted by diagonal and run, neighbouring diagonals of a template are merged (an inserted
or missing word shifts the rest by one), and the merged span is verified by the share of the
template's words that it covers in order. Templates are a small fixed table, so the join
broadcasts it and texts are never shuffled; only hits are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratasift.llm.common import WordHasher, materialise, window_hashes

#: Words in a rolling k-gram of notices and of whole licenses (LONG words or more), whose word pairs are too common.
K, LONG_K, LONG = 2, 5, 30
#: Farthest shift between merged diagonals, and the share of a template's k-grams that makes a license.
SHIFT, LEAST_COVER = 3, 0.7
#: Base phrases and their labels. Every place where a phrase stands counts.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices of public licenses and their labels, found as whole spans even when a few words differ.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu affero general public license version 3": "agpl-3.0",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
#: Whole public licenses without their copyright lines, and their labels.
_AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
    "the software or the use or other dealings in the software"
)
_BSD_FIRST = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_BSD_THIRD = (
    "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
)
_BSD_LAST = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness "
    "for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but "
    "not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or "
    "tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
LICENSES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
    "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _AS_IS: "mit",
    _BSD_FIRST + _BSD_LAST: "bsd-2-clause",
    _BSD_FIRST + _BSD_THIRD + _BSD_LAST: "bsd-3-clause",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in "
    "all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the "
    "author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other "
    "tortious action arising out of or in connection with the use or performance of this software": "isc",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to "
    "anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not "
    "be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not "
    "required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source "
    "distribution": "zlib",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled "
    "binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in "
    "the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of "
    "relinquishment in perpetuity of all present and future rights to this software under copyright law": "unlicense",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license "
    "2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or "
    "implied see the license for the specific language governing permissions and limitations under the license": "apache-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license "
    "or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a "
    "particular purpose see the gnu general public license for more details": "gpl-3.0-or-later",
}

#: Bytes that end a word: ASCII other than letters and digits. Upper case is folded before.
_SEPARATORS = bytes(32 if not (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) else b for b in range(256))


def license_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and non-ASCII characters after lower-casing A-Z; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SEPARATORS).split()


def template_table() -> list[tuple[int, str, str, int, int, bool]]:
    """(number, words, label, length, k, is_phrase) of every phrase, notice and license."""
    rows = [*((p, label, True) for p, label in PHRASES.items()), *((t, label, False) for t, label in {**TEMPLATES, **LICENSES}.items())]
    return [(i, words, label, n := len(words.split()), LONG_K if n >= LONG else K, phrase) for i, (words, label, phrase) in enumerate(rows)]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        row, at = batch.column(0), 0
        texts = batch.column(1).to_pylist()
        while at < len(texts):  # pieces of bounded size
            start, total, hashes, sizes = at, 0, [], []
            while at < len(texts) and total < 400_000:
                h = hasher(license_words(texts[at]))
                for k in (K, LONG_K):
                    hashes.append(window_hashes(h, k) if len(h) >= k else h[:0])
                    sizes.append(len(hashes[-1]))
                    total += sizes[-1]
                at += 1
            owner = np.repeat(np.repeat(np.arange(start, at), 2), sizes)
            position = np.concatenate([np.arange(n) for n in sizes]) if sizes else np.empty(0, np.int64)
            values = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
            for lo in range(0, len(values), 500_000):
                cut = slice(lo, lo + 500_000)
                yield pa.record_batch([row.take(pa.array(owner[cut])), pa.array(position[cut], pa.int64()), pa.array(values[cut].view(np.int64))], ["row", "at", "gram"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(license_words(t)) for t in batch.column(2).to_pylist()], pa.int64())], ["row", "doc_id", "n_words"])


def find_spans(texts: DataFrame) -> DataFrame:
    """Verified spans of rows (row, text): row, template, label, is_phrase, first, last, cover.

    first and last are word places, from 0. Phrases count at each diagonal where all their
    words stand; templates at each merged run of diagonals that covers LEAST_COVER of their
    k-grams and no more text words than the template has and `slack`: SHIFT on either side,
    a tenth of the words of a long template.
    """
    spark = texts.sparkSession
    hasher = WordHasher()
    grams = []
    for number, words, _, _, k, _ in template_table():
        grams += [(number, j, int(h)) for j, h in enumerate(window_hashes(hasher(words.encode().split()), k).view(np.int64))]
    index = F.broadcast(spark.createDataFrame(grams, "template int, j long, gram long"))  # a fixed table
    templates = F.broadcast(spark.createDataFrame(template_table(), "template int, words string, label string, length int, k int, is_phrase boolean")).drop("words")
    hits = texts.select("row", "text").mapInArrow(_grams, "row long, at long, gram long").join(index, "gram")
    hits, _ = materialise(hits.select("row", "template", (F.col("at") - F.col("j")).alias("diagonal"), "at", "j"))

    votes = hits.groupBy("row", "template", "diagonal").agg(F.count_distinct("j").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"))
    votes = votes.join(templates, "template")
    phrases = votes.where("is_phrase and votes = length - k + 1").select("row", "template", "label", "is_phrase", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("length") - 1).alias("last"), F.lit(1.0).alias("cover"))

    # Neighbouring diagonals of one template are merged while they are SHIFT apart at most and their text spans are close.
    # A run too long for one copy, as of repeats of a short notice, is read as the SHIFT diagonals from each of its own on.
    seen = Window.partitionBy("row", "template").orderBy("diagonal", "first")
    near = votes.where("not is_phrase")
    apart = (F.col("diagonal") - F.lag("diagonal").over(seen) > SHIFT) | (F.col("first") - F.lag("last").over(seen) > F.col("length"))
    near = near.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(seen))
    run = Window.partitionBy("row", "template", "run")
    ahead = run.orderBy("diagonal").rangeBetween(0, SHIFT)
    near = near.withColumn("slack", F.greatest(F.lit(2 * SHIFT), F.floor(F.col("length") / 10)))
    near = near.withColumn("long", F.max("last").over(run) + F.col("k") - F.min("first").over(run) > F.col("length") + F.col("slack"))
    ends = lambda f, c: F.when(F.col("long"), f(c).over(ahead)).otherwise(f(c).over(run))
    merged = near.select("row", "template", "label", "length", "k", "slack", "run", ends(F.min, "first").alias("first"), (ends(F.max, "last") + F.col("k") - 1).alias("last"), ends(F.min, "diagonal").alias("d0"), ends(F.max, "diagonal").alias("d1")).distinct()
    inside = merged.join(hits.withColumnRenamed("template", "t").withColumnRenamed("row", "r"), (F.col("row") == F.col("r")) & (F.col("template") == F.col("t")) & F.col("diagonal").between(F.col("d0"), F.col("d1")))
    cover = inside.groupBy("row", "template", "label", "length", "k", "slack", "run", "d0", "first", "last").agg(F.count_distinct("j").alias("found")).withColumn("cover", F.col("found") / (F.col("length") - F.col("k") + 1))
    whole = cover.where((F.col("cover") >= LEAST_COVER) & (F.col("last") - F.col("first") + 1 <= F.col("length") + F.col("slack")))
    return phrases.unionByName(whole.select("row", "template", "label", F.lit(False).alias("is_phrase"), "first", "last", "cover"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest share of a template that a span covers, 1 for a base phrase, 0 for
    none. Null and empty texts have no words and no labels (empty strings). Repeated rows
    and null ids are rows of their own; an empty table gives none; other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # Rows carry a key of their id and text: equal rows have equal results, so votes of repeated rows may meet.
    keyed = source.withColumn("row", F.xxhash64("doc_id", "text", F.col("doc_id").isNull(), F.col("text").isNull()))
    counted = keyed.select("row", "doc_id", "text").mapInArrow(_counts, f"row long, doc_id {dict(source.dtypes)['doc_id']}, n_words long")
    spans = find_spans(keyed)
    base = F.col("is_phrase")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy("row").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("cover").alias("score"),
    )
    out = counted.join(found, "row", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
