r"""Licence scan by sparse TF-IDF cosine, in DataFrame operations only.

Every line, every paragraph (lines up to one without letter or digit, so
comment marks don't matter) and the whole of a text is a unit.  A unit matches a
template if the cosine of their TF-IDF vectors reaches ``MIN_COSINE``: notices and
headers by lines and paragraphs, licence files as a whole.  Titles count at a text's
first line or paragraph alone.  Document frequencies of the templates' terms
are counted over all files, and a term outside the templates weighs as much as the
mean of theirs.  A unit whose cosine reaches the threshold must share one of a
template's heaviest terms (its other terms together weigh too little), so a
unit without any is passed over without loss.  Equal units are scored once.

A file that begins with a licence's title, matches as a whole, or most of whose
words stand in matching lines or paragraphs is a licence file; it licenses its
directory.  Files without a licence of their own take that of the nearest ancestor
directory with one, found by joining directories with the licensed ones on
every prefix of their path.

Defined results: null and empty texts have no licence of their own; a very long
text is judged unit by unit and as a whole; of matches that tie the earliest
counts; a null path has no directory and inherits nothing; repeated rows are
judged alike; several licence files in one directory give the licence that most of
them name, the least name of equals; an empty table gives an empty result;
columns besides the key, path and text are ignored whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm.session import join_checked, settle, table

MIN_COSINE = 0.7
TOKEN = "[a-z0-9]+(?:[.][0-9]+)*"
WORD = "[^\\x20\\x09-\\x0D]+"

#: A paragraph ends at lines without letter or digit.
PARAGRAPH = "\\n(?:[^A-Za-z0-9\\n]*+\\n)++"
LINE, PARA, WHOLE = 0, 1, 2

#: Short notices by which licences are commonly declared, the headers that licences propose for sources, and short licences in full.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
#: How licence files begin.
TITLES = (
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
)


def tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def document_frequencies(files: DataFrame, vocabulary: list[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """Files in all and files with each term; as many rows as the templates have terms reach the driver."""
    terms = F.array_intersect(F.array_distinct(tokens(F.coalesce(F.col(text).cast("string"), F.lit("")))), F.array(*[F.lit(t) for t in vocabulary]))
    rows = files.select(F.explode(F.concat(terms, F.array(F.lit("")))).alias("term")).groupBy("term").count().collect()
    found = {r.term: r["count"] for r in rows}
    return found.pop("", 0), found


class Weights:
    """Template vectors of unit length (``rows``: number, licence, whether a title, term, weight) and the terms of which a matching unit must share one."""

    def __init__(self, n: int, found: dict[str, int], templates=TEMPLATES, titles=TITLES, min_cosine: float = MIN_COSINE):
        bags = [(name, re.findall(TOKEN, text.lower())) for name, text in (*templates, *titles)]
        self.idf = {t: math.log((n + 1) / (found.get(t, 0) + 1)) + 1 for _, bag in bags for t in bag}
        self.other = sum(self.idf.values()) / len(self.idf)
        self.rows, self.heavy = [], set()
        for k, (name, bag) in enumerate(bags):
            raw = {t: (1 + math.log(bag.count(t))) * self.idf[t] for t in bag}
            norm = math.sqrt(sum(w * w for w in raw.values()))
            left = 1.0
            for t, w in sorted(raw.items(), key=lambda x: (-x[1], x[0])):
                self.rows.append((k, name, k >= len(templates), t, w / norm))
                # As long as the terms not yet taken could reach the threshold alone.
                if left >= min_cosine**2 - 1e-9:
                    self.heavy.add(t)
                left -= (w / norm) ** 2


def scored_units(units: DataFrame, weights: Weights, min_cosine: float = MIN_COSINE) -> DataFrame:
    """``unit_key, title, license, cosine`` of the distinct units that match: the best notice and the best title of each."""
    spark = units.sparkSession
    idf = spark.createDataFrame(sorted(weights.idf.items()), "term string, idf double")
    templates = spark.createDataFrame(weights.rows, "template int, license string, title boolean, term string, w double")
    distinct = units.groupBy("unit_key").agg(F.first("unit").alias("unit"))
    terms = distinct.select("unit_key", F.explode(tokens("unit")).alias("term")).groupBy("unit_key", "term").count()
    # Both tables are as large as the template list.
    vector = terms.join(F.broadcast(idf), "term", "left").select("unit_key", "term", ((1 + F.log("count")) * F.coalesce("idf", F.lit(weights.other))).alias("v"))
    norms = vector.groupBy("unit_key").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dots = vector.join(F.broadcast(templates), "term").groupBy("unit_key", "template", "license", "title").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm"), 9)
    best = dots.join(norms, "unit_key").withColumn("cosine", cosine).where(F.col("cosine") >= min_cosine)
    return best.groupBy("unit_key", "title").agg(F.max_by("license", F.struct("cosine", -F.col("template"))).alias("license"), F.max("cosine").alias("cosine"))


def units_of(text: Column) -> Column:
    """Lines, paragraphs of several lines and, of several lines, the whole: structs ``kind, no, unit``."""
    bare = F.regexp_replace(text, "^[^A-Za-z0-9]+", "")
    part = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("no"), x.alias("unit"))
    long = lambda parts: F.filter(parts, lambda x: F.contains(x["unit"], F.lit("\n")))
    lines = F.transform(F.split(bare, "\n"), part(LINE))
    return F.concat(lines, long(F.transform(F.split(bare, PARAGRAPH), part(PARA))), long(F.transform(F.array(bare), part(WHOLE))))


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", templates=TEMPLATES, titles=TITLES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """``key, path, license, cosine, origin, licensed_dir``; ``origin`` is ``own``, ``inherited`` or null."""
    vocabulary = sorted({t for _, x in (*templates, *titles) for t in re.findall(TOKEN, x.lower())})
    weights = Weights(*document_frequencies(files, vocabulary, text), templates, titles, min_cosine)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    heavy = F.array(*[F.lit(t) for t in sorted(weights.heavy)])
    files = files.select(F.col(key).alias("_key"), F.col(path).alias("_path"), whole.alias("_text"), F.xxhash64(whole).alias("_h"))
    likely = files.where(F.arrays_overlap(tokens("_text"), heavy)).select("_key", "_path", "_h", F.regexp_count("_text", F.lit(WORD)).alias("_n"), F.explode(units_of(F.col("_text"))).alias("u"))
    likely = likely.select("_key", "_path", "_h", "_n", "u.kind", "u.no", "u.unit").where(F.arrays_overlap(tokens("unit"), heavy))
    units = settle(likely.withColumns({"unit_key": F.struct(F.xxhash64("unit").alias("a"), F.xxhash64(F.lit("unit"), "unit").alias("b")), "n": F.regexp_count("unit", F.lit(WORD))}))
    matched = settle(scored_units(units, weights, min_cosine))
    hits = join_checked(units.drop("unit").distinct(), matched, ["unit_key"]).where("not title or (no = 0 and kind < 2)")
    words = lambda kind: F.coalesce(F.sum(F.when(~F.col("title") & (F.col("kind") == kind), F.col("n"))), F.lit(0))
    is_file = F.bool_or("title") | F.bool_or(F.col("kind") == WHOLE) | (2 * F.greatest(words(LINE), words(PARA)) >= F.max("_n"))
    own = hits.groupBy("_key", "_path", "_h").agg(F.max_by("license", F.struct("cosine", -F.col("no"), -F.col("kind"))).alias("own"), F.max("cosine").alias("cosine"), is_file.alias("whole"))
    own = settle(own)
    parent = F.when(F.instr("_path", "/") > 0, F.regexp_replace("_path", "/[^/]*$", ""))
    voted = own.where("whole").withColumn("dir", parent).where("dir is not null").groupBy("dir", "own").count()
    # Most files, then the least name: names are compared by their rank downwards.
    licensed = settle(voted.groupBy("dir").agg(F.max("count").alias("most"), F.collect_set(F.struct("count", "own")).alias("all")).select("dir", F.array_min(F.transform(F.filter("all", lambda x: x["count"] == F.col("most")), lambda x: x["own"])).alias("dir_license")))
    dirs = files.select(parent.alias("dir")).where("dir is not null").distinct()
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(F.split("dir", "/"), 1, k), "/").alias("at")))
    chain = dirs.select("dir", F.explode(up).alias("u")).select("dir", "u.depth", F.col("u.at").alias("at"))
    near = join_checked(chain, licensed.withColumnRenamed("dir", "at"), ["at"]).groupBy("dir").agg(F.max_by(F.struct("at", "dir_license"), "depth").alias("n"))
    near = settle(near.select("dir", F.col("n.at").alias("licensed_dir"), F.col("n.dir_license").alias("dir_license")))
    mine = own.select(F.col("_key").alias("_k"), F.col("_path").alias("_p"), F.col("_h").alias("_t"), "own", "cosine")
    same = F.col("_key").eqNullSafe(F.col("_k")) & F.col("_path").eqNullSafe(F.col("_p")) & (F.col("_h") == F.col("_t"))
    rows = files.select("_key", "_path", "_h", parent.alias("dir")).join(mine, same, "left")
    rows = join_checked(rows, near, ["dir"], "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited")
    return rows.select(F.col("_key").alias(key), F.col("_path").alias(path), F.coalesce("own", "dir_license").alias("license"), "cosine", origin.alias("origin"), F.when(origin == "inherited", F.col("licensed_dir")).alias("licensed_dir"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = F.concat(F.lit("/"), F.coalesce("source", F.lit("_")), F.lit("/"), F.coalesce("lang", F.lit("_")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("_")))
    return scan(docs.select("doc_id", "text", place.alias("path")))
