"""License scan: MinHash bands over overlapping windows find candidates, containment of word shingles decides.

A text is a row of shingles of three words (license lines are short; a line of five words has three). Templates are sorted by
size into classes; a class of width w looks at windows of w shingles, w/4 apart, so that a template of
up to 3w/4 shingles lies whole in one of them and makes up at least 3/8 of it. A window's MinHash is one permutation in
16 parts: the smallest hash in each part is one band. A whole template so meets its window in at least one band with
probability 1 - (1 - 3/8)^16 = 0.9995, with a fifth of its shingles changed 0.996; windows of up to 16 shingles keep nearly all
of their hashes as bands and miss nothing in practice.

A candidate is verified exactly: the share of the template's distinct shingles that occur in the window and half
a window around it. Three quarters are asked for, of short lines all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .seeds import word_hashes

SHINGLE, PARTS_BITS = 3, 4
#: Templates of the classes up to this one are lines that differ from each other in a word: all of their shingles must occur.
LINE_WIDTH = 16
#: Up to so many bands of templates the template side is broadcast; beyond, both sides are shuffled.
BROADCAST_BANDS = 1_000_000

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
# License notices and the lines that name a license.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. " + _AS_IS
    ),
    "MIT line": "Released under the MIT License.",
    "MIT line 2": "Licensed under the MIT License.",
    "MIT tag": "SPDX-License-Identifier: MIT",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain "
        "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
        "License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 tag": "SPDX-License-Identifier: Apache-2.0",
    "BSD-2-Clause": _BSD,
    "BSD-3-Clause": _BSD + (
        " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "BSD line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will "
        "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General "
        "Public License for more details."
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0 line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely."
    ),
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0 line": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0 line": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0 line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "All rights reserved line": "All rights reserved.",
    "All rights reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means.",
}


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((texts or TEMPLATES).items()), "license string, text string")


def _shingles(name: str) -> Column:
    """Hashes of runs of three words of a column of word hashes, in order, their top bits naming the part."""
    hashes = F.col(name)  # a column, for an expression here would be worked out for every word
    return F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - F.lit(SHINGLE - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *[F.get(hashes, i + F.lit(k)) for k in range(1, SHINGLE)]),
    )


def _bands(ordered: str) -> Column:
    """On rows (i, band) exploded from a sorted array: whether the value is a band, that is the first of its part.

    In the classes of lines, which have to be contained whole, every shingle is one: a short line shares its parts with whatever
    stands next to it.
    """
    part = lambda x: F.shiftright(x, 64 - PARTS_BITS)
    return (F.col("width") <= LINE_WIDTH) | (F.col("i") == 0) | (part(F.get(F.col(ordered), F.col("i") - 1)) != part(F.col("band")))


def width_for(shingles: int) -> int:
    """The class of a template: the smallest power of two, 4 at least, with three quarters of it holding the template."""
    w = 4
    while 3 * w // 4 < shingles:
        w *= 2
    return w


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.75) -> DataFrame:
    """One row per row of `docs` and license found: doc_id, license, containment, first_word, last_word of the window with the largest
    containment (the first of equals).

    known: license, text. Templates and texts that are null or have fewer than three words match nothing. Null keys
    are reported as null, repeated rows each on their own, templates of equal text all. Empty tables give an empty result.
    Other columns are ignored.
    """
    forms = known.select("license", word_hashes(F.col("text")).alias("hw")).select("license", F.array_distinct(_shingles("hw")).alias("ts")).where(F.size("ts") > 0)
    # one number per template: the widths in use
    sizes = sorted({width_for(r["n"]) for r in forms.select(F.size("ts").alias("n")).distinct().collect()})
    width = F.lit(None).cast("int")
    for w in reversed(sizes):
        width = F.when(F.size("ts") * 4 <= F.lit(3 * w), F.lit(w)).otherwise(width)
    forms = forms.withColumn("width", width).withColumn("ordered", F.sort_array("ts"))
    bands = forms.select("license", "width", "ts", "ordered", F.posexplode("ordered").alias("i", "band")).where(_bands("ordered")).select(
        "license", "ts", "width", "band")
    small = bands.count() <= BROADCAST_BANDS
    bands = F.broadcast(bands) if small else bands.hint("merge")

    rows = docs.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("row"), word_hashes(F.col(text)).alias("hw")).select(
        "doc_id", "row", _shingles("hw").alias("sh"))
    every = F.array(*[F.lit(w) for w in sizes]) if sizes else F.expr("cast(array() as array<int>)")
    windows = (
        rows.where(F.size("sh") > 0).select("*", F.explode(every).alias("width"))
        # the last windows may be short; the first begins at 0
        .select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.size("sh") - F.lit(1), F.lit(0)), F.expr("greatest(width div 4, 1)").cast("int"))).alias("start"))
        .select("*", F.sort_array(F.slice("sh", F.col("start") + 1, F.col("width"))).alias("ordered"))
        .select("*", F.posexplode("ordered").alias("i", "band"))
        .where(_bands("ordered"))
    )
    first = F.greatest(F.col("start") - F.expr("width div 4"), F.lit(0))
    around = F.slice("sh", first + 1, F.col("width") + F.expr("width div 2"))
    share = F.size(F.array_intersect("ts", around)) / F.size("ts")
    found = windows.join(bands, ["width", "band"]).select("doc_id", "row", "license", "start", "width", F.size("sh").alias("n"), share.alias("share")).where(
        F.col("share") >= F.when(F.col("width") <= LINE_WIDTH, 1.0).otherwise(least))
    best = F.max(F.struct("share", (-F.col("start")).alias("at"), "width", "n")).alias("b")
    return found.groupBy("row", "doc_id", "license").agg(best).select(
        "doc_id", "license", F.col("b.share").alias("containment"), (-F.col("b.at")).alias("first_word"),
        F.least(-F.col("b.at") + F.col("b.width"), F.col("b.n")).alias("__end")).select(
        "doc_id", "license", "containment", "first_word", (F.col("__end") + F.lit(SHINGLE - 2)).alias("last_word"))
