"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

DataFrame functions only, and no shuffle: a document's row holds all that is found in it.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, whole

# Names and notices of licenses in public use.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0-line": "Licensed under CC BY-ND 4.0.",
    "BSD-3-Clause-line": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: Words of a shingle; the share of a template's shingles that a window must contain; hash functions (one a band).
SHINGLE, CONTAINED, BANDS = 5, 0.8, 12


def mask(band: int) -> int:
    """A band's hash function orders shingles by their hash xor this."""
    return xxhash.xxh64_intdigest(f"band {band}".encode(), 9) >> 1


def normal(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def shingles_of(text: Column) -> Column:
    """Hashes (63 bits) of the shingles of a text's lower-cased words, in order; fewer words than a shingle have none."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")

    def of(w: Column) -> Column:
        def one(i: Column) -> Column:
            return F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]), 1)

        return F.when(F.size(w) < SHINGLE, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), one))

    return let(F.transform(words, lambda x: F.xxhash64(x)), of)


class Template:
    """A template's shingles, the least of them under each band, and its windows: of width shingles, every stride.

    A copy of n shingles lies whole in a window. For n under 8 windows have n shingles and start everywhere; else they
    start at every fourth shingle and are at most 7 longer. A copy with a containment of 0.8 so shares at least
    0.47 of the union of both sets, and one of the 12 bands meets with probability 1 - 0.53^12, over 0.999.
    """

    def __init__(self, name: str, hashes: list[int]) -> None:
        self.name, self.hashes = name, sorted(set(hashes))
        n = len(hashes)
        self.stride = 1 if n < 8 else 4
        self.width = n if n < 8 else 4 * (-(-n // 4) + 1)
        self.least = [min(self.hashes, key=lambda h, b=b: h ^ mask(b)) for b in range(BANDS)]


def compiled(spark, templates: dict[str, str] = TEMPLATES) -> list[Template]:
    """The templates' shingles, hashed as the texts' are. Templates with fewer words than a shingle can't be found."""
    short = [name for name, text in templates.items() if len(normal(text)) < SHINGLE]
    if short:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    rows = spark.createDataFrame([*templates.items()], "name string, text string").select("name", shingles_of(F.col("text")).alias("s")).collect()
    by = {r.name: r.s for r in rows}
    return [Template(name, by[name]) for name in templates]


def matches(text: Column, templates: list[Template]) -> Column:
    """array<struct<template, containment, start, end>> of a text, the best window of each template that it contains.

    A window meets a template in a band if the least shingle of both is the same, so just at a text's shingles that are
    some template's least ones its windows are hashed; that finds what hashing all windows finds. start and end count
    words. Ties go to the earliest window. Of matches at one place whose templates have most of their words in common (a
    license with a clause more, say) the one that is contained most is told, of equals the longest.
    """
    by: dict[int, list[tuple[int, int]]] = {}
    for t, tem in enumerate(templates):
        for b, h in enumerate(tem.least):
            by.setdefault(h, []).append((t, b))
    keys = sorted(by)
    bands = F.create_map(*[x for h in keys for x in (F.lit(h), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(b).alias("b")) for t, b in sorted(by[h])]))])
    masks = F.array(*[F.lit(mask(b)) for b in range(BANDS)])
    width, stride = F.array(*[F.lit(t.width) for t in templates]), F.array(*[F.lit(t.stride) for t in templates])
    sets, names = F.array(*[F.array(*[F.lit(h) for h in t.hashes]) for t in templates]), F.array(*[F.lit(t.name) for t in templates])

    alike = [[u for u, b in enumerate(templates) if u != t and len(set(a.hashes) & set(b.hashes)) >= CONTAINED * len(a.hashes)] for t, a in enumerate(templates)]
    rivals, sizes = F.array(*[F.array(*[F.lit(u) for u in r]).cast("array<int>") for r in alike]), F.array(*[F.lit(len(t.hashes)) for t in templates])

    def found(s: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.get(s, i).isin(keys))
        met = F.flatten(F.transform(at, lambda i: F.transform(F.element_at(bands, F.get(s, i)), lambda tb: F.struct(i.alias("i"), tb["t"].alias("t"), tb["b"].alias("b")))))

        def windows(m: Column) -> Column:
            w, g = F.get(width, m["t"]), F.get(stride, m["t"])
            first = F.ceil(F.greatest(F.lit(0), m["i"] - w + 1) / g).cast("int") * g
            starts = F.when(first <= m["i"], F.sequence(first, F.greatest(first, m["i"]), g)).otherwise(F.array().cast("array<int>"))
            same = F.filter(starts, lambda st: F.array_min(F.transform(F.slice(s, st + 1, w), lambda x: x.bitwiseXOR(F.get(masks, m["b"])))) == F.get(s, m["i"]).bitwiseXOR(F.get(masks, m["b"])))
            return F.transform(same, lambda st: F.struct(m["t"].alias("t"), st.alias("st")))

        def verified(w: Column) -> Column:
            own = F.get(sets, w["t"])
            share = F.size(F.array_intersect(F.slice(s, w["st"] + 1, F.get(width, w["t"])), own)) / F.size(own)
            return F.struct(w["t"].alias("t"), share.alias("share"), (-w["st"]).alias("back"))

        good = F.filter(F.transform(F.array_distinct(F.flatten(F.transform(met, windows))), verified), lambda w: w["share"] >= CONTAINED)

        def best(g: Column) -> Column:
            every = F.array_distinct(F.transform(g, lambda w: w["t"]))
            tops = F.transform(F.array_sort(every), lambda t: F.array_max(F.filter(g, lambda w: w["t"] == t)))
            ahead = lambda o, w: (o["share"] > w["share"]) | (o["share"] == w["share"]) & (F.get(sizes, o["t"]) > F.get(sizes, w["t"]))
            near = lambda o, w: (-w["back"] < -o["back"] + F.get(width, o["t"])) & (-o["back"] < -w["back"] + F.get(width, w["t"]))
            told = lambda all_: F.filter(all_, lambda w: ~F.exists(all_, lambda o: F.array_contains(F.get(rivals, w["t"]), o["t"]) & near(o, w) & ahead(o, w)))
            return F.transform(let(tops, told), lambda w: F.struct(F.get(names, w["t"]).alias("template"), w["share"].alias("containment"), (-w["back"]).cast("long").alias("start"), F.least(F.size(s) + (SHINGLE - 1), F.get(width, w["t"]) - w["back"] + (SHINGLE - 1)).cast("long").alias("end")))

        return let(good, best)

    none = F.array().cast("array<struct<template:string,containment:double,start:bigint,end:bigint>>")
    return let(shingles_of(text), lambda s: F.when(F.exists(s, lambda x: x.isin(keys)), found(s)).otherwise(none))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """docs with licenses_: see matches(). Null and empty texts have none; no row is dropped, repeated rows are alike, very
    long texts are read whole, an empty table gives an empty one. Further columns keep their names; licenses_ is taken."""
    return docs.withColumn("licenses_", matches(whole(F.col("text")), compiled(docs.sparkSession, templates)))
