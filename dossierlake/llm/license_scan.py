"""Licence scans: windows of normalised text against licence templates by the Dice coefficient over word bigrams.

Normalised: A-Z in lower case, every run of anything but letters and digits one space. A and B being the sets of word
bigrams of a window and a template, Dice is 2 |A and B| / (|A| + |B|). A window of a template's own length is laid over
the whole text wherever an anchor word of the template stands, so that the word is where the template has it: a notice is
found in the middle of a line, over line ends and within a longer licence text alike.

What can't reach the threshold t isn't compared. A template of which a text has too few bigrams is out for that text, and
a window that has too few of them is passed over before its own bigrams are counted. A window needs |A| between |B| t / (2 - t) and |B| (2 - t) / t, and must
share so many of the template's bigrams that it can't miss all of a few: anchor words are the longest ones that cover
these few, function words last. Texts without any anchor word are passed over as a whole.

Each template counts once a text, by its best window (of equal ones the first). Of templates whose best windows overlap
only the better one counts, so a notice isn't taken for a sibling's; of equally good ones the one whose licence comes
last in order.

All of it is projections of built-in functions: no shuffle, no join, no Python, and every row for itself. Bigrams are
compared by 64-bit hashes. A null or empty text has no matches; nulls, repeats and ties of other columns change nothing;
work and memory follow a text's length, also where it repeats one anchor word. A column of the result's name is
replaced.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.common import free_name

THRESHOLD = 0.8
#: Bits of a window's code that say where it begins, and what is added so that this isn't negative.
SPAN, BEFORE = 33, 1 << 16

#: Wordings of notices and paragraphs as their licences give them.
TEMPLATES = [
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("AFL-3.0", "Licensed under the Academic Free License version 3.0"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("CC0-1.0", "This work is marked with CC0 1.0 Universal."),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the Licence); You may not use this work except in compliance with the Licence."),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MS-PL", "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software."),
    ("MulanPSL-2.0", "is licensed under Mulan PSL v2. You can use this software according to the terms and conditions of the Mulan PSL v2. You may obtain a copy of Mulan PSL v2 at: http://license.coscl.org.cn/MulanPSL2"),
    ("NCSA", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers.'),
    ("ODbL-1.0", "This database is made available under the Open Database License: http://opendatacommons.org/licenses/odbl/1.0/."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("Proprietary", "All rights reserved."),
    ("PSF-2.0", "This LICENSE AGREEMENT is between the Python Software Foundation, and the Individual or Organization (Licensee) accessing and otherwise using this software in source or binary form and its associated documentation."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Function words, which are anchors only where a template has nothing else.
COMMON = set("a all an and any as at be by for from in is it its may not of on or other that the this to under was were with you your".split())


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(size: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """The sizes of a set that can reach the threshold against one of ``size``."""
    low = -(-round(size * threshold * 1e9) // round((2 - threshold) * 1e9))
    return low, round(size * (2 - threshold) * 1e9) // round(threshold * 1e9)


def least_shared(size: int, threshold: float = THRESHOLD) -> int:
    """Bigrams of a template of ``size`` that a window must have to reach the threshold."""
    low, _ = size_bounds(size, threshold)
    return -(-round(threshold * (low + size) * 1e9) // round(2e9))


def bigram_hash(gram: str) -> int:
    """Spark's xxhash64 of a string."""
    return int.from_bytes(xxhash.xxh64_digest(gram.encode(), 42), "big", signed=True)


def anchor_words(text: str, threshold: float = THRESHOLD) -> list[str]:
    """Words one of which is in every window that reaches the threshold."""
    grams = template_bigrams(text)
    shared = least_shared(len(grams), threshold)
    open_grams, chosen = set(grams), []
    while len(grams) - len(open_grams) < len(grams) - shared + 1:
        gains = {w: sum(w in g.split() for g in open_grams) for w in template_words(text)}
        best = min((w for w in gains if gains[w]), key=lambda w: (w in COMMON, -len(w), w))
        chosen.append(best)
        open_grams = {g for g in open_grams if best not in g.split()}
    return chosen


def anchors(threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """(word, template, place of the word in it) of all templates."""
    return [
        (w, k, place)
        for k, (_, text) in enumerate(TEMPLATES)
        for w in sorted(anchor_words(text, threshold))
        for place, own in enumerate(template_words(text))
        if own == w
    ]


def scan(docs: DataFrame, text_column: str = "text", threshold: float = THRESHOLD, name: str = "matches") -> DataFrame:
    """``docs`` with an array of (dice, license, first, last): first and last word, from 1, of each match's window."""
    found = anchors(threshold)
    by_word: dict[str, list[int]] = {}
    for word, template, place in found:
        by_word.setdefault(word, []).append((template << SPAN) + BEFORE - place)
    places = F.create_map(*(x for w, own in by_word.items() for x in (F.lit(w), F.array(*(F.lit(code).cast("long") for code in own)))))
    rows = []
    for license_id, text in TEMPLATES:
        grams = template_bigrams(text)
        low, high = size_bounds(len(grams), threshold)
        hashes = F.array(*(F.lit(bigram_hash(g)) for g in grams))
        columns = {"license": F.lit(license_id), "grams": hashes, "words": F.lit(len(template_words(text))), "low": F.lit(low), "high": F.lit(high), "shared": F.lit(least_shared(len(grams), threshold))}
        rows.append(F.struct(*(c.alias(n) for n, c in columns.items())))
    templates = F.array(*rows)
    words, pairs, alive, starts, best = (free_name(docs, f"__license_{x}") for x in ("words", "pairs", "alive", "starts", "best"))
    template = lambda code: F.shiftright(code, SPAN).cast("int")

    def window(code: Column) -> tuple[Column, Column]:
        """First and last word of a window of its template's length, as far as it lies in the text."""
        start = (code.bitwiseAND(F.lit((1 << SPAN) - 1)) - BEFORE).cast("int")
        return F.greatest(start, F.lit(1)), F.least(start + F.get(templates, template(code)).words - 1, F.size(words))

    def own_pairs(code: Column) -> Column:
        first, last = window(code)
        return F.slice(pairs, first, F.greatest(last - first, F.lit(0)))

    def with_pairs(code: Column) -> Column:
        first, last = window(code)
        return F.struct(template(code).alias("template"), first.alias("first"), last.alias("last"), F.array_distinct(own_pairs(code)).alias("own"))

    def scored(s: Column) -> Column:
        t = F.get(templates, s.template)
        dice = F.lit(2.0) * F.size(F.array_intersect(s.own, t.grams)) / (F.size(s.own) + F.size(t.grams))
        return F.struct(dice.alias("dice"), t.license.alias("license"), (-s["first"]).alias("back"), s["last"].alias("last"), s.template.alias("template"))

    def shares(held: Column, t: Column) -> Column:
        return F.size(F.array_intersect(held, t.grams)) >= t.shared

    at = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.get(words, i - 1).isin(*by_word))
    # a window's code is one number, its template's and where it begins, so that distinct ones are found by hashing
    codes = F.flatten(
        F.transform(at, lambda i: F.transform(F.filter(F.try_element_at(places, F.get(words, i - 1)), lambda p: F.array_contains(alive, template(p))), lambda p: p + i))
    )
    living = F.filter(F.sequence(F.lit(0), F.lit(len(TEMPLATES) - 1)), lambda k: shares(F.col(pairs), F.get(templates, k)))
    likely = F.filter(F.array_distinct(codes), lambda code: shares(own_pairs(code), F.get(templates, template(code))))
    sized = F.filter(
        F.transform(starts, with_pairs), lambda s: F.size(s.own).between(F.get(templates, s.template).low, F.get(templates, s.template).high)
    )
    good = F.filter(F.transform(sized, scored), lambda s: s.dice >= threshold)
    none = F.array().cast("array<struct<dice:double,license:string,back:int,last:int,template:int>>")
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text_column, F.lit("")), UPPER, LOWER), r"[^\p{L}\p{N}]+", " "))
    any_anchor = F.exists(words, lambda w: w.isin(*by_word))
    fewer = F.greatest(F.size(words) - 1, F.lit(0))
    hashed = F.zip_with(F.slice(words, 1, fewer), F.slice(words, 2, fewer), lambda a, b: F.xxhash64(F.concat_ws(" ", a, b)))
    no_longs, no_templates = F.array().cast("array<long>"), F.array().cast("array<int>")
    marked = docs.withColumn(words, F.split(plain, " ")).withColumn(pairs, F.when(any_anchor, hashed).otherwise(no_longs))
    marked = marked.withColumn(alive, F.when(F.size(pairs) > 0, living).otherwise(no_templates))
    marked = marked.withColumn(starts, F.when(F.size(alive) > 0, likely).otherwise(no_longs))
    marked = marked.withColumn(best, F.when(F.size(starts) > 0, good).otherwise(none))

    each = F.transform(
        F.array_distinct(F.col(best).template), lambda k: F.array_max(F.filter(best, lambda s: s.template == k))
    )
    marked = marked.withColumn(best, F.when(F.size(best) > 0, each).otherwise(none))
    apart = F.filter(
        best,
        lambda s: ~F.exists(best, lambda o: (o > s) & (-o.back <= s.last) & (-s.back <= o.last)),
    )
    kept = F.transform(
        F.when(F.size(best) > 0, apart).otherwise(none),
        lambda s: F.struct(s.dice.alias("dice"), s.license.alias("license"), (-s.back).alias("first"), s["last"].alias("last")),
    )
    columns = [c for c in docs.columns if c != name]
    return marked.select(*columns, kept.alias(name))
