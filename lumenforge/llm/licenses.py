"""Licence scans with a positional rare-token index.

The templates, short notices and whole licence texts, are indexed by word and position; a word's inverse document
frequency over the templates says how rare it is. In each file the licence words of highest IDF are looked up; each
posting, less its position in the template, is a place where the template may begin. Places on which a word of the template's
mandatory key phrase and words around it agree are candidates: a key phrase that stands without its surroundings is none. There every mandatory
phrase has to stand word for word, and the share of the template's weight that stands where it should is the
score. All of it happens within a row.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words for Spark, whose engine is many times faster with classes that have a name; in a text that isn't lower-cased yet A-Z are of them too.
SPARK_WORD = r"[\p{Alnum}\P{ASCII}]+"
#: What stands between two words.
BETWEEN = r"[\p{Punct}\p{Cntrl} ]+"

#: Fixed by the contract: phrases whose every place counts, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: (label, template, mandatory key phrase, further mandatory phrases..): short notices.
NOTICES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version", "apache license version"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd", "licensed under the bsd 3 clause license", "bsd 3 clause"),
    ("bsd", "licensed under the bsd 2 clause license", "bsd 2 clause"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "distribute this software for any purpose with or without fee"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc0", "released under cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
)

#: The same for whole texts: licences, and the notices that licences ask for.
TEXTS = (
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
        OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included",
    ),
    (
        "bsd-3-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source
        code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may
        be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
        EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
        "redistributions in binary form must reproduce the above copyright notice",
        "may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    (
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source
        code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
        EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
        "other materials provided with the distribution this software is provided by the copyright holders and contributors",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS""",
        "for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing",
    ),
    (
        "apache-2.0",
        """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and
        conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.""",
        "apache license version 2 0 january 2004",
    ),
    (
        "gpl-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License,
        or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details.""",
        "gnu general public license as published by the free software foundation either version 3 of the license",
    ),
    (
        "gpl-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License,
        or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details.""",
        "gnu general public license as published by the free software foundation either version 2 of the license",
    ),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License,
        or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
        "gnu lesser general public license as published by the free software foundation",
    ),
    (
        "agpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License,
        or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
        "gnu affero general public license as published by the free software foundation",
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "subject to the terms of the mozilla public license v 2 0",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the
        public domain.""",
        "anyone is free to copy modify publish use compile sell or distribute this software",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
        wrote the original software.""",
        "the origin of this software must not be misrepresented",
    ),
    (
        "bsl-1.0",
        """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
        (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software""",
        "to use reproduce display distribute execute and transmit the software",
    ),
    (
        "cc0",
        """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is published under the CC0 1.0 Universal Public Domain Dedication.""",
        "has waived all copyright and related or neighboring rights to",
    ),
    (
        "wtfpl",
        """Do what the fuck you want to public license Version 2, December 2004 Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.""",
        "you want to public license",
    ),
)
#: Tags of the form `SPDX-License-Identifier: <name>`: label and name.
TAGS = tuple(
    (label, f"SPDX-License-Identifier: {name}", f"identifier {name}")
    for label, name in (("mit", "MIT"), ("apache-2.0", "Apache-2.0"), ("gpl-2.0", "GPL-2.0"), ("gpl-3.0", "GPL-3.0"), ("lgpl", "LGPL-2.1"), ("lgpl", "LGPL-3.0"), ("agpl", "AGPL-3.0"), ("bsd-2-clause", "BSD-2-Clause"), ("bsd-3-clause", "BSD-3-Clause"), ("mpl-2.0", "MPL-2.0"), ("isc", "ISC"), ("epl", "EPL-2.0"), ("eupl", "EUPL-1.2"), ("cc-by", "CC-BY-4.0"), ("cc-by-sa", "CC-BY-SA-4.0"), ("cc0", "CC0-1.0"), ("unlicense", "Unlicense"))
)
#: Parts of licence texts that stand alone.
PARTS = (
    ("apache", "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of", "grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "in binary form must reproduce the above copyright notice"),
    ("gpl", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software", "designed to take away your freedom to share and change it"),
    ("epl", "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE", "eclipse public license v 2"),
    ("eupl", "This European Union Public Licence (the EUPL) applies to the Work (as defined below) which is provided under the terms of this Licence", "european union public licence"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "creative commons attribution sharealike 4 0 international"),
)
TEMPLATES = NOTICES + TEXTS + TAGS + PARTS
#: Words that stand around anything and anchor nothing.
STOP = frozenset("a an and any as at be by for from in is it its of on or that the this to was we with you your".split())
#: Words of a template on either side of its key phrase that may anchor it, and how many of the rarest do; a text of LONG words needs two of them, a notice one.
AROUND, ANCHORS, LONG = 25, 8, 30
#: A further phrase may stand so many words off its place: holders' names and years differ in length.
SLACK = 12


def index(templates=TEMPLATES) -> tuple[dict[str, float], list[dict]]:
    """(idf of every template word, templates with their postings).

    Postings are (word, position, side): side 0 for the rarest words of the key phrase, side 1 for the rarest around it; ties go
    to the longer word; words of STOP stand nowhere. A template without words around its key phrase needs two words of it instead.
    """
    cut = lambda t: re.findall(WORD, t.lower())
    texts = [cut(t[1]) for t in templates]
    seen = Counter(w for words in texts for w in set(words))
    idf = {w: math.log(1 + len(templates) / n) for w, n in seen.items()}
    out = []
    for (label, _, *phrases), words in zip(templates, texts, strict=True):
        keys = [cut(p) for p in phrases]
        places = []
        for key in keys:
            where = [i for i in range(len(words)) if words[i : i + len(key)] == key]
            if not where:
                raise ValueError(f"{label}: the phrase {' '.join(key)!r} does not stand in its template")
            places.append(where[0])
        at, end = places[0], places[0] + len(keys[0])
        rarest = lambda span: sorted(span, key=lambda i: (-idf[words[i]], -len(words[i]), i))[:ANCHORS]  # noqa: B023, E731
        inside = rarest(range(at, end))
        around = rarest([i for i in range(max(0, at - AROUND), min(len(words), end + AROUND)) if not at <= i < end and words[i] not in STOP])
        if not around:
            inside, around = inside[:1], inside[1:]
        postings = [(words[i], i, 0) for i in inside] + [(words[i], i, 1) for i in around]
        out.append({"label": label, "words": words, "keys": keys, "places": places, "postings": postings, "need": 2 if len(words) >= LONG else 1})
    return idf, out


def _gate(phrase: list[str]) -> tuple[str, str | None]:
    """(what the lower-cased text of any text with the phrase holds, pattern that it matches besides): the longest word; where that is short, and would stand anywhere, the phrase."""
    longest = max(phrase, key=len)
    return longest, None if len(longest) >= 5 else BETWEEN.join(phrase)


def _may_hold(text: Column, phrases: list[list[str]]) -> Column:
    """Whether a text may hold any of the phrases. Plain search on the lower-cased text, which is far cheaper than one pattern of all words."""
    gates = sorted({_gate(p) for p in phrases}, key=str)
    alone = [g for g, more in gates if more is None]
    found = F.lit(False)
    for g in alone:
        if not any(o != g and o in g for o in alone):
            found = found | text.contains(g)
    for g, more in gates:
        if more is not None:
            found = found | (text.contains(g) & text.rlike(more))
    return found


def _stands(words: Column, at: Column, phrase: list[str]) -> Column:
    ok = F.lit(True)
    for j, w in enumerate(phrase):
        ok = ok & F.coalesce(F.get(words, at + j) == w, F.lit(False))
    return ok


def _array(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def _candidates(hits: Column, known: list[dict]) -> Column:
    """(t, o): places o at which template t may begin, on which a word of its key phrase and enough words around it agree."""
    by: dict[str, list[tuple[int, int, int]]] = {}
    for k, t in enumerate(known):
        for w, i, side in t["postings"]:
            by.setdefault(w, []).append((k, i, side))
    words = sorted(by)
    posting = lambda k, i, side: F.struct(F.lit(k).alias("t"), F.lit(i).alias("i"), F.lit(side).alias("s"))
    lists = F.array(*[F.array(*[posting(*p) for p in by[w]]) for w in words])
    number = lambda w: F.array_position(_array(words, "string"), w) - 1
    place = lambda h: F.transform(F.get(lists, number(h["w"]).cast("int")), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["i"]).alias("o"), p["s"].alias("s")))
    found = F.array_sort(F.flatten(F.transform(F.filter(hits, lambda h: h["w"].isin(words)), place)))

    def agreed(s: Column) -> Column:
        def here(e: Column, j: Column) -> Column:
            around = lambda n: F.coalesce((F.get(s, j + n)["t"] == e["t"]) & (F.get(s, j + n)["o"] == e["o"]) & (F.get(s, j + n)["s"] == 1), F.lit(False))
            long = F.get(_array([t["need"] for t in known], "int"), e["t"]) > 1
            # sorted, the last word of the key phrase stands before the first one around it
            ok = (e["s"] == 0) & around(1) & (~long | around(2))
            return F.when(ok, F.struct(e["t"].alias("t"), e["o"].alias("o")))

        return F.filter(F.transform(s, here), lambda x: x.isNotNull())

    return let(found, agreed)


def _verify(words: Column, found: Column, known: list[dict]) -> Column:
    """The candidates at which the key phrase stands word for word, and the further phrases within SLACK words of their places."""

    def ok(c: Column) -> Column:
        out = F.lit(False)
        for k, t in enumerate(known):
            all_ = _stands(words, c["o"] + t["places"][0], t["keys"][0])
            for key, at in zip(t["keys"][1:], t["places"][1:], strict=True):
                all_ = all_ & F.exists(F.sequence(F.lit(-SLACK), F.lit(SLACK)), lambda d: _stands(words, c["o"] + d + at, key))  # noqa: B023
            out = F.when(c["t"] == k, all_).otherwise(out)
        return out

    return F.filter(found, ok)


def _coverage(words: Column, c: Column, known: list[dict], idf: dict[str, float]) -> Column:
    """The share of the template's weight that stands where it should."""
    texts = F.array(*[_array(t["words"], "string") for t in known])
    weights = F.array(*[_array([idf[w] / sum(idf[x] for x in t["words"]) for w in t["words"]], "double") for t in known])
    text, weight = F.get(texts, c["t"]), F.get(weights, c["t"])
    own = F.transform(text, lambda w, j: F.when(F.get(words, c["o"] + j) == w, F.get(weight, j)).otherwise(0.0))
    return F.aggregate(own, F.lit(0.0), lambda a, x: a + x)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, places) of every row.

    A null text counts as empty: no words, null places, empty labels, score 0. Ids may be null or
    repeated, each row has its own result; other columns, whatever their names, are not looked at; an empty table gives no rows. Nothing is
    shuffled: a text is matched within its row, whatever its length. Texts without any template's key phrase or base phrase are counted
    but not cut into words. places lists label:word of every verified template, the word being where its key phrase begins; of templates that
    begin at one word, the one listed first in `templates` stands first, and equal entries stand once.
    """
    idf, known = index(templates)
    phrases = [(p.split(), label) for p, label in BASE]
    looked = sorted({w for t in known for w, _, _ in t["postings"]} | {p[0] for p, _ in phrases})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = df.select(F.col(id_col).alias("id"), text.alias("t"))
    d = d.withColumn("n_words", F.regexp_count("t", F.lit(SPARK_WORD)).cast("long"))
    maybe = let(F.lower("t"), lambda x: _may_hold(x, [t["keys"][0] for t in known] + [p for p, _ in phrases]))
    d = d.withColumn("w", F.when(maybe, F.regexp_extract_all(ascii_lower(F.col("t")), F.lit(SPARK_WORD), F.lit(0)))).drop("t")
    words = F.col("w")
    hits = F.filter(F.transform("w", lambda w, i: F.when(w.isin(looked), F.struct(i.alias("i"), w.alias("w")))), lambda x: x.isNotNull())
    d = d.withColumn("h", hits)
    starts = lambda w: F.transform(F.filter("h", lambda h: h["w"] == w), lambda h: h["i"])
    base = {f"b_{label}": F.filter(starts(p[0]), lambda i: _stands(words, i, p)) for p, label in phrases}  # noqa: B023
    d = d.withColumns({k: F.coalesce(v, F.array().cast("array<int>")) for k, v in base.items()})
    d = d.withColumn("c", _candidates(F.col("h"), known))
    d = d.withColumn("c", F.when(F.size("c") > 0, _verify(words, F.col("c"), known)).otherwise(F.array().cast("array<struct<t:int,o:int>>")))
    named = _array([t["label"] for t in known], "string")
    begin = _array([t["places"][0] for t in known], "int")
    places = F.concat(*[F.col(f"b_{label}") for _, label in phrases])
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"b_{label}") > 0, label) for _, label in phrases]))
    own = F.transform("c", lambda c: F.get(named, c["t"]))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    spans = F.transform("c", lambda c: F.concat_ws(":", F.get(named, c["t"]), (c["o"] + F.get(begin, c["t"])).cast("string")))
    # a base phrase alone is worth the share of its words in the notice that it belongs to
    alone = {label: max(sum(idf[w] for w in p) / sum(idf[w] for w in t["words"]) for t in known if t["label"] == label) for p, label in phrases}
    best = F.when(F.size("c") > 0, F.array_max(F.transform("c", lambda c: _coverage(words, c, known, idf)))).otherwise(0.0)
    score = F.greatest(F.coalesce(best, F.lit(0.0)), *[F.when(F.size(f"b_{label}") > 0, s).otherwise(0.0) for label, s in alone.items()])
    return d.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        let(F.concat(base_labels, own), joined).alias("labels"),
        F.least(F.lit(1.0), score).alias("score"),
        F.array_join(F.array_distinct(spans), ",").alias("places"),
    )
