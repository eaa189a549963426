"""License scans by sentence rules.

A document's sentences, as lower-case words in one spelling, are mapped to identifiers of known licence sentences by walking a trie
of their words from every sentence start (after a full stop or a line break), so wrapped lines do not matter.  A sentence may have
holes (<*>) for names and dates, of up to HOLE words of one sentence or line.  The sequence of identifiers is then matched against ordered rules: a rule's
sentences must come in this order, with at most GAP unknown sentences between two of them; the longest rule that matches at a place
wins.  A sentence beyond the gap is not lost where its licence has a rule of that sentence alone; a BSD grant without its conditions
names no licence.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Most unknown sentences between two sentences of a rule.
GAP = 2
#: Most words that stand in a hole of a sentence.
HOLE = 12

# Licence sentences.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "mit-liability": "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of <*> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-adverts": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-warranty": "This software is provided by <*> \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl2-free": "This <*> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-free": "This <*> is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-only": "This <*> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "lgpl-free": "This <*> is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-free": "This <*> is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-free": "This <*> is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This <*> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this <*>",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "apache-title": "Apache License Version 2.0, January 2004",
    "mpl-ref": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "epl-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "epl1-terms": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    "boost-ref": "Distributed under the Boost Software License, Version 1.0",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    "postgres-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted",
    "wtfpl": "You just do what the fuck you want to",
    "by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "by-nd-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "by-nc-sa-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "by-nc-nd-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "zero-ref": "This work is dedicated to the public domain under CC0 1.0",
    "zero-waived": "To the extent possible under law, <*> has waived all copyright and related or neighboring rights to <*>",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "unlicense-free": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
}
# Names of licences in sentences that only refer to them, and the ways to refer.
NAMES = {
    "MIT": ["MIT License"], "ISC": ["ISC License"], "BSD": ["BSD License"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License"], "GPL-2.0-only": ["GNU General Public License, version 2", "GNU GPL v2", "GPLv2"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU GPL v3", "GPLv3"], "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1"], "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "AGPLv3"], "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"], "EPL-2.0": ["Eclipse Public License 2.0"], "BSL-1.0": ["Boost Software License, Version 1.0"],
    "Unlicense": ["Unlicense"], "CC-BY-4.0": ["CC BY 4.0"], "CC-BY-SA-4.0": ["CC BY-SA 4.0"], "CC-BY-NC-4.0": ["CC BY-NC 4.0"], "CC-BY-ND-4.0": ["CC BY-ND 4.0"], "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"], "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0"], "CC0-1.0": ["CC0 1.0"],
}
WAYS = ["licensed under", "licensed under the", "released under", "released under the", "distributed under", "distributed under the", "distributed under the terms of the", "available under", "available under the"]
SUBJECTS = ["", "this work is", "this project is", "this software is", "this code is", "this file is", "this document is", "this dataset is", "this program is", "this library is"]
# Ordered rules, licence and its sentences.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("ISC", ["isc-grant"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-grant", "apache-copy", "apache-warranty"]),
    ("Apache-2.0", ["apache-grant"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-copy"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-copy"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("GPL-2.0", ["gpl2-title", "verbatim"]),
    ("GPL-2.0", ["gpl2-title"]),
    ("GPL-3.0", ["gpl3-title", "verbatim"]),
    ("GPL-3.0", ["gpl3-title"]),
    ("GPL", ["gpl-copy"]),
    ("LGPL-2.1-or-later", ["lgpl-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("LGPL-2.1", ["lgpl21-title"]),
    ("LGPL-3.0", ["lgpl3-title"]),
    ("AGPL-3.0-or-later", ["agpl-free"]),
    ("AGPL-3.0", ["agpl-title"]),
    ("Apache-2.0", ["apache-title"]),
    ("MPL-2.0", ["mpl-ref"]),
    ("EPL-2.0", ["epl-terms"]),
    ("EPL-1.0", ["epl1-terms"]),
    ("BSL-1.0", ["boost-grant"]),
    ("BSL-1.0", ["boost-ref"]),
    ("Zlib", ["zlib-warranty", "zlib-grant", "zlib-origin"]),
    ("Zlib", ["zlib-grant"]),
    ("PostgreSQL", ["postgres-grant"]),
    ("WTFPL", ["wtfpl"]),
    ("CC-BY-4.0", ["by-long"]),
    ("CC-BY-SA-4.0", ["by-sa-long"]),
    ("CC-BY-NC-4.0", ["by-nc-long"]),
    ("CC-BY-ND-4.0", ["by-nd-long"]),
    ("CC-BY-NC-SA-4.0", ["by-nc-sa-long"]),
    ("CC-BY-NC-ND-4.0", ["by-nc-nd-long"]),
    ("CC0-1.0", ["zero-ref"]),
    ("CC0-1.0", ["zero-waived"]),
    ("Unlicense", ["unlicense", "unlicense-free"]),
    ("Unlicense", ["unlicense"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-adverts", "bsd-names"]),
    *[(name, [f"ref:{name}"]) for name in NAMES],
]

WORD = re.compile(r"[^\W_]+")
STOP = re.compile(r"[.!?;:]|\n")
#: Every sentence has one of these; texts without any have no licence.
HINTS = ("licens", "licenc", "permi", "redistribut", "software", "copyright", "cc0", "public domain", "gpl", "under cc", "free to copy", "do what the")
# Spellings that are read as one.
SPELLED = {"licence": "license", "licenced": "licensed", "licences": "licenses", "organisation": "organization", "noncommercial": "noncommercial", "merchantibility": "merchantability"}


def words_of(sentence: str) -> list[str]:
    """Lower-case words in one spelling; "*" is a hole."""
    return [SPELLED.get(w, w) for w in re.findall(r"[^\W_]+|(?<=<)\*(?=>)", sentence.lower())]


def all_sentences() -> list[tuple[str, list[str]]]:
    """Identifier and words of every known sentence."""
    out = [(name, words_of(text)) for name, text in SENTENCES.items()]
    for name, forms in NAMES.items():
        out += [(f"ref:{name}", words_of(f"{subject} {way} {form}")) for form in forms for way in WAYS for subject in SUBJECTS]
        out.append((f"ref:{name}", ["spdx", "license", "identifier", *words_of(name)]))
    return out


@lru_cache(1)
def sentence_trie() -> dict:
    trie: dict = {}
    for name, words in all_sentences():
        at = trie
        for w in words:
            at = at.setdefault(w, {})
        at.setdefault("", name)
    return trie


def _known(words: list[str], starts: list[bool], i: int, trie: dict) -> tuple[str, int] | None:
    """The longest known sentence at word i that ends where a sentence may end: its identifier and end."""
    best = None
    work = [(trie, i)]
    while work:
        at, j = work.pop()
        if "" in at and starts[j] and (best is None or j > best[1]):
            best = (at[""], j)
        if j < len(words) and words[j] in at:
            work.append((at[words[j]], j + 1))
        if "*" in at:
            for k in range(j + 1, min(j + HOLE, len(words)) + 1):
                work.append((at["*"], k))
                if starts[k]:
                    break
    return best


def sentence_ids(text: str) -> list[tuple[str | None, int, int]]:
    """Known sentence (None: unknown), start and end of the sentences of a text in order."""
    trie = sentence_trie()
    places = [m.span() for m in WORD.finditer(text)]
    words = [SPELLED.get(w := text[s:e].lower(), w) for s, e in places]
    starts = [i == 0 or bool(STOP.search(text, places[i - 1][1], places[i][0])) for i in range(len(places))] + [True]
    out: list[tuple[str | None, int, int]] = []
    i = 0
    while i < len(words):
        if not starts[i]:
            i += 1
            continue
        best = _known(words, starts, i, trie)
        if best:
            j = best[1]
        else:
            j = i + 1
            while not starts[j]:
                j += 1
        out.append((best[0] if best else None, places[i][0], places[j - 1][1]))
        i = j
    return out


def find_licenses(text: str) -> list[tuple[str, int, int, int]]:
    """(license, start, end, number of sentences), in order of the text."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    ids = sentence_ids(text)
    out, i = [], 0
    while i < len(ids):
        best = None
        for name, rule in RULES if ids[i][0] else ():
            if rule[0] != ids[i][0] or best and len(rule) <= best[3]:
                continue
            at, last = 1, i
            k = i + 1
            while at < len(rule) and k < len(ids) and k - last <= GAP + 1:
                if ids[k][0] == rule[at]:
                    at, last = at + 1, k
                k += 1
            if at == len(rule):
                best = (name, ids[i][1], ids[last][2], len(rule), last)
        if best:
            out.append(best[:4])
            i = best[4]
        i += 1
    return out


SPANS = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("sentences", pa.int64())]))


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and licenses: array of struct license, start, end, sentences of every whole text (null and empty: none).

    A map over rows: repeated rows and null keys stay, other columns are left out; of rules of one length the first is taken; texts are
    whole however long; an empty table gives no rows."""
    small_batches(df.sparkSession)
    src = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s, e in slices([len(t or "") for t in texts]):
                rows = [[dict(zip(("license", "start", "end", "sentences"), x)) for x in find_licenses(t or "")] for t in texts[s:e]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(rows, SPANS)], names=["k", "licenses"])

    kind = src.schema["k"].dataType.simpleString()
    return src.mapInArrow(run, f"k {kind}, licenses array<struct<license:string,start:long,end:long,sentences:long>>").select(F.col("k").alias(key), "licenses")


def op4_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_licenses, licenses (distinct, sorted, comma-joined), spans (license:start:end, comma-joined) of every document."""
    got = scan_licenses(docs)
    names = F.array_sort(F.array_distinct(F.col("licenses.license")))
    spans = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    return got.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.array_join(spans, ",").alias("spans"))
