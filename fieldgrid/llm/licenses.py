"""License scan by conditional compression.

A text's candidate blocks are its license cues with all words around them that
the longest wording could take, so wordings wrapped over lines or set in comments
stay whole. A block is compressed with zstandard, once alone and once with each
template as raw dictionary, and the templates are ranked by the bytes they save. The
rank is the order in which they are confirmed and settles ties; it rules none out, for
a short wording beside a longer one may save nothing ("All rights reserved." beside
a license line costs a byte). Confirmation is by exact wording differences: a template is aligned with the block's words, and the words that are
missing or put in between decide. A wording is confirmed if at most a set share of
the template's words differs and none of those that tell licenses apart (version
numbers, lesser, affero and so on); ``exact`` means none. A block may hold any
number of wordings; where some match the same words, the one that matches most
words and differs least wins. The saving of the confirmed words is reported.

SPDX tags name licenses by identifier and are read as they stand.

Texts without a cue are told apart by one pattern in the scan and never leave
the JVM. Nothing is shuffled. Defined cases: null and empty texts have no
blocks; wordings of several licenses that win equally all stay; repeated rows and
null ids are scanned row by row; empty tables give empty results; long texts are
read whole and cost their candidate blocks only.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_2 = BSD + ": Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_3 = BSD_2 + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: Wordings that count as a license statement, by identifier; "BSD" is the sentence that its forms share. Fixed values.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004"],
    "BSD": [BSD],
    "BSD-2-Clause": [BSD_2],
    "BSD-3-Clause": [BSD_3],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
}
#: The GNU licenses' names, versions, and what their notices call the work. Fixed values.
GNU = {
    "AGPL-3.0": ("GNU Affero General Public License", "3", "program", "19 November 2007"),
    "GPL-2.0": ("GNU General Public License", "2", "program", "June 1991"),
    "GPL-3.0": ("GNU General Public License", "3", "program", "29 June 2007"),
    "LGPL-2.1": ("GNU Lesser General Public License", "2.1", "library", "February 1999"),
    "LGPL-3.0": ("GNU Lesser General Public License", "3", "library", "29 June 2007"),
}
for _key, (_name, _version, _work, _date) in GNU.items():
    TEMPLATES[_key] = [f"{verb} under the {_name}, version {_version}." for verb in ("Licensed", "Distributed", "This work is licensed")]
    TEMPLATES[_key] += [f"This {_work} is free software: you can redistribute it and/or modify it under the terms of the {_name} as published by the Free Software Foundation, either version {_version} of the License"]
    TEMPLATES[_key] += [f"This {_work} is free software; you can redistribute it and/or modify it under the terms of the {_name} version {_version}", f"{_name} Version {_version}, {_date}"]
#: Creative Commons terms. Fixed values.
for _code, _terms in {"BY": "Attribution", "BY-NC": "Attribution-NonCommercial", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-SA": "Attribution-ShareAlike"}.items():
    TEMPLATES[f"CC-{_code}-4.0"] = [f"Licensed under CC {_code} 4.0.", f"This work is licensed under a Creative Commons {_terms} 4.0 International License."]
#: Words that tell licenses apart, besides those with a digit. Fixed values.
TELLING = {"affero", "lesser", "nc", "nd", "sa", "noncommercial", "noderivatives", "sharealike"}
#: Between the words of a cue stands anything that is no word: a line may end there, and a comment mark follow.
CUE = r"(?i)licen[sc]e|copyright|all rights reserved|redistribution and use|hereby granted|permission is granted|creative commons|public domain|\bSPDX-|waived all".replace(" ", "[^0-9A-Za-z]+")
_TAG = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()\- \t]+)")
_CUE = re.compile(CUE)
_WORD = re.compile(r"[0-9a-z]+(?:\.[0-9a-z]+)*")
_PLACE = re.compile(r"[0-9A-Za-z]+(?:\.[0-9A-Za-z]+)*")
MAX_DIFFERENCE = 0.2


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def telling(words: list[str]) -> list[str]:
    return [w for w in words if w in TELLING or w[0].isdigit()]


def tags_of(text: str) -> list[str]:
    """The identifiers of SPDX tags, in order; exceptions after WITH aren't licenses."""
    out = []
    for m in _TAG.finditer(text):
        words = re.sub(r"[()]", " ", m[1]).split()
        for before, word in zip(["", *words], words, strict=False):
            if before in ("", "AND", "OR") and re.search("[A-Za-z]", word):
                out.append(word)
            elif word not in ("AND", "OR", "WITH") and before != "WITH":
                break  # the expression is over
    return out


#: A wording that holds a cue lies within so many words of it on either side.
REACH = max(len(words_of(t)) + int(MAX_DIFFERENCE * len(words_of(t))) for ts in TEMPLATES.values() for t in ts)


def blocks_of(text: str) -> list[str]:
    """The cues with all words in reach of them, whatever the lines; what overlaps is one block."""
    cues, spans = [m.span() for m in _CUE.finditer(text)], []
    words = [m.span() for m in _PLACE.finditer(text)] if cues else []
    for start, end in cues:
        first = max(bisect_right(words, start, key=lambda w: w[1]) - REACH, 0)
        last = min(bisect_left(words, end, key=lambda w: w[0]) + REACH, len(words))
        if spans and first <= spans[-1][1]:
            spans[-1][1] = last
        else:
            spans.append([first, last])
    return [text[words[first][0] : words[last - 1][1]] for first, last in spans]


class Scanner:
    """The templates' dictionaries, made once per worker."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, level: int = 3):
        import zstandard as z

        params = z.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.plain = z.ZstdCompressor(compression_params=params)
        dictionary = lambda t: z.ZstdCompressionDict(t.encode() * (1 + 16 // len(t)), dict_type=z.DICT_TYPE_RAWCONTENT)
        self.templates = [(name, i, t, words_of(t), z.ZstdCompressor(compression_params=params, dict_data=dictionary(" ".join(words_of(t))))) for name, ts in templates.items() for i, t in enumerate(ts)]

    def saving(self, wording: str, template: int) -> float:
        """Share of the wording's bytes that the template as dictionary saves."""
        raw = wording.encode()
        return 1 - len(self.templates[template][4].compress(raw)) / len(self.plain.compress(raw))

    @staticmethod
    def alignments(template: list[str], block: list[str], counts: Counter) -> list[tuple[int, frozenset[int]]]:
        """(differing words, places of the matched words) of the template's confirmed alignments, the best of each first word.
        Words of the template that are missing and foreign words between its first and last match count, the more of the two;
        telling words must be the same."""
        told = Counter(telling(template))
        n, most, need = len(template), int(MAX_DIFFERENCE * len(template)), Counter(template)
        if sum(min(k, counts[w]) for w, k in need.items()) < n - most:
            return []
        out, heads = [], set(template[: most + 1])  # no more words than that may be missing in front
        for start in (i for i, w in enumerate(block) if w in heads):
            window = block[start : start + n + most]
            if sum((need & Counter(window)).values()) < n - most:
                continue
            rows, best = [[0] * (n + 1)], None  # longest common subsequences of window and template
            for size, word in enumerate(window, 1):
                before, row = rows[-1], [0] * (n + 1)
                for j, t in enumerate(template):
                    row[j + 1] = before[j] + 1 if t == word else max(before[j + 1], row[j])
                rows.append(row)
                if row[n] > before[n] and (cost := max(n, size) - row[n]) <= most and (best is None or cost < best[0]):
                    best = (cost, size)
            if best:
                places, i, j = [], best[1], n
                while i and j:
                    if rows[i][j] == rows[i - 1][j]:
                        i -= 1
                    elif rows[i][j] == rows[i][j - 1]:
                        j -= 1
                    else:
                        i, j = i - 1, j - 1
                        places.append(start + i)
                found = [w for w in telling(block[min(places) : max(places) + 1]) if w in TELLING or any(k not in TELLING for k in told)]
                if not told - Counter(block[p] for p in places) and not Counter(found) - told:
                    out.append((best[0], frozenset(places)))
        return out

    def ranked(self, wording: str) -> list[int]:
        """The templates by the size of the wording with each as dictionary, least first."""
        raw = wording.encode()
        return [i for _, i in sorted((len(t[4].compress(raw)), i) for i, t in enumerate(self.templates))]

    def identify(self, block: str) -> list[tuple[str, float, int]]:
        """(license, saving, differing words) of every confirmed wording. Among wordings that match the same words
        of the block the one with most matched words wins, where a difference counts against four of them; equal ones of
        several licenses all stay."""
        words = words_of(block)
        counts, kept, owners = Counter(words), [], {}
        found = [(4 * n - len(places), n, rank, min(places), i, places) for rank, i in enumerate(self.ranked(" ".join(words))) for n, places in self.alignments(self.templates[i][3], words, counts)]
        for score, n, _, start, i, places in sorted(found, key=lambda x: x[:4]):
            name = self.templates[i][0]
            if any(k == name or best < score for p in places for k, best in owners.get(p, ())):
                continue
            kept.append((name, self.saving(" ".join(words[start : max(places) + 1]), i), n))
            for p in places:
                owners.setdefault(p, []).append((name, score))
        return sorted(kept)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_blocks, licenses (sorted names of wordings and tags), n_exact (wordings matched in full), n_differences
    (words), best_saving, n_tags (identifiers in SPDX tags)."""
    out = "n_tags long, n_blocks long, licenses array<string>, n_exact long, n_differences long, best_saving double"

    @F.pandas_udf(out)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for texts in batches:
            rows = []
            for text in texts:
                blocks = blocks_of(text) if text else []
                hits = [h for b in blocks for h in scanner.identify(b)]
                tags = tags_of(text) if text else []
                rows.append((len(tags), len(blocks), sorted({h[0] for h in hits} | set(tags)), sum(h[2] == 0 for h in hits), sum(h[2] for h in hits), max((round(h[1], 6) for h in hits), default=0.0)))
            yield pd.DataFrame(rows, columns=["n_tags", "n_blocks", "licenses", "n_exact", "n_differences", "best_saving"])

    text = F.col("text").cast("string")
    return docs.select("doc_id", find(F.when(text.rlike(CUE), text)).alias("f")).select("doc_id", "f.*")
