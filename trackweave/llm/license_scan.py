"""License scans by conditional compression (operator 8)."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.scratch import small_batches
from trackweave.session import reach_workers

#: Wordings of common notices, by identifier. ``BSD`` is the clauses' common first sentence alone: which, it doesn't say.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD-2-Clause": [
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC0-1.0": [
        "Creative Commons Legal Code CC0 1.0 Universal",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    **{
        f"CC-{kind}-{version}": [f"This work is licensed under a Creative Commons {words} {version} {law} License.", f"Licensed under CC {kind} {version}."]
        for kind, words in {
            "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
            "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
        }.items()
        for version, law in (("3.0", "Unported"), ("4.0", "International"))
    },
}
#: Names that stand for a licence behind one of LEADS, as a heading over a copyright line, or (those with GNU in front) alone.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause"],
    "ISC": ["ISC License", "ISC"],
    "Zlib": ["zlib License", "Zlib"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "CC0-1.0"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "EPL-2.0"],
    **{
        f"{short}-{full}": [form.format(name=name, v=v) for name in (f"GNU {long} General Public License".replace("  ", " "), f"GNU {short}", short) for v in dict.fromkeys((number, full)) for form in ("{name}, version {v}", "{name} v{v}", "{name}v{v}", "{name}-{v}", "{name}-{v}-only", "{name}-{v}-or-later")]
        for short, long, number, full in (("GPL", "", "2", "2.0"), ("GPL", "", "3", "3.0"), ("LGPL", "Lesser", "2.1", "2.1"), ("LGPL", "Lesser", "3", "3.0"), ("AGPL", "Affero", "3", "3.0"))
    },
    **{f"CC-{kind}-{v}": [f"CC {kind} {v}"] for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") for v in ("2.0", "2.5", "3.0", "4.0")},
}
#: Words in front of a name that say it is the licence, and those that do if another licence stands right before them.
LEADS = ("under", "under the", "under a", "under either", "under either of", "under either of the", "either the", "either of the", "terms of", "terms of the", "license", "licence", "licenses", "license is", "license is the", "spdx license identifier")
FURTHER = ("or", "or the", "and", "and the", "with", "or under the")
#: Words right before a notice that turn it round.
NEGATIONS = frozenset("not never no isn aren wasn cannot nor".split())
#: A notice has one of these words; those of two words may be wrapped between them.
CUE = r"(?i)licen[sc]|copyright|permission[^a-z]+is[^a-z]+hereby|is[^a-z]+hereby[^a-z]+granted|redistribut|\b[al]?gplv?\b|public[^a-z]+domain|\bcc[ -]by\b|\bcc0\b"
#: Share of a template's words that must be there in order, and words that make another licence where they differ.
LEAST_WORDS, TELLING = 0.9, frozenset("not lesser library affero noncommercial nc sharealike sa noderivatives noderivs nd".split())

_CUE = re.compile(CUE)
#: A line's end with the next one's comment mark.
_BREAK = re.compile(r"\s*(?:\*/|-->)?\s*\n\s*(?:(?:#|//|/\*|<!--|\*|;|--|%|>|!|\.\.|(?:rem|dnl)\b)[#/*;%>!-]*\s*)*", re.IGNORECASE)
_WORD = re.compile(r"\w+")
#: Numbers and marks of a list's items in front of their usual first words.
_ITEM = re.compile(r"(?:(?<=\s)|^)(?:\(?\d{1,2}[.)]|[*-])\s+(?=(?:Redistributions|Neither|All advertising|The origin|Altered|This notice)\b)")


@dataclass(frozen=True)
class _Template:
    """A licence's wording, its words, how many words may be put in, whether it is a mere name, and a compressor that knows it."""

    license: str
    wording: str
    words: tuple[str, ...]
    more: int
    name: bool
    known: zstandard.ZstdCompressor


@lru_cache(maxsize=1)
def _known() -> list[_Template]:
    out = []
    for table, name in ((TEMPLATES, False), (NAMES, True)):
        for license_, wordings in table.items():
            for w in wordings:
                raw = zstandard.ZstdCompressionDict(w.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words = tuple(x.lower() for x in _WORD.findall(w))
                out.append(_Template(license_, w, words, 0 if name else max(4, len(words) // 2), name, zstandard.ZstdCompressor(level=9, dict_data=raw, write_content_size=False)))
    return out


@lru_cache(maxsize=1)
def _plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=9, write_content_size=False)


@lru_cache(maxsize=1)
def _reach() -> int:
    """Words of the longest window: no notice reaches further from its cue word."""
    return max(len(t.words) + _edits_allowed(t.words, t.more) for t in _known())


def _edits_allowed(words: tuple[str, ...], more: int) -> int:
    return len(words) - _least(words) + more


def _least(words: tuple[str, ...]) -> int:
    return int(np.ceil(LEAST_WORDS * len(words) - 1e-9))


def _distances(words: tuple[str, ...], text: list[str], anchored: bool) -> np.ndarray:
    """Word edits between ``words`` and the cheapest part of ``text`` that ends before each place (or the whole part, anchored)."""
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    at, place = np.array([codes.get(w, -1) for w in text], int), np.arange(len(text) + 1)
    row = place.copy() if anchored else np.zeros(len(text) + 1, int)
    for w in words:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (at != codes[w]))
        row = np.minimum.accumulate(new - place) + place
    return row


def wording_difference(template: str, block: str) -> tuple[float, list[str]]:
    """Share of the template's words that the block has in order, and its exact differences inside the matched part."""
    a, b = _WORD.findall(template), _WORD.findall(block)
    ops = SequenceMatcher(None, [w.lower() for w in a], [w.lower() for w in b], autojunk=False).get_opcodes()
    same = sum(i2 - i1 for tag, i1, i2, _, _ in ops if tag == "equal")
    inner = ops[(1 if ops and ops[0][0] == "insert" else 0) : (-1 if ops and ops[-1][0] == "insert" else None)]
    return same / max(1, len(a)), [f"-{' '.join(a[i1:i2])}+{' '.join(b[j1:j2])}" for tag, i1, i2, j1, j2 in inner if tag != "equal"]


def _same_license(wording: str, block: str) -> str | None:
    """The exact differences of a window's wording, if they leave it the template's licence."""
    share, differs = wording_difference(wording, block)
    changed = {w.lower() for d in differs for w in _WORD.findall(d)}
    # numbers are a licence's version, and some words its kind: a block that changes one is another licence
    if share < LEAST_WORDS or changed & TELLING or any(re.search(r"\d", w) for w in changed):
        return None
    return "; ".join(differs)


def _windows(t: _Template, words: list[str], held: set[str]) -> list[tuple[int, int]]:
    """Where few enough changed words make a template's wording, the least changed first; none overlap."""
    if sum(n for w, n in Counter(t.words).items() if w not in held) > len(t.words) - _least(t.words):
        return []
    if t.name:
        return [(i, i + len(t.words)) for i, w in enumerate(words) if w == t.words[0] and tuple(words[i : i + len(t.words)]) == t.words]
    most, cost = _edits_allowed(t.words, t.more), _distances(t.words, words, False)
    low = (cost[1:] <= most) & (cost[1:] <= cost[:-1]) & (cost[1:] <= np.append(cost[2:], len(t.words) + 1))
    out: list[tuple[int, int]] = []
    for end in sorted((np.flatnonzero(low) + 1).tolist(), key=lambda j: (cost[j], j)):
        if any(x < end < y + _least(t.words) for x, y in out):
            continue
        start = end - int(_distances(t.words[::-1], words[max(0, end - len(t.words) - most) : end][::-1], True).argmin())
        if start < end and all(end <= x or y <= start for x, y in out):
            out.append((start, end))
    return out


def _ends_with(words: list[str], end: int, leads: tuple[str, ...]) -> bool:
    return any(words[max(0, end - len(x)) : end] == x for lead in leads for x in [lead.split()])


class _Region:
    """Words around cue words, and the text that they stand in."""

    def __init__(self, text: str, spans: list[tuple[int, int]], lo: int, hi: int):
        self.text, self.spans, self.lo = text, spans, lo
        self.words = [text[x:y].lower() for x, y in spans[lo:hi]]

    def block(self, start: int, end: int) -> str:
        """The window's text on one line, without comment marks and the numbers of a list."""
        return _ITEM.sub("", _BREAK.sub(" ", self.text[self.spans[self.lo + start][0] : self.spans[self.lo + end - 1][1]]))

    def heading(self, start: int, end: int) -> bool:
        """Whether the window is a line of its own with a copyright line soon behind it."""
        x, y = self.spans[self.lo + start][0], self.spans[self.lo + end - 1][1]
        line = self.text[self.text.rfind("\n", 0, x) + 1 : x]
        rest, _, behind = self.text[y : y + 300].partition("\n")
        alone = all(w.lower() in ("the", "rem", "dnl") for w in _WORD.findall(line)) and all(w.lower() in ("license", "licence", "mit") for w in _WORD.findall(rest))
        return alone and any(re.match(r"\W*(?:copyright|\(c\))", x, re.IGNORECASE) for x in behind.split("\n")[:4])

    def named(self, t: _Template, start: int, end: int) -> bool:
        """Whether a mere name is said to be the licence."""
        return t.words[0] == "gnu" or _ends_with(self.words, start, LEADS) or self.heading(start, end)

    def negated(self, t: _Template, start: int) -> bool:
        """Whether the words in front turn the notice round; a name's lead stands between."""
        return bool(NEGATIONS & set(self.words[max(0, start - (5 if t.name else 3)) : start]))


def notices(text: str) -> tuple[int, list[tuple[int, str, float, str]]]:
    """Number of candidate blocks, and line, license, size reduction and differences of each notice in a text."""
    cues = [m.start() for m in _CUE.finditer(text)]
    if not cues:
        return 0, []
    spans = [m.span() for m in _WORD.finditer(text)]
    starts = np.array([x for x, _ in spans])
    breaks = np.array([m.start() for m in re.finditer("\n", text)], int)
    lines = np.unique(np.searchsorted(breaks, cues))
    n_blocks = int(1 + (np.diff(lines) > 1).sum())
    reach, regions = _reach(), []
    for i in np.maximum(np.searchsorted(starts, cues, "right") - 1, 0).tolist():
        lo, hi = max(0, i - reach), min(len(spans), i + reach + 1)
        if regions and lo <= regions[-1][1]:
            regions[-1][1] = hi
        else:
            regions.append([lo, hi])
    out = [(lo + start, *rest) for lo, hi in regions for start, *rest in _winners(_Region(text, spans, lo, hi))]
    out.sort(key=lambda o: (o[0], o[1]))
    return n_blocks, [(int(np.searchsorted(breaks, starts[x])), name, gain, differs) for x, name, gain, differs in out]


def _winners(r: _Region) -> list[tuple[int, str, float, str]]:
    """First word, license, size reduction and differences of a region's notices.

    Windows in which a template's words are found make the candidate blocks, joined where they overlap. Each
    block is compressed with every template as dictionary; in the order of their size reductions, templates
    whose exact wording is there take their words, and what overlaps those is no further notice.
    """
    held, known = set(r.words), _known()
    windows = {i: found for i, t in enumerate(known) if (found := _windows(t, r.words, held))}
    blocks: list[list[int]] = []
    for start, end in sorted(w for found in windows.values() for w in found):
        if blocks and start < blocks[-1][1]:
            blocks[-1][1] = max(blocks[-1][1], end)
        else:
            blocks.append([start, end])
    taken: list[tuple[int, int, str, float, str]] = []
    waiting: list[tuple[int, int, str, float]] = []
    for b0, b1 in blocks:
        raw = r.block(b0, b1).encode()
        plain = len(_plain().compress(raw))
        order = sorted(((plain - len(t.known.compress(raw)), len(t.words), -i) for i, t in enumerate(known)), reverse=True)
        for saved, _, minus in order:
            t, gain = known[-minus], saved / plain
            for start, end in windows.get(-minus, ()):
                if not (b0 <= start and end <= b1) or any(start < y and x < end for x, y, *_ in taken) or r.negated(t, start):
                    continue
                differs = _same_license(t.wording, r.block(start, end))
                if differs is None:
                    continue
                if not t.name or r.named(t, start, end):
                    taken.append((start, end, t.license, gain, differs))
                else:
                    waiting.append((start, end, t.license, gain))
    # a name behind "or" and the like is a licence if one stands right before it
    for start, end, name, gain in sorted(waiting, key=lambda x: (x[0], -x[1])):
        lead = next((len(x) for f in FURTHER for x in [f.split()] if r.words[max(0, start - len(x)) : start] == x and any(0 <= start - len(x) - y <= 2 for _, y, *_ in taken)), None)
        if lead is not None and all(end <= x or y <= start for x, y, *_ in taken):
            taken.append((start, end, name, gain, ""))
    return [(start, name, gain, differs) for start, _, name, gain, differs in taken]


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find licence notices; one row for each input row: the id, ``n_blocks``, ``licenses``, ``findings``.

    Words near a cue word are candidates, over line ends and comment marks alike. Windows with few
    enough changed words of a template make the candidate blocks. Each block is compressed with every
    template as a raw dictionary; templates are ranked by the bytes that saves, and confirmed in that
    order if the exact differences in wording leave it the same licence. Notices behind a negation are
    none. The sentence that all BSD licences share is reported as ``BSD`` where no clauses follow. ``findings``: first line, license, reduction and differences of each
    confirmed notice; ``licenses``: their sorted identifiers, comma-joined.

    Defined cases: a null text has no blocks; ``n_blocks`` counts the runs of consecutive lines
    that hold a cue word, confirmed or not; repeated rows each get a row; an empty table gives
    none; other columns are ignored.
    """
    reach_workers(docs.sparkSession)
    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<n_blocks:bigint,findings:array<struct<line:int,license:string,reduction:double,differences:string>>>")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = [(0, []) if t is None else notices(t) for t in texts]
        each = [[{"line": line, "license": name, "reduction": round(gain, 6), "differences": differs} for line, name, gain, differs in got] for _, got in rows]
        return pd.DataFrame({"n_blocks": [n for n, _ in rows], "findings": each})

    text = F.col(text_col)
    rows = docs.select(F.col(id_col), found(F.when(text.rlike(CUE), text)).alias("x"))
    rows = rows.select(id_col, "x.n_blocks", "x.findings")
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda x: x["license"]))), ",")
    return rows.select(id_col, "n_blocks", names.alias("licenses"), "findings")
