"""License statements by conditional compression.

A candidate block is the words around a cue word, as far on either side as the
longest template reaches, over the ends of lines; overlapping blocks are one.
What a template's statement can reach of it, from a cue on, is compressed alone
and with that template as zstandard raw dictionary. The bytes saved rank the templates; those that save at least ``MIN_REDUCTION`` of what their
template takes by itself are the winners. They are confirmed by exact wording differences: a place in the block where at most
``MAX_CHANGED`` of a winner's words differ is a statement, unless another
winner's place overlaps it and differs less, or as little and ranks before.

Defined results: null and empty texts have no finding; very long texts are
scanned whole; each statement counts once, with the number of the line that it
begins on, as many as a line or text has; templates that save the same rank by
name, then as listed; of a template's overlapping places with equal changes the
first stays. Findings are in the order of the text.
Repeated rows have equal findings; empty tables give empty ones; other columns
stay, but one called like the result is replaced.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenorlake.llm.common import col, without

# Customary wordings of license statements, by SPDX identifier.
TEMPLATES = {
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",),
}
# Words that a license statement has at least one of.
CUES = re.compile(r"licen[sc]e|copyright|implied[\W_]+warranty|permission[\W_]+is[\W_]+hereby|redistribut|public[\W_]+domain|spdx", re.IGNORECASE)
_word = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")

MIN_REDUCTION = 0.25  # share of the template's own compressed size that it must save as a dictionary; altered statements within MAX_CHANGED saved 0.36 or more in 3,347 trials
LEVEL = -1  # literals stay as they are, so what is saved is what the dictionary says, not a better code for the rest
MAX_CHANGED = 0.15  # share of the template's words that may differ


def wordings() -> list[tuple[str, str]]:
    """(license, text) of all templates: the statements, and the identifier line of each license."""
    out = []
    for name in sorted(TEMPLATES):
        tags = [name, f"{name}-only", f"{name}-or-later"] if "GPL" in name else [name]
        out += [(name, text) for text in (*TEMPLATES[name], *(f"SPDX-License-Identifier: {t}" for t in tags))]
    return out


def words(s: str) -> list[str]:
    return _word.findall(s.lower())


def changed(template: list[str], block: list[str]) -> tuple[float, list[str]]:
    """Share of template words missing or replaced in the best place of ``block``, and the differences."""
    ops = difflib.SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    edits = [(op, template[a:b], block[c:d]) for op, a, b, c, d in ops if op != "equal"]
    inner = edits[1:] if edits and edits[0][0] == "insert" and ops[0][0] == "insert" else edits
    inner = inner[:-1] if inner and ops[-1][0] == "insert" else inner
    lost = sum(max(len(t), len(b)) for _, t, b in inner)
    return lost / max(len(template), 1), [f"-{' '.join(t)}" * bool(t) + f"+{' '.join(b)}" * bool(b) for _, t, b in inner]


@lru_cache(1)
def _compressors() -> tuple[zstandard.ZstdCompressor, list[tuple[str, list[str], zstandard.ZstdCompressor, int]]]:
    """One without a dictionary; and of each template the license, its words, a compressor and the size that it takes alone."""
    plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    made = []
    for name, text in wordings():
        raw = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.append((name, words(text), zstandard.ZstdCompressor(dict_data=raw, level=LEVEL, write_content_size=False, write_dict_id=False), len(plain.compress(text.lower().encode()))))
    return plain, made


_version = re.compile(r"[0-9]")
_blank = re.compile(r"\s+")


def _ends(template: list[str], ws: list[str], anywhere: bool = True) -> np.ndarray:
    """For each end in ``ws`` the fewest words to change so that the template ends there; it begins anywhere, or with the first word."""
    place = np.arange(len(ws) + 1)
    cost = np.zeros(len(ws) + 1, np.int64) if anywhere else place
    at = np.array(ws, object)
    for w in template:
        new = cost + 1
        new[1:] = np.minimum(new[1:], cost[:-1] + (at != w))
        cost = np.minimum.accumulate(new - place) + place
    return cost


@lru_cache(1 << 14)
def _saved(raw: bytes, reach: int) -> tuple[tuple[int, int], ...]:
    """(bytes, template) that the dictionaries of the templates with that reach save of one window."""
    plain, made = _compressors()
    alone = len(plain.compress(raw))
    return tuple((alone - len(z.compress(raw)), i) for i, (_, ws, z, _) in enumerate(made) if _reach(ws) == reach)


def _reach(template: list[str]) -> int:
    """Words that its statement has at most."""
    return int(len(template) * (1 + MAX_CHANGED)) + 1


def ranked(block: str, spans: list[tuple[int, int]]) -> list[tuple[float, int]]:
    """(reduction, template) of the templates whose dictionaries save enough, those that save the most bytes first; reduction is the share of the template's own size.

    A template compresses the words around a cue that its statement can reach, its best cue counts: in a longer text a short statement saves too little to be told from chance.
    """
    _, made = _compressors()
    starts, best = [a for a, _ in spans], {}
    for cue in CUES.finditer(block):
        first, last = bisect_right(starts, cue.start()) - 1, bisect_right(starts, cue.end() - 1)
        for reach in {_reach(ws) for _, ws, _, _ in made}:
            a, b = max(0, first - reach), min(len(spans), last + reach)
            for less, i in _saved(_blank.sub(" ", block[spans[a][0] : spans[b - 1][1]]).encode(), reach):
                best[i] = max(less, best.get(i, 0))
    return [(less / made[i][3], i) for less, i in sorted(((n, i) for i, n in best.items()), key=lambda x: (-x[0], x[1])) if less >= MIN_REDUCTION * made[i][3]]


def _places(template: list[str], ws: list[str]) -> list[tuple[int, int, int]]:
    """(changed words, first word, end) of the places in ``ws`` that say what the template says, but for the words that may differ."""
    most = int(MAX_CHANGED * len(template) + 1e-9)
    there = set(ws)
    if sum(w in there for w in template) < len(template) - most:
        return []  # more words are missing from the block than may change
    cost, out = _ends(template, ws), []
    for end in np.flatnonzero(cost <= most).tolist():
        low = max(0, end - len(template) - most)
        back = _ends(template[::-1], ws[low:end][::-1], False)
        start = end - int(np.argmin(back))
        named = {w for w in template if _version.search(w)} <= set(ws[start:end])  # versions and clause numbers are part of the name
        if named and start < end:
            out.append((int(cost[end]), start, end))
    return out


@lru_cache(4096)
def judge(block: str) -> tuple[tuple[int, str, float, str], ...]:
    """(first word, license, reduction, differences) of each confirmed statement in one block of lower-cased text, in order."""
    _, made = _compressors()
    spans = [m.span() for m in _word.finditer(block)]
    ws = [block[a:b] for a, b in spans]
    places = [(cost / len(made[i][1]), rank, start, end, i, gain) for rank, (gain, i) in enumerate(ranked(block, spans)) for cost, start, end in _places(made[i][1], ws)]
    taken: list[tuple[int, int, int, float]] = []
    for _, _, start, end, i, gain in sorted(places):
        if all(end <= a or start >= b for a, b, *_ in taken):
            taken.append((start, end, i, gain))
    return tuple((start, made[i][0], round(gain, 6), "; ".join(changed(made[i][1], ws[start:end])[1])) for start, end, i, gain in sorted(taken))


FOUND = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("block", T.IntegerType()), T.StructField("reduction", T.DoubleType()), T.StructField("differences", T.StringType())]))
_FOUND_ARROW = pa.list_(pa.struct([("license", pa.string()), ("block", pa.int32()), ("reduction", pa.float64()), ("differences", pa.string())]))


REACH = max(_reach(words(t)) for _, t in wordings())


def scan(text: str | None) -> list[dict]:
    if not text or not CUES.search(text):
        return []
    text = text.lower()
    spans = [m.span() for m in _word.finditer(text)]
    starts = [a for a, _ in spans]
    reach, blocks = REACH, []
    for cue in CUES.finditer(text):
        lo = max(0, bisect_right(starts, cue.start()) - 1 - reach)
        hi = min(len(spans), bisect_right(starts, cue.end()) + reach)
        if blocks and lo <= blocks[-1][1]:
            blocks[-1][1] = hi
        else:
            blocks.append([lo, hi])
    out, line, at = [], 0, 0
    for lo, hi in blocks:
        for first, name, gain, edits in judge(text[spans[lo][0] : spans[hi - 1][1]]):
            here = starts[lo + first]
            line, at = line + text.count("\n", at, here), here
            out.append({"license": name, "block": line, "reduction": gain, "differences": edits})
    return out


def find(df: DataFrame, text: str = "text", licenses: str = "licenses") -> DataFrame:
    """``df`` with an array of (license, block, reduction, differences); a column of that name is replaced."""
    keep = without(df, licenses)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(licenses, FOUND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [scan(t) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(cells, _FOUND_ARROW)], names=[*keep, licenses])

    return df.select(*(col(c) for c in keep)).mapInArrow(run, schema)


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_licenses (statements), licenses (names, sorted and comma-joined) and details (license:line pairs)."""
    found = find(docs.select(col(key).alias(key), col(text).alias("__text")), "__text")
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"]))), ",")
    details = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["block"])), ",")
    return found.select(col(key), F.size("licenses").cast("long").alias("n_licenses"), names.alias("licenses"), details.alias("details"))
