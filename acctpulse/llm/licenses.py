"""License scans by conditional compression.

Blocks of a text that mention what licenses mention are compressed on their own
and with each template as raw dictionary of the compressor. The bytes that a
template saves rank it; the best are compared word by word, and one is confirmed
if enough of its wording stands in the block and no word that tells licenses
apart (names, versions, conditions) differs. The differences are reported.

One map over the rows; the templates are a parameter of fixed size. Whole texts
are searched: a long line is cut around each mention, so that no block grows with
the text.

Defined results: a null or empty text has no blocks; each mention of a license
counts, a repeated line every time; rows that repeat are scanned one by one.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Mapping, Sequence
from functools import lru_cache

import zstandard
from pyspark.sql import DataFrame

from acctpulse.llm.batches import map_texts

#: Customary notices of public licenses.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0."],
}
#: Words that tell licenses apart, besides any word with a digit.
TELLING = set("mit apache gnu lesser affero bsd mozilla cc by sa nc nd attribution sharealike noncommercial noderivatives clause".split())
MENTION = re.compile(r"licen[cs]|permission is hereby|redistribut|public domain|creative commons|copyleft", re.I)
#: Characters on either side of a mention, in lines longer than both.
AROUND = 400
#: Share of a template's words that must stand in the block.
WORDING = 0.8

_WORD = re.compile(r"[a-z]+|\d+(?:\.\d+)*")


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans of lines that mention a license; of long lines, the surroundings of each mention."""
    out: list[tuple[int, int]] = []
    for m in MENTION.finditer(text):
        lo = max(text.rfind("\n", 0, m.start()) + 1, m.start() - AROUND)
        end = text.find("\n", m.end())
        hi = min(len(text) if end < 0 else end, m.end() + AROUND)
        if out and lo < out[-1][1]:
            lo = out.pop()[0] if hi - out[-1][0] <= 2 * AROUND + len(m[0]) else lo
        out.append((lo, hi))
    return out


class Scanner:
    """Compressors of all templates, built once per task."""

    def __init__(self, templates: Mapping[str, Sequence[str]]):
        self.plain = zstandard.ZstdCompressor(level=6, write_content_size=False)
        self.templates = []
        for name, texts in templates.items():
            for t in texts:
                raw = zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                with_it = zstandard.ZstdCompressor(level=6, dict_data=raw, write_content_size=False)
                self.templates.append((name, _WORD.findall(t.lower()), with_it, len(self.plain.compress(t.encode()))))
        self.judge = lru_cache(4096)(self._judge)  # notices repeat

    def _judge(self, block: str) -> tuple[tuple[str, str], ...]:
        """Confirmed (license, differences) of a block, one per license; best first."""
        data = block.encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(data))
        ranked = []
        for name, words, with_it, own in self.templates:
            saved = alone - len(with_it.compress(data))
            if saved * 4 >= own:
                ranked.append((saved, name, words))
        ranked.sort(key=lambda x: (-x[0], x[1]))
        words = _WORD.findall(block.lower())
        out: list[tuple[str, str]] = []
        used: set[int] = set()
        for _, name, template in ranked:
            if any(n == name for n, _ in out):
                continue
            match = difflib.SequenceMatcher(None, template, words, autojunk=False)
            same = [m for m in match.get_matching_blocks() if m.size]
            if sum(m.size for m in same) < WORDING * len(template):
                continue
            lo, hi = same[0].b, same[-1].b + same[-1].size
            where = set(range(lo, hi))
            aligned = difflib.SequenceMatcher(None, template, words[lo:hi], autojunk=False)
            differ, telling = [], False
            for tag, a, b, c, d in aligned.get_opcodes():
                if tag != "equal":
                    gone, new = template[a:b], words[lo + c : lo + d]
                    telling |= any(w in TELLING or w[0].isdigit() for w in [*gone, *new])
                    differ.append(f"-{' '.join(gone)} +{' '.join(new)}".strip())
            if telling or hi - lo > len(template) / WORDING or where & used:
                continue
            used |= where
            out.append((name, "; ".join(differ)))
        return tuple(out)

    def __call__(self, texts: list[str]) -> list[list]:
        out: list[list] = [[] for _ in range(4)]
        for t in texts:
            spans = blocks(t)
            found = [(n, a, b, d) for a, b in spans for n, d in self.judge(t[a:b])]
            out[0].append(len(spans))
            out[1].append(",".join(sorted({n for n, *_ in found})))
            out[2].append(",".join(f"{n}:{a}:{b}" for n, a, b, _ in found))
            out[3].append(" | ".join(f"{n}: {d}" for n, _, _, d in found if d))
        return out


def scan_rows(
    docs: DataFrame, keep: list[str] | None = None, text: str = "text", templates: Mapping[str, Sequence[str]] = TEMPLATES
) -> DataFrame:
    """``keep`` (all, if not given) with li_blocks, li_names, li_found (name:start:end of the block) and li_differences."""
    fields = "li_blocks long, li_names string, li_found string, li_differences string"
    return map_texts(docs, docs.columns if keep is None else keep, fields, lambda: Scanner(templates), text)
