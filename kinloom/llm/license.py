"""License scans by conditional compression (operator 4).

Lines are joined to paragraphs without their comment marks, so a notice may be wrapped as it likes. Candidate blocks are
the sentences that speak of rights, and windows of a few sizes over them, overlapping. Each block is compressed by
Zstandard alone and with every template as a raw dictionary: the more of a template's wording it has, the more bytes that
saves. Templates are ranked by what they save; those that save enough, beside the best, are winners. A winner is confirmed
by its exact wording differences, word by word, which also tell where the notice stands. Of confirmed notices that overlap
the one whose template saves most of its bytes counts; all that don't overlap count.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: notices by which public licenses are declared, by SPDX identifier. Several wordings may share one.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", "Distributed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Use, modification and distribution are subject to the Boost Software License, Version 1.0."),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2."),
    ("EUPL-1.2", "Licensed under the European Union Public Licence, version 1.2."),
    ("GPL-2.0", "License: GPLv2"),
    ("GPL-3.0", "License: GPLv3"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("proprietary", "All rights reserved."),
]
#: Fixed: identifiers of one version of the GNU licenses and of those after it.
VERSIONED = [f"{name}-{which}" for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for which in ("only", "or-later")]
#: The tag by which a file names its license, one for each license that has an identifier.
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys([*(n for n, _ in TEMPLATES if n != "proprietary"), *VERSIONED])]
#: What may stand between two words of a wrapped comment.
_GAP = r"(?:[\W_]|\b(?:rem|dnl)\b)+"
#: A window is looked at if it has one of these.
TRIGGER = "(?i)licen[sc]e|copyright|" + "|".join(x.replace(" ", _GAP) for x in ("all rights reserved", "public domain", "permission is hereby", "redistribution and use", "free software"))
#: A winner saves so many bytes of a block at least, and such a share of what the best template saves.
LEAST_BYTES, BESIDE_BEST = 6, 0.4
#: The least share of its bytes that a template must save of a notice with differences, and of its words that it must have in order.
LEAST_SAVED, LEAST_WORDS = 0.2, 0.8
#: Words of a window, each with half as many more: the least that is no less than a template's is the one that finds it.
SIZES = (12, 32, 96)
_TRIGGER, _WORD = re.compile(TRIGGER), re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: Words of these kinds tell licenses apart, so none may differ.
_TELLING = re.compile(r"\d|^(?:nc|nd|sa|by-.*|lesser|affero|mit|isc|unlicense|bsd|apache|mozilla|eclipse|boost|eupl|european)$")
#: Words that may lead in several licenses of one sentence: "Licensed under the MIT License or the Apache License, Version 2.0".
_LEADS = {"this", "work", "is", "licensed", "released", "distributed", "under", "the", "spdx-license-identifier"}
_MARKS = re.compile(r"^\s*(?:(?://+|/\*+|\*+/?|#+|--+|;+|%+|<!--+|\(\*|\"\"\"|'''|(?i:rem|dnl)\b)\s*)*|\s*(?:\*+/|--+>|\*\)|\"\"\"|'''|[*#])?\s*$")
#: A notice doesn't go over a sentence's end. "v. 2.0" is none.
_SENTENCE = re.compile(r"(?<=[.!?])(?<!\bv\.)(?<!\bV\.)\s+(?=[^\sa-z\d])")


@lru_cache(1)
def _compressors() -> list[zstandard.ZstdCompressor]:
    kinds = [None] + [zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, t in TEMPLATES]
    return [zstandard.ZstdCompressor(level=3, dict_data=k, write_content_size=False, write_dict_id=False) if k else zstandard.ZstdCompressor(level=3, write_content_size=False) for k in kinds]


@lru_cache(1)
def _template_words() -> list[list[str]]:
    return [_WORD.findall(t.lower()) for _, t in TEMPLATES]


def differences(block: list[str], template: list[str]) -> tuple[float, list[str], list[str], list[int]]:
    """(share of the template's words that the block has in order, template words it lacks, words it puts between, places of those it has)."""
    ops = SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    inner = [k for k, o in enumerate(ops) if o[0] == "equal"]
    lacks = [w for o in ops if o[0] in ("delete", "replace") for w in template[o[1] : o[2]]]
    puts = [w for k, o in enumerate(ops) if o[0] in ("insert", "replace") and inner and inner[0] < k < inner[-1] for w in block[o[3] : o[4]]]
    return 1 - len(lacks) / max(len(template), 1), lacks, puts, [i for k in inner for i in range(ops[k][3], ops[k][4])]


@lru_cache(1)
def _telling() -> list[set[str]]:
    return [{w for w in t if _TELLING.search(w)} for t in _template_words()]


def _saved(block: str, k: int) -> tuple[int, float]:
    """How many of the block's bytes template ``k`` saves, and which share of them."""
    raw, all_ = block.encode(), _compressors()
    alone = len(all_[0].compress(raw))
    saved = alone - len(all_[k + 1].compress(raw))
    return saved, saved / alone


def winners(block: str) -> tuple[int, ...]:
    """The templates that save enough of a block, those that save most first. Copies of a short block are ranked once."""
    return _remembered(block) if len(block) <= 1000 else _ranked(block)


def _ranked(block: str) -> tuple[int, ...]:
    raw, (alone, *given) = block.encode(), _compressors()
    size = len(alone.compress(raw))
    ranked = sorted((len(c.compress(raw)) - size, k) for k, c in enumerate(given))
    least = max(LEAST_BYTES, -ranked[0][0] * BESIDE_BEST)
    return tuple(k for more, k in ranked if -more >= least)


_remembered = lru_cache(4096)(_ranked)


def _windows(first: int, last: int, size: int, triggers: list[int]) -> set[tuple[int, int]]:
    """[from, to) of the overlapping windows of 1.5 times ``size`` over the words from ``first`` to ``last`` that have a trigger."""
    step, length = max(1, size // 4), size + size // 2
    return {(max(first, s), min(last, s + length)) for t in triggers for s in range((t - length) // step * step + step, t + 1, step)}


def _paragraphs(text: str) -> Iterator[tuple[str, list[int], list[int]]]:
    """(text, start of each line in it, number of each line) of the runs of lines that aren't blank but for comment marks."""
    parts, starts, numbers, size = [], [], [], 0
    for n, line in enumerate([*text.split("\n"), ""]):
        bare = _MARKS.sub("", line)
        if bare:
            parts.append(bare)
            starts.append(size)
            numbers.append(n)
            size += len(bare) + 1
        elif parts:
            yield " ".join(parts), starts, numbers
            parts, starts, numbers, size = [], [], [], 0


def match(block: str) -> list[dict]:
    """All licenses of a paragraph: every confirmed notice that doesn't overlap a better one, by its place.

    "All rights reserved" in a sentence that grants a license is no license of its own.
    """
    spots = [m.span() for m in _WORD.finditer(block)]
    words = [block[a:b].lower() for a, b in spots]
    begins = [a for a, _ in spots]
    triggers = sorted({max(0, bisect_right(begins, m.start()) - 1) for m in _TRIGGER.finditer(block)})
    if not words or not triggers:
        return []
    cuts = [0, *(bisect_left(begins, m.end()) for m in _SENTENCE.finditer(block)), len(words)]
    inside: dict[tuple[int, int], list[int]] = {}
    for t in triggers:
        i = bisect_right(cuts, t) - 1
        inside.setdefault((cuts[i], cuts[i + 1]), []).append(t)
    confirmed = {}
    blocks = {w for sentence, ts in inside.items() for w in (sentence, *(x for size in SIZES if size < sentence[1] - sentence[0] for x in _windows(*sentence, size, ts)))}
    for a, b in sorted(blocks):
        part = words[a:b]
        bag = set(part)
        for k in winners(block[spots[a][0] : spots[b - 1][1]]):
            template = _template_words()[k]
            if not _telling()[k] <= bag or sum(w in bag for w in template) < LEAST_WORDS * len(template):
                continue
            have, lacks, puts, at = differences(part, template)
            if have < LEAST_WORDS or any(map(_TELLING.search, lacks)):
                continue
            at = tuple(a + i for i in at)
            if (k, at) not in confirmed:
                end = spots[at[-1]][1]
                found = block[spots[at[0]][0] : end + (block[end : end + 1] in tuple(".!?"))]
                saved, share = _saved(found, k)
                # A notice with much put between is saved little of; it is confirmed by standing there word for word.
                if share >= LEAST_SAVED or not lacks and not puts:
                    confirmed[k, at] = (-saved, len(lacks) + len(puts), k, at, share, have, lacks, puts, found)
    out: list[dict] = []
    taken: dict[int, set[str]] = {}
    for _, _, k, at, share, have, lacks, puts, found in sorted(confirmed.values()):
        name = TEMPLATES[k][0]
        if not any(i in taken and (words[i] not in _LEADS or name in taken[i]) for i in at):
            for i in at:
                taken.setdefault(i, set()).add(name)
            out.append({"license": name, "template": k, "saved": share, "coverage": have, "lacks": lacks, "puts": puts, "block": found, "at": spots[at[0]][0], "of": bisect_right(cuts, at[0])})
    granted = {x["of"] for x in out if x["license"] != "proprietary"}
    out = [x for x in out if x["license"] != "proprietary" or x["of"] not in granted]
    return sorted(out, key=lambda x: (x["at"], x["template"]))


def scan(text: str) -> list[dict]:
    """The confirmed license notices of a whole text, by the line that each starts in."""
    if not _TRIGGER.search(text):
        return []
    return [{"line": numbers[bisect_right(starts, x["at"]) - 1], **x} for block, starts, numbers in _paragraphs(text) if _TRIGGER.search(block) for x in match(block)]


RESULT = "doc_id long, line int, license string, template int, saved double, coverage double, lacks array<string>, puts array<string>, block string"


def license_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each confirmed license notice of each row of ``docs``.

    line: from 0; license, template: what it is; saved: the share of bytes that the template saves; coverage, lacks,
    puts: the wording differences; block: the notice, its lines joined. Null and empty texts give no rows; rows that repeat a doc_id
    each give theirs; a null doc_id is kept. An empty table gives no rows; extra columns are ignored. Texts without a
    trigger never leave the JVM.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"doc_id": pa.int64(), "line": pa.int32(), "license": pa.string(), "template": pa.int32(), "saved": pa.float64(), "coverage": pa.float64(), "lacks": pa.list_(pa.string()), "puts": pa.list_(pa.string()), "block": pa.string()}
        for b in batches:
            found = [{"doc_id": i, **x} for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for x in scan(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in kinds.items()], list(kinds))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(TRIGGER))
    return rows.mapInArrow(work, RESULT)


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: the license notices of every document, with their differences from the template."""
    out = license_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "line", "license", "saved", "coverage", F.array_join("lacks", " ").alias("lacks"), F.array_join("puts", " ").alias("puts"), "block")
