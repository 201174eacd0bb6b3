"""Operator 7: license scans by conditional compression.

Candidate blocks are the words around license cues.  Each block is compressed
plain and with each template as a raw zstandard dictionary; the template that
saves most tells most about the block, as wording they share costs next to
nothing.  Winners in rank order are confirmed by exact wording: words of
template and block are aligned, and what differs is reported.

A name or version can't be another one: the *telling* words of a template (numbers,
and names: capitals within a sentence) must all stand in the notice, and no
name of other templates may stand between its words.  Only templates
whose telling words, and ``LEAST_WORDS`` of all their words in any order, stand in
a block are compressed with: no other could be confirmed.

Work is local to a row: one scan, no shuffle.  A text without a cue is passed
over by substring search; blocks are bounded, texts are read whole.

Defined results: null and empty texts give no rows; a notice that occurs
several times in a text gives a row for each; repeated rows give their rows
again; a null doc_id stays null; other columns are ignored, whatever their
names; texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wording of public license notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
}
TEMPLATES |= {
    f"{name}-SPDX": f"SPDX-License-Identifier: {name}"
    for name in "MIT Apache-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later BSD-2-Clause BSD-3-Clause ISC MPL-2.0 EPL-2.0 Zlib BSL-1.0 Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0".split()
}
CUES = ("licens", "licenc", "copyright", "permission", "redistribut", "warrant", "public", "domain", "free", "software")

#: Words of a block before and after its cues; cues closer than that share a block, up to ``LONGEST`` words (twice the longest template and more, as cuts overlap by half).
BEFORE, AFTER, LONGEST = 16, 24, 400
#: Least saving, relative to the block or to the template if that is shorter, and least share of a template's words found in order.
LEAST_GAIN, LEAST_WORDS = 0.15, 0.8
SCHEMA = "doc_id long, license string, start long, stop long, gain double, n_words int, differences string"

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_CUE = re.compile("|".join(CUES), re.I)
_CUE_BYTES = [c.encode() for c in CUES]


def words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


#: Words with a capital that are no names.
_PLAIN = frozenset("a any as basis code for form foundation free is kind license of or software source unless version you".split())


def telling(body: str) -> frozenset[str]:
    """Numbers, and names: words with a capital that begin no sentence, but for long words in capitals only."""
    out = set()
    for m in _WORD.finditer(body):
        begins = not m.start() or body[: m.start()].rstrip(' "(')[-1:] in ".:;"
        name = m[0][0].isupper() and not begins and not (m[0].isupper() and len(m[0]) > 5)
        if any(c.isdigit() for c in m[0]) or name and m[0].lower() not in _PLAIN:
            out.add(m[0].lower())
    if body.startswith("SPDX"):
        out.add("spdx-license-identifier")
    return frozenset(out)


TELLING = {name: telling(body) for name, body in TEMPLATES.items()}
_NAMES = frozenset(w for ws in TELLING.values() for w in ws if not any(c.isdigit() for c in w)) - {"by"}
TELLING_WORDS = {tuple(w for w, _, _ in words(body)): TELLING[name] for name, body in TEMPLATES.items()}


@lru_cache(maxsize=1)
def _prepared():
    import zstandard as z

    plain = z.ZstdCompressor(level=19)
    out = []
    for name, body in TEMPLATES.items():
        raw = " ".join(w for w, _, _ in words(body))
        known = z.ZstdCompressionDict(raw.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
        out.append((name, raw.split(" "), Counter(raw.split(" ")), z.ZstdCompressor(level=19, dict_data=known)))
    return plain, out


def blocks(found: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Word ranges around cues; long ones are cut where they exceed ``LONGEST``, with an overlap."""
    ranges: list[list[int]] = []
    for k, (w, _, _) in enumerate(found):
        if _CUE.search(w):
            a, b = max(0, k - BEFORE), min(len(found), k + AFTER)
            if ranges and a <= ranges[-1][1]:
                ranges[-1][1] = b
            else:
                ranges.append([a, b])
    for a, b in ranges:
        while b - a > LONGEST:
            yield a, a + LONGEST
            a += LONGEST // 2
        yield a, b


def rank(block: list[str]) -> list[tuple[float, str, list[str]]]:
    """Templates that can be confirmed, by how much they save, most first: (relative saving, name, words)."""
    plain, templates = _prepared()
    have = Counter(block)
    able = [(name, tw, c) for name, tw, bag, c in templates if all(w in have for w in TELLING[name]) and sum(min(n, have[w]) for w, n in bag.items()) >= LEAST_WORDS * len(tw)]
    if not able:
        return []
    data = " ".join(block).encode()
    alone = len(plain.compress(data))
    out = []
    for name, tw, compressor in able:
        saved = alone - len(compressor.compress(data))
        out.append((saved / max(1, min(alone, len(plain.compress(" ".join(tw).encode())))), name, tw))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def align(block: list[str], template: list[str]) -> tuple[int, int, int, str, bool]:
    """(first, last exclusive, template words found in order, differences, whether names and numbers are the template's)."""
    m = SequenceMatcher(None, template, block, autojunk=False)
    best = m.find_longest_match()
    if not best.size:
        return 0, 0, 0, "", False
    # the template's own extent around its longest common run
    slack = max(4, len(template) // 4)
    a, b = max(0, best.b - best.a - slack), min(len(block), best.b + len(template) - best.a + slack)
    m = SequenceMatcher(None, template, block[a:b], autojunk=False)
    same = [x for x in m.get_matching_blocks() if x.size]
    first, last = same[0].b, same[-1].b + same[-1].size
    notes, lost, more = [], [], []
    for op, i, j, k, n in m.get_opcodes():
        if op != "equal" and not (op == "insert" and (n <= first or k >= last)):
            notes.append(f"-{' '.join(template[i:j])}+{' '.join(block[a + max(k, first) : a + min(n, last)])}")
            lost += template[i:j]
            more += block[a + max(k, first) : a + min(n, last)]
    own = TELLING_WORDS.get(tuple(template), frozenset())
    exact = not own.intersection(lost) and not (_NAMES - own).intersection(more)
    return a + first, a + last, sum(x.size for x in same), ";".join(notes), exact


def scan(text: str) -> list[tuple[str, int, int, float, int, str]]:
    """Notices of a whole text: (license, start, stop, saving, words, differences), in text order."""
    found = words(text)
    out: dict[tuple[int, int], tuple] = {}
    for a, b in blocks(found):
        todo = [(a, b)]
        while todo:  # after a notice, what stands before and after it
            lo, hi = todo.pop()
            block = [w.replace("licenc", "licens") for w, _, _ in found[lo:hi]]  # one word in two spellings; which is reported
            if not any(_CUE.search(w) for w in block):
                continue
            good = []
            for gain, name, template in rank(block):
                if gain < LEAST_GAIN:
                    break
                first, last, same, notes, exact = align(block, template)
                if exact and same >= LEAST_WORDS * len(template) and any(_CUE.search(w) for w in block[first:last]):
                    good.append((same - notes.count("-") - notes.count("+"), gain, name, first, last, notes))
            if not good:
                continue
            # exact wording decides among those that compression put forward
            _, gain, name, first, last, notes = max(good, key=lambda x: (x[5] == "", x[0], x[1]))
            notes = ";".join([*([notes] if notes else []), *(f"-{w}+{raw}" for w, (raw, _, _) in zip(block[first:last], found[lo + first : lo + last], strict=True) if w != raw)])
            out[(found[lo + first][1], found[lo + last - 1][2])] = (name, found[lo + first][1], found[lo + last - 1][2], gain, last - first, notes)
            todo += [(lo, lo + first), (lo + last, hi)]
    kept: list[tuple[int, int]] = []
    for at in sorted(out):  # cuts of a long block overlap: of what both saw, the longer
        if kept and at[0] < kept[-1][1]:
            if at[1] - at[0] > kept[-1][1] - kept[-1][0]:
                kept[-1] = at
        else:
            kept.append(at)
    return [out[k] for k in kept]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            raw = text.as_py()
            low = raw.lower()
            if any(c in low for c in _CUE_BYTES):
                rows += [(doc, *n) for n in scan(raw.decode("utf-8", "replace"))]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "license", "start", "stop", "gain", "n_words", "differences"])


def notices(docs: DataFrame) -> DataFrame:
    """One row a notice found in ``docs(doc_id, text)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_scan, SCHEMA)
