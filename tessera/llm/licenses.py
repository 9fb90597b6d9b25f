"""License scan by sentence-rule recognition.

Known licence sentences, each with an identifier, are looked for as runs of
words: lower case, and whatever stands between two words (blanks, line ends,
comment marks, quotes) counts as one separator, so a sentence wrapped over
lines of a comment is the same sentence.  A run starts where a line or a
sentence does, after any comment marks and item number, or right after
another known sentence; it ends before a mark, a line end or the end of the
text; the longest known sentence wins.  ``{holder}`` in a known sentence
stands for up to ``HOLDER_WORDS`` words.  A copyright line goes to the end of
its line or sentence.  What is left of a document is its sequence of
identifiers.  Ordered rules name a licence by an identifier sequence: a rule
matches where its identifiers follow each other with nothing but other
licence sentences between them, a longer rule goes before a shorter one, and
an identifier that a rule has used is not used again.

Both tables are small and fixed, so a task holds them; texts are scanned
where they are.  A null text has no sentence.  Repeated rows are scanned each
for itself; extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import add_fields, load

#: Known licence sentences and their identifiers.  The first part of a sentence stands where the rest may differ.
SENTENCES = {
    "all rights reserved": "all-rights",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under the apache license version 2 0 the license": "apache-2",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "released under the mit license": "mit-name",
    "licensed under the mit license": "mit-name",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind": "as-is",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "this work is licensed under the gnu general public license version 3": "gpl-3-name",
    "this work is licensed under the gnu general public license version 2": "gpl-2-name",
    "licensed under the gnu general public license version 3": "gpl-3-name",
    "licensed under the gnu general public license version 2": "gpl-2-name",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "either version 3 of the license or at your option any later version": "gpl-3-later",
    "either version 2 of the license or at your option any later version": "gpl-2-later",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "licensed under cc by nc 4 0": "cc-by-nc-4",
    "licensed under cc by sa 4 0": "cc-by-sa-4",
    "licensed under cc by 4 0": "cc-by-4",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-grant",
    "You may obtain a copy of the License at http": "apache-copy",
    "You may obtain a copy of the License at https": "apache-copy",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.": "apache-warranty",
    "See the License for the specific language governing permissions and limitations under the License.": "apache-see",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:": "mit-grant",
    "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.": "mit-notice",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.": "as-is",
    "IN NO EVENT SHALL {holder} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.": "mit-liability",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "bsd-binary",
    "Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-name",
    "Neither the name of {holder} nor the names of other contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-name",
    "The name of {holder} may not be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-name",
    "THIS SOFTWARE IS PROVIDED BY {holder} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.": "bsd-warranty",
    "IN NO EVENT SHALL {holder} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.": "bsd-liability",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3.": "gpl-3-name",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2.": "gpl-2-name",
    "Licensed under the GNU General Public License version 3 or later": "gpl-3-later-name",
    "Licensed under the GNU General Public License version 2 or later": "gpl-2-later-name",
    "Licensed under the GNU General Public License version 3 or (at your option) any later version": "gpl-3-later-name",
    "Licensed under the GNU General Public License version 2 or (at your option) any later version": "gpl-2-later-name",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "gpl-warranty",
    "See the GNU General Public License for more details.": "gpl-see",
    "You should have received a copy of the GNU General Public License along with this program": "gpl-copy",
    "If a copy of the MPL was not distributed with this file, You can obtain one at http": "mpl-2-copy",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https": "mpl-2-copy",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc-grant",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc-grant",
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND {holder} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.": "isc-warranty",
    "IN NO EVENT SHALL {holder} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.": "isc-liability",
    "This library is free software": "gpl-free",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "lgpl-terms",
    "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation": "agpl-terms",
    "either version 2.1 of the License, or (at your option) any later version.": "lgpl-2.1-later",
    "See the GNU Lesser General Public License for more details.": "gpl-see",
    "See the GNU Affero General Public License for more details.": "gpl-see",
    "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "gpl-warranty",
    "Licensed under the GNU Lesser General Public License version 2.1": "lgpl-2.1-name",
    "Licensed under the GNU Lesser General Public License version 3": "lgpl-3-name",
    "Licensed under the GNU Affero General Public License version 3": "agpl-3-name",
    "This software is provided 'as-is', without any express or implied warranty.": "zlib-as-is",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:": "zlib-grant",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:": "bsl-grant",
    "Distributed under the Boost Software License, Version 1.0.": "bsl-name",
    "To the extent possible under law, {holder} has waived all copyright and related or neighboring rights to this work.": "cc0",
    "Licensed under CC0 1.0": "cc0",
    "Licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa-4",
    "Licensed under CC BY-ND 4.0": "cc-by-nd-4",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0": "epl-2",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0": "epl-2",
    "Licensed under the BSD 3-Clause License": "bsd-3-name",
    "Licensed under the BSD 2-Clause License": "bsd-2-name",
    "Licensed under the ISC License": "isc-name",
    "Licensed under the Mozilla Public License 2.0": "mpl-2",
    "Licensed under the Mozilla Public License, version 2.0": "mpl-2",
}

#: Licences and the identifier sequences that name them; the first match of the longest goes first.
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-terms", "gpl-3-later")),
    ("LGPL-3.0-or-later", ("gpl-free", "lgpl-terms", "gpl-3-later")),
    ("LGPL-2.1-or-later", ("gpl-free", "lgpl-terms", "lgpl-2.1-later")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl-terms", "gpl-3-later")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-terms", "gpl-2-later")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-2", "apache-comply", "apache-copy")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("Apache-2.0", ("apache-2", "apache-comply")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-2",)),
    ("MIT", ("mit-name",)),
    ("MIT", ("mit-grant",)),
    ("GPL-3.0-or-later", ("gpl-3-later-name",)),
    ("GPL-2.0-or-later", ("gpl-2-later-name",)),
    ("GPL-3.0-only", ("gpl-3-name",)),
    ("GPL-2.0-only", ("gpl-2-name",)),
    ("MPL-2.0", ("mpl-2",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("Unlicense", ("unlicense",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("BSL-1.0", ("bsl-name",)),
    ("CC0-1.0", ("cc0",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    ("EPL-2.0", ("epl-2",)),
    ("LGPL-2.1-only", ("lgpl-2.1-name",)),
    ("LGPL-3.0-only", ("lgpl-3-name",)),
    ("AGPL-3.0-only", ("agpl-3-name",)),
    ("BSD-3-Clause", ("bsd-3-name",)),
    ("BSD-2-Clause", ("bsd-2-name",)),
    ("ISC", ("isc-name",)),
)

#: Most words of a name where a known sentence has ``{holder}``.
HOLDER_WORDS = 12
#: What a sentence of the table that starts with "licensed" or "released" may have before it.
SUBJECTS = ("this work is", "this project is", "this software is", "this program is", "this library is", "this code is", "this file is", "it is")

_WORD = re.compile(r"[a-z0-9]+|\{holder\}")
# Bounded, so that long runs of marks or of another script cost no more than their length.
_GAP = r"[^a-z0-9]{1,80}+(?:(?<=\n)(?:dnl|rem)[^a-z0-9]{1,80}+)?"
_ITEM = r"(?:(?:[a-z0-9]{1,3}[.)]|dnl\b|rem\b)[^a-z0-9]{1,80}+)?"
_END = r"(?![a-z0-9])(?=[^a-z0-9\n.;:!?,(]{0,80}+(?:\Z|[\n(]|[.;:!?,](?:[^a-z0-9]|\Z)))"
#: A copyright line, but not a sentence on notices or holders.
_COPYRIGHT = re.compile(r"copyright(?![a-z0-9])(?!\s+(?:notice|holder|owner|law|licen[sc]e)s?\b)(?:[^\n.;:!?]|[.;:!?](?!\s))*")


def _pattern(words: list[str]) -> re.Pattern:
    name = rf"(?:[a-z0-9]++{_GAP}){{1,{HOLDER_WORDS}}}?"
    parts = [name if w == "{holder}" else w + (_GAP if k + 1 < len(words) else "") for k, w in enumerate(words)]
    return re.compile("".join(parts) + _END)


def _table() -> dict[str, list[tuple[re.Pattern, str]]]:
    """Patterns of the known sentences by first word, the longest first."""
    known = {tuple(_WORD.findall(s.lower())): name for s, name in SENTENCES.items()}
    known |= {(*x.split(), *words): name for words, name in known.items() if words[0] in ("licensed", "released") for x in SUBJECTS}
    out: dict[str, list[tuple[re.Pattern, str]]] = {}
    for words in sorted(known, key=lambda w: (-len(w), w)):
        out.setdefault(words[0], []).append((_pattern(words), known[words]))
    return out


_KNOWN = _table()
_FIRST = "(" + "|".join(sorted({*_KNOWN, "copyright"})) + ")(?![a-z0-9])"
_START = re.compile(r"(?:\A|\n|[.;:!?]\s)[^a-z0-9]{0,80}+" + _ITEM + _FIRST)
_NOT = re.compile(r"\b(?:not|never)[^a-z0-9]+\Z")
_NEXT = re.compile(r"[^a-z0-9]{1,80}+" + _ITEM + _FIRST)


def _sentence(low: str, at: int, first: str) -> tuple[int, str] | None:
    """End and identifier of the known sentence that starts at ``at``, unless the line before it ends in "not"."""
    if _NOT.search(low, max(0, at - 90), at):
        return None
    if first == "copyright":
        m = _COPYRIGHT.match(low, at)
        return m and (m.end(), "all-rights" if re.search(r"all[^a-z0-9]+rights[^a-z0-9]+reserved[^a-z0-9]*\Z", m[0]) else "copyright")
    return next(((m.end(), name) for pattern, name in _KNOWN[first] if (m := pattern.match(low, at))), None)


def sentence_ids(text: str | None) -> list[str]:
    """Identifiers of the licence sentences of a text, in order."""
    low, out = (text or "").lower(), []
    m = _START.search(low)
    while m:
        found = _sentence(low, m.start(1), m[1])
        if found:
            out.append(found[1])
            m = _NEXT.match(low, found[0]) or _START.search(low, found[0])
        else:
            m = _START.search(low, m.end())
    return out


def match_rules(ids: list[str], rules: tuple = RULES) -> list[str]:
    """Licences that the rules find, in the order of their first identifier."""
    free, found = list(range(len(ids))), []
    for name, rule in rules:
        at = 0
        while at + len(rule) <= len(free):
            if all(ids[free[at + k]] == rule[k] for k in range(len(rule))):
                found.append((free[at], name))
                del free[at : at + len(rule)]
            else:
                at += 1
    return [name for _, name in sorted(found)]


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``license_sentences`` (identifiers) and ``licenses`` (names), both in the text's order."""

    @F.arrow_udf("struct<license_sentences:array<string>,licenses:array<string>>")
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in texts:
            ids = [sentence_ids(x) for x in col.to_pylist()]
            strings = pa.list_(pa.string())
            yield pa.StructArray.from_arrays([pa.array(ids, strings), pa.array([match_rules(x) for x in ids], strings)], ["license_sentences", "licenses"])

    return add_fields(docs, scan(F.col(text)), ("license_sentences", "licenses"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of every whole text of ``documents``."""
    found = scan_licenses(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("license_sentences").cast("long").alias("n_sentences"), F.array_join("license_sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"))
