"""Fingerprints, licences and token counts."""

import hashlib
import random

from tessera.llm.fingerprint import fingerprint_with_edit
from tessera.llm.licenses import match_rules, scan_licenses, sentence_ids
from tessera.llm.token_count import BYTE_SCORE, WORD_START, Counter, count_tokens


def test_fingerprints_of_texts_and_edited_texts(docs_of, prose):
    texts = [prose(i, 120, 3000) for i in range(2600)]
    texts[7] = texts[100]
    rows = {r.doc_id: r for r in fingerprint_with_edit(docs_of([(3 * i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        half, after = len(t) // 2, texts[(i + 1) % len(texts)]
        edited = t[: len(t) - half] + after[:half]
        row = rows[3 * i]
        assert row.n_chars == len(t) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        assert 0 <= row.near_next <= 1 and 0 <= row.near_edited <= 1
    assert rows[21].fingerprint == rows[300].fingerprint and rows[21].edited_fingerprint != rows[21].fingerprint
    assert sum(r.near_edited > r.near_next for r in rows.values()) > 0.95 * len(rows)


def test_fingerprints_of_odd_rows(docs_of, odd_rows):
    rows = fingerprint_with_edit(docs_of(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_chars == 0 and by[1].fingerprint == by[2].fingerprint and by[4].fingerprint == by[5].fingerprint
    order = sorted(odd_rows, key=lambda x: (x[0] is not None, x[0] or 0))  # equal ids have equal texts here
    texts = [x[1] or "" for x in order]
    want = []
    for i, t in enumerate(texts):
        half = len(t) // 2
        want.append(hashlib.sha256((t[: len(t) - half] + texts[(i + 1) % len(texts)][:half]).encode()).hexdigest())
    assert sorted(want) == sorted(r.edited_sha256 for r in rows)
    assert fingerprint_with_edit(docs_of([])).count() == 0


def test_fingerprints_agree_with_brute_force(docs_of, prose):
    """The whole-lexicon part and the overlapping subsets, from terms counted in Python; the mix of a term is the module's own."""
    import numpy as np

    import tessera.llm.fingerprint as P
    from tessera.llm import words as W

    texts = [prose(i, 60, 1200) + f" only{i}" for i in range(40)]
    rows = {r.doc_id: r for r in fingerprint_with_edit(docs_of([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    df = {}
    for t in texts:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    inside = {w for w, n in df.items() if 2 <= n <= max(2, 0.1 * len(texts))}

    def number(w):
        import pyarrow as pa

        return next(W.tokens(pa.array([w]), W.LETTERS_AND_MARKS))[2].hashes[0]

    numbers = {w: number(w) for w in df}
    for i, t in enumerate(texts):
        terms = np.array(sorted(numbers[w] for w in set(t.split()) & inside), np.uint64)
        assert len(terms)
        want = [terms] + [np.array([x for x in terms if int(W.mix(np.array([x + np.uint64(1)]))[0]) >> 20 + 2 * k & 3], np.uint64) for k in range(P.OVERLAPPING)]
        text = "".join(hashlib.blake2b(x.tobytes(), digest_size=8).hexdigest() if len(x) else "0" * 16 for x in want)
        assert rows[i].fingerprint.startswith(text), i


def test_one_changed_term_leaves_most_of_a_fingerprint(docs_of, prose):
    base = [prose(i, 200, 4000) for i in range(30)]
    words = base[3].split()
    words[50:54] = ["new1", "new2", "new3", "new4"]
    rows = {r.doc_id: r for r in fingerprint_with_edit(docs_of([(i, t, "en", "a") for i, t in enumerate([*base[:4], " ".join(words), *base[4:], *base])])).collect()}
    assert rows[3].near_next >= 0.7 and rows[3].fingerprint != rows[4].fingerprint and rows[1].near_next < 0.3


def test_any_number_of_null_and_equal_ids(docs_of, spark, prose):
    rows = [(None, f"t{i} a b c", "en", "a") for i in range(3000)] + [(5, f"u{i} d e", "en", "a") for i in range(3000)] + [(6, "same text", "en", "a")] * 3000 + [(7, "end", "en", "a")]
    found = fingerprint_with_edit(docs_of(rows))
    out = found.groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in out} == {None: 3000, 5: 3000, 6: 3000, 7: 1}
    six = [r for r in found.where("doc_id = 6").collect()]
    edits = {hashlib.sha256(("same text"[:5] + after[:4]).encode()).hexdigest(): n for after, n in (("same text", 2999), ("end", 1))}
    assert {d: sum(r.edited_sha256 == d for r in six) for d in edits} == edits
    named = spark.createDataFrame([("b", "x y z"), ("a", "p q r"), ("c", None)], "doc_id string, text string")
    got = {r.doc_id: r.edited_sha256 for r in fingerprint_with_edit(named).collect()}
    assert got["a"] == hashlib.sha256(b"p qx ").hexdigest() and got["c"] == hashlib.sha256(b"").hexdigest()


def test_a_term_of_one_document_is_never_in_the_lexicon(docs_of):
    for size in (300, 1500):
        rows = []
        for i in range(size):
            text = " ".join(f"d{i}x{k}" for k in range(200))
            rows += [(2 * i, text, "en", "a"), (2 * i + 1, f"{text} slip{i}", "en", "a")]
        found = {r.doc_id: r.fingerprint for r in fingerprint_with_edit(docs_of(rows)).select("doc_id", "fingerprint").collect()}
        assert [i for i in range(size) if found[2 * i] != found[2 * i + 1]] == []
        assert len(set(found.values())) == size


def test_license_sentences_and_rules(docs_of, odd_rows):
    text = "Intro.\nCopyright (c) 2020 Some Holder. Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://x"
    assert sentence_ids(text) == ["copyright", "apache-2", "apache-comply", "apache-copy"]
    assert match_rules(sentence_ids(text)) == ["Apache-2.0"]
    assert match_rules(["mit-name", "bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "mit-grant", "as-is"]) == ["MIT", "BSD-3-Clause", "MIT"]
    found = {r.doc_id: r.licenses for r in scan_licenses(docs_of([*odd_rows, (50, "x\nReleased under the MIT License.\ny", "en", "a"), (51, "This work is licensed under the GNU General Public License, version 3.", "en", "a")])).collect()}
    assert found[50] == ["MIT"] and found[51] == ["GPL-3.0-only"] and found[1] == []
    assert scan_licenses(docs_of([])).count() == 0


MIT = """Copyright (c) 2019 Example, Inc.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD_2 = """Copyright 2020 The Example Authors
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above
   copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAME = """3. Neither the name of Example Inc. nor the names of its contributors may
   be used to endorse or promote products derived from this software without
   specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
GPL = """This program is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{comma} either version {n} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
FULL = {
    "MIT": (MIT, "copyright mit-grant mit-notice as-is mit-liability"),
    "BSD-2-Clause": (BSD_2 + BSD_END, "copyright all-rights bsd-grant bsd-source bsd-binary bsd-warranty bsd-liability"),
    "BSD-3-Clause": (BSD_2 + BSD_NAME + BSD_END, "copyright all-rights bsd-grant bsd-source bsd-binary bsd-name bsd-warranty bsd-liability"),
    "ISC": (ISC, "isc-grant isc-warranty isc-liability"),
    "MPL-2.0": (MPL, "mpl-2 mpl-2-copy"),
    "GPL-3.0-or-later": (GPL.format(mark=":", comma=",", n=3), "gpl-free gpl-terms gpl-3-later gpl-warranty gpl-see gpl-copy"),
    "GPL-2.0-or-later": (GPL.format(mark=";", comma=";", n=2), "gpl-free gpl-terms gpl-2-later gpl-warranty gpl-see gpl-copy"),
    "Apache-2.0": (APACHE, "apache-2 apache-comply apache-copy apache-warranty apache-see"),
}


def test_full_wrapped_licences():
    for name, (text, ids) in FULL.items():
        for mark in ("", "# ", " * ", "// ", "dnl "):
            wrapped = "\n".join(["some code", *((mark + line).rstrip() for line in text.split("\n")), "more code"])
            assert sentence_ids(wrapped) == ids.split(), (name, mark)
            assert match_rules(sentence_ids(wrapped)) == [name], (name, mark)
        assert sentence_ids(" ".join(text.split()))[-1] == ids.split()[-1]
    assert match_rules(sentence_ids("This project is licensed under the GNU General Public License,\nversion 3 or later.")) == ["GPL-3.0-or-later"]
    assert sentence_ids("It is not\nlicensed under the MIT License.") == []
    assert sentence_ids("It is not licensed under the MIT License. The released under the MIT License phrase, and copyright\nholders. " + "\n- " * 100_000 + "я" * 100_000) == []


def brute_count(word, pieces):
    """The best segmentation of one pre-token, without a trie."""
    marked = WORD_START + word
    best = [(0.0, 0)] + [None] * len(marked)
    for j in range(1, len(marked) + 1):
        for i in range(j):
            score = pieces.get(marked[i:j])
            if score is not None:
                cand = (best[i][0] + score, best[i][1] - 1)
                if best[j] is None or cand > best[j]:
                    best[j] = cand
        if best[j] is None:
            n = len(marked[j - 1].encode())
            best[j] = (best[j - 1][0] + BYTE_SCORE * n, best[j - 1][1] - n)
    return -best[-1][1]


def test_shared_prefixes_give_the_same_counts():
    r = random.Random(5)
    pieces = {"".join(r.choice("ab" + WORD_START) for _ in range(r.randrange(1, 5))): -r.random() * 5 for _ in range(25)}
    counter = Counter(pieces)
    words = ["".join(r.choice("abcé") for _ in range(r.randrange(1, 9))) for _ in range(500)]
    counts, n = counter.counts([" ".join(words), None, ""])
    assert counts == [sum(brute_count(w, pieces) for w in words), 0, 0] and n == [500, 0, 0]


def test_token_counts_of_odd_rows(docs_of, odd_rows):
    rows = count_tokens(docs_of(odd_rows)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(odd_rows) and by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 0
    assert by[4].n_tokens == by[5].n_tokens >= by[4].n_words == 30_000
    assert count_tokens(docs_of([])).count() == 0


NOTICES = {"LGPL-2.1-or-later":"""/*
 * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
 * Lesser General Public License for more details.
 */""",
"AGPL-3.0-or-later":"""# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU Affero General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.""",
"Zlib":"""This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented;""",
"BSL-1.0":"""// Distributed under the Boost Software License, Version 1.0.
// (See accompanying file)""",
"CC0-1.0":"To the extent possible under law, Jane Q. Doe has waived all copyright and related\nor neighboring rights to this work.",
"EPL-2.0":" * This program and the accompanying materials\n * are made available under the terms of the Eclipse Public License 2.0\n * which accompanies this distribution",

    "CC-BY-NC-SA-4.0": "This work is licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License."}


def test_further_notices():
    for name, text in NOTICES.items():
        assert match_rules(sentence_ids(text)) == [name], name


def test_result_columns_replace_those_of_the_same_name(spark):
    from tessera.llm.decontaminate import find_leaks
    from tessera.llm.secret_scan import scan_secrets

    docs = spark.createDataFrame([(1, "Released under the MIT License.", "old", "old", "old", "old")], "doc_id long, text string, licenses string, spans string, leaks string, n_tokens string")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    found = {"licenses": (scan_licenses(docs), ["MIT"]), "spans": (scan_secrets(docs), []), "leaks": (find_leaks(docs, bench), [])}
    for name, (df, want) in found.items():
        row = df.first()
        assert df.columns.count(name) == 1 and row[name] == want
        assert all(row[c] == "old" for c in ("licenses", "spans", "leaks", "n_tokens") if c != name)


def test_counts_of_words_longer_than_the_shared_states(monkeypatch):
    """Long words go on from the shared states, or share none; equal to counting each alone."""
    import random

    from tessera.llm import token_count as C

    pieces = {C.WORD_START: -3.0, C.WORD_START + "a": -2.0, "a": -2.5, "ab": -2.6, "b": -2.8, "bab": -3.1, "abab": -4.0}
    alone = lambda word: C.Counter(pieces).learn([word])[word]
    r = random.Random(2)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 30))) for _ in range(200)} | {"a" * n for n in range(1, 25)})
    want = {w: alone(w) for w in words}
    for shared in (1, 2, 5, 9, 2048):
        monkeypatch.setattr(C, "SHARED", shared)
        assert C.Counter(pieces).learn(words) == want
        counter = C.Counter(pieces)
        assert counter.counts([" ".join(words), None, words[3]])[0] == [sum(want.values()), 0, want[words[3]]]
        assert all(len(w) <= shared for w in counter.known)


def test_a_long_text_without_blanks_takes_bounded_memory():
    import tracemalloc

    from tessera.llm import token_count as C

    counter = C.Counter({C.WORD_START: -3.0, "a": -2.5, "ab": -2.6, "b": -2.8})
    text = "ab" * 500_000
    tracemalloc.start()
    counts = counter.counts([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts == ([500_001], [1]) and not counter.known
    assert peak < 30_000_000
