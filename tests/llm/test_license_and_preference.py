import re

from llm.license_scan import FRAMES, KEYWORDS, RULES, SENTENCES, scan_licenses
from llm.preference import format_preferences, pairs_of_conversations


def test_every_sentence_holds_a_keyword_and_every_rule_knows_its_sentences():
    assert all(any(k in s for k in KEYWORDS) for _, s in SENTENCES)
    assert all(re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", s) for _, s in SENTENCES)
    assert all(any(k in begin + end for k in KEYWORDS) for _, begin, end in FRAMES)
    known = {n for n, _ in SENTENCES} | {n for n, _, _ in FRAMES}
    assert all(set(run) <= known for _, run in RULES)


def test_scan(spark):
    text = {n: s for n, s in SENTENCES}
    mit = ".\n\n".join(text[n].upper() for n in ["MitTitle", "MitGrant", "MitNotice", "AsIsMit", "LiableMit"])
    bsd = ". ".join(text[n].replace(" ", "\n ", 2) for n in ["BsdGrant", "BsdSource", "BsdBinary", "AsIsBsd"])
    rows = [
        (1, mit + ". Some code. Licensed under the Apache License, Version 2.0.\n\nmore"),
        (2, bsd), (3, "Nothing of the kind. A licence of another kind."), (4, None), (5, ""), (None, "x. All rights reserved.\n\n"),
        (6, "Released under the MIT License.\n\n" * 3), (6, "Released under the MIT License.\n\n" * 3), (7, text["GplHope"]), (8, "word " * 40000 + ". SPDX-License-Identifier: MIT"),
    ]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, licenses int")).collect()}
    assert (got[1].licenses, got[1].n_sentences, got[1].n_unmatched) == ("MIT,Apache-2.0", 6, 0)
    assert (got[2].licenses, got[2].sentences) == ("BSD-2-Clause", "BsdGrant,BsdSource,BsdBinary,AsIsBsd")
    assert all((got[i].licenses, got[i].n_sentences, got[i].n_unmatched) == ("", 0, 0) for i in (3, 4, 5))
    assert got[None].licenses == "all-rights-reserved" and got[8].licenses == "MIT"
    assert (got[6].licenses, got[6].n_sentences) == ("MIT", 3) and (got[7].licenses, got[7].n_unmatched) == ("", 1)
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


BSD = """Copyright (c) 2015, X. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

{0}Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
{1}Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
{2}THIS SOFTWARE IS PROVIDED BY {3} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {3} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
ENDORSE = """{0}Neither the name of {1} nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.

"""


def test_holders_items_and_comment_marks(spark):
    """Whoever the holder is, however items are marked, and inside comments: the licence with a 'neither the name' clause is never the one without."""
    rows = {}
    for marks in (("   * ", "   * ", "   * "), ("1. ", "2. ", "3. "), ("  (a) ", "  (b) ", "  (c) "), ("- ", "- ", "- "), ("", "\n", "\n")):
        for holder in ("Google Inc.", "the copyright holder", "Example GmbH", "Foo Inc. and Bar Corp."):
            rows["BSD-3-Clause", marks, holder] = BSD.format(marks[0], marks[1], ENDORSE.format(marks[2], holder), holder.upper())
            rows["BSD-2-Clause", marks, holder] = BSD.format(marks[0], marks[1], "\n", holder.upper())
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
    for mark in ("# ", "// ", " * ", "-- ", ";; ", "%% ", ""):
        rows["Apache-2.0", mark, ""] = "".join(f"{mark}{line}".rstrip() + "\n" for line in apache.split("\n"))
        rows["BSD-3-Clause", mark, "Google Inc."] = "".join(f"{mark}{line}".rstrip() + "\n" for line in BSD.format("1. ", "2. ", ENDORSE.format("3. ", "Google Inc."), "X").split("\n"))
    keys = list(rows)
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame([(i, rows[k]) for i, k in enumerate(keys)], "doc_id long, text string")).collect()}
    for i, key in enumerate(keys):
        assert got[i].licenses.replace(",all-rights-reserved", "") == key[0], (key, got[i])
        assert key[0] != "Apache-2.0" or got[i].n_sentences == 5 and got[i].n_unmatched == 0, (key, got[i])


def test_verbatim_notices(spark):
    """Notices as their licences word them, with sentence ends inside sentences and odd white space."""
    apache = '''Copyright 2020 X

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
'''
    gpl = '''This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
'''
    mpl = '''This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http{}://mozilla.org/MPL/2.0/.
'''
    want = [(apache, "Apache-2.0"), (mpl.format("s"), "MPL-2.0"), (mpl.format(""), "MPL-2.0")]
    bsd = '''BSD 3-Clause License

Copyright (c) 2017, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
'''
    lgpl = '''This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
'''
    want += [(lgpl, "LGPL-2.1-or-later"), (bsd, "BSD-3-Clause")]
    want += [(gpl.format(a, b, v), f"GPL-{v}.0-or-later") for a in ":;" for b in ",;" for v in (2, 3)]
    want += [(gpl.format(":", ",", 3) + "\nYou should have received a copy of the GNU General Public License\nalong with this program.  If not, see <https://www.gnu.org/licenses/>.\n", "GPL-3.0-or-later")]
    want += [(gpl.format(";", ";", 2).split("\n\n")[0], "GPL-2.0-or-later"), ("x. All rights\nreserved.", "all-rights-reserved"), ("x. ALL  RIGHTS  RESERVED.", "all-rights-reserved")]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "doc_id long, text string")).collect()}
    for i, (text, name) in enumerate(want):
        assert (got[i].licenses, got[i].n_unmatched) == (name, 0), text


def test_preferences(spark):
    u, a, b = ("user", "hi <|im_end|>"), ("assistant", "yes"), ("assistant", "no")
    rows = [(1, [u, a], [u, b], 0), (2, [u, a, u, a], [u, a, u, b, u], 0), (3, [u, a], [u, a], 0), (4, None, [u], 0), (5, [u], [u, a], 0), (6, [u, ("assistant", None)], [(None, None), a], 0), (1, [u, a], [u, b], 0)]
    schema = "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt int"
    out = format_preferences(spark.createDataFrame(rows, schema)).collect()
    got = {r.pair_id: r for r in out}
    assert len(out) == 7 and [got[i].n_prompt_turns for i in range(1, 7)] == [1, 3, 2, 0, 1, 0]
    assert [got[i].usable for i in range(1, 7)] == [True, True, False, False, False, True]
    assert got[1].prompt == "<|im_start|>user\nhi < |im_end|><|im_end|>\n"
    assert got[1].chosen == "<|im_start|>assistant\nyes<|im_end|>\n" and got[3].chosen == got[3].rejected == ""
    for r in out:
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            at, trained = 0, ""
            for run in mask.split():
                n, flag = map(int, run.split(":"))
                trained += text[at : at + n] if flag else ""
                at += n
            assert at == len(text)
            assert trained == "".join(re.findall(r"<\|im_start\|>assistant\n(.*?<\|im_end\|>\n)", text, re.S))
    assert format_preferences(spark.createDataFrame([], schema)).count() == 0


def test_pairs_of_conversations(spark):
    """Partners that open alike, spliced ones, ties, nulls, repeated turns, blocks, very long turns."""
    u, long = "user", "word " * 50_000
    rows = [
        (1, 0, u, "same"), (1, 1, "assistant", "one"), (1, 2, u, "more"), (1, 3, "assistant", "end one"),
        (2, 0, u, "other"), (2, 1, "assistant", long), (2, 2, u, "bye"),
        (3, 0, u, "same"), (3, 1, "assistant", "one"), (3, 2, u, "else"),
        (4, 0, None, None), (5, 1, "b", "y"), (5, 1, "a", "z"), (5, 1, "a", "z"), (5, None, "assistant", "first"),
        (1005, 0, u, "same"), (None, 0, u, "same"),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, last int")
    got = {r.pair_id: r for r in pairs_of_conversations(docs).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 1005]
    turns = lambda c: c and [tuple(t) for t in c]
    assert turns(got[1].rejected) == turns(got[3].chosen) and got[5].rejected is None and got[1005].rejected is None
    assert turns(got[2].rejected) == [(u, "other"), ("assistant", "one"), (u, "bye")]
    assert turns(got[3].rejected) == turns(got[4].chosen) == [(None, None)] and turns(got[4].rejected) == turns(got[5].chosen)
    assert turns(got[5].chosen) == [("assistant", "first"), ("a", "z"), ("a", "z"), ("b", "y")]
    out = {r.pair_id: r for r in format_preferences(pairs_of_conversations(docs)).collect()}
    assert [(i, out[i].n_prompt_turns, out[i].usable) for i in sorted(out)] == [(1, 2, False), (2, 1, True), (3, 0, False), (4, 0, False), (5, 0, False), (1005, 0, False)]
    assert long in out[2].chosen
    assert pairs_of_conversations(docs.where("false")).count() == 0
