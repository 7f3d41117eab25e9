import random
import time

from tallyloom.llm.licenses import (
    GAP,
    HINTS,
    RULES,
    SENTENCES,
    match_rules,
    normalised,
    scan_licenses,
    sentence_ids,
)

MIT = """Copyright (c) 2019 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice, this
 *    list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright notice,
 *    this list of conditions and the following disclaimer in the documentation
 *    and/or other materials provided with the distribution."""
ENDORSE = """
 * 3. Neither the name of the copyright holder nor the names of its contributors
 *    may be used to endorse or promote products derived from this software without
 *    specific prior written permission."""
APACHE = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def test_tables_agree():
    names = {name.removeprefix("?") for _, sentences in RULES for name in sentences}
    assert names == set(SENTENCES)
    for texts in SENTENCES.values():
        for text in texts:
            assert any(hint in text for hint in HINTS)
            assert normalised(text.replace("#", "2"))[0] == text


def test_licences_of_texts(spark):
    wanted = {
        MIT: ["MIT"],
        BSD: ["BSD-2-Clause"],
        BSD + ENDORSE: ["BSD-3-Clause"],
        APACHE: ["Apache-2.0"],
        GPL: ["GPL-3-or-later"],
        "Words here.\nLicensed under CC BY-NC 4.0\nMore words.": ["CC-BY-NC-4.0"],
        "x\nReleased under the MIT License.\nall rights reserved\n": ["MIT", "Proprietary"],
        "LICENSED  UNDER the Apache Licence, version 2.0": ["Apache-2.0"],
        "The licence was not granted, permission is hereby refused.": [],
        "plain": [], "": [], None: [],
        "y. " * 20000 + "Released under the MIT License.": ["MIT"],
    }
    rows = [(n, text, "c") for n, text in enumerate(wanted)] + [(None, MIT, "c")]
    found = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, licences string"))
    by_id = {row.doc_id: row for row in found.collect()}
    for number, (text, licences) in enumerate(wanted.items()):
        assert by_id[number].licences == licences, text
    assert by_id[0].sentence_ids == ["Permission", "NoticeKept"]
    assert by_id[None].licences == ["MIT"]
    assert scan_licenses(found.selectExpr("doc_id", "'' AS text").limit(0)).isEmpty()


def test_unclaimed_sentences_are_told(spark):
    text = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the software."
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.licences, row.unclaimed) == ([], ["NoticeKept"])


def test_wrapped_public_domain_texts(spark):
    texts = [
        "This work is in the public\ndomain.",
        "# This work is in the public\n#   domain.",
        "This work is in the  public \t domain.",
        "This is free and unencumbered software released into the public\n * domain.",
        "This work is in the public 'do'main.",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in scan_licenses(rows).collect():
        assert row.licences == ["Public-Domain"], texts[row.doc_id]


MIT_END = """

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_END = """
 * THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
 * WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
 * PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
 * ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
 * TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
 * HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
 * NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
 * POSSIBILITY OF SUCH DAMAGE. */"""
APACHE_END = """
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software distributed under the License is
// distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
// See the License for the specific language governing permissions and limitations under the License."""
GPL_END = """
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License
for more details.

You should have received a copy of the GNU General Public License along with this program.  If not, see
<https://www.gnu.org/licenses/>."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and
to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
LGPL = GPL.replace("This program", "This library").replace("GNU General", "GNU Lesser General")


def test_whole_notices_are_claimed():
    for text, licence in {
        MIT + MIT_END: "MIT", BSD + BSD_END: "BSD-2-Clause", BSD + ENDORSE + BSD_END: "BSD-3-Clause",
        APACHE + APACHE_END: "Apache-2.0", GPL + GPL_END: "GPL-3-or-later", ZLIB: "Zlib", MPL: "MPL-2.0",
        LGPL: "LGPL-3-or-later", GPL.replace("GNU General", "GNU Affero General"): "AGPL-3-or-later",
    }.items():
        assert match_rules(sentence_ids(text)) == ([licence], [])
        shouted = match_rules(sentence_ids(text.replace("\n", "\r\n   ").upper()))
        assert shouted[0] == [licence] and shouted[1] == []


def enumerated(sentences):
    """All ways to spell a rule from each place, the first in order of preference."""
    left = dict(enumerate(sentences))

    def ways(wanted, at, first):
        if not wanted:
            yield []
            return
        name, may_miss = wanted[0].removeprefix("?"), wanted[0].startswith("?")
        for place in range(at, at + (1 if first else GAP + 1)):
            if place in left and left[place][0] == name:
                yield from ([place, *more] for more in ways(wanted[1:], place + 1, False))
        if may_miss:
            yield from ways(wanted[1:], at, False)

    found = []
    needed = [sum(not name.startswith("?") for name in wanted) for _, wanted in RULES]
    for number in sorted(range(len(RULES)), key=lambda n: -needed[n]):
        licence, wanted = RULES[number]
        for at in range(len(sentences)):
            places = next(ways(wanted, at, True), None)
            if places:
                version = "".join(next(([left[p][1]] for p in places if left[p][1]), []))
                found.append((at, licence.format(version)))
                for place in places:
                    del left[place]
    names = []
    for _, name in sorted(found):
        if name not in names:
            names.append(name)
    return names, [left[at][0] for at in sorted(left)]


def test_rules_equal_enumeration():
    draw = random.Random(4)
    spelt = [[name.removeprefix("?") for name in wanted] for _, wanted in RULES]
    for _ in range(2000):
        names = []
        for _ in range(draw.randint(0, 4)):
            names += [name for name in draw.choice(spelt) if draw.random() < 0.85]
            names += draw.choices(list(SENTENCES), k=draw.choice([0, 0, 1, 2]))
        sentences = [(name, draw.choice(["", "2", "3.0"])) for name in names]
        assert match_rules(sentences) == enumerated(sentences)


def test_time_is_in_proportion_to_the_text():
    for text in ("license" + " " * 100_000 + "x", "license\n" * 50_000, ("\t" * 9 + "*" * 50 + "\n") * 5000 + "license",
                 "all rights reserved. " * 30_000, "license" + "\n \t" * 100_000, "license " + "*/" * 100_000):
        begun = time.process_time()
        match_rules(sentence_ids(text))
        assert time.process_time() - begun < 15
