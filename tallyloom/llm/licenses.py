"""Finding licences by their sentences (operator 2).

Sentences are normalised and looked up among known licence sentences, which gives
a document a sequence of sentence identifiers. Ordered rules, the longest licence
first, then claim the stretches of the sequence that spell their licence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import read_table

# Identifiers and normalised texts of licence sentences. ``#`` stands
# for a version, which is handed on to the licence's name.
SENTENCES = {
    "Permission": (
        "permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files (the software), to deal in the software"
        " without restriction, including without limitation the rights to use, copy, modify,"
        " merge, publish, distribute, sublicense, and/or sell copies of the software, and to"
        " permit persons to whom the software is furnished to do so, subject to the following"
        " conditions",
    ),
    "PermissionIsc": (
        "permission to use, copy, modify, and/or distribute this software for any purpose with"
        " or without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies",
        "permission to use, copy, modify, and distribute this software for any purpose with"
        " or without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies",
    ),
    "NoticeKept": (
        "the above copyright notice and this permission notice shall be included in all copies"
        " or substantial portions of the software",
    ),
    "Redistribution": (
        "redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met",
    ),
    "SourceKeeps": (
        "redistributions of source code must retain the above copyright notice, this list of"
        " conditions and the following disclaimer",
    ),
    "BinaryKeeps": (
        "redistributions in binary form must reproduce the above copyright notice, this list of"
        " conditions and the following disclaimer in the documentation and/or other materials"
        " provided with the distribution",
    ),
    "NoEndorsement": (
        "neither the name of the copyright holder nor the names of its contributors may be used"
        " to endorse or promote products derived from this software without specific prior"
        " written permission",
    ),
    "ApacheUnder": (
        "licensed under the apache license, version #",
        "licensed under the apache license, version # (the license)",
        "released under the apache license, version #",
    ),
    "ApacheFile": (
        "you may not use this file except in compliance with the license",
    ),
    "MitUnder": (
        "released under the mit license",
        "licensed under the mit license",
        "this project is licensed under the mit license",
        "distributed under the mit license",
    ),
    "BsdUnder": (
        "licensed under the bsd #-clause license",
        "released under the bsd #-clause license",
    ),
    "GplUnder": (
        "this work is licensed under the gnu general public license, version #",
        "licensed under the gnu general public license, version #",
        "released under the gnu general public license, version #",
    ),
    "GplFree": (
        "this program is free software: you can redistribute it and/or modify it under the terms"
        " of the gnu general public license as published by the free software foundation, either"
        " version # of the license, or (at your option) any later version",
        "this program is free software; you can redistribute it and/or modify it under the terms"
        " of the gnu general public license as published by the free software foundation; either"
        " version # of the license, or (at your option) any later version",
    ),
    "LgplUnder": (
        "licensed under the gnu lesser general public license, version #",
    ),
    "MplUnder": (
        "this source code form is subject to the terms of the mozilla public license, v. #",
        "licensed under the mozilla public license, version #",
    ),
    "CcByUnder": ("licensed under cc by #", "this work is licensed under cc by #"),
    "CcBySaUnder": ("licensed under cc by-sa #", "this work is licensed under cc by-sa #"),
    "CcByNcUnder": ("licensed under cc by-nc #", "this work is licensed under cc by-nc #"),
    "CcByNdUnder": ("licensed under cc by-nd #", "this work is licensed under cc by-nd #"),
    "CcByNcSaUnder": ("licensed under cc by-nc-sa #",),
    "CcByNcNdUnder": ("licensed under cc by-nc-nd #",),
    "PublicDomain": (
        "this work is in the public domain",
        "this is free and unencumbered software released into the public domain",
    ),
    "Reserved": ("all rights reserved",),
    "MitAsIs": (
        "the software is provided as is, without warranty of any kind, express or implied,"
        " including but not limited to the warranties of merchantability, fitness for a"
        " particular purpose and noninfringement",
    ),
    "MitNoLiability": (
        "in no event shall the authors or copyright holders be liable for any claim, damages or"
        " other liability, whether in an action of contract, tort or otherwise, arising from,"
        " out of or in connection with the software or the use or other dealings in the software",
    ),
    "BsdAsIs": (
        "this software is provided by the copyright holders and contributors as is and any"
        " express or implied warranties, including, but not limited to, the implied warranties"
        " of merchantability and fitness for a particular purpose are disclaimed",
    ),
    "BsdNoLiability": tuple(
        f"in no event shall the copyright {holder} or contributors be liable for any direct,"
        " indirect, incidental, special, exemplary, or consequential damages (including, but not"
        " limited to, procurement of substitute goods or services; loss of use, data, or profits;"
        " or business interruption) however caused and on any theory of liability, whether in"
        " contract, strict liability, or tort (including negligence or otherwise) arising in any"
        " way out of the use of this software, even if advised of the possibility of such damage"
        for holder in ("holder", "holders", "owner")
    ),
    "IscAsIs": (
        "the software is provided as is and the author disclaims all warranties with regard to"
        " this software including all implied warranties of merchantability and fitness",
    ),
    "ApacheCopyAt": (
        "you may obtain a copy of the license at",
        "you may obtain a copy of the license at http://www.apache.org/licenses/license-#",
        "you may obtain a copy of the license at https://www.apache.org/licenses/license-#",
    ),
    "ApacheUrl": (
        "http://www.apache.org/licenses/license-#",
        "https://www.apache.org/licenses/license-#",
    ),
    "ApacheAsIs": (
        "unless required by applicable law or agreed to in writing, software distributed under"
        " the license is distributed on an as is basis, without warranties or conditions of any"
        " kind, either express or implied",
    ),
    "ApacheSee": (
        "see the license for the specific language governing permissions and limitations under"
        " the license",
    ),
    "GplOnly": tuple(
        "this program is free software"
        f"{mark} you can redistribute it and/or modify it under the terms of the gnu general"
        f" public license{comma} version #{comma} as published by the free software foundation"
        for mark in ":;"
        for comma in ("", ",")
    ),
    "LgplFree": tuple(
        f"this {thing} is free software{mark} you can redistribute it and/or modify it under the"
        f" terms of the gnu lesser general public license as published by the free software"
        f" foundation{stop} either version # of the license, or (at your option) any later version"
        for thing in ("library", "program")
        for mark, stop in ((":", ","), (";", ";"))
    ),
    "AgplFree": tuple(
        f"this program is free software{mark} you can redistribute it and/or modify it under the"
        f" terms of the gnu affero general public license as published by the free software"
        f" foundation, either version # of the license, or (at your option) any later version"
        for mark in ":;"
    ),
    "GnuHope": tuple(
        f"this {thing} is distributed in the hope that it will be useful, but without any"
        " warranty; without even the implied warranty of merchantability or fitness for a"
        " particular purpose"
        for thing in ("program", "library")
    ),
    "GnuSee": tuple(
        f"see the gnu {kind}general public license for more details"
        for kind in ("", "lesser ", "affero ")
    ),
    "GnuCopy": tuple(
        f"you should have received a copy of the gnu {kind}general public license along with"
        f" this {thing}"
        for kind in ("", "lesser ", "affero ")
        for thing in ("program", "library")
    ),
    "GnuUrl": (
        "if not, see <https://www.gnu.org/licenses/>",
        "if not, see <http://www.gnu.org/licenses/>",
        "if not, see https://www.gnu.org/licenses/",
    ),
    "MplCopy": (
        "if a copy of the mpl was not distributed with this file, you can obtain one at"
        " https://mozilla.org/mpl/#/",
        "if a copy of the mpl was not distributed with this file, you can obtain one at"
        " http://mozilla.org/mpl/#/",
    ),
    "ZlibAsIs": (
        "this software is provided as-is, without any express or implied warranty",
    ),
    "ZlibNoLiability": (
        "in no event will the authors be held liable for any damages arising from the use of"
        " this software",
    ),
    "ZlibPermission": (
        "permission is granted to anyone to use this software for any purpose, including"
        " commercial applications, and to alter it and redistribute it freely, subject to the"
        " following restrictions",
    ),
    "ZlibOrigin": (
        "the origin of this software must not be misrepresented; you must not claim that you"
        " wrote the original software",
    ),
    "ZlibMarked": (
        "altered source versions must be plainly marked as such, and must not be misrepresented"
        " as being the original software",
    ),
    "ZlibNotice": ("this notice may not be removed or altered from any source distribution",),
    "BoostUnder": ("distributed under the boost software license, version #",),
    "BoostPermission": (
        "permission is hereby granted, free of charge, to any person or organization obtaining a"
        " copy of the software and accompanying documentation covered by this license (the"
        " software) to use, reproduce, display, distribute, execute, and transmit the software,"
        " and to prepare derivative works of the software, and to permit third-parties to whom"
        " the software is furnished to do so, all subject to the following",
    ),
    "Unencumbered": (
        "anyone is free to copy, modify, publish, use, compile, sell, or distribute this"
        " software, either in source code form or as a compiled binary, for any purpose,"
        " commercial or non-commercial, and by any means",
    ),
    "CcZero": (
        "to the extent possible under law, the author(s) have dedicated all copyright and"
        " related and neighboring rights to this software to the public domain worldwide",
        "released under cc0 #",
        "licensed under cc0 #",
    ),
}

_BSD_END = ("?BsdAsIs", "?BsdNoLiability")
_GNU_END = ("?GnuHope", "?GnuSee", "?GnuCopy", "?GnuUrl")
_APACHE_END = ("?ApacheCopyAt", "?ApacheUrl", "?ApacheAsIs", "?ApacheSee")
# Licences by the sentences that spell them, in order; those with a
# question mark may be missing. ``{}`` is the version. A rule of more sentences that
# must be there comes first; rules of as many, as listed.
RULES = (
    ("Zlib", ("ZlibAsIs", "ZlibNoLiability", "ZlibPermission", "?ZlibOrigin", "?ZlibMarked", "?ZlibNotice")),
    ("BSD-3-Clause", ("Redistribution", "SourceKeeps", "BinaryKeeps", "NoEndorsement", *_BSD_END)),
    ("BSD-2-Clause", ("Redistribution", "SourceKeeps", "BinaryKeeps", *_BSD_END)),
    ("MIT", ("Permission", "NoticeKept", "?MitAsIs", "?MitNoLiability")),
    ("Apache-{}", ("ApacheUnder", "ApacheFile", *_APACHE_END)),
    ("Unlicense", ("PublicDomain", "Unencumbered", "?MitAsIs", "?MitNoLiability")),
    ("Apache-{}", ("ApacheUnder",)),
    ("ISC", ("PermissionIsc", "?IscAsIs")),
    ("BSL-{}", ("BoostUnder",)),
    ("BSL-1.0", ("BoostPermission",)),
    ("CC0-1.0", ("CcZero",)),
    ("AGPL-{}-or-later", ("AgplFree", *_GNU_END)),
    ("LGPL-{}-or-later", ("LgplFree", *_GNU_END)),
    ("GPL-{}-only", ("GplOnly", *_GNU_END)),
    ("MIT", ("MitUnder",)),
    ("BSD-{}-Clause", ("BsdUnder",)),
    ("GPL-{}-or-later", ("GplFree", *_GNU_END)),
    ("GPL-{}", ("GplUnder",)),
    ("LGPL-{}", ("LgplUnder",)),
    ("MPL-{}", ("MplUnder", "?MplCopy")),
    ("CC-BY-{}", ("CcByUnder",)),
    ("CC-BY-SA-{}", ("CcBySaUnder",)),
    ("CC-BY-NC-{}", ("CcByNcUnder",)),
    ("CC-BY-ND-{}", ("CcByNdUnder",)),
    ("CC-BY-NC-SA-{}", ("CcByNcSaUnder",)),
    ("CC-BY-NC-ND-{}", ("CcByNcNdUnder",)),
    ("Public-Domain", ("PublicDomain",)),
    ("Proprietary", ("Reserved",)),
)

#: Every known sentence holds one of these, so a text without them holds none. None
#: has a blank, since blanks and line ends of a text are not yet normalised.
HINTS = (
    "licen", "permi", "distribut", "copyright", "domain", "software", "rights", "warrant",
    "released", "licensed",
)
#: Other known sentences that may stand between two of a rule.
GAP = 1

_KNOWN = {text: name for name, texts in SENTENCES.items() for text in texts}
_LINE_MARKS = re.compile(
    r"[ \t]*+(?:/\*+|\*+/|\*+|//+|#+|;+|--+|<!--|\"\"\"|\(?[a-z0-9]\)|[0-9]\.)?[ \t]*+", re.I
)
_END_MARKS = ("*/", "-->", '"""')
_VERSION = re.compile(r"(?<![\w.])v?([0-9]+(?:\.[0-9]+)*)(?![\w])")
#: A sentence ends at such a mark before a blank, or at an empty line.
_SENTENCE = re.compile(r"[.!?:;]+(?=\s)|\n(?=\n)")
_BLANKS = re.compile(r"\s+")
_QUOTE_MARKS = "\"'`“”‘’«»"
_QUOTES = str.maketrans("", "", _QUOTE_MARKS)


def without_marks(line: str) -> str:
    """The line without the marks of a comment or a list, and the blanks, at its sides."""
    line = line[_LINE_MARKS.match(line).end() :].rstrip(" \t\r")
    for mark in _END_MARKS:
        if line.endswith(mark):
            return line.removesuffix(mark).rstrip("*" if mark == "*/" else "").rstrip(" \t\r")
    return line


def normalised(sentence: str) -> tuple[str, str]:
    """The sentence as it is looked up, and the versions in it."""
    text = _BLANKS.sub(" ", sentence.translate(_QUOTES).lower()).strip(" .,:;!?-*")
    text = re.sub(r"\bcc[- ]by\b", "cc by", text).replace("licence", "license")
    versions = _VERSION.findall(text)
    return _VERSION.sub("#", text), "-".join(versions)


def _known(sentences: Iterator[str]) -> list[tuple[str, str]]:
    found = []
    for sentence in sentences:
        text, version = normalised(sentence)
        if name := _KNOWN.get(text):
            found.append((name, version))
    return found


def _joined_sentences(text: str) -> Iterator[str]:
    """Sentences that may run over several lines.

    A semicolon or colon within a known sentence would part it, so every stretch
    of up to three parts is tried, the longest first.
    """
    at, ends = 0, [*(match.end() for match in _SENTENCE.finditer(text)), len(text)]
    number = 0
    while number < len(ends):
        for more in (2, 1, 0):
            last = min(number + more, len(ends) - 1)
            part = text[at : ends[last]]
            if more == 0 or normalised(part)[0] in _KNOWN:
                break
        yield part
        at, number = ends[last], last + 1


def sentence_ids(text: str) -> list[tuple[str, str]]:
    """Known sentences of a text in order, each with its version.

    The text is read by lines and by sentences over lines; the reading that knows
    more of it counts, of equals the one by lines.
    """
    bare = "\n".join(map(without_marks, text.split("\n")))
    lines = (part for line in bare.split("\n") for part in _joined_sentences(line))
    by_line = _known(lines)
    by_sentence = _known(_joined_sentences(bare))
    return by_sentence if len(by_sentence) > len(by_line) else by_line


def _spelling(wanted: tuple[str, ...]) -> re.Pattern[str]:
    """A rule as a pattern of letters, one for each sentence."""
    parts = []
    for number, name in enumerate(wanted):
        letter = _LETTER[name.removeprefix("?")]
        part = f"(?:.{{0,{GAP}}}?({letter}))" if number else f"({letter})"
        parts.append(part + "?" * name.startswith("?"))
    return re.compile("".join(parts), re.S)


_LETTER = {name: chr(0xE000 + number) for number, name in enumerate(SENTENCES)}
_CLAIMED = "-"
_BY_LENGTH = sorted(RULES, key=lambda rule: -sum(not name.startswith("?") for name in rule[1]))
_SPELLINGS = [(licence, _spelling(wanted)) for licence, wanted in _BY_LENGTH]


def match_rules(sentences: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """Licences in order of appearance without repeats, and sentences no rule claims.

    Rules are tried in their order, each from the first sentence on. A rule claims the
    sentences it is spelt with; up to ``GAP`` others, claimed or not, may stand between
    two of them.
    """
    line = "".join(_LETTER[name] for name, _ in sentences)
    found: list[tuple[int, str]] = []
    for licence, spelling in _SPELLINGS:
        claimed: set[int] = set()
        match = spelling.search(line)
        while match:
            places = [match.start(n) for n in range(1, spelling.groups + 1) if match[n]]
            if not claimed.isdisjoint(places):  # this rule has taken some of them already
                line = "".join(_CLAIMED if at in claimed else c for at, c in enumerate(line))
                match = spelling.search(line, match.start())
                continue
            claimed.update(places)
            version = next((sentences[at][1] for at in places if sentences[at][1]), "")
            found.append((places[0], licence.format(version)))
            match = spelling.search(line, match.start() + 1)
        line = "".join(_CLAIMED if at in claimed else c for at, c in enumerate(line)) if claimed else line
    licences = list(dict.fromkeys(name for _, name in sorted(found)))
    return licences, [name for (name, _), c in zip(sentences, line) if c != _CLAIMED]


def _hinted(text: str) -> bool:
    low = text.lower()
    for mark in _QUOTE_MARKS:
        low = low.replace(mark, "")
    return any(hint in low for hint in HINTS)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strings = pa.list_(pa.string())
    for batch in batches:
        rows = []
        for text in batch.column(1):
            text = text.as_py() or ""
            ids = sentence_ids(text) if _hinted(text) else []
            rows.append(([name for name, _ in ids], *match_rules(ids)))
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(column, strings) for column in columns)],
            ["doc_id", "sentence_ids", "licences", "unclaimed"],
        )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``sentence_ids``, ``licences`` and ``unclaimed`` of every document.

    Reads ``doc_id`` and ``text``; other columns are not read. ``sentence_ids`` are
    the known licence sentences in order, ``licences`` what they spell, and
    ``unclaimed`` those that no rule claims. Whole texts are read.

    A document without known sentences has empty lists, as have NULL and empty
    texts. Repeated rows stay; an empty table gives no rows. Nothing is shuffled.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _scan,
        "doc_id long, sentence_ids array<string>, licences array<string>, unclaimed array<string>",
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))
