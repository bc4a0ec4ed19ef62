"""License scans with ordered signature rules.

A text is read as lower-case words joined by single blanks, so punctuation and line breaks do
not matter. Every rule has keywords; its pattern runs only if the text has one of them. Hits
are ordered by priority, and one that lies within an accepted hit of higher priority is dropped:
an SPDX tag hides the bare name inside it, a version hides the family.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsight.llm.stored import by_place, extended, plain

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = (
    "n_words long, base_places array<struct<label: string, word: long>>, "
    "hits array<struct<label: string, rule: string, first_word: long, last_word: long, score: double>>, score double"
)

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label of a family, words of which every name has one, pattern of the name, versions.
FAMILIES = [
    ("gpl", "general gpl", "(?:gnu )?(?:general public license|gpl)", ["1.0", "2.0", "3.0"]),
    ("lgpl", "general lgpl", "(?:gnu )?(?:(?:lesser|library) general public license|lgpl)", ["2.0", "2.1", "3.0"]),
    ("agpl", "affero agpl", "(?:gnu )?(?:affero general public license|agpl)", ["1.0", "3.0"]),
    ("gfdl", "documentation gfdl", "(?:gnu )?(?:free documentation license|gfdl)", ["1.1", "1.2", "1.3"]),
    ("apache", "apache", "apache(?: software)?(?: license)?", ["1.0", "1.1", "2.0"]),
    ("mpl", "mozilla mpl", "(?:mozilla public license|mpl)", ["1.0", "1.1", "2.0"]),
    ("epl", "eclipse epl", "(?:eclipse public license|epl)", ["1.0", "2.0"]),
    ("cpl", "common", "common public license", ["1.0"]),
    ("cddl", "distribution cddl", "(?:common development and distribution license|cddl)", ["1.0", "1.1"]),
    ("eupl", "european eupl", "(?:european union public licen[cs]e|eupl)", ["1.0", "1.1", "1.2"]),
    ("artistic", "artistic", "artistic license", ["1.0", "2.0"]),
    ("ofl", "font ofl", "(?:sil )?(?:open font license|ofl)", ["1.0", "1.1"]),
    ("bsl", "boost bsl", "(?:boost software license|bsl)", ["1.0"]),
    ("afl", "academic afl", "(?:academic free license|afl)", ["2.1", "3.0"]),
    ("osl", "software osl", "(?:open software license|osl)", ["2.1", "3.0"]),
    ("ecl", "educational", "educational community license", ["1.0", "2.0"]),
    ("lppl", "latex lppl", "(?:latex project public license|lppl)", ["1.2", "1.3"]),
    ("php", "php", "php license", ["3.0", "3.01"]),
    ("zpl", "zope zpl", "(?:zope public license|zpl)", ["2.0", "2.1"]),
    ("cecill", "cecill", "cecill", ["1.0", "2.0", "2.1"]),
    ("odbl", "database odbl", "(?:open database license|odbl)", ["1.0"]),
    ("odc-by", "commons odc", "(?:open data commons attribution license|odc by)", ["1.0"]),
    ("pddl", "dedication pddl", "(?:public domain dedication and license|pddl)", ["1.0"]),
    ("cc-by", "creative cc", "(?:creative commons attribution|cc by)(?: (?:license|international|unported))?", ["2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-sa", "creative cc", "(?:creative commons attribution share ?alike|cc by sa)(?: license)?", ["2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nd", "creative cc", "(?:creative commons attribution no ?deriv(?:ative)?s|cc by nd)(?: license)?", ["2.0", "3.0", "4.0"]),
    ("cc-by-nc", "creative cc", "(?:creative commons attribution non ?commercial|cc by nc)(?: license)?", ["2.0", "3.0", "4.0"]),
    ("cc-by-nc-sa", "creative cc", "(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: license)?", ["2.0", "3.0", "4.0"]),
    ("cc-by-nc-nd", "creative cc", "(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd)(?: license)?", ["3.0", "4.0"]),
    ("cc0", "creative cc", "(?:creative commons zero|cc0|cc 0)", ["1.0"]),
    ("mit", "mit expat", "(?:mit|expat) license", []),
    ("mit-0", "mit", "mit no attribution", []),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd license)", []),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", []),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)", []),
    ("0bsd", "bsd", "(?:0bsd|zero clause bsd)", []),
    ("bsd", "bsd", "bsd(?: style)? license", []),
    ("isc", "isc", "isc license", []),
    ("zlib", "zlib", "zlib(?: libpng)? license", []),
    ("unlicense", "unlicense", "unlicense", []),
    ("wtfpl", "wtfpl fuck", "(?:wtfpl|do what the fuck you want to public license)", []),
    ("postgresql", "postgresql", "postgresql license", []),
    ("psf", "python psf", "(?:python software foundation license|psf license)", []),
    ("ruby", "ruby", "ruby license", []),
    ("openssl", "openssl", "openssl license", []),
    ("x11", "x11", "x11 license", []),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source license", []),
    ("ms-pl", "microsoft ms", "(?:microsoft public license|ms pl)", []),
    ("ms-rl", "microsoft ms", "(?:microsoft reciprocal license|ms rl)", []),
    ("upl", "universal", "universal permissive license", []),
    ("vim", "vim", "vim license", []),
    ("sleepycat", "sleepycat", "sleepycat license", []),
    ("qpl", "public", "q public license", []),
    ("json", "json", "json license", []),
    ("public-domain", "domain", "(?:placed|released) (?:in|into) the public domain", []),
    ("proprietary", "proprietary", "(?:proprietary and confidential|confidential and proprietary)", []),
]

# Phrases from license texts, and addresses, as normalised words.
PASSAGES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("zlib", "this software is provided as is without any express or implied warranty"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("apache-2.0", "apache org licenses license 2 0"),
    ("mit", "opensource org licenses mit"),
    ("cc-by", "creativecommons org licenses by"),
    ("cc-by-sa", "creativecommons org licenses by sa"),
    ("cc-by-nc", "creativecommons org licenses by nc"),
    ("cc0", "creativecommons org publicdomain zero"),
    ("gpl", "gnu org licenses gpl"),
    ("lgpl", "gnu org licenses lgpl"),
    ("agpl", "gnu org licenses agpl"),
    ("mpl", "mozilla org mpl"),
]

# Label, keyword, and the words of a notice as license texts and file headers have them.
NOTICES = [
    ("apache-2.0", "compliance", "you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache-2.0", "basis", "software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "contributor", "licensed to .{1,80}? under one or more contributor license agreements"),
    ("apache-1.1", "apache", "this product includes software developed by the apache (?:software foundation|group)"),
    ("gpl-1.0-or-later", "option", "(?:gnu )?general public license .{0,60}?either version 1 (?:of the license )?or at your option any later version"),
    ("gpl-2.0-or-later", "option", "(?:gnu )?general public license .{0,60}?either version 2 (?:of the license )?or at your option any later version"),
    ("gpl-3.0-or-later", "option", "(?:gnu )?general public license .{0,60}?either version 3 (?:of the license )?or at your option any later version"),
    ("gpl-2.0-only", "general", "gnu general public license version 2 (?:only|as published by the free software foundation)"),
    ("gpl-3.0-only", "general", "gnu general public license version 3 (?:only|as published by the free software foundation)"),
    ("gpl", "gnu", "you should have received a copy of the gnu general public license"),
    ("gpl", "hope", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl", "hope", "this library is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl", "lesser", "you should have received a copy of the gnu lesser general public license"),
    ("lgpl-2.1-or-later", "lesser", "(?:gnu )?lesser general public license .{0,60}?either version 2 1 (?:of the license )?or at your option any later version"),
    ("lgpl-3.0-or-later", "lesser", "(?:gnu )?lesser general public license .{0,60}?either version 3 (?:of the license )?or at your option any later version"),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public license"),
    ("agpl-3.0-or-later", "affero", "(?:gnu )?affero general public license .{0,60}?either version 3 (?:of the license )?or at your option any later version"),
    ("gpl-classpath-exception", "independent", "as a special exception .{0,120}?permission to link this library with independent modules"),
    ("gfdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mit", "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "merchantability", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("x11", "advertising", "the name of .{1,60}? shall not be used in advertising or otherwise to promote the sale use or other dealings"),
    ("bsd-2-clause", "retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "endorse", "neither the names? of .{1,80}? may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "code", "use of this source code is governed by a bsd style license that can be found in the license file"),
    ("isc", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "fee", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee"),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("bsl-1.0", "organization", "free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("mpl-2.0", "subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "contents", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl-2.0", "accompanying", "the accompanying materials are made available under the terms of the eclipse public license v? ?2 0"),
    ("cddl", "contents", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl", "european", "licensed under the eupl .{0,40}?as soon (?:as )?they will be approved by the european commission"),
    ("artistic", "perl", "you can redistribute it and or modify it under the same terms as perl(?: itself)?"),
    ("php-3.01", "php", "this source file is subject to version 3 01 of the php license"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1"),
    ("ncsa", "illinois", "developed by .{1,80}? university of illinois"),
    ("ms-pl", "governs", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("unlicense", "anyone", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "verbatim", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("beerware", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("cc0", "waived", "to the extent possible under law .{1,80}? waived all copyright and related or neighboring rights"),
    ("cc-by-4.0", "creative", "this work is licensed under (?:a |the )?creative commons attribution 4 0 international(?: license)?"),
    ("cc-by-sa-4.0", "creative", "this work is licensed under (?:a |the )?creative commons attribution sharealike 4 0 international(?: license)?"),
    ("cc-by-sa-3.0", "creative", "text is available under the creative commons attribution sharealike"),
    ("odbl", "database", "made available under the open database license"),
    ("public-domain", "government", "work of the united states government"),
    ("public-domain", "domain", "(?:is|are|has been|have been) (?:hereby )?(?:placed |released |dedicated )?(?:in|into|to) the public domain"),
    ("sspl-1.0", "server", "server side public license"),
    ("busl-1.1", "business", "business source license(?: 1 1)?"),
    ("elastic-2.0", "elastic", "elastic license(?: 2 0| v2)?"),
    ("commons-clause", "clause", "commons clause license condition"),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|perimeter|strict|free trial|internal use) license"),
    ("openrail", "rail", "(?:creativeml |bigscience |bigcode )?open ?rail(?: [ms])? license"),
    ("llama", "llama", "llama [234](?: [0-9])? community license(?: agreement)?"),
    ("proprietary", "prohibited", "unauthorized (?:copying|use|reproduction|distribution)(?: \\S+){0,12}? (?:is )?strictly prohibited"),
    ("proprietary", "consent", "may not be (?:copied|reproduced|distributed|disclosed)(?: \\S+){0,12}? without (?:the )?(?:express |prior )*(?:written )?(?:permission|consent)"),
    ("proprietary", "secret", "this (?:file|document|software) contains (?:confidential|proprietary)(?: \\S+){0,6}? (?:information|trade secrets)"),
]

# Kind of rule, pattern around a name, priority, score.
FORMS = [
    ("tag", "spdx license identifier {id}", 5, 1.0),
    ("notice", "(?:licensed|released|distributed|available|covered|published) under (?:the )?(?:terms of (?:the )?)?{name}", 4, 0.9),
    ("name", "{name}", 2, 0.7),
]


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern
    priority: int
    score: float


def rules() -> list[Rule]:
    """All rules, highest priority first: each family and version in each form, passages and notices."""
    made = []

    def add(label: str, kind: str, pattern: str, keywords: tuple[bytes, ...], priority: int, score: float) -> None:
        made.append(Rule(label, kind, keywords, re.compile(rb"(?<!\S)" + pattern.encode() + rb"(?!\S)"), priority, score))

    for family, words, name, versions in FAMILIES:
        named = tuple(words.encode().split())
        for kind, form, priority, score in FORMS:
            spelled = family.replace("-", " ")
            tagged = (b"spdx",)
            add(family, kind, form.format(name=name, id=spelled), tagged if kind == "tag" else named, priority, score - 0.1)
            for version in versions:
                major, minor = version.split(".")
                number = f"(?: license)?(?: version| v)? ?v?{major}" + (f"(?: {minor})?" if minor == "0" else f" {minor}")
                exact = f"{spelled} {major} {minor}(?: only| or later)?"
                add(
                    f"{family}-{version}", kind, form.format(name=name + number, id=exact),
                    tagged if kind == "tag" else named, priority + 1, score,
                )
    for label, passage in PASSAGES:
        longest = max(passage.split(), key=len).encode()
        add(label, "passage", passage, (longest,), 4, 0.95)
    for label, keyword, notice in NOTICES:
        add(label, "notice text", notice, (keyword.encode(),), 7, 1.0)
    return sorted(made, key=lambda r: -r.priority)


def _letters() -> bytes:
    """Byte for byte: capitals to small letters, whatever is no part of a word to a blank."""
    table = bytearray(b" " * 256)
    for code in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        table[code] = code
    for code in range(0x41, 0x5B):
        table[code] = code + 32
    return bytes(table)


class Scanner:
    def __init__(self):
        self.rules = rules()
        self.letters = _letters()
        self.words = sorted({k for r in self.rules for k in r.keywords})
        self.base = {phrase.encode(): label for phrase, label in BASE.items()}

    def scan(self, text: bytes) -> tuple[int, list[dict], list[dict], float]:
        """Number of words, base places, hits and the score of a text."""
        words = text.translate(self.letters).split()
        line = b" ".join(words)
        padded = b" " + line + b" "
        found: list[tuple[int, str]] = []
        for phrase, label in self.base.items():
            sought, at = b" " + phrase + b" ", -1
            while (at := padded.find(sought, at + 1)) >= 0:
                found.append((at, label))
        present = {k for k in self.words if k in line}
        spans: list[tuple[int, int, Rule]] = []
        if present:
            for rule in self.rules:
                if present.intersection(rule.keywords):
                    spans += [(*m.span(), rule) for m in rule.pattern.finditer(line)]
        # A word's number is the number of blanks before it.
        blanks = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 0x20) if found or spans else None
        places = [{"label": label, "word": int(np.searchsorted(blanks, at))} for at, label in found]
        hits = [
            {
                "label": rule.label, "rule": rule.kind, "first_word": int(np.searchsorted(blanks, a)),
                "last_word": int(np.searchsorted(blanks, b)), "score": rule.score,
            }
            for a, b, rule in uncovered(spans)
        ]
        score = max([0.6 * bool(places), *[h["score"] for h in hits]])
        return len(words), places, hits, score


def uncovered(spans: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Spans that do not lie within one of higher priority, or a longer one of the same.

    Accepted spans are kept in the order of their starts with the furthest end so far.
    """
    accepted: list[tuple[int, int, Rule]] = []
    by_priority: dict[int, list[tuple[int, int, Rule]]] = {}
    for span in spans:
        by_priority.setdefault(span[2].priority, []).append(span)
    for priority in sorted(by_priority, reverse=True):
        group = sorted(by_priority[priority], key=lambda s: (s[0], -s[1], s[2].label))
        higher = sorted((a, b) for a, b, _ in accepted)
        at, reach, own = 0, -1, -1
        for a, b, rule in group:
            while at < len(higher) and higher[at][0] <= a:
                reach = max(reach, higher[at][1])
                at += 1
            if b > reach and b > own:
                accepted.append((a, b, rule))
                own = b
    return sorted(accepted, key=lambda s: (s[0], s[1], s[2].label))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, plus n_words, base_places, hits and score.

    A map without a shuffle. A null or empty text has no words and score 0; repeated rows are
    scanned one by one, an empty table stays empty. Columns named like a new one are replaced.
    """
    fresh = ("n_words", "base_places", "hits", "score")
    carried = [c for c in docs.columns if c != text and c not in fresh]
    source = by_place(docs, carried, __text=F.coalesce(F.col(plain(text)), F.lit("")).cast("binary"))
    out = extended(source, SCHEMA, without=("__text",))
    names = out.names
    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    hit = pa.list_(pa.struct([
        ("label", pa.string()), ("rule", pa.string()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("score", pa.float64()),
    ]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            found = [scanner.scan(t.as_py()) for t in batch.column(at)]
            words, places, hits, scores = zip(*found) if found else ([], [], [], [])
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([
                *columns, pa.array(words, pa.int64()), pa.array(places, place), pa.array(hits, hit),
                pa.array(scores, pa.float64()),
            ], names=names)

    return source.mapInArrow(scanned, out).toDF(*carried, *fresh)
