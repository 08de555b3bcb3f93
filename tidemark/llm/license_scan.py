"""Licence scans by sentence rules.

A text's sentences are normalised and looked up among known licence sentences.
Texts are cut at stops, semicolons and line ends; a sentence is then as many
neighbouring pieces as make a known one, so that wrapped lines, comment markers
and blank lines inside it don't matter.
Runs of identifiers are then matched against ordered rules: a rule is a
sequence of identifiers that must come in its order, with at most a few other
sentences between neighbours; the first rule that matches at a place wins, and
its sentences are used up. Sentence lookup is a dictionary of normalised text,
with patterns for sentences that hold a version or a name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import frugal, parts

#: Sentences that may lie between two of a rule's sentences.
GAP = 2

#: Known sentences by identifier, normalised: lower case, runs of anything but letters and digits made one space. Fixed values.
SENTENCES = {
    "apache-2.0-short": "licensed under the apache license version 2 0",
    "apache-2.0-may-not-use": "you may not use this file except in compliance with the license",
    "apache-2.0-obtain": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-2.0-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2.0-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-short": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-short": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-no-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "boost": "distributed under the boost software license version 1 0",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "epl-2.0": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "lgpl-library": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "reserved": "all rights reserved",
    "public-domain": "this work is in the public domain",
}
#: Other wordings of the same sentences.
VARIANTS = {
    "licensed under the apache license version 2 0 the license": "apache-2.0-defined",
    "the asf licenses this file to you under the apache license version 2 0 the license": "apache-2.0-defined",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-2.0-obtain",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non infringement": "mit-as-is",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-copy",
}
#: Sentences with a changing part, on the normalised form.
PATTERNS = {
    "cc": r"(?:this (?:work|page|article) is )?licensed under (?:a )?(?:cc|creative commons) (?P<kind>by(?: (?:nc|nd|sa))*|0) (?P<version>[0-9] [0-9])(?: international| unported)?(?: license)?",
    "cc-long": r"(?:this (?:work|page|article) is )?(?:licensed under (?:a |the )?)?creative commons (?P<kind>attribution(?: (?:noncommercial|non commercial|noderivatives|noderivs|no derivatives|sharealike|share alike))*|zero|cc0) (?P<version>[0-9] [0-9])(?: international| unported| universal| generic)?(?: public)?(?: licen[sc]e)?",
    "gpl-later": r"(?:this \w+|\w+) is free software you can redistribute it and or modify it under the terms of the gnu (?P<kind>lesser |library |affero )?general public license as published by the free software foundation either version (?P<version>[0-9](?: [0-9])?) of the license or at your option any later version",
    "gpl": r"(?:this (?:work|file|program) is )?licensed under the gnu (?P<kind>lesser |affero )?general public license version (?P<version>[0-9](?: [0-9])?)",
    "spdx": r"spdx license identifier (?P<kind>[a-z0-9 ]+)",
    "copyright": r"copyright (?:c )?(?P<version>[0-9]{4})(?: [0-9]{4})? [\w ]+",
}


@dataclass(frozen=True)
class Rule:
    licence: str
    sentences: tuple[str, ...]


#: Ordered: longer texts before their own short forms.
RULES = (
    Rule("Apache-2.0", ("apache-2.0-short", "apache-2.0-may-not-use", "apache-2.0-obtain", "apache-2.0-as-is", "apache-2.0-see")),
    Rule("Apache-2.0", ("apache-2.0-defined", "apache-2.0-may-not-use", "apache-2.0-obtain", "apache-2.0-as-is", "apache-2.0-see")),
    Rule("Apache-2.0", ("apache-2.0-defined", "apache-2.0-may-not-use")),
    Rule("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    Rule("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    Rule("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    Rule("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is")),
    Rule("BSD", ("bsd-redistribution",)),
    Rule("ISC", ("isc-grant", "isc-as-is")),
    Rule("ISC", ("isc-grant",)),
    Rule("Unlicense", ("unlicense",)),
    Rule("BSL-1.0", ("boost",)),
    Rule("Zlib", ("zlib-grant",)),
    Rule("EPL-2.0", ("epl-2.0",)),
    Rule("GPL-3.0-or-later", ("gpl-free", "gpl-no-warranty")),
    Rule("GPL-3.0-or-later", ("gpl-free",)),
    Rule("Apache-2.0", ("apache-2.0-short",)),
    Rule("MIT", ("mit-short",)),
    Rule("MIT", ("mit-licensed",)),
    Rule("GPL-3.0", ("gpl-short",)),
    Rule("MPL-2.0", ("mpl-2.0", "mpl-copy")),
    Rule("MPL-2.0", ("mpl-2.0",)),
    Rule("public-domain", ("public-domain",)),
    Rule("{gpl-later}", ("gpl-later", "gpl-no-warranty")),
    Rule("{gpl-later}", ("gpl-later", "lgpl-library")),
    Rule("{gpl-later}", ("gpl-later",)),
    Rule("{gpl}", ("gpl",)),
    Rule("{cc}", ("cc",)),
    Rule("{cc-long}", ("cc-long",)),
    Rule("{spdx}", ("spdx",)),
    Rule("all-rights-reserved", ("copyright", "reserved")),
    Rule("all-rights-reserved", ("reserved",)),
)

#: The rules by their first sentence, in order.
_RULES_FROM: dict[str, list[Rule]] = {}
for _rule in RULES:
    _RULES_FROM.setdefault(_rule.sentences[0], []).append(_rule)

_BY_TEXT = {text: name for name, text in SENTENCES.items()} | VARIANTS
_PATTERNS = {name: re.compile(p) for name, p in PATTERNS.items()}
#: Beginnings of known sentences, word by word.
_BEGINNINGS = {" ".join(w[:k]) for w in (t.split() for t in _BY_TEXT) for k in range(1, len(w) + 1)}
#: Pieces that a sentence with a changing part may have; those of one line have one.
_PIECES = {"cc": 4, "cc-long": 4, "gpl-later": 8, "gpl": 4, "spdx": 1, "copyright": 1}
#: A piece ends at a line's end, a semicolon, or at a stop before white space; a stop inside a number ends none.
_PIECE = re.compile(r"[^\n.!?;]*(?:[.!?](?!\s|\Z)[^\n.!?;]*)*[.!?;]*")
#: What may stand before a comment's words on each line, besides signs.
_MARKER = re.compile(r"\s*(?:rem|dnl)\s", re.IGNORECASE)
_NOT_WORD = re.compile(r"[^\w]+|_+")
#: What any known sentence holds; other texts are not split.
_WORTH = re.compile(r"licen[sc]|copyright|rights reserved|permission is hereby|public domain|redistribut|warrant|spdx|copyright notice|free software|mozilla public|creative commons", re.IGNORECASE)


def normalised(sentence: str) -> str:
    return _NOT_WORD.sub(" ", sentence.lower()).strip()


def _named(name: str, m: re.Match) -> str:
    """The licence that a sentence's changing part names."""
    part = m.groupdict()
    kind, version = (part.get("kind") or "").strip(), (part.get("version") or "").replace(" ", ".")
    if name == "cc":
        return f"CC{kind.replace(' ', '-').upper() if kind == '0' else '-' + kind.replace(' ', '-').upper()}-{version}"
    if name == "cc-long":
        if kind in ("zero", "cc0"):
            return f"CC0-{version}"
        parts = ["BY", *(k for k, words in (("NC", ("noncommercial", "non commercial")), ("ND", ("noderiv", "no deriv")), ("SA", ("sharealike", "share alike"))) if any(w in kind for w in words))]
        return f"CC-{'-'.join(parts)}-{version}"
    if name in ("gpl", "gpl-later"):
        full = {"": "GPL", "lesser": "LGPL", "library": "LGPL", "affero": "AGPL"}[kind] + "-" + (version if "." in version else version + ".0")
        return full + ("-or-later" if name == "gpl-later" else "")
    return kind.replace(" ", "-").upper()


def identify(sentence: str, pieces: int = 1) -> tuple[str, str] | None:
    """The identifier of a sentence, and the licence its changing part names, or None."""
    text = normalised(sentence)
    if text in _BY_TEXT:
        return _BY_TEXT[text], ""
    for name, pattern in _PATTERNS.items():
        m = pattern.fullmatch(text) if pieces <= _PIECES[name] else None
        if m:
            return name, _named(name, m)
    return None


def _sentence_at(pieces: list[tuple[str, int, int, bool]], at: int) -> tuple[tuple[str, str], int] | None:
    """The longest known sentence of pieces from a place on, and the place after it."""
    best, text, most = None, "", max(_PIECES.values())
    for k in range(at, len(pieces)):
        text = f"{text} {pieces[k][0]}" if text else pieces[k][0]
        beginning = text in _BEGINNINGS
        if not beginning and k - at >= most:
            break
        found = identify(text, k - at + 1)
        if found:
            best = found, k + 1
    return best


def scan_text(text: str | None) -> list[tuple[str, int, int]]:
    """(licence, start, end) of the matches in a text, by start; code points, end exclusive."""
    if not text or not _WORTH.search(text):
        return []
    pieces = []  # (normalised, start, end, whether a sentence ends here)
    for m in _PIECE.finditer(text):
        raw, start = m[0], m.start()
        marker = _MARKER.match(raw) if start == 0 or text[start - 1] == "\n" else None
        if marker:
            raw, start = raw[marker.end() :], start + marker.end()
        words = normalised(raw)
        if words:
            body = raw.lstrip()
            lead = len(raw) - len(body)
            if start == 0 or text[start - 1] == "\n" or marker:
                signs = re.match(r"(?:[/*#;%!|>-]|<!--)+\s+", body)  # a comment's
                lead += signs.end() if signs else 0
            pieces.append((words, start + lead, start + len(raw.rstrip()), raw.rstrip()[-1] in ".!?"))
        elif pieces and text[m.start() - 1 : m.start()] == "\n":
            pieces[-1] = (*pieces[-1][:3], True)  # a blank line
    known = []  # (number of the sentence, identifier, named licence, start, end)
    at = number = 0
    while at < len(pieces):
        found = _sentence_at(pieces, at)
        if found:
            (name, named), after = found
            known.append((number + 1, name, named, pieces[at][1], pieces[after - 1][2]))
            number += 1
            at = after
        else:
            number += pieces[at][3]
            at += 1
    out, used = [], set()
    for at in range(len(known)):
        for rule in _RULES_FROM.get(known[at][1], ()) if at not in used else ():
            taken = _sequence(rule, known, at, used)
            if taken:
                named = next((known[k][2] for k in taken if known[k][2]), "")
                out.append((named if rule.licence.startswith("{") else rule.licence, known[taken[0]][3], known[taken[-1]][4]))
                used.update(taken)
                break
    return out


def _sequence(rule: Rule, known: list[tuple], at: int, used: set[int]) -> list[int] | None:
    """The known sentences, from a place on, that match a rule; each is looked for among the GAP next sentences alone."""
    taken = [at]
    for want in rule.sentences[1:]:
        last = taken[-1]
        for k in range(last + 1, min(last + GAP + 2, len(known))):
            if known[k][0] - known[last][0] > GAP + 1:
                return None
            if k not in used and known[k][1] == want:
                taken.append(k)
                break
        else:
            return None
    return taken


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and matches (licence, start, end) of every row of ``docs``.

    ``docs`` has doc_id and text; other columns are ignored. Whole texts are
    read. Null and empty texts have no matches; repeated rows and null ids each
    give their row; an empty table gives an empty one.
    """
    def run(batches):
        kind = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in parts(batches, 1):
            found = [[{"licence": n, "start": a, "end": b} for n, a, b in scan_text(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "matches"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), "doc_id long, matches array<struct<licence: string, start: long, end: long>>")
