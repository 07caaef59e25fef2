"""License scans by ordered signature rules.

A text is read as words in lower case, joined by single spaces, so rules need not care for punctuation or line breaks.
Keywords pick the rules worth running. Each match is a detection with a priority; of overlapping detections the one of
higher priority stays, and one that lies inside another of at least its priority goes.
"""

import re
from typing import NamedTuple

from pyspark.sql import DataFrame

from gradeloom.llm.common import once, per_text

#: The phrases that always count, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Licenses by label, each with its keyword, the ways it is named, and its versions. Words as the scan
#: reads them; "" stands for a license without a version.
FAMILIES = (
    ("mit", "mit|expat|x11", r"mit|expat|x11", ("",)),
    ("apache", "apache", r"apache(?: software)?", ("2", "1 1", "1")),
    ("gpl", "gnu general public|gpl", r"gnu general public|gnu gpl|gpl", ("3", "2", "1")),
    ("lgpl", "lesser general public|library general public|lgpl",
     r"gnu (?:lesser|library) general public|gnu lgpl|lgpl", ("3", "2 1", "2")),
    ("agpl", "affero general public|agpl", r"gnu affero general public|gnu agpl|agpl", ("3", "1")),
    ("fdl", "free documentation|gfdl", r"gnu free documentation|gfdl", ("1 3", "1 2", "1 1")),
    ("mpl", "mozilla public|mpl", r"mozilla public|mpl", ("2", "1 1", "1")),
    ("epl", "eclipse public|epl", r"eclipse public|epl", ("2", "1")),
    ("eupl", "european union public|eupl", r"european union public|eupl", ("1 2", "1 1", "1")),
    ("cddl", "common development and distribution|cddl", r"common development and distribution|cddl", ("1 1", "1")),
    ("cpl", "common public", r"common public", ("1",)),
    ("ipl", "ibm public", r"ibm public", ("1",)),
    ("osl", "open software", r"open software", ("3", "2 1", "2", "1 1", "1")),
    ("afl", "academic free", r"academic free", ("3", "2 1", "2", "1 2", "1 1")),
    ("artistic", "artistic", r"(?:perl )?artistic", ("2", "1")),
    ("bsd-2-clause", "bsd|freebsd", r"(?:2|two) clause bsd|bsd 2 clause|simplified bsd|freebsd", ("",)),
    ("bsd-3-clause", "bsd", r"(?:3|three) clause bsd|bsd 3 clause|(?:new|modified|revised) bsd", ("",)),
    ("bsd-4-clause", "bsd", r"(?:4|four) clause bsd|bsd 4 clause|original bsd", ("",)),
    ("0bsd", "bsd|0bsd", r"zero clause bsd|0bsd", ("",)),
    ("isc", "isc", r"isc", ("",)),
    ("zlib", "zlib", r"zlib(?: libpng)?", ("",)),
    ("libpng", "libpng", r"libpng", ("2", "")),
    ("boost", "boost|bsl", r"boost(?: software)?|bsl", ("1",)),
    ("unlicense", "unlicense", r"unlicense", ("",)),
    ("wtfpl", "what the fuck you want|wtfpl", r"do what the fuck you want to public|wtfpl", ("2", "1")),
    ("postgresql", "postgresql", r"postgresql", ("",)),
    ("openssl", "openssl", r"openssl", ("",)),
    ("php", "php", r"php", ("3 01", "3")),
    ("python", "python software foundation|psf", r"python software foundation|psf", ("2",)),
    ("ruby", "ruby", r"ruby", ("",)),
    ("w3c", "w3c", r"w3c(?: software)?", ("",)),
    ("vim", "vim", r"vim", ("",)),
    ("ncsa", "ncsa", r"university of illinois ncsa|ncsa", ("",)),
    ("ofl", "open font|ofl", r"sil open font|open font|ofl", ("1 1", "1")),
    ("upl", "universal permissive", r"universal permissive", ("1",)),
    ("mulan", "mulan", r"mulan (?:permissive software|psl)", ("2", "1")),
    ("ecl", "educational community", r"educational community", ("2", "1")),
    ("ms-pl", "microsoft public|ms pl", r"microsoft public|ms pl", ("",)),
    ("ms-rl", "microsoft reciprocal|ms rl", r"microsoft reciprocal|ms rl", ("",)),
    ("zpl", "zope", r"zope public", ("2 1", "2", "1 1")),
    ("qpl", "q public", r"q public", ("1",)),
    ("sleepycat", "sleepycat", r"sleepycat", ("",)),
    ("lppl", "latex project", r"latex project public", ("1 3c", "1 2", "1 1", "1")),
    ("odbl", "open database|odbl", r"open database|odbl", ("1",)),
    ("odc-by", "open data commons", r"open data commons attribution", ("1",)),
    ("pddl", "public domain dedication", r"public domain dedication(?: and)?", ("1",)),
    ("sspl", "server side public|sspl", r"server side public|sspl", ("1",)),
    ("busl", "business source|busl", r"business source|busl", ("1 1", "1")),
    ("elastic", "elastic", r"elastic", ("2", "1")),
    ("llama", "llama", r"llama (?:2|3|3 1)? ?community", ("",)),
    ("openrail", "openrail|creativeml|bigscience|responsible ai", r"(?:bigscience|creativeml)? ?openrail(?: m)?|responsible ai", ("",)),
)

#: The parts of Creative Commons licenses, their words, and the versions in use.
CREATIVE = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s?"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
)
CREATIVE_VERSIONS = ("4", "3", "2 5", "2", "1")

#: Wordings of a text that names no license.
NOTICES = (
    ("all-rights-reserved", "all rights reserved", r"all rights reserved"),
    ("public-domain", "public domain", r"(?:released|dedicated|placed) (?:in|in ?to|to) the public domain"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
    ("mit", "permission is hereby granted free", r"permission is hereby granted free of charge to any person"),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software"),
    ("bsd", "redistribution and use in source", r"redistribution and use in source and binary forms"),
    ("unlicense", "free and unencumbered", r"free and unencumbered software released into the public domain"),
)

#: Sentences of license texts and notices, in words as the scan reads them: label, priority, the phrase that
#: must stand in a text for the rule to be run, the pattern, and a sample that it must find. ``{n}`` is a name of up to 12
#: words.
SIGNATURES = (
    ("gpl-3", 4, "gnu general public", r"terms of the gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e(?: or at your option any later version)?",
     "terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-2", 4, "gnu general public", r"terms of the gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e(?: or at your option any later version)?",
     "terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-2", 4, "gnu general public", r"terms of the gnu general public licen[cs]e version 2(?: only)? as published by the free software foundation",
     "terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("gpl", 2, "gnu general public", r"you should have received a copy of the gnu general public licen[cs]e",
     "You should have received a copy of the GNU General Public License"),
    ("lgpl-2.1", 4, "lesser general public", r"terms of the gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e",
     "terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("lgpl-3", 4, "lesser general public", r"terms of the gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e",
     "terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl-2", 4, "library general public", r"terms of the gnu library general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e",
     "terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("agpl-3", 4, "affero general public", r"terms of the gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e",
     "terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("fdl", 3, "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e",
     "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    ("mpl-2", 4, "mozilla public", r"this source code form is subject to the terms of the mozilla public licen[cs]e v(?: ?|ersion )2(?: 0)?",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-1.1", 4, "mozilla public", r"contents of this file are subject to the mozilla public licen[cs]e version 1 1",
     "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("epl-1", 4, "eclipse public", r"accompanying materials are made available under the terms of the eclipse public licen[cs]e v(?: ?|ersion )1(?: 0)?",
     "and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("epl-2", 4, "eclipse public", r"accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v(?: ?|ersion ))?2(?: 0)?",
     "and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("cddl", 3, "common development and distribution", r"contents of this file are subject to the terms of the common development and distribution licen[cs]e",
     "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("apache-2", 4, "you may not use this file", r"licen[cs]ed under the apache licen[cs]e version 2(?: 0)? the licen[cs]e you may not use this file except in compliance with the licen[cs]e",
     'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'),
    ("apache-2", 2, "unless required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis",
     'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS'),
    ("apache-2", 3, "under one or more contributor", r"licen[cs]ed to the {n} under one or more contributor licen[cs]e agreements",
     "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements"),
    ("bsd", 2, "redistributions of source code", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
     "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", 3, "redistribution and use in source", r"all rights reserved redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?",
     "All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-3-clause", 4, "endorse or promote products", r"neither the names? of {n} may be used to endorse or promote products derived from this software",
     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 4, "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment",
     "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("mit", 4, "associated documentation files", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
     'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("mit", 2, "substantial portions of the software", r"above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("isc", 4, "with or without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", 3, "this software and its documentation", r"permission to use copy modify (?:and )?(?:distribute|distribute and sell) this software and its documentation for any purpose",
     "Permission to use, copy, modify, distribute this software and its documentation for any purpose"),
    ("zlib", 4, "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
     "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("boost-1", 4, "see accompanying file", r"distributed under the boost software licen[cs]e version 1(?: 0)? see accompanying file licen[cs]e",
     "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt"),
    ("boost-1", 4, "person or organization obtaining", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation",
     "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", 4, "anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software",
     "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc0", 3, "related or neighboring rights", r"has waived all copyright and related or neighboring rights",
     "has waived all copyright and related or neighboring rights"),
    ("ofl-1.1", 4, "this font software", r"this font software is licen[cs]ed under the sil open font licen[cs]e version 1 1",
     "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("perl", 3, "same terms as perl", r"redistribute it and or modify it under the same terms as perl(?: itself)?",
     "you can redistribute it and/or modify it under the same terms as Perl itself"),
    ("wtfpl", 4, "verbatim or modified", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document and changing it is allowed",
     "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed"),
    ("some-rights-reserved", 1, "some rights reserved", r"some rights reserved", "Some rights reserved"),
    ("gpl", 3, "logiciel libre", r"ce programme est un logiciel libre vous pouvez le redistribuer et ou le modifier",
     "Ce programme est un logiciel libre ; vous pouvez le redistribuer et/ou le modifier"),
    ("gpl", 3, "freie software", r"dieses programm ist freie software sie können es unter den bedingungen der gnu general public license",
     "Dieses Programm ist freie Software. Sie können es unter den Bedingungen der GNU General Public License"),
    ("gpl", 3, "software libre", r"este programa es software libre (?:puede|usted puede) redistribuirlo y o modificarlo bajo los términos de la licencia pública general",
     "Este programa es software libre; puede redistribuirlo y/o modificarlo bajo los términos de la Licencia Pública General"),
    ("mit", 3, "mit", r"(?:sous(?: la)? licence|bajo(?: la)? licencia|sotto(?: la)? licenza|sob a licença) mit", "Ce code est sous licence MIT"),
    ("mit", 3, "mit lizenz", r"unter der mit lizenz", "Dieser Code steht unter der MIT-Lizenz"),
    ("all-rights-reserved", 0, "droits réservés", r"tous droits réservés", "Tous droits réservés"),
    ("all-rights-reserved", 0, "rechte vorbehalten", r"alle rechte vorbehalten", "Alle Rechte vorbehalten"),
    ("all-rights-reserved", 0, "derechos reservados", r"todos los derechos reservados", "Todos los derechos reservados"),
    ("all-rights-reserved", 0, "diritti riservati", r"tutti i diritti riservati", "Tutti i diritti riservati"),
    ("all-rights-reserved", 0, "direitos reservados", r"todos os direitos reservados", "Todos os direitos reservados"),
)
_NAME = r"[^ ]+(?: [^ ]+){0,11}"

_SEPARATORS = bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123))
_LOWER = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))
#: One of these, of ``SENTENCES``, or ``BARE`` stands in every text that a rule can match: a bare name counts with its version alone.
GATES = (b"licen", b"spdx", b"cc ", b"cc0", b"creative commons", b"rights reserved", b"public domain", b"proprietary",
         b"permission", b"redistribution", b"unencumbered")
BARE = re.compile(rb" v(?:ersion | ?)[0-9]")
#: The keywords of sentences that hold none of the words above.
SENTENCES = tuple({k.encode() for _, _, k, _, _ in SIGNATURES if k != "mit" and not any(g.decode() in k for g in GATES)})

STRENGTH = {4: 1.0, 3: 0.95, 2: 0.8, 1: 0.6, 0: 0.5}


class Rule(NamedTuple):
    priority: int
    label: str
    keywords: tuple[str, ...]
    pattern: re.Pattern


def _versioned(label: str, version: str) -> str:
    return f"{label}-{version.replace(' ', '.')}" if version else label


def _rule(priority: int, label: str, keywords: str, pattern: str) -> Rule:
    return Rule(priority, label, tuple(keywords.split("|")), re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])"))


def rules() -> list[Rule]:
    """All rules, highest priority first: identifiers and sentences of notices, grants, titles with a version, bare titles."""
    out = []
    for label, keywords, names, versions in FAMILIES:
        title = rf"(?:{names}) (?:public )?licen[cs]e"
        for version in versions:
            tail = rf"(?: version)?(?: v)? ?v?{version}(?: 0)?" if version else ""
            name = _versioned(label, version)
            identifier = (name if version else label).replace("-", " ").replace(".", " ")
            out.append(_rule(4, name, "spdx", rf"spdx licen[cs]e identifier {identifier}(?: 0)?(?: only| or later)?"))
            grant = rf"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?"
            out.append(_rule(3, name, keywords, rf"{grant}(?:{title}{tail}|(?:{names}){tail} licen[cs]e)"))
            if version:
                out.append(_rule(2, name, keywords, rf"(?:{title}|{names}) (?:version |v ?){version}(?: 0)?"))
        out.append(_rule(1, label, keywords, title))
    for label, short, long in CREATIVE:
        for version in ("", *CREATIVE_VERSIONS):
            tail = rf" {version}(?: 0)?" if version else ""
            name = _versioned(label, version)
            level = 3 if version else 2
            out.append(_rule(level, name, "cc", rf"(?:spdx licen[cs]e identifier )?cc {short}{tail}"))
            out.append(_rule(level, name, "creative commons", rf"creative commons {long}{tail}"))
            out.append(_rule(level, name, "creativecommons", rf"creativecommons org licenses {short}{tail}"))
    out += [_rule(0, label, keyword, pattern) for label, keyword, pattern in NOTICES]
    out += [_rule(level, label, keyword, pattern.replace("{n}", _NAME)) for label, level, keyword, pattern, _ in SIGNATURES]
    return sorted(out, key=lambda r: -r.priority)


class Detection(NamedTuple):
    start: int
    end: int
    priority: int
    label: str


def resolve(found: list[Detection]) -> list[Detection]:
    """Detections that stay: by priority, then length, then place, each unless it overlaps one that stays already.

    Places that are taken are marked, so the work grows with the text and the length of the detections.
    """
    kept: list[Detection] = []
    taken = bytearray(max((d.end for d in found), default=0))
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        if taken.find(1, d.start, d.end) < 0:
            taken[d.start : d.end] = b"\x01" * (d.end - d.start)
            kept.append(d)
    return sorted(kept)


def in_words(spaced: str, kept: list[Detection]) -> list[tuple[int, int]]:
    """First word and the word behind each of some detections that do not overlap, in one pass over the text."""
    out, seen, word = [], 0, 0
    for d in kept:
        word += spaced.count(" ", seen, d.start)
        first = word
        word += spaced.count(" ", d.start, d.end)
        seen = d.end
        out.append((first, word + 1))
    return out


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z only): runs of letters, digits and anything beyond ASCII."""
    return text.translate(_LOWER).split()


def places(joined: bytes, phrase: str) -> list[int]:
    """Numbers of the words at which a phrase starts; ``joined`` has a space on both ends."""
    wanted, out, at, word, seen = f" {phrase} ".encode(), [], joined.find(b" " + phrase.encode() + b" "), 0, 0
    while at >= 0:
        word += joined.count(b" ", seen, at)
        seen = at
        out.append(word)
        at = joined.find(wanted, at + 1)
    return out


def gated(joined: bytes) -> bool:
    """Whether any rule can match; without, no rule is run."""
    return any(g in joined for g in GATES) or any(k in joined for k in SENTENCES) or BARE.search(joined) is not None


def detections(joined: str, table: list[Rule]) -> list[Detection]:
    """What stays of the matches of all rules one of whose keywords begins at a word of the text."""
    found, padded, stands = [], f" {joined}", {}
    for rule in table:
        for k in rule.keywords:
            if k not in stands:
                stands[k] = f" {k}" in padded
        if any(stands[k] for k in rule.keywords):
            found += [Detection(m.start(), m.end(), rule.priority, rule.label) for m in rule.pattern.finditer(joined)]
    return resolve(found)


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Licenses of every whole text, beside the ``keep`` columns.

    ``n_words``; ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` of the fixed phrases; ``labels`` with
    those of the rules; ``score``, the strength of the best evidence (0 without any); ``detections``, the rules' kept
    matches as ``label:first word:end word``. A null text is empty. Nothing is shuffled; a text without a gate word or
    the version of a bare name costs one pass.
    """

    def measure(texts: list[bytes]):
        table, rows = once("licenses", "rules", rules), []
        for text in texts:
            words = words_of(text)
            spaced = b" ".join(words)
            hits, joined = [], b" " + spaced + b" "
            if b"license" in spaced or b"cc by nc" in spaced:
                hits = [(at, label) for phrase, label in PHRASES for at in places(joined, phrase)]
            kept = detections(spaced.decode("utf-8", "replace"), table) if gated(spaced) else []
            plain = spaced.decode("utf-8", "replace") if kept else ""
            base = {label for _, label in hits}
            starts = [at for at, _ in hits]
            at_word = in_words(plain, kept)
            strength = max([STRENGTH[d.priority] for d in kept] + [0.9] * bool(hits), default=0.0)
            rows.append((
                len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                ",".join(sorted(base | {d.label for d in kept})), strength,
                ",".join(f"{d.label}:{a}:{b}" for d, (a, b) in zip(kept, at_word)),
            ))
        return list(zip(*rows)) if rows else [[]] * 8

    schema = (
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "detections string"
    )
    return per_text(docs, measure, schema, list(keep))
