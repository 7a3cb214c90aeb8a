"""Signatures of license texts, notices, names and addresses, as patterns over words a-z, 0-9 joined by single spaces."""

from __future__ import annotations

import re

GRANTS = "licensed|released|distributed|available|published|provided|covered"
_UNDER = f"(?:(?:(?:{GRANTS}) )?under (?:the )?(?:terms of )?(?:the )?)?"


def _gap(most: int, never: str) -> str:
    """At most `most` characters of a text's middle, none of which begins `never`."""
    return rf"(?:(?!{never})[^\x00]){{0,{most}}}?"


_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
_DEAL = (
    "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
    "sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
)
_ISC = "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"
_HPND = "permission to use copy modify and distribute this software and its documentation for any purpose"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted"
_ENDORSE = "endorse or promote products derived from this software without specific prior written permission"
_ADVERTISE = "all advertising materials mentioning features or use of this software must display"

#: Fixed texts: label, keyword, pattern, priority, weight.
TEXTS = [
    ("mit", "permission", f"{_MIT}(?: {_DEAL})?", 3, 0.95),
    ("mit-0", "permission", f"{_MIT} {_DEAL} the software is provided as is", 3, 0.95),
    ("x11", "advertising", r"except as contained in this notice the names? of [^\x00]{1,120}? shall not be used in advertising", 3, 0.9),
    ("json", "evil", "the software shall be used for good not evil", 3, 0.95),
    ("isc", "permission", f"{_ISC}(?: provided that the above copyright notice and this permission notice appear in all copies)?", 3, 0.95),
    ("0bsd", "permission", f"{_ISC} the software is provided as is", 3, 0.95),
    ("hpnd", "permission", f"{_HPND}(?: and)?(?: without fee)? is hereby granted", 3, 0.9),
    ("postgresql", "permission", f"{_HPND} without fee and without a written agreement is hereby granted", 3, 0.95),
    ("bsd-2-clause", "redistribution", f"{_BSD}(?: provided that the following conditions are met)?", 3, 0.9),
    ("bsd-3-clause", "redistribution", f"{_BSD}{_gap(2500, 'redistribution and use in source')}{_ENDORSE}", 3, 0.95),
    ("bsd-4-clause", "redistribution", f"{_BSD}{_gap(2500, 'redistribution and use in source')}{_ADVERTISE}{_gap(1500, 'redistribution and use in source')}{_ENDORSE}", 4, 0.95),
    ("apache-2", "apache", "apache license version 2 0 january 2004", 3, 1.0),
    ("apache-2", "apache", f"{_UNDER}apache license version 2 0 the license you may not use this file except in compliance with the license", 3, 1.0),
    ("apache-2", "compliance", "licensed under the apache license version 2 0 the license you may not use this (?:file|work|software) except in compliance with the license", 3, 1.0),
    ("apache-1.1", "apache", "the apache software license version 1 1", 3, 0.95),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0", 3, 1.0),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1", 3, 1.0),
    ("mpl-1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 0", 3, 1.0),
    ("epl-1", "eclipse", "made available under the terms of the eclipse public license v(?:ersion)? ?1 0", 3, 0.95),
    ("epl-2", "eclipse", "made available under the terms of the eclipse public license v(?:ersion)? ?2 0", 3, 0.95),
    ("cddl-1", "common", "common development and distribution license(?: cddl)?(?: version)?(?: 1 0)?", 2, 0.9),
    ("cddl-1.1", "common", "common development and distribution license(?: cddl)?(?: version)? 1 1", 2, 0.9),
    ("zlib", "permission", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", 3, 0.95),
    ("boost-1", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 3, 0.95),
    ("boost-1", "boost", "distributed under the boost software license version 1 0", 3, 1.0),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 3, 1.0),
    ("wtfpl", "want", "do what the fuck you want to public license", 3, 1.0),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1", 3, 1.0),
    ("psf-2", "python", "python software foundation license version 2", 3, 0.95),
    ("openssl", "toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit", 3, 0.9),
    ("beerware", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer", 3, 0.95),
    ("ncsa", "ncsa", "university of illinois ncsa open source license", 3, 0.95),
    ("upl-1", "universal", "the universal permissive license (?:upl )?version 1 0", 3, 0.95),
    ("cecill-2.1", "cecill", "cecill free software license agreement version 2 1", 3, 0.95),
    ("eupl-1.2", "european", "european union public licence (?:eupl )?(?:version |v ?)?1 2", 3, 0.95),
    ("eupl-1.1", "european", "european union public licence (?:eupl )?(?:version |v ?)?1 1", 3, 0.95),
    ("sspl-1", "server", "server side public license(?: version 1)?", 3, 0.95),
    ("busl-1.1", "business", "business source license 1 1", 3, 0.95),
    ("elastic-2", "elastic", "elastic license (?:version )?2 0", 3, 0.95),
    ("commons-clause", "commons", "commons clause(?: license)? (?:license )?condition v?1 0", 3, 0.95),
    ("polyform-noncommercial-1", "polyform", "polyform noncommercial license 1 0 0", 3, 0.95),
    ("polyform-small-business-1", "polyform", "polyform small business license 1 0 0", 3, 0.95),
    ("openrail-m", "rail", "(?:creativeml |bigscience |bigcode )?open ?rail m(?: license)?", 3, 0.9),
    ("llama-2", "llama", "llama 2 community license(?: agreement)?", 3, 0.95),
    ("llama-3", "llama", "(?:meta )?llama 3 community license(?: agreement)?", 3, 0.95),
    ("odc-by-1", "commons", "open data commons attribution license(?: v(?:ersion)? ?1 0)?", 3, 0.95),
    ("odbl-1", "commons", "open data commons open database license(?: odbl)?(?: v(?:ersion)? ?1 0)?", 3, 0.95),
    ("pddl-1", "commons", "open data commons public domain dedication (?:and|amp) license(?: pddl)?", 3, 0.95),
    ("cc0-1", "cc0", "cc0 1 0 universal", 3, 1.0),
    ("cc0-1", "commons", "creative commons (?:zero|cc0)(?: (?:v(?:ersion)? ?)?1 0)?(?: universal)?", 3, 0.95),
    ("cc0-1", "commons", "creativecommons org publicdomain zero 1 0", 3, 1.0),
    ("public-domain-mark", "commons", "creativecommons org publicdomain mark 1 0", 3, 0.95),
    ("artistic-2", "artistic", "the artistic license 2 0", 3, 0.95),
    ("qpl-1", "public", "the q public license version 1 0", 3, 0.95),
    ("python-cnri", "cnri", "cnri open source license agreement", 3, 0.9),
    ("vim", "vim", "vim license", 1, 0.7),
    ("proprietary", "prohibited", "unauthorized copying of this (?:file|software|program) via any medium is strictly prohibited", 3, 0.9),
    ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)", 2, 0.8),
]

#: Creative Commons: words of an identifier, and of a name in prose.
CC_KINDS = {
    "by": "attribution",
    "by sa": "attribution share ?alike",
    "by nc": "attribution non ?commercial",
    "by nd": "attribution no ?deriv(?:ative)?s?(?: works)?",
    "by nc sa": "attribution non ?commercial share ?alike",
    "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?",
}
CC_VERSIONS = {"1 0": "1", "2 0": "2", "2 5": "2.5", "3 0": "3", "4 0": "4"}

#: The GNU licenses: label, name in prose, short names, versions as words and in a label, dates of the texts.
GNU = [
    ("gpl", "gnu general public license", "(?:gnu )?gpl", {"1": ("1", "february 1989"), "2": ("2", "june 1991"), "3": ("3", "29 june 2007")}),
    ("lgpl", "gnu (?:lesser|library) general public license", "(?:gnu )?lgpl", {"2": ("2.0", "june 1991"), "2 1": ("2.1", "february 1999"), "3": ("3", "29 june 2007")}),
    ("agpl", "(?:gnu )?affero general public license", "(?:gnu )?agpl", {"1": ("1", "march 2002"), "3": ("3", "19 november 2007")}),
    ("gfdl", "gnu free documentation license", "(?:gnu )?g?fdl", {"1 1": ("1.1", "march 2000"), "1 2": ("1.2", "november 2002"), "1 3": ("1.3", "3 november 2008")}),
]

#: Addresses of license texts, words only.
ADDRESSES = {
    "apache org licenses license 2 0": "apache-2", "opensource org licenses? mit": "mit", "opensource org licenses? isc": "isc", "opensource org licenses? zlib": "zlib",
    "opensource org licenses? bsd 2 clause": "bsd-2-clause", "opensource org licenses? bsd 3 clause": "bsd-3-clause", "opensource org licenses? apache 2 0": "apache-2",
    "opensource org licenses? 0bsd": "0bsd", "opensource org licenses? mpl 2 0": "mpl-2", "opensource org licenses? ms pl": "ms-pl", "opensource org licenses? ms rl": "ms-rl",
    "opensource org licenses? artistic license 2 0": "artistic-2", "mozilla org mpl 2 0": "mpl-2", "mozilla org mpl 1 1": "mpl-1.1", "boost org license 1 0": "boost-1",
    "eclipse org legal epl v10": "epl-1", "eclipse org legal epl 2 0": "epl-2", "eclipse org legal epl v20": "epl-2", "unlicense org": "unlicense", "scripts sil org ofl": "ofl-1.1",
    "gnu org licenses (?:old licenses )?gpl 1 0": "gpl-1", "gnu org licenses (?:old licenses )?gpl 2 0": "gpl-2", "gnu org licenses gpl 3 0": "gpl-3", "gnu org licenses (?:old licenses )?lgpl 2 0": "lgpl-2.0",
    "gnu org licenses (?:old licenses )?lgpl 2 1": "lgpl-2.1", "gnu org licenses lgpl 3 0": "lgpl-3", "gnu org licenses agpl 3 0": "agpl-3", "gnu org licenses fdl 1 3": "gfdl-1.3",
    "opendatacommons org licenses odbl": "odbl-1", "opendatacommons org licenses by": "odc-by-1", "opendatacommons org licenses pddl": "pddl-1",
}

#: Further identifiers of the SPDX list that stand in tags, words only; exceptions (after WITH) among them.
IDENTIFIERS = """
aal|apsl 2 0|beerware|blueoak 1 0 0|bsd 2 clause patent|bsd 3 clause clear|bsd 4 clause uc|busl 1 1|cc pddc|cdla permissive 1 0|cdla permissive 2 0|cdla sharing 1 0|cecill 2 1|cecill b|cecill c
curl|ecl 2 0|efl 2 0|elastic 2 0|eupl 1 1|ftl|hpnd|icu|ijg|imagemagick|intel|ipl 1 0|json|lppl 1 3c|mit cmu|mit modern variant|mulanpsl 2 0|ncsa|ntp|oldap 2 8|pddl 1 0|python 2 0|qpl 1 0|rpl 1 5|sgi b 2 0
sleepycat|spl 1 0|sspl 1 0|tcl|unicode 3 0|unicode dfs 2016|upl 1 0|vim|w3c|x11|zpl 2 1
autoconf exception 3 0|bison exception 2 2|classpath exception 2 0|font exception 2 0|gcc exception 2 0|gcc exception 3 1|linux syscall note|llvm exception|openssl exception|qt gpl exception 1 0|swift exception|wxwindows exception 3 1
""".replace("\n", "|").strip("|").split("|")


def label_of(identifier: str) -> str:
    """The label of an identifier in words: hyphens between words, dots within a version, no trailing .0."""
    version = re.search(r" (\d+(?: \d+)*)$", identifier)
    name = identifier[: version.start()] if version else identifier
    number = re.sub(r"(?:\.0)+$", "", version[1].replace(" ", ".")) if version else ""
    return "-".join([*name.split(), *([number] if number else [])])


def tags() -> dict[str, str]:
    """Identifier in words: label, of those that no family lists."""
    out = {i: label_of(i) for i in IDENTIFIERS}
    for family, _, _, versions in GNU:
        for words, (number, _) in versions.items():
            full = words if " " in words else f"{words} 0"
            out |= {f"{family} {full} {end}": f"{family}-{number}-{end.replace(' ', '-')}" for end in ("only", "or later")}
    return out


def signatures() -> list[tuple[str, str, str, int, float]]:
    out = list(TEXTS)
    for family, name, short, versions in GNU:
        keyword = {"gpl": "gnu", "lgpl": "gnu", "agpl": "affero", "gfdl": "gnu"}[family]
        by = "(?: as published by the free software foundation(?: inc)?)?"
        later = "or (?:at your option )?(?:any )?(?:later|newer|higher)(?: versions?)?"
        for words, (number, date) in versions.items():
            version = f"(?:{words}(?: 0)?)" if " " not in words else words
            stated = f"{_UNDER}{name}(?: (?:{family}|fdl))?{by} (?:either )?(?:version |v ?)?{version}(?: of the license)?{by}"
            out += [
                (f"{family}-{number}-or-later", keyword, f"{stated} {later}", 4, 1.0),
                (f"{family}-{number}-only", keyword, f"{_UNDER}{name} as published by the free software foundation(?: inc)? version {version} of the license(?: only)?", 3, 0.95),
                (f"{family}-{number}-only", keyword, f"{_UNDER}{name} (?:version |v ?)?{version}(?: only)? as published by the free software foundation(?: inc)?", 3, 0.95),
                (f"{family}-{number}", keyword, f"{name} version {version} {date}", 3, 1.0),
                (f"{family}-{number}-or-later", family[-3:], f"{_UNDER}{short} ?(?:version |v ?)?{version} (?:licen[sc]ed? )?{later}", 4, 0.9),
            ]
    for kind, prose in CC_KINDS.items():
        plain = f"cc-{kind.replace(' ', '-')}"
        tail = "(?: (?:international|unported|generic))?(?: public)?(?: licen[sc]e)?"
        out.append((plain, "commons", f"{_UNDER}creative commons {prose}{tail}", 3, 0.9))
        for words, number in CC_VERSIONS.items():
            out.append((f"{plain}-{number}", "commons", f"{_UNDER}creative commons {prose}(?: licen[sc]e)? (?:version |v ?)?{words}{tail}", 3, 1.0))
            out.append((f"{plain}-{number}", "commons", f"creativecommons org licenses {kind} {words}", 3, 1.0))
    for pattern, label in ADDRESSES.items():
        out.append((label, pattern.split()[0], pattern, 3, 1.0))
    return out
